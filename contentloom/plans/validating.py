"""Queries: validation of records, rules and definitions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from contentloom.functions import rules as R
from contentloom.functions.model import FieldDef, Model, model
from contentloom.functions.typespec import parse_type
from contentloom.operators import catalog, validation as V
from contentloom.plans.registry import derive, query

EVENT = model("Event", type="str", value="float")

# Error texts of the event payloads by their own CASE, for the SQL twins.
derive("event_errors", """
SELECT event_id, event_type, payload, CASE
  WHEN event_id % 11 = 0 THEN '|invalid_json|payload is not valid JSON'
  WHEN event_id % 7 = 0 THEN 'value|invalid|Invalid type for value: expected number, got str'
  WHEN event_id % 5 = 0 THEN 'type|invalid|Missing required field: type'
  WHEN event_id % 3 = 0 THEN 'type|invalid|Invalid type for type: expected string, got NoneType' ELSE '' END AS errors
FROM @payloads
""")


def shown(df, *cols):
    return df.select(*cols, "is_valid", V.error_text(F.col("errors")).alias("errors"))


@query("v01_validate", "SELECT event_id, errors = '' AS is_valid, errors, CASE WHEN errors = '' THEN payload END AS validated_data FROM @event_errors")
def validate(t):
    return V.validate(t.payloads, "payload", EVENT).select(
        "event_id", "is_valid", V.error_text(F.col("errors")).alias("errors"), "validated_data")


@query("v02_required_fields", """
SELECT event_id, event_id % 5 <> 0 OR event_id % 7 = 0 OR event_id % 11 = 0 AS named,
       CASE WHEN event_id % 11 = 0 THEN 1 ELSE 1 + CASE WHEN event_id % 5 = 0 AND event_id % 7 <> 0 THEN 1 ELSE 0 END END AS n_errors FROM @payloads""")
def required_fields(t):
    m = Model("E", (
        FieldDef("type"), FieldDef("level"), FieldDef("kind", "str", default="x", has_default_key=True),
        FieldDef("note", "str", required=False),
    ))
    out = V.validate(t.payloads, "payload", m)
    named = ~F.exists("errors", lambda e: e["message"] == "Missing required field: type")
    return out.select("event_id", named.alias("named"), F.size("errors").alias("n_errors"))


@query("v02_null_default_strict", "SELECT event_id, false AS loose, event_id % 11 <> 0 AS strict FROM @payloads")
def null_default_strict(t):
    m = Model("E", (FieldDef("extra", "str", has_default_key=True),))
    loose = V.validate(t.payloads, "payload", m).select("event_id", "payload", F.col("is_valid").alias("loose"))
    return V.validate(loose, "payload", m, strict_reference=True).select("event_id", "loose", F.col("is_valid").alias("strict"))


@query("v03_partial", """
SELECT event_id, errors = '' OR errors LIKE '%Missing%' AS is_valid, CASE WHEN errors LIKE '%Missing%' THEN '' ELSE errors END AS errors FROM @event_errors""")
def partial(t):
    return shown(V.validate(t.payloads, "payload", EVENT, partial=True), "event_id")


# Python type names of the values in the case payloads.
derive("case_types", """
SELECT event_id, payload, kind, CASE WHEN kind IN (0, 11, 12, 13, 14, 15, 18) THEN 'str' WHEN kind IN (1, 16) THEN 'int' WHEN kind IN (2, 17) THEN 'float' WHEN kind = 3 THEN 'bool'
  WHEN kind = 4 THEN 'NoneType' WHEN kind IN (5, 6, 7, 19) THEN 'list' ELSE 'dict' END AS py FROM @cases
""")


def case_errors(t, *types: str):
    """The error text of every case value against each type."""
    from contentloom.functions import payload as P
    from contentloom.functions.typespec import check

    v = P.get(F.col("__v"), "v")
    parsed = t.cases.withColumn("__v", P.safe_json(F.col("payload")))
    return V.once(parsed, **{f"e{i}": check(v, parse_type(s)) for i, s in enumerate(types)}).drop("__v", "payload")


@query("v04_basic_types", """
SELECT event_id, kind, CASE WHEN py <> 'str' THEN concat('expected string, got ', py) END AS e0, CASE WHEN py <> 'int' THEN concat('expected integer, got ', py) END AS e1,
  CASE WHEN py NOT IN ('int', 'float') THEN concat('expected number, got ', py) END AS e2, CASE WHEN py <> 'bool' THEN concat('expected boolean, got ', py) END AS e3,
  CASE WHEN py <> 'NoneType' THEN concat('expected None, got ', py) END AS e4, CAST(NULL AS STRING) AS e5 FROM @case_types""")
def basic_types(t):
    return case_errors(t, "str", "int", "float", "bool", "None", "Any")


@query("v05_datetimes", """
SELECT event_id, kind, CASE WHEN py <> 'str' THEN concat('expected datetime or ISO format string, got ', py) WHEN kind NOT IN (11, 18) THEN 'invalid datetime format' END AS e0 FROM @case_types""")
def datetimes(t):
    return case_errors(t, "datetime")


@query("v06_lists", """
SELECT event_id, kind, CASE WHEN py <> 'list' THEN concat('expected list, got ', py) WHEN kind = 6 THEN 'invalid item at index 1: expected string, got int'
    WHEN kind = 19 THEN 'invalid item at index 0: expected string, got list' END AS e0,
  CASE WHEN py <> 'list' THEN concat('expected list, got ', py) WHEN kind IN (5, 6) THEN 'invalid item at index 0: expected list, got str'
    WHEN kind = 19 THEN 'invalid item at index 1: invalid item at index 0: expected integer, got str' END AS e1 FROM @case_types""")
def lists(t):
    return case_errors(t, "List[str]", "List[List[int]]")


@query("v07_dicts", """
SELECT event_id, kind, CASE WHEN py <> 'dict' THEN concat('expected dictionary, got ', py) WHEN kind = 9 THEN 'invalid value for key ''b'': expected integer, got str' END AS e0,
  CASE WHEN py <> 'dict' THEN concat('expected dictionary, got ', py) WHEN kind IN (8, 9) THEN 'invalid key: expected integer, got str' END AS e1 FROM @case_types""")
def dicts(t):
    return case_errors(t, "Dict[str, int]", "Dict[int, Any]")


@query("v08_unions", """
SELECT event_id, kind, CASE WHEN py NOT IN ('str', 'int') THEN concat('value did not match any of the expected types: expected string, got ', py, ', expected integer, got ', py) END AS e0,
  CASE WHEN py <> 'bool' AND kind <> 8 AND kind <> 10 THEN concat('value did not match any of the expected types: expected boolean, got ', py, ', ',
    CASE WHEN kind = 9 THEN 'invalid value for key ''b'': expected integer, got str' ELSE concat('expected dictionary, got ', py) END) END AS e1 FROM @case_types""")
def unions(t):
    return case_errors(t, "Union[str, int]", "Union[bool, Dict[str, int]]")


@query("v09_optionals", """
SELECT event_id, kind, CASE WHEN py NOT IN ('str', 'NoneType') THEN concat('expected string, got ', py) END AS e0,
  CASE WHEN py = 'NoneType' OR kind IN (5, 7) THEN NULL WHEN py <> 'list' THEN concat('expected list, got ', py) WHEN kind = 6 THEN 'invalid item at index 1: expected string, got int'
    ELSE 'invalid item at index 0: expected string, got list' END AS e1 FROM @case_types""")
def optionals(t):
    return case_errors(t, "Optional[str]", "Optional[List[Optional[str]]]")


@query("v10_unsupported_types", """
SELECT event_id, kind, 'unsupported type: Decimal' AS e0, CASE WHEN py <> 'list' THEN concat('expected list, got ', py) WHEN kind <> 7 THEN 'invalid item at index 0: unsupported type: date' END AS e1 FROM @case_types""")
def unsupported_types(t):
    return case_errors(t, "Decimal", "List[date]")


@query("t07_nested_types", """
SELECT event_id, kind, CASE WHEN py <> 'dict' THEN concat('expected dictionary, got ', py) WHEN kind IN (8, 9) THEN 'invalid value for key ''a'': expected dictionary, got int' END AS e0,
  CASE WHEN py <> 'list' THEN concat('expected list, got ', py) END AS e1, CASE WHEN py <> 'dict' THEN concat('expected dictionary, got ', py) END AS e2 FROM @case_types""")
def nested_types(t):
    return case_errors(t, "Dict[str, Dict[str, int]]", "List", "Dict")


@query("v11_rules_after_fields", """
SELECT event_id, errors = '' AND event_id % 2 = 0 AS is_valid, CASE WHEN errors <> '' THEN errors WHEN event_id % 2 <> 0 THEN '|invalid|Validator even_event failed: event must be even' ELSE '' END AS errors FROM @event_errors""")
def rules_after_fields(t):
    even = R.Rule("even_event", ("id",), lambda r: F.col("event_id") % 2 != 0, "event must be even")
    return shown(V.validate(t.payloads, "payload", EVENT.with_rules(even)), "event_id")


def ruled(t, *found: R.Rule):
    return shown(V.validate(t.posts, "content", Model("Post", (), found)), "id")


# The posts with the values the rules look at, read once for the SQL twins.
derive("post_values", """
SELECT id, content, json_extract_string(content, '$.title') AS title, json_extract_string(content, '$.body') AS body, json_extract_string(content, '$.excerpt') AS excerpt,
  json_extract_string(content, '$.status') AS status, json_extract_string(content, '$.slug') AS slug, CAST(json_extract_string(content, '$.score') AS BIGINT) AS score,
  json_extract_string(content, '$.uid') AS uid, json_extract_string(content, '$.url') AS url, json_type(content, '$.steps') AS steps_type,
  CAST(json_extract(content, '$.steps') AS STRING) AS steps, json_keys(content, '$.system_message') AS system_keys, json_type(content, '$.human_message') AS human_type,
  json_keys(content, '$.metadata') AS meta_keys
FROM @posts
""")


def twin(condition: str, name: str, message: str) -> str:
    """SQL for one rule: rows that meet the condition carry the message."""
    text = f"'|invalid|Validator {name} failed: {message}'"
    return f"SELECT id, NOT ({condition}) AS is_valid, CASE WHEN {condition} THEN {text} ELSE '' END AS errors FROM @post_values"


@query("v12_not_blank", twin("trim(title) = ''", "title_not_empty", "title cannot be empty"))
def not_blank(t):
    return ruled(t, R.not_blank("title"))


@query("v13_length_between", twin("length(title) < 5 OR length(title) > 100", "title_length", "title must have 5 to 100 characters"))
def length_between(t):
    return ruled(t, R.length_between("title", 5, 100))


@query("v14_has_keys", """
SELECT id, len(gone) = 0 AS is_valid, CASE WHEN len(gone) > 0 THEN concat('|invalid|Validator system_message_keys failed: system_message lacks ', array_to_string(gone, ', ')) ELSE '' END AS errors
FROM (SELECT id, list_filter(['agent_role', 'agent_task'], lambda k: NOT list_contains(system_keys, k)) AS gone FROM @post_values)""")
def has_keys(t):
    return ruled(t, R.has_keys("system_message", ["agent_role", "agent_task"]))


@query("v15_any_of", twin("len(system_keys) = 0 AND human_type = 'NULL'", "any_of_system_message_human_message", "at least one must be given: system_message, human_message"))
def any_of(t):
    return ruled(t, R.any_of("system_message", "human_message"))


@query("v16_each_has_key", twin("steps_type <> 'ARRAY' OR steps = '[]' OR steps LIKE '%other%'", "steps_items", "steps must be a non-empty list of objects with prompt_name"))
def each_has_key(t):
    return ruled(t, R.each_has_key("steps", "prompt_name"))


@query("v17_metadata_contract", """
SELECT id, CASE WHEN list_contains(meta_keys, 'content_type') THEN '' ELSE 'metadata.content_type|invalid|required metadata is missing: content_type' END AS errors,
  CASE WHEN list_contains(meta_keys, 'audience') THEN '' ELSE 'metadata.audience|invalid|recommended metadata is missing: audience' END AS warnings FROM @post_values""")
def metadata_contract(t):
    m = Model("Post", metadata_required=("content_type", "tags"), metadata_recommended=("audience",))
    out = V.validate(t.posts, "content", m)
    return out.select("id", V.error_text(F.col("errors")).alias("errors"), V.error_text(F.col("warnings")).alias("warnings"))


@query("v18_lint_definitions", """
SELECT name, trim(concat_ws('; ', type_error, body_error), '; ') AS errors FROM (
  SELECT name, CASE WHEN object_type IS NULL THEN 'object_type|invalid|Invalid model type: null' WHEN object_type = 'delta' THEN 'object_type|invalid|Invalid model type: delta' END AS type_error,
    CASE WHEN k % 13 = 0 THEN '|invalid|definition is not valid JSON' WHEN k % 11 = 0 THEN '|invalid|Missing required keys in model definition: name'
      WHEN k % 9 = 0 THEN 'fields|invalid|''fields'' must be a dictionary'
      WHEN k % 7 = 0 THEN 'fields|invalid|Missing required keys in field ''size'': type; validators|invalid|''validators'' must be a list'
      WHEN k % 5 = 0 THEN 'validators|invalid|Each validator must have a ''code'' key; metadata_schema|invalid|''metadata_schema'' must be a dictionary' END AS body_error
  FROM (SELECT *, CAST(id AS BIGINT) AS k FROM @stored_definitions))""")
def lint_definitions(t):
    return catalog.lint(t.stored_definitions).select("name", V.error_text(F.col("errors")).alias("errors"))


@query("v19_one_of", twin("status NOT IN ('draft', 'published', 'archived')", "status_allowed", "status must be one of: draft, published, archived"))
def one_of(t):
    return ruled(t, R.one_of("status", ["draft", "published", "archived"]))


@query("v20_pattern", twin("NOT regexp_matches(slug, '^[a-z0-9-]+$')", "slug_pattern", "slug does not match the pattern"))
def pattern(t):
    return ruled(t, R.pattern("slug", "^[a-z0-9-]+$"))


@query("v20_minimum", twin("score < 1", "score_minimum", "score must be at least 1"))
def minimum(t):
    return ruled(t, R.min_value("score", 1))


@query("v20_formats", """
SELECT id, uid <> 'nope' AND url <> 'no link' AS is_valid, concat_ws('; ', CASE WHEN uid = 'nope' THEN '|invalid|Validator uid_format failed: uid is no uuid' END,
  CASE WHEN url = 'no link' THEN '|invalid|Validator url_format failed: url is no uri' END) AS errors FROM @post_values""")
def formats(t):
    return ruled(t, R.format_is("uid", "uuid"), R.format_is("url", "uri"))


@query("v21_contains_field", """
SELECT id, contains(body, excerpt) AS is_valid, CASE WHEN contains(body, excerpt) THEN '' ELSE 'excerpt|invalid|Excerpt must be derived from content' END AS errors FROM @post_values""")
def contains_field(t):
    return ruled(t, R.contains_field("excerpt", "body", "Excerpt must be derived from content"))


@query("v22_mixed_definitions", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '|invalid_json|payload is not valid JSON' WHEN event_type = 'view' THEN CASE WHEN errors LIKE 'type|%' THEN errors ELSE '' END
  WHEN event_type = 'click' THEN CASE WHEN errors LIKE 'value|%' THEN errors ELSE '' END
  ELSE concat('|model_not_found|Model not found: ', event_type) END AS errors FROM @event_errors""")
def mixed_definitions(t):
    out = V.validate_mixed(t.payloads, "payload", "event_type", {"view": model("view", type="str"), "click": model("click", value="float")})
    return out.select("event_id", V.error_text(F.col("errors")).alias("errors"))


@query("v23_typed_class", """
SELECT id, concat_ws('; ', CASE WHEN NOT list_contains(system_keys, 'agent_task') THEN 'system_message.agent_task|invalid|Missing required field: system_message.agent_task' END,
  CASE WHEN steps_type <> 'ARRAY' THEN 'steps|invalid|Invalid type for steps: expected list, got str' END) AS errors FROM @post_values""")
def typed_class(t):
    inner = T.StructType([T.StructField("agent_role", T.StringType()), T.StructField("agent_task", T.StringType(), False)])
    schema = T.StructType([
        T.StructField("title", T.StringType(), False), T.StructField("system_message", inner, False),
        T.StructField("steps", T.ArrayType(T.MapType(T.StringType(), T.VariantType())), False), T.StructField("absent", T.LongType()),
    ])
    return V.validate_struct(t.posts, "content", schema).select("id", V.error_text(F.col("errors")).alias("errors"))


@query("v24_split", "SELECT event_id, CASE WHEN errors = '' THEN 'valid' ELSE 'quarantine' END AS sink FROM @event_errors")
def split(t):
    valid, bad = V.split(V.validate(t.payloads, "payload", EVENT))
    return valid.select("event_id", F.lit("valid").alias("sink")).unionByName(bad.select("event_id", F.lit("quarantine").alias("sink")))


AUDIT = """SELECT {by} count(*) AS n_rows, count(*) FILTER (errors = '') AS n_valid, count(*) FILTER (errors <> '') AS n_invalid, count(*) FILTER (errors <> '') AS n_errors FROM @event_errors {group}"""


@query("v25_audit", AUDIT.format(by="event_type,", group="GROUP BY event_type"))
def audit(t):
    return V.audit(t.payloads, "payload", EVENT, "event_type")


@query("v26_combined_object", """
SELECT id, content_type IN ('collection', 'article') OR content_type IS NULL AS is_valid,
  CASE WHEN content_type IN ('collection', 'article') THEN '' ELSE '|invalid|Validator content_type_allowed failed: content_type must be one of: collection, article' END AS errors FROM @contents""")
def combined_object(t):
    m = model("Stored", (R.one_of("content_type", ["collection", "article"]),), content_type="str", title="str", content="Dict[str, Any]", metadata="Dict[str, Any]")
    return shown(V.validate_object(t.contents, m), "id")


@query("ud1_user_rule", """
SELECT id, score >= 0 AND length(slug) > 8 AS is_valid, concat_ws('; ', CASE WHEN score < 0 THEN '|invalid|Validator score_not_negative failed: score below zero' END,
  CASE WHEN length(slug) <= 8 THEN '|invalid|Validator long_slug failed: slug too short' END) AS errors FROM @post_values""")
def user_rule(t):
    by_sql = R.register("score_not_negative", ["score"], "CAST([score] AS INT) >= 0 AND [slug] IS NOT NULL", "score below zero")
    by_code = R.register("long_slug", ["slug"], lambda r: F.length(r.text("slug")) > 8, "slug too short")
    return ruled(t, by_sql, by_code)


@query("a01_summary", AUDIT.format(by="", group=""))
def summary(t):
    return V.summary(V.validate(t.payloads, "payload", EVENT))


@query("a02_error_list", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 1 END AS n_errors FROM @payloads""")
def error_list(t):
    out = V.validate(t.payloads, "payload", model("E", type="Optional[str]", value="float", extra="int"))
    return out.select("event_id", F.size("errors").alias("n_errors"))


@query("a03_error_histogram", """
SELECT path, code, count(*) AS n FROM (SELECT split_part(errors, '|', 1) AS path, split_part(errors, '|', 2) AS code FROM @event_errors WHERE errors <> '') GROUP BY path, code""")
def error_histogram(t):
    return V.error_histogram(V.validate(t.payloads, "payload", EVENT))


@query("a04_batch_gate", "SELECT event_id, errors = '' AS is_valid, (SELECT count(*) = 0 FROM @event_errors WHERE errors <> '') AS batch_valid FROM @event_errors")
def batch_gate(t):
    return V.with_gate(V.validate(t.payloads, "payload", EVENT)).select("event_id", "is_valid", "batch_valid")


@query("a04_all_or_nothing", "SELECT event_id FROM @cases WHERE (SELECT count(*) = 0 FROM @cases WHERE NOT json_valid(payload))")
def all_or_nothing(t):
    return V.all_or_nothing(V.validate(t.cases, "payload", model("Case", v="Any"))).select("event_id")
