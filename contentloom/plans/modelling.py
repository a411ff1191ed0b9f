"""Queries: model catalog, conversion, migration, schema verification, vectors and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentloom.functions import payload as P
from contentloom.functions.model import model, struct_for
from contentloom.operators import catalog as C, vector_index as I, vectors as E, verify as K, writes as W
from contentloom.plans.reading import NOW
from contentloom.plans.registry import query
from contentloom.session import scratch_path
from contentloom.sources import partitioned, snapshots
from contentloom.streaming.upsert import upsert_stream
from contentloom.streaming.validate import validate_once_stream, validate_stream


@query("a07_model_counts", """
SELECT name, CAST(CASE WHEN k % 13 = 0 THEN 0 WHEN k % 11 = 0 THEN 1 WHEN k % 9 = 0 THEN 0 WHEN k % 7 = 0 THEN 2 WHEN k % 5 = 0 THEN 1 ELSE 7 END AS BIGINT) AS n_fields,
  CAST(CASE WHEN k % 13 = 0 OR k % 11 = 0 OR k % 9 = 0 OR k % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_validators FROM (SELECT name, CAST(id AS BIGINT) AS k FROM @stored_definitions)""")
def model_counts(t):
    return C.counts(t.stored_definitions)


@query("c01_from_json_schema", """
SELECT concat_ws('_', source_schema, name) AS model, field, CAST(pos AS INTEGER) AS pos, type, field = 'name' OR (field = 'amount' AND p_size % 3 = 0) AS required,
  CASE WHEN field = 'amount' THEN CAST(p_size AS STRING) END AS "default", CASE WHEN field = 'name' THEN p_brand ELSE '' END AS description FROM @schema_fields""")
def from_json_schema(t):
    return C.from_json_schema(t.json_schemas.withColumn("name", F.concat_ws("_", "source_schema", "name")))


@query("c02_to_json_schema", """
SELECT model, field, CASE type WHEN 'str' THEN 'string' WHEN 'int' THEN 'integer' WHEN 'float' THEN 'number' WHEN 'datetime' THEN 'string' WHEN 'List[str]' THEN 'array' ELSE 'object' END AS type,
  CASE WHEN type = 'datetime' THEN 'date-time' END AS format, field <> 'brand' AS required, CASE field WHEN 'price' THEN '1.5' WHEN 'brand' THEN p_brand WHEN 'tags' THEN '[]' END AS "default",
  CASE WHEN field = 'brand' THEN 'the brand' END AS description
FROM @fields LEFT JOIN @sound_definitions ON name = model""")
def to_json_schema(t):
    docs = C.to_json_schema(t.stored_definitions)
    v = docs.withColumn("__d", P.safe_json(F.col("json_schema")))
    rows = v.select("name", P.as_list(P.get(F.col("__d"), "required")).alias("r"), F.explode(F.map_entries(P.as_map(P.get(F.col("__d"), "properties")))).alias("e"))
    p = F.col("e.value")
    return rows.select(
        F.col("name").alias("model"), F.col("e.key").alias("field"), P.get_text(p, "type").alias("type"), P.get_text(p, "format").alias("format"),
        F.exists("r", lambda x: P.as_text(x) == F.col("e.key")).alias("required"), P.get_text(p, "default").alias("default"), P.get_text(p, "description").alias("description"))


@query("c03_field_catalog", """
SELECT f.model, f.table_name, f.field, f.type, f.required, CASE f.field WHEN 'brand' THEN concat('"', p_brand, '"') WHEN 'price' THEN '1.5' WHEN 'size' THEN CAST(p_size AS STRING) WHEN 'tags' THEN '[]' END AS "default",
  CASE WHEN f.field = 'brand' THEN 'the brand' ELSE '' END AS description, f.primary_key FROM @fields f LEFT JOIN @sound_definitions m ON m.name = f.model""")
def field_catalog(t):
    return t.fields.select("model", "table_name", "field", "type", "required", "default", "description", "primary_key")


RECORD = model("Record", type="str?", value="float")


@query("c04_typed_columns", """
SELECT event_id, json_extract_string(payload, '$.type') AS type, CAST(json_extract_string(payload, '$.value') AS DOUBLE) AS value FROM @payloads WHERE event_id % 11 <> 0 AND event_id % 7 <> 0""")
def typed_columns(t):
    from contentloom.operators import validation as V

    loose = model("Record", type="Any?", value="float")
    valid = V.validate(t.payloads, "payload", loose).where("is_valid")
    row = F.from_json("payload", struct_for(RECORD))
    return valid.select("event_id", row["type"].alias("type"), row["value"].alias("value"))


@query("c05_export", """
SELECT model, field, type, CASE WHEN name IS NOT NULL THEN field = 'title' ELSE field = 'size' AND type = 'Any' END AS required, CASE WHEN field = 'brand' THEN 'the brand' ELSE '' END AS description,
  CASE field WHEN 'price' THEN '1.5' WHEN 'brand' THEN p_brand END AS "default" FROM @fields LEFT JOIN @sound_definitions ON name = model""")
def export(t):
    docs = C.export(t.stored_definitions)
    rows = docs.select("name", F.explode(F.map_entries(P.as_map(P.get(P.safe_json(F.col("document")), "fields")))).alias("e"))
    p = F.col("e.value")
    return rows.select(F.col("name").alias("model"), F.col("e.key").alias("field"), P.get_text(p, "type").alias("type"),
                       F.try_variant_get(p, "$.required", "boolean").alias("required"), P.get_text(p, "description").alias("description"), P.get_text(p, "default").alias("default"))


@query("s07_export_documents", """
SELECT name, concat('{"model_name":"', name, '","fields":{"title":{"type":"str","required":false,"description":""}}}') AS document FROM @stored_definitions WHERE CAST(id AS BIGINT) % 11 = 0 AND CAST(id AS BIGINT) % 13 <> 0""")
def export_documents(t):
    return C.export(t.stored_definitions.where(~P.json_text(F.col("definition"), "name").isNotNull()))


WANTED_NAMES = "SELECT concat('Model', CAST(s_suppkey * 13 AS STRING)) AS name FROM @supplier UNION ALL SELECT concat('Model', CAST(s_suppkey * 2 AS STRING)) FROM @supplier"


@query("a08_partial_export", f"""
SELECT name, name IN (SELECT name FROM @stored_definitions WHERE json_valid(definition)) AS exported FROM (SELECT DISTINCT name FROM ({WANTED_NAMES}))""")
def partial_export(t):
    good, failed = C.export_named(t.stored_definitions, t.sql(WANTED_NAMES))
    return good.select("name", F.lit(True).alias("exported")).unionByName(failed.select("name", F.lit(False).alias("exported")))


@query("c06_list_definitions", "SELECT id, name, description, object_type, version, '2024-01-01 00:00:00' AS created_at, '2024-01-02 00:00:00' AS updated_at FROM @stored_definitions")
def list_definitions(t):
    return C.list_definitions(t.stored_definitions, timestamps=True)


@query("m01_migrate_fields", """
SELECT name, 'content' AS object_type, 'content' AS model_type, CAST(CASE WHEN k % 11 = 0 THEN 1 WHEN k % 9 = 0 THEN 1 WHEN k % 7 = 0 THEN 2 WHEN k % 5 = 0 THEN 1 ELSE 7 END AS BIGINT) AS n_fields
FROM (SELECT name, CAST(id AS BIGINT) AS k FROM @stored_definitions) WHERE k % 13 <> 0""")
def migrate_fields(t):
    v = P.safe_json(F.col("definition"))
    out = C.migrate_a(t.stored_definitions)
    size = F.coalesce(F.size(P.as_map(P.get(v, "fields"))), F.lit(-1))
    listed = F.size(P.as_list(P.get(v, "fields")))
    return out.select("name", "object_type", P.get_text(v, "model_type").alias("model_type"), F.greatest(size, listed).cast("bigint").alias("n_fields"))


@query("m02_migrate_json_schemas", """
SELECT concat_ws('_', source_schema, name) AS name, field, type, field = 'name' OR (field = 'amount' AND p_size % 3 = 0) AS required,
  CASE WHEN field = 'amount' THEN CAST(p_size AS STRING) END AS "default", CASE WHEN field = 'name' THEN p_brand ELSE '' END AS description FROM @schema_fields""")
def migrate_json_schemas(t):
    return C.field_catalog(C.migrate_b(t.json_schemas)).select(F.col("model").alias("name"), "field", "type", "required", "default", "description")


@query("u01_all_definitions", """
SELECT name, 'content' AS object_type FROM (SELECT name FROM @stored_definitions WHERE json_valid(definition) UNION SELECT concat_ws('_', source_schema, name) FROM @json_schemas)""")
def all_definitions(t):
    both = C.migrate_a(t.stored_definitions).unionByName(C.migrate_b(t.json_schemas))
    empty = t.stored_definitions.where("false")
    return W.upsert(empty, both.withColumn("version", F.lit("1.0")), "name", NOW).select("name", "object_type")


@query("u03_model_names", f"SELECT name FROM @stored_definitions UNION SELECT name FROM ({WANTED_NAMES})")
def model_names(t):
    return C.model_names(t.stored_definitions, t.sql(WANTED_NAMES))


# What each model's table should hold, compared column by column.
COMPARED = """SELECT f.model, f.table_name, f.field, CASE f.type WHEN 'int' THEN 'bigint' WHEN 'float' THEN 'double' WHEN 'datetime' THEN 'timestamp_ntz' ELSE 'string' END AS expected,
  CASE c.data_type WHEN 'int' THEN 'bigint' WHEN 'timestamp' THEN 'timestamp_ntz' ELSE c.data_type END AS actual
FROM @fields f JOIN (SELECT DISTINCT "table" AS table_name FROM @columns) t ON t.table_name = f.table_name LEFT JOIN @columns c ON c."table" = f.table_name AND c."column" = f.field
WHERE f.required AND f.type <> 'List[str]'"""


@query("j08_schema_issues", f"""
SELECT model, table_name AS tbl, field AS col, CASE WHEN actual IS NULL THEN 'missing_column' ELSE 'type_mismatch' END AS issue, expected, actual FROM ({COMPARED}) WHERE actual IS NULL OR actual <> expected""")
def schema_issues(t):
    return K.issues(t.fields, t.columns).withColumnsRenamed({"table": "tbl", "column": "col"})


@query("k01_verify_definitions", f"""
SELECT model, table_name AS tbl, count(*) FILTER (actual IS NULL OR actual <> expected) = 0 AS is_valid, coalesce(string_agg(field, ',' ORDER BY field) FILTER (actual IS NULL), '') AS missing_columns,
  coalesce(string_agg(concat(field, ':', expected, ':', actual), ',' ORDER BY field) FILTER (actual <> expected), '') AS type_mismatches FROM ({COMPARED}) GROUP BY model, table_name""")
def verify_definitions(t):
    out = K.verify(t.fields, t.columns)
    wrong = F.transform("type_mismatches", lambda m: F.concat_ws(":", m["column"], m["expected"], m["actual"]))
    return out.select("model", F.col("table").alias("tbl"), "is_valid", F.array_join("missing_columns", ",").alias("missing_columns"), F.array_join(wrong, ",").alias("type_mismatches"))


@query("k02_unresolved_definitions", f"""
SELECT w.name AS model, CASE WHEN m.name IS NULL THEN concat('Model ''', w.name, ''' not found in registry') ELSE concat('Table ''', m.table_name, ''' not found in schema ''public''') END AS error
FROM (SELECT DISTINCT name FROM ({WANTED_NAMES})) w LEFT JOIN @sound_definitions m ON m.name = w.name WHERE m.name IS NULL OR m.table_name NOT IN (SELECT "table" FROM @columns)""")
def unresolved_definitions(t):
    return K.unresolved(t.sql(WANTED_NAMES).withColumnRenamed("name", "model"), t.sound_definitions, t.columns)


@query("k03_missing_tables", """
SELECT table_name AS tbl, max(name) AS model FROM @sound_definitions WHERE table_name NOT IN (SELECT "table" FROM @columns) GROUP BY table_name""")
def missing_tables(t):
    return K.missing_tables(t.sound_definitions, t.columns).withColumnRenamed("table", "tbl")


@query("k04_target_schema", """
SELECT table_name AS tbl, field AS col, CASE type WHEN 'int' THEN 'bigint' WHEN 'float' THEN 'double' WHEN 'datetime' THEN 'timestamp_ntz' ELSE 'string' END AS data_type, NOT required AS nullable, primary_key FROM @fields""")
def target_schema(t):
    return K.table_schema(t.fields).select(F.col("table").alias("tbl"), F.col("column").alias("col"), "data_type", "nullable", "primary_key")


@query("j07_primary_keys", """SELECT c."table" AS tbl, c."column" AS col FROM @columns c JOIN @fields f ON f.table_name = c."table" AND f.field = c."column" WHERE f.primary_key GROUP BY ALL""")
def primary_keys(t):
    keys = t.fields.where("primary_key").select(F.col("table_name").alias("table"), F.col("field").alias("column"))
    return K.primary_keys(t.columns, keys).select(F.col("table").alias("tbl"), F.col("column").alias("col"))


@query("l04_ordinal_order", """SELECT "table" AS tbl, "column" AS col, pos FROM @columns""")
def ordinal_order(t):
    return t.columns.orderBy("table", "pos").select(F.col("table").alias("tbl"), F.col("column").alias("col"), "pos")


@query("k05_conform_table", "SELECT o_orderkey, o_orderstatus, CAST(NULL AS STRING) AS note, CAST(NULL AS DOUBLE) AS weight FROM orders")
def conform_table(t):
    m = model("Orders", o_orderkey="int", o_orderstatus="str", note="str?", weight="float?")
    return K.conform(t.orders.select("o_orderkey", "o_orderstatus"), m)


@query("k06_range_partition", "SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS o_orderdate_year, count(*) AS n FROM orders GROUP BY 1")
def range_partition(t):
    return K.with_range_partition(t.orders, "o_orderdate").groupBy("o_orderdate_year").agg(F.count("*").alias("n"))


@query("k06_period_read", """
SELECT o_orderkey, o_orderdate::TIMESTAMP AS o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderdate >= DATE '1994-03-01' AND o_orderdate < DATE '1995-02-01'""")
def period_read(t):
    orders = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), F.col("o_totalprice").cast("double").alias("o_totalprice"), F.lit(0).alias("revision"))
    rows, path, by = partitioned.by_period(orders, "o_orderdate"), scratch_path(t.spark, "periods"), ["o_orderdate_year"]
    partitioned.write(rows, path, by)
    late = rows.where("o_orderkey % 7 = 0 AND year(o_orderdate) = 1994 OR o_orderkey % 7 = 0 AND year(o_orderdate) = 1995").withColumns({"o_totalprice": F.lit(0.0), "revision": F.lit(1)})
    partitioned.merge(late, path, rows.schema, by, "o_orderkey", ["revision"])
    found = partitioned.between(partitioned.read(t.spark, path, rows.schema), "1994-03-01", "1995-02-01", "o_orderdate")
    return found.select("o_orderkey", "o_orderdate", "o_totalprice")


# Every vector is a query. Scores are rounded before ranking, so equal scores rank by id.
SIMILAR = """SELECT query_id, content_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.content_id AS query_id, v.content_id, s.score, row_number() OVER (PARTITION BY q.content_id ORDER BY s.score DESC, v.content_id) AS rank
FROM @vectors q JOIN @vectors v ON {where}, LATERAL (SELECT round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score) s) WHERE rank <= {k}"""


def asked(t):
    return t.vectors.select(F.col("content_id").alias("query_id"), "embedding")


@query("e01_similar_content", SIMILAR.format(where="true", k=10))
def similar_content(t):
    return E.top_k(asked(t), t.vectors, 10)


@query("e01_similar_filtered", SIMILAR.format(where="v.content_type = 'label-2' AND json_extract_string(v.metadata, '$.label') = '2'", k=3))
def similar_filtered(t):
    return E.top_k(asked(t), t.vectors, 3, "label-2", {"label": "2"})


@query("e01_similar_above_threshold", f"SELECT * FROM ({SIMILAR.format(where='true', k=5)}) WHERE score >= 0.4")
def similar_above(t):
    return E.top_k(asked(t), t.vectors, 5, threshold=0.4)


@query("l03_similar_in_blocks", SIMILAR.format(where="true", k=4))
def similar_in_blocks(t):
    return E.top_k(asked(t), t.vectors, 4, blocks=4, shards=8)


# Queries whose id is divisible by 100, against all vectors.
HUNDREDTH = "CAST(substr(q.content_id, 5) AS BIGINT) % 100 = 0"


def indexed(t):
    """An index of all vectors and the queries of every hundredth."""
    asked_for = asked(t).where(F.substring("query_id", 5, 20).cast("bigint") % 100 == 0)
    return I.build(t.vectors, scratch_path(t.spark, "vector-index")), asked_for


@query("e01_index_similar", SIMILAR.format(where=HUNDREDTH, k=10))
def index_similar(t):
    return I.search(*indexed(t), 10)


@query("e01_index_filtered", SIMILAR.format(where=f"{HUNDREDTH} AND v.content_type = 'label-1' AND json_extract_string(v.metadata, '$.label') = '1'", k=5))
def index_filtered(t):
    return I.search(*indexed(t), 5, "label-1", {"label": "1"})


@query("l03_index_above_threshold", f"SELECT * FROM ({SIMILAR.format(where=HUNDREDTH, k=20)}) WHERE score >= 0.4")
def index_above(t):
    return I.search(*indexed(t), 20, threshold=0.4)


@query("e02_extract_text", "SELECT id, concat_ws(' ', text, CASE WHEN length(text) > 0 THEN 'about ' || content_type ELSE 'about ' || content_type END) AS text FROM @doc_contents")
def extract_text(t):
    extra = P.merge_object(F.col("content"), {"summary": P.quoted(F.concat(F.lit("about "), "content_type"))})
    return t.doc_contents.select("id", E.extract_text(extra).alias("text"))


@query("e03_vector_sync", """
SELECT coalesce(c.id, v.content_id) AS id, CASE WHEN v.content_id IS NULL THEN 'missing_vector' ELSE 'orphan_vector' END AS issue
FROM @doc_contents c FULL JOIN @vectors v ON v.content_id = c.id WHERE c.id IS NULL OR v.content_id IS NULL""")
def vector_sync(t):
    return E.sync_report(t.doc_contents, t.vectors)


@query("j09_contents_with_vectors", "SELECT c.id, c.title, v.content_type AS label, CAST(len(v.embedding) AS INTEGER) AS dims FROM @doc_contents c JOIN @vectors v ON v.content_id = c.id")
def contents_with_vectors(t):
    joined = E.join_vectors(t.doc_contents.select("id", "title"), t.vectors)
    return joined.select("id", "title", F.col("content_type").alias("label"), F.size("embedding").alias("dims"))


def event_stream(t):
    """The event table read as a stream."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(t.folder + "/events*.parquet")
    return stream


@query("st1_stream_validation", "SELECT event_id, event_type IN ('click', 'view') AS is_valid FROM events")
def stream_validation(t):
    from contentloom.functions import rules as R

    m = model("Event", (R.one_of("kind", ["click", "view"]),), kind="str", value="float")
    text = F.to_json(F.struct(F.col("event_type").alias("kind"), "value"))
    path, checkpoint = scratch_path(t.spark, "valid"), scratch_path(t.spark, "progress")
    validate_stream(event_stream(t).select("event_id", text.alias("payload")), "payload", m, path, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.parquet(path).select("event_id", F.col("is_valid").cast("boolean").alias("is_valid"))


@query("st1_replayed_records", "SELECT event_id, event_type IN ('click', 'view') AS is_valid FROM events")
def replayed_records(t):
    """Events in four files by time, each with records of the file before it once more, validated once each."""
    from contentloom.functions import rules as R

    m = model("Event", (R.one_of("kind", ["click", "view"]),), kind="str", value="float")
    text = F.to_json(F.struct(F.col("event_type").alias("kind"), "value"))
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), text.alias("payload"))
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    quarter = F.least(F.floor((F.unix_micros("ts") - low) * 4 / max(1, high - low)), F.lit(3))
    source, path, checkpoint = (scratch_path(t.spark, x) for x in ("events", "valid", "progress"))
    for n in range(4):
        again = rows.where((quarter == n - 1) & (F.col("event_id") % 2 == 0))
        rows.where(quarter == n).union(again).coalesce(1).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    delay = f"{(high - low) // 2 // 1_000_000 + 1} seconds"
    validate_once_stream(stream, "payload", m, path, checkpoint, "event_id", "ts", delay, available_now=True).awaitTermination()
    return t.spark.read.parquet(path).select("event_id", F.col("is_valid").cast("boolean").alias("is_valid"))


@query("st2_stream_upsert", """
SELECT user_id, id, context, updated_at FROM (SELECT user_id, CAST(event_id AS STRING) AS id, props AS context, ts AS updated_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_upsert(t):
    rows = event_stream(t).select("user_id", "event_id", F.col("event_id").cast("string").alias("id"), F.col("props").alias("context"), F.col("ts").alias("updated_at"))
    root, checkpoint = scratch_path(t.spark, "contexts"), scratch_path(t.spark, "progress")
    upsert_stream(rows, root, ["user_id"], ["updated_at", "event_id"], checkpoint, available_now=True).awaitTermination()
    return snapshots.read(t.spark, root, ["user_id"], ["updated_at", "event_id"]).select("user_id", "id", "context", "updated_at")



