"""Prompt templates, their adaptations, prompt assembly and prompt chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from contentloom.functions import payload as P
from contentloom.functions.text import slug
from contentloom.operators.skew import fold, salted_join
from contentloom.operators.store import templates_in
from contentloom.operators.writes import at, object_id

# Defaults of template fields.
DEFAULTS = {
    "template_text": "", "variables": "{}", "model": "gpt-4-turbo", "temperature": "0.7", "description": "",
    "category": "general", "version": "1.0",
}
# What a template keeps in its content and in its metadata.
IN_CONTENT = ("template_text", "variables", "model", "temperature", "description")
IN_METADATA = ("category", "version", "tags")
# Template fields that hold JSON values rather than text.
JSON_FIELDS = ("variables", "temperature", "tags")

# Component orders of assembled prompts.
ORDERS = {
    "standard": [
        "positioning_sentence", "agent_role", "agent_task", "agent_goal", "agent_tools", "key_information",
        "context_placeholder", "controlled_context_placeholder", "additional_instructions", "agent_response",
        "output_format", "closing_instructions", "focused_question",
    ],
    "chatbot": [
        "positioning_sentence", "agent_role", "agent_task", "agent_goal", "focused_question", "agent_tools",
        "key_information", "context_placeholder", "controlled_context_placeholder", "additional_instructions",
        "agent_response", "output_format", "closing_instructions",
    ],
    "agent": [
        "positioning_sentence", "agent_role", "agent_task", "agent_tools", "additional_instructions",
        "agent_response", "focused_question",
    ],
}


def _json(df: DataFrame, name: str) -> Column:
    """A template field as JSON text, NULL without value."""
    return F.col(name).cast("string") if name in JSON_FIELDS else P.quoted(F.col(name))


def _value(df: DataFrame, name: str, default: str) -> Column:
    """A template field, or its default, ready for a JSON object."""
    given = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    value = F.coalesce(given, F.lit(default))
    return (F.try_parse_json(value) if name in JSON_FIELDS else value).alias(name)


def _object(*fields: Column) -> Column:
    """A JSON object; NULL fields are left out."""
    return F.to_json(F.struct(*fields))


def _list(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def build(df: DataFrame, now: datetime | str) -> DataFrame:
    """Content objects for templates given as columns; missing fields get defaults."""
    content = _object(*[_value(df, k, DEFAULTS[k]) for k in IN_CONTENT])
    metadata = _object(
        *[_value(df, k, DEFAULTS[k]) for k in ("category", "version")],
        F.lit("active").alias("status"), _value(df, "tags", '["template"]'),
        F.lit(0).alias("hierarchy_level"), F.lit("prompt_template").alias("object_type"),
        _list().alias("references"), _list().alias("referenced_by"),
    )
    title = F.coalesce("name", F.lit("Untitled Template"))
    given = F.col("id") if "id" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.coalesce(given, object_id(F.lit("prompt_template"), title, content)).alias("id"),
        F.lit("prompt_template").alias("content_type"), title.alias("title"), slug(title).alias("slug"),
        content.alias("content"), metadata.alias("metadata"),
        at(now).alias("created_at"), at(now).alias("updated_at"),
    )


def view(df: DataFrame) -> DataFrame:
    """Template objects as typed columns, with defaults for absent fields."""
    parsed = df.withColumn("__c", P.safe_json(F.col("content"))).withColumn("__m", P.safe_json(F.col("metadata")))
    read = lambda v, k: F.coalesce(P.get_text(F.col(v), k), F.lit(DEFAULTS[k])).alias(k)
    return parsed.select(
        "id", F.col("title").alias("name"),
        *[read("__c", k) for k in IN_CONTENT if k != "temperature"],
        F.coalesce(F.try_variant_get("__c", "$.temperature", "double"), F.lit(float(DEFAULTS["temperature"]))).alias("temperature"),
        read("__m", "category"), read("__m", "version"),
        F.coalesce(F.try_variant_get("__m", "$.tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        "created_at", "updated_at",
    )


def list_templates(df: DataFrame, category: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of templates, newest first."""
    found = templates_in(df.where(F.col("content_type") == "prompt_template"), category, limit, offset)
    return view(found).drop("version", "tags")


def by_name(df: DataFrame, name: str) -> DataFrame:
    return view(df.where((F.col("content_type") == "prompt_template") & (F.col("title") == name)))


def update_templates(current: DataFrame, patches: DataFrame, now: datetime | str, order: Sequence[str]) -> DataFrame:
    """Sparse update: only the fields a patch gives change; of several patches each field takes the last value in ``order``."""
    fields = [c for c in (*IN_CONTENT, *IN_METADATA) if c in patches.columns]
    one = fold(patches, ["id"], order, fields)
    changes = one.select("id", F.lit(True).alias("__hit"), *[_json(one, c).alias(f"__{c}") for c in fields])
    joined = current.join(changes, "id", "left")
    part = lambda text, names: F.when(
        F.col("__hit"), P.merge_object(F.col(text), {c: F.col(f"__{c}") for c in names if c in fields})
    ).otherwise(F.col(text))
    replaced = {"updated_at": F.when(F.col("__hit"), at(now)).otherwise(F.col("updated_at"))}
    if any(c in fields for c in IN_CONTENT):
        replaced["content"] = part("content", IN_CONTENT)
    if any(c in fields for c in IN_METADATA):
        replaced["metadata"] = part("metadata", IN_METADATA)
    return joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in current.columns])


def adapt(templates: DataFrame, adaptations: DataFrame, now: datetime | str) -> tuple[DataFrame, DataFrame]:
    """Adapted templates, and the adaptations whose original does not exist.

    An adaptation inherits model, temperature, category and title from its
    original. Popular originals are spread over several tasks.
    """
    originals = templates.select(
        F.col("id").alias("original_template_id"), F.col("title").alias("__title"),
        P.json_text(F.col("content"), "model").alias("__model"),
        P.json_text(F.col("content"), "temperature").alias("__temperature"),
        P.json_text(F.col("metadata"), "category").alias("__category"),
        F.lit(True).alias("__found"),
    )
    joined = salted_join(adaptations, originals, ["original_template_id"], ["id"], "left")
    lost = joined.where(F.col("__found").isNull()).select(
        *adaptations.columns,
        F.concat(F.lit("Original template "), F.coalesce("original_template_id", F.lit("null")), F.lit(" not found")).alias("error"),
    )
    good = joined.where(F.col("__found"))
    inherited = good.withColumn("model", F.coalesce("model", "__model", F.lit(DEFAULTS["model"]))).withColumn(
        "temperature", F.coalesce("temperature", "__temperature", F.lit(DEFAULTS["temperature"]))
    ).withColumn("category", F.coalesce("__category", F.lit(DEFAULTS["category"])))
    content = _object(*[_value(inherited, k, DEFAULTS[k]) for k in IN_CONTENT if k != "description"], F.col("original_template_id"))
    metadata = _object(
        F.col("category"), _value(inherited, "version", DEFAULTS["version"]),
        F.lit("active").alias("status"), _list("adapted_template").alias("tags"), F.col("site_id"), F.col("project_id"),
        F.col("original_template_id").alias("parent_id"), F.lit(1).alias("hierarchy_level"),
        F.lit("adapted_prompt_template").alias("object_type"),
    )
    title = F.concat(F.col("__title"), F.lit(" (Adapted)"))
    created = F.col("created_at") if "created_at" in adaptations.columns else at(now)
    made = inherited.select(
        "id", F.lit("adapted_prompt_template").alias("content_type"), title.alias("title"), slug(title).alias("slug"),
        content.alias("content"), metadata.alias("metadata"), "original_template_id", "site_id", "project_id",
        created.alias("created_at"), at(now).alias("updated_at"),
    )
    return made, lost


def find_adaptation(adapted: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest adaptation per request (original_template_id, site_id, project_id).

    An adaptation fits if its site or its project is the requested one. Each arm
    is an equi-join of its own. An arm keeps the newest adaptation per template
    and site (or project) before it joins, so no task holds all candidates.
    """
    request = ["original_template_id", "site_id", "project_id"]
    asked = wanted.select(*request).distinct()
    value = F.struct("created_at", "id")
    found = None
    for arm in ("site_id", "project_id"):
        newest = adapted.where(F.col(arm).isNotNull()).groupBy("original_template_id", arm).agg(F.max(value).alias("best"))
        hits = asked.where(F.nullif(arm, F.lit("")).isNotNull()).join(newest, ["original_template_id", arm]).select(*request, "best")
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy(*request).agg(F.max("best").alias("best")).select(*request, F.col("best.id").alias("adaptation_id"))
    return best


def assemble(df: DataFrame, order: str = "standard") -> DataFrame:
    """Join prompt components in the given order; absent ones are skipped.

    Input rows are (prompt, component, position, text). Several texts of a component
    follow each other by position. A prompt's texts end in one string and are gathered for it.
    """
    return df.groupBy("prompt").agg(F.concat_ws("\n", *[_component(c) for c in ORDERS[order]]).alias("text"))


def _component(name: str) -> Column:
    """The texts of one component by position, NULL if there is none."""
    found = F.array_sort(F.collect_list(F.when((F.col("component") == name) & F.col("text").isNotNull(), F.struct("position", "text"))))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda r: r["text"]), "\n"))


def assemble_all(df: DataFrame) -> DataFrame:
    """The prompt in every declared order, from one pass over the components."""
    names = sorted({c for order in ORDERS.values() for c in order})
    wide = df.groupBy("prompt").agg(*[_component(c).alias(c) for c in names])
    texts = F.create_map(*[x for o, cs in ORDERS.items() for x in (F.lit(o), F.concat_ws("\n", *cs))])
    return wide.select("prompt", F.explode(texts).alias("assembly_order", "text"))


def fill(df: DataFrame, contexts: DataFrame) -> DataFrame:
    """Replace ``{context}`` and ``{controlled_context}`` by the prompt's context texts."""
    rows = salted_join(df, contexts.select("context_id", "context", "controlled_context"), ["context_id"], ["prompt"], "left")
    # One pass: the text is cut behind each placeholder, so inserted texts are not filled again.
    cut = F.split("text", r"(?<=\{context\})|(?<=\{controlled_context\})")
    filled = lambda part, name: F.replace(part, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
    parts = F.transform(cut, lambda p: F.when(p.endswith("{controlled_context}"), filled(p, "controlled_context")).when(p.endswith("{context}"), filled(p, "context")).otherwise(p))
    return rows.select("prompt", "context_id", F.array_join(parts, "").alias("text"))


def chain_steps(df: DataFrame) -> DataFrame:
    """Steps of prompt chains as rows (chain, step, prompt_name, output_key, is_object, inputs)."""
    steps = F.posexplode(P.as_list(P.safe_json(F.col("chain_steps")))).alias("step", "v")
    return df.select(F.col("name").alias("chain"), steps).select(
        "chain", "step",
        P.get_text(F.col("v"), "prompt_name").alias("prompt_name"),
        P.get_text(F.col("v"), "output_key").alias("output_key"),
        P.get_text(F.col("v"), "version_requirement").alias("version_requirement"),
        P.as_map(F.col("v")).isNotNull().alias("is_object"),
        F.transform(
            F.filter(F.map_entries(P.as_map(P.get(F.col("v"), "input_mapping"))), lambda e: P.is_text(e["value"])),
            lambda e: P.as_text(e["value"]),
        ).alias("inputs"),
    )


def missing_outputs(steps: DataFrame) -> DataFrame:
    """Steps that read an output no earlier step of their chain makes.

    The first step that makes each output is an aggregate by (chain, output);
    readers are then joined on the same pair, so no task sees a whole long chain.
    """
    first = steps.where(F.col("output_key").isNotNull()).groupBy("chain", "output_key").agg(F.min("step").alias("made_at"))
    reads = steps.where(F.col("step") > 0).select("chain", "step", F.explode("inputs").alias("source")).where(
        F.col("source").startswith("$outputs.")
    ).select("chain", "step", F.substr("source", F.lit(10)).alias("output_key"))
    joined = reads.join(first, ["chain", "output_key"], "left")
    return joined.where(F.col("made_at").isNull() | (F.col("made_at") >= F.col("step"))).select("chain", "step", "output_key")


def chain_errors(df: DataFrame) -> DataFrame:
    """All faults of prompt chains as rows (chain, step, message)."""
    listed = P.as_list(P.safe_json(F.col("chain_steps")))
    empty = df.where(F.coalesce(F.size(listed) <= 0, F.lit(True))).select(
        F.col("name").alias("chain"), F.lit(None).cast("int").alias("step"), F.lit("chain_steps must be a non-empty list").alias("message")
    )
    steps = chain_steps(df)
    broken = steps.where(~F.col("is_object") | F.col("prompt_name").isNull()).select(
        "chain", "step",
        F.when(F.col("is_object"), "Each chain step must include prompt_name").otherwise("Each chain step must be a dictionary").alias("message"),
    )
    unread = missing_outputs(steps).select(
        "chain", "step", F.concat(F.lit("Input mapping refers to non-existent output key: "), "output_key").alias("message")
    )
    return empty.unionByName(broken).unionByName(unread)


def semver(text: Column) -> Column:
    """Version text as a comparable list of numbers, NULL for anything else; 1.2 equals 1.2.0.

    Numbers have up to 38 digits.
    """
    clean = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)\s*$", 1)
    short = F.regexp_replace(clean, r"(\.0+)+$", "")
    numbers = F.transform(F.split(short, r"\."), lambda p: p.try_cast("decimal(38,0)"))
    return F.when((clean != "") & ~F.exists(numbers, lambda p: p.isNull()), numbers)


def resolve_versions(requests: DataFrame, versions: DataFrame, strategy: str = "minimum", fallback: str = "use_latest") -> DataFrame:
    """Pick a version for each request (request_id, prompt_name, version_requirement ``>=x.y.z``).

    ``minimum`` takes the lowest version that satisfies the requirement, any other
    strategy the highest; without a match ``use_latest`` takes the highest of all.
    """
    have = versions.select("prompt_name", F.col("version").alias("__version"), semver(F.col("version")).alias("__at")).where("__at IS NOT NULL").distinct()
    low = semver(F.regexp_replace("version_requirement", r"^\s*>=", ""))
    asked = requests.select("prompt_name", "version_requirement").distinct().withColumn("__at", low)
    # Versions and requirements of a prompt in one descending order: the version
    # last seen before a requirement is the lowest one that satisfies it.
    line = have.withColumn("version_requirement", F.lit(None).cast("string")).withColumn("__asked", F.lit(0)).unionByName(
        asked.withColumn("__version", F.lit(None).cast("string")).withColumn("__asked", F.lit(1))
    )
    down = Window.partitionBy("prompt_name").orderBy(F.desc_nulls_last("__at"), "__asked").rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("__lowest", F.last("__version", ignorenulls=True).over(down)).where("__asked = 1")
    newest = have.groupBy("prompt_name").agg(F.max(F.struct("__at", "__version")).alias("__latest"))
    latest = F.col("__latest.__version")
    satisfied = met["__at"].isNotNull() & F.col("__lowest").isNotNull()
    fit = F.when(satisfied, F.col("__lowest") if strategy == "minimum" else latest)
    named = met.join(newest, "prompt_name").select(
        "prompt_name", "version_requirement",
        F.coalesce(fit, latest if fallback == "use_latest" else F.lit(None).cast("string")).alias("resolved"),
        fit.isNull().alias("used_fallback"),
    )
    return salted_join(requests, named, ["prompt_name", "version_requirement"], ["request_id"], "left")
