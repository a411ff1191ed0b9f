"""Queries: templates, adaptations, prompt assembly and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentloom.functions import payload as P
from contentloom.operators import templates as M
from contentloom.plans.reading import NOW
from contentloom.plans.registry import derive, query

VIEW = """SELECT id, title AS name, json_extract_string(content, '$.template_text') AS template_text, '{}' AS variables,
  coalesce(json_extract_string(content, '$.model'), 'gpt-4-turbo') AS model, '' AS description, coalesce(CAST(json_extract_string(content, '$.temperature') AS DOUBLE), 0.7) AS temperature,
  coalesce(json_extract_string(metadata, '$.category'), 'general') AS category, '1.0' AS version, coalesce(json_extract_string(metadata, '$.tags[0]'), '') AS tags, created_at, updated_at FROM @templates"""


@query("p01_build_templates", f"""
SELECT id, coalesce(name, 'Untitled Template') AS title, template_text, coalesce(variables, '{{}}') AS variables, coalesce(model, 'gpt-4-turbo') AS model, coalesce(temperature, '0.7') AS temperature,
  coalesce(category, 'general') AS category, '1.0' AS version, coalesce(tags, '["template"]') AS tags, TIMESTAMP '{NOW}' AS created_at FROM @template_rows""")
def build_templates(t):
    out = M.build(t.template_rows, NOW)
    read = lambda c, k: P.json_text(F.col(c), k).alias(k)
    return out.select("id", "title", *[read("content", k) for k in ("template_text", "variables", "model", "temperature")],
                      *[read("metadata", k) for k in ("category", "version", "tags")], "created_at")


@query("p02_template_view", VIEW)
def template_view(t):
    return M.view(t.templates).withColumn("tags", F.array_join("tags", ","))


@query("p02_template_by_name", f"SELECT * EXCLUDE (tags) FROM ({VIEW}) WHERE name = (SELECT min(p_name) FROM part)")
def template_by_name(t):
    name = t.part.agg(F.min("p_name").alias("name")).scalar()
    return M.view(t.templates.where((F.col("content_type") == "prompt_template") & (F.col("title") == name))).drop("tags")


@query("p02_list_templates", f"SELECT * EXCLUDE (tags, version) FROM ({VIEW}) ORDER BY created_at DESC, id LIMIT 30 OFFSET 10")
def list_templates(t):
    return M.list_templates(t.templates, limit=30, offset=10)


@query("t06_default_fill", """
SELECT id, coalesce(json_extract_string(content, '$.model'), 'gpt-4-turbo') AS model, coalesce(json_extract_string(metadata, '$.category'), 'general') AS category,
  p_size % 6 = 0 AS no_tags FROM @templates""")
def default_fill(t):
    return M.view(t.templates).select("id", "model", "category", (F.size("tags") == 0).alias("no_tags"))


PATCHES = """SELECT concat('template-', CAST(ps AS STRING)) AS id, CASE WHEN ps % 2 = 0 THEN concat('patched "', CAST(ps AS STRING), '"') ELSE CAST(NULL AS STRING) END AS template_text,
  CASE WHEN ps % 3 = 0 THEN '0.5' ELSE CAST(NULL AS STRING) END AS temperature, CASE WHEN ps % 5 = 0 THEN 'patched' ELSE CAST(NULL AS STRING) END AS category, 2 AS seq
FROM (SELECT DISTINCT l_suppkey * 3 AS ps FROM @lineitem)"""
# The same templates once more: an older patch and a newer one that gives other fields.
MORE_PATCHES = f"""{PATCHES} UNION ALL SELECT id, 'zz older', '9.9', 'zz older', 1 FROM ({PATCHES}) UNION ALL SELECT id, CAST(NULL AS STRING), '0.1', CAST(NULL AS STRING), 3 FROM ({PATCHES})"""


@query("p03_patch_templates", f"""
SELECT t.id, CASE WHEN p.id IS NULL THEN json_extract_string(t.content, '$.template_text') ELSE coalesce(p.template_text, 'zz older') END AS template_text,
  json_extract_string(t.content, '$.model') AS model, CASE WHEN p.id IS NULL THEN json_extract_string(t.content, '$.temperature') ELSE '0.1' END AS temperature,
  CASE WHEN p.id IS NULL THEN json_extract_string(t.metadata, '$.category') ELSE coalesce(p.category, 'zz older') END AS category,
  CASE WHEN p.id IS NULL THEN t.updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at FROM @templates t LEFT JOIN ({PATCHES}) p ON p.id = t.id""")
def patch_templates(t):
    out = M.update_templates(t.templates, t.sql(MORE_PATCHES), NOW, ["seq"])
    read = lambda c, k: P.json_text(F.col(c), k).alias(k)
    return out.select("id", read("content", "template_text"), read("content", "model"), read("content", "temperature"), read("metadata", "category"), "updated_at")


ADAPTED = f"""SELECT a.id, concat(t.title, ' (Adapted)') AS title, a.template_text, coalesce(a.model, json_extract_string(t.content, '$.model'), 'gpt-4-turbo') AS model,
  coalesce(json_extract_string(t.content, '$.temperature'), '0.7') AS temperature, coalesce(json_extract_string(t.metadata, '$.category'), 'general') AS category,
  a.original_template_id, a.site_id, a.project_id, a.created_at FROM @adaptations a JOIN @templates t ON t.id = a.original_template_id"""


@query("j05_adapt", ADAPTED)
def adapt(t):
    made, _ = M.adapt(t.templates, t.adaptations, NOW)
    read = lambda k: P.json_text(F.col("content"), k).alias(k)
    return made.select("id", "title", read("template_text"), read("model"), read("temperature"), P.json_text(F.col("metadata"), "category").alias("category"),
                       "original_template_id", "site_id", "project_id", "created_at")


@query("j05_missing_originals", """
SELECT id, concat('Original template ', original_template_id, ' not found') AS error FROM @adaptations WHERE original_template_id NOT IN (SELECT id FROM @templates)""")
def missing_originals(t):
    return M.adapt(t.templates, t.adaptations, NOW)[1].select("id", "error")


# Which adaptation of a part's template fits a supplier's site or a project.
WANTED = """SELECT DISTINCT concat('template-', CAST(l_partkey AS STRING)) AS original_template_id, concat('site-', CAST(l_suppkey AS STRING)) AS site_id,
  CASE WHEN l_suppkey % 2 = 0 THEN concat('project-', CAST(l_suppkey % 50 AS STRING)) ELSE CAST(NULL AS STRING) END AS project_id FROM @lineitem"""


@query("j06_find_adaptation", f"""
SELECT original_template_id, site_id, project_id, adaptation_id FROM (
  SELECT w.*, a.id AS adaptation_id, row_number() OVER (PARTITION BY w.original_template_id, w.site_id, w.project_id ORDER BY a.created_at DESC, a.id DESC) AS rn
  FROM ({WANTED}) w JOIN @adaptations a ON a.original_template_id = w.original_template_id AND (a.site_id = w.site_id OR a.project_id = w.project_id)) WHERE rn = 1""")
def find_adaptation(t):
    return M.find_adaptation(t.adaptations, t.sql(WANTED))


@query("w02_first_match", f"""
SELECT site_id, original_template_id, arg_max(id, (created_at, id)) AS adaptation_id FROM @adaptations WHERE site_id IS NOT NULL GROUP BY site_id, original_template_id""")
def first_match(t):
    asked = t.adaptations.where("site_id IS NOT NULL").select("original_template_id", "site_id", F.lit(None).cast("string").alias("project_id"))
    return M.find_adaptation(t.adaptations, asked).select("site_id", "original_template_id", "adaptation_id")


def _assembled(order: str) -> str:
    pick = ", ".join(f"string_agg(text, chr(10) ORDER BY position) FILTER (component = '{c}')" for c in M.ORDERS[order])
    return f"SELECT prompt, '{order}' AS assembly_order, concat_ws(chr(10), {pick}) AS text FROM @prompt_components GROUP BY prompt"


@query("p04_assemble", " UNION ALL ".join(_assembled(o) for o in M.ORDERS))
def assemble(t):
    return M.assemble_all(t.prompt_components)


@query("p04_assemble_agent", f"SELECT prompt, text FROM ({_assembled('agent')})")
def assemble_agent(t):
    return M.assemble(t.prompt_components, "agent")


FILL = """SELECT concat('prompt-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS prompt, concat('order-', CAST(l_orderkey % 5000 AS STRING)) AS context_id,
  'Use {context} and {controlled_context}; again {context}.' AS text FROM @lineitem"""
GIVEN = """SELECT concat('order-', CAST(o_orderkey AS STRING)) AS context_id, o_orderpriority AS context,
  CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE CAST(NULL AS STRING) END AS controlled_context FROM @orders"""


@query("p05_fill_placeholders", f"""
SELECT prompt, f.context_id, replace(replace(text, '{{context}}', coalesce(context, '')), '{{controlled_context}}', coalesce(controlled_context, '')) AS text
FROM ({FILL}) f LEFT JOIN ({GIVEN}) g ON g.context_id = f.context_id""")
def fill_placeholders(t):
    return M.fill(t.sql(FILL), t.sql(GIVEN))


# Faults of the chains by their own CASE; the plain step shifts the later ones by one.
MISSING = """SELECT name AS chain, 1 + p AS step, 'late' AS output_key FROM (SELECT *, CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS p FROM @chains WHERE turn % 6 <> 5) WHERE turn % 3 = 0
UNION ALL SELECT name, 2 + p, 'nowhere' FROM (SELECT *, CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS p FROM @chains WHERE turn % 6 <> 5) WHERE turn % 2 = 0"""


@query("w03_missing_outputs", f"SELECT chain, CAST(step AS INTEGER) AS step, output_key FROM ({MISSING})")
def missing_outputs(t):
    return M.missing_outputs(M.chain_steps(t.chains))


@query("p06_chain_errors", f"""
SELECT chain, CAST(step AS INTEGER) AS step, concat('Input mapping refers to non-existent output key: ', output_key) AS message FROM ({MISSING})
UNION ALL SELECT name, NULL, 'chain_steps must be a non-empty list' FROM @chains WHERE turn % 6 = 5
UNION ALL SELECT name, 1, 'Each chain step must be a dictionary' FROM @chains WHERE turn % 6 <> 5 AND turn % 4 = 3
UNION ALL SELECT name, CASE WHEN turn % 4 = 3 THEN 2 ELSE 1 END, 'Each chain step must include prompt_name' FROM @chains WHERE turn % 6 <> 5 AND turn % 5 = 2""")
def chain_errors(t):
    return M.chain_errors(t.chains)


VERSIONS = """SELECT p_brand AS prompt_name, concat('1.', CAST(p_size AS STRING), '.', CAST(p_partkey % 3 AS STRING)) AS version FROM @part"""
REQUESTS = """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS request_id, p_brand AS prompt_name,
  concat('>=1.', CAST(CAST(l_quantity AS BIGINT) + l_linenumber AS STRING), '.1') AS version_requirement, CAST(l_quantity AS BIGINT) + l_linenumber AS minor
FROM @lineitem JOIN @part ON p_partkey = l_partkey"""


@query("p07_resolve_versions", f"""
WITH v AS (SELECT DISTINCT p_brand AS prompt_name, p_size * 10 + p_partkey % 3 AS code, concat('1.', CAST(p_size AS STRING), '.', CAST(p_partkey % 3 AS STRING)) AS version FROM part),
k AS (SELECT prompt_name, version_requirement, minor * 10 + 1 AS low FROM ({REQUESTS}) GROUP BY ALL),
best AS (SELECT k.prompt_name, k.version_requirement, arg_min(version, code) FILTER (code >= low) AS fit, arg_max(version, code) AS latest FROM k JOIN v ON v.prompt_name = k.prompt_name GROUP BY ALL)
SELECT r.request_id, r.prompt_name, r.version_requirement, coalesce(fit, latest) AS resolved, fit IS NULL AS used_fallback
FROM ({REQUESTS}) r JOIN best b ON b.prompt_name = r.prompt_name AND b.version_requirement = r.version_requirement""")
def resolve_versions(t):
    return M.resolve_versions(t.sql(REQUESTS).drop("minor"), t.sql(VERSIONS))
