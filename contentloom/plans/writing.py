"""Queries: enrichment, inserts, updates, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentloom.functions import payload as P
from contentloom.operators import store, vectors, writes as W
from contentloom.plans.graph import DELETED
from contentloom.plans.reading import NOW
from contentloom.plans.registry import query
from contentloom.session import scratch_path
from contentloom.sources import keyed, tables

AT = f"TIMESTAMP '{NOW}'"


@query("j04_updated_ids", "SELECT id FROM @updates WHERE id IN (SELECT id FROM @contents)")
def updated_ids(t):
    return W.updated_ids(t.contents, t.updates)


@query("w01_latest_context", """
SELECT project_id, params, id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id, params ORDER BY updated_at DESC, id DESC) AS rn FROM @contexts) WHERE rn = 1""")
def latest_context(t):
    return store.latest_context(t.contexts, ("project_id", "params")).select("project_id", "params", "id", "updated_at")


@query("w01_latest_visible_context", """
SELECT params, id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY params ORDER BY updated_at DESC, id DESC) AS rn FROM @contexts WHERE project_id = '7' OR project_id IS NULL) WHERE rn = 1""")
def latest_visible_context(t):
    return store.latest_context(t.contexts, ("params",), "7").select("params", "id", "updated_at")


# Model registrations, several per name.
REGISTRATIONS = """SELECT concat('Model', CAST(l_partkey % 300 * 7 AS STRING)) AS name, concat('beta-', CAST(l_linenumber AS STRING)) AS object_type,
  lpad(CAST(l_orderkey * 10 + l_linenumber AS STRING), 12, '0') AS version, concat('{"from":', CAST(l_orderkey AS STRING), '}') AS definition,
  CASE WHEN l_linenumber = 2 THEN CAST(NULL AS STRING) ELSE concat('registered by ', CAST(l_orderkey AS STRING)) END AS description FROM @lineitem"""
LAST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS rn FROM ({REGISTRATIONS})) WHERE rn = 1"


@query("w04_collapse_batch", f"SELECT name, object_type, version, definition, description FROM ({LAST})")
def collapse_batch(t):
    return W.collapse(t.sql(REGISTRATIONS), ["name"], ["version"]).select("name", "object_type", "version", "definition", "description")


ENRICHED = """SELECT id, CASE WHEN parent_id IS NULL THEN 0 WHEN parent_id = 'customer-none' THEN NULL ELSE 3 END AS level, 'article' AS object_type, parent_id,
  CASE WHEN metadata IS NULL THEN CAST(NULL AS STRING) ELSE 'new' END AS status, CASE WHEN metadata IS NULL THEN {none} ELSE {some} END AS n_references, 0 AS n_referenced_by FROM @batch_children"""


def _enriched(df):
    m = P.safe_json(F.col("metadata"))
    size = lambda k: F.size(P.as_list(P.get(m, k))).alias(f"n_{k}")
    return [P.get_int(m, "hierarchy_level").alias("level"), P.get_text(m, "object_type").alias("object_type"), P.get_text(m, "parent_id").alias("parent_id"),
            P.get_text(m, "status").alias("status"), size("references"), size("referenced_by")]


@query("w05_enrich", ENRICHED.format(none=0, some=1))
def enrich(t):
    out = W.enrich(t.batch_children, t.contents)
    return out.select("id", *_enriched(out))


@query("w06_insert", f"SELECT e.*, lower(replace(b.title, ' ', '-')) AS slug, {AT} AS created_at, {AT} AS updated_at FROM ({ENRICHED.format(none=1, some=2)}) e JOIN @batch_children b ON b.id = e.id")
def insert(t):
    out = W.insert(t.batch_children, t.contents, NOW)
    return out.select("id", *_enriched(out), "slug", "created_at", "updated_at")


@query("w06_generated_ids", """
SELECT sha256(concat('article', chr(31), o_orderpriority, chr(31), '{"n":', CAST(o_orderkey AS STRING), '}')) AS id, lower(replace(o_orderpriority, ' ', '-')) AS slug FROM orders""")
def generated_ids(t):
    batch = t.orders.select(
        F.lit("article").alias("content_type"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("parent_id"),
        F.concat(F.lit('{"n":'), "o_orderkey", F.lit("}")).alias("content"), F.lit(None).cast("string").alias("metadata"))
    return W.insert(batch, t.contents, NOW).select("id", "slug")


# Every update with an older one whose texts sort behind it.
MORE_UPDATES = """SELECT id, content, metadata, 2 AS seq FROM @updates UNION ALL SELECT id, '{"zz":1}', '{"zz":1}', 1 FROM @updates"""


@query("w07_update", f"""
SELECT c.id, title, coalesce(u.content, c.content) AS content, coalesce(u.metadata, c.metadata) AS metadata, CASE WHEN u.id IS NULL THEN c.updated_at ELSE {AT} END AS updated_at
FROM @contents c LEFT JOIN @updates u ON u.id = c.id""")
def update(t):
    return W.update(t.contents, t.sql(MORE_UPDATES), NOW, ["seq"]).select("id", "title", "content", "metadata", "updated_at")


@query("w08_upsert", f"""
SELECT coalesce(m.name, b.name) AS name, coalesce(b.object_type, m.object_type) AS object_type, coalesce(b.version, m.version) AS version, coalesce(b.definition, m.definition) AS definition,
  coalesce(b.description, m.description) AS description, CASE WHEN b.name IS NULL THEN m.updated_at ELSE {AT} END AS updated_at, CASE WHEN m.name IS NULL THEN {AT} ELSE m.created_at END AS created_at
FROM @stored_definitions m FULL JOIN ({LAST}) b ON b.name = m.name""")
def upsert(t):
    out = W.upsert(t.stored_definitions, t.sql(REGISTRATIONS), "name", NOW)
    return out.select("name", "object_type", "version", "definition", "description", "updated_at", "created_at")


@query("w08_upsert_of_parts", f"""
SELECT coalesce(m.name, b.name) AS name, coalesce(b.object_type, m.object_type) AS object_type, coalesce(b.version, m.version) AS version, coalesce(b.definition, m.definition) AS definition,
  coalesce(b.description, m.description) AS description, CASE WHEN b.name IS NULL THEN m.updated_at ELSE {AT} END AS updated_at, CASE WHEN m.name IS NULL THEN {AT} ELSE m.created_at END AS created_at
FROM @stored_definitions m FULL JOIN ({LAST}) b ON b.name = m.name""")
def upsert_of_parts(t):
    table = keyed.create(t.stored_definitions, scratch_path(t.spark, "definitions"), "name", 16)
    for _ in range(2):  # the second run changes nothing
        W.upsert_parts(table, t.sql(REGISTRATIONS), NOW)
    return table.read(t.spark).select("name", "object_type", "version", "definition", "description", "updated_at", "created_at")


@query("w09_duplicate_names", f"SELECT name, count(*) AS n FROM (SELECT name FROM @stored_definitions UNION ALL SELECT name FROM ({REGISTRATIONS})) GROUP BY name HAVING count(*) > 1")
def duplicate_names(t):
    cols = ["name", "object_type", "version", "definition", "description"]
    return W.duplicate_names(W.append_definitions(t.stored_definitions.select(*cols), t.sql(REGISTRATIONS)))


SPARSE = """SELECT CAST(s_suppkey * 3 AS STRING) AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE CAST(NULL AS STRING) END AS description,
  CASE WHEN s_suppkey % 3 = 0 THEN '9.9' ELSE CAST(NULL AS STRING) END AS version FROM @supplier"""
# The same changes in two rows per id, the later one with the first attribute, and an older row behind both.
SPLIT = f"""SELECT id, description, CAST(NULL AS STRING) AS version, 3 AS seq FROM ({SPARSE}) UNION ALL SELECT id, CAST(NULL AS STRING), version, 2 FROM ({SPARSE})
  UNION ALL SELECT id, CASE WHEN description IS NULL THEN CAST(NULL AS STRING) ELSE 'zz' END, CASE WHEN version IS NULL THEN CAST(NULL AS STRING) ELSE 'zz' END, 1 FROM ({SPARSE})"""


@query("w10_sparse_update", f"""
SELECT m.id, coalesce(u.description, m.description) AS description, coalesce(u.version, m.version) AS version,
  CASE WHEN u.description IS NULL AND u.version IS NULL THEN m.updated_at ELSE {AT} END AS updated_at FROM @stored_definitions m LEFT JOIN ({SPARSE}) u ON u.id = m.id""")
def sparse_update(t):
    return W.sparse_update(t.stored_definitions, t.sql(SPLIT), NOW, ["seq"]).select("id", "description", "version", "updated_at")


@query("w10_sparse_update_of_parts", f"""
SELECT m.id, coalesce(u.description, m.description) AS description, coalesce(u.version, m.version) AS version,
  CASE WHEN u.description IS NULL AND u.version IS NULL THEN m.updated_at ELSE {AT} END AS updated_at FROM @stored_definitions m LEFT JOIN ({SPARSE}) u ON u.id = m.id""")
def sparse_update_of_parts(t):
    table = keyed.create(t.stored_definitions, scratch_path(t.spark, "definitions"), "id", 16)
    W.sparse_update_parts(table, t.sql(SPLIT), NOW, ["seq"])
    return table.read(t.spark).select("id", "description", "version", "updated_at")


@query("w11_delete", f"SELECT id, content_type, title FROM @contents WHERE id NOT IN (SELECT id FROM ({DELETED}))")
def delete(t):
    return W.delete(t.contents, t.sql(DELETED)).select("id", "content_type", "title")


@query("w11_deleted_ids", f"SELECT DISTINCT id FROM ({DELETED}) WHERE id IN (SELECT id FROM @contents)")
def deleted_ids(t):
    return W.deleted_ids(t.contents, t.sql(DELETED))


CONTEXT_UPDATES = "SELECT CAST(event_id AS STRING) AS id, concat('{\"new\":', CAST(user_id AS STRING), '}') AS context FROM @events WHERE event_type = 'click'"


@query("w12_update_contexts", f"""
SELECT c.id, CASE WHEN hit THEN u.context ELSE c.context END AS context, CASE WHEN hit THEN {AT} ELSE updated_at END AS updated_at FROM (
  SELECT c.*, u.context AS new_context, coalesce(u.id IS NOT NULL AND (c.project_id = '5' OR c.project_id IS NULL), false) AS hit FROM @contexts c LEFT JOIN ({CONTEXT_UPDATES}) u ON u.id = c.id) c
LEFT JOIN ({CONTEXT_UPDATES}) u ON u.id = c.id""")
def update_contexts(t):
    twice = f"SELECT id, context, 2 AS seq FROM ({CONTEXT_UPDATES}) UNION ALL SELECT id, '{{\"zz\":1}}', 1 FROM ({CONTEXT_UPDATES})"
    return W.update_contexts(t.contexts, t.sql(twice), NOW, ["seq"], "5").select("id", "context", "updated_at")


@query("w12_delete_contexts", f"""
SELECT id, project_id FROM @contexts WHERE NOT (id IN (SELECT id FROM ({CONTEXT_UPDATES})) AND coalesce(project_id = '5', true))""")
def delete_contexts(t):
    return W.delete_contexts(t.contexts, t.sql(CONTEXT_UPDATES), "5").select("id", "project_id")


VECTOR_UPDATES = """SELECT concat('doc-', CAST(doc_id AS STRING)) AS content_id, CASE WHEN quality = 1 THEN '{"quality":1}' ELSE '{}' END AS metadata FROM @labels"""


@query("w13_update_vectors", f"""
SELECT v.content_id, CASE WHEN u.metadata = '{{"quality":1}}' THEN u.metadata ELSE coalesce(v.metadata, '{{}}') END AS metadata, u.content_id IS NOT NULL AS zeroed
FROM @vectors v LEFT JOIN (SELECT content_id, max(metadata) AS metadata FROM ({VECTOR_UPDATES}) GROUP BY content_id) u ON u.content_id = v.content_id""")
def update_vectors(t):
    # The embedding comes in one row, the metadata in an older one, another embedding in the oldest.
    zero, none = F.array(F.lit(0.0).cast("float")), F.lit(None).cast("array<float>")
    given = t.sql(VECTOR_UPDATES)
    changes = given.select("content_id", "metadata", none.alias("embedding"), F.lit(2).alias("seq")).union(
        given.select("content_id", F.lit(None).cast("string"), zero, F.lit(3))).union(
        given.select("content_id", F.lit("{}"), F.array(F.lit(9.0).cast("float"), F.lit(9.0).cast("float")), F.lit(1)))
    current = tables.build_vectors(t.vectors)
    return vectors.update_vectors(current, changes, ["seq"]).select("content_id", "metadata", (F.size("embedding") == 1).alias("zeroed"))


@query("w13_delete_vectors", "SELECT content_id FROM @vectors WHERE content_id NOT IN (SELECT concat('doc-', CAST(doc_id AS STRING)) FROM labels)")
def delete_vectors(t):
    return W.delete(t.vectors, t.sql(VECTOR_UPDATES), key="content_id").select("content_id")
