"""Queries: scans, selections, search, paging and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentloom.functions import payload as P, rules as R
from contentloom.functions.model import model
from contentloom.functions.text import slug
from contentloom.operators import catalog, pages, search_index, store, vectors
from contentloom.plans.registry import derive, query
from contentloom.session import scratch_path
from contentloom.sources import definitions, keyed, partitioned, tables

NOW = "2024-06-01 00:00:00"
EIGHT = "id, content_type, title, slug, content, metadata, created_at, updated_at"
PAGE = "ORDER BY created_at DESC, id LIMIT 100 OFFSET 50"


@query("s01_content_scan", f"SELECT {EIGHT} FROM @contents")
def content_scan(t):
    return store.project_columns(t.contents)


@query("s02_conform_contents", """
SELECT id, content_type, title, 'gen' || '' || '' AS marker, '{}' AS content, metadata,
       json_extract_string(metadata, '$.parent_id') AS parent_id, CAST(json_extract_string(metadata, '$.hierarchy_level') AS INTEGER) AS hierarchy_level,
       json_extract_string(metadata, '$.status') AS status, created_at, TIMESTAMP '2024-06-01 00:00:00' AS updated_at
FROM @contents WHERE id IS NOT NULL""".replace("'gen' || '' || '' AS marker, ", ""))
def conform_contents(t):
    raw = t.contents.select("id", "content_type", "title", F.lit(None).cast("string").alias("content"), "metadata", "created_at")
    done = tables.complete(tables.conform_contents(raw, NOW))
    return done.select("id", "content_type", "title", "content", "metadata", "parent_id", "hierarchy_level", "status", "created_at", "updated_at")


@query("s02_null_violations", """
SELECT id, CASE WHEN title IS NULL THEN 'title,slug' ELSE '' END AS null_columns FROM (
  SELECT id, CASE WHEN status = 'archived' THEN NULL ELSE title END AS title FROM @contents) WHERE title IS NULL""")
def null_violations(t):
    raw = t.contents.withColumn("title", F.when(F.col("status") != "archived", F.col("title"))).drop("slug")
    bad = tables.null_violations(tables.conform_contents(raw, NOW))
    return bad.select("id", F.array_join("null_columns", ",").alias("null_columns"))


@query("s03_project_isolation", f"SELECT project_id, {EIGHT} FROM @contents WHERE project_id = 'project-3'")
def project_isolation(t):
    return tables.for_project(t.contents, "project-3").select("project_id", *store.COLUMNS)


# The content table on disk, by project and type, after changes: some orders go to another project, some are new.
derive("content_changes", """
SELECT concat('new-', id) AS id, content_type, title, slug, content, metadata, parent_id, hierarchy_level, object_type, status, tags, 'project-3' AS project_id, created_at, updated_at FROM @contents WHERE id LIKE 'nation-%'
UNION ALL SELECT id, content_type, concat(title, ' moved'), slug, content, metadata, parent_id, hierarchy_level, object_type, status, tags, 'project-9', created_at, updated_at + INTERVAL '1' DAY FROM @contents WHERE id LIKE 'order-1_' OR id = 'region-2'
""")
derive("contents_later", "SELECT * FROM @contents WHERE id NOT IN (SELECT id FROM @content_changes) UNION ALL SELECT * FROM @content_changes")


def written_contents(t):
    """The content table, written by project and type and then changed in the partitions that the changes touch."""
    path, by = scratch_path(t.spark, "contents"), ["project_id", "content_type"]
    rows = tables.complete(t.contents)
    partitioned.write(rows, path, by)
    partitioned.merge(t.content_changes.select(*rows.columns), path, rows.schema, by, "id", ["updated_at"])
    return partitioned.read(t.spark, path, rows.schema)


@query("s02_written_and_merged", f"SELECT project_id, {EIGHT} FROM @contents_later")
def written_and_merged(t):
    return written_contents(t).select("project_id", *store.COLUMNS)


@query("s03_project_partition", f"SELECT project_id, {EIGHT} FROM @contents_later WHERE project_id = 'project-9'")
def project_partition(t):
    return tables.for_project(written_contents(t), "project-9").select("project_id", *store.COLUMNS)


PROJECT_ROWS = """SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, c_mktsegment AS description,
  CASE WHEN c_nationkey % 2 = 0 THEN CAST(NULL AS STRING) ELSE concat('{"nation":', CAST(c_nationkey AS STRING), '}') END AS metadata FROM @customer"""


@query("s04_projects_create", f"""
SELECT id, name, description, coalesce(metadata, '{{}}') AS metadata, TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at FROM ({PROJECT_ROWS})""")
def projects_create(t):
    return tables.build_projects(t.sql(PROJECT_ROWS), NOW)


@query("s04_project_by_name", f"SELECT id, name, coalesce(metadata, '{{}}') AS metadata FROM ({PROJECT_ROWS}) WHERE name = 'Customer#000000007'")
def project_by_name(t):
    return tables.projects_by(tables.build_projects(t.sql(PROJECT_ROWS), NOW), name="Customer#000000007").select("id", "name", "metadata")


@query("s04_project_by_id", f"SELECT id, name, coalesce(metadata, '{{}}') AS metadata FROM ({PROJECT_ROWS}) WHERE id = '11'")
def project_by_id(t):
    return tables.projects_by(tables.build_projects(t.sql(PROJECT_ROWS), NOW), id="11").select("id", "name", "metadata")


@query("s05_contexts_create", f"""
SELECT id, type, concat('{{"a":', id, ',"b":[1,2]}}') AS params, context, project_id, TIMESTAMP '{NOW}' AS created_at FROM @contexts""")
def contexts_create(t):
    even = F.col("id").cast("bigint") % 2 == 0
    mixed = F.when(even, F.concat(F.lit('{"b": [1, 2], "a": '), "id", F.lit("}"))).otherwise(F.concat(F.lit('{"a":'), "id", F.lit(', "b":[1,2] }')))
    return tables.build_contexts(t.contexts.withColumn("params", mixed), NOW).drop("updated_at")


@query("s06_parse_definitions", """
SELECT path, name, CASE WHEN bad THEN NULL ELSE coalesce(json_extract_string(d, '$.description'), name || ' model definition') END AS description,
       CASE WHEN bad THEN 'invalid JSON' WHEN name IS NULL THEN 'name is required' END AS error
FROM (SELECT *, json_extract_string(d, '$.name') AS name FROM (
  SELECT id AS path, NOT json_valid(definition) AS bad, CASE WHEN json_valid(definition) THEN definition ELSE '{}' END AS d FROM @stored_definitions))""")
def parse_definitions(t):
    files = t.stored_definitions.select(F.col("id").alias("path"), F.col("definition").alias("value"))
    return definitions.parse_definitions(files, NOW).select("path", "name", "description", "error")


@query("s08_read_legacy", """
SELECT name, definition, 'blog' AS source_schema FROM @json_schemas WHERE source_schema = 'blog'
UNION ALL SELECT name, definition, 'shop' FROM @json_schemas WHERE source_schema = 'shop'""")
def read_legacy(t):
    js = t.json_schemas
    part = lambda s: js.where(F.col("source_schema") == s).drop("source_schema")
    return catalog.read_legacy([("blog", part("blog")), ("pg_catalog", part("blog")), ("shop", part("shop")), ("raw", t.part)])


@query("s09_collections_written", """
SELECT content_id, content_type, CASE WHEN content_id LIKE '%7' THEN '{"late":true}' ELSE coalesce(metadata, '{}') END AS metadata,
  CASE WHEN content_id LIKE '%7' THEN 'updated' ELSE concat('set-', content_type) END AS collection, CAST(len(embedding) AS BIGINT) AS dims FROM @vectors
WHERE content_id LIKE '%7' OR content_type IN ('label-1', 'label-2')""")
def collections_written(t):
    path, by = scratch_path(t.spark, "vectors"), ["collection"]
    rows = tables.build_vectors(t.vectors).withColumn("collection", F.concat(F.lit("set-"), "content_type"))
    partitioned.write(rows, path, by)
    late = rows.where("content_id LIKE '%7'").withColumns({"collection": F.lit("updated"), "metadata": F.lit('{"late":true}')})
    partitioned.merge(late, path, rows.schema, by, "content_id", ["collection"])
    found = partitioned.read(t.spark, path, rows.schema).where(F.col("collection").isin("updated", "set-label-1", "set-label-2"))
    return found.select("content_id", "content_type", "metadata", "collection", F.size("embedding").cast("bigint").alias("dims"))


@query("s09_vector_rows", """
SELECT content_id, content_type, coalesce(metadata, '{}') AS metadata, 'articles' AS collection, CAST(len(embedding) AS BIGINT) AS dims FROM @vectors""")
def vector_rows(t):
    return tables.build_vectors(t.vectors, "articles").select(
        "content_id", "content_type", "metadata", "collection", F.size("embedding").cast("bigint").alias("dims"))


@query("f01_by_ids", f"SELECT {EIGHT} FROM @contents WHERE id IN (SELECT concat('order-', CAST(l_orderkey AS STRING)) FROM lineitem WHERE l_returnflag = 'R')")
def by_ids(t):
    ids = t.lineitem.where("l_returnflag = 'R'").select(F.concat(F.lit("order-"), "l_orderkey").alias("id"))
    return store.project_columns(store.by_ids(t.contents, ids))


def keyed_contents(t):
    """The contents cut by id."""
    return keyed.create(t.contents.select("id", "content_type", "title"), scratch_path(t.spark, "contents"), "id", 16)


@query("f01_by_ids_of_parts", "SELECT id, content_type, title FROM @contents WHERE id IN (SELECT concat('order-', CAST(l_orderkey AS STRING)) FROM lineitem WHERE l_suppkey = 3)")
def by_ids_of_parts(t):
    ids = t.lineitem.where("l_suppkey = 3").select(F.concat(F.lit("order-"), "l_orderkey").alias("id"))
    return keyed_contents(t).of(ids)


@query("f02_by_type", f"SELECT {EIGHT} FROM @contents WHERE content_type = 'article' {PAGE}")
def by_type(t):
    return store.project_columns(store.page(store.by_type(t.contents, "article"), 100, 50))


@query("f03_by_parent", f"SELECT {EIGHT} FROM @contents WHERE parent_id = 'nation-3'")
def by_parent(t):
    return store.project_columns(store.by_parent(t.contents, "nation-3"))


@query("f03_by_parent_json", f"SELECT {EIGHT} FROM @contents WHERE json_extract_string(metadata, '$.parent_id') = 'nation-5'")
def by_parent_json(t):
    return store.project_columns(store.by_parent_json(t.contents, "nation-5"))


@query("f04_by_level", f"SELECT {EIGHT} FROM @contents WHERE hierarchy_level = 2")
def by_level(t):
    return store.project_columns(store.by_level(t.contents, 2))


@query("f04_by_level_json", f"SELECT {EIGHT} FROM @contents WHERE CAST(json_extract_string(metadata, '$.hierarchy_level') AS INTEGER) = 1")
def by_level_json(t):
    return store.project_columns(store.by_level_json(t.contents, 1))


@query("f05_referencing_json", f"SELECT {EIGHT} FROM @contents WHERE json_contains(json_extract(metadata, '$.references'), '{{\"id\":\"nation-4\"}}')")
def referencing_json(t):
    return store.project_columns(store.referencing_json(t.contents, "nation-4"))


@query("f05_referencing", """
SELECT id, content_type, title FROM @contents WHERE id IN (SELECT source_id FROM @edges WHERE target_id IN (
  SELECT concat('part-', CAST(p_partkey AS STRING)) FROM part WHERE p_size = 7))""")
def referencing(t):
    ids = t.part.where("p_size = 7").select(F.concat(F.lit("part-"), "p_partkey").alias("id"))
    return store.referencing(t.contents, t.edges, ids).select("id", "content_type", "title")


@query("f05_referencing_of_parts", """
SELECT id, content_type, title FROM @contents WHERE id IN (SELECT source_id FROM @edges WHERE target_id IN (
  SELECT concat('part-', CAST(p_partkey AS STRING)) FROM part WHERE p_size = 7))""")
def referencing_of_parts(t):
    ids = t.part.where("p_size = 7").select(F.concat(F.lit("part-"), "p_partkey").alias("target_id"))
    edges = keyed.create(t.edges, scratch_path(t.spark, "edges"), "target_id", 16)
    return keyed_contents(t).of(edges.of(ids).select(F.col("source_id").alias("id")))


@query("f06_referenced_by_json", f"SELECT {EIGHT} FROM @contents WHERE json_contains(json_extract(metadata, '$.referenced_by'), '{{\"id\":\"order-9\"}}')")
def referenced_by_json(t):
    return store.project_columns(store.referenced_by_json(t.contents, "order-9"))


@query("f06_referenced_by", """
SELECT id, content_type, title FROM @contents WHERE id IN (SELECT target_id FROM @edges WHERE source_id IN (
  SELECT concat('order-', CAST(o_orderkey AS STRING)) FROM orders WHERE o_orderstatus = 'P'))""")
def referenced_by(t):
    ids = t.orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("order-"), "o_orderkey").alias("id"))
    return store.referenced_by(t.contents, t.edges, ids).select("id", "content_type", "title")


@query("f06_referenced_by_of_parts", """
SELECT id, content_type, title FROM @contents WHERE id IN (SELECT target_id FROM @edges WHERE source_id IN (
  SELECT concat('order-', CAST(o_orderkey AS STRING)) FROM orders WHERE o_orderstatus = 'P'))""")
def referenced_by_of_parts(t):
    ids = t.orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("order-"), "o_orderkey").alias("source_id"))
    edges = keyed.create(t.edges, scratch_path(t.spark, "edges"), "source_id", 16)
    return keyed_contents(t).of(edges.of(ids).select(F.col("target_id").alias("id")))


@query("f07_search", """
SELECT id, content_type, title FROM @doc_contents WHERE title ILIKE '%da_a%' OR content ILIKE '%da_a%' OR metadata ILIKE '%da_a%'""")
def search(t):
    return store.search(t.doc_contents, "da_a").select("id", "content_type", "title")


def indexed_search(t, pattern):
    path = scratch_path(t.spark, "search-index")
    search_index.build(t.doc_contents, path)
    return search_index.search(t.spark, path, pattern).select("id", "content_type", "title")


SEARCHED = "SELECT id, content_type, title FROM @doc_contents WHERE title ILIKE '%{0}%' OR content ILIKE '%{0}%' OR metadata ILIKE '%{0}%'"


@query("f07_index_search", SEARCHED.format("ÉTION de"))
def index_search(t):
    return indexed_search(t, "ÉTION de")


@query("f07_index_wildcards", SEARCHED.format("WHER%ing t_e"))
def index_wildcards(t):
    return indexed_search(t, "WHER%ing t_e")


@query("f07_index_short_pattern", SEARCHED.format("da_a"))
def index_short_pattern(t):
    return indexed_search(t, "da_a")


@query("f08_active", f"SELECT {EIGHT} FROM @contents WHERE status = 'active'")
def active(t):
    return store.project_columns(store.active(t.contents))


@query("f09_title_any_case", "SELECT id, title FROM @contents WHERE lower(title) = 'customer#000000012'")
def title_any_case(t):
    return store.title_ci(t.contents, "CUSTOMER#000000012").select("id", "title")


@query("f09_title_prefix", "SELECT id, title FROM @contents WHERE starts_with(lower(title), 'order 12')")
def title_prefix(t):
    return store.title_ci(t.contents, "ORDER 12", prefix=True).select("id", "title")


@query("f10_with_tag", "SELECT id, title FROM @contents WHERE list_contains(tags, '1-urgent')")
def with_tag(t):
    return store.with_tag(t.contents, "1-urgent").select("id", "title")


@query("f10_with_custom_field", "SELECT id, title FROM @contents WHERE json_extract_string(metadata, '$.custom_fields.tier') = 't2'")
def with_custom(t):
    return store.with_custom(t.contents, "tier", "t2").select("id", "title")


@query("f11_visible_contexts", """
SELECT id, type, context, project_id FROM @contexts
WHERE id IN (SELECT CAST(event_id AS STRING) FROM events WHERE event_type = 'click') AND (project_id = '42' OR project_id IS NULL)""")
def visible_contexts(t):
    ids = t.events.where("event_type = 'click'").select(F.col("event_id").cast("string").alias("id"))
    return store.visible_contexts(t.contexts, ids, "42").select("id", "type", "context", "project_id")


@query("f11_visible_without_project", "SELECT id, type, context, project_id FROM @contexts WHERE project_id IS NULL")
def visible_without_project(t):
    return store.visible_contexts(t.contexts).select("id", "type", "context", "project_id")


@query("f12_contexts_by", "SELECT id, type, params, project_id, updated_at FROM @contexts WHERE type = 'purchase' AND project_id = '17'")
def contexts_by(t):
    return store.contexts_by(t.contexts, project="17", type="purchase").select("id", "type", "params", "project_id", "updated_at")


@query("f13_model_by_name", "SELECT id, name, definition FROM @stored_definitions WHERE name = 'Model17'")
def model_by_name(t):
    return catalog.by_name(t.stored_definitions, name="Model17").select("id", "name", "definition")


@query("f13_definitions_by_prefix", "SELECT id, name FROM @stored_definitions WHERE name LIKE 'Model1%'")
def definitions_by_prefix(t):
    return catalog.by_name(t.stored_definitions, prefix="Model1").select("id", "name")


@query("f14_templates_by_category", """
SELECT id, title FROM @templates WHERE json_extract_string(metadata, '$.category') = 'Brand#13' ORDER BY created_at DESC, id LIMIT 20 OFFSET 5""")
def templates_by_category(t):
    return store.templates_in(t.templates, "Brand#13", 20, 5).select("id", "title")


POST = model("BlogPost", (R.length_between("title", 5, 200),), title="str", body="str", status="str", belongs_to="Dict[str, Any]", score="int?")


@query("f15_children_valid", """
SELECT id, created_at FROM (SELECT * FROM @posts WHERE json_extract_string(content, '$.belongs_to.id') = 'nation-8' ORDER BY created_at DESC, id LIMIT 25 OFFSET 10)
WHERE length(json_extract_string(content, '$.title')) BETWEEN 5 AND 200""")
def children_valid(t):
    return store.children_valid(t.posts, "nation-8", POST, 25, 10).select("id", "created_at")


@query("f16_vector_filters", "SELECT content_id, content_type FROM @vectors WHERE content_type = 'label-3' AND json_extract_string(metadata, '$.label') = '3'")
def vector_filters(t):
    return vectors.filtered(t.vectors, "label-3", {"label": "3"}).select("content_id", "content_type")


@query("l01_newest_first", "SELECT id, created_at FROM @contents")
def newest_first(t):
    return store.newest(t.contents).select("id", "created_at")


@query("l02_deep_page", "SELECT id, created_at FROM @contents ORDER BY created_at DESC, id LIMIT 500 OFFSET 9000")
def deep_page(t):
    path = scratch_path(t.spark, "pages")
    pages.build(t.contents.select("id", "created_at"), path, 2000)
    return pages.page(t.spark, path, 500, 9000)


@query("l02_page_after", """
SELECT id, created_at FROM @contents WHERE created_at < TIMESTAMP '1995-06-01 00:00:00' OR (created_at = TIMESTAMP '1995-06-01 00:00:00' AND id > 'order-5')
ORDER BY created_at DESC, id LIMIT 100""")
def page_after(t):
    return store.page(t.contents, 100, after=("1995-06-01 00:00:00", "order-5")).select("id", "created_at")


@query("l02_page_offset", f"SELECT {EIGHT} FROM @contents ORDER BY created_at DESC, id LIMIT 40 OFFSET 1000")
def page_offset(t):
    return store.project_columns(store.page(t.contents, 40, 1000))


@query("l05_definitions_by_name", "SELECT id, name, description, object_type, version FROM @stored_definitions")
def definitions_by_name(t):
    return catalog.list_definitions(t.stored_definitions)


@query("t01_slug", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), ' ', '-'), '[^\p{L}\p{N}-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM documents""")
def slugs(t):
    return t.documents.select("doc_id", slug(F.col("text")).alias("slug"))


@query("t02_canonical_json", """
SELECT event_id, concat('{"a":[1,{"x":null,"y":"', event_type, '"}],"b":', CAST(event_id AS STRING), '}') AS canonical FROM events""")
def canonical(t):
    loose = F.concat(F.lit(' { "b" : '), F.col("event_id").cast("string"), F.lit(', "a": [1, {"y":"'), "event_type", F.lit('", "x" : null}] }'))
    return t.events.select("event_id", P.canonical_json(loose).alias("canonical"))


@query("t03_json_extract", """
SELECT event_id, json_extract_string(props, '$.k') AS as_text, CAST(json_extract_string(props, '$.k') AS INTEGER) AS as_int FROM events""")
def json_extract(t):
    return t.events.select("event_id", P.json_text(F.col("props"), "k").alias("as_text"), P.json_int(F.col("props"), "k").alias("as_int"))


@query("t04_contains_ref", """
SELECT id, json_contains(json_extract(content, '$.others'), concat('{"id":"', supplier_id, '"}')) AS has_supplier,
       json_contains(json_extract(content, '$.others'), concat('{"id":"', order_id, '"}')) AS has_order FROM @line_contents""")
def contains_ref(t):
    others = P.get(P.safe_json(F.col("content")), "others")
    return t.line_contents.select("id", P.contains_ref(others, F.col("supplier_id")).alias("has_supplier"), P.contains_ref(others, F.col("order_id")).alias("has_order"))


@query("t05_safe_json", "SELECT event_id, json_valid(payload) AS parsed FROM @payloads")
def safe_json(t):
    return t.payloads.select("event_id", P.safe_json(F.col("payload")).isNotNull().alias("parsed"))


@query("t08_times_as_text", "SELECT id, name, '2024-01-01 00:00:00' AS created_at, '2024-01-02 00:00:00' AS updated_at FROM @stored_definitions")
def times_as_text(t):
    return catalog.list_definitions(t.stored_definitions, timestamps=True).select("id", "name", "created_at", "updated_at")
