"""Queries: references, hierarchy and the documented relations between objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentloom.operators import hierarchy as H, level_table, reference_view, references as X
from contentloom.plans.registry import derive, query
from contentloom.session import scratch_path

# The references every order line embeds, by hand.
EMBEDDED = """
SELECT id AS source_id, 0 AS pos, part_id AS id, 'part' AS type FROM @line_contents
UNION ALL SELECT id, 1, supplier_id, 'unknown' FROM @line_contents
UNION ALL SELECT id, 4, order_id, 'parent' FROM @line_contents"""


@query("r01_embedded_references", EMBEDDED)
def embedded_references(t):
    return X.extract_embedded(t.line_contents)


@query("a05_first_reference_wins", f"SELECT type, count(*) AS n, min(pos) AS first_pos FROM ({EMBEDDED}) GROUP BY type")
def first_reference_wins(t):
    return X.extract_embedded(t.line_contents).groupBy("type").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


# The five edges of every order line.
derive("line_edges", """
SELECT id AS source_id, part_id AS target_id, 'reference' AS reference_type FROM @line_contents
UNION ALL SELECT id, supplier_id, 'vendor' FROM @line_contents
UNION ALL SELECT id, order_id, 'parent' FROM @line_contents
UNION ALL SELECT id, part_id, 'related' FROM @line_contents
UNION ALL SELECT id, supplier_id, 'related' FROM @line_contents
""")


@query("r02_metadata_edges", "SELECT * FROM @line_edges")
def metadata_edges(t):
    return X.extract_edges(t.line_contents)


@query("a06_unique_edges", "SELECT DISTINCT source_id, target_id, reference_type FROM @edges")
def unique_edges(t):
    return X.unique_edges(t.edges)


CHANGED = "SELECT concat('order-', CAST(o_orderkey AS STRING)) AS id FROM @orders WHERE o_orderpriority = '1-URGENT'"
NEW_EDGES = "SELECT concat('order-', CAST(o_orderkey AS STRING)) AS source_id, 'region-0' AS target_id, 'moved' AS reference_type FROM @orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"


@query("r03_replace_edges", f"""
SELECT source_id, target_id, reference_type FROM @edges WHERE source_id NOT IN (SELECT id FROM ({CHANGED})) UNION ALL SELECT * FROM ({NEW_EDGES})""")
def replace_edges(t):
    return X.replace_edges(t.edges, t.sql(NEW_EDGES), t.sql(CHANGED))


BACK = """SELECT DISTINCT e.target_id, e.source_id AS id, coalesce(s.object_type, 'unknown') AS type
FROM @edges e JOIN @objects o ON o.id = e.target_id LEFT JOIN @objects s ON s.id = e.source_id"""


@query("j02_back_references", BACK)
def back_references(t):
    return X.back_references(t.edges, t.objects)


@query("r04_referenced_by_lists", f"SELECT target_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM ({BACK}) GROUP BY target_id")
def referenced_by_lists(t):
    parts = X.referenced_by_parts(X.back_references(t.edges, t.objects), part_size=20, edges=t.edges)
    size, low, high = F.size("referenced_by").cast("bigint"), F.array_min("referenced_by")["id"], F.array_max("referenced_by")["id"]
    return parts.groupBy("target_id").agg(F.sum(size).alias("n"), F.min(low).alias("first_id"), F.max(high).alias("last_id"))


# Edges after two batches of changes, and objects after some were deleted and some got another type.
derive("edges_later", f"""
SELECT source_id, target_id, reference_type FROM (SELECT * FROM @edges WHERE source_id NOT IN (SELECT id FROM ({CHANGED})) UNION ALL SELECT * FROM ({NEW_EDGES})) WHERE source_id NOT LIKE 'customer-%'
""")
derive("objects_later", """
SELECT id, CASE WHEN id LIKE 'order-%7' THEN 'archived' ELSE object_type END AS object_type FROM @objects WHERE id NOT LIKE 'nation-1%' AND id NOT LIKE 'order-%3'
""")


@query("r04_kept_by_changes", """SELECT DISTINCT e.target_id, e.source_id AS id, coalesce(s.object_type, 'unknown') AS type
FROM @edges_later e JOIN @objects_later o ON o.id = e.target_id LEFT JOIN @objects_later s ON s.id = e.source_id""")
def kept_by_changes(t):
    view = reference_view.create(t.edges, t.objects, scratch_path(t.spark, "reference-view"), 16)
    reference_view.replace_edges(view, t.sql(CHANGED), t.sql(NEW_EDGES), "urgent")
    customers = t.objects.where("id LIKE 'customer-%'").select("id")
    reference_view.replace_edges(view, customers, t.edges.limit(0), "customers")
    retyped = t.objects.where("id LIKE 'order-%7'").select("id", F.lit("archived").alias("object_type"))
    reference_view.change_objects(view, retyped, t.objects.where("id LIKE 'nation-1%' OR id LIKE 'order-%3'").select("id"), "objects")
    return view.read(t.spark)


@query("r05_dangling_references", "SELECT source_id, target_id, reference_type FROM @edges WHERE target_id NOT IN (SELECT id FROM @objects)")
def dangling_references(t):
    return X.dangling(t.edges, t.objects).select("source_id", "target_id", "reference_type")


DELETED = """SELECT concat('part-', CAST(p_partkey AS STRING)) AS id FROM @part WHERE p_size > 40
UNION ALL SELECT concat('order-', CAST(o_orderkey AS STRING)) FROM @orders WHERE o_orderstatus = 'P'"""


@query("j03_drop_references", f"""
SELECT source_id, target_id, reference_type FROM @edges WHERE source_id NOT IN (SELECT id FROM ({DELETED})) AND target_id NOT IN (SELECT id FROM ({DELETED}))""")
def drop_references(t):
    return X.drop_references(t.edges, t.sql(DELETED))


DEAD = "SELECT id FROM @contents WHERE content_type = 'category' OR id LIKE 'order-1%'"


@query("j03_drop_embedded_references", f"""
SELECT id, len(list_filter(CAST(json_extract_string(metadata, '$.references[*].id') AS VARCHAR[]), lambda r: NOT (r LIKE 'nation-%' AND list_contains(known, r)))) AS n_references,
  len(list_filter(CAST(json_extract_string(metadata, '$.referenced_by[*].id') AS VARCHAR[]), lambda r: r NOT LIKE 'order-1%' OR NOT list_contains(known_orders, r))) AS n_referenced_by, status
FROM @contents, (SELECT list(id) FILTER (id LIKE 'nation-%') AS known, list(id) FILTER (id LIKE 'order-1_' OR id = 'order-1') AS known_orders FROM ({DEAD}))""")
def drop_embedded_references(t):
    from contentloom.functions import payload as P

    out = X.drop_embedded(t.contents, t.sql(DEAD))
    m = P.safe_json(F.col("metadata"))
    size = lambda k: F.size(P.as_list(P.get(m, k))).cast("bigint").alias(f"n_{k}")
    return out.select("id", size("references"), size("referenced_by"), P.get_text(m, "status").alias("status"))


# Children of which some name a parent that does not exist.
derive("batch_children", """
SELECT concat('post-', CAST(o_orderkey AS STRING)) AS id, o_orderpriority AS title, 'article' AS content_type,
       CASE WHEN o_orderkey % 10 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 10 = 1 THEN 'customer-none' ELSE concat('customer-', CAST(o_custkey AS STRING)) END AS parent_id,
       CAST(NULL AS INT) AS hierarchy_level, concat('{"order":{"id":"order-', CAST(o_orderkey AS STRING), '","type":"article"}}') AS content,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE '{"references":[{"id":"region-1"}],"status":"new"}' END AS metadata
FROM @orders
""")


@query("j01_parent_level", """
SELECT id, CASE WHEN parent_id IS NULL THEN 0 WHEN parent_id = 'customer-none' THEN NULL ELSE 3 END AS hierarchy_level,
       CASE WHEN parent_id = 'customer-none' THEN 'parent_not_found' END AS issue FROM @batch_children""")
def parent_level(t):
    return H.with_parent_level(t.batch_children, t.contents).select("id", "hierarchy_level", "issue")


# The hierarchy without stored levels, with lost parents and cycles of three.
derive("tree", """
SELECT id, CASE WHEN id = 'nation-7' THEN 'region-none' ELSE parent_id END AS parent_id FROM @raw_contents
UNION ALL SELECT concat('loop-', CAST(p_partkey AS STRING)),
  concat('loop-', CAST(CASE WHEN p_partkey % 3 = 2 THEN p_partkey - 2 ELSE p_partkey + 1 END AS STRING))
FROM @part WHERE p_partkey < (SELECT max(p_partkey) - max(p_partkey) % 3 FROM @part)
""")


@query("h01_levels", """
WITH RECURSIVE walk AS (
  SELECT id, CAST(0 AS BIGINT) AS level FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT c.id, w.level + 1 FROM tree c JOIN walk w ON c.parent_id = w.id),
lost AS (SELECT id FROM tree WHERE parent_id NOT IN (SELECT id FROM tree)),
below AS (SELECT id FROM lost UNION ALL SELECT c.id FROM tree c JOIN below b ON c.parent_id = b.id)
SELECT t.id, w.level, CASE WHEN t.id IN (SELECT id FROM lost) THEN 'parent_not_found' WHEN t.id IN (SELECT id FROM below) THEN 'ancestor_not_found' WHEN w.level IS NULL THEN 'cycle' END AS issue
FROM @tree t LEFT JOIN walk w ON w.id = t.id""")
def levels(t):
    return H.levels(t.tree)


# The tree after moves: nations change their region, one hangs below its own customer, loops open, customers go.
derive("tree_later", """
SELECT id, CASE WHEN id LIKE 'nation-1_' THEN 'region-0' WHEN id = 'nation-7' THEN 'region-1' WHEN id = 'nation-3' THEN (SELECT min(id) FROM @raw_contents WHERE parent_id = 'nation-3')
  WHEN id LIKE 'loop-%5' THEN CAST(NULL AS STRING) ELSE parent_id END AS parent_id FROM @tree WHERE id NOT LIKE 'customer-%9'
""")


@query("h01_kept_levels", """
WITH RECURSIVE walk AS (
  SELECT id, CAST(0 AS BIGINT) AS level FROM tree_later WHERE parent_id IS NULL
  UNION ALL SELECT c.id, w.level + 1 FROM tree_later c JOIN walk w ON c.parent_id = w.id),
lost AS (SELECT id FROM tree_later WHERE parent_id NOT IN (SELECT id FROM tree_later)),
below AS (SELECT id FROM lost UNION ALL SELECT c.id FROM tree_later c JOIN below b ON c.parent_id = b.id)
SELECT t.id, w.level, CASE WHEN t.id IN (SELECT id FROM lost) THEN 'parent_not_found' WHEN t.id IN (SELECT id FROM below) THEN 'ancestor_not_found' WHEN w.level IS NULL THEN 'cycle' END AS issue
FROM @tree_later t LEFT JOIN walk w ON w.id = t.id""")
def kept_levels(t):
    table = level_table.create(t.tree, scratch_path(t.spark, "level-table"), 16)
    moved = t.tree_later.where("id LIKE 'nation-1_' OR id IN ('nation-3', 'nation-7') OR id LIKE 'loop-%5'")
    level_table.change(table, moved, t.tree.where("id LIKE 'customer-%9'").select("id"))
    return table.read(t.spark).select("id", "level", "issue")


derive("listed", """
SELECT id AS container_id, 'topics' AS kind, concat('set-', substr(id, 7), '-1') AS id, 'one' AS name, 'one' AS slug, CAST(NULL AS STRING) AS parent_id, 1 AS depth, 0 AS pos FROM @hierarchies
UNION ALL SELECT id, 'subtopics', concat('set-', substr(id, 7), '-2'), 'two', 'two', concat('set-', substr(id, 7), '-1'), 2, 0 FROM @hierarchies
UNION ALL SELECT id, 'subtopics', concat('set-', substr(id, 7), '-3'), 'three', CAST(NULL AS STRING), concat('set-', substr(id, 7), '-1'), 2, 1 FROM @hierarchies
""")


@query("h02_explode_hierarchy", """
SELECT * FROM @listed UNION ALL
SELECT concat('order-', CAST(o_orderkey AS STRING)), 'categories', concat('cat-', CAST(o_orderkey AS STRING)), o_orderpriority, 'p', CAST(NULL AS STRING), 1, 0 FROM orders""")
def explode_hierarchy(t):
    return H.explode_hierarchy(t.hierarchies)


@query("j10_organizer_items", """
SELECT organizer_id, i.item_id, i.item_type, i.position, i.status, c.title AS item_title FROM (
  SELECT id AS organizer_id, json_extract_string(belongs_to, '$.article') AS item_id, 'article' AS item_type, 2 AS position, 'published' AS status FROM @organizers
  UNION ALL SELECT id, json_extract_string(content_items, '$[1].id'), 'collection', 1, 'active' FROM @organizers) i LEFT JOIN @contents c ON c.id = i.item_id""")
def organizer_items(t):
    return H.organizer_items(t.organizers, t.contents)


# Qualifier tables: return flags as categories, suppliers as authors.
QUALIFIERS = """SELECT 'categories' AS kind, l_returnflag AS id, concat('Flag ', l_returnflag) AS name FROM @lineitem GROUP BY l_returnflag
UNION ALL SELECT 'authors', concat('supplier-', CAST(s_suppkey AS STRING)), s_name FROM @supplier"""


@query("j11_qualifiers", f"""
SELECT object_id, q.kind, q.qualifier_id, n.name AS qualifier_name FROM (
  SELECT id AS object_id, 'authors' AS kind, json_extract_string(qualifiers, '$.authors[0]') AS qualifier_id FROM @organizers
  UNION ALL SELECT id, 'categories', json_extract_string(qualifiers, '$.categories[0]') FROM @organizers
  UNION ALL SELECT id, 'categories', json_extract_string(qualifiers, '$.categories[1]') FROM @organizers) q
LEFT JOIN ({QUALIFIERS}) n ON n.kind = q.kind AND n.id = q.qualifier_id""")
def qualifiers(t):
    return H.qualifiers(t.organizers, t.sql(QUALIFIERS))


@query("j12_containers", """
SELECT child_id, b.kind, b.container_id, c.title AS container_title FROM (
  SELECT id AS child_id, 'article' AS kind, json_extract_string(belongs_to, '$.article') AS container_id FROM @organizers
  UNION ALL SELECT id, 'website', json_extract_string(belongs_to, '$.website') FROM @organizers) b LEFT JOIN @contents c ON c.id = b.container_id""")
def containers(t):
    return H.with_containers(H.belongs_to(t.organizers), t.contents)


@query("j12_one_sided_links", """
SELECT coalesce(b.container_id, l.container_id) AS container_id, coalesce(b.child_id, l.id) AS child_id,
  CASE WHEN l.id IS NULL THEN 'not_listed' WHEN b.child_id IS NULL THEN 'not_claimed' ELSE 'both' END AS link
FROM (SELECT DISTINCT id AS child_id, json_extract_string(belongs_to, '$.article') AS container_id FROM @organizers) b
FULL JOIN @listed l ON l.container_id = b.container_id AND l.id = b.child_id""")
def one_sided_links(t):
    claimed = H.belongs_to(t.organizers).where("kind = 'article'")
    listed = H.explode_hierarchy(t.hierarchies).where("kind != 'categories'")
    return H.container_links(claimed, listed)


@query("j13_components", """
SELECT object_id, kind, pos, e.component_id, p.p_name AS component_title, p.p_name IS NULL AS dangling FROM (
  SELECT id AS object_id, 'key_takeaways' AS kind, 0 AS pos, json_extract_string(extracted_components, '$.key_takeaways[0]') AS component_id FROM @organizers
  UNION ALL SELECT id, 'key_takeaways', 1, 'part-none' FROM @organizers
  UNION ALL SELECT id, 'tables', 0, json_extract_string(extracted_components, '$.tables[0]') FROM @organizers) e
LEFT JOIN part p ON concat('part-', CAST(p.p_partkey AS STRING)) = e.component_id""")
def components(t):
    parts = t.part.select(F.concat(F.lit("part-"), "p_partkey").alias("id"), F.col("p_name").alias("title"))
    return H.components(t.organizers, parts)


KINDS = """SELECT doc_id, CASE lang WHEN 'en' THEN 'Blog Post' WHEN 'de' THEN 'Website' WHEN 'fr' THEN 'Code Snippet' ELSE 'Postcard' END AS object_kind FROM @documents"""


@query("j14_taxonomy", f"""
SELECT doc_id, object_kind, CASE object_kind WHEN 'Blog Post' THEN 'beta' WHEN 'Website' THEN 'alpha' WHEN 'Code Snippet' THEN 'gamma' END AS taxonomy_level, object_kind <> 'Postcard' AS known_kind FROM ({KINDS})""")
def taxonomy(t):
    return H.with_taxonomy(t.sql(KINDS), "object_kind")


@query("j14_known_types", "SELECT name, object_type, object_type IS NOT NULL AND object_type <> 'delta' AS known_type FROM @stored_definitions")
def known_types(t):
    return H.known_model_type(t.stored_definitions.select("name", "object_type"))
