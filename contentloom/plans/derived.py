"""Tables of the content data model, derived from the given tables.

Every derived table reads whole given tables. Faults that the data lacks, such as
missing keys, wrong types and links to nothing, are put in by rules on the row's
own numbers, so both engines derive the same rows.
"""

from pyspark.sql import DataFrame, functions as F

from contentloom.operators.catalog import field_catalog
from contentloom.plans.registry import Tables, derive


def physical_columns(t: Tables) -> DataFrame:
    """Columns of the tables that the sound definitions name, with faults."""
    tables = t.sound_definitions.groupBy(F.col("table_name").alias("table")).agg(F.min("p_partkey").alias("k")).where("k % 10 <> 1")
    every = F.expr("""inline(array(
        named_struct('column', 'id', 'data_type', 'string', 'pos', 1),
        named_struct('column', 'title', 'data_type', 'string', 'pos', 2),
        named_struct('column', 'price', 'data_type', CASE WHEN k % 8 = 1 THEN 'string' ELSE 'double' END, 'pos', 3),
        named_struct('column', 'size', 'data_type', CASE WHEN k % 3 = 0 THEN 'int' ELSE 'bigint' END, 'pos', 4),
        named_struct('column', 'created', 'data_type', 'timestamp', 'pos', 5)))""")
    return tables.select("table", "k", every).where("NOT (column = 'title' AND k % 6 = 2)").drop("k")


# A four-level hierarchy with payloads, references and tags.
derive("raw_contents", """
SELECT concat('region-', CAST(r_regionkey AS STRING)) AS id, 'website' AS content_type, r_name AS title,
       CAST(NULL AS STRING) AS parent_id, CAST('2024-01-01 00:00:00' AS $TS) AS created_at, 0 AS lvl,
       'active' AS status, 'root' AS tag, CAST(r_regionkey AS BIGINT) AS num, concat('nation-', CAST(r_regionkey AS STRING)) AS ref
FROM @region
UNION ALL SELECT concat('nation-', CAST(n_nationkey AS STRING)), 'category', n_name,
       concat('region-', CAST(n_regionkey AS STRING)), CAST('2024-01-02 00:00:00' AS $TS), 1,
       'active', 'place', CAST(n_nationkey AS BIGINT), concat('region-', CAST(n_nationkey % 7 AS STRING))
FROM @nation
UNION ALL SELECT concat('customer-', CAST(c_custkey AS STRING)), 'collection', c_name,
       concat('nation-', CAST(c_nationkey AS STRING)), CAST('2024-01-03 00:00:00' AS $TS), 2,
       CASE WHEN c_acctbal < 0 THEN 'archived' ELSE 'active' END, lower(c_mktsegment), c_custkey,
       concat('nation-', CAST(c_custkey % 29 AS STRING))
FROM @customer
UNION ALL SELECT concat('order-', CAST(o_orderkey AS STRING)), 'article',
       concat('Order ', CAST(o_orderkey AS STRING), ' ', o_orderpriority),
       concat('customer-', CAST(o_custkey AS STRING)), o_orderdate, 3,
       CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'draft' ELSE 'archived' END, lower(o_orderpriority), o_orderkey,
       concat('customer-', CAST(o_custkey AS STRING))
FROM @orders
""")

derive("contents", """
SELECT id, content_type, title, lower(replace(replace(title, '#', ''), ' ', '-')) AS slug,
       concat('{"belongs_to":{"id":"', ref, '"},"label":"', content_type, '","total":', CAST(num AS STRING), '}') AS content,
       concat('{"custom_fields":{"tier":"t', CAST(num % 4 AS STRING), '"},"hierarchy_level":', CAST(lvl AS STRING),
              ',"object_type":"', content_type, '"',
              CASE WHEN parent_id IS NULL THEN '' ELSE concat(',"parent_id":"', parent_id, '"') END,
              ',"referenced_by":[{"id":"order-', CAST(num % 50 AS STRING), '","type":"article"}],"references":[{"id":"', ref,
              '","type":"link"},{"id":"region-', CAST(num % 6 AS STRING), '"}],"status":"', status, '","tags":["', tag, '","all"]}') AS metadata,
       parent_id, lvl AS hierarchy_level, content_type AS object_type, status, $SPLIT(concat(tag, ',all'), ',') AS tags,
       concat('project-', CAST(num % 5 AS STRING)) AS project_id, created_at, created_at AS updated_at
FROM @raw_contents
""")

# Everything that references may point at.
derive("objects", """
SELECT id, content_type AS object_type FROM @raw_contents
UNION ALL SELECT concat('part-', CAST(p_partkey AS STRING)), CASE WHEN p_size = 50 THEN CAST(NULL AS STRING) ELSE 'part' END FROM @part
UNION ALL SELECT concat('supplier-', CAST(s_suppkey AS STRING)), 'supplier' FROM @supplier
""")

derive("edges", """
SELECT concat('order-', CAST(l_orderkey AS STRING)) AS source_id,
       CASE WHEN l_orderkey % 97 = 0 THEN concat('part-missing-', CAST(l_partkey AS STRING)) ELSE concat('part-', CAST(l_partkey AS STRING)) END AS target_id,
       'part' AS reference_type FROM @lineitem
UNION ALL SELECT concat('order-', CAST(l_orderkey AS STRING)), concat('supplier-', CAST(l_suppkey AS STRING)), 'supplier' FROM @lineitem
UNION ALL SELECT concat('order-', CAST(o_orderkey AS STRING)), concat('customer-', CAST(o_custkey AS STRING)), 'parent' FROM @orders
""")

# One document of every kind of reference per order line.
derive("line_contents", """
SELECT concat_ws('-', 'line', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS id,
       concat('{"buyer":"none","item":{"id":"part-', CAST(l_partkey AS STRING), '","type":"part"},"meta":{"name":"x"},"others":[{"id":"supplier-',
              CAST(l_suppkey AS STRING), '"},"plain",{"name":"y"},{"id":"part-', CAST(l_partkey AS STRING), '","type":"again"}],"qty":',
              CAST(CAST(l_quantity AS BIGINT) AS STRING), '}') AS content,
       concat('{"parent_id":"', CASE WHEN l_linenumber = 7 THEN '' ELSE concat('order-', CAST(l_orderkey AS STRING)) END,
              '","references":[{"id":"part-', CAST(l_partkey AS STRING), '"},{"target_id":"supplier-', CAST(l_suppkey AS STRING),
              '","type":"vendor"},{"id":"order-', CAST(l_orderkey AS STRING), '","type":"parent"},"junk",7],"related_to":["part-',
              CAST(l_partkey AS STRING), '",{"id":"supplier-', CAST(l_suppkey AS STRING), '"},{"id":"supplier-', CAST(l_suppkey AS STRING),
              '","type":"vendor"},5]}') AS metadata,
       concat('order-', CAST(l_orderkey AS STRING)) AS order_id, concat('part-', CAST(l_partkey AS STRING)) AS part_id,
       concat('supplier-', CAST(l_suppkey AS STRING)) AS supplier_id, l_linenumber
FROM @lineitem
""")

derive("doc_contents", """
SELECT concat('doc-', CAST(doc_id AS STRING)) AS id, source AS content_type, concat(lang, ' document ', CAST(doc_id AS STRING)) AS title,
       CAST(to_json($OBJ('lang', lang, 'text', text)) AS STRING) AS content,
       CAST(to_json($OBJ('source', source, 'status', 'active')) AS STRING) AS metadata,
       CAST('2024-01-01 00:00:00' AS $TS) + INTERVAL '1' MINUTE * doc_id AS created_at, text
FROM @documents
""")

# Dirty payloads.
derive("payloads", """
SELECT event_id, event_type, CASE
  WHEN event_id % 11 = 0 THEN '{bad'
  WHEN event_id % 7 = 0 THEN concat('{"type":"', event_type, '","value":"x"}')
  WHEN event_id % 5 = 0 THEN concat('{"value":', CAST(value AS STRING), '}')
  WHEN event_id % 3 = 0 THEN concat('{"type":null,"value":', CAST(event_id AS STRING), '}')
  ELSE concat('{"type":"', event_type, '","value":', CAST(value AS STRING), '}') END AS payload
FROM @events
""")

# One JSON value of every kind per event.
derive("cases", """
SELECT event_id, concat('{"v":', CASE event_id % 20
  WHEN 0 THEN concat('"', event_type, '"') WHEN 1 THEN CAST(event_id AS STRING) WHEN 2 THEN '1.5' WHEN 3 THEN 'true' WHEN 4 THEN 'null'
  WHEN 5 THEN concat('["', event_type, '","b"]') WHEN 6 THEN concat('["a",', CAST(event_id AS STRING), ',null]') WHEN 7 THEN '[]'
  WHEN 8 THEN concat('{"a":', CAST(event_id AS STRING), '}') WHEN 9 THEN '{"a":1,"b":"x"}' WHEN 10 THEN '{}'
  WHEN 11 THEN '"2023-01-01T12:00:00"' WHEN 12 THEN '"2023-02-30"' WHEN 13 THEN '"2023"' WHEN 14 THEN '"12:30:00"'
  WHEN 15 THEN '"20230101"' WHEN 16 THEN '12345678901234567890' WHEN 17 THEN '1.0' WHEN 18 THEN '"2024-02-29"' ELSE '[[1,2],["x"]]' END, '}') AS payload,
  event_id % 20 AS kind
FROM @events
""")

# Posts with fields that the rules look at.
derive("posts", """
SELECT concat('post-', CAST(o_orderkey AS STRING)) AS id,
       concat('{"belongs_to":{"id":"nation-', CAST(o_custkey % 25 AS STRING), '","type":"Website"},"body":"',
              CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('Body of ', o_orderpriority, ' order') END,
              '","excerpt":"', CASE WHEN o_orderkey % 4 = 0 THEN 'elsewhere' ELSE o_orderpriority END,
              '","score":', CAST(o_orderkey % 9 - 2 AS STRING),
              ',"slug":"', CASE WHEN o_orderkey % 5 = 0 THEN 'Bad Slug' ELSE concat('order-', CAST(o_orderkey AS STRING)) END,
              '","status":"', CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'unknown' END,
              '","steps":', CASE o_orderkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{"prompt_name":"a"},{"other":1}]' WHEN 2 THEN '"none"' ELSE '[{"prompt_name":"a"}]' END,
              ',"system_message":', CASE o_orderkey % 3 WHEN 0 THEN '{"agent_role":"r","agent_task":"t"}' WHEN 1 THEN '{"agent_role":"r"}' ELSE '{}' END,
              ',"human_message":', CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '{"q":1}' END,
              ',"title":"', CASE o_orderkey % 5 WHEN 0 THEN '   ' WHEN 1 THEN 'abc' ELSE concat('Order number ', CAST(o_orderkey AS STRING)) END,
              '","uid":"', CASE WHEN o_orderkey % 3 = 0 THEN 'nope' ELSE concat('e47ac10b-58cc-4372-a567-', lpad(CAST(o_orderkey AS STRING), 12, '0')) END,
              '","url":"', CASE WHEN o_orderkey % 7 = 0 THEN 'no link' ELSE concat('https://example.com/', CAST(o_orderkey AS STRING)) END,
              '","metadata":{"tags":[]', CASE WHEN o_orderkey % 2 = 0 THEN ',"content_type":"x"' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN ',"audience":"y"' ELSE '' END, '}}') AS content,
       o_orderdate AS created_at
FROM @orders
""")

derive("contexts", """
SELECT CAST(event_id AS STRING) AS id, event_type AS type, props AS params,
       concat('{"value":', CAST(event_id AS STRING), '}') AS context,
       CASE WHEN event_id % 10 = 0 THEN CAST(NULL AS STRING) ELSE CAST(user_id AS STRING) END AS project_id,
       ts AS created_at, ts AS updated_at
FROM @events
""")

derive("updates", """
SELECT concat('customer-', CAST(user_id AS STRING)) AS id,
       CASE WHEN user_id % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('{"n":', CAST(count(*) AS STRING), '}') END AS content,
       CASE WHEN user_id % 2 = 0 THEN CAST(NULL AS STRING) ELSE concat('{"last":', CAST(max(event_id) AS STRING), '}') END AS metadata
FROM @events GROUP BY user_id
""")

# Stored model definitions, some of them faulty.
derive("stored_definitions", """
SELECT CAST(p_partkey AS STRING) AS id, concat('Model', CAST(p_partkey AS STRING)) AS name,
       CASE p_size % 9 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' WHEN 3 THEN 'qualifier' WHEN 4 THEN 'organizer'
                       WHEN 5 THEN 'prompt_template' WHEN 6 THEN 'prompt_chain' WHEN 7 THEN 'delta' ELSE CAST(NULL AS STRING) END AS object_type,
       concat('1.', CAST(p_size AS STRING)) AS version, p_name AS description,
       CASE WHEN p_partkey % 13 = 0 THEN '{broken'
            WHEN p_partkey % 11 = 0 THEN '{"fields":{"title":{"type":"str"}}}'
            WHEN p_partkey % 9 = 0 THEN concat('{"fields":["title"],"name":"Model', CAST(p_partkey AS STRING), '"}')
            WHEN p_partkey % 7 = 0 THEN concat('{"fields":{"size":{"required":true},"title":"str"},"name":"Model', CAST(p_partkey AS STRING), '","validators":{}}')
            WHEN p_partkey % 5 = 0 THEN concat('{"fields":{"title":{"type":"str"}},"metadata_schema":[],"name":"Model', CAST(p_partkey AS STRING), '","validators":[{"name":"a","fields":["title"]}]}')
            ELSE concat('{"fields":{"brand":{"args":{"default":"', p_brand, '","description":"the brand"},"required":false,"type":"str"},"created":{"type":"datetime"},',
                        '"id":{"type":"UUID"},"price":{"args":{"default":1.5},"type":"float"},"size":{"default":', CAST(p_size AS STRING), ',"type":"int"},',
                        '"tags":{"args":{"default":[],"description":""},"type":"List[str]"},"title":{"required":true,"type":"str"}},',
                        '"metadata_schema":{"required":["tags"]},"name":"Model', CAST(p_partkey AS STRING), '"',
                        CASE WHEN p_partkey % 4 = 0 THEN concat(',"table_name":"shared_', CAST(p_size AS STRING), '"') ELSE '' END,
                        ',"validators":[{"code":"","fields":["title"],"name":"title_not_empty"}]}') END AS definition,
       CAST('2024-01-01 00:00:00' AS $TS) AS created_at, CAST('2024-01-02 00:00:00' AS $TS) AS updated_at
FROM @part
""")

# The sound definitions above, and the fields of all definitions as plain rows: broken ones have none,
# those without a name have theirs, and fields that say no type are of any type.
derive("sound_definitions", """
SELECT p_partkey, p_size, p_brand, concat('Model', CAST(p_partkey AS STRING)) AS name,
       CASE WHEN p_partkey % 4 = 0 THEN concat('shared_', CAST(p_size AS STRING)) ELSE concat('model', CAST(p_partkey AS STRING)) END AS table_name
FROM @part
WHERE p_partkey % 13 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0
""")

derive("fields", """
SELECT m.name AS model, m.table_name, f.field, f.pos, f.type, f.required, f.field = 'id' AS primary_key
FROM @sound_definitions m CROSS JOIN (
  SELECT 'brand' AS field, 0 AS pos, 'str' AS type, false AS required UNION ALL SELECT 'created', 1, 'datetime', true
  UNION ALL SELECT 'id', 2, 'UUID', true UNION ALL SELECT 'price', 3, 'float', true UNION ALL SELECT 'size', 4, 'int', true
  UNION ALL SELECT 'tags', 5, 'List[str]', true UNION ALL SELECT 'title', 6, 'str', true) f
UNION ALL SELECT concat('Model', CAST(k AS STRING)), concat('model', CAST(k AS STRING)), field, pos, type, true, false FROM (
  SELECT p_partkey AS k, 'title' AS field, 0 AS pos, 'str' AS type FROM @part WHERE p_partkey % 13 <> 0 AND p_partkey % 11 = 0
  UNION ALL SELECT p_partkey, 'title', 0, 'str' FROM @part WHERE p_partkey % 13 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, f.field, f.pos, 'Any' FROM (SELECT p_partkey FROM @part WHERE p_partkey % 13 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 7 = 0) p
    CROSS JOIN (SELECT 'size' AS field, 0 AS pos UNION ALL SELECT 'title', 1) f)
""", lambda t: field_catalog(t.stored_definitions))

# Physical tables: some lack columns, some have wrong types, some do not exist.
derive("columns", """
SELECT t.table_name AS $Qtable$Q, c.col AS $Qcolumn$Q,
       CASE WHEN c.col = 'size' AND t.k % 3 = 0 THEN 'int' WHEN c.col = 'price' AND t.k % 8 = 1 THEN 'string' ELSE c.data_type END AS data_type, c.pos
FROM (SELECT table_name, min(p_partkey) AS k FROM @sound_definitions GROUP BY table_name) t CROSS JOIN (
  SELECT 'id' AS col, 'string' AS data_type, 1 AS pos UNION ALL SELECT 'title', 'string', 2 UNION ALL SELECT 'price', 'double', 3
  UNION ALL SELECT 'size', 'bigint', 4 UNION ALL SELECT 'created', 'timestamp', 5) c
WHERE t.k % 10 <> 1 AND NOT (c.col = 'title' AND t.k % 6 = 2)
""", physical_columns)

derive("json_schemas", """
SELECT CASE WHEN p_size % 2 = 0 THEN 'shop' ELSE 'blog' END AS source_schema, concat('Part', CAST(p_partkey AS STRING)) AS name,
       concat('{"properties":{"amount":{"default":', CAST(p_size AS STRING), ',"type":"integer"},"at":{"format":"date-time","type":"string"},',
              '"deep":', repeat('{"items":', p_size % 13), '{"type":"number"}', repeat(',"type":"array"}', p_size % 13), ',"flag":{"type":"boolean"},"free":{},"meta":{"type":"object"},',
              '"name":{"description":"', p_brand, '","type":"string"},"nothing":{"type":"null"},"tags":{"items":{"type":"string"},"type":"array"},"things":{"type":"array"}},',
              '"required":["name"', CASE WHEN p_size % 3 = 0 THEN ',"amount"' ELSE '' END, '],"title":"Part"}') AS definition
FROM @part
""")

derive("schema_fields", """
SELECT source_schema, name, p_size, p_brand, f.field, f.pos, CASE WHEN f.field = 'deep' THEN concat(repeat('List[', p_size % 13), 'float', repeat(']', p_size % 13)) ELSE f.type END AS type
FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'shop' ELSE 'blog' END AS source_schema, concat('Part', CAST(p_partkey AS STRING)) AS name, p_size, p_brand FROM @part) p
CROSS JOIN (
  SELECT 'amount' AS field, 0 AS pos, 'int' AS type UNION ALL SELECT 'at', 1, 'datetime' UNION ALL SELECT 'deep', 2, 'set above'
  UNION ALL SELECT 'flag', 3, 'bool' UNION ALL SELECT 'free', 4, 'Any' UNION ALL SELECT 'meta', 5, 'Dict[str, Any]' UNION ALL SELECT 'name', 6, 'str'
  UNION ALL SELECT 'nothing', 7, 'None' UNION ALL SELECT 'tags', 8, 'List[str]' UNION ALL SELECT 'things', 9, 'List[Any]') f
""")

# Templates given as columns, with gaps, and as stored objects.
derive("template_rows", """
SELECT concat('template-', CAST(p_partkey AS STRING)) AS id, CASE WHEN p_partkey % 9 = 0 THEN CAST(NULL AS STRING) ELSE p_name END AS name,
       concat('Write about ', p_name, ': {context} / {controlled_context}') AS template_text,
       CASE WHEN p_size % 2 = 0 THEN concat('{"size":', CAST(p_size AS STRING), '}') ELSE CAST(NULL AS STRING) END AS variables,
       CASE WHEN p_size % 3 = 0 THEN CAST(NULL AS STRING) ELSE p_type END AS model,
       CASE WHEN p_size % 4 = 0 THEN CAST(NULL AS STRING) ELSE '0.25' END AS temperature,
       CAST(NULL AS STRING) AS description, CASE WHEN p_size % 5 = 0 THEN CAST(NULL AS STRING) ELSE p_brand END AS category,
       CAST(NULL AS STRING) AS version, CASE WHEN p_size % 6 = 0 THEN CAST(NULL AS STRING) ELSE concat('["', p_type, '"]') END AS tags
FROM @part
""")

derive("templates", """
SELECT concat('template-', CAST(p_partkey AS STRING)) AS id, 'prompt_template' AS content_type, p_name AS title,
       concat('{"template_text":"Write about ', p_name, '"', CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(',"model":"', p_type, '"') END,
              CASE WHEN p_size % 4 = 0 THEN '' ELSE ',"temperature":0.25' END, '}') AS content,
       concat('{"status":"active"', CASE WHEN p_size % 5 = 0 THEN '' ELSE concat(',"category":"', p_brand, '"') END,
              CASE WHEN p_size % 6 = 0 THEN '' ELSE concat(',"tags":["', p_type, '"]') END, '}') AS metadata,
       CAST('2024-01-01 00:00:00' AS $TS) + INTERVAL '1' MINUTE * p_size AS created_at,
       CAST('2024-01-01 00:00:00' AS $TS) AS updated_at, p_partkey, p_size, p_brand, p_type
FROM @part
""")

derive("adaptations", """
SELECT concat('adapt-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id,
       CASE WHEN l_orderkey % 41 = 0 THEN concat('template-gone-', CAST(l_partkey AS STRING)) ELSE concat('template-', CAST(l_partkey AS STRING)) END AS original_template_id,
       CASE WHEN l_linenumber = 1 THEN CAST(NULL AS STRING) ELSE concat('site-', CAST(l_suppkey AS STRING)) END AS site_id,
       CASE WHEN l_linenumber = 2 THEN CAST(NULL AS STRING) ELSE concat('project-', CAST(l_orderkey % 50 AS STRING)) END AS project_id,
       concat('Adapted text ', CAST(l_linenumber AS STRING)) AS template_text, CAST(NULL AS STRING) AS variables,
       CASE WHEN l_linenumber = 3 THEN 'own-model' ELSE CAST(NULL AS STRING) END AS model, CAST(NULL AS STRING) AS temperature,
       CAST(NULL AS STRING) AS version, l_shipdate AS created_at
FROM @lineitem
""")

# Chat turns as prompt components and as chains of three steps.
derive("prompt_components", """
SELECT concat('conv-', CAST(conv_id AS STRING)) AS prompt, turn AS position,
       CASE turn % 8 WHEN 0 THEN 'focused_question' WHEN 1 THEN 'agent_role' WHEN 2 THEN 'agent_task' WHEN 3 THEN 'key_information'
                     WHEN 4 THEN 'context_placeholder' WHEN 5 THEN 'output_format' WHEN 6 THEN 'agent_goal' ELSE 'notes' END AS component, text
FROM @conversations
""")

derive("chains", """
SELECT concat('chain-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS name, turn,
       CASE WHEN turn % 6 = 5 THEN '[]' ELSE concat(
         '[{"input_mapping":{},"output_key":"', role, '","prompt_name":"first","version_requirement":">=1.', CAST(turn AS STRING), '.0"},',
         CASE WHEN turn % 4 = 3 THEN '"plain",' ELSE '' END,
         '{"input_mapping":{"a":"$outputs.', CASE WHEN turn % 3 = 0 THEN 'late' ELSE role END, '","b":"fixed","c":3},"output_key":"mid"',
         CASE WHEN turn % 5 = 2 THEN '' ELSE ',"prompt_name":"second"' END, '},',
         '{"input_mapping":{"a":"$outputs.mid","b":"$outputs.', CASE WHEN turn % 2 = 0 THEN 'nowhere' ELSE 'mid' END, '"},"output_key":"late","prompt_name":"third"}]') END AS chain_steps
FROM @conversations
""")

derive("vectors", """
SELECT concat('doc-', CAST(vec_id AS STRING)) AS content_id, embedding, concat('label-', CAST(label AS STRING)) AS content_type,
       CASE WHEN vec_id % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('{"label":"', CAST(label AS STRING), '"}') END AS metadata
FROM @embeddings
""")

derive("organizers", """
SELECT concat('set-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id,
       concat('[{"id":"order-', CAST(l_orderkey AS STRING), '","position":2,"status":"published","type":"article"},{"id":"customer-',
              CAST(l_partkey AS STRING), '","position":1,"type":"collection"}]') AS content_items,
       concat('{"authors":["supplier-', CAST(l_suppkey AS STRING), '"],"categories":["', l_returnflag, '","', l_linestatus, '"],"tags":[]}') AS qualifiers,
       concat('{"article":"order-', CAST(l_orderkey AS STRING), '","website":"region-', CAST(l_suppkey % 7 AS STRING), '"}') AS belongs_to,
       concat('{"key_takeaways":["part-', CAST(l_partkey AS STRING), '","part-none"],"tables":["supplier-', CAST(l_suppkey AS STRING), '"]}') AS extracted_components
FROM @lineitem
""")

# Each order lists lines 1 to 3 as its content, whether they exist or not.
derive("hierarchies", """
SELECT concat('order-', CAST(o_orderkey AS STRING)) AS id,
       concat('{"categories":[{"id":"cat-', CAST(o_orderkey AS STRING), '","name":"', o_orderpriority, '","slug":"p","subcategories":[]}],"topics":[{"id":"set-',
              CAST(o_orderkey AS STRING), '-1","name":"one","slug":"one","subtopics":[{"id":"set-', CAST(o_orderkey AS STRING),
              '-2","name":"two","slug":"two"},{"id":"set-', CAST(o_orderkey AS STRING), '-3","name":"three"}]}]}') AS content_hierarchy
FROM @orders
""")
