"""Parents, levels, containers and the other documented relations between objects.

Lookups whose left side comes out of JSON are plain joins: counting their keys
first would parse the payloads twice. Adaptive execution splits their large
partitions, since nothing after them needs the join's partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentloom.functions import payload as P
from contentloom.operators.skew import salted_join
from contentloom.session import materialize

# The object kinds of each taxonomy level.
TAXONOMY = {
    "alpha": [
        "Website", "Book", "Ebook", "Documentation Site", "Knowledge Base", "Learning Management System",
        "Email Campaign", "Social Media Campaign", "Podcast Series", "Video Course", "Newsletter",
    ],
    "beta": [
        "Blog Post", "Landing Page", "Product Page", "Product Review", "Product Comparison", "Listicle",
        "How-To Guide", "Case Study", "Whitepaper", "Ebook Chapter", "Book Chapter", "FAQ Page", "Glossary Page",
        "Email Message", "Social Media Post", "Tweet Thread", "Podcast Episode", "Video Lesson", "Tutorial",
        "API Documentation", "Newsletter Issue",
    ],
    "gamma": [
        "Call to Action (CTA)", "Table", "Blockquote", "Image with Caption", "Code Snippet", "Interactive Demo",
        "Video Embed", "Audio Player", "Key Takeaway", "FAQ Item", "Testimonial", "Step Instructions", "Definition",
        "Sidebar Content", "Pull Quote", "Infographic", "Data Visualization", "Product Feature",
        "Pros and Cons List", "Checklist",
    ],
    "organizer": [
        "Collection", "Series", "Taxonomy", "ContentMap", "Sitemap", "ContentCalendar", "WorkflowTemplate",
        "ContentLayout", "ContentBundle", "Campaign",
    ],
    "qualifier": [
        "Tag", "Category", "Author", "Location", "Audience", "Language", "ReadingLevel", "ContentRating",
        "SeoMetadata", "PublicationStatus", "RevisionHistory", "AccessControl",
    ],
}
# The object types a stored model may have.
MODEL_TYPES = ("alpha", "beta", "gamma", "qualifier", "organizer", "prompt_template", "prompt_chain")


def taxonomy(spark: SparkSession) -> DataFrame:
    """The taxonomy as (level, kind) rows."""
    rows = [(level, kind) for level, kinds in TAXONOMY.items() for kind in kinds]
    return spark.createDataFrame(rows, "level string, kind string")


def with_taxonomy(df: DataFrame, kind_column: str, kinds: DataFrame | None = None) -> DataFrame:
    """Attach the taxonomy level of a kind and flag kinds outside the taxonomy.

    The taxonomy is a fixed list of under a hundred rows and is broadcast.
    """
    table = taxonomy(df.sparkSession) if kinds is None else kinds
    named = table.select(F.col("level").alias("taxonomy_level"), F.col("kind").alias(kind_column))
    return df.join(F.broadcast(named), kind_column, "left").withColumn("known_kind", F.col("taxonomy_level").isNotNull())


def known_model_type(df: DataFrame, column: str = "object_type") -> DataFrame:
    return df.withColumn("known_type", F.coalesce(F.col(column).isin(*MODEL_TYPES), F.lit(False)))


def with_parent_level(df: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Level from the parent's stored level: 0 for roots, parent + 1 below.

    A parent without a level counts as level 0. A parent that does not exist
    gives no level and the issue ``parent_not_found``.
    """
    parents = (df if current is None else current).select(
        F.col("id").alias("parent_id"), F.coalesce("hierarchy_level", F.lit(0)).alias("__parent_level")
    )
    own = df.withColumn("parent_id", F.nullif("parent_id", F.lit("")))
    joined = salted_join(own, parents, ["parent_id"], ["id"], "left")
    level = F.when(F.col("parent_id").isNull(), F.lit(0)).otherwise(F.col("__parent_level") + 1)
    lost = F.col("parent_id").isNotNull() & F.col("__parent_level").isNull()
    return joined.select(
        *[c for c in df.columns if c != "hierarchy_level"],
        level.cast("int").alias("hierarchy_level"),
        F.when(lost, F.lit("parent_not_found")).alias("issue"),
    )


def levels(df: DataFrame) -> DataFrame:
    """Level of every object when parents may stand in the same batch.

    Returns (id, level, issue). Each round doubles how far a row looks up, so a
    hierarchy of depth d takes about log2(d) rounds. Each round is written to the
    shared folder, which cuts the lineage. ``parent_not_found`` marks rows whose parent is not in
    the table, ``ancestor_not_found`` the rows below them, ``cycle`` rows that
    never reach a root.
    """
    nodes = df.select("id", F.nullif("parent_id", F.lit("")).alias("up"))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("__known"))
    start = salted_join(nodes, known, ["up"], ["id"], "left")
    lost = F.col("up").isNotNull() & F.col("__known").isNull()
    state = materialize(start.select(
        "id",
        F.when(~lost, F.col("up")).alias("up"),
        F.when(F.col("up").isNull() | lost, 0).otherwise(1).cast("bigint").alias("dist"),
        F.when(lost, F.lit("parent_not_found")).alias("issue"),
    ), "levels")
    return doubled(state)


def doubled(state: DataFrame) -> DataFrame:
    """(id, level, issue) of rows that look ``dist`` steps up, to ``up``; NULL there means finished.

    Each round looks up as far again; rows that look at one another for good are cycles, and so is what hangs below them.
    """
    finished, todo, before = [state.where(F.col("up").isNull())], state.where(F.col("up").isNotNull()), None
    while True:
        now = todo.count()
        # While any open row leads to a finished one, the last open row before it
        # finishes in the next round. A round without progress leaves only cycles.
        if now in (0, before):
            break
        before = now
        above = reduce(DataFrame.unionByName, [*finished, todo]).select(
            F.col("id").alias("up"), F.col("up").alias("__up"), F.col("dist").alias("__dist"), F.col("issue").alias("__issue")
        )
        moved = materialize(salted_join(todo, above, ["up"], ["id"], "inner").select(
            "id",
            F.col("__up").alias("up"),
            (F.col("dist") + F.col("__dist")).alias("dist"),
            F.when(F.col("__issue") == "cycle", "cycle").when(F.col("__issue").isNotNull(), "ancestor_not_found").alias("issue"),
        ), "levels")
        # Finished rows stay where they were written; a round writes its own rows only.
        finished.append(moved.where(F.col("up").isNull()))
        todo = moved.where(F.col("up").isNotNull())
    issue = F.when(F.col("up").isNotNull(), F.lit("cycle")).otherwise(F.col("issue"))
    return reduce(DataFrame.unionByName, [*finished, todo]).select("id", F.when(issue.isNull(), F.col("dist")).alias("level"), issue.alias("issue"))


# The nested list each top list of a content hierarchy holds.
NESTED = {"topics": "subtopics", "categories": "subcategories"}


def explode_hierarchy(df: DataFrame, column: str = "content_hierarchy") -> DataFrame:
    """Entries of nested content hierarchies as rows.

    Returns (container_id, kind, id, name, slug, parent_id, depth, pos). The top
    lists may have any name; their entries' nested lists are named in NESTED or
    ``sub`` + the top name.
    """
    top = F.map_entries(P.as_map(P.safe_json(F.col(column))))
    lists = df.select(F.col("id").alias("container_id"), F.explode(top).alias("e")).select(
        "container_id", F.col("e.key").alias("kind"), F.posexplode(P.as_list(F.col("e.value"))).alias("pos", "v")
    )
    nested_key = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in NESTED.items() for x in kv]), F.col("kind")),
        F.concat(F.lit("sub"), F.col("kind")),
    )
    entry = lambda v, parent, depth: [
        P.get_text(v, "id").alias("id"), P.get_text(v, "name").alias("name"), P.get_text(v, "slug").alias("slug"),
        parent.alias("parent_id"), F.lit(depth).alias("depth"), "pos",
    ]
    first = lists.select("container_id", "kind", *entry(F.col("v"), F.lit(None).cast("string"), 1))
    inner = (
        lists.select("container_id", nested_key.alias("kind"), P.get_text(F.col("v"), "id").alias("over"), P.as_map(F.col("v")).alias("m"))
        .select("container_id", "kind", "over", F.posexplode(P.as_list(F.try_element_at("m", F.col("kind")))).alias("pos", "v"))
        .select("container_id", "kind", *entry(F.col("v"), F.col("over"), 2))
    )
    return first.unionByName(inner)


def organizer_items(df: DataFrame, contents: DataFrame, column: str = "content_items") -> DataFrame:
    """Members of organizers in position order, with the content's title if it exists."""
    items = df.select(F.col("id").alias("organizer_id"), F.explode(P.as_list(P.safe_json(F.col(column)))).alias("v")).select(
        "organizer_id",
        P.get_text(F.col("v"), "id").alias("item_id"), P.get_text(F.col("v"), "type").alias("item_type"),
        P.get_int(F.col("v"), "position").alias("position"),
        F.coalesce(P.get_text(F.col("v"), "status"), F.lit("active")).alias("status"),
    )
    titles = contents.select(F.col("id").alias("item_id"), F.col("title").alias("item_title"))
    return items.join(titles, "item_id", "left")


def qualifiers(df: DataFrame, tables: DataFrame, column: str = "qualifiers") -> DataFrame:
    """Qualifier ids of objects, joined with the qualifier tables (kind, id, name)."""
    lists = F.explode(F.map_entries(P.as_map(P.safe_json(F.col(column))))).alias("e")
    rows = df.select(F.col("id").alias("object_id"), lists).select(
        "object_id", F.col("e.key").alias("kind"), F.explode(P.as_list(F.col("e.value"))).alias("v")
    ).select("object_id", "kind", P.as_text(F.col("v")).alias("qualifier_id"))
    named = tables.select("kind", F.col("id").alias("qualifier_id"), F.col("name").alias("qualifier_name"))
    return rows.join(named, ["kind", "qualifier_id"], "left")


def belongs_to(df: DataFrame, column: str = "belongs_to") -> DataFrame:
    """Container references of objects as rows (child_id, kind, container_id)."""
    entries = F.explode(F.map_entries(P.as_map(P.safe_json(F.col(column))))).alias("e")
    return df.select(F.col("id").alias("child_id"), entries).select(
        "child_id", F.col("e.key").alias("kind"), P.as_text(F.col("e.value")).alias("container_id")
    )


def container_links(children: DataFrame, listed: DataFrame) -> DataFrame:
    """Compare both directions of containment and name the links only one side has.

    ``children`` holds (child_id, container_id), ``listed`` (container_id, id) as
    explode_hierarchy returns it. Both sides are reduced to distinct pairs and
    grouped by the whole pair, which spreads even a container of a third of all rows.
    """
    below = children.select("container_id", "child_id", F.lit(1).alias("__below"), F.lit(0).alias("__above"))
    above = listed.select("container_id", F.col("id").alias("child_id"), F.lit(0), F.lit(1))
    merged = below.union(above).groupBy("container_id", "child_id").agg(F.max("__below").alias("b"), F.max("__above").alias("a"))
    status = F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("b") == 1, "not_listed").otherwise("not_claimed")
    return merged.select("container_id", "child_id", status.alias("link"))


def with_containers(children: DataFrame, contents: DataFrame) -> DataFrame:
    """Attach the container's title; a NULL title means it does not exist."""
    names = contents.select(F.col("id").alias("container_id"), F.col("title").alias("container_title"))
    return children.join(names, "container_id", "left")


def components(df: DataFrame, parts: DataFrame, column: str = "extracted_components") -> DataFrame:
    """Extracted components of objects joined with the component table; missing ones are flagged."""
    lists = F.explode(F.map_entries(P.as_map(P.safe_json(F.col(column))))).alias("e")
    rows = df.select(F.col("id").alias("object_id"), lists).select(
        "object_id", F.col("e.key").alias("kind"), F.posexplode(P.as_list(F.col("e.value"))).alias("pos", "v")
    ).select("object_id", "kind", "pos", P.as_text(F.col("v")).alias("component_id"))
    known = parts.select(F.col("id").alias("component_id"), F.col("title").alias("component_title"))
    joined = rows.join(known, "component_id", "left")
    return joined.withColumn("dangling", F.col("component_title").isNull())
