"""The cross-reference graph: extraction, maintenance and checks.

The edge table (source_id, target_id, reference_type) is the truth. Embedded
back-reference lists are a view on it and come in parts of bounded size, since
one popular target may be referenced by a third of all objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contentloom.functions import payload as P
from contentloom.operators.skew import Dealt, dealt_by, salted_join, without
from contentloom.operators.validation import once

REF = "struct<id:string,type:string>"


def _list(c: Column) -> Column:
    return F.coalesce(P.as_list(c), F.array().cast(P.ANY_LIST))


def embedded_refs(content: Column, metadata: Column) -> Column:
    """All references of one object in order, duplicates included; a type may be NULL.

    Object values of the content with an id, objects with an id inside its list
    values (keys in sorted order), then the metadata's references. Values are read
    with a typed cast, which turns everything of another shape into NULL.
    """
    none = F.array().cast(f"array<{REF}>")
    with_id = lambda refs: F.coalesce(F.filter(refs, lambda r: r["id"].isNotNull()), none)
    objects = F.map_values(F.try_variant_get(content, "$", f"map<string,{REF}>"))
    lists = F.map_values(F.try_variant_get(content, "$", f"map<string,array<{REF}>>"))
    own = F.zip_with(objects, lists, lambda o, l: F.when(o["id"].isNotNull(), F.array(o)).otherwise(with_id(l)))
    stored = with_id(F.try_variant_get(metadata, "$.references", f"array<{REF}>"))
    return F.concat(F.coalesce(F.flatten(own), none), stored)


def _first_in_row(df: DataFrame, refs: Column, key: tuple[str, ...]) -> DataFrame:
    """Append ``refs`` without duplicates, the first one winning.

    References of an object all stand in its own row, so they are sorted and
    compared with their neighbour there; nothing is shuffled.
    """
    ranked = F.sort_array(F.transform(refs, lambda r, i: F.struct(*[r[k].alias(k) for k in key], i.alias("pos"), r.alias("ref"))))
    out = once(df, __sorted=ranked)
    same = lambda x, i: F.struct(*[F.get(F.col("__sorted"), i - 1)[k] for k in key]).eqNullSafe(F.struct(*[x[k] for k in key]))
    kept = F.filter(F.col("__sorted"), lambda x, i: (i == 0) | ~same(x, i))
    return once(out, refs=kept).drop("__sorted")


def extract_embedded(df: DataFrame) -> DataFrame:
    """References embedded in content and metadata as rows (source_id, pos, id, type).

    One level deep. Each id once per object, the first occurrence winning.
    """
    parsed = df.select(
        F.col("id").alias("source_id"),
        P.safe_json(F.col("content")).alias("__c"), P.safe_json(F.col("metadata")).alias("__m"),
    )
    unique = _first_in_row(parsed, embedded_refs(F.col("__c"), F.col("__m")), ("id",))
    rows = unique.select("source_id", F.explode("refs").alias("r"))
    return rows.select("source_id", F.col("r.pos").alias("pos"), F.col("r.ref.id").alias("id"), F.coalesce("r.ref.type", F.lit("unknown")).alias("type"))


def metadata_edges(m: Column) -> Column:
    """Edges named by the metadata: references, the parent and related objects."""
    edge = lambda t, k: F.struct(t.alias("target_id"), k.alias("reference_type"))
    explicit = F.transform(
        F.try_variant_get(m, "$.references", "array<struct<id:string,target_id:string,type:string>>"),
        lambda r: F.when(r["target_id"].isNotNull() & r["type"].isNotNull(), edge(r["target_id"], r["type"])).otherwise(
            edge(r["id"], F.coalesce(r["type"], F.lit("reference")))
        ),
    )
    parent = F.array(edge(F.nullif(P.get_text(m, "parent_id"), F.lit("")), F.lit("parent")))
    related = F.zip_with(
        F.try_variant_get(m, "$.related_to", f"array<{REF}>"), P.as_list(P.get(m, "related_to")),
        lambda o, v: F.when(o["id"].isNotNull(), edge(o["id"], F.coalesce(o["type"], F.lit("related")))).when(
            P.is_text(v), edge(P.as_text(v), F.lit("related"))
        ),
    )
    none = F.array().cast("array<struct<target_id:string,reference_type:string>>")
    found = F.concat(F.coalesce(explicit, none), parent, F.coalesce(related, none))
    return F.filter(found, lambda e: e["target_id"].isNotNull())


def extract_edges(df: DataFrame) -> DataFrame:
    """The edge table of a content table, each (source, target, type) once."""
    parsed = df.select(F.col("id").alias("source_id"), P.safe_json(F.col("metadata")).alias("__m"))
    unique = _first_in_row(parsed, metadata_edges(F.col("__m")), ("target_id", "reference_type"))
    return unique.select("source_id", F.explode("refs").alias("r")).select("source_id", "r.target_id", "r.reference_type")


def unique_edges(edges: DataFrame) -> DataFrame:
    """Edges from several sources without duplicates."""
    return edges.select("source_id", "target_id", "reference_type").distinct()


def replace_edges(edges: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """Swap all edges of the changed sources for the new ones, also for an empty new set."""
    changed = sources.select(F.col("id").alias("source_id")).distinct()
    kept = salted_join(edges, changed, ["source_id"], ["target_id"], "left_anti")
    return kept.unionByName(unique_edges(new))


def with_source_type(edges: DataFrame, contents: DataFrame) -> DataFrame:
    """Unique edges with the source's ``type`` and ``first``, which is true for one edge of each pair of source and target.

    Edges are dealt by source once; duplicates go and the type comes where they lie then. The window holds the edges of one
    pair. Of several types of one id the greatest counts.
    """
    dealt = dealt_by(edges.select("source_id", "target_id", "reference_type"), ["source_id"], ["target_id"])
    pair = Window.partitionBy("source_id", "__salt", "target_id").orderBy("reference_type")
    ranked = dealt.rows.select("*", F.row_number().over(pair).alias("n"), F.lag("reference_type").over(pair).alias("before"))
    unique = ranked.where((F.col("n") == 1) | ~F.col("reference_type").eqNullSafe(F.col("before"))).withColumn("first", F.col("n") == 1).drop("n", "before")
    kinds = contents.groupBy("id").agg(F.max(F.coalesce("object_type", F.lit("unknown"))).alias("object_type"))
    return _typed(dealt, unique, kinds).select("source_id", "target_id", "reference_type", "type", "first")


def _typed(dealt: Dealt, pairs: DataFrame, contents: DataFrame) -> DataFrame:
    kinds = contents.select(F.col("id").alias("source_id"), F.col("object_type").alias("type"))
    return dealt.join(pairs, kinds, "left").withColumn("type", F.coalesce("type", F.lit("unknown")))


def missing_targets(edges: DataFrame, contents: DataFrame) -> DataFrame:
    """``target_id`` of the targets that do not exist."""
    return edges.select("target_id").distinct().join(contents.select(F.col("id").alias("target_id")), "target_id", "left_anti")


def back_references(edges: DataFrame, contents: DataFrame) -> DataFrame:
    """Back references as rows (target_id, id, type): each source once per target.

    Sources of unknown type count as ``unknown``; targets that do not exist are
    left out. Only edges that a filter takes for one to a missing target are shuffled by target.
    """
    ends = edges.select("target_id", "source_id").where(F.col("target_id").isNotNull())
    known = without(ends, missing_targets(ends, contents), "target_id", ["source_id"])
    dealt = dealt_by(known, ["source_id"], ["target_id"], measure=edges)
    pairs = dealt.rows.distinct()
    return _typed(dealt, pairs, contents).select("target_id", F.col("source_id").alias("id"), "type")


def referenced_by_parts(back: DataFrame, part_size: int = 1000, edges: DataFrame | None = None) -> DataFrame:
    """Back-reference lists per target (target_id, part, n_parts, referenced_by).

    Targets with up to ``part_size`` back references have the one part 0. Larger
    lists are cut by a hash of the id, so no task collects a whole hot target and
    all entries stay in the result. ``edges``, if given, is used to find hot targets.
    """
    sizes = back.groupBy("target_id").agg(F.ceil(F.count("*") / part_size).alias("n_parts"))
    sized = salted_join(back, sizes, ["target_id"], ["id"], "inner", measure=edges)
    part = F.pmod(F.xxhash64("id"), F.col("n_parts")).alias("part")
    return sized.groupBy("target_id", part, "n_parts").agg(
        F.sort_array(F.collect_list(F.struct("id", "type"))).alias("referenced_by")
    )


def dangling(edges: DataFrame, contents: DataFrame) -> DataFrame:
    """Edges whose target does not exist."""
    known = contents.select(F.col("id").alias("target_id"))
    return salted_join(edges, known, ["target_id"], ["source_id"], "left_anti")


def drop_references(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges without those that start or end at a deleted id."""
    gone = deleted.select("id").distinct()
    kept = salted_join(edges, gone.withColumnRenamed("id", "target_id"), ["target_id"], ["source_id"], "left_anti")
    kept = salted_join(kept, gone.withColumnRenamed("id", "source_id"), ["source_id"], ["target_id"], "left_anti", measure=edges)
    return kept.select(*edges.columns)


def drop_embedded(df: DataFrame, deleted: DataFrame) -> DataFrame:
    """Contents whose embedded reference lists no longer name deleted ids.

    Only (object, referenced id) pairs meet the deleted ids; the list collected
    per object is no longer than the object's own lists.
    """
    m = P.safe_json(F.col("metadata"))
    ids = lambda key: F.coalesce(F.try_variant_get(F.col("__m"), f"$.{key}", f"array<{REF}>"), F.array().cast(f"array<{REF}>"))
    both = F.array_distinct(F.transform(F.concat(ids("references"), ids("referenced_by")), lambda r: r["id"]))
    listed = once(df.select(F.col("id").alias("owner"), m.alias("__m")), __ids=both)
    pairs = listed.select("owner", F.explode("__ids").alias("id")).dropna()
    hits = salted_join(pairs, deleted.select("id").distinct(), ["id"], ["owner"], "left_semi")
    dead = hits.groupBy("owner").agg(F.collect_set("id").alias("__dead")).withColumnRenamed("owner", "id")

    def without(key: str) -> Column:
        kept = F.filter(P.as_list(P.get(m, key)), lambda e: ~F.coalesce(F.array_contains(F.col("__dead"), P.get_text(e, "id")), F.lit(False)))
        return F.to_json(kept)

    cleaned = F.when(
        F.col("__dead").isNotNull(),
        P.merge_object(F.col("metadata"), {"references": without("references"), "referenced_by": without("referenced_by")}),
    ).otherwise(F.col("metadata"))
    return df.join(dead, "id", "left").withColumn("metadata", cleaned).select(*df.columns)
