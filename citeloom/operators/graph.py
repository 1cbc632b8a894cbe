"""Graphs of documents: containment, references, authorities, weights, and parts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.lineage import materialize

EDGE = "u string, v string, edge_type string"
# The columns of a node list.
NODE_COLUMNS = [
    "key", "level", "citekey", "parent_key", "type", "document_type", "heading", "law_name", "chars_n", "chars_nowhites", "tokens_n", "tokens_unique",
    "abbr_1", "abbr_2", "subject_areas", "legislators", "contributors", "texts_tokens_n", "texts_chars_n",
]


def containment_edges(nodes: DataFrame, root: str = "root") -> DataFrame:
    """Parent to child; documents hang below a root node that stands for the whole snapshot."""
    parent = F.when(F.coalesce(F.col("parent_key"), F.lit("")) == "", F.lit(root)).otherwise(F.col("parent_key"))
    return nodes.where("key is not null").select(parent.alias("u"), F.col("key").alias("v"), F.lit("containment").alias("edge_type"))


def typed_edges(pairs: DataFrame, u: str, v: str, kind: str) -> DataFrame:
    return pairs.select(F.col(u).cast("string").alias("u"), F.col(v).cast("string").alias("v"), F.lit(kind).alias("edge_type"))


def export_nodes(nodes: DataFrame, root: str = "root") -> DataFrame:
    """The fixed columns of a node list, and a row for the root; regulations are known by their keys where no type is given."""
    have = set(nodes.columns)
    attr = {"subject_areas": "sachgebiete", "legislators": "normgeber", "contributors": "mitwirkende", "abbr_1": "abbr_1", "abbr_2": "abbr_2", "document_type": "document_type"}
    law = F.expr("max(case when level = 0 then heading end) over (partition by doc_id)")

    def column(name: str):
        if name == "law_name":
            return law.alias(name)
        if name == "document_type":
            own = F.col("attributes")[name]
            return F.coalesce(own, F.when(F.col("key").startswith("cfr"), "regulation").otherwise("statute")).alias(name)
        if name in attr:
            return F.col("attributes")[attr[name]].alias(name)
        if name in ("texts_tokens_n", "texts_chars_n"):
            return F.array_join(F.col(name).cast("array<string>"), ",").alias(name) if name in have else F.lit(None).cast("string").alias(name)
        return F.col(name)

    out = nodes.where("key is not null").select(*(column(c) for c in NODE_COLUMNS))
    top = out.limit(0).sparkSession.range(1).select(*(F.lit(root).alias(c) if c in ("key", "law_name") else F.lit(-1).cast("int").alias(c) if c == "level" else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in NODE_COLUMNS))
    return top.unionByName(out)


def snapshot_edges(containment: DataFrame, references: DataFrame, authorities: DataFrame | None = None) -> DataFrame:
    """All edges of a snapshot; repeats stay, they are a multigraph."""
    out = containment.unionByName(references)
    return out.unionByName(authorities) if authorities is not None else out


def weighted(edges: DataFrame, by: tuple[str, ...] = ("u", "v")) -> DataFrame:
    return edges.groupBy(*by).agg(F.count(F.lit(1)).alias("weight"))


def without_kind(nodes: DataFrame, edges: DataFrame, kind: str = "subseqitem") -> tuple[DataFrame, DataFrame]:
    """The graph without nodes of a type and the edges that touch them; ends outside the node list stay."""
    gone = nodes.where(F.col("type") == kind).select("key")
    kept = edges.join(gone.withColumnRenamed("key", "u"), "u", "left_anti").join(gone.withColumnRenamed("key", "v"), "v", "left_anti")
    return nodes.where(F.col("type").isNull() | (F.col("type") != kind)), kept


def quotient(edges: DataFrame, units: DataFrame) -> DataFrame:
    """``edges(u, v, edge_type)`` between units: an end that ``units(key, unit)`` has moves to its unit, another one stays.

    Edges that so come to lie within one unit go; loops of a node that is no part of a unit, and repeats, stay. Keys of
    ``units`` are unique; rows with a null key or unit move nothing.
    """
    of = lambda c: units.where("key is not null and unit is not null").select(F.col("key").alias(c), F.col("unit").alias(f"_{c}"))
    moved = edges.join(of("u"), "u", "left").join(of("v"), "v", "left")
    u, v = F.coalesce("_u", "u"), F.coalesce("_v", "v")
    inner = (F.col("_u").isNotNull() | F.col("_v").isNotNull()) & (u == v)
    return moved.where(~F.coalesce(inner, F.lit(False))).select(u.alias("u"), v.alias("v"), "edge_type")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("u").alias("key")).distinct(), "key", "left_anti")


def ancestors(nodes: DataFrame) -> DataFrame:
    """``(key, ancestor, distance)`` of every node, itself at 0, by jumps that double.

    A round knows the ancestors up to a distance and the one at just that distance; put together they reach twice as
    far. So a tree of n levels takes the logarithm of n rounds, each of which is written. A node that is its own
    ancestor is an error.
    """
    jump = materialize(nodes.where("coalesce(parent_key, '') <> ''").select("key", F.col("parent_key").alias("to")))
    known, reach = nodes.select("key", F.col("key").alias("ancestor"), F.lit(0).alias("distance")), 1
    while jump.take(1):
        far = known.join(jump.select(F.col("key").alias("ancestor"), "to"), "ancestor").select("key", F.col("to").alias("ancestor"), (F.col("distance") + reach).alias("distance"))
        far = materialize(far)
        if far.where("key = ancestor").take(1):
            raise ValueError("a node is its own ancestor")
        known = known.unionByName(far)
        jump = materialize(jump.join(jump.select(F.col("key").alias("to"), F.col("to").alias("next")), "to").select("key", F.col("next").alias("to")))
        reach *= 2
    return known


def decision_references(refs: DataFrame, closure: DataFrame) -> DataFrame:
    """A reference of a node counts for every node around it: ``(u, v, edge_type)`` for ``refs(key, target)``."""
    return refs.join(closure.select("key", "ancestor"), "key").select(F.col("ancestor").alias("u"), F.col("target").alias("v"), F.lit("reference").alias("edge_type"))


def bipartite_nodes(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """Decision nodes and the different statutes that are referred to."""
    return nodes.select("key", F.lit("decision").alias("bipartite")).unionByName(references.select(F.col("v").alias("key"), F.lit("statute").alias("bipartite")).distinct())


def one_to_one(pairs: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Different pairs both ends of which occur in one pair only."""
    d = pairs.select(u, v).distinct()
    once = lambda c: d.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(c)
    return d.join(once(u), u, "left_semi").join(once(v), v, "left_semi").select(u, v)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an undirected graph of ``edges(a, b)`` of longs: the smallest node that can be reached.

    Large-star and small-star steps in turn (Kiveris et al. 2014), so a chain of n nodes takes some log n rounds. A step is
    a minimum a node and a join back; no component is gathered. Nodes without a link to another one are not returned.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # settled: every larger end has one link, and is nobody's smaller end
        if not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").take(1):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
