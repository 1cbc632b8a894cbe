"""The volumes of a title of regulations as one document.

What a volume begins with may go on with what the volume before ended with. Only the borders decide that: the last node
of every level of a volume (its right spine), and the containers that a volume begins with, as long as their headings
can meet one there. These few rows are stitched, title by title; all other nodes only learn the new beginning of
their paths, and get keys and places by counting within volumes.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.operators.joins import few_bytes
from citeloom.operators.lineage import materialize

_STITCHES = "title int, year int, volume int, old array<int>, new array<int>, shift int, target string, more int"


@dataclass
class _Node:
    """A container on the border of what is merged so far: its key, new path, heading's start, first free place, last part."""

    key: str
    path: list[int]
    start: str
    free: int
    last: _Node | None = None


def _stitch(rows: pd.DataFrame) -> pd.DataFrame:
    """From the border rows of a title: which containers go into which, and at which place their parts go on there.

    ``old`` is a path that gives way to ``new``; children's places below it are raised by ``shift``. ``target`` is the key of
    the container that takes the parts, None for the document, and ``more`` the number of parts that it gains by that.
    """
    root, out = _Node("", [], "", 0), []
    title, year = int(rows["title"].iloc[0]), int(rows["year"].iloc[0])
    for number, part in rows.groupby("volume"):
        held = {tuple(r.path): r for r in part.itertuples()}
        spine = sorted((p for p, r in held.items() if r.right), key=len)
        # a merged path: what took it, the first place there, and what was last there before
        image: dict[tuple, tuple[_Node, int, _Node | None]] = {(): (root, root.free, root.last)}

        def last_of(path: tuple, image=image, held=held) -> _Node | None:
            """The last container in what a merged path became."""
            r, (node, _, before) = held[path], image[path]
            if not r.n_children:
                return before
            below = image.get((*path, int(r.n_children) - 1))
            return below[0] if below else None

        for path in sorted(p for p, r in held.items() if r.left):
            r, above = held[path], image[path[:-1]]
            if path[-1] == 0:
                before = above[2]
            else:
                beside = (*path[:-1], path[-1] - 1)
                before = image[beside][0] if beside in image else None
                if before is not None:
                    before.last = last_of(beside)
            if before is None or not r.heading or before.start != r.start:
                break
            image[path] = (before, before.free, before.last)
            before.free += int(r.n_children)
        for path, (node, shift, _) in image.items():
            merged_below = sum(len(p) == len(path) + 1 and p[:-1] == path for p in image if p)
            out.append((title, year, int(number), list(path), node.path, shift, node.key or None, int(held[path].n_children) - merged_below))
        root.free += int(held[()].n_children)
        # the right spine of all volumes so far
        above = root
        for path in spine[1:]:
            r, prior = held[path], image.get(path)
            if prior:
                node = prior[0]
            else:
                base = next(path[:n] for n in range(len(path) - 1, -1, -1) if path[:n] in image)
                node = _Node(r.key, [*image[base][0].path, image[base][1] + path[len(base)], *path[len(base) + 1 :]], r.start, int(r.n_children))
            above.last, above = node, node
    return pd.DataFrame(out, columns=[c.split()[0] for c in _STITCHES.split(", ")])


def _borders(items: DataFrame) -> DataFrame:
    """The rows that decide: right spines, and what a volume begins with while it may go on with something.

    A container may only go into one whose heading starts alike and lies on a right spine of the title, or into what took
    the one beside it. So from the first one on that starts like neither, nothing of a volume is needed.
    """
    volume = ["title", "year", "volume"]
    ends = items.groupBy(*volume).agg(F.max("path").alias("_end"))
    marked = items.join(F.broadcast(ends) if few_bytes(ends) else ends, volume).withColumn("right", F.slice("_end", 1, F.size("path")) == F.col("path"))
    known = marked.where("right and type = 'item'").select("title", "year", "start").distinct().withColumn("_known", F.lit(True))
    kept = marked.where("type in ('item', 'document')").join(F.broadcast(known) if few_bytes(known) else known, ["title", "year", "start"], "left")
    beside = Window.partitionBy(*volume, "_up").orderBy("path")
    placed = kept.withColumn("_up", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).withColumn("_beside", F.lag("start").over(beside))
    can = (F.col("type") == "document") | F.coalesce("_known", F.lit(False)) | F.coalesce(F.col("_beside") == F.col("start"), F.lit(False))
    so_far = Window.partitionBy(*volume).orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    chosen = placed.withColumn("_chain", F.min(can.cast("int")).over(so_far) == 1)
    return chosen.where("_chain or right").select(*volume, "path", "key", "heading", "start", "n_children", "right", (F.col("_chain") & (F.col("type") == "item")).alias("left"))


def merged_volumes(nodes: DataFrame) -> DataFrame:
    """Nodes of the volumes of regulations as one document per title and year, with keys counted anew in every volume.

    The first container of a volume goes into the one before it if their headings begin with the same two words, and so
    do the ones after it as long as each can. Units take nothing in. Files that could not be parsed stay as rows with
    their errors. A volume occurs once; what is between two nodes' places in a path doesn't count, as gaps stay where
    containers went. No title is ever brought together: see the module.
    """
    name = lambda i: F.regexp_extract("doc_id", r"^cfr(\d+)v(\d+)_(\d+)$", i).cast("int")
    volume = ["title", "year", "volume"]
    start = F.trim(F.lower(F.substring_index("heading", " ", 2)))
    good = nodes.where("error is null").withColumns({"title": name(1), "volume": name(2), "year": name(3)})
    items = good.where("type <> 'subseqitem'").select(*volume, "path", "key", "type", "heading", start.alias("start"), "n_children")
    stitches = materialize(_borders(items).groupBy("title", "year").applyInPandas(_stitch, _STITCHES))

    # what every node's path becomes: the innermost stitch above it decides
    by_volume = stitches.groupBy(*volume).agg(F.array_sort(F.collect_list(F.struct(F.size("old").alias("n"), "old", "new", "shift"))).alias("_stitches"))
    slim = good.select(*volume, "key", "parent_key", "seqitem_key", "path", "level").join(by_volume, volume)
    above = F.filter("_stitches", lambda s: (s["n"] < F.size("path")) & (F.slice("path", 1, s["n"]) == s["old"]))
    gone = F.exists("_stitches", lambda s: s["old"] == F.col("path"))
    stayed = slim.where(~gone).withColumn("_s", F.element_at(above, -1)).drop("_stitches")
    there = F.element_at("path", F.col("_s")["n"] + 1) + F.col("_s")["shift"]
    moved = stayed.withColumn("_path", F.concat(F.col("_s")["new"], F.array(there), F.slice("path", F.col("_s")["n"] + 2, F.greatest(F.size("path") - F.col("_s")["n"] - 1, F.lit(0)))))

    # keys count within a volume, places go on over the volumes of a title
    counted = materialize(moved.withColumn("_n", F.row_number().over(Window.partitionBy(*volume).orderBy("_path"))).drop("_s", "path"))
    sizes = counted.groupBy(*volume).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy("title", "year").orderBy("volume")) - F.col("_size")).drop("_size")
    new_key = F.format_string("cfr%dv%d_%d_%06d", "title", "volume", "year", "_n")
    keyed = counted.withColumn("_key", new_key).join(F.broadcast(before) if few_bytes(before) else before, volume).withColumn("_pos", (F.col("_n") + F.col("_before")).cast("int"))
    top = F.format_string("cfr%dv0_%d_000001", "title", "year")
    names = keyed.select("key", "_key")
    gone_to = stitches.join(items.select(*volume, F.col("path").alias("old"), "key"), [*volume, "old"])
    taken = gone_to.where("target is not null").join(names.withColumnRenamed("key", "target"), "target").select("key", "_key")
    names = materialize(names.unionByName(taken).unionByName(gone_to.where("target is null").select("key", top.alias("_key"))))

    few = few_bytes(names)
    named = lambda rows, column, out: rows.join(F.broadcast(names) if few else names, rows[column] == names["key"], "left").drop(names["key"]).withColumnRenamed("_key", out)
    slim = keyed.select("key", F.col("_key").alias("_own"), "_path", "_pos", "parent_key", "seqitem_key")
    slim = named(named(slim, "parent_key", "_parent"), "seqitem_key", "_unit").drop("parent_key", "seqitem_key")
    gains = stitches.where("target is not null").groupBy(F.col("target").alias("key")).agg(F.sum("more").alias("_more"))
    slim = slim.join(F.broadcast(gains) if few_bytes(gains) else gains, "key", "left")
    # parts that went away from a container that stayed count in what took them
    changed = {"doc_id": F.format_string("cfr%d_%d", "title", "year"), "pos": F.col("_pos"), "key": F.col("_own"), "parent_key": F.col("_parent"), "level": F.size("_path"), "seqitem_key": F.col("_unit"), "path": F.col("_path"), "n_children": (F.col("n_children") + F.coalesce("_more", F.lit(0))).cast("int")}
    rest = good.join(slim, "key").select(*(changed.get(c, F.col(c)).alias(c) for c in nodes.columns))

    fixed = {
        "doc_id": changed["doc_id"], "pos": F.lit(0), "key": top, "parent_key": F.lit(""), "level": F.lit(0), "type": F.lit("document"), "citekey": F.lit(""),
        "heading": F.format_string("Title %d", "title"), "attributes": F.create_map(F.lit("document_type"), F.lit("regulation"), F.lit("title"), F.col("title").cast("string"), F.lit("year"), F.col("year").cast("string")),
        "path": F.array().cast("array<int>"), "texts": F.array().cast("array<string>"), "text_places": F.array().cast("array<int>"), "n_children": F.col("_parts").cast("int"), "citekey_detailed": F.array().cast("array<string>"),
    }
    roots = stitches.where("target is null").groupBy("title", "year").agg(F.sum("more").alias("_parts"))
    documents = roots.select(*(fixed.get(c, F.lit(None)).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns))
    return documents.unionByName(rest).unionByName(nodes.where("error is not null"))
