"""From nested documents to one flat table of nodes.

A format is a function from the bytes of a file to trees of ``Item``; everything else is shared: keys in document
order, parents, levels, paths. The functions run in ``mapInArrow``, one row per file, and files are never
gathered. A node has its own texts only. Its ``path`` holds its place among the parts of its parent, after the places of
its ancestors; so paths sort nodes and texts as the document does, and the nodes below one are those whose paths begin
with its own. Statistics of what is below a node are sums over such beginnings, which the JVM computes.
"""

from __future__ import annotations

import itertools
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import text as tx

NODE_SCHEMA = (
    "doc_id string, pos int, key string, parent_key string, level int, type string, citekey string, heading string, attributes map<string,string>, "
    "seqitem_key string, seqitem_citekey string, path array<int>, texts array<string>, text_places array<int>, n_children int, citekey_detailed array<string>, error string"
)


_ARROW = {"string": pa.string(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
_NAMES = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
_TYPES = [_ARROW[c.split()[1]] for c in NODE_SCHEMA.split(", ")]
_MAP = _NAMES.index("attributes")
#: Rows of nodes that are given back at once.
ROWS = 2_000


@dataclass
class Item:
    """``kind`` is document, item, seqitem or subseqitem; ``parts`` are texts and items in order."""

    kind: str
    heading: str = ""
    citekey: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    parts: Iterable = field(default_factory=list)
    detailed: list[str] = field(default_factory=list)

    def read(self) -> Item:
        """The same with all parts, where a parser reads them when they are asked for."""
        self.parts = [p.read() if isinstance(p, Item) else p for p in self.parts]
        return self

    def items(self) -> Iterator[Item]:
        return (p for p in self.parts if isinstance(p, Item))

    def texts(self) -> list[str]:
        return [p for p in self.parts if isinstance(p, str)]

    def all_texts(self) -> Iterator[str]:
        for p in self.parts:
            if isinstance(p, str):
                yield p
            else:
                yield from p.all_texts()

    def walk(self) -> Iterator[Item]:
        yield self
        for p in self.items():
            yield from p.walk()


def rows(root: Item, doc_id: str, prefix: str, first: int = 1) -> Iterator[tuple]:
    """Node rows, a node's after those below it; keys are ``{prefix}_{counter}`` with six digits in document order.

    Parts are asked for one after the other, and what is above a node is read from it after its last part only. So a
    parser may give parts that it reads when they are asked for.
    """
    count = 0

    def visit(item: Item, parent: str, path: list[int], seqitem: tuple[str | None, str | None]) -> Iterator[tuple]:
        nonlocal count
        pos, key = count, f"{prefix}_{first + count:06d}"
        count += 1
        own = (key, item.citekey or None) if item.kind == "seqitem" else seqitem
        texts, places, n = [], [], 0
        for part in item.parts:
            if isinstance(part, Item):
                yield from visit(part, key, [*path, n], own)
            else:
                texts.append(part)
                places.append(n)
            n += 1
        yield (doc_id, pos, key, parent, len(path), item.kind, item.citekey, item.heading, item.attrs, *own, path, texts, places, n, item.detailed, None)

    return visit(root, "", [], (None, None))


def _waiting(found: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists, once the last one is known to be good; more than one list waits in a temporary file."""
    chunk = list(itertools.islice(found, ROWS))
    if len(chunk) < ROWS:
        return iter([chunk])
    file, lists = tempfile.TemporaryFile(), 0
    try:
        while chunk:
            pickle.dump(chunk, file)
            lists, chunk = lists + 1, list(itertools.islice(found, ROWS))
    except BaseException:
        file.close()
        raise

    def back() -> Iterator[list[tuple]]:
        with file:
            file.seek(0)
            for _ in range(lists):
                yield pickle.load(file)

    return back()


def _batch(held: list[tuple]) -> pa.RecordBatch:
    """Node rows as Arrow, column by column."""
    columns = list(zip(*held, strict=True))
    columns[_MAP] = [m if m is None else list(m.items()) for m in columns[_MAP]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


Parser = Callable[[str, bytes], list[tuple[Item, str, str, int]]]


def shred(files: DataFrame, parse: Parser, path: str = "path", content: str = "content") -> DataFrame:
    """Nodes of every file. ``parse`` gives trees with document id, key prefix and first counter.

    A file that can't be parsed, or is null, gives one row that holds its path and the error, so nothing is lost
    silently and one bad file fails no job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for name, data in zip(*batch.columns, strict=True):
                name, data = name.as_py(), data.as_py()
                try:
                    found = _waiting(r for tree in parse(name or "", bytes(data)) for r in rows(*tree))
                except Exception as e:  # quarantined below, with the reason
                    found = iter([[(name, 0, *[None] * 14, f"{type(e).__name__}: {e}")]])
                for chunk in found:
                    held += chunk
                    if len(held) >= ROWS:  # small files share a batch, a large one has several
                        yield _batch(held)
                        held = []
            if held:
                yield _batch(held)

    return files.select(F.col(path).cast("string").alias("p"), F.col(content).alias("c")).mapInArrow(run, NODE_SCHEMA)


def beginnings(path: Column) -> Column:
    """A path and those of all ancestors, the root's empty one first."""
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda n: F.slice(path, 1, n))


def common_beginning(one: Column, other: Column) -> Column:
    """The path of the innermost node that holds both."""
    equal = F.zip_with(one, other, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(equal, F.lit(False)).cast("int")
    return F.when(first == 0, one).otherwise(F.slice(one, 1, F.greatest(first - 1, F.lit(0))))


def with_statistics(nodes: DataFrame) -> DataFrame:
    """Characters and tokens of what a node holds at any depth, joined by spaces, and of its own texts where it holds texts beside other parts.

    A node's own counts are added to all its ancestors', which is combined before the shuffle. A token counts once a node:
    every occurrence counts, less one at the innermost node that holds it and the last equal token before it, for this
    one and its ancestors. So no text is stored or shuffled once a level. Document ids are unique in ``nodes``. A node without
    any text has zeros, a row with an error nulls.
    """
    total = lambda f: F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + f(t))
    good = nodes.where("error is null").withColumn("_words", F.array_distinct(F.flatten(F.transform("texts", tx.tokens))))
    own = good.select("doc_id", "path", total(tx.chars_n).alias("_c"), F.size("texts").cast("long").alias("_t"), total(tx.chars_nowhites).alias("_b"), total(tx.tokens_n).alias("_n"), F.size("_words").cast("long").alias("_u"))
    words = good.select("doc_id", "path", F.explode("_words").alias("_word"))
    before = F.lag("path").over(Window.partitionBy("doc_id", "_word").orderBy("path"))
    again = words.withColumn("_before", before).where("_before is not null")
    none = F.lit(0).cast("long")
    less = again.select("doc_id", common_beginning(F.col("_before"), F.col("path")).alias("path"), none.alias("_c"), none.alias("_t"), none.alias("_b"), none.alias("_n"), F.lit(-1).cast("long").alias("_u"))
    spread = own.unionByName(less).select("doc_id", F.explode(beginnings(F.col("path"))).alias("path"), "_c", "_t", "_b", "_n", "_u")
    sums = spread.groupBy("doc_id", "path").agg(*(F.sum(c).alias(c) for c in ("_c", "_t", "_b", "_n", "_u")))
    mixed = (F.col("n_children") > 1) & (F.size("texts") > 0)
    return nodes.join(sums, ["doc_id", "path"], "left").select(
        *nodes.columns,
        (F.col("_c") + F.greatest(F.col("_t") - 1, F.lit(0))).alias("chars_n"),
        F.col("_b").alias("chars_nowhites"),
        F.col("_n").alias("tokens_n"),
        F.col("_u").alias("tokens_unique"),
        F.when(mixed, F.transform("texts", lambda t: tx.tokens_n(t).cast("int"))).alias("texts_tokens_n"),
        F.when(mixed, F.transform("texts", lambda t: tx.chars_nowhites(t).cast("int"))).alias("texts_chars_n"),
    )


def text_rows(nodes: DataFrame) -> DataFrame:
    """One row per text: owner's key with its place among the owner's texts, enclosing unit, normalised text."""
    spread = nodes.where("error is null").select("doc_id", "pos", "key", "seqitem_key", "seqitem_citekey", F.posexplode("texts").alias("i", "raw"))
    return spread.select("doc_id", "pos", F.concat_ws("_", "key", F.col("i").cast("string")).alias("text_key"), F.col("key").alias("node_key"), "seqitem_key", F.coalesce("seqitem_citekey", F.lit("")).alias("citekey"), tx.normalise(F.col("raw")).alias("text"))


def lookup_rows(nodes: DataFrame, detailed: bool = False) -> DataFrame:
    """``(key, citekey, doc_id, pos)`` of every node that has a citekey, and of its detailed ones if wanted."""
    own = nodes.where(F.col("citekey") != "").select("key", "citekey", "doc_id", "pos")
    return own.unionByName(nodes.select("key", F.explode("citekey_detailed").alias("citekey"), "doc_id", "pos")) if detailed else own
