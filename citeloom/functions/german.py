"""German citations: areas such as ``§ 6 Abs. 1 Nr. 2 BGB`` in running text and the paths that they name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.joins import few_bytes, fetched
from citeloom.operators.lineage import materialize

# Units of German statutes with the ways they are written, in the order in which they nest.
UNITS = {
    "§": ("§§", "§"),
    "Art": ("Artikeln", "Artikels", "Artikel", "Art."),
    "Abs": ("Absätzen", "Absätze", "Absatzes", "Absatz", "Abs."),
    "Unterabs": ("Unterabsatz", "Unterabs.", "UAbs."),
    "Satz": ("Sätzen", "Sätze", "Satzes", "Satz", "S."),
    "Halbsatz": ("Halbsatz", "Halbs.", "Hs."),
    "Nr": ("Nummern", "Nummer", "Nrn.", "Nr."),
    "Buchst": ("Buchstaben", "Buchstabe", "Buchst.", "lit."),
    "Alt": ("Alternative", "Alt."),
}
_NAMES = {name.lower(): unit for unit, names in UNITS.items() for name in names}
_UNIT = "|".join(re.escape(n) for n in sorted(_NAMES, key=len, reverse=True))
_INNER = "|".join(re.escape(n) for n in sorted(_NAMES, key=len, reverse=True) if _NAMES[n] not in ("§", "Art"))
_VALUE = r"(?:\d+[a-z]{0,2}|[a-z]{1,2}|[IVX]+)(?![\w])"
_LINK = r"(?:\s*,\s*|\s+(?:und|oder|bis|sowie|i\.\s?V\.\s?m\.|in\s+Verbindung\s+mit)\s+)"
_STEP = rf"(?:(?:{_UNIT}|S(?=\s*\d))\s*)?{_VALUE}"
MAIN = re.compile(rf"(?:§§?|\b(?:Artikel[ns]?|Art\.))\s*\d+[a-z]?(?![\w])(?:(?:{_LINK}|\s+)(?:(?:{_INNER}|S(?=\s*\d))\s*{_VALUE}|\d+[a-z]?(?![\w])|(?<=[,\s])[a-z]{{1,2}}(?![\w])))*(?:{_LINK}S(?!\w))?", re.I)
_SUFFIX = re.compile(r"\s*(?:des|der|dieses|dieser)?\s+", re.I)
_STEP_RE = re.compile(rf"\s*,\s*(?-i:S)(?!\w|\s*\d)|\s*(?P<link>,|und\b|oder\b|bis\b|sowie\b)?\s*(?:(?P<unit>{_UNIT}|S(?=\s*\d))\s*)?(?P<value>{_VALUE})", re.I)
_ORDER = list(UNITS)


def parse_main(area: str) -> list[list[tuple[str, str]]]:
    """Paths of ``(unit, value)``: a step with a unit of its own goes below, or beside or above a step of the same unit; one without joins the last unit."""
    paths: list[list[tuple[str, str]]] = []
    path: list[tuple[str, str]] = []
    at = 0
    while at < len(area):
        m = _STEP_RE.match(area, at)
        if not m or m.end() == at:
            break
        at = m.end()
        if m["value"] is None:
            continue
        named = "Satz" if (m["unit"] or "").upper() == "S" else _NAMES.get((m["unit"] or "").lower())
        unit = named or (path[-1][0] if path else "§")
        held = [u for u, _ in path]
        if unit in held:
            paths.append(path)
            path = path[: held.index(unit)]
        elif path and m["link"] and any(_ORDER.index(u) > _ORDER.index(unit) for u in held):
            paths.append(path)
            path = [p for p in path if _ORDER.index(p[0]) < _ORDER.index(unit)]
        path = [*path, (unit, m["value"])]
    return [*paths, path] if path else paths


def simple(paths: list[list[tuple[str, str]]]) -> list[list[str]]:
    return [[value for _, value in path] for path in paths]


#: Names that every dictionary has, stemmed; ordinals of the books of the social code.
CUSTOM_NAMES = {"grundgesetz": "GG"}
BOOKS = ["erst", "zweit", "dritt", "viert", "fünft", "sechst", "siebt", "acht", "neunt", "zehnt", "elft", "zwölft"]
_ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]
_SGB = re.compile(rf"SGB\s+(?P<number>{'|'.join(sorted(_ROMAN, key=len, reverse=True))}|\d{{1,2}})(?!\w)|(?i:(?P<book>{'|'.join(BOOKS)})(?:e[snr]?)\s+Buch(?:e?s)?(?:\s+\(?Sozialgesetzbuch(?:e?s)?\)?))")
# a word that looks like the name of a law behind "des" or "der"
_UNKNOWN = re.compile(r"(?:[A-ZÄÖÜ][\w\-]*\s+){0,3}?[A-ZÄÖÜ]?[\w\-]*(?:gesetz(?:es|buch(?:e?s)?)?|ordnung|satzung|richtlinie|abkommens?|vertrag(?:e?s)?)(?!\w)", re.I)
#: Characters of names that are sent to the workers at most.
MAX_NAMES = 32_000_000
_WORD = re.compile(r"[\w\-]+")
#: Texts of a group that one worker reads with the names of the group.
TILE_TEXTS = 20_000


class LawNames:
    """Names of laws by stem, as an automaton over stemmed words (Aho and Corasick 1975): a text is read once for all names.

    A node has the words that lead on from it, the node of the longest start of a name that its own words end with, and
    how many words the names have that end in it.
    """

    def __init__(self, names: dict[str, str]):
        self.names = {**{k: v for k, v in names.items() if k}, **CUSTOM_NAMES}
        self.next: list[dict[str, int]] = [{}]
        self.back, self.ends = [0], [0]
        for name in self.names:
            node = 0
            words = _WORD.findall(name)
            for word in words:
                if word not in self.next[node]:
                    self.next[node][word] = len(self.next)
                    self.next.append({})
                    self.back.append(0)
                    self.ends.append(0)
                node = self.next[node][word]
            self.ends[node] = len(words)
        queue = list(self.next[0].values())
        for node in queue:
            for word, to in self.next[node].items():
                at = self.back[node]
                while at and word not in self.next[at]:
                    at = self.back[at]
                self.back[to] = self.next[at].get(word, 0)
                queue.append(to)

    def at(self, text: str, begin: int) -> tuple[int, str] | None:
        """End and citekey of the longest name that begins here."""
        node, ends = 0, []
        for m in _WORD.finditer(text, begin):
            node = self.next[node].get(stem(m[0]))
            if node is None:
                break
            if self.ends[node]:
                ends.append(m.end())
        for end in reversed(ends):
            found = self.names.get(stem(text[begin:end]))
            if found:
                return end, found
        return None

    def within(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, citekey)`` of names in the text that don't overlap, the leftmost first and the longest of these."""
        node, words, found = 0, [], []
        for m in _WORD.finditer(text):
            words.append(m)
            word = stem(m[0])
            while node and word not in self.next[node]:
                node = self.back[node]
            node = self.next[node].get(word, 0)
            at = node
            while at:
                if self.ends[at]:
                    start = words[-self.ends[at]].start()
                    key = self.names.get(stem(text[start : m.end()]))
                    if key:
                        found.append((start, -m.end(), key))
                at = self.back[at]
        out: list[tuple[int, int, str]] = []
        for start, end, key in sorted(found):
            if not out or start >= out[-1][1]:
                out.append((start, -end, key))
        return out


def stem(name: str) -> str:
    """As ``text.law_name_stem``."""
    return re.sub(r"(?<=\w{3})(?:es|en|er|em|e|s|n)\b", "", re.sub(r"\s+", " ", name).strip().lower())


def areas(text: str | None, laws: LawNames, own_law: str | None, paragraphs: bool = True, articles: bool = True) -> list[dict]:
    """Citations with main area, suffix, law name, kind and parsed paths.

    Kinds: ``dict`` with a known law name behind it, ``sgb`` with a book of the social code, ``unknown`` with the name of a
    law that isn't known, ``internal`` with none, ``ignore`` if the own document has no heading of the cited kind, so
    that an internal citation can't be meant. The law's citekey goes in front of the paths of dict, sgb and internal.
    """
    out = []
    for m in MAIN.finditer(text or ""):
        suffix = _SUFFIX.match(text, m.end())
        law = laws.at(text, suffix.end()) if suffix else None
        kind, end, key = "internal", m.end(), own_law
        book = _SGB.match(text, suffix.end()) if suffix and not law else None
        other = _UNKNOWN.match(text, suffix.end()) if suffix and suffix[0].strip() and not law and not book else None
        if law:
            kind, end, key = "dict", law[0], law[1]
        elif book:
            number = book["number"]
            place = BOOKS.index(book["book"].lower()) + 1 if book["book"] else _ROMAN.index(number) + 1 if number in _ROMAN else int(number)
            kind, end, key = "sgb", book.end(), f"SGB-{place}"
        elif other:
            kind, end, key = "unknown", other.end(), None
        elif not (paragraphs if m[0].startswith("§") else articles):
            kind, key = "ignore", None
        paths = simple(parse_main(m[0]))
        if kind not in ("ignore", "unknown") and key:
            paths = [[key, *p] for p in paths]
        named = kind in ("dict", "sgb", "unknown")
        out.append({"start": m.start(), "end": end, "main": m[0], "suffix": text[m.end() : suffix.end()] if named else "", "lawname": text[suffix.end() : end] if named else "", "law_type": kind, "parsed": paths})
    return out


_AREA = "array<struct<start:int,end:int,main:string,suffix:string,lawname:string,law_type:string,parsed:array<array<string>>>>"


def find_citations(df: DataFrame, names: dict[str, str], text: str = "text", own_law: Column | None = None, paragraphs: Column | None = None, articles: Column | None = None) -> DataFrame:
    """One row per citation with all columns of ``df``. ``names`` maps stemmed law names to citekeys, a dictionary of
    laws in force, bounded by the number of laws. Null texts have none."""
    shared = df.sparkSession.sparkContext.broadcast(checked(names))

    @F.pandas_udf(_AREA)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        laws = LawNames(shared.value)
        for texts, own, para, art in batches:
            yield pd.Series([areas(*row[:1], laws, *row[1:]) for row in zip(texts, own, para, art, strict=True)], dtype="object")

    given = [F.lit(None).cast("string") if own_law is None else own_law, F.lit(True) if paragraphs is None else paragraphs, F.lit(True) if articles is None else articles]
    return df.select("*", F.posexplode(run(F.col(f"`{text}`"), *given)).alias("ref_pos", "_ref")).select(*(F.col(f"`{c}`") for c in df.columns), "ref_pos", "_ref.*")


def find_citations_by(df: DataFrame, names: DataFrame, group: str, text: str = "text", tile_texts: int = TILE_TEXTS) -> DataFrame:
    """One row per citation with all columns of the written ``df``: those of a ``group`` by its own ``names(group, name, citekey)``.

    Of several citekeys of a name the largest counts. Neither dates nor names are limited and none is broadcast, only the groups' numbers of tiles are if they are few: a group's
    texts are dealt into tiles of about ``tile_texts``, so that a large group goes over many tasks; its names go once to
    every tile, come first there by the sort and become its automaton. Citations without a name are ignored. Null texts
    have none, nor has a null group; groups without texts cost nothing, those without names know the custom ones only.
    """
    own = ["ref_pos", "start", "end", "main", "suffix", "lawname", "law_type", "parsed"]
    kept = [c for c in df.columns if c not in own]
    tiles = materialize(df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count(F.lit(1)) / tile_texts).alias("_n")))
    few = few_bytes(tiles)  # then texts move by group and tile only, never all of a group to one task
    row = F.struct(*(F.col(f"`{c}`") for c in kept))
    # drawn on the written rows, so that a task that runs again deals them alike
    drawn = df.select(F.col(group).alias("_g"), F.rand(1).alias("_at"), F.lit(None).cast("string").alias("_name"), F.lit(None).cast("string").alias("_key"), F.col(f"`{text}`").alias("_text"), row.alias("_row"))
    texts = fetched(drawn, tiles, "_g", few).select("_g", F.floor(F.col("_at") * F.col("_n")).alias("_tile"), "_name", "_key", "_text", "_row")
    known = names.where("name <> '' and citekey is not null").groupBy(F.col(group).alias("_g"), F.col("name").alias("_name")).agg(F.max("citekey").alias("_key"))
    known = fetched(known, tiles, "_g", few).select("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_tile"), "_name", "_key")
    rows = known.unionByName(texts, allowMissingColumns=True).select(*texts.columns).repartition("_g", "_tile").sortWithinPartitions("_g", "_tile", F.col("_name").isNull())
    area = df.select(F.lit(None).cast(_AREA).alias("a")).schema["a"].dataType.elementType
    schema = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("ref_pos", T.IntegerType()), *area.fields])
    ref = pa.struct([("start", pa.int32()), ("end", pa.int32()), *((c, pa.string()) for c in own[3:7]), ("parsed", pa.list_(pa.list_(pa.string())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, given, laws = None, {}, None
        for batch in batches:
            at, pos, refs = [], [], []
            for i, (g, tile, name, key, t) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)):
                if group != (g, tile):
                    group, given, laws = (g, tile), {}, None
                if name is not None:
                    given[name] = key
                    continue
                laws = laws or LawNames(given)
                found = areas(t, laws, None, False, False)
                at += [i] * len(found)
                pos += range(len(found))
                refs += found
            cited = pa.array(refs, ref)
            yield pa.RecordBatch.from_arrays([batch.column(5).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), *cited.flatten()], names=["_row", "ref_pos", *own[1:]])

    return rows.mapInArrow(run, schema).select("_row.*", *own)


def checked(names: dict[str, str]) -> dict[str, str]:
    """The names, if they are few enough to be sent to all workers."""
    if sum(len(k) + len(v or "") for k, v in names.items()) > MAX_NAMES:
        raise ValueError(f"names of laws have more than {MAX_NAMES} characters")
    return names


def find_mentions(df: DataFrame, names: dict[str, str], text: str = "text") -> DataFrame:
    """One row per law that a text names without citing a part of it: all columns of ``df``, ``ref_pos, start, end, lawname, citekey``.

    Names inside of citations are theirs. Null texts name none.
    """
    shared = df.sparkSession.sparkContext.broadcast(checked(names))

    @F.pandas_udf("array<struct<start:int,end:int,lawname:string,citekey:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        laws = LawNames(shared.value)
        for texts in batches:
            out = []
            for t in texts:
                cited = [(a["start"], a["end"]) for a in areas(t, laws, None)]
                free = [x for x in laws.within(t or "") if not any(x[0] < e and s < x[1] for s, e in cited)]
                out.append([{"start": s, "end": e, "lawname": t[s:e], "citekey": key} for s, e, key in free])
            yield pd.Series(out, dtype="object")

    return df.select("*", F.posexplode(run(F.col(f"`{text}`"))).alias("ref_pos", "_ref")).select(*(F.col(f"`{c}`") for c in df.columns), "ref_pos", "_ref.*")


def section_path(text: Column) -> Column:
    """The first path that a section's name such as ``§ 12 Abs. 1`` is; empty without one."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([(simple(parse_main(m[0])) or [[]])[0] if v and (m := MAIN.match(v)) else [] for v in values], dtype="object")

    return run(text)
