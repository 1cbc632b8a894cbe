"""From nodes to the citation network of a snapshot, and the pipeline's steps in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import citations, german
from citeloom.functions import text as tx
from citeloom.operators import graph, lookup, ordered, temporal
from citeloom.operators.lineage import materialize
from citeloom.sources import tree


def references(nodes: DataFrame, code: bool | None = None) -> DataFrame:
    """One row per path that a text cites: ``ref_id, seqitem_key, node_key, path``. The own code is that of the document's key."""
    texts = nodes.where("error is null").select("doc_id", "key", "seqitem_key", F.posexplode("texts").alias("i", "text"))
    title = citations.own_title(F.col("doc_id"))
    regulations = F.col("doc_id").startswith("cfr")

    def cited(part: DataFrame, is_code: bool) -> DataFrame:
        return citations.find_citations(part, title=title, code=is_code)

    found = cited(texts, code) if code is not None else cited(texts.where(~regulations), True).unionByName(cited(texts.where(regulations), False))
    spread = found.select("key", "seqitem_key", "i", "ref_pos", F.posexplode("parsed").alias("p", "path"))
    return spread.select(F.concat_ws("/", "key", "i", "ref_pos", "p").alias("ref_id"), "seqitem_key", F.col("key").alias("node_key"), "path")


def authorities(nodes: DataFrame) -> DataFrame:
    """``(ref_id, node_key, path)`` of authority notes."""
    noted = nodes.where(F.col("attributes")["auth_text"].isNotNull())
    spread = noted.select("key", F.posexplode(citations.authorities(F.col("attributes")["auth_text"])).alias("p", "path"))
    return spread.select(F.concat_ws("/", "key", F.col("p").cast("string")).alias("ref_id"), F.col("key").alias("node_key"), "path")


def citation_network(nodes: DataFrame, detailed: bool = False) -> dict[str, DataFrame]:
    """``nodes`` and ``edges`` of a snapshot: containment, references resolved by their longest prefix, authorities by two components."""
    known = lookup.first_wins(tree.lookup_rows(nodes, detailed), "citekey", "key", ["doc_id", "pos"])
    refs = references(nodes)
    source = "node_key" if detailed else "seqitem_key"
    hits = lookup.resolve_longest(refs.where(F.col(source).isNotNull()), known, "path", ["ref_id", source])
    notes = lookup.resolve_fixed(authorities(nodes), known, "path", ["ref_id", "node_key"])
    edges = graph.snapshot_edges(graph.containment_edges(nodes), graph.typed_edges(hits, source, "key", "reference"), graph.typed_edges(notes, "node_key", "key", "authority"))
    return {"nodes": graph.export_nodes(tree.with_statistics(nodes)), "edges": edges}


def alignment_index(nodes: DataFrame) -> DataFrame:
    """``(pos, key, citekey, text)`` of a snapshot in the order of files and documents, as alignment takes it."""
    texts = tree.text_rows(nodes).select("doc_id", "pos", F.length("text_key").alias("_n"), F.col("text_key").alias("key"), "citekey", "text")
    placed = ordered.places(texts.withColumnRenamed("pos", "_pos"), ["doc_id", "_pos", "_n", "key"], "pos")
    return placed.select((F.col("pos") - 1).alias("pos"), "key", "citekey", "text")


def law_titles(nodes: DataFrame) -> DataFrame:
    """``(name, citekey, doc_id)``: headings and abbreviations of documents as they are."""
    a = F.col("attributes")
    named = nodes.where("level = 0").select("doc_id", F.explode(F.array(F.col("heading"), a["heading_short"], a["abbr_1"], a["abbr_2"])).alias("name"), tx.key_prefix(a["abbr_1"]).alias("citekey"))
    return named.where("name is not null and name <> ''").select("name", "citekey", "doc_id")


def law_names(nodes: DataFrame) -> DataFrame:
    """``(name, citekey, doc_id)``: stemmed headings and abbreviations of documents."""
    return law_titles(nodes).select(tx.law_name_stem(F.col("name")).alias("name"), "citekey", "doc_id").distinct()


def heading_kinds(nodes: DataFrame) -> DataFrame:
    """Units per document whose heading begins with §, with Art, or otherwise."""
    h = F.lower(F.coalesce("heading", F.lit("")))
    kind = F.when(h.startswith("§"), "para").when(h.startswith("art"), "art").otherwise("misc")
    return nodes.where("type = 'seqitem'").groupBy("doc_id").agg(*(F.count_if(kind == k).alias(k) for k in ("para", "art", "misc")))


def german_references(nodes: DataFrame, names: dict[str, str]) -> DataFrame:
    """Reference edges of German statutes: citations of known laws and internal ones, resolved by law and section."""
    kinds = heading_kinds(nodes).select("doc_id", (F.col("para") > 0).alias("has_para"), (F.col("art") > 0).alias("has_art"))
    own = nodes.where("level = 0").select("doc_id", tx.key_prefix(F.col("attributes")["abbr_1"]).alias("own"))
    texts = nodes.where("error is null").select("doc_id", "key", "seqitem_key", F.posexplode("texts").alias("i", "text")).join(own, "doc_id").join(kinds, "doc_id")
    found = german.find_citations(texts, names, own_law=F.col("own"), paragraphs=F.col("has_para"), articles=F.col("has_art"))
    spread = found.where(F.col("law_type").isin("dict", "sgb", "internal")).select("key", "seqitem_key", "i", "ref_pos", F.posexplode("parsed").alias("p", "path"))
    refs = spread.where("seqitem_key is not null").select(F.concat_ws("/", "key", "i", "ref_pos", "p").alias("ref_id"), "seqitem_key", "path")
    known = lookup.first_wins(tree.lookup_rows(nodes), "citekey", "key", ["doc_id", "pos"])
    return graph.typed_edges(lookup.resolve_fixed(refs, known, "path", ["ref_id", "seqitem_key"]), "seqitem_key", "key", "reference")


def decision_citations(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Citations of decisions: ``key, part`` (text or norm) and the columns of ``german.find_citations_by``.

    ``names(since, name, citekey)`` are stemmed names of laws from a date on; each decision takes those of the latest date
    at or before its own. Citations without a law's name are ignored, as a decision has no sections of its own. A decision
    before the first date, or without a date, is an error. All dates go in one pass over the texts.
    """
    day = nodes.where("level = 0").select("doc_id", tx.compact_date(F.col("attributes")["datum"]).alias("day"))
    texts = nodes.where("error is null").select("doc_id", "key", F.lit("text").alias("part"), F.explode("texts").alias("text"))
    norms = nodes.where("level = 0").select("doc_id", "key", F.lit("norm").alias("part"), F.col("attributes")["norm"].alias("text")).where("text is not null")
    # different days and dates only
    every = F.lit(0).alias("all")
    latest = temporal.as_of(day.select(every, "day").distinct(), names.select(every, "since").distinct(), "all", "day", "since", ["since"])
    since = F.coalesce(F.col("since"), F.raise_error(F.concat(F.lit("no names of laws at "), F.coalesce("day", F.lit("no date")))))
    dated = day.join(latest.select(F.col("day").alias("_day"), "since"), F.col("day").eqNullSafe(F.col("_day"))).select("doc_id", "day", since.alias("since"))
    return german.find_citations_by(materialize(texts.unionByName(norms).join(dated, "doc_id")), names, "since")


# Types of entries that name the laws which empower another.
EMPOWERING = ["Ermächtigung", "Rechtsgrundlage", "Durchführungsvorschrift"]


def entry_references(laws: DataFrame, key: str, entries: str, names: DataFrame) -> DataFrame:
    """``key, path`` of the laws that the entries (JSON of type, section and name) of a law name; repeats of a law go.

    Only empowering types with a name count; names meet ``names(name, citekey)`` by their stems, the last of equals.
    """
    spread = laws.select(key, F.explode(F.from_json(entries, "array<struct<typ:string,enbez:string,normabk:string>>")).alias("e"))
    wanted = spread.where(F.col("e.typ").isin(EMPOWERING) & F.col("e.normabk").isNotNull()).select(key, tx.law_name_stem(F.col("e.normabk")).alias("stem"), german.section_path(F.col("e.enbez")).alias("section"))
    known = lookup.last_wins(names.select(tx.law_name_stem(F.col("name")).alias("stem"), "citekey"), "stem", "citekey", ["citekey"])
    # entries are small as stored and many times that as rows, so their size is no reason to broadcast them
    return known.join(wanted.hint("shuffle_merge"), "stem").select(key, F.concat(F.array("citekey"), "section").alias("path")).distinct()


def german_authorities(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Authority edges of German regulations: ``entries(key, entries)`` of their root nodes, the JSON that ``entry_references`` takes.

    A law that is named alone stands for its root node, a section of it for its unit; names and sections that no
    document of the snapshot has give no edge. Names are the headings and abbreviations of the snapshot; where several
    laws have one, the largest citekey counts, and of several documents of a citekey the last one.
    """
    refs = entry_references(entries, "key", "entries", law_titles(nodes)).select(F.col("key").alias("node_key"), "path")
    roots = nodes.where("level = 0").select("doc_id", "key", tx.key_prefix(F.col("attributes")["abbr_1"]).alias("citekey"))
    known = lookup.first_wins(tree.lookup_rows(nodes), "citekey", "key", ["doc_id", "pos"])
    found = lookup.resolve_authority(refs, known, lookup.last_wins(roots, "citekey", "key", ["doc_id"]), "path", ["node_key"])
    return graph.typed_edges(found, "node_key", "key", "authority")
