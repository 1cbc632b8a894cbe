import io
import zipfile

import pytest
from pyspark.sql import functions as F

from citeloom.operators import graph
from citeloom.plans import statutes
from citeloom.sources import files, formats, tree

GERMAN = """<dokumente><norm><metadaten><jurabk>Test G</jurabk><langue>Testgesetz</langue><juris><normgeber>Bund</normgeber><sachgebiete>FNA 1</sachgebiete><sachgebiete>x</sachgebiete></juris></metadaten><textdaten/></norm>
<norm><metadaten><gliederungseinheit><gliederungskennzahl>010</gliederungskennzahl><gliederungsbez>Teil 1</gliederungsbez><gliederungstitel>Anfang</gliederungstitel></gliederungseinheit></metadaten></norm>
<norm><metadaten><enbez>§ 1</enbez></metadaten><textdaten><text><Content><P>(1) Dies gilt nach § 2 Abs. 1.</P><P>(2) Mehr Text hier.</P><P>(weggefallen)</P></Content></text></textdaten></norm>
<norm><metadaten><enbez>§ 2</enbez></metadaten><textdaten><text><Content><P>Nur ein Absatz steht hier.</P></Content></text></textdaten></norm>
<norm><metadaten><enbez>Anlage 1</enbez></metadaten><textdaten><text><Content><P>Was hier steht, bleibt weg.</P></Content></text></textdaten></norm></dokumente>"""
REGULATION = """<CFRDOC><TITLE><HD>Title 7</HD><CHAPTER><HD>Chapter I</HD><AUTH><P>42 U.S.C. 7401; 5 U.S.C. 301</P></AUTH><SECTION><SECTNO>§ 1.1</SECTNO><SUBJECT>Scope.</SUBJECT><P>(a)(1) First, see section 1.2.</P><P>(2) Second.</P><P>(b) Third.</P></SECTION>
<SECTION><SECTNO>§ 1.2</SECTNO><SUBJECT>Terms.</SUBJECT><P>One text under 42 U.S.C. 7401(a).</P></SECTION></CHAPTER></TITLE></CFRDOC>"""
CODE = """<html><body><div><!-- documentid:42_1 --><!-- expcite:TITLE 42-HEALTH!@!CHAPTER 1 --><!-- itempath:/420/CHAPTER 1 --><!-- itemsortkey:1 --><!-- field-start:head --><h3 class="chapter-head">Chapter 1</h3><!-- field-end:head -->
<!-- documentid:42_2 --><!-- expcite:TITLE 42-HEALTH!@!CHAPTER 1!@!Sec. 7401 --><!-- itempath:/420/CHAPTER 1/Sec. 7401 --><!-- itemsortkey:2 --><!-- field-start:statute --><h4 class="subsection-head">(a) Findings</h4><p class="statutory-body">(a)(1) The text, see section 7402 of this title.</p><!-- field-end:statute -->
<!-- documentid:42_3 --><!-- expcite:TITLE 42-HEALTH!@!CHAPTER 1!@!Sec. 7402 --><!-- itempath:/420/CHAPTER 1/Sec. 7402 --><!-- itemsortkey:3 --><!-- field-start:statute --><p class="statutory-body">Only this.</p><!-- field-end:statute --></div></body></html>"""
DECISION = """<dokument><gertyp>BGH</gertyp><entsch-datum>20200131</entsch-datum><aktenzeichen>I ZR 1/20</aktenzeichen><doktyp>Urteil</doktyp><spruchkoerper>1. Senat</spruchkoerper><norm>§ 1 BGB</norm>
<gruende><dl><dt>1</dt><dd><p style="margin-left:1">A. Zum Recht</p></dd></dl><dl><dt>2</dt><dd><p>Nach § 5 gilt das.</p></dd></dl><dl><dt/><dd><p style="margin-left:1">geht weiter</p></dd></dl></gruende></dokument>"""


def shape(item):
    return (item.kind, item.heading, item.citekey, [p if isinstance(p, str) else shape(p) for p in item.parts])


def test_german_statute():
    (root, doc_id, prefix, first), *_ = formats.german_statute("x/BJNR1_20000101_99991231.xml", GERMAN.encode())
    assert (doc_id, prefix, first) == ("BJNR1_Test-G_20000101_99991231", "BJNR1_Test-G_99991231", 1)
    unit = ("seqitem", "§ 1", "Test-G_1", [("subseqitem", "", "", ["(1) Dies gilt nach § 2 Abs. 1."]), ("subseqitem", "", "", ["(2) Mehr Text hier."])])
    assert shape(root) == ("document", "Testgesetz", "", [("item", "Teil 1 Anfang", "", [unit, ("seqitem", "§ 2", "Test-G_2", ["Nur ein Absatz steht hier."])])])
    assert root.attrs["sachgebiete"] == "FNA 1"


def test_regulation():
    (root, key, prefix, _), *_ = formats.regulation("/d/CFR-2000-title7-vol1.xml", REGULATION.encode())
    assert key == prefix == "cfr7v1_2000" and root.heading == "Title 7"
    first = root.parts[0].parts[0]
    assert shape(first) == ("seqitem", "§ 1.1 Scope.", "cfr7_1.1", [("subseqitem", "", "", ["(a)", ("subseqitem", "", "", ["(1) First, see section 1.2."]), ("subseqitem", "", "", ["(2) Second."])]), ("subseqitem", "", "", ["(b) Third."])])
    assert root.parts[0].attrs["auth_text"].startswith("42 U.S.C.")
    assert formats.split_units([["(a)(1) sdf"], ["(a)(2) asdasd"], [["x", "y"]]]) == [["(a)"], ["(1) sdf"], ["(2) asdasd"], [["x", "y"]]]
    both = (formats._LETTER, formats._ROMAN)
    assert [k for k, _ in formats.disambiguate([(formats._LETTER, "h"), (both, "i"), (formats._LETTER, "j")])] == [formats._LETTER] * 3
    assert [k for k, _ in formats.disambiguate([(formats._LETTER, "a"), (both, "i"), (both, "ii")])] == [formats._LETTER, formats._ROMAN, formats._ROMAN]


def test_us_code():
    (root, doc_id, prefix, _), *_ = formats.us_code("420_2010.htm", CODE.encode())
    assert (doc_id, prefix, root.heading) == ("420_2010", "420_2010", "TITLE 42-HEALTH")
    chapter = root.parts[0]
    assert [c.citekey for c in chapter.items()] == ["42_7401", "42_7402"]
    assert chapter.parts[1].parts == ["Only this."]
    assert [d for i in chapter.walk() for d in i.detailed] == ["42_7401_a", "42_7401_a_1"]


def test_decision():
    (doc, *_), *_ = formats.decision("J1.xml", DECISION.encode())
    assert doc.attrs["datum"] == "2020-01-31" and doc.attrs["norm"] == "§ 1 BGB"
    assert shape(doc.parts[0]) == ("item", "gruende", "", [("item", "A", "", [("seqitem", "", "", ["A. Zum Recht"]), ("seqitem", "", "", ["Nach § 5 gilt das. geht weiter"])])])


def test_shred_and_network(spark, tmp_path):
    (tmp_path / "CFR-2000-title7-vol1.xml").write_text(REGULATION)
    (tmp_path / "CFR-2000-title8-vol1.xml").write_text("<broken")
    (tmp_path / "420_2000.htm").write_text(CODE)
    nodes = tree.shred(files.scan(spark, str(tmp_path)), formats.regulation).unionByName(tree.shred(files.scan(spark, str(tmp_path), ".htm"), formats.us_code)).cache()
    assert [r["error"][:10] for r in nodes.where("error is not null").collect()] == ["ParseError"]
    out = statutes.citation_network(nodes)
    edges = {(r["u"], r["v"], r["edge_type"]) for r in out["edges"].collect()}
    keys = {r["citekey"]: r["key"] for r in nodes.where("citekey <> ''").collect()}
    assert (keys["cfr7_1.2"], keys["42_7401"], "reference") in edges
    assert (keys["42_7401"], keys["42_7402"], "reference") in edges
    assert (keys["cfr7_1.1"], keys["cfr7_1.2"], "reference") in edges
    assert any(k == "authority" and v == keys["42_7401"] for _, v, k in edges)
    exported = out["nodes"].collect()
    assert len(exported) == nodes.where("error is null").count() + 1 and exported[0].asDict().keys() == set(graph.NODE_COLUMNS)
    stats = {r["key"]: r for r in tree.with_statistics(nodes).collect()}
    assert stats[keys["42_7402"]]["tokens_n"] == 2 and stats[keys["42_7402"]]["chars_nowhites"] == 9
    files.write_xml(nodes, str(tmp_path / "xml"))
    back = spark.read.text(str(tmp_path / "xml")).collect()
    again = [formats.structural("x", r[0].encode())[0][0] for r in back]
    assert sum(len(list(i.walk())) for i in again) == nodes.where("error is null").count()


def test_archives_and_increments(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/x.xml", "<a/>")
        z.writestr("a/y.txt", "no")
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    found = files.unzip(files.scan(spark, str(tmp_path), ".zip"), ".xml").collect()
    assert [(r["path"].rsplit("!", 1)[1], bytes(r["content"])) for r in found] == [("a/x.xml", b"<a/>")]
    ids = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r[0] for r in files.pending(ids, spark.createDataFrame([("a",)], "k string"), "k").collect()] == ["b"]
    files.write_log(spark.createDataFrame([("b",), ("A",), ("C",)], "l string"), "l", str(tmp_path / "log"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["A", "b", "C"]


def test_stream_of_files(spark, tmp_path):
    from citeloom.streaming import incremental

    (tmp_path / "in").mkdir()
    step = lambda batch: tree.shred(batch, formats.regulation)
    for year in (2000, 2001):
        (tmp_path / "in" / f"CFR-{year}-title7-vol1.xml").write_text(REGULATION)
        incremental.run_step(incremental.watch(spark, str(tmp_path / "in")), step, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id").collect()} == {"cfr7v1_2000", "cfr7v1_2001"}


def test_unknown_classes_are_an_error_and_known_ones_lose_no_text():
    page = CODE.replace("Only this.</p>", "Only this.</p><p class='note-body-1em'>A note.</p><p class='signature'>Signed.</p><h4 class='italic-head'>passed over</h4>")
    (root, *_), *_ = formats.us_code("420_2010.htm", page.encode())
    assert [t for t in root.all_texts()][-3:] == ["Only this.", "A note.", "Signed."]
    with pytest.raises(ValueError, match="unheard"):
        formats.us_code("420_2010.htm", page.replace("note-body-1em", "unheard").encode())


def test_ancestors_of_deep_trees(spark):
    chain = spark.createDataFrame([(f"k{i}", f"k{i - 1}" if i else "", i) for i in range(36)], "key string, parent_key string, level int")
    assert graph.ancestors(chain).count() == 36 * 37 // 2
    with pytest.raises(ValueError, match="own ancestor"):
        graph.ancestors(spark.createDataFrame([("a", "b", 0), ("b", "a", 1)], "key string, parent_key string, level int"))


def test_simplified():
    page = "<dokumente builddate='1'><norm><metadaten><titel>Law *)</titel><fundstelle>x</fundstelle></metadaten><textdaten><text><Content><P>one<BR/>two <FnR ID='1'/>three</P><TOC><a>x</a><b>y</b></TOC></Content></text><Footnotes>f</Footnotes></textdaten></norm></dokumente>"
    out = formats.simplified(page.encode()).decode()
    assert out == "<dokumente><norm><metadaten><titel>Law</titel></metadaten><textdaten><text><Content><P>one two three</P><TOC>x y</TOC></Content></text></textdaten></norm></dokumente>"


def test_a_volume_is_never_held_whole():
    """The memory of a volume's nodes doesn't grow with it, and one that can't be parsed at its end gives no nodes."""
    import tracemalloc

    section = "<SECTION><SECTNO>§ 1.1</SECTNO><SUBJECT>Scope</SUBJECT><P>(a) First.</P><P>(b) Second.</P></SECTION>"
    path = "/d/CFR-2000-title7-vol1.xml"
    page = lambda n, end="": f"<CFRDOC><TITLE><CHAPTER>{section * n}{end}<HD>Last</HD></CHAPTER></TITLE></CFRDOC>".encode()

    def peak(n):
        data = page(n)
        tracemalloc.start()
        count = sum(len(chunk) for chunk in tree._waiting(r for found in formats.volume(path, data) for r in tree.rows(*found)))
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert count == 2 + 3 * n
        return most

    assert peak(12_000) < 1.5 * peak(3_000)
    (root, *_), *_ = formats.regulation(path, page(2))
    whole = sorted(tree.rows(root, "d", "k"), key=lambda r: r[1])
    (lazy, *_), *_ = formats.volume(path, page(2))
    assert sorted(tree.rows(lazy, "d", "k"), key=lambda r: r[1]) == whole and [r[7] for r in whole][:2] == ["TITLE", "Last"]
    with pytest.raises(ValueError, match="tag BAD"):
        tree._waiting(r for found in formats.volume(path, page(3_000, "<SECTION><BAD/></SECTION>")) for r in tree.rows(*found))


def test_small_rows_that_cost_much_are_dealt(spark, sf):
    """One small file of a table makes work for all cores: documents are made and read over several tasks a core."""
    from citeloom.plans import documents

    assert documents.decision_files(spark, sf).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert documents.regulation_files(spark, sf).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism


def test_the_simplified_tree_is_what_is_read_back():
    """A German statute is parsed once: the tree is the one that the simplified bytes give, returns that references stand for included."""
    import xml.etree.ElementTree as ET

    p = "<P>one&#13;two<BR/>three &amp; <b a='x&#10;y'>four</b></P>"
    for text in ("a", "a&#13;&#10;b", "ä &lt;"):
        page = f"<dokumente><norm><metadaten><jurabk>{text}</jurabk><enbez>(XXXX)</enbez></metadaten><textdaten><text><Content>{p}<DL><DT>1</DT><DD>{text}</DD></DL></Content></text></textdaten></norm></dokumente>".encode()
        assert ET.tostring(formats.simplified_tree(page)) == ET.tostring(ET.fromstring(formats.simplified(page)))
        assert [list(tree.rows(*t)) for t in formats.german_statute("/d/BJNR1_a_b.xml", formats.simplified_tree(page))] == [list(tree.rows(*t)) for t in formats.german_statute("/d/BJNR1_a_b.xml", formats.simplified(page))]


def test_entries_of_laws_are_not_broadcast(spark, sf):
    """Entries are made from a number a row, so they look small and grow with the laws; both sides are shuffled, and entries are parsed over several tasks."""
    from citeloom.plans import documents, statutes

    few = spark.range(3).select(F.concat(F.lit("k"), "id").alias("key"), F.to_json(F.array(F.struct(F.lit("Rechtsgrundlage").alias("typ"), F.concat(F.lit("§ "), "id").alias("enbez"), F.lit("Gesetz").alias("normabk")))).alias("entries"))
    names = spark.createDataFrame([("Gesetz", "G")], "name string, citekey string")
    found = statutes.entry_references(few, "key", "entries", names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted(tuple(r["path"]) for r in found.collect()) == [("G", "0"), ("G", "1"), ("G", "2")]
    assert documents.german_authority_edges(spark, sf).count() > 0
