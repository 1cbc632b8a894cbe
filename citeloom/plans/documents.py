"""Queries over documents of the five formats, which are written from the tables and shredded again.

Every builder makes ``(path, content)`` files by column functions; the SQL beside a query says what nodes must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import citations, german
from citeloom.functions import text as tx
from citeloom.operators import graph, lookup
from citeloom.operators.lineage import dealt, materialize, new_path
from citeloom.plans import statutes, volumes
from citeloom.plans.base import query, table
from citeloom.sources import archives, files, formats, tree


def bundle(rows: DataFrame, by: str, order: list[str], piece: str, head: str, tail: str, path: str) -> DataFrame:
    """One file per ``by`` of pieces in order; ``head``, ``piece``, ``tail`` and ``path`` are SQL expressions. Files are as large as a group."""
    made = rows.select(F.col(by), F.struct(*order).alias("o"), F.expr(piece).alias("x"), F.expr(head).alias("h"), F.expr(tail).alias("t"), F.expr(path).alias("path"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]), "")
    # many tasks, as a few files are dealt unevenly and are read where they are made
    return dealt(made, "path", tasks=8).groupBy("path").agg(F.first("h").alias("h"), body.alias("b"), F.first("t").alias("t")).select("path", F.concat("h", "b", "t").cast("binary").alias("content"))


def shown(nodes: DataFrame) -> DataFrame:
    """The columns of nodes that the SQL states."""
    return nodes.select("key", "parent_key", "level", "type", "citekey", "heading", F.coalesce("seqitem_key", F.lit("")).alias("unit"), F.array_join("texts", "|").alias("texts"), F.array_join("citekey_detailed", ",").alias("detailed"), F.coalesce("error", F.lit("")).alias("error"))


_SHOWN = "key, parent_key, level, type, citekey, heading, unit, texts, detailed, error"

# -- regulations ----------------------------------------------------------------------------------------------------


def regulation_files(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_size", "p_partkey", "p_brand", "p_type")
    piece = "concat('<SECTION><SECTNO>§ ', p_size, '.', p_partkey, '</SECTNO><SUBJECT>', p_type, '</SUBJECT><P>(a)(1) First ', p_brand, '.</P><P>(i) One.</P><P>(ii) Two.</P><P>(2) Second.</P><PRTPAGE P=\"7\"/><P>(b)  Third.</P><FP>Flush.</FP></SECTION>')"
    head = "concat('<CFRDOC><TITLE><HD>Title ', p_size, '</HD><CHAPTER><TOC><TOCHD><HD>Chapter of the table</HD></TOCHD></TOC><AUTH><P>42 U.S.C. ', p_size, '; 5 U.S.C. 301(a).</P></AUTH>')"
    return bundle(p, "p_size", ["p_partkey"], piece, head, "'</CHAPTER></TITLE></CFRDOC>'", "concat('/in/2000/CFR-2000-title', p_size, '-vol1.xml')")


_REGULATION = """base AS (SELECT p_size AS s, p_partkey AS k, p_brand AS b, p_type AS t, 'cfr' || p_size || 'v1_2000' AS d, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS r FROM part),
parts(i, up, lvl, kind, x) AS (VALUES (0, -1, 2, 'seqitem', ''), (1, 0, 3, 'subseqitem', '(a)'), (2, 1, 4, 'subseqitem', ''), (3, 2, 5, 'subseqitem', '(i) One.'), (4, 2, 5, 'subseqitem', '(ii) Two.'),
  (5, 1, 4, 'subseqitem', '(2) Second.'), (6, 0, 3, 'subseqitem', '(b) Third.'), (7, 0, 3, 'subseqitem', 'Flush.')),
nodes AS (SELECT DISTINCT d || '_000001' AS key, '' AS parent_key, 0 AS level, 'document' AS type, '' AS citekey, 'Title ' || s AS heading, '' AS unit, '' AS texts, d FROM base
UNION ALL SELECT DISTINCT d || '_000002', d || '_000001', 1, 'item', '', 'Chapter of the table', '', '', d FROM base
UNION ALL SELECT d || '_' || printf('%06d', 3 + 8 * r + i), d || '_' || printf('%06d', CASE WHEN up < 0 THEN 2 ELSE 3 + 8 * r + up END), lvl, kind, CASE WHEN i = 0 THEN 'cfr' || s || '_' || s || '.' || k ELSE '' END,
  CASE WHEN i = 0 THEN '§ ' || s || '.' || k || ' ' || t ELSE '' END, d || '_' || printf('%06d', 3 + 8 * r), CASE WHEN i = 2 THEN '(1) First ' || b || '.' ELSE x END, d FROM base, parts)"""


def regulation_nodes_of(spark, sf_dir):
    return materialize(tree.shred(regulation_files(spark, sf_dir), formats.volume))


@query(f"WITH {_REGULATION} SELECT key, parent_key, level, type, citekey, heading, unit, texts, '' AS detailed, '' AS error FROM nodes")
def regulation_nodes(spark, sf_dir):
    return shown(regulation_nodes_of(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_REGULATION}, up AS (SELECT key AS node, key AS above FROM nodes UNION ALL SELECT node, n.parent_key FROM up JOIN nodes n ON n.key = above WHERE n.parent_key <> ''),
below AS (SELECT above AS key, texts FROM up JOIN nodes ON key = node WHERE texts <> ''), words AS (SELECT key, count(DISTINCT w) AS n FROM (SELECT key, unnest(string_split(texts, ' ')) AS w FROM below) GROUP BY 1),
sums AS (SELECT key, sum(length(texts)) + count(*) - 1 AS c, sum(length(replace(texts, ' ', ''))) AS b, sum(len(string_split(texts, ' '))) AS t FROM below GROUP BY 1)
SELECT n.key, CAST(coalesce(c, 0) AS BIGINT) AS chars_n, CAST(coalesce(b, 0) AS BIGINT) AS chars_nowhites, CAST(coalesce(t, 0) AS BIGINT) AS tokens_n, CAST(coalesce(w.n, 0) AS BIGINT) AS tokens_unique,
  CASE WHEN n.texts <> '' AND n.key IN (SELECT parent_key FROM nodes) THEN CAST(len(string_split(n.texts, ' ')) AS VARCHAR) ELSE '' END AS own FROM nodes n LEFT JOIN sums s ON s.key = n.key LEFT JOIN words w ON w.key = n.key"""
)
def subtree_statistics(spark, sf_dir):
    """Characters and tokens of what every node holds."""
    stats = tree.with_statistics(regulation_nodes_of(spark, sf_dir))
    return stats.select("key", "chars_n", "chars_nowhites", "tokens_n", "tokens_unique", F.coalesce(F.array_join(F.col("texts_tokens_n").cast("array<string>"), "|"), F.lit("")).alias("own"))


@query(
    f"""WITH {_REGULATION}, mixed AS (SELECT key, texts FROM nodes WHERE key IN (SELECT parent_key FROM nodes) AND texts <> '')
SELECT key, CAST(len(string_split(texts, ' ')) AS VARCHAR) AS tokens, CAST(length(replace(texts, ' ', '')) AS VARCHAR) AS chars FROM mixed"""
)
def direct_text_statistics(spark, sf_dir):
    """Tokens and characters of the texts that stand beside other parts of a unit."""
    stats = tree.with_statistics(regulation_nodes_of(spark, sf_dir)).where("texts_tokens_n is not null")
    return stats.select("key", F.array_join(F.col("texts_tokens_n").cast("array<string>"), ",").alias("tokens"), F.array_join(F.col("texts_chars_n").cast("array<string>"), ",").alias("chars"))


@query(f"WITH {_REGULATION} SELECT key, citekey FROM nodes WHERE citekey <> ''")
def lookup_rows(spark, sf_dir):
    return tree.lookup_rows(regulation_nodes_of(spark, sf_dir)).select("key", "citekey")


@query(f"WITH {_REGULATION} SELECT n.key || '_0' AS key, coalesce(u.citekey, '') AS citekey, lower(n.texts) AS text FROM nodes n LEFT JOIN nodes u ON u.key = n.unit WHERE n.texts <> ''")
def text_rows(spark, sf_dir):
    return tree.text_rows(regulation_nodes_of(spark, sf_dir)).select(F.col("text_key").alias("key"), "citekey", "text")


@query(
    f"""WITH {_REGULATION}, c AS (SELECT DISTINCT s, d FROM base) SELECT d || '_000002' AS node_key, '42/' || s AS path FROM c UNION ALL SELECT d || '_000002', '5/301/a' FROM c"""
)
def authority_paths(spark, sf_dir):
    found = statutes.authorities(regulation_nodes_of(spark, sf_dir))
    return found.select("node_key", F.array_join("path", "/").alias("path"))


@query(
    f"""WITH {_REGULATION}, c AS (SELECT DISTINCT s, d FROM base), laws AS (SELECT '42_' || p_size AS citekey, min('law' || p_partkey) AS key FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT d || '_000002' AS u, key AS v, 'authority' AS edge_type FROM c JOIN laws ON citekey = '42_' || s"""
)
def authority_edges(spark, sf_dir):
    laws = table(spark, sf_dir, "part").where("p_size % 2 = 0").groupBy(F.concat(F.lit("42_"), F.col("p_size").cast("string")).alias("citekey")).agg(F.min(F.concat(F.lit("law"), F.col("p_partkey").cast("string"))).alias("key"))
    hits = lookup.resolve_fixed(statutes.authorities(regulation_nodes_of(spark, sf_dir)), laws, "path", ["ref_id", "node_key"])
    return graph.typed_edges(hits, "node_key", "key", "authority")


def volume_files(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_size", (1 + F.col("p_partkey") % 2).alias("v"), "p_partkey", "p_type").withColumn("file", F.concat_ws("/", "p_size", "v"))
    piece = "concat('<SECTION><SECTNO>§ ', p_size, '.', p_partkey, '</SECTNO><SUBJECT>', p_type, '</SUBJECT><P>Only text ', p_partkey, '.</P></SECTION>')"
    head = "concat('<CFRDOC><TITLE><CHAPTER><HD>Chapter I of volume ', v, '</HD><PART><HD>Part 7—some words ', v, '</HD>')"
    return bundle(p, "file", ["p_partkey"], piece, head, "'</PART></CHAPTER></TITLE></CFRDOC>'", "concat('/in/2000/CFR-2000-title', p_size, '-vol', v, '.xml')")


@query(
    """WITH p AS (SELECT p_size AS s, 1 + p_partkey % 2 AS v, p_partkey AS k, p_type AS t FROM part), f AS (SELECT s, min(v) AS first FROM p GROUP BY 1),
n AS (SELECT p.*, first, row_number() OVER (PARTITION BY s, v ORDER BY k) + CASE WHEN v = first THEN 2 ELSE 0 END AS i FROM p JOIN f USING (s)), vol(s, first, pre) AS (SELECT s, first, 'cfr' || s || 'v' || first || '_2000_' FROM f)
SELECT 'cfr' || s || 'v0_2000_000001' AS key, '' AS parent_key, 0 AS level, 'document' AS type, '' AS citekey, 'Title ' || s AS heading, '' AS unit, '' AS texts, '' AS detailed, '' AS error FROM vol
UNION ALL SELECT pre || '000001', 'cfr' || s || 'v0_2000_000001', 1, 'item', '', 'Chapter I of volume ' || first, '', '', '', '' FROM vol
UNION ALL SELECT pre || '000002', pre || '000001', 2, 'item', '', 'Part 7—some words ' || first, '', '', '', '' FROM vol
UNION ALL SELECT 'cfr' || s || 'v' || v || '_2000_' || printf('%06d', i), 'cfr' || s || 'v' || first || '_2000_000002', 3, 'seqitem', 'cfr' || s || '_' || s || '.' || k, '§ ' || s || '.' || k || ' ' || t, 'cfr' || s || 'v' || v || '_2000_' || printf('%06d', i), 'Only text ' || k || '.', '', '' FROM n"""
)
def merged_volumes(spark, sf_dir):
    """The volumes of a title as one document: what a volume goes on with joins the unit before it, at every depth."""
    # written once, as merging reads them many times
    return shown(volumes.merged_volumes(materialize(tree.shred(volume_files(spark, sf_dir), formats.volume))))


# -- statutes of the code -------------------------------------------------------------------------------------------


def code_files(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.col("s_suppkey").alias("k"), "s_name")
    at = "concat('<!-- documentid:', r, '_', k, ' --><!-- expcite:TITLE ', r + 1, '-LAW!@!CHAPTER ', n, '!@!Sec. ', k, ' --><!-- itempath:/', r + 1, '0/CHAPTER ', n, '/Sec. ', k, ' --><!-- itemsortkey:', k, ' -->')"
    blocks = "concat('<!-- field-start:statute --><h4 class=\"subsection-head\">(a) Findings</h4><p class=\"statutory-body\">(1) Text of ', s_name, ', see section ', k, ' of this title.</p><p class=\"statutory-body-1em\">(A) Inner <i>part</i>.</p><p class=\"statutory-body-block\">Tail.</p><!-- PDFPage:1 --><p class=\"note-body\">(2) Note.</p><table><tr><td>x</td><td>y</td></tr></table><!-- field-end:statute -->')"
    return bundle(rows, "r", ["n", "k"], f"concat({at}, {blocks})", "'<html><body><div>'", "'</div></body></html>'", "concat('/in/', r + 1, '0_2010.htm')")


_CODE = """s AS (SELECT n_regionkey + 1 AS t, n_nationkey AS n, s_suppkey AS k, s_name AS nm FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n, k) - 1 AS r, dense_rank() OVER (PARTITION BY t ORDER BY n) AS c, t || '0_2010' AS d FROM s),
v AS (SELECT *, 1 + c + 6 * r + 1 AS pos FROM u), ch AS (SELECT d, t, n, min(pos) - 1 AS pos FROM v GROUP BY ALL),
parts(i, up, lvl, h) AS (VALUES (0, -1, 2, ''), (1, 0, 3, '(a) Findings'), (2, 1, 4, ''), (3, 2, 5, ''), (4, 1, 4, ''), (5, 4, 5, '')),
texts AS (SELECT v.*, i, up, lvl, h, CASE i WHEN 2 THEN '(1) Text of ' || nm || ', see section ' || k || ' of this title.|Tail.' WHEN 3 THEN '(A) Inner part.' WHEN 4 THEN '(2) Note.' WHEN 5 THEN 'x y' ELSE '' END AS x,
  CASE WHEN i = 2 AND k <> 1 THEN t || '_' || k || '_1' WHEN i = 3 THEN t || '_' || k || CASE WHEN k = 1 THEN '' ELSE '_1' END || '_A' WHEN i = 4 AND k <> 2 THEN t || '_' || k || '_2' ELSE '' END AS dk FROM v, parts)"""
_CODE_NODES = f"""{_CODE},
nodes AS (SELECT DISTINCT d || '_000001' AS key, '' AS parent_key, 0 AS level, 'document' AS type, '' AS citekey, 'TITLE ' || t || '-LAW' AS heading, '' AS unit, '' AS texts, '' AS detailed FROM v
UNION ALL SELECT d || '_' || printf('%06d', pos), d || '_000001', 1, 'item', '', 'CHAPTER ' || n, '', '', '' FROM ch
UNION ALL SELECT x.d || '_' || printf('%06d', x.pos + i), x.d || '_' || printf('%06d', CASE WHEN up < 0 THEN ch.pos ELSE x.pos + up END), lvl, CASE WHEN i = 0 THEN 'seqitem' ELSE 'subseqitem' END, CASE WHEN i = 0 THEN x.t || '_' || k ELSE '' END,
  CASE WHEN i = 0 THEN 'Sec. ' || k ELSE h END, x.d || '_' || printf('%06d', x.pos), x, dk FROM texts x JOIN ch ON ch.d = x.d AND ch.n = x.n)"""


def code_nodes_of(spark, sf_dir):
    return materialize(tree.shred(code_files(spark, sf_dir), formats.us_code))


@query(f"WITH {_CODE_NODES} SELECT {_SHOWN.replace('error', chr(39) * 2 + ' AS error')} FROM nodes")
def code_nodes(spark, sf_dir):
    return shown(code_nodes_of(spark, sf_dir))


@query(
    f"""WITH {_CODE_NODES}, t AS (SELECT 'u' AS a, key, unit, texts, detailed FROM nodes)
SELECT key AS u, unit AS v, 'reference' AS edge_type FROM t WHERE texts LIKE '(1) Text%'"""
)
def detailed_references(spark, sf_dir):
    """References from the sub-unit that holds them; the citekeys of sub-units are in the dictionary too."""
    edges = statutes.citation_network(code_nodes_of(spark, sf_dir), detailed=True)["edges"]
    return edges.where("edge_type = 'reference'")


@query(
    f"""WITH {_CODE_NODES} SELECT 'containment' AS edge_type, CASE WHEN parent_key = '' THEN 'root' ELSE parent_key END AS u, key AS v FROM nodes
UNION ALL SELECT 'reference', unit, unit FROM nodes WHERE texts LIKE '(1) Text%'"""
)
def snapshot_network(spark, sf_dir):
    """Containment, references and authorities of a snapshot as one list of edges."""
    return statutes.citation_network(code_nodes_of(spark, sf_dir))["edges"]


@query(
    f"""WITH {_CODE_NODES} SELECT key, level, parent_key, type, citekey, heading, 'statute' AS document_type, 'TITLE ' || regexp_extract(key, '^(\\d+)0_', 1) || '-LAW' AS law_name FROM nodes
UNION ALL SELECT 'root', -1, NULL, NULL, NULL, NULL, NULL, 'root'"""
)
def exported_nodes(spark, sf_dir):
    nodes = statutes.citation_network(code_nodes_of(spark, sf_dir))["nodes"]
    return nodes.select("key", "level", "parent_key", "type", "citekey", "heading", "document_type", "law_name")


@query(f"WITH {_CODE_NODES} SELECT {_SHOWN.replace('error', chr(39) * 2 + ' AS error')} FROM nodes")
def structural_round_trip(spark, sf_dir):
    """Nodes written as structural XML and read again: nothing is lost, and mixed content keeps its order."""
    xml = files.xml_documents(code_nodes_of(spark, sf_dir), files.STYLESHEET)
    again = xml.select(F.concat(F.lit("/x/"), "doc_id", F.lit(".xml")).alias("path"), F.encode("xml", "utf-8").alias("content"))
    return shown(tree.shred(again, formats.structural))


@query(f"WITH {_CODE_NODES} SELECT {_SHOWN.replace('error', chr(39) * 2 + ' AS error')} FROM nodes")
def scanned_files(spark, sf_dir):
    """Structural XML written as one file per document, found by a scan of the folder, and read again."""
    path = new_path(spark)
    files.write_xml(code_nodes_of(spark, sf_dir), path)
    return shown(tree.shred(files.scan(spark, path, ".txt"), formats.structural))


@query(
    f"""WITH {_REGULATION} SELECT row_number() OVER (ORDER BY n.d, n.key) - 1 AS pos, n.key || '_0' AS key, coalesce(u.citekey, '') AS citekey, lower(n.texts) AS text
FROM nodes n LEFT JOIN nodes u ON u.key = n.unit WHERE n.texts <> ''"""
)
def alignment_index(spark, sf_dir):
    """The texts of a snapshot in the order of files and documents, numbered over the whole snapshot."""
    return statutes.alignment_index(regulation_nodes_of(spark, sf_dir))


@query("SELECT p_partkey || '.xml' AS name, '<p>' || p_name || '</p>' AS content FROM part")
def archived_files(spark, sf_dir):
    """Members written to zip archives by many tasks, and read from them by as many as their bytes ask for."""
    path = new_path(spark)
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".xml")).alias("path"), F.encode(F.concat(F.lit("<p>"), "p_name", F.lit("</p>")), "utf-8").alias("content"))
    archives.write_zip(p, path)
    return archives.read_zip(spark, path, ".xml").select(F.element_at(F.split("path", "!"), -1).alias("name"), F.decode("content", "utf-8").alias("content"))


@query("SELECT DISTINCT '/in/' || (n_regionkey + 1) || '0_2010.htm' AS path, 'ValueError: class ''unheard-of'' of <p>' AS error FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def quarantined_files(spark, sf_dir):
    """A file with an unknown class gives one row that says so."""
    old = F.encode(F.replace(F.decode("content", "utf-8"), F.lit("note-body"), F.lit("unheard-of")), "utf-8")
    return tree.shred(code_files(spark, sf_dir).withColumn("content", old), formats.us_code).select(F.col("doc_id").alias("path"), "error")


@query("SELECT '/in/' || r || '.htm' AS path, 'text ' || r || CASE WHEN r % 2 = 0 THEN ' new' ELSE ' old' END || ' end' AS content FROM (SELECT r_regionkey AS r FROM region)")
def patched_files(spark, sf_dir):
    r = F.col("r_regionkey").cast("string")
    given = table(spark, sf_dir, "region").select(F.concat(F.lit("/in/"), r, F.lit(".htm")).alias("path"), F.concat(F.lit("text "), r, F.lit(" old end")).alias("content"))
    patches = table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(F.concat(r, F.lit(".htm")).alias("file"), F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("old").alias("old"), F.lit("newer").alias("new")), F.struct(F.lit(2).alias("rank"), F.lit("newer").alias("old"), F.lit("new").alias("new")))).alias("p")).select("file", "p.*")
    return files.patched(given, patches, F.element_at(F.split("path", "/"), -1))


# -- German statutes -------------------------------------------------------------------------------------------------


def german_files(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    rows = n.join(s, s["s_nationkey"] == n["n_nationkey"], "left").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.col("s_suppkey").alias("k"), "n_name", F.row_number().over(_first()).alias("f"))
    part = "concat('<norm><metadaten><gliederungseinheit><gliederungskennzahl>', lpad(cast(n + 1 as string), 3, '0'), '</gliederungskennzahl><gliederungsbez>Teil</gliederungsbez><gliederungstitel>', n_name, ' *)</gliederungstitel></gliederungseinheit></metadaten></norm>')"
    unit = "concat('<norm><metadaten><enbez>', if(k % 3 = 0, 'Art ', '§ '), k, '</enbez></metadaten><textdaten><text><Content><P>(1) Es  gilt<BR/>§ ', k, ' Abs. 1.<FnR ID=\"1\"/></P><P>(2) Mehr steht hier unten.</P><P>(weggefallen)</P></Content></text></textdaten></norm>')"
    head = "concat('<dokumente builddate=\"1\"><norm><metadaten><jurabk>R ', r, '</jurabk><langue>Gesetz der Region ', r, '</langue><ausfertigung-datum>x</ausfertigung-datum></metadaten><textdaten/></norm><norm><metadaten><enbez>Inhaltsverzeichnis</enbez></metadaten><textdaten><text><Content><P>Ein Verzeichnis von allem.</P></Content></text></textdaten></norm>')"
    tail = "'<norm><metadaten><enbez>Anlage 1</enbez></metadaten><textdaten><text><Content><P>Was hier steht, bleibt weg.</P></Content></text></textdaten></norm></dokumente>'"
    return bundle(rows, "r", ["n", "f"], f"concat(if(f = 1, {part}, ''), if(k is null, '', {unit}))", head, tail, "concat('/in/BJNR', r, '_20000101_99991231.xml')")


def _first():
    from pyspark.sql.window import Window

    return Window.partitionBy("n_nationkey").orderBy("s_suppkey")


_GERMAN_NODES = """s AS (SELECT n_regionkey AS r, n_nationkey AS n, s_suppkey AS k, n_name AS nm, 'BJNR' || n_regionkey || '_R-' || n_regionkey || '_99991231' AS d FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT *, 1 + dense_rank() OVER (PARTITION BY r ORDER BY n) + 3 * (row_number() OVER (PARTITION BY r ORDER BY n, k) - 1) + 1 AS pos FROM s), ch AS (SELECT d, n, nm, min(pos) - 1 AS pos FROM u GROUP BY ALL),
parts(i) AS (VALUES (0), (1), (2)), regions AS (SELECT n_regionkey AS r, 'BJNR' || n_regionkey || '_R-' || n_regionkey || '_99991231' AS d FROM nation GROUP BY 1),
nodes AS (SELECT d || '_000001' AS key, '' AS parent_key, 0 AS level, 'document' AS type, '' AS citekey, 'Gesetz der Region ' || r AS heading, '' AS unit, '' AS texts FROM regions
UNION ALL SELECT d || '_' || printf('%06d', pos), d || '_000001', 1, 'item', '', 'Teil ' || nm, '', '' FROM ch
UNION ALL SELECT u.d || '_' || printf('%06d', u.pos + i), u.d || '_' || printf('%06d', CASE WHEN i = 0 THEN ch.pos ELSE u.pos END), CASE WHEN i = 0 THEN 2 ELSE 3 END, CASE WHEN i = 0 THEN 'seqitem' ELSE 'subseqitem' END, CASE WHEN i = 0 THEN 'R-' || r || '_' || k ELSE '' END,
  CASE WHEN i > 0 THEN '' WHEN k % 3 = 0 THEN 'Art ' || k ELSE '§ ' || k END, u.d || '_' || printf('%06d', u.pos), CASE i WHEN 1 THEN '(1) Es gilt § ' || k || ' Abs. 1.' WHEN 2 THEN '(2) Mehr steht hier unten.' ELSE '' END FROM u JOIN ch ON ch.d = u.d AND ch.n = u.n, parts)"""


def german_nodes_of(spark, sf_dir):
    return materialize(tree.shred(german_files(spark, sf_dir), lambda path, data: formats.german_statute(path, formats.simplified_tree(data))))


@query(f"WITH {_GERMAN_NODES} SELECT key, parent_key, level, type, citekey, heading, unit, texts, '' AS detailed, '' AS error FROM nodes")
def german_nodes(spark, sf_dir):
    return shown(german_nodes_of(spark, sf_dir))


@query(f"WITH {_GERMAN_NODES} SELECT regexp_replace(substr(key, 1, length(key) - 7), '_99991231$', '_20000101_99991231') AS doc_id, count(*) FILTER (WHERE heading LIKE '§%') AS para, count(*) FILTER (WHERE heading LIKE 'Art%') AS art, 0 AS misc FROM nodes WHERE type = 'seqitem' GROUP BY 1")
def heading_kinds(spark, sf_dir):
    return statutes.heading_kinds(german_nodes_of(spark, sf_dir))


@query(
    """SELECT DISTINCT r.name AS name, 'R-' || n_regionkey AS citekey, 'BJNR' || n_regionkey || '_R-' || n_regionkey || '_20000101_99991231' AS doc_id
FROM (SELECT n_regionkey, unnest(['gesetz der regio ' || n_regionkey, 'r ' || n_regionkey]) AS name FROM nation) r"""
)
def law_names(spark, sf_dir):
    return statutes.law_names(german_nodes_of(spark, sf_dir))


@query(
    f"""WITH {_GERMAN_NODES} SELECT t.unit AS u, t.unit AS v, 'reference' AS edge_type FROM nodes t WHERE texts LIKE '(1)%' AND substr(key, 1, length(key) - 7) IN (SELECT substr(key, 1, length(key) - 7) FROM nodes WHERE heading LIKE '§%')"""
)
def german_network(spark, sf_dir):
    """Internal citations of German statutes, resolved by two components; laws without a § of their own have none."""
    return statutes.german_references(german_nodes_of(spark, sf_dir), {})


_TYPES = ["Ermächtigung", "Rechtsgrundlage", "Durchführungsvorschrift", "Sonderregelung"]


@query(
    f"""WITH c AS (SELECT c_custkey AS k, coalesce(lead(c_custkey) OVER (ORDER BY c_custkey), (SELECT min(c_custkey) FROM customer)) AS t FROM customer)
SELECT 'BJNR' || k || '_V-' || k || '_99991231_000001' AS u, 'BJNR' || t || '_V-' || t || '_99991231_' || CASE WHEN k % 3 = 0 THEN '000002' ELSE '000001' END AS v, 'authority' AS edge_type FROM c WHERE k % 4 <> 3 AND k % 5 <> 0"""
)
def german_authority_edges(spark, sf_dir):
    """Regulations and the laws, or sections of laws, that their entries name as what empowers them; one file a customer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    given = dealt(c, "k").select("k", F.expr("concat('/in/BJNR', k, '_20000101_99991231.xml')").alias("path"))
    xml = "concat('<dokumente builddate=\"1\"><norm><metadaten><jurabk>V ', k, '</jurabk><langue>Verordnung ', k, '</langue><ausfertigung-datum>x</ausfertigung-datum></metadaten><textdaten/></norm><norm><metadaten><enbez>§ ', k, '</enbez></metadaten><textdaten><text><Content><P>Es gilt.</P></Content></text></textdaten></norm></dokumente>')"
    nodes = materialize(tree.shred(given.select("path", F.expr(xml).cast("binary").alias("content")), lambda path, data: formats.german_statute(path, formats.simplified_tree(data))))
    # every law names the next one by number, the last one the first
    last, first = c.agg(F.max("k"), F.min("k")).first()
    after = dealt(c, "k").withColumn("t", F.when(F.col("k") == last, first).otherwise(F.col("k") + 1))
    types = ", ".join(f"'{t}'" for t in _TYPES)
    entry = f"to_json(array(struct(element_at(array({types}), cast(k % 4 + 1 as int)) as typ, if(k % 3 = 0, concat('§ ', t), null) as enbez, concat(if(k % 5 = 0, 'Keine ', ''), 'Verordnung ', t) as normabk)))"
    entries = after.select(F.expr("concat('BJNR', k, '_V-', k, '_99991231_000001')").alias("key"), F.expr(entry).alias("entries"))
    return statutes.german_authorities(nodes, entries)


# -- decisions -------------------------------------------------------------------------------------------------------


def decision_files(spark, sf_dir):
    c = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n")), "k")
    xml = "concat('<dokument><gertyp>BGH</gertyp><entsch-datum>20', lpad(cast(n as string), 2, '0'), '0131</entsch-datum><aktenzeichen>I ZR ', k, '/20</aktenzeichen><doktyp>Urteil</doktyp><norm>§ ', k, ' Testgesetz</norm><tenor><dl><dt/><dd><p>Die Klage ist erledigt.</p></dd></dl></tenor>', "
    xml += "'<gruende><dl><dt>1</dt><dd><p style=\"margin-left:1\">A. Zum Recht ', n, '</p></dd></dl><dl><dt>2</dt><dd><p>Nach § ', k, ' Testgesetz gilt das.</p></dd></dl><dl><dt/><dd><p style=\"margin-left:1\">geht weiter</p></dd></dl><dl><dt>3</dt><dd/></dl></gruende></dokument>')"
    return c.select(F.expr("concat('/in/K', k, '.xml')").alias("path"), F.encode(F.expr(xml), "utf-8").alias("content"))


_DECISION = """parts(i, up, lvl, kind, h, u) AS (VALUES (0, -1, 0, 'document', '', -1), (1, 0, 1, 'item', 'tenor', -1), (2, 1, 2, 'seqitem', '', 2), (3, 0, 1, 'item', 'gruende', -1), (4, 3, 2, 'item', 'A', -1), (5, 4, 3, 'seqitem', '', 5), (6, 4, 3, 'seqitem', '', 6)),
nodes AS (SELECT c_custkey AS k, i, 'K' || c_custkey || '_' || printf('%06d', i) AS key, CASE WHEN up < 0 THEN '' ELSE 'K' || c_custkey || '_' || printf('%06d', up) END AS parent_key, lvl AS level, kind AS type, '' AS citekey, h AS heading, CASE WHEN u < 0 THEN '' ELSE 'K' || c_custkey || '_' || printf('%06d', u) END AS unit,
  CASE i WHEN 2 THEN 'Die Klage ist erledigt.' WHEN 5 THEN 'A. Zum Recht ' || c_nationkey WHEN 6 THEN 'Nach § ' || c_custkey || ' Testgesetz gilt das. geht weiter' ELSE '' END AS texts FROM customer, parts)"""


def decision_nodes_of(spark, sf_dir):
    return materialize(tree.shred(decision_files(spark, sf_dir), formats.decision))


@query(f"WITH {_DECISION} SELECT key, parent_key, level, type, citekey, heading, unit, texts, '' AS detailed, '' AS error FROM nodes")
def decision_nodes(spark, sf_dir):
    return shown(decision_nodes_of(spark, sf_dir))


_LAWS = "laws AS (SELECT * FROM (VALUES ('20000101', 'L0'), ('20100101', 'L1')) t(since, law))"


def dated_names(spark):
    return spark.createDataFrame([("20000101", "testgesetz", "L0"), ("20100101", "testgesetz", "L1")], "since string, name string, citekey string")


@query(
    f"""WITH {_LAWS}, c AS (SELECT c_custkey AS k, CASE WHEN c_nationkey >= 10 THEN 'L1' ELSE 'L0' END AS law FROM customer)
SELECT 'K' || k || '_000006' AS key, 'text' AS part, 'dict' AS law_type, law || '/' || k AS path FROM c UNION ALL SELECT 'K' || k || '_000000', 'norm', 'dict', law || '/' || k FROM c"""
)
def decision_references(spark, sf_dir):
    """Citations in texts and norms, by the names of laws as of the decision's date."""
    found = statutes.decision_citations(decision_nodes_of(spark, sf_dir), dated_names(spark))
    return found.select("key", "part", "law_type", F.explode("parsed").alias("p")).select("key", "part", "law_type", F.array_join("p", "/").alias("path"))


@query(
    """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_nationkey >= 10 THEN 'L1_' ELSE 'L0_' END || c_custkey AS t FROM customer), e AS (SELECT 'K' || k || '_' || printf('%06d', i) AS u, t AS v FROM c, (VALUES (0), (3), (4), (6), (0)) x(i))
SELECT u, v, count(*) AS weight FROM e GROUP BY ALL"""
)
def decision_graph(spark, sf_dir):
    """References of a decision count for every node around them; law references by their citekeys."""
    nodes = decision_nodes_of(spark, sf_dir)
    found = statutes.decision_citations(nodes, dated_names(spark)).where(F.col("law_type").isin("dict", "sgb"))
    refs = found.select("key", F.explode("parsed").alias("p")).select("key", F.array_join("p", "_").alias("target"))
    return graph.weighted(graph.decision_references(refs, graph.ancestors(nodes)))


@query("SELECT 'K' || c_custkey AS key, 'decision' AS bipartite FROM customer UNION ALL SELECT DISTINCT 'N' || c_nationkey, 'statute' FROM customer")
def bipartite_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return graph.bipartite_nodes(c.select(name("K", "c_custkey").alias("key")), c.select(name("N", "c_nationkey").alias("v")))


# -- files and names --------------------------------------------------------------------------------------------------


def named_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("y"))
    return o.select("k", "y", F.expr("concat('/in/', k % 50, if(k % 7 = 0, '1', '0'), '_', y, if(k % 11 = 0, '.html', '.htm'))").alias("path"))


_FILES = "f AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, '/in/' || (o_orderkey % 50) || CASE WHEN o_orderkey % 7 = 0 THEN '1' ELSE '0' END || '_' || year(o_orderdate) || CASE WHEN o_orderkey % 11 = 0 THEN '.html' ELSE '.htm' END AS path FROM orders)"


@query(f"WITH {_FILES} SELECT k, path FROM f WHERE k % 7 <> 0 AND k % 11 <> 0")
def without_appendices(spark, sf_dir):
    return files.without_appendices(named_files(spark, sf_dir)).select("k", "path")


@query(f"WITH {_FILES} SELECT k, path FROM f WHERE y = 1996")
def files_of_snapshot(spark, sf_dir):
    return files.of_snapshot(named_files(spark, sf_dir), F.lit(1996)).select("k", "path")


@query(f"WITH {_FILES} SELECT k FROM f WHERE k % 3 <> 0")
def pending_files(spark, sf_dir):
    f = named_files(spark, sf_dir)
    return files.pending(f, f.where("k % 3 = 0").select("k"), "k").select("k")


@query(f"WITH {_FILES} SELECT k FROM f WHERE k % 5 = 1")
def selected_files(spark, sf_dir):
    f = named_files(spark, sf_dir)
    return files.selected(f, f.where("k % 5 = 1").select("k"), "k").select("k")


@query(
    "SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderkey % 50 AS INTEGER) AS title, CAST(o_orderkey % 4 AS INTEGER) AS volume, row_number() OVER (ORDER BY o_orderkey % 50, o_orderkey % 4, o_orderkey) AS place FROM orders WHERE o_orderkey % 4 > 0"
)
def volumes_in_order(spark, sf_dir):
    """Files of regulations with a volume, numbered by title, volume and key over all files."""
    path = F.expr("concat('/in/CFR-', year(o_orderdate), '-title', o_orderkey % 50, '-vol', if(o_orderkey % 4 = 0, '', cast(o_orderkey % 4 as string)), '.xml')")
    kept = files.with_volume(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), path.alias("path")))
    from citeloom.operators import ordered

    return ordered.places(kept.select("k", "year", "title", "volume"), ["title", "volume", "k"], "place")


@query("SELECT p_partkey AS k, CAST(p_size AS INTEGER) AS title, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS appendix, '/in/' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '0' END || '_2001.htm' AS renamed FROM part")
def code_file_names(spark, sf_dir):
    name = F.expr("concat('/raw/2001usc', lpad(cast(p_size as string), 2, '0'), if(p_partkey % 2 = 0, 'a', ''), '.htm')")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), files.code_file_parts(name).alias("n"))
    return p.select("k", "n.title", "n.appendix", F.format_string("/in/%d%d_2001.htm", "n.title", "n.appendix").alias("renamed"))


@query("SELECT 'BJNR' || o_custkey || '_' || o_orderkey || '_99991231.xml' AS path, 'BJNR' || o_custkey AS doknr FROM orders WHERE o_custkey % 4 = 0")
def selected_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    given = o.select(F.format_string("BJNR%d_%d_99991231.xml", "o_custkey", "o_orderkey").alias("path"))
    return files.selected_versions(given, o.where("o_custkey % 4 = 0").select(F.format_string("BJNR%d", "o_custkey").alias("id"))).select("path", "doknr")


# -- sinks that are read again ----------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    path = new_path(spark)
    files.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT 'r' || n_regionkey AS u, 'n' || n_nationkey AS v, n_name AS heading FROM nation")
def graph_round_trip(spark, sf_dir):
    path, n = new_path(spark), table(spark, sf_dir, "nation")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    files.write_graph(n.select(name("n", "n_nationkey").alias("key"), F.col("n_name").alias("heading")), n.select(name("r", "n_regionkey").alias("u"), name("n", "n_nationkey").alias("v")), path)
    nodes, edges = files.read_graph(spark, path)
    return edges.join(nodes, edges["v"] == nodes["key"]).select("u", "v", "heading")


@query("SELECT 'a' || s_suppkey AS key1, 'b' || s_suppkey AS key2 FROM supplier")
def mapping_round_trip(spark, sf_dir):
    path = new_path(spark)
    name = lambda p: F.concat(F.lit(p), F.col("s_suppkey").cast("string"))
    files.write_mapping(table(spark, sf_dir, "supplier").select(name("a").alias("key1"), name("b").alias("key2")), path)
    return spark.read.schema("key1 string, key2 string").json(path)


@query("SELECT value, row_number() OVER (ORDER BY lower(value), value) AS place FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS value FROM nation)")
def sorted_log(spark, sf_dir):
    """A log whose lines are sorted without regard to case; places count its lines."""
    path = new_path(spark)
    n = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("line"))
    files.write_log(n, "line", path)
    from pyspark.sql.window import Window

    # one file for every sorted part, in the order of names; a log of a run is short
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    return lines.select("value", F.row_number().over(Window.orderBy("f", "i")).alias("place"))


@query("SELECT 'in' || r_regionkey || '.zip!a' || r_regionkey || '.xml' AS path, 'one ' || r_name AS content FROM region")
def unzipped_files(spark, sf_dir):
    """Members of archives that have the suffix."""

    def pack(batches):
        import io
        import zipfile

        for batch in batches:
            for k, name in zip(batch["r_regionkey"], batch["r_name"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr(f"a{k}.xml", f"one {name}")
                    z.writestr("b.txt", "passed over")
                yield batch.head(1).assign(path=f"in{k}.zip", content=[out.getvalue()])[["path", "content"]]

    archives = table(spark, sf_dir, "region").mapInPandas(pack, "path string, content binary")
    return files.unzip(archives, ".xml").select("path", F.col("content").cast("string").alias("content"))


# -- names, numbers and paths -----------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey AS k, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size END AS INTEGER) AS cfr, CAST(CASE WHEN p_partkey % 2 = 1 THEN p_size END AS INTEGER) AS code, p_size || 'a' AS section, 'cfr' || p_size || 'v2_1999' AS volume, 'x_' || printf('%06d', p_size) AS node,
  'BJNR' || p_size AS doknr, '20000101' AS valid_from, '99991231' AS valid_to FROM part"""
)
def key_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("int").alias("s"))
    own = citations.own_title(F.expr("if(k % 2 = 0, concat('cfr', s, 'v1_2000'), concat(s, '0_2000'))"))
    even = F.col("k") % 2 == 0
    v = tx.version_parts(F.expr("concat('/in/BJNR', s, '_20000101_99991231.xml')"))
    return p.select("k", F.when(even, own).alias("cfr"), F.when(~even, own).alias("code"), tx.section_number(F.expr("concat('§ ', s, 'a Rest')")).alias("section"), tx.volume_key(F.col("s"), F.lit(2), F.lit(1999)).alias("volume"), tx.node_key(F.lit("x"), F.col("s")).alias("node"), v["doknr"].alias("doknr"), v["valid_from"].alias("valid_from"), v["valid_to"].alias("valid_to"))


_TOKENS = "'a)' 'bb)' '(c)' '(dd)' 'e.' 'XIV.' '12.' '3)' 'B.' 'H)' '1.2' '4.5.6.' 'word' 'Z' 'i)'".replace("' '", "', '")
_KINDS = "alpha-lower-bracket-1 alpha-lower-bracket-2 alpha-lower-double-bracket-1 alpha-lower-double-bracket-2 alpha-lower-dot-1 roman-upper arabic-dot arabic-bracket alpha-dot alpha-bracket numeric-2 numeric-3 - - -".split()


@query(f"SELECT c_custkey AS k, [{', '.join(repr(x) for x in _KINDS)}][1 + c_custkey % 15] AS kind FROM customer")
def list_numbering(spark, sf_dir):
    token = F.element_at(F.expr(f"array({_TOKENS})"), (F.col("c_custkey") % 15 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.coalesce(tx.list_number_type(F.concat(F.lit("  "), token, F.lit(" and so on"))), F.lit("-")).alias("kind"))


@query("SELECT c_custkey AS k, [false, true, true, false, true][1 + c_custkey % 5] AS same FROM customer")
def enumeration_types(spark, sf_dir):
    pairs = F.expr("array(struct('a' as x, '1' as y), struct('b' as x, 'q' as y), struct('iv' as x, 'x' as y), struct('A' as x, 'aa' as y), struct('7' as x, '12' as y))")
    pair = F.element_at(pairs, (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), tx.enum_types_match(pair["x"], pair["y"]).alias("same"))


@query("SELECT p_partkey AS k, [['a', p_size || ''], ['b'], ['a', '1']] AS first, '[[\"a\",\"' || p_size || '\"],[\"b\"],[\"a\",\"1\"]]' AS json FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN 51 ELSE p_size END AS p_size FROM part)".replace("SELECT p_partkey AS k, [['a', p_size || ''], ['b'], ['a', '1']] AS first", "SELECT p_partkey AS k, 'a/' || p_size || ' b a/1' AS first"))
def path_json(spark, sf_dir):
    """Paths without repeats, as JSON and back."""
    s = F.when(F.col("p_size") == 1, 51).otherwise(F.col("p_size")).cast("string")
    paths = citations.distinct_paths(F.array(F.array(F.lit("a"), s), F.array(F.lit("b")), F.array(F.lit("a"), F.lit("1")), F.array(F.lit("a"), s), F.array(F.lit("b"))))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), citations.paths_json(paths).alias("json"))
    return p.select("k", F.array_join(F.transform(citations.paths_of_json(F.col("json")), lambda x: F.array_join(x, "/")), " ").alias("first"), "json")


@query("SELECT p_partkey AS k, 'a b' || p_size || 'c|[1]|de' AS merged FROM part")
def merged_strings(spark, sf_dir):
    """Neighbouring strings become one; other entries stay between them."""
    e = lambda text, item: F.struct(F.lit(text).cast("string").alias("text") if not hasattr(text, "cast") else text.cast("string").alias("text"), F.lit(item).cast("string").alias("item"))
    parts = F.array(e("a ", None), e(F.concat(F.lit("b"), F.col("p_size").cast("string")), None), e("c", None), e(None, "[1]"), e("d", None), e("e", None))
    out = F.transform(tx.merge_strings(parts), lambda x: F.coalesce(x["text"], x["item"]))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(out, "|").alias("merged"))


@query(
    """SELECT o_orderkey AS k, law_type, path FROM (SELECT o_orderkey, o_custkey AS c, o_orderkey % 4 AS m FROM orders), LATERAL (SELECT CASE m WHEN 0 THEN 'dict' WHEN 1 THEN 'internal' WHEN 2 THEN 'ignore' ELSE 'dict' END AS law_type,
  CASE m WHEN 0 THEN 'L1/' || (1 + c) || '/2' WHEN 1 THEN 'OWN/' || (1 + c) || '/1/3' WHEN 2 THEN CAST(1 + c AS VARCHAR) ELSE 'L1/' || (1 + c) || '/a' END AS path)"""
)
def german_citation_kinds(spark, sf_dir):
    """Known, internal and ignored citations, of several shapes."""
    shapes = "array(concat('nach § ', 1 + o_custkey, ' Abs. 2 des Auftragsgesetzes'), concat('nach § ', 1 + o_custkey, ' Abs. 1 Nr. 3 gilt'), concat('siehe Art. ', 1 + o_custkey, ' hier'), concat('gemäß Artikel ', 1 + o_custkey, ' Buchst. a Auftragsgesetz'))"
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.element_at(F.expr(shapes), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("text"))
    found = german.find_citations(o, {german.stem("Auftragsgesetz"): "L1"}, own_law=F.lit("OWN"), articles=F.lit(False))
    return found.select("k", "law_type", F.explode("parsed").alias("p")).select("k", "law_type", F.array_join("p", "/").alias("path"))


_KINDS = [("dict", "L1/{}/2"), ("sgb", "SGB-5/{}"), ("sgb", "SGB-12/{}"), ("internal", "OWN/{}/1"), ("ignore", "{}"), ("unknown", "{}"), ("dict", "GG/{}")]


@query(f"SELECT o_orderkey AS k, {[k for k, _ in _KINDS]}[1 + o_orderkey % 7] AS law_type, replace({[p for _, p in _KINDS]}[1 + o_orderkey % 7], '{{}}', CAST(1 + o_custkey AS VARCHAR)) AS path FROM orders")
def german_law_kinds(spark, sf_dir):
    """What stands behind a citation: a known law, a book of the social code, nothing, or a law that nobody knows."""
    behind = ["' Abs. 2 des Auftragsgesetzes'", "' SGB V'", "' des Zwölften Buches Sozialgesetzbuch'", "' Abs. 1 gilt'", "' hier'", "' des Fantasiegesetzes'", "' des Grundgesetzes'"]
    main = F.when(F.col("o_orderkey") % 7 == 4, "siehe Art. ").otherwise("nach § ")
    text = F.concat(main, (1 + F.col("o_custkey")).cast("string"), F.expr(f"element_at(array({', '.join(behind)}), cast(o_orderkey % 7 + 1 as int))"))
    found = german.find_citations(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text")), {german.stem("Auftragsgesetz"): "L1"}, own_law=F.lit("OWN"), articles=F.lit(False))
    return found.select("k", "law_type", F.explode("parsed").alias("p")).select("k", "law_type", F.array_join("p", "/").alias("path"))


@query("SELECT o_orderkey AS k, u.n AS n, u.law AS law FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [{'n': 0, 'law': 'L2'}, {'n': 1, 'law': 'GG'}] ELSE [{'n': 0, 'law': 'L1'}] END) AS u FROM orders)")
def german_law_mentions(spark, sf_dir):
    """Laws that are named alone: the longest name counts, those of citations don't."""
    even = F.lit("Das Gesetz über Aufträge der Länder und das Grundgesetz sowie § 3 des Auftragsgesetzes")
    text = F.when(F.col("o_orderkey") % 2 == 0, even).otherwise("wie im Auftragsgesetz und Gesetz über Aufträge")
    names = {german.stem("Auftragsgesetz"): "L1", german.stem("Gesetz über Aufträge der Länder"): "L2", german.stem("über Aufträge der Länder"): "L3"}
    found = german.find_mentions(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text")), names)
    return found.select("k", F.col("ref_pos").alias("n"), F.col("citekey").alias("law"))


@query("SELECT o_orderkey AS k, 'LAW' || o_custkey AS law FROM orders WHERE o_orderkey % 4 IN (0, 1, 2) AND o_orderkey % 5 > 0")
def administrative_references(spark, sf_dir):
    """References of a law's entry to the laws that empower it, by type and name."""
    kinds = "array('Ermächtigung', 'Rechtsgrundlage', 'Durchführungsvorschrift', 'Sonderregelung')"
    entries = F.expr(f"to_json(array(struct(element_at({kinds}, cast(o_orderkey % 4 + 1 as int)) as typ, cast(null as string) as enbez, if(o_orderkey % 5 > 0, concat('Gesetz ', o_custkey), null) as normabk)))")
    given = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), entries.alias("verweise"))
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("gesetz "), F.col("o_custkey").cast("string")).alias("name"), F.concat(F.lit("LAW"), F.col("o_custkey").cast("string")).alias("citekey")).distinct()
    return statutes.entry_references(given, "k", "verweise", names).select("k", F.col("path")[0].alias("law"))


@query(
    """WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER () AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, u.path FROM (SELECT *, CASE (l_orderkey + l_linenumber) % 5
 WHEN 0 THEN ['cfr' || (1 + l_suppkey % 50) || '/' || l_partkey || '/a', 'cfr' || (1 + l_suppkey % 50) || '/' || (l_partkey + 1)] WHEN 1 THEN ['12/' || l_partkey, '12/' || (l_partkey + 5)] WHEN 2 THEN ['9/' || l_partkey || '/b/2']
 WHEN 3 THEN ['cfr3/' || l_partkey] ELSE ['7/' || l_partkey, '8/' || (l_partkey + 2)] END AS ps FROM lineitem), LATERAL (SELECT unnest(ps) AS path) u"""
)
def citation_shapes(spark, sf_dir):
    """Ranges, "et seq.", section signs, other titles and codes: the paths that each shape names."""
    shapes = """array(concat('in ', 1 + l_suppkey % 50, ' CFR ', l_partkey, '(a) through ', l_partkey + 1, ' there'), concat('in 12 U.S.C. §§ ', l_partkey, ' to ', l_partkey + 5, ' et seq.'), concat('in section ', l_partkey, '(b)(2) of title 9.'),
      concat('in section ', l_partkey, ' of title 3 of the Code of Federal Regulations.'), concat('in 7 U.S.C. ', l_partkey, ' and ', l_partkey + 2, ' of title 8.'))"""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.element_at(F.expr(shapes), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 + 1).cast("int")).alias("text"))
    found = citations.find_citations(li, title=F.lit(40))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode("parsed").alias("p")).withColumn("path", F.array_join("p", "/")).drop("p")
