"""All queries by name, and their SQL.

The operators take legal documents; on the driver's star schema each query applies one of them to whole tables that
have the same shape: orders and line items are versions and references, parts and events are dictionaries and
observations, documents and conversations are texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import citations, german, similarity
from citeloom.functions import text as tx
from citeloom.operators import alignment, graph, lineage, lookup, ordered, temporal
from citeloom.plans import documents  # noqa: F401  registers its queries
from citeloom.plans.base import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES", "flagship"]

def sides(spark: SparkSession, sf_dir: str, prepared: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents as two snapshots: place, key, citekey, normalised text. In the later one English texts have lost their
    last word, French ones have gained one, Spanish ones have another first word, German ones are the same.
    ``prepared`` writes the normalised texts first, for what reads them several times."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("citekey"), tx.normalise(F.col("text")).alias("text"))
    d = lineage.prepared(d) if prepared else d
    later = F.when(F.col("lang") == "en", tx.clip_last_token(F.col("text"))).when(F.col("lang") == "fr", F.concat("text", F.lit(" fin"))).when(F.col("lang") == "es", F.concat(F.lit("cambio "), tx.clip_first_token(F.col("text")))).otherwise(F.col("text"))
    side = lambda name, text: d.select(F.col("doc_id").alias("pos"), F.concat(F.lit(name), F.col("doc_id").cast("string")).alias("key"), "citekey", text.alias("text"))
    return side("x_", F.col("text")), side("x_", later)


_SPACE = r"'\s+'"
_SIDES = rf"""d AS (SELECT doc_id, lang, source AS citekey, trim(lower(regexp_replace(text, {_SPACE}, ' ', 'g'))) AS text FROM documents), a AS (SELECT 'x_' || doc_id AS key, citekey, text FROM d),
b AS (SELECT 'x_' || doc_id AS key, citekey, CASE lang WHEN 'en' THEN regexp_replace(text, ' [^ ]*$', '') WHEN 'fr' THEN text || ' fin' WHEN 'es' THEN 'cambio ' || CASE WHEN contains(text, ' ') THEN substr(text, strpos(text, ' ') + 1) ELSE text END ELSE text END AS text FROM d)"""


# -- functions ------------------------------------------------------------------------------------------------------


@query(
    rf"""SELECT doc_id, length(text) AS chars_n, length(regexp_replace(text, {_SPACE}, '', 'g')) AS chars_nowhites,
  len(list_filter(regexp_split_to_array(text, {_SPACE}), lambda x: x <> '')) AS tokens_n,
  len(list_distinct(list_filter(regexp_split_to_array(text, {_SPACE}), lambda x: x <> ''))) AS tokens_unique FROM documents"""
)
def text_statistics(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.chars_n(t).alias("chars_n"), tx.chars_nowhites(t).alias("chars_nowhites"), tx.tokens_n(t).alias("tokens_n"), tx.tokens_unique(t).alias("tokens_unique"))


@query(rf"SELECT doc_id, md5(trim(lower(regexp_replace(text, {_SPACE}, ' ', 'g')))) AS digest FROM documents")
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalise(F.col("text"))).alias("digest"))


@query("SELECT conv_id, turn, md5(CASE WHEN contains(text, ' ') THEN substr(text, strpos(text, ' ') + 1) ELSE text END) AS digest FROM conversations")
def clipped_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.clip_first_token(F.col("text"))).alias("digest"))


@query(
    """SELECT p_partkey, repeat('0 ', greatest(4 - length(CAST(p_size AS VARCHAR)), 0)) || p_size AS sortable, lower(p_name) AS heading_start,
  regexp_replace(p_brand, '[^A-Za-z0-9_]', '-', 'g') AS prefix, CAST(p_size AS VARCHAR) || '_' || p_type AS citekey FROM part"""
)
def key_functions(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        tx.sortable_number(c("p_size").cast("string")).alias("sortable"),
        tx.heading_start(c("p_name")).alias("heading_start"),
        tx.key_prefix(c("p_brand")).alias("prefix"),
        tx.statute_citekey(c("p_size"), c("p_type")).alias("citekey"),
    )


# texts of seven shapes: each has its kinds, its number and the keys of its leading groups
_SHAPES = [("(3)(b) x", "arabic-double-bracket", "3", "_3,_3_b"), ("(b) x", "alpha-lower-double-bracket", "b", "_b"), ("(BB) x", "alpha-upper-double-bracket", "BB", "_BB"), ("(iv) x", "roman-lower-double-bracket", "iv", "_iv"), ("(ii) x", "alpha-lower-double-bracket,roman-lower-double-bracket", "ii", "_ii"), ("no number", "", "", ""), ("(k)(1)(A) x", "alpha-lower-double-bracket", "k", "_1,_1_A")]
_pick = lambda i: "[" + ", ".join(repr(x[i]) for x in _SHAPES) + "][1 + l_partkey % 7]"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {_pick(1)} AS kinds, {_pick(2)} AS number, array_to_string(list_transform(list_filter(string_split({_pick(3)}, ','), lambda x: x <> ''), lambda x: l_orderkey || '_k' || x), ',') AS keys FROM lineitem"""
)
def numbering(spark, sf_dir):
    text = F.element_at(F.array(*(F.lit(x[0]) for x in _SHAPES)), (F.col("l_partkey") % 7 + 1).cast("int"))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.col("l_orderkey").cast("string"), F.lit("_k")).alias("parent"), text.alias("t"))
    t = t.withColumn("groups", tx.leading_groups(F.col("t")))
    keys = tx.detailed_of_groups(F.col("parent"), F.col("groups"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(tx.bracket_number_types(F.col("t")), ",").alias("kinds"), F.coalesce(tx.bracket_number(F.col("t")), F.lit("")).alias("number"), F.array_join(keys, ",").alias("keys"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderstatus = 'F' AS flag FROM orders")
def date_functions(spark, sf_dir):
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.compact_date(tx.iso_date(compact)).alias("compact"), tx.iso_date(compact).alias("iso"), tx.to_bool(F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("n")).alias("flag"))


# citations are put into texts from line items, since the tables have none
_CITED = "'see ' || (1 + l_suppkey % 50) || ' U.S.C. ' || l_partkey || '(a)(' || l_linenumber || ') and ' || (l_partkey + 1) || ', or section ' || l_orderkey || ' of this title'"


def cited(spark, sf_dir):
    text = F.expr("concat('see ', 1 + l_suppkey % 50, ' U.S.C. ', l_partkey, '(a)(', l_linenumber, ') and ', l_partkey + 1, ', or section ', l_orderkey, ' of this title')")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.alias("text"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, r.pattern, r.path FROM (SELECT *, unnest([
  {'pattern': 'block', 'path': (1 + l_suppkey % 50) || '/' || l_partkey || '/a/' || l_linenumber}, {'pattern': 'block', 'path': (1 + l_suppkey % 50) || '/' || (l_partkey + 1)},
  {'pattern': 'inline', 'path': '7/' || l_orderkey}]) AS r FROM lineitem)"""
)
def citation_paths(spark, sf_dir):
    found = citations.find_citations(cited(spark, sf_dir), title=F.lit(7))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pattern", F.explode("parsed").alias("p")).withColumn("path", F.array_join("p", "/")).drop("p")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 AS n, (1 + l_suppkey % 50) || ' U.S.C. ' || l_partkey || '(a)(' || l_linenumber || ') and ' || (l_partkey + 1) AS area FROM lineitem")
def block_citations(spark, sf_dir):
    found = cited(spark, sf_dir).withColumn("areas", citations.block_citations(F.col("text")))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("areas").alias("n"), F.regexp_replace(F.get("areas", F.lit(0)), r",?\s*$", "").alias("area"))


@query(
    """SELECT o_orderkey, u.path FROM (SELECT o_orderkey, unnest(['LAW/' || (1 + o_custkey) || '/2/' || (1 + o_orderkey % 9), 'LAW/' || (1 + o_custkey) || '/3']) AS path FROM orders) u"""
)
def german_citation_paths(spark, sf_dir):
    text = F.expr("concat('nach § ', 1 + o_custkey, ' Abs. 2 Nr. ', 1 + o_orderkey % 9, ', Abs. 3 des Auftragsgesetzes gilt')")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    found = german.find_citations(rows, {german.stem("Auftragsgesetz"): "LAW"})
    return found.select("o_orderkey", F.explode("parsed").alias("p")).select("o_orderkey", F.array_join("p", "/").alias("path"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(jaro_winkler_similarity(a.n_name || ' of the world', b.n_name || ' in the world'), 9) AS sim FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def jaro_winkler(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), "n_regionkey", F.concat("n_name", F.lit(" of the world")).alias("x"))
    b = n.select(F.col("n_nationkey").alias("b"), "n_regionkey", F.concat("n_name", F.lit(" in the world")).alias("y"))
    return a.join(b, "n_regionkey").select("a", "b", F.round(similarity.jaro_winkler_column("x", "y"), 9).alias("sim"))


# -- lookups --------------------------------------------------------------------------------------------------------

# references are paths of type, size and brand; the dictionary has some prefixes of two and of three components
_DICTIONARY = """dictionary AS (SELECT citekey, min(key) AS key FROM (
  SELECT p_type || '_' || p_size AS citekey, p_partkey AS key FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_type || '_' || p_size || '_' || p_brand, p_partkey FROM part WHERE p_size % 3 = 0) GROUP BY citekey)"""


def dictionary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    two = p.where("p_size % 2 = 0").select(F.concat_ws("_", "p_type", F.col("p_size").cast("string")).alias("citekey"), F.col("p_partkey").alias("key"))
    three = p.where("p_size % 3 = 0").select(F.concat_ws("_", "p_type", F.col("p_size").cast("string"), "p_brand").alias("citekey"), F.col("p_partkey").alias("key"))
    return lookup.first_wins(two.unionByName(three), "citekey", "key", ["key"])


def paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array("p_type", F.col("p_size").cast("string"), "p_brand", "p_name").alias("path"))


@query(f"WITH {_DICTIONARY} SELECT p_partkey, coalesce(b.key, a.key) AS key FROM part LEFT JOIN dictionary b ON b.citekey = p_type || '_' || p_size || '_' || p_brand LEFT JOIN dictionary a ON a.citekey = p_type || '_' || p_size WHERE coalesce(b.key, a.key) IS NOT NULL")
def resolve_longest_prefix(spark, sf_dir):
    return lookup.resolve_longest(paths(spark, sf_dir), dictionary(spark, sf_dir), "path", ["p_partkey"])


@query(f"WITH {_DICTIONARY} SELECT p_partkey, key FROM part JOIN dictionary ON citekey = p_type || '_' || p_size")
def resolve_fixed_prefix(spark, sf_dir):
    return lookup.resolve_fixed(paths(spark, sf_dir), dictionary(spark, sf_dir), "path", ["p_partkey"])


@query(
    f"""WITH {_DICTIONARY}, roots AS (SELECT p_type AS citekey, min(p_partkey) AS key FROM part GROUP BY p_type)
SELECT p_partkey, key FROM part JOIN dictionary ON citekey = p_type || '_' || p_size WHERE p_size > 10
UNION ALL SELECT p_partkey, key FROM part JOIN roots ON citekey = p_type WHERE p_size <= 10"""
)
def resolve_authorities(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    refs = p.select("p_partkey", F.when(F.col("p_size") > 10, F.array("p_type", F.col("p_size").cast("string"))).otherwise(F.array("p_type")).alias("path"))
    roots = p.groupBy(F.col("p_type").alias("citekey")).agg(F.min("p_partkey").alias("key"))
    return lookup.resolve_authority(refs, dictionary(spark, sf_dir), roots, "path", ["p_partkey"])


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def first_and_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = lookup.first_wins(o, "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"]).withColumnRenamed("o_orderkey", "first_order")
    return first.join(lookup.last_wins(o, "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"]).withColumnRenamed("o_orderkey", "last_order"), "o_custkey")


@query("SELECT o_totalprice, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_totalprice HAVING count(*) = 1")
def unique_values(spark, sf_dir):
    return lookup.unique_values(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


@query("SELECT c_nationkey, array_to_string(list(c_custkey ORDER BY c_custkey), ',') AS keys FROM customer GROUP BY c_nationkey")
def keys_by_value(spark, sf_dir):
    found = lookup.keys_by_value(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")
    return found.select("c_nationkey", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query(
    """WITH names AS (SELECT n_name || ' ' || y AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE n_nationkey + y END AS citekey FROM nation, (VALUES (1990), (2000)) t(y))
SELECT name, citekey FROM names UNION ALL SELECT n_name, n_nationkey FROM nation WHERE n_nationkey % 2 = 0"""
)
def short_law_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("y", F.explode(F.array(F.lit(1990), F.lit(2000))))
    names = n.select(F.concat_ws(" ", "n_name", F.col("y").cast("string")).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + F.col("y")).alias("citekey"))
    return lookup.with_short_names(names, tx.short_law_name(F.col("name")))


@query("SELECT s_suppkey, coalesce(k.kind, NULL) AS kind FROM supplier LEFT JOIN (SELECT s_nationkey % 7 AS m, CASE WHEN max(s_nationkey) > 20 THEN 'regulation' ELSE 'statute' END AS kind FROM supplier GROUP BY 1) k ON s_nationkey % 7 = k.m")
def kind_by_list(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 7).cast("string").alias("file"), "s_nationkey")
    lists = s.select(F.col("file").alias("id"), F.when(F.col("s_nationkey") > 20, "regulation").otherwise("statute").alias("kind"), F.col("s_nationkey").alias("rank"))
    return lookup.kind_by_list(s, "file", lists).select("s_suppkey", "kind")


# -- time -----------------------------------------------------------------------------------------------------------

_VERSIONS = """versions AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, coalesce(CAST(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) - 1, DATE '2003-12-31') AS e FROM orders)"""


def versions(spark, sf_dir):
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    nxt = F.lead("d").over(Window.partitionBy("o_custkey").orderBy("d", "o_orderkey"))
    return o.withColumn("e", F.coalesce(F.date_sub(nxt, 1), F.lit("2003-12-31").cast("date")))


@query(f"WITH {_VERSIONS}, days AS (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) AS day FROM orders) SELECT strftime(day, '%Y-%m-%d') AS day, o_custkey, o_orderkey FROM days JOIN versions ON d <= day AND e >= day")
def valid_versions(spark, sf_dir):
    v = versions(spark, sf_dir)
    days = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "year").alias("day")).distinct()
    return temporal.valid_at(days, v, "day", "d", "e", bucket_of=F.year).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "o_custkey", "o_orderkey")


# some versions end late, so that a date can have several
@query(f"WITH {_VERSIONS}, days AS (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) AS day FROM orders) SELECT day, o_custkey, count(*) AS n FROM days JOIN versions ON d <= day AND e + CASE WHEN o_orderkey % 3 = 0 THEN 300 ELSE 0 END >= day GROUP BY ALL HAVING count(*) > 1")
def several_versions(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "year").alias("day")).distinct()
    return temporal.several_versions(temporal.valid_at(days, versions(spark, sf_dir).withColumn("e", F.when(F.col("o_orderkey") % 3 == 0, F.date_add("e", 300)).otherwise(F.col("e"))), "day", "d", "e", bucket_of=F.year), "day", "o_custkey")


@query(
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, (SELECT max(r.l_shipdate) FROM lineitem r WHERE r.l_suppkey = l.l_suppkey AND r.l_returnflag = 'R' AND r.l_shipdate <= l.l_shipdate) AS since FROM lineitem l"""
)
def latest_before(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    left = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    right = li.where("l_returnflag = 'R'").select("l_suppkey", F.col("l_shipdate").alias("since")).distinct()
    return temporal.as_of(left, right, "l_suppkey", "l_shipdate", "since", ["since"])


# nine rows of ten have one key, which is split over tasks
@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_partkey % 10 = 0 THEN l_suppkey ELSE -1 END AS k FROM lineitem),
r AS (SELECT CASE WHEN l_partkey % 10 = 0 THEN l_suppkey ELSE -1 END AS k, l_shipdate AS since, max(l_orderkey) AS latest FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.k, r.since, r.latest FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.l_shipdate >= r.since"""
)
def latest_before_in_hot_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.when(F.col("l_partkey") % 10 == 0, F.col("l_suppkey")).otherwise(-1))
    left = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "k")
    right = li.where("l_returnflag = 'R' and l_linenumber = 1").groupBy("k", F.col("l_shipdate").alias("since")).agg(F.max("l_orderkey").alias("latest"))
    return temporal.as_of(left, right, "k", "l_shipdate", "since", ["since", "latest"], hot_rows=2_000)


@query(
    """WITH have AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), ends AS (SELECT o_custkey, min(y) AS lo, max(y) AS hi FROM have GROUP BY 1),
spine AS (SELECT o_custkey, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS to_year FROM ends)
SELECT s.o_custkey, s.to_year, (SELECT max(y) FROM have h WHERE h.o_custkey = s.o_custkey AND h.y < s.to_year) AS from_year FROM spine s WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.o_custkey = s.o_custkey AND h.y = s.to_year)"""
)
def carry_forward(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    return temporal.carry_forward(o, ["o_custkey"], "y")


@query("WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), p AS (SELECT y, lead(y, 2) OVER (ORDER BY y) AS next FROM y) SELECT * FROM p WHERE next IS NOT NULL")
def snapshot_pairs(spark, sf_dir):
    return temporal.snapshot_pairs(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")), "y", 2)


@query(
    """WITH laws AS (SELECT s_name AS citename, s_nationkey AS citekey, 1 + s_suppkey % 20 AS "start", 5 + s_suppkey % 20 AS "end", s_suppkey AS filename FROM supplier),
n AS (SELECT 'name' || (filename % 3) AS citename, citekey, "start", "end", filename FROM laws), d AS (SELECT DISTINCT "start" AS date FROM n)
SELECT date, citename, arg_max(citekey, (filename, citekey)) AS citekey FROM d JOIN n ON "start" <= date AND "end" >= date GROUP BY ALL"""
)
def names_by_date(spark, sf_dir):
    k = F.col("s_suppkey")
    laws = table(spark, sf_dir, "supplier").select(F.concat(F.lit("name"), (k % 3).cast("string")).alias("citename"), F.col("s_nationkey").alias("citekey"), (1 + k % 20).alias("start"), (5 + k % 20).alias("end"), k.alias("filename"))
    return temporal.names_by_date(laws)


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, max(o_orderkey) AS largest, min(o_custkey) AS least FROM orders GROUP BY 1")
def files_per_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("largest"), F.min("o_custkey").alias("least"))


# -- order ----------------------------------------------------------------------------------------------------------

_RUNS = "l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) % 4 AS level, l_orderkey * 100 + l_linenumber AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos, l_partkey FROM lineitem)"


def lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = ordered.numbered(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "pos")
    return n.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 4).alias("level"), (F.col("l_orderkey") * 100 + F.col("pos")).alias("key"), "pos", "l_partkey")


@query(f"WITH {_RUNS} SELECT a.l_orderkey * 100 + a.pos AS key, (SELECT max(b.l_orderkey * 100 + b.pos) FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.pos < a.pos AND b.level < a.level) AS parent_key FROM l a")
def parents_by_level(spark, sf_dir):
    return ordered.parents_by_level(lines(spark, sf_dir), "l_orderkey", "pos", "level", "key").select("key", "parent_key")


@query(f"WITH {_RUNS} SELECT a.l_orderkey * 100 + a.pos AS key, (SELECT string_agg(CAST(b.pos AS VARCHAR), ',' ORDER BY b.pos) FROM l b WHERE b.l_orderkey = a.l_orderkey AND abs(b.pos - a.pos) <= 2 AND b.level = a.level) AS near FROM l a")
def neighbourhood(spark, sf_dir):
    found = ordered.neighbours(lines(spark, sf_dir).withColumn("p", F.col("pos").cast("string")), "l_orderkey", "pos", "p", 2, F.col("level").cast("string"))
    return found.select("key", F.array_join("neighbours", ",").alias("near"))


@query(f"WITH {_RUNS}, x AS (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY pos) AS before FROM l) SELECT l_orderkey * 100 + pos AS key, l_partkey, before FROM x WHERE l_partkey < before")
def out_of_order(spark, sf_dir):
    return ordered.out_of_order(lines(spark, sf_dir), "l_orderkey", "pos", "l_partkey").select("key", "l_partkey", "before")


@query(f"WITH {_RUNS} SELECT l_orderkey * 100 + pos AS key, bool_or(level = 3) OVER (PARTITION BY l_orderkey ORDER BY pos) AS appendix FROM l")
def sticky_flag(spark, sf_dir):
    return ordered.sticky(lines(spark, sf_dir), "l_orderkey", "pos", F.col("level") == 3, "appendix").select("key", "appendix")


@query("SELECT p_partkey, coalesce(p_name = lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey), false) AS merges FROM part")
def same_heading_start(spark, sf_dir):
    return ordered.same_start_as_before(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name").select("p_partkey", "merges")


@query("SELECT l_suppkey, arg_max(l_partkey, (l_extendedprice, -l_partkey)) AS l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem WHERE l_extendedprice > 900 GROUP BY 1")
def best_match(spark, sf_dir):
    return ordered.best_per_key(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice"), "l_suppkey", "l_extendedprice", ["l_partkey"], 900.0)


# -- graphs ---------------------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT CAST(o_custkey AS VARCHAR) AS u, CAST(l_suppkey AS VARCHAR) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def purchases(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return graph.typed_edges(o.join(li, o["o_orderkey"] == li["l_orderkey"]), "o_custkey", "l_suppkey", "reference")


@query(f"WITH {_EDGES} SELECT u, v, count(*) AS weight FROM e GROUP BY ALL")
def edge_weights(spark, sf_dir):
    return graph.weighted(purchases(spark, sf_dir))


@query("WITH d AS (SELECT DISTINCT p_partkey // 2 AS u, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 1000 + p_partkey // 2 END AS v FROM part) SELECT u, v FROM d WHERE u IN (SELECT u FROM d GROUP BY u HAVING count(*) = 1) AND v IN (SELECT v FROM d GROUP BY v HAVING count(*) = 1)")
def one_to_one_pairs(spark, sf_dir):
    half = F.floor(F.col("p_partkey") / 2).cast("long")
    return graph.one_to_one(table(spark, sf_dir, "part").select(half.alias("u"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).otherwise(1000 + half).alias("v")))


_GEO = """nodes AS (SELECT 'r' || r_regionkey AS key, '' AS parent_key, 0 AS level, 'document' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, 'item' FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 2, 'seqitem' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2, 'subseqitem' FROM customer)"""


def geography(spark, sf_dir):
    def level(name, key, parent, prefix, above, depth, kind):
        t = table(spark, sf_dir, name)
        up = F.lit("") if parent is None else F.concat(F.lit(above), F.col(parent).cast("string"))
        return t.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"), up.alias("parent_key"), F.lit(depth).alias("level"), F.lit(kind).alias("type"))

    out = level("region", "r_regionkey", None, "r", "", 0, "document").unionByName(level("nation", "n_nationkey", "n_regionkey", "n", "r", 1, "item"))
    return out.unionByName(level("supplier", "s_suppkey", "s_nationkey", "s", "n", 2, "seqitem")).unionByName(level("customer", "c_custkey", "c_nationkey", "c", "n", 2, "subseqitem"))


@query(f"WITH {_GEO} SELECT CASE WHEN parent_key = '' THEN 'root' ELSE parent_key END AS u, key AS v, 'containment' AS edge_type FROM nodes")
def containment_edges(spark, sf_dir):
    return graph.containment_edges(geography(spark, sf_dir))


@query(f"WITH {_GEO} SELECT CASE WHEN parent_key = '' THEN 'root' ELSE parent_key END AS u, key AS v, 'containment' AS edge_type FROM nodes WHERE type <> 'subseqitem'")
def without_subunits(spark, sf_dir):
    nodes = geography(spark, sf_dir)
    return graph.without_kind(nodes, graph.containment_edges(nodes))[1]


@query(
    f"""WITH {_GEO}, refs AS (SELECT 'c' || o_custkey AS u, 's' || l_suppkey AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'c' || o_custkey, 'n' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
units AS (SELECT key, parent_key AS unit FROM nodes WHERE type = 'subseqitem')
SELECT coalesce(x.unit, u) AS u, v, count(*) AS weight FROM refs LEFT JOIN units x ON x.key = u WHERE coalesce(x.unit, u) <> v GROUP BY ALL"""
)
def quotient_graph(spark, sf_dir):
    """References of parts counted for the units that hold them; those to the own unit go."""
    nodes, o = geography(spark, sf_dir), table(spark, sf_dir, "orders")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    to_suppliers = o.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(name("c", "o_custkey").alias("u"), name("s", "l_suppkey").alias("v"))
    to_nations = o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(name("c", "o_custkey").alias("u"), name("n", "c_nationkey").alias("v"))
    edges = graph.typed_edges(to_suppliers.unionByName(to_nations), "u", "v", "reference")
    return graph.weighted(graph.quotient(edges, nodes.where("type = 'subseqitem'").select("key", F.col("parent_key").alias("unit"))))


@query(f"WITH {_GEO} SELECT key, type FROM nodes WHERE key NOT IN (SELECT parent_key FROM nodes)")
def leaf_nodes(spark, sf_dir):
    nodes = geography(spark, sf_dir)
    return graph.leaves(nodes, graph.containment_edges(nodes)).select("key", "type")


@query(f"WITH RECURSIVE {_GEO}, a(key, ancestor, distance) AS (SELECT key, key, 0 FROM nodes UNION ALL SELECT a.key, n.parent_key, distance + 1 FROM a JOIN nodes n ON n.key = a.ancestor WHERE n.parent_key <> '') SELECT * FROM a")
def ancestor_closure(spark, sf_dir):
    return graph.ancestors(geography(spark, sf_dir))


@query(
    f"""WITH {_GEO}, r AS (SELECT 'c' || o_custkey AS key, 'p' || o_orderpriority AS target FROM orders), up AS (SELECT n.key, n.key AS ancestor FROM nodes n UNION ALL SELECT n.key, n.parent_key FROM nodes n WHERE n.parent_key <> ''
UNION ALL SELECT n.key, p.parent_key FROM nodes n JOIN nodes p ON n.parent_key = p.key WHERE p.parent_key <> '') SELECT ancestor AS u, target AS v, count(*) AS weight FROM r JOIN up USING (key) GROUP BY ALL"""
)
def decision_network(spark, sf_dir):
    closure = graph.ancestors(geography(spark, sf_dir))
    refs = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"), F.concat(F.lit("p"), "o_orderpriority").alias("target"))
    return graph.weighted(graph.decision_references(refs, closure))


# -- alignment ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_SIDES}, x AS (SELECT text, min(key) AS key1 FROM a WHERE length(text) >= 50 GROUP BY text HAVING count(*) = 1), y AS (SELECT text, min(key) AS key2 FROM b WHERE length(text) >= 50 GROUP BY text HAVING count(*) = 1)
SELECT key1, key2, 'text' AS stage FROM x JOIN y USING (text)"""
)
def align_unique_texts(spark, sf_dir):
    return alignment.by_unique_text(*sides(spark, sf_dir))


@query(
    f"""WITH {_SIDES}, x AS (SELECT lower(citekey) AS c, text, min(key) AS key1 FROM a WHERE citekey <> '' GROUP BY ALL HAVING count(*) = 1), y AS (SELECT lower(citekey) AS c, text, min(key) AS key2 FROM b WHERE citekey <> '' GROUP BY ALL HAVING count(*) = 1)
SELECT key1, key2, 'citekey' AS stage FROM x JOIN y USING (c, text)"""
)
def align_citekeys(spark, sf_dir):
    return alignment.by_citekey_and_text(*sides(spark, sf_dir))


@query(
    f"""WITH {_SIDES}, clip AS (SELECT 1 AS s, key, regexp_replace(text, '^[^ ]* ', '') AS text FROM a UNION ALL SELECT 2, key, regexp_replace(text, '^[^ ]* ', '') FROM b),
p AS (SELECT x.key AS key1, y.key AS key2 FROM clip x JOIN clip y ON x.s = 1 AND y.s = 2 AND ((length(x.text) >= 50 AND contains(y.text, x.text)) OR (length(y.text) >= 50 AND contains(x.text, y.text))))
SELECT key1, key2, 'containment' AS stage FROM p WHERE key1 IN (SELECT key1 FROM p GROUP BY key1 HAVING count(*) = 1) AND key2 IN (SELECT key2 FROM p GROUP BY key2 HAVING count(*) = 1)"""
)
def align_containment(spark, sf_dir):
    return alignment.by_containment(*sides(spark, sf_dir, prepared=True))


@query(f"WITH {_SIDES} SELECT a.key AS needle, b.key AS haystack FROM a JOIN b ON length(a.text) >= 50 AND contains(b.text, a.text)")
def containment_join(spark, sf_dir):
    a, b = sides(spark, sf_dir, prepared=True)
    return alignment.contained(a, b)


# similarity of bytes is that of characters if every letter is one byte: those that the texts have beyond ASCII become capitals, which they lack
_LETTERS = "translate({}, 'àâäçèéêëîïôöùûüßñóíáúœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"
# the stages one after another; then rounds, each of which sees all that is mapped so far (recurring.m)
_ALIGNED = rf"""WITH RECURSIVE {_SIDES}, u AS MATERIALIZED (SELECT key, citekey, text, CAST(substr(key, 3) AS BIGINT) AS pos FROM a), v AS MATERIALIZED (SELECT key, citekey, text, CAST(substr(key, 3) AS BIGINT) AS pos FROM b),
s1 AS MATERIALIZED (SELECT key1, key2, 'text' AS stage FROM (SELECT text, min(key) AS key1 FROM u WHERE length(text) >= 50 GROUP BY text HAVING count(*) = 1) JOIN (SELECT text, min(key) AS key2 FROM v WHERE length(text) >= 50 GROUP BY text HAVING count(*) = 1) USING (text)),
s2 AS MATERIALIZED (SELECT key1, key2, 'citekey' AS stage FROM (SELECT lower(citekey) AS c, text, min(key) AS key1 FROM u WHERE citekey <> '' AND key NOT IN (SELECT key1 FROM s1) GROUP BY ALL HAVING count(*) = 1)
  JOIN (SELECT lower(citekey) AS c, text, min(key) AS key2 FROM v WHERE citekey <> '' AND key NOT IN (SELECT key2 FROM s1) GROUP BY ALL HAVING count(*) = 1) USING (c, text)),
m2 AS MATERIALIZED (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
cu AS (SELECT key, regexp_replace(text, '^[^ ]* ', '') AS text FROM u WHERE key NOT IN (SELECT key1 FROM m2)), cv AS (SELECT key, regexp_replace(text, '^[^ ]* ', '') AS text FROM v WHERE key NOT IN (SELECT key2 FROM m2)),
p AS MATERIALIZED (SELECT x.key AS key1, y.key AS key2 FROM cu x JOIN cv y ON (length(x.text) >= 50 AND contains(y.text, x.text)) OR (length(y.text) >= 50 AND contains(x.text, y.text))),
m3 AS MATERIALIZED (SELECT * FROM m2 UNION ALL SELECT key1, key2, 'containment' FROM p WHERE key1 IN (SELECT key1 FROM p GROUP BY key1 HAVING count(*) = 1) AND key2 IN (SELECT key2 FROM p GROUP BY key2 HAVING count(*) = 1)),
free1 AS MATERIALIZED (SELECT key AS key1, pos AS at1, text AS t1, {_LETTERS.format("text")} AS l1 FROM u WHERE key NOT IN (SELECT key1 FROM m3)), free2 AS MATERIALIZED (SELECT key AS key2, pos AS at2, text AS t2, {_LETTERS.format("text")} AS l2 FROM v WHERE text <> '' AND key NOT IN (SELECT key2 FROM m3)),
m(key1, key2, stage) USING KEY (key1) AS (SELECT * FROM m3 UNION SELECT w.key1, w.key2, 'neighbours' FROM (
  SELECT z.key2 AS key2, arg_max(key1, (z.sim, -z.at1)) AS key1 FROM (SELECT key1, arg_max(struct_pack(key2 := key2, at1 := at1, sim := sim), (sim, -at2)) AS z FROM (
    SELECT key1, at1, key2, at2, CASE WHEN t1 = t2 THEN 1.0 ELSE jaro_winkler_similarity(l1, l2) END AS sim FROM (
      SELECT DISTINCT key1, key2 FROM (SELECT CAST(substr(key1, 3) AS BIGINT) AS p1, CAST(substr(key2, 3) AS BIGINT) AS p2 FROM recurring.m) k JOIN free1 x ON abs(p1 - at1) <= 5 JOIN free2 y ON abs(p2 - at2) <= 5
      WHERE key1 NOT IN (SELECT key1 FROM recurring.m) AND key2 NOT IN (SELECT key2 FROM recurring.m)) JOIN free1 USING (key1) JOIN free2 USING (key2)
    WHERE length(t1) >= 0.49 * length(t2) AND length(t2) >= 0.49 * length(t1)) WHERE sim > 0.9 GROUP BY key1) GROUP BY z.key2) w WHERE EXISTS (SELECT 1 FROM m))
SELECT key1, key2, stage FROM m"""


@query(_ALIGNED)
def align_snapshots(spark, sf_dir):
    return alignment.align(*sides(spark, sf_dir, prepared=True))


@query(f"""{_ALIGNED.replace("SELECT key1, key2, stage FROM m", "")}, g AS (SELECT coalesce(stage, 'all') AS stage, count(*) AS n FROM m GROUP BY GROUPING SETS ((stage), ())) SELECT stage, n, n / (SELECT count(*) FROM u) AS share FROM g""")
def alignment_progress(spark, sf_dir):
    """How far each stage of the alignment came."""
    one, two = sides(spark, sf_dir, prepared=True)
    return alignment.progress(lineage.materialize(alignment.align(one, two)), one, two)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_longest_prefix(spark, sf_dir)
