"""DuckDB SQL for the corpus queries that SQL can express, on whole tables."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"coalesce(regexp_extract_all(translate({{}}, '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

URL_FILTER = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{_UP}', '{_LOW}') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), rules(rule, verdict, rhost, rpath) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
    ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN regexp_matches(s.host,
  '(^|[.-])(ads|ads-track|adserver|bets|bonus|casino|casino-win|cheap-pills|free-bets|gambling|jackpot|lottery|payday-loan|pills|poker|porn|slots|spam|spam-farm|viagra|xxx)([.-]|$)')
  THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f ON s.page_id IS NOT DISTINCT FROM f.page_id
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, w[i : i + least(10, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM spots JOIN wins ON w[i : i + n - 1] = win),
spans AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), spots AS (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, hash(w[i : i + least(5, len(w)) - 1]) AS g FROM spots),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

EMBEDDING_NEARDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), ok AS MATERIALIZED (SELECT vec_id, label, e FROM v WHERE CASE WHEN len(e) = 0 OR len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN false ELSE len(list_filter(e, lambda x: x <> 0)) > 0 END),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT m.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept FROM embeddings m
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) k USING (vec_id)
JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) c USING (vec_id)
"""

LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l),
words AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS w FROM raw),
seq AS (SELECT doc_id, i, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM words WHERE w > 0),
s AS (SELECT doc_id, list(line ORDER BY pos) AS lines, list(w ORDER BY pos) AS ws FROM seq GROUP BY doc_id),
spans AS (SELECT x.doc_id, x.pos AS b, y.pos AS e, list_sum(s.ws[x.pos : y.pos]) AS n, list_sum(s.ws[x.pos + 1 : y.pos]) AS n1, list_sum(s.ws[x.pos : y.pos - 1]) AS n2
  FROM seq x JOIN seq y ON x.doc_id = y.doc_id AND y.pos BETWEEN x.pos AND x.pos + 49 JOIN s ON s.doc_id = x.doc_id),
runs AS (SELECT p.doc_id, b, e, s.lines[b : e] AS run FROM spans p JOIN s USING (doc_id) WHERE n >= 50 AND (coalesce(n1, 0) < 50 OR coalesce(n2, 0) < 50)),
firsts AS (SELECT run, min((doc_id, b)) AS f FROM runs GROUP BY run),
cut AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS pos FROM runs JOIN firsts USING (run) WHERE (doc_id, b) > f),
kept AS (SELECT doc_id, count(*) FILTER (WHERE w > 0) AS n_lines, count(cut.pos) AS n_cut, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE cut.pos IS NULL) AS rest
  FROM (SELECT words.doc_id, words.i, words.line, words.w, seq.pos FROM words LEFT JOIN seq USING (doc_id, i)) z LEFT JOIN cut USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_cut, 0) AS n_cut, CASE WHEN d.text IS NULL THEN NULL WHEN coalesce(n_cut, 0) = 0 THEN d.text WHEN n_cut = n_lines THEN '' ELSE coalesce(rest, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""

TOPK_SEARCH = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS MATERIALIZED (SELECT row_number() OVER () AS row_n, vec_id, list_transform(e, lambda x: floor(1024 * x)) AS e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.row_n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND q.row_n <> c.row_n),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY row_n ORDER BY score DESC, vec_id NULLS LAST) AS "rank", vec_id, score FROM pairs)
SELECT query_id, CAST("rank" AS INTEGER) AS "rank", vec_id, score FROM ranked WHERE "rank" <= 10
"""

ORACLES = {
    "op1_url_filter": URL_FILTER,
    "op6_decontaminate": DECONTAMINATE,
    "op7_ngram_join": NGRAM_JOIN,
    "op8_embedding_neardup": EMBEDDING_NEARDUP,
    "op9_line_dedup": LINE_DEDUP,
    "op11_topk_search": TOPK_SEARCH,
}
