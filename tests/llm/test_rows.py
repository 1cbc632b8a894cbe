"""Row-wise operators against brute force, exact round trips and held-out accuracy."""

import math
import time
import random
import struct
import zlib

import numpy as np
import pytest

from citeloom.llm import html_extract, langid, piece, quality, tokencount, urlfilter
from citeloom.llm.queries import QUERIES, tokenizer_path
from citeloom.llm.sql import ORACLES

ODD = [None, "", " ", "\n\t x", "a  b ", "▁a▁b", "é日本語 🎉 \u200b", "<s> </s> <unk> <0x41>", "<|endoftext|> a <|endoftext|>", "a" * 5000, "\x00\x01 \x1c\x85", "don't  stop\r\n\r\n x", "１２３ ²³ Ⅷ", "word " * 30_000]


def random_texts(n=150):
    rnd = random.Random(5)
    return ["".join(rnd.choice("ab ▁\n日é<s>/|0 ") for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_urls(compare, spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://example.net/en/1", "http://www.Example.NET/en", "https://example.com/de/?q", "http://notexample.com/de/", "http://x.org/fr/a#b", "http://net", "http://net/", "http://a.net?x=/", "https://spam.a.org/fr/", "http://org/fr/", "a://b://c.net/d", "http://casino.example.com", "http://ß.NET/É"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(99, "http://casino.org/")], "page_id long, url string")
    compare(QUERIES["op1_url_filter"], {"pages": df}, tmp_path, ORACLES["op1_url_filter"])


def test_url_rules_by_brute_force(spark):
    rnd = random.Random(2)
    hosts = ["a.com", "b.a.com", "com", "c.org", "x.c.org"]
    rules = [urlfilter.host_rule(rnd.choice(["allow", "block"]), f"{h}/{p}") for h in hosts for p in ("", "x", "x/", "x/y")]
    index = urlfilter.RuleIndex(rules)
    for _ in range(300):
        host, path = rnd.choice(hosts + ["d.c.org", "org"]), "/" + rnd.choice(["", "x", "x/y/z", "xy", "z"])
        fits = [r for r in rules if (host == r.name.split("/")[0] or host.endswith("." + r.name.split("/")[0])) and path.startswith("/" + r.name.split("/", 1)[1])]
        best = max(fits, key=lambda r: (len(r.name), r.name), default=None)
        assert index.match(host, path) == best
    out = urlfilter.filter_urls(spark.createDataFrame([("http://a.com/", 1)], "url string, rule int"), rules)
    assert out.columns == ["url", "host", "path", "rule", "verdict"]
    assert urlfilter.filter_urls(out.where("false"), rules).count() == 0


ARTICLE = "<article><h1>A &amp; B</h1><p>One  two&nbsp;three<br>four<p>Next <b>bold</b> <a href=x>link</a>.</article>"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        (f"<html><body><nav><a href=1>m</a></nav>{ARTICLE}<footer>f</footer>", "A & B\nOne two three four\nNext bold link."),
        (f"<body><div class='sidebar'>side</div><div id=comments><p>nice</p></div>{ARTICLE}<script>var a='</p>'</script><!-- c --><form>f</form>", "A & B\nOne two three four\nNext bold link."),
        ("<body><ul><li><a href=1>one</a><li><a href=2>two</a></ul><div><p>Long text of an article that goes on and on.</p><p>More of the same long text here.</p></div><div class=footer>x</div>", "Long text of an article that goes on and on.\nMore of the same long text here."),
        ("<body><script>x</script></body>", ""),
        ("<p>cut off &am", "cut off &am"),
    ],
)
def test_html(page, want):
    assert html_extract.extract_text(page) == want


def test_html_deep_and_long():
    assert html_extract.extract_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_extract.extract_text("<body><article>" + "<p>w w</p>" * 20_000).count("\n") == 19_999


@pytest.mark.parametrize(
    "piece, other",
    [("<b>", "</i>"), ('<a "x', ""), ("<b>", "<p>x</p>"), ("<b>", "<article>"), ("<form>", "<article></article>"), ("<i><div><b>", "</i>"), ("<tr>", "<td>"), ("<a", "'"), ("<div>x", ""), ("</b '", '<i "')],
)
def test_html_time_grows_with_the_length(piece, other):
    """Twelve times the page takes far less than its square: once unclosed elements and quotes made it quadratic."""

    def took(n):
        page = piece * n + other * n
        best = math.inf
        for _ in range(3):
            began = time.process_time()
            html_extract.extract_text(page)
            best = min(best, time.process_time() - began)
        return best

    assert took(12_000) < 40 * took(1_000) + 0.1


def test_html_unclosed_quotes():
    """A tag whose quotes or end are missing is text; tags after it are read as tags wherever their own quotes end."""
    assert html_extract.extract_text("<p>a</p><b \"<p>c</p><p title='>'>d</p>") == 'a\n<b "\nc\nd'
    assert html_extract.extract_text("<p>a<i 'b<i \"c") == "a<i 'b<i \"c"


def test_html_junk_within_an_article():
    """Reader comments, notices, sign-ups and sharing go from an article; headers too, if they don't hold its heading."""
    long = "Long text of an article that goes on and on, and has no links at all."
    junk = [f"<section id=comments><h2>Comments</h2><p>{long}</p></section>", "<div class=notice>n</div>", "<div class='newsletter-signup'>s</div>", "<div class=share>s</div>", "<header>by me</header>", "<div class='related-posts'>r</div>"]
    page = f"<body><article><header><h1>Title</h1></header><p>{long}</p>{''.join(junk)}<section id='notices'><p>{long}</p></section></article></body>"
    assert html_extract.extract_text(page) == "\n".join(["Title", long, long])


def test_html_ambiguous_names_within_an_article(monkeypatch):
    """They go if they are less dense than the threshold; the same box full of text stays."""
    long = "Long text of an article that goes on and on, and has no links at all. " * 3
    box = lambda inner: f"<body><article><p>{long}</p><p>{long}</p><div class='promo x1'>{inner}</div></article></body>"
    thin = "".join(f"<i>w{i}</i>" for i in range(30))
    assert html_extract.extract_text(box(thin)) == "\n".join([long.strip()] * 2)
    assert html_extract.extract_text(box(f"<p>{long}</p>")) == "\n".join([long.strip()] * 3)
    monkeypatch.setattr(html_extract, "composite_density", lambda *counts: 1.0)
    assert "w7" in html_extract.extract_text(box(thin))


PARTS = "<h1 class='entry-header'>Title</h1><p class='skip-first'>First words here.</p><section id='search-algorithms'><h2 id='comments'>Comments in code</h2><p>They say why.</p></section><figure><table><tr><td>cell</td></tr></table><figcaption>A caption</figcaption></figure><h2><button>Folded</button></h2><object>fallback</object>"
WHOLE = "Title\nFirst words here.\nComments in code\nThey say why.\ncell\nA caption\nFolded\nfallback"
JUNK = "<div class='ad'>buy</div><ul class='nav-menu menu'><li>m</ul><div id='comments'>me too</div><div class='cookie-notice'>ok</div><dialog>closed</dialog>"


def test_html_keeps_what_only_sounds_like_boilerplate():
    assert html_extract.extract_text(f"<body><article>{PARTS}{JUNK}</article></body>") == WHOLE
    assert html_extract.extract_text(f"<body><div class='search-page has-sidebar'><main>{PARTS}{JUNK}</main></div></body>") == WHOLE


def test_html_names_without_article():
    long = "Long text of a page that goes on and on, and has no links at all."
    links = "<a href=1>one</a> <a href=2>two</a> <a href=3>three</a>"
    page = f"<body><ul><li><a href=1>m</a></ul><div><h2 id='notice'>Heading of some length</h2><p class='tags-intro'>{long}</p><section id='search-algorithms'>{long}</section><p>{long}</p><div class='share'>{links}</div></div><div class='footer'>{long}</div></body>"
    assert html_extract.extract_text(page) == "\n".join(["Heading of some length", long, long, long])


def test_html_density_decides(monkeypatch):
    """Densities pick the best subtree and the threshold, also within an article; other densities give other texts."""
    long = "Long text of a page that goes on and on, and has no links at all."
    links = "".join(f"<b><a href={i}>link {i}</a></b>" for i in range(9))
    page = f"<body><article><h1>Title</h1><div>{links}</div><section><p>{long}</p><p>{long}</p></section><div>{long} <a href=x>See</a></div>.</article></body>"
    plain = f"<body><div>{links}</div><div><p>{long}</p><p>{long}</p></div></body>"
    assert html_extract.extract_text(page) == "\n".join(["Title", long, long, f"{long} See", "."])
    assert html_extract.extract_text(plain) == "\n".join([long, long])
    monkeypatch.setattr(html_extract, "composite_density", lambda *counts: 1.0)
    assert "link 3" in html_extract.extract_text(page) and "link 3" in html_extract.extract_text(plain)


def test_html_densities_by_brute_force():
    """Counts of a subtree by walking it anew for every node, densities by the formula written out."""
    root = html_extract.parse("<body><div><p>ab cd<a href=1>ef</a></p><p>gh<b>ij <i>kl</i></b></p></div><ul><li><a href=2>mno</a></li></ul></body>")

    def walk(node):
        yield node
        for c in node.children():
            yield from walk(c)

    def letters(node):
        return len("".join("".join(x for x in n.items if isinstance(x, str)) for n in walk(node)).replace(" ", ""))

    for node in html_extract._measure(root):
        below = list(walk(node))
        link = [n for n in below if n.tag == "a"]
        want = letters(node), len(below) - 1, sum(letters(n) for n in link), sum(n is not node for n in link)
        assert (node.chars, node.tags, node.link_chars, node.link_tags) == want
        c, t, lc, lt = want
        base = math.log(c / max(c - lc, 1) * max(lc, 1) + 5 / 15 * c + math.e)
        density = c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / math.log(base)
        assert abs(html_extract.composite_density(c, t, lc, lt, 15, 5) - density) < 1e-12


def test_html_within_a_form():
    assert html_extract.extract_text(f"<body><form id=f><input>{ARTICLE}</form><form><p>Name<input></p></form></body>") == "A & B\nOne two three four\nNext bold link."
    assert html_extract.extract_text("<body><form><div><p>One two.</p><p>Three.</p></div></form></body>") == "One two.\nThree."
    assert html_extract.extract_text("<body><form><label>Search</label><input></form></body>") == ""


def test_html_tables(spark):
    rows = [(1, "<p>one</p>", "x"), (1, "<p>one</p>", "x"), (2, None, "y"), (3, f"<body><p title='{'t' * 200_000}'>two</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted(map(tuple, html_extract.extract_pages(df).select("page_id", "text", "n_chars").collect())) == [(1, "one", 3), (1, "one", 3), (2, "", 0), (3, "two", 3)]
    assert html_extract.extract_pages(df.where("false")).count() == 0


def test_html_query(spark, sf):
    rows = QUERIES["op2_html_extract"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


def test_pieces_parity_and_round_trip(spark, sf):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = [t or "" for t in ODD] + random_texts() + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert piece.verify_parity(path, texts) == []
    c = piece.codec(path)
    assert [c.normal(t) for t in texts] == c.decode(c.encode(texts))
    whole = [x.ids for x in c.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert whole == [x.tolist() for x in c.encode(texts)]


def test_piece_columns(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    path = tokenizer_path("piece_bpe_32k.model")
    coded = piece.encode_texts(df, path)
    rows = sorted(piece.decode_ids(coded, path).collect())
    assert all(r["round_trip"] and len(r["token_ids"]) == r["n_tokens"] for r in rows)
    assert [r["decoded"] for r in rows] == [piece.codec(path).normal(t) for t in ODD]
    assert piece.encode_texts(df.where("false"), path).count() == 0


def test_unigram_model_is_rebuilt():
    model = piece.Model(pieces=[("<unk>", 0.0, piece.UNKNOWN), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -2.0, 1), ("b", -2.0, 1)], model_type=piece.UNIGRAM, remove_extra_whitespaces=False)
    assert piece.build(model).encode("ab b", add_special_tokens=False).tokens == ["▁ab", "▁", "b"]


def _message(*fields):
    """A protobuf message of (number, value) fields: whole numbers, floats, bytes."""
    out = b""

    def varint(n):
        return (bytes([n & 127 | 128]) + varint(n >> 7)) if n > 127 else bytes([n])

    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_parity(tmp_path, squeeze, fallback):
    """A unigram model written by hand gives the same ids and texts in both libraries."""
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abé▁") for _ in range(n)) for n in (1, 1, 1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4) for _ in range(4)} | set("abé▁"))
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if fallback else []
    pieces += [(w, -rnd.random() * 4 * len(w) - 0.01, 1) for w in words]
    model = b"".join(_message((1, _message((1, p.encode()), (2, score), (3, kind)))) for p, score, kind in pieces)
    model += _message((2, _message((3, 1), (35, int(fallback)))), (3, _message((1, b"identity"), (3, 1), (4, int(squeeze)), (5, 1))))
    (tmp_path / "unigram.model").write_bytes(model)
    texts = ["", "a", "ab ba", "  a  b ", "é日 x", "🎉🎉", "zz b", "a\tb", "abé " * 2000] + ["".join(rnd.choice("abé 日z") for _ in range(rnd.randrange(30))) for _ in range(300)]
    path = str(tmp_path / "unigram.model")
    assert [texts[i] for i in piece.verify_parity(path, texts)] == []
    known = [all(c in "abé " for c in t) for t in texts]
    assert [ok or not k for k, ok in zip(known, piece.codec(path).encode_and_check(texts)[1], strict=True)] == [True] * len(texts)
    assert fallback or not piece.codec(path).encode_and_check(["a日"])[1][0]


def test_token_counts(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    texts = ODD + random_texts()
    library = tokencount.load_tokenizer(path)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)
    found = tokencount.count_tokens(df, path).select("doc_id", "n_tokens").collect()
    assert [r[1] for r in sorted(found)] == want
    # with an empty table everything is a miss; a lower-casing tokenizer can't be split by the pattern
    assert [r[0] for r in tokencount.count_tokens(df, path, table={}).orderBy("doc_id").select("n_tokens").collect()] == want
    other = tokenizer_path("word_bpe_49k.json")
    counter, whole = tokencount.TokenCounter(other), tokencount.load_tokenizer(other)
    assert [counter.count(t) for t in texts] == [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert tokencount.count_tokens(df.where("false"), path).count() == 0


def test_quality_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = {r["doc_id"]: r for r in QUERIES["op5_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(rows[r["doc_id"]]["held_out"] for r in held)
    right = sum(rows[r["doc_id"]]["predicted"] == r["quality"] for r in held)
    assert right >= 0.93 * len(held)
    good = [r for r in held if r["quality"] == 1]
    assert sum(rows[r["doc_id"]]["predicted"] for r in good) >= 0.97 * len(good)


def test_quality_edges(spark):
    one = quality.fit(["a b c", "d"], [1, 1])
    assert one.score("x") > 0.9
    assert quality.fit([], []).score(None) == 0.5
    m = quality.fit(["good words here", "bad ### *** stuff"] * 5 + [None, ""], [1, 0] * 5 + [1, 0])
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "z " * 20_000, 1)], "doc_id long, text string, score int")
    assert all(0 <= r["score"] <= 1 for r in quality.score_texts(df, m).collect())
    assert m.score("good words here") > m.score("bad ### *** stuff")
    docs, labels = df.select("doc_id", "text"), spark.createDataFrame([(1, None), (3, 1)], "doc_id long, quality int")
    assert quality.train(docs, labels).score("z") > 0.5


def test_language_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in QUERIES["op10_language_id"](spark, sf).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_language_edges(spark):
    m = langid.fit(["the cat and the dog", "der Hund und die Katze", "123", ""], ["en", "de", "en", "de"])
    assert m.langs == ["de", "en"]
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "der Hund " * 9_000, "x"), (5, "ω", "x")], "doc_id long, text string, score string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, m).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[4][0] == "de" and found[5][0] in m.langs and all(0 <= s <= 1 for _, s in found.values())
    assert langid.fit([], []).predict(["text"]) == (["und"], [0.0])
    assert langid.identify(df.where("false"), m).count() == 0


def test_language_by_exact_kernels():
    """Scores equal those of kernels of sets of n-grams, with the ridge regression solved for coefficients of landmarks."""
    rnd = random.Random(8)
    words = {"en": "the cat and dog over house where with".split(), "de": "der Hund und die Katze über Haus wo".split(), "es": "el gato y la perra sobre casa donde".split()}
    langs = [rnd.choice(list(words)) for _ in range(40)]
    texts = [" ".join(rnd.choice(words[n]) for _ in range(rnd.randrange(3, 20))) for n in langs]
    names, ridge, landmarks = sorted(words), 1e-2, 6
    m = langid.fit(texts, langs, landmarks=landmarks, ridge=ridge)
    picked = [t for n in names for t in [t for t, lang in zip(texts, langs, strict=True) if lang == n][: landmarks // 3]]

    def kernels(left, right):
        grams = [[set(langid.presence(t).tolist()) for t in side] for side in (left, right)]
        return np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in grams[1]] for a in grams[0]])

    k, own = kernels(texts, picked), kernels(picked, picked)
    x = np.column_stack([k, np.ones(len(texts))])
    weight = np.diag([len(texts) / (3 * langs.count(n)) for n in langs])
    penalty = np.zeros((landmarks + 1, landmarks + 1))
    penalty[:-1, :-1], penalty[-1, -1] = ridge * len(texts) * own, 1e-9
    y = np.array([[1.0 if n == lang else -1.0 for n in names] for lang in langs])
    coef = np.linalg.solve(x.T @ weight @ x + penalty, x.T @ weight @ y)
    new = ["the dog", "die Katze wo", "perra", "ω", "the gato und", "a " * 3000]
    z = np.column_stack([kernels(new, picked), np.ones(len(new))]) @ coef
    p = np.exp(4 * z) / np.exp(4 * z).sum(axis=1, keepdims=True)
    found, scores = m.predict(new)
    assert np.allclose(scores, p.max(axis=1), atol=1e-4)
    assert [f for f, row in zip(found, z, strict=True) if np.ptp(row) > 1e-3] == [names[row.argmax()] for row in z if np.ptp(row) > 1e-3]


def test_language_repeated_rows(spark):
    m = langid.fit(["the cat and the dog", "der Hund und die Katze"], ["en", "de"])
    df = spark.createDataFrame([(1, "a dog", "x")] * 3 + [(None, "ein Hund", None)], "doc_id long, text string, lang_pred string")
    assert langid.identify(df, m).groupBy("doc_id", "lang_pred").count().count() == 2 and langid.identify(df, m).count() == 4


def test_quality_by_exact_solver():
    """Log-count ratios counted one by one; dual coordinate descent against projected gradient on the whole dual."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc XY#") for _ in range(rnd.randrange(1, 25))) for _ in range(14)]
    y = np.array([1.0, -1.0, -1.0] * 4 + [1.0, -1.0])
    rows = [quality.buckets(t) for t in texts]
    assert all(len(set(r.tolist())) == len(r) for r in rows)
    ratio = quality.log_count_ratio(rows, y, quality.SIZE)
    pos, neg = ([1 + sum(b in r for r, label in zip(map(set, map(list, rows)), y, strict=True) if label == side) for b in (int(rows[0][0]), int(rows[3][-1]))] for side in (1, -1))
    total = [quality.SIZE + sum(len(r) for r, label in zip(rows, y, strict=True) if label == side) for side in (1, -1)]
    want = [math.log(a / total[0]) - math.log(b / total[1]) for a, b in zip(pos, neg, strict=True)]
    assert np.allclose([ratio[rows[0][0]], ratio[rows[3][-1]]], want)

    x = np.zeros((len(rows), quality.SIZE + 1))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / math.sqrt(len(r))
    x[:, -1] = 1.0
    bound = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha, step = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(50_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, bound)
    exact = x.T @ (alpha * y)
    w, bias = quality.dual_descent(rows, y, ratio, epochs=5000)
    assert abs(bias - exact[-1]) < 0.02 and np.allclose(w, exact[:-1] * ratio, atol=0.02)
    margins = quality._margins(rows, w, bias)
    assert np.allclose(margins, x @ exact, atol=0.05)


def test_quality_repeated_and_contradicting_labels(spark):
    docs = spark.createDataFrame([(i % 6, f"{'good words' if i % 2 else '### junk'} {i}", "x") for i in range(24)], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] * 2 + [(0, 1), (1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    m = quality.train(docs.select("doc_id", "text"), labels)
    assert m.score("good words 9") > m.score("### junk 9")
    out = quality.score_texts(docs.unionByName(docs), m)
    assert out.count() == 48 and out.columns == ["doc_id", "text", "quality", "score"]
    assert quality.score_texts(docs.where("false"), m).count() == 0
    assert quality.train(docs.where("false").select("doc_id", "text"), labels.where("false")).score("x") == 0.5
