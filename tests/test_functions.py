import random
import re

import pytest
from pyspark.sql import functions as F

from citeloom.functions import citations, german, similarity
from citeloom.functions import text as tx


@pytest.mark.parametrize(
    "area, paths",
    [
        ("§ 6 Absatz 1 Nummer 2 Buchstabe r, s, t und v", [["6", "1", "2", "r"], ["6", "1", "2", "s"], ["6", "1", "2", "t"], ["6", "1", "2", "v"]]),
        ("§ 6 Absatz 1 Nummer 2 Buchstabe r, s, t, S", [["6", "1", "2", "r"], ["6", "1", "2", "s"], ["6", "1", "2", "t"]]),
        ("§ 6 Absatz 1 Nummer 2 S 4, S 5", [["6", "1", "2", "4"], ["6", "1", "2", "5"]]),
    ],
)
def test_german_paths(area, paths):
    assert german.simple(german.parse_main(area)) == paths


def test_german_areas():
    laws = german.LawNames({german.stem("Bürgerliches Gesetzbuch"): "BGB"})
    found = german.areas("nach § 12 Abs. 1 Satz 2 des Bürgerlichen Gesetzbuchs und Art. 3 sowie § 4", laws, "X", paragraphs=False)
    assert [(f["law_type"], f["parsed"]) for f in found] == [("dict", [["BGB", "12", "1", "2"]]), ("internal", [["X", "3"]]), ("ignore", [["4"]])]
    assert german.areas(None, laws, None) == []


def test_citation_spans():
    text = "see 42 U.S.C. 7401(a) and 7402, or section 3 of this title; 26 CFR Part 1.2 of title 7, section 9 of the Act"
    found = citations.spans(text)
    assert [(p, a) for _, _, p, a in found][:2] == [("block", "42 U.S.C. 7401(a) and 7402"), ("inline", "section 3 of this title")]
    assert all(text[s:e] == a for s, e, _, a in found)
    assert not any("9" in a for *_, a in found)  # what "of" follows isn't marked
    assert citations.spans(None) == citations.spans("") == []


@pytest.mark.parametrize(
    "area, pattern, paths",
    [
        ("42 U.S.C. 7401(a)(1)", "block", [["42", "7401", "a", "1"]]),
        ("42 U.S.C. 7401(a), 7402 of title 7", "block", [["42", "7401", "a"], ["7", "7402"]]),
        ("26 CFR 1.61 through 1.63", "block", [["cfr26", "1.61"], ["cfr26", "1.63"]]),
        ("section 12-14 of this title", "inline", [["9", "12"], ["9", "14"]]),
        ("section 3 of title 7 of the Code of Federal Regulations", "inline", [["cfr7", "3"]]),
        ("sec. 5(b), (c)", "inline", [["9", "5", "b"]]),
    ],
)
def test_citation_paths(area, pattern, paths):
    assert citations.parse_area(area, pattern, 9) == paths


def test_split_block():
    assert citations.split_block("47 CFRSec. 1.1204(b)") == (False, 47, "1.1204(b)")
    assert citations.authority_paths("5 U.S.C. 301; 42 U.S.C. 1302 and 1395") == [[["5", "301"]], [["42", "1302"], ["42", "1395"]]]


def test_jaro_winkler_against_definition():
    def plain(a, b):
        if a == b:
            return 1.0 if a else 0.0
        reach, used, first = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
        for i, c in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if j not in used and b[j] == c:
                    used.add(j)
                    first.append(c)
                    break
        if not first:
            return 0.0
        second = [b[j] for j in sorted(used)]
        m, t = len(first), sum(x != y for x, y in zip(first, second, strict=True)) // 2
        jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
        same = 0
        while same < min(4, len(a), len(b)) and a[same] == b[same]:
            same += 1
        return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro

    rnd = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(12))) for _ in range(2))
        assert abs(similarity.jaro_winkler(a, b) - plain(a, b)) < 1e-12


def test_text_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("YES",), ("true",), ("No",), (None,)], "v string")
    assert [r[0] for r in df.select(tx.to_bool(F.col("v"))).collect()] == [True, True, False, None]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("hell!",)], "v string").select(tx.to_bool(F.col("v"))).collect()
    one = spark.range(1)
    row = one.select(
        tx.normalise(F.lit(" A  B\n c ")).alias("n"),
        tx.section_number(F.lit("§ 12a Titel")).alias("s"),
        tx.short_law_name(F.lit("Gesetz 2001-2")).alias("l"),
        tx.detailed_citekeys(F.lit("42_7"), F.lit("(7)(a) (1) text")).alias("d"),
        tx.bracket_number_types(F.lit("(ii) x")).alias("k"),
        tx.list_number_type(F.lit("1.2.3 x")).alias("t"),
        tx.regulation_citekey(F.lit(7), F.lit("§ 1.2-a")).alias("r"),
        tx.sortable_number(F.lit("12a")).alias("o"),
        tx.enum_types_match(F.lit("b"), F.lit("c")).alias("e"),
        tx.clip_first_token(F.lit("(1) text of it")).alias("c"),
    ).first()
    assert row.asDict() == {"n": "a b c", "s": "12a", "l": "Gesetz", "d": ["42_7_a", "42_7_a_1"], "k": ["alpha-lower-double-bracket", "roman-lower-double-bracket"], "t": "numeric-3", "r": "cfr7_1.2a", "o": "0 0 12a", "e": True, "c": "text of it"}
    assert [tx.roman(i) for i in (4, 8, 19, 34)] == ["iv", "viii", "xix", "xxxiv"]


def test_law_names_by_automaton():
    rnd = random.Random(3)
    words = ["gesetz", "über", "die", "der", "ordnung", "länder", "bund"]
    names = {german.stem(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))): f"L{i}" for i in range(25)}
    laws = german.LawNames(names)
    for _ in range(300):
        text = " ".join(rnd.choice([*words, "x", "Gesetzes", "§ 3,"]) for _ in range(rnd.randint(0, 14)))
        tokens = list(re.finditer(r"[\w\-]+", text))
        every = [(a.start(), -b.end(), laws.names[german.stem(text[a.start() : b.end()])]) for i, a in enumerate(tokens) for b in tokens[i:] if german.stem(text[a.start() : b.end()]) in laws.names]
        want = []
        for start, end, key in sorted(every):
            if not want or start >= want[-1][1]:
                want.append((start, -end, key))
        assert laws.within(text) == want
        for t in tokens:
            here = [(-e, k) for s, e, k in sorted(every) if s == t.start()]
            assert laws.at(text, t.start()) == (here[0] if here else None)


def test_kinds_of_laws_behind_citations():
    laws = german.LawNames({german.stem("Auftragsgesetz"): "L1"})
    kinds = lambda text, **k: [(a["law_type"], a["lawname"], a["parsed"]) for a in german.areas(text, laws, "OWN", **k)]
    assert kinds("§ 3 SGB XII und") == [("sgb", "SGB XII", [["SGB-12", "3"]])]
    assert kinds("§ 3 des Fünften Buches (Sozialgesetzbuch)") == [("sgb", "Fünften Buches (Sozialgesetzbuch)", [["SGB-5", "3"]])]
    assert kinds("§ 3 des Fantasiegesetzes") == [("unknown", "Fantasiegesetzes", [["3"]])]
    assert kinds("Art. 1 des Grundgesetzes") == [("dict", "Grundgesetzes", [["GG", "1"]])]
    assert kinds("§ 3 gilt") == [("internal", "", [["OWN", "3"]])]
    assert kinds("§ 3 gilt", paragraphs=False) == [("ignore", "", [["3"]])]
    with pytest.raises(ValueError, match="characters"):
        german.checked({"x" * (german.MAX_NAMES + 1): "L"})


def test_citations_by_dated_names_beside_loops(spark):
    rnd = random.Random(11)
    laws = [f"Gesetz {w}" for w in ("Eins", "Zwei", "Drei und Vier", "Drei")]
    names = {f"{d:08d}": {german.stem(x): f"L{d}_{i}" for i, x in enumerate(laws) if rnd.random() < 0.7} for d in range(600)}
    days = sorted(names)
    names[days[3]].setdefault("gesetz zwei", "A")
    texts = [(i, days[3] if i % 3 == 0 else rnd.choice([*days, "none"]), rnd.choice([None, "", *(f"nach § {i} Abs. 2 des {x} und Art. 3 gilt § 4 SGB V" for x in laws)]), i % 2 == 0) for i in range(900)]
    want = []
    for i, day, text, _ in texts:
        found = german.areas(text, german.LawNames(names.get(day, {})), None, False, False)
        want += [(i, n, f["start"], f["end"], f["law_type"], f["parsed"]) for n, f in enumerate(found)]
    df = spark.createDataFrame(texts, "k long, since string, text string, start boolean")
    given = spark.createDataFrame([(d, n, c) for d, x in names.items() for n, c in x.items()] + [(days[3], "gesetz zwei", "A"), (days[3], "", "B"), (None, "x", "C")], "since string, name string, citekey string")
    found = german.find_citations_by(df, given, "since", tile_texts=50)
    rows = sorted((r["k"], r["ref_pos"], r["start"], r["end"], r["law_type"], r["parsed"]) for r in found.collect())
    assert rows == sorted(want) and len(rows) > 800
    assert german.find_citations_by(df.where("false"), given, "since").count() == 0
    assert german.find_citations_by(df, given.where("false"), "since", tile_texts=50).where("law_type = 'dict'").count() == 0


def test_texts_of_a_date_are_dealt_before_they_move(spark):
    """A group's texts go to their tiles at once; the number of tiles comes to them, so no task gets all texts of a date on the way."""
    df = spark.range(400).selectExpr("id as k", "cast(20000101 + id div 1000 as string) as since", "concat('nach § ', id, ' des Testgesetzes') as text")
    names = spark.createDataFrame([("20000101", "testgesetz", "L")], "since string, name string, citekey string")
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")  # as with tables whose size says nothing
    try:
        found = german.find_citations_by(df, names, "since", tile_texts=50)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["k"], r["parsed"]) for r in found.collect()) == [(i, [["L", str(i)]]) for i in range(400)]
    finally:
        spark.conf.set(name, before)


def test_areas_without_of_and_texts_without_title(spark):
    """Areas are parsed alike with and without a trailing place; a text whose title is null has citations without paths, as before."""
    assert citations.parse_area("5 U.S.C. 3(a), 4-7 and following", "block", 9) == [["5", "3", "a"], ["5", "4"], ["5", "7"]]
    assert citations.parse_area("sections 3 and 4", "inline", 9) == [["9", "3"], ["9", "4"]]
    assert citations.parse_area("sections 3 and 4 of title 8", "inline", 9) == [["8", "3"], ["8", "4"]]
    rows = spark.createDataFrame([("section 3 Of this title", 7), ("section 3", None), (None, 1)], "text string, own int")
    found = citations.find_citations(rows, title=rows["own"]).collect()
    assert sorted((r["text"], r["ref_pos"], r["area"], r["parsed"]) for r in found) == [("section 3", 0, "section 3", []), ("section 3 Of this title", 0, "section 3 Of this title", [["7", "3"]])]


def test_tokens_are_clipped_without_expressions(spark):
    """First and last tokens are found by their spaces; patterns took a third of the time of what reads a snapshot again and again."""
    texts = ["", " ", "a", "a b", " a", "a ", "  ", "a  b", "ä € ß", "\u00df\u20ac \U0001d11e x", "a\nb c\n", "a\u2028b c\u2028", "eins zwei drei", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    clipped = df.select("t", tx.clip_first_token(F.col("t")).alias("first"), tx.clip_last_token(F.col("t")).alias("last"))
    assert "regexp" not in clipped._jdf.queryExecution().optimizedPlan().toString()
    for r in clipped.collect():
        assert (r["first"], r["last"]) == ((None, None) if r["t"] is None else (re.sub(r"(?s)\A[^ ]* ", "", r["t"]), re.sub(r" [^ ]*\Z", "", r["t"])))
