"""Column functions over text, headings, numbering and keys. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s+"


def normalise(text: Column) -> Column:
    """White space runs to one space, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, _SPACE, " ")))


def chars_n(text: Column) -> Column:
    return F.length(text).cast("long")


def chars_nowhites(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _SPACE, "")).cast("long")


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, _SPACE), lambda t: t != "")


def tokens_n(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def tokens_unique(text: Column) -> Column:
    return F.size(F.array_distinct(tokens(text))).cast("long")


def clip_first_token(text: Column) -> Column:
    """Without the first token and its space; texts without a space stay whole."""
    return F.substr(text, F.instr(text, " ") + 1)


def clip_last_token(text: Column) -> Column:
    """Without the last token and its space; texts without a space stay whole."""
    return F.when(F.instr(text, " ") > 0, F.left(text, F.length(text) - F.length(F.substring_index(text, " ", -1)) - 1)).otherwise(text)


def heading_start(heading: Column) -> Column:
    """The first two words of a heading in lower case."""
    return F.lower(F.substring_index(heading, " ", 2))


def sortable_number(value: Column, digits: int = 4) -> Column:
    """``0 `` once for every digit that is missing to four, so that numbers compare as text; no change without digits."""
    found = F.length(F.regexp_extract(value, r"^(\d*)", 1))
    return F.when(found == 0, value).otherwise(F.concat(F.repeat(F.lit("0 "), F.greatest(F.lit(digits) - found, F.lit(0))), value))


def to_bool(value: Column) -> Column:
    """yes/true/t/y/1 and no/false/f/n/0 in any case; null stays null, anything else is an error."""
    low = F.lower(value.cast("string"))
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False).when(low.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), low)).cast("boolean"))


def short_law_name(name: Column) -> Column:
    """The name without its year (and what digits and dashes follow it); null if there is none."""
    found = F.regexp_extract(name, r"(?U)^(.+)\s\d{4}[\-\d]*$", 1)
    return F.when(found != "", found)


def law_name_stem(name: Column) -> Column:
    """Lower case, single spaces, and without the endings that German inflection puts on words of a law's name."""
    return F.regexp_replace(normalise(name), r"(?U)(?<=\w{3})(?:es|en|er|em|e|s|n)\b", "")


def section_number(heading: Column) -> Column:
    """The number of ``§ 12a`` or ``Art. 3`` headings; null for others."""
    found = F.regexp_extract(heading, r"(?U)(?:§§?|Art[a-z\.]*)\s?(\d+[a-z]*)\b", 1)
    return F.when(found != "", found)


def key_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\wäöüÄÖÜß]", "-")


def statute_citekey(title: Column, section: Column) -> Column:
    return F.concat_ws("_", title.cast("string"), section)


def regulation_citekey(title: Column, sectno: Column) -> Column:
    """``cfr{title}_{section}``; the section keeps letters, digits and dots of its last word."""
    return F.concat(F.lit("cfr"), title.cast("string"), F.lit("_"), F.regexp_replace(F.element_at(F.split(F.trim(sectno), r"\s+"), -1), r"[^A-Za-z0-9\.]", ""))


def leading_groups(text: Column) -> Column:
    """Up to four leading ``(x)`` groups of one or two characters."""
    pattern = r"^" + r"(?:\s*\((..?)\))?" * 4
    return F.filter(F.array(*(F.regexp_extract(text, pattern, i) for i in range(1, 5))), lambda g: g != "")


def detailed_of_groups(parent: Column, groups: Column) -> Column:
    """Cumulative keys below ``parent`` for groups that a column holds already; a first group that repeats the parent's last part is passed over."""
    last = F.element_at(F.split(parent, "_"), -1)
    own = F.when(F.get(groups, F.lit(0)) == last, F.slice(groups, 2, 4)).otherwise(groups)
    return F.transform(own, lambda g, i: F.concat(parent, F.lit("_"), F.array_join(F.slice(own, F.lit(1), i + 1), "_")))


def detailed_citekeys(parent: Column, text: Column) -> Column:
    """As ``detailed_of_groups`` for the leading groups of a text."""
    return detailed_of_groups(parent, leading_groups(text))


def bracket_number_types(text: Column) -> Column:
    """Kinds that the numbering at the start of a text can be; two when letters and Roman numerals can't be told apart."""
    none = F.array().cast("array<string>")
    letter, roman = "alpha-lower-double-bracket", "roman-lower-double-bracket"
    return (
        F.when(text.rlike(r"^\((ii?i?|xx?x?|vv?)\)"), F.array(F.lit(letter), F.lit(roman)))
        .when(text.rlike(r"^\((([A-Z])\2*)\)"), F.array(F.lit("alpha-upper-double-bracket")))
        .when(text.rlike(r"^\((([a-z])\2*)\)"), F.array(F.lit(letter)))
        .when(text.rlike(r"^\(\d+\)"), F.array(F.lit("arabic-double-bracket")))
        .when(text.rlike(r"^\((x[cl]|l?x{0,3})(i[xv]|v?i{0,3})\)"), F.array(F.lit(roman)))
        .otherwise(none)
    )


def bracket_number(text: Column) -> Column:
    """What the numbering at the start of a text says, without brackets; null without numbering."""
    return F.when(F.size(bracket_number_types(text)) > 0, F.regexp_extract(text, r"^\(([^)]*)\)", 1))


def list_number_type(text: Column, position: int = 0) -> Column:
    """Kind of the numbering that a token of a decision's text is, with its level; null for ordinary tokens."""
    token = F.get(tokens(text), F.lit(position))
    level = F.length(F.regexp_extract(token, r"([a-h]+)", 1)).cast("string")
    parts = F.size(F.split(F.regexp_extract(token, r"^(\d(?:\.\d)*)\.?$", 1), r"\.")).cast("string")
    return (
        F.when(token.rlike(r"^(([a-h])\2*)\)$"), F.concat(F.lit("alpha-lower-bracket-"), level))
        .when(token.rlike(r"^\((([a-h])\2*)\)$"), F.concat(F.lit("alpha-lower-double-bracket-"), level))
        .when(token.rlike(r"^(([a-h])\2*)\.$"), F.concat(F.lit("alpha-lower-dot-"), level))
        .when(token.rlike(r"^((X[CL]|L?X{0,3})(I[XV]|V?I{0,3}))\.?$"), F.lit("roman-upper"))
        .when(token.rlike(r"^\d+\.$"), F.lit("arabic-dot"))
        .when(token.rlike(r"^\d+\)$"), F.lit("arabic-bracket"))
        .when(token.rlike(r"^[A-H]\.$"), F.lit("alpha-dot"))
        .when(token.rlike(r"^[A-H]\)$"), F.lit("alpha-bracket"))
        .when(token.rlike(r"^\d(\.\d)*\.?$") & (F.length(token) > 1), F.concat(F.lit("numeric-"), parts))
    )


def enum_types(value: Column) -> Column:
    """Which of six kinds of enumeration a component can be."""
    kinds = {"lower": "[a-z]", "arabic": r"\d+", "upper": "[A-Z]", "roman-lower": "[xvi]x{0,4}v?i{0,4}", "roman-upper": "[XVI]X{0,4}V?I{0,4}", "double": r"([a-z])\1"}
    return F.filter(F.array(*(F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in kinds.items())), lambda k: k.isNotNull())


def enum_types_match(a: Column, b: Column) -> Column:
    return F.arrays_overlap(enum_types(a), enum_types(b))


def merge_strings(parts: Column) -> Column:
    """``array<struct<text, item>>`` with neighbouring texts joined to one; entries that have an item stay as they are."""

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        both = last["text"].isNotNull() & x["text"].isNotNull()
        joined = F.struct(F.concat(last["text"], x["text"]).alias("text"), x["item"].alias("item"))
        return F.when(both, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(parts, F.expr("cast(array() as array<struct<text:string,item:string>>)"), add)


def roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def letters(times: int = 3) -> list[str]:
    """a to z, then doubled, then tripled."""
    return [chr(97 + i) * k for k in range(1, times + 1) for i in range(26)]


def volume_key(title: Column, volume: Column, year: Column) -> Column:
    return F.format_string("cfr%dv%d_%d", title, volume, year)


def node_key(prefix: Column, position: Column) -> Column:
    return F.format_string("%s_%06d", prefix, position)


def iso_date(compact: Column) -> Column:
    return F.concat_ws("-", F.substring(compact, 1, 4), F.substring(compact, 5, 2), F.substring(compact, 7, 2))


def compact_date(iso: Column) -> Column:
    return F.replace(iso, F.lit("-"), F.lit(""))


def version_parts(filename: Column) -> Column:
    """``{id}_{from}_{to}.xml`` as a struct."""
    name = F.split(F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.xml$", ""), "_")
    return F.struct(F.get(name, F.lit(0)).alias("doknr"), F.get(name, F.lit(1)).alias("valid_from"), F.get(name, F.lit(2)).alias("valid_to"))


def snapshot_dates(first: int, last: int, kind: str = "all") -> list[str]:
    """``all``: the last days of the years; ``all-new-years``: the first ones; ``years``: the years alone."""
    day = {"all": "-12-31", "all-new-years": "-01-01", "years": ""}[kind]
    return [f"{y}{day}" for y in range(first, last + 1)]
