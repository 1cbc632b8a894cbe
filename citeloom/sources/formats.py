"""Formats of legal documents: the structural XML, statutes and regulations of two countries, court decisions."""

from __future__ import annotations

import io
import itertools
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

from citeloom.functions.text import letters, roman
from citeloom.sources.tree import Item

_SPACE = re.compile(r"\s+")
_KINDS = ("document", "item", "seqitem", "subseqitem")


def squeeze(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip()


def base_name(path: str) -> str:
    return re.sub(r"\.[A-Za-z]+$", "", path.rsplit("/", 1)[-1])


# -- structural XML -----------------------------------------------------------------------------------------------


def structural(path: str, data: bytes) -> list[tuple[Item, str, str, int]]:
    """The normalised tree; keys that the file has are kept by their prefix and first counter."""
    root = ET.fromstring(data)

    def build(e: ET.Element) -> Item:
        known = {"heading", "citekey", "key", "level", "citekey_detailed"}
        item = Item(e.tag, e.get("heading", ""), e.get("citekey", ""), {k: v for k, v in e.attrib.items() if k not in known and not k.startswith("{")}, detailed=[x for x in e.get("citekey_detailed", "").split(",") if x])
        item.parts = [build(c) if c.tag in _KINDS else " ".join(c.itertext()) for c in e if c.tag in (*_KINDS, "text")]
        return item

    prefix, _, count = root.get("key", f"{base_name(path)}_000001").rpartition("_")
    return [(build(root), base_name(path), prefix, int(count))]


# -- statutes in German XML ----------------------------------------------------------------------------------------

_APPENDIX = re.compile(r"(?:Anlagen?|Anhang|Schlu.s?formel|Tabelle \w+ zu)\b", re.I)
_GONE = re.compile(r".{0,5}(?:weggefallen|\-|\—|aufgehoben|entf.ll(?:t|en)|gestrichen|unbesetzt).{0,5}", re.I)
_UNIT_HEADING = re.compile(r"(§§?|Art[a-z\.]*)\s?(\d+[a-z]*)\b")
_CONTENTS = {"inhaltsverzeichnis", "inhaltsübersicht", "inhalt"}


def _juris(meta: ET.Element | None) -> dict[str, str]:
    if meta is None:
        return {}
    out = {}
    for tag in ("normgeber", "mitwirkende", "sachgebiete"):
        values = [squeeze(x.text) for x in meta.findall(tag)]
        out[tag] = ";".join(v for v in values if tag != "sachgebiete" or v.lower().startswith("fna"))
    entries = [{"typ": v.get("verweistyp"), "enbez": v.findtext("enbez"), "normabk": v.findtext("normabk")} for v in meta.findall("v_eintrag")]
    return out | {"verweise": json.dumps(entries, ensure_ascii=False)}


def german_statute(path: str, data: bytes | ET.Element, document_type: str | None = None) -> list[tuple[Item, str, str, int]]:
    """Norms of a file, or of its tree, become items by the length of their structure number, and units with paragraphs. Everything from the
    first appendix on, tables of contents and repealed texts are left out; items without content go."""
    norms = (data if isinstance(data, ET.Element) else ET.fromstring(data)).findall("norm")
    if not norms:
        return []
    frame = norms[0].find("metadaten")
    text_part = norms[0].find("textdaten")
    if (text_part is None or not len(text_part)) and norms[0].find(".//gliederungskennzahl") is None:
        norms = norms[1:]
    abbreviation = squeeze(frame.findtext("jurabk"))
    if not abbreviation:
        raise ValueError("no abbreviation")
    named = {"heading_short": frame.findtext("kurzue"), "abbr_1": abbreviation, "abbr_2": frame.findtext("amtabk"), "document_type": document_type}
    root = Item("document", squeeze(frame.findtext("langue")), attrs={k: squeeze(v) for k, v in named.items() if v} | _juris(frame.find("juris")))
    prefix = re.sub(r"[^\wäöüÄÖÜß]", "-", abbreviation)
    cursor, lengths, last, items, appendix = [root], [0], None, [], False
    for norm in norms:
        meta = norm.find("metadaten")
        label = squeeze(meta.findtext("enbez"))
        appendix = appendix or bool(label and _APPENDIX.match(label))
        if appendix:
            continue
        unit = meta.find("gliederungseinheit")
        if unit is not None:
            number = (unit.findtext("gliederungskennzahl") or "").strip()
            if not number or len(number) % 3:
                raise ValueError(f"structure number {number!r}")
            if len(number) not in lengths:
                lengths = sorted([*lengths, len(number)])
            level = min(lengths.index(len(number)), len(cursor))
            if number != last:
                last = number
                item = Item("item", squeeze(f"{unit.findtext('gliederungsbez') or ''} {unit.findtext('gliederungstitel') or ''}"))
                cursor[level - 1].parts.append(item)
                items.append((item, cursor[level - 1]))
                cursor, lengths = [*cursor[:level], item], lengths[: level + 1]
        content = norm.find("textdaten/text")
        if label.lower() in _CONTENTS or content is None:
            continue
        texts = [t for p in content.findall("Content/P") if (t := "".join(p.itertext()).strip()) and (len(t) > 14 or not _GONE.fullmatch(t))]
        if texts:
            m = _UNIT_HEADING.match(label)
            seq = Item("seqitem", label, f"{prefix}_{m[2]}" if m else "", _juris(meta.find("juris")))
            seq.parts = texts if len(texts) == 1 else [Item("subseqitem", parts=[t]) for t in texts]
            cursor[-1].parts.append(seq)
    for item, parent in reversed(items):
        if "weggefallen" in item.heading.lower() or not item.parts:
            parent.parts = [p for p in parent.parts if p is not item]
    changed: set[int] = set()
    for item, _ in items:  # laws that are made of articles: an article is the unit, what it holds is below it
        m = _UNIT_HEADING.match(item.heading)
        if m and id(item) not in changed:
            item.kind, item.citekey = "seqitem", f"{prefix}_{m[2]}"
            for sub in list(item.walk())[1:]:
                sub.kind, sub.citekey = "subseqitem", ""
                changed.add(id(sub))
            if len(item.parts) == 1 and isinstance(item.parts[0], Item) and not item.parts[0].heading:
                item.parts = item.parts[0].parts
    doknr, start, end = (base_name(path).split("_") + ["", "", ""])[:3]
    return [(root, "_".join([doknr, prefix, start, end]), "_".join([doknr, prefix, end]), 1)]


# What the simplifier takes out, spaces out, or turns into plain text.
DROPPED = ("FnR", "fussnoten", "Footnotes", "ausfertigung-datum", "fundstelle", "standangabe")
SPACED, FLAT, TITLED = ("DT", "DD", "entry", "LA"), ("P", "TOC"), ("gliederungstitel", "titel", "langue", "kurzue")


def simplified(data: bytes) -> bytes:
    """A German statute without footnotes and build dates; line breaks, cells, paragraphs and contents become plain text of single spaces."""
    return ET.tostring(simplified_tree(data), encoding="utf-8")


def simplified_tree(data: bytes) -> ET.Element:
    """The tree that ``simplified`` writes, as it is read back."""
    root = ET.fromstring(data)

    def join(parent: ET.Element, i: int, text: str) -> None:
        if i:
            parent[i - 1].tail = (parent[i - 1].tail or "") + text
        else:
            parent.text = (parent.text or "") + text

    def clean(e: ET.Element) -> None:
        e.attrib.pop("builddate", None)
        for c in list(e):
            clean(c)
            if c.tag in DROPPED or c.tag == "BR" or c.tag == "SUP" and c.get("class") == "Rec":
                i = list(e).index(c)
                e.remove(c)
                join(e, i, ("" if c.tag in DROPPED else " ") + (c.tail or ""))
            elif c.tag == "text" and not "".join(c.itertext()).strip():
                e.remove(c)
        if e.tag in SPACED:
            e.text = " " + (e.text or "")
            join(e, len(e), " ")
        if e.tag in FLAT:
            text = squeeze((" " if e.tag == "TOC" else "").join(e.itertext()))
            for c in list(e):
                e.remove(c)
            e.text = text
        if e.tag in TITLED:
            for x in e.iter():
                x.text = re.sub(r"\s*\*\)\s*$", "", squeeze(x.text))
        if e.tag == "enbez" and e.text == "(XXXX)":
            e.text = "XXXX"

    clean(root)
    for e in root.iter():  # a return that a reference stands for is a line break when it is read back
        if "\r" in (e.text or "") or "\r" in (e.tail or ""):
            return ET.fromstring(ET.tostring(root, encoding="utf-8"))
    return root


# -- statutes in XHTML with comments --------------------------------------------------------------------------------


class _Fields(HTMLParser):
    """Documents as properties and fields of (class, text) blocks, cut at comments."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.docs: list[dict] = []
        self.open: list[str] = []
        self.depth = self.sup = 0
        self.block: list | None = None

    def handle_comment(self, data: str) -> None:
        name, _, value = data.strip().partition(":")
        if name == "documentid":
            self.docs.append({"documentid": value, "fields": {}})
        elif not self.docs:
            return
        elif name in ("expcite", "itempath", "itemsortkey"):
            self.docs[-1][name] = value
        elif name == "field-start":
            self.open.append(value)
        elif name == "field-end":
            if not self.open or self.open.pop() != value:
                raise ValueError(f"field {value} isn't open")
        elif name != "PDFPage":
            raise ValueError(f"comment {name}")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("img", "br", "hr", "meta", "link"):
            return
        self.sup += tag == "sup"
        if self.docs and self.open:
            if self.depth == 0:
                self.block = [tag, (dict(attrs).get("class") or "").split(" ")[0], ""]
                self.docs[-1]["fields"].setdefault("/".join(self.open), []).append(self.block)
            self.depth += 1

    def handle_endtag(self, tag: str) -> None:
        self.sup -= tag == "sup" and self.sup > 0
        if self.depth:
            self.depth -= 1
            if self.block is not None and tag in ("td", "th"):
                self.block[2] += " "

    def handle_data(self, data: str) -> None:
        if self.block is not None and not self.sup and self.docs and (self.depth or data.strip()):
            self.block[2] += data if self.depth else " " + data.strip()


# Kinds of blocks of the code from the outermost on, each with the classes of paragraphs that open one.
CLASSES = {
    "subsection": "subsection-head",
    "paragraph": "paragraph-head",
    "subparagraph": "subparagraph-head",
    "clause": "clause-head",
    "subclause": "subclause-head",
    "subsubclause": "subsubclause-head",
    "subhead": "analysis-subhead",
    "item": "item-head",
    "text": "statutory-body usc28aForm-left usc28aform-right signature presidential-signature note-body note-body-small note-body-block italic-text-block statutory-body-block",
    "text-enumeration1": "statutory-body-1em statutory-body-block-1em note-body-1em note-body-block-1em",
    "text-enumeration2": "statutory-body-2em statutory-body-block-2em statutory-body-flush0_hang2 note-body-2em",
    "text-enumeration3": "statutory-body-3em statutory-body-flush2_hang3 note-body-3em",
    "text-enumeration4": "statutory-body-4em statutory-body-block-4em statutory-body-flush2_hang4",
    "text-enumeration5": "statutory-body-5em",
    "text-enumeration6": "statutory-body-6em",
    "text-misc": "formula note-sub-head subchapter-head tableftnt note-body-flush3_hang4 5802I62 5802I63 5801I76 5800I01 5803I01 5801I01 5801I05 italic-text-para statutory-body-flush0_hang1 dispo",
}
# Classes that go on with an open text of that kind, and classes that are passed over.
CONTINUED = {
    "text": "statutory-body-block",
    "text-enumeration1": "statutory-body-block-1em note-body-block-1em",
    "text-enumeration2": "statutory-body-block-2em statutory-body-flush0_hang2",
    "text-enumeration3": "statutory-body-flush2_hang3",
    "text-enumeration4": "statutory-body-block-4em statutory-body-flush2_hang4",
}
SKIPPED = "rules-form-source-credit analysis-style-table leader-work-left leader-work-right leader-work-head-left leader-work-head-right italic-head two-column-analysis-style-content-left".split()
_DEPTH = {css: depth for depth, names in enumerate(CLASSES.values()) for css in names.split()}
_GOES_ON = {css: list(CLASSES).index(kind) for kind, names in CONTINUED.items() for css in names.split()}
_TEXTS_FROM = list(CLASSES).index("text")


def us_code(path: str, data: bytes) -> list[tuple[Item, str, str, int]]:
    """Documents between comments are nested by their path; a section's blocks are nested by the order of their classes."""
    parser = _Fields()
    parser.feed(data.decode("utf-8-sig", "ignore").replace("\x1a", ""))
    roots: list[dict] = []
    by_path: dict[tuple, dict] = {}
    for doc in parser.docs:
        doc["path"] = (doc["itempath"].split("/")[1], *doc["expcite"].split("!@!")[1:])
        doc["children"] = []
        chain = [doc]
        while len(chain[0]["path"]) > 1 and chain[0]["path"][:-1] not in by_path:  # parents that are missing are made
            one = chain[0]
            chain.insert(0, {"path": one["path"][:-1], "itempath": one["itempath"].rpartition("/")[0], "expcite": one["expcite"].rpartition("!@!")[0], "fields": {}, "children": []})
        for one in chain:
            (by_path[one["path"][:-1]]["children"] if len(one["path"]) > 1 else roots).append(one)
            by_path[one["path"]] = one
    version = base_name(path).rpartition("_")[2]
    return [(_us_item(r, True), f"{r['itempath'][1:]}_{version}", f"{r['path'][0]}_{version}", 1) for r in roots]


def _us_item(doc: dict, root: bool = False) -> Item:
    item = Item("document" if root else "item" if doc["children"] else "seqitem", doc["expcite"].split("!@!")[-1])
    if root:
        item.attrs["document_type"] = "statute"
    if item.kind == "seqitem" and doc["itempath"].split("/")[1].endswith("0"):
        item.citekey = f"{doc['expcite'].split('-')[0].split()[-1]}_{doc['itempath'].split()[-1]}"
    stack: list[tuple[int, Item]] = [(-1, item)]
    for tag, css, text in doc["fields"].get("statute", []):
        if not css and tag not in ("div", "table") or css in SKIPPED or tag == "td" and css in ("middle", "right"):
            continue
        if tag in ("div", "table"):
            stack[-1][1].parts.append(Item("subseqitem", parts=[squeeze(text)]))
        elif any(depth == _GOES_ON.get(css) for depth, _ in stack[:-1]):
            while stack[-1][0] != _GOES_ON[css]:
                stack.pop()
            stack[-1][1].parts.append(squeeze(text))
        elif css not in _DEPTH:  # the file goes to quarantine with this reason, so no text is lost silently
            raise ValueError(f"class {css!r} of <{tag}>")
        else:
            while stack[-1][0] >= _DEPTH[css]:
                stack.pop()
            headed = _DEPTH[css] < _TEXTS_FROM
            sub = Item("subseqitem", squeeze(text) if headed else "", parts=[] if headed else [squeeze(text)])
            stack[-1][1].parts.append(sub)
            stack.append((_DEPTH[css], sub))
    if item.kind == "seqitem":
        only = item.parts[0] if len(item.parts) == 1 else None
        if isinstance(only, Item) and not only.heading and len(only.parts) == 1 and isinstance(only.parts[0], str):
            item.parts = only.parts
        _detail(item, item.citekey)
    item.parts += [_us_item(c) for c in doc["children"]]
    return item


_GROUPS = re.compile(r"(?:\s*\((..?)\))?" * 4)


def _detail(item: Item, above: str) -> None:
    """Cumulative citekeys of sub-units whose text begins with (a), (1) and so on."""
    for sub in item.items():
        first = sub.parts[0] if sub.parts and isinstance(sub.parts[0], str) else ""
        groups = [g for g in _GROUPS.match(first).groups() if g]
        if groups and groups[0] == above.rpartition("_")[2]:
            groups = groups[1:]
        key = above
        for g in groups:
            key = f"{key}_{g}"
            sub.detailed.append(key)
        _detail(sub, key)


# -- regulations ----------------------------------------------------------------------------------------------------

# Tags of regulation files.
CONTENTS_ONLY = {"TOC", "LRH", "RRH"}
CONTAINERS = ("TITLE", "SUBTITLE", "CHAPTER", "SUBCHAPTER", "SUBCHAP", "PART", "SUBPART", "SUBJGRP")
OPENING, CONTINUING, GATHERED = ("P", "HD", "WIDE", "TEAR"), ("FP", "LDRWK", "BOXTXT"), ("EXTRACT", "EXAMPLE", "GPOTABLE", "TSECT", "WBOXTXT")
PASSED = "SECTNO SUBJECT PRTPAGE CITA FTNT GPH EDNOTE RESERVED NOTE EFFDNOT EAR APPRO STARS MATH LRH RRH CONTENTS SUBTITLE CTRHD WEDNOTE CROSSREF WEFFDNO TEFFDNO EXT-XREF EFFDNOTP PARAUTH WEFFDNOP EXHIBIT SECAUTH AUTH LHD1".split()
_LETTER, _ROMAN = "alpha-lower-double-bracket", "roman-lower-double-bracket"
_UNIT = r"\((?:[A-Za-z]|\d+|(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3}))\)"
_LEAD = re.compile(_UNIT + r"(?:[\sA-Za-z\-]{1,50}(?:\.\s|—))?")
_REPEAT = re.compile(rf"(?:{_UNIT}\s?)+(?=\(|$|\s+)")
_ALPHAS, _ROMANS = letters(), [roman(i) for i in range(1, 35)] + ["viv", "vv", "vvi"]


def number_of(text) -> tuple[str | tuple | None, str | None]:
    """Kind and value of the numbering at the start of a text; a pair of kinds if it can be both."""
    if not isinstance(text, str):
        return None, None
    for kind, pattern in (((_LETTER, _ROMAN), r"\((ii?i?|xx?x?|vv?)\)"), ("alpha-upper-double-bracket", r"\((([A-Z])\2*)\)"), (_LETTER, r"\((([a-z])\2*)\)"), ("arabic-double-bracket", r"\((\d+)\)"), (_ROMAN, r"\(((?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3}))\)")):
        if m := re.match(pattern, text):
            return kind, m[1]
    return None, None


def disambiguate(numbers: list[tuple]) -> list[tuple]:
    """Decide between letters and Roman numerals by the neighbours in the sequence: the other kind's absence first,
    then whichever sequence has its neighbour next to the place, then the nearest one; at last, the first of its kind."""
    numbers = list(numbers)
    values = [v for _, v in numbers]

    def away(i: int, wanted: str | None, back: bool) -> int | None:
        if wanted is None:
            return None
        order = range(i - 1, -1, -1) if back else range(i + 1, len(values))
        return next((abs(j - i) for j in order if values[j] == wanted), None)

    for i, (kind, value) in enumerate(numbers):
        if not isinstance(kind, tuple):
            continue
        others = [k for j, (k, _) in enumerate(numbers) if j != i]
        has = {k: k in others for k in (_LETTER, _ROMAN)}
        if has[_LETTER] != has[_ROMAN] and not any(isinstance(k, tuple) for k in others):
            numbers[i] = (_ROMAN if has[_ROMAN] else _LETTER, value)
            continue
        near = {}
        for name, series in ((_LETTER, _ALPHAS), (_ROMAN, _ROMANS)):
            at = series.index(value)
            near[name] = (away(i, series[at - 1] if at else None, True), away(i, series[at + 1] if at + 1 < len(series) else None, False))
        beside = {name: 1 in pair for name, pair in near.items()}
        if beside[_LETTER] != beside[_ROMAN]:
            choice = _LETTER if beside[_LETTER] else _ROMAN
        else:
            ranked = [(d, side, name) for name, pair in near.items() for side, d in enumerate(pair) if d]
            first = {name: series.index(value) == 0 for name, series in ((_LETTER, _ALPHAS), (_ROMAN, _ROMANS))}
            choice = min(ranked, key=lambda x: (x[0], x[1], x[2] != _LETTER))[2] if ranked else _LETTER if first[_LETTER] else _ROMAN
        numbers[i] = (choice, value)
    return numbers


def split_units(lists: list[list]) -> list[list]:
    """``(a)(1) text`` becomes two units; a start that only repeats the unit before it is taken away."""
    out = []
    for i, parts in enumerate(lists):
        text = parts[0]
        if not isinstance(text, str):
            out.append(parts)
            continue
        before = lists[i - 1][0] if i else None
        if isinstance(before, str):
            same = next((k for k, (x, y) in enumerate(zip(text, before, strict=False)) if x != y), min(len(text), len(before)) - 1)
            start = text[: same + 1]
            if len(start) >= 3 and (m := _REPEAT.match(start)):
                text = text[m.end() :]
        pieces, m = [], _LEAD.match(text)
        while m:
            rest = text[m.end() :]
            following = _LEAD.match(rest)
            if following:
                pieces.append(m[0].strip())
                text, m = rest, following
            else:
                break
        out += [[p] for p in pieces] + [[text, *parts[1:]]]
    return out


def _section_texts(section: ET.Element) -> list[list]:
    out: list[list] = []
    for e in section:
        if e.tag in OPENING:
            out.append([squeeze("".join(e.itertext()))])
        elif e.tag in CONTINUING or e.tag in GATHERED:
            value = squeeze("".join(e.itertext())) if e.tag in CONTINUING else [t for c in e if (t := squeeze("".join(c.itertext())))]
            if value:
                out[-1].append(value) if out else out.append([value])
        elif e.tag not in PASSED:
            raise ValueError(f"tag {e.tag}")
    return out


def _regulation_section(section: ET.Element, title: str) -> Item:
    number, subject = squeeze(section.findtext("SECTNO")), squeeze(section.findtext("SUBJECT"))
    item = Item("seqitem", f"{number} {subject}".strip(), f"cfr{title}_{re.sub(r'[^A-Za-z0-9.]', '', number)}")
    lists = split_units(_section_texts(section))
    if len(lists) == 1 and len(lists[0]) == 1 and isinstance(lists[0][0], str):
        item.parts = [lists[0][0]]
        return item
    numbers = disambiguate([number_of(parts[0]) for parts in lists])
    kinds = list(dict.fromkeys([None, *(k for k, _ in numbers)]))
    stack: list[tuple[int, Item]] = [(-1, item)]
    for (kind, _), parts in zip(numbers, lists, strict=True):
        level = kinds.index(kind)
        while stack[-1][0] >= level:
            stack.pop()
        subs = [Item("subseqitem", parts=[p] if isinstance(p, str) else p if len(p) == 1 else [Item("subseqitem", parts=[x]) for x in p]) for p in parts]
        stack[-1][1].parts += subs
        stack.append((level, subs[-1]))
    return item


def _written_heading(e: ET.Element) -> str | None:
    """The heading that a container has itself, in its table of contents or as a reserved place; None if it has no place for one."""
    if (found := e.find("HD")) is not None:
        return squeeze(found.text)
    if toc := e.findall("TOC/TOCHD/HD"):
        return squeeze(" ".join(squeeze(h.text) for h in toc))
    found = e.find("RESERVED")
    return None if found is None else squeeze(found.text)


#: Parts of a container that its heading, its note and its end ask for; others go as soon as they are read.
_ASKED = ("HD", "TOC", "RESERVED", "AUTH")


@dataclass
class _Chapter:
    """A chapter that was begun: what is around it; and after its end, whether it holds contents only, and its heading."""

    around: tuple[ET.Element, ...]
    contents: bool = False
    heading: str | None = None

    def end(self, e: ET.Element, tags: set[str]) -> None:
        self.contents, self.heading = "TOC" in tags and tags <= CONTENTS_ONLY, _written_heading(e)


def _volume_head(data: bytes) -> tuple[bool, str]:
    """Whether a volume has a title's element, and its own heading, which its contents name; holds no more of the file than what is open."""
    named: dict[tuple, list[str]] = {("TOC",): [], ("FMTR", "TOC"): []}
    around, titled = [], False
    for event, e in ET.iterparse(io.BytesIO(data), ("start", "end")):
        if event == "start":
            titled = titled or e.tag == "TITLE"
            around.append(e)
            continue
        around.pop()
        if e.tag == "SUBJECT" and [x.tag for x in around[-2:]] == ["TITLENO", "CHAPTI"] and (within := tuple(x.tag for x in around[1:-2])) in named:
            named[within].append(squeeze(e.text))
        if around:
            around[-1].remove(e)
    return titled, next((t for t in named[("TOC",)] or named[("FMTR", "TOC")] if t.lower().startswith("chap")), "")


class _Volume:
    """A volume that is read once from its start, with the elements that are open and one unit at a time."""

    def __init__(self, data: bytes, title: str):
        self.title, (self.titled, self.heading) = title, _volume_head(data)
        self.events, self.waiting = ET.iterparse(io.BytesIO(data), ("start", "end")), []
        self.first, self.last = True, None

    def next(self) -> tuple[str, ET.Element]:
        return self.waiting.pop() if self.waiting else next(self.events)

    def pass_over(self, e: ET.Element, around: tuple[ET.Element, ...]) -> None:
        """To the end of an element; chapters in it may be contents too."""
        while self.next() != ("end", e):
            pass
        for c in e.iter("CHAPTER"):
            self.last = _Chapter(around)
            self.last.end(c, {x.tag for x in c})

    def document(self) -> Item:
        """The tree, whose parts are read when they are asked for."""
        root = None
        for _, e in self.events:
            root = e if root is None else root
            if e.tag == "TITLE" or not self.titled:
                break
        for c in root.iter():
            if c is e:
                break
            if c.tag == "CHAPTER":
                self.last = _Chapter((root,))
                self.last.end(c, {x.tag for x in c})
        return self.container(e, (root,), "document", {"document_type": "regulation"}, self.first, None, self.begin(e, (root,)))

    def begin(self, e: ET.Element, around: tuple[ET.Element, ...]) -> _Chapter | None:
        if e.tag != "CHAPTER":
            return None
        self.last = _Chapter(around)
        return self.last

    def container(self, e: ET.Element, around: tuple[ET.Element, ...], kind: str, attrs: dict, first: bool, before: _Chapter | None, own: _Chapter | None) -> Item:
        item = Item(kind, attrs=attrs)
        self.first = self.first and own is None
        item.parts = self.parts(item, e, around, first, before, own)
        return item

    def parts(self, item: Item, e: ET.Element, around: tuple[ET.Element, ...], first: bool, before: _Chapter | None, own: _Chapter | None) -> Iterator[Item]:
        """Units and containers of a container; its heading and its note are known at its end.

        A chapter without a heading may stand behind a chapter that is its table of contents; the first one of a volume
        has the volume's. Others have their tags.
        """
        inside, tags = (*around, e), set()
        while (found := self.next()) != ("end", e):
            c = found[1]
            begun = (self.first, self.last, self.begin(c, inside))
            gone = False
            if c.tag in CONTAINERS or c.tag == "SECTION":  # one that holds a table of contents only is passed over
                ahead = self.next()
                if ahead[0] == "start" and ahead[1].tag == "TOC":
                    self.pass_over(ahead[1], (*inside, c))
                    ahead = self.next()
                    gone = ahead == ("end", c)
                if not gone:
                    self.waiting.append(ahead)
            if gone:
                if begun[2]:
                    begun[2].end(c, {"TOC"})
            elif c.tag in CONTAINERS:
                yield self.container(c, inside, "item", {}, *begun)
            elif c.tag == "SECTION":
                self.pass_over(c, inside)
                yield _regulation_section(c, self.title)
            else:
                self.pass_over(c, inside)
            if c.tag not in _ASKED:
                tags.add(c.tag)
                e.remove(c)
        if own:
            own.end(e, tags | {x.tag for x in e})
        heading = _written_heading(e)
        if heading is None and e.tag == "CHAPTER":
            if before and before.contents and any(x is around[-2:][0] for x in before.around):
                heading = self.heading if before.heading is None else before.heading
            elif first:
                heading = self.heading
        item.heading = heading or e.tag
        note = e.find("AUTH/P")
        if note is not None and (text := "".join(note.itertext()).strip()):
            item.attrs["auth_text"] = text


def volume(path: str, data: bytes) -> list[tuple[Item, str, str, int]]:
    """One volume of regulations: containers become items, sections units; authority notes are attributes.

    Its parts are read when they are asked for, as by ``tree.rows``, so a volume is never held as a tree.
    """
    m = re.search(r"CFR-(\d+)-title(\d+)-vol(\d+)\.xml$", path)
    if not m:
        raise ValueError("no volume in the file's name")
    year, title, number = m.groups()
    key = f"cfr{title}v{number}_{year}"
    return [(_Volume(data, title).document(), key, key, 1)]


def regulation(path: str, data: bytes) -> list[tuple[Item, str, str, int]]:
    """As ``volume``, with the whole tree."""
    return [(root.read(), *rest) for root, *rest in volume(path, data)]


# -- court decisions --------------------------------------------------------------------------------------------------

# Parts of a decision in their order, and kinds of numbering from the outermost on.
PARTS = ("tenor", "tatbestand", "entscheidungsgruende", "gruende", "abwmeinung", "sonstlt")
NUMBERING = (
    "alpha-dot alpha-bracket roman-upper arabic-dot arabic-bracket numeric-2 numeric-3 numeric-4 numeric-5 alpha-lower-dot-1 alpha-lower-bracket-1 alpha-lower-dot-2 alpha-lower-bracket-2 "
    "alpha-lower-dot-3 alpha-lower-bracket-3 alpha-lower-bracket-4 alpha-lower-double-bracket-1 alpha-lower-double-bracket-2 alpha-lower-double-bracket-3 alpha-lower-double-bracket-4"
).split()


_NUMBERS = tuple((kind, re.compile(pattern)) for kind, pattern in (("alpha-lower-bracket-{}", r"(([a-h])\2*)\)"), ("alpha-lower-double-bracket-{}", r"\((([a-h])\2*)\)"), ("alpha-lower-dot-{}", r"(([a-h])\2*)\."), ("roman-upper", r"((?:X[CL]|L?X{0,3})(?:I[XV]|V?I{0,3}))\.?"), ("arabic-dot", r"(\d+)\."), ("arabic-bracket", r"(\d+)\)"), ("alpha-dot", r"([A-H])\."), ("alpha-bracket", r"([A-H])\)")))
_NUMERIC = re.compile(r"(\d(?:\.\d)*)\.?")


def list_number(token: str) -> tuple[str | None, str | None]:
    """As ``text.list_number_type``, with the value."""
    for kind, pattern in _NUMBERS:
        if m := pattern.fullmatch(token):
            return kind.format(len(m[1])), m[1]
    m = _NUMERIC.fullmatch(token)
    return (f"numeric-{len(m[1].split('.'))}", m[1]) if m and len(token) > 1 else (None, None)


def paragraphs(part: ET.Element) -> list[tuple[str | None, str, bool]]:
    """``(number, content, indented)`` of the definition lists of a part; empty contents are left out."""
    out = []
    for dl in part.iter("dl"):
        dt, dd = dl.find("dt"), dl.find("dd")
        text = squeeze(" ".join(dd.itertext())) if dd is not None else ""
        p = dd.find("p") if dd is not None else None
        if text:
            number = squeeze(" ".join(dt.itertext())) if dt is not None else ""
            out.append((number or None, text, p is not None and "margin-left" in p.get("style", "")))
    return out


def decision(path: str, data: bytes) -> list[tuple[Item, str, str, int]]:
    """A decision as document, parts, numbered items and units; indented paragraphs go on with the text before them."""
    root = ET.fromstring(data.decode("utf-8").replace("\xa0", " "))
    first: dict[str, ET.Element] = {}
    for e in itertools.islice(root.iter(), 1, None):
        first.setdefault(e.tag, e)
    get = lambda tag: squeeze("".join(e.itertext())) if (e := first.get(tag)) is not None else ""
    court, date, number, kind = get("gertyp"), get("entsch-datum"), get("aktenzeichen"), get("doktyp")
    if not (court and len(date) == 8 and number and kind):
        raise ValueError("metadata is missing")
    doc = Item("document", attrs={"gericht": court, "datum": f"{date[:4]}-{date[4:6]}-{date[6:]}", "az": number, "doktyp": kind} | {k: v for k in ("spruchkoerper", "norm") if (v := get(k))})
    for name in PARTS:
        part = first.get(name)
        found = paragraphs(part) if part is not None else []
        if not found:
            continue
        top = Item("item", name)
        doc.parts.append(top)
        stack: list[tuple[int, Item]] = [(-1, top)]
        unit: Item | None = None
        for _, text, indented in found:
            if unit is not None and indented:
                unit.parts[0] += " " + text
                continue
            if indented:
                for place, token in enumerate(text.split()[:3]):
                    k, value = list_number(token)
                    if not k or (place and k == "alpha-dot"):
                        break
                    level = NUMBERING.index(k)
                    while stack[-1][0] >= level:
                        stack.pop()
                    item = Item("item", value)
                    stack[-1][1].parts.append(item)
                    stack.append((level, item))
            unit = Item("seqitem", parts=[text])
            stack[-1][1].parts.append(unit)
    return [(doc, base_name(path), base_name(path), 0)]
