"""Paths of nodes: statistics, structural XML and merged volumes against plain walks over trees."""

import random

import pytest

from citeloom.plans import volumes
from citeloom.sources import files, formats, tree
from citeloom.sources.tree import Item

STARTS = ["Part 1", "Part 2", "part 1—x", "Chapter I", ""]


def table(spark, trees):
    return spark.createDataFrame([r for t in trees for r in tree.rows(*t)], tree.NODE_SCHEMA)


def mixed_tree(r, depth=0):
    parts = [mixed_tree(r, depth + 1) if depth < 6 and r.random() < 0.4 else " ".join(r.choice(["a", "bb", "c", "d\te", ""]) for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 4))]
    return Item("document" if depth == 0 else "seqitem" if depth == 2 else "item", 'h "<&>\n', "", {"x": "1"}, parts)


def walked(item):
    """All texts below, in order."""
    for p in item.parts:
        yield from [p] if isinstance(p, str) else walked(p)


def test_statistics_of_every_node(spark):
    r = random.Random(3)
    roots = [mixed_tree(r) for _ in range(30)] + [Item("document")]
    deep = Item("document", parts=["w a"])
    for _ in range(150):
        deep = Item("document", parts=["a b", deep, "b"])
    roots.append(deep)
    nodes = table(spark, [(x, f"d{i}", f"d{i}", 1) for i, x in enumerate(roots)])
    bad = spark.createDataFrame([("d1", 0, *[None] * 14, "ParseError: x")], tree.NODE_SCHEMA)
    got = {(s["doc_id"], s["pos"]): s for s in tree.with_statistics(nodes).collect()}
    for i, root in enumerate(roots):
        for pos, item in enumerate(root.walk()):
            text = " ".join(walked(item))
            s = got[f"d{i}", pos]
            assert (s["chars_n"], s["chars_nowhites"], s["tokens_n"], s["tokens_unique"]) == (len(text), len("".join(text.split())), len(text.split()), len(set(text.split())))
    error = tree.with_statistics(nodes.unionByName(bad)).where("error is not null").first()
    assert error["chars_n"] is None and error["tokens_unique"] is None
    assert tree.with_statistics(nodes.where("false")).count() == 0


def test_xml_events_need_no_python(spark, tmp_path):
    r = random.Random(4)
    roots = [mixed_tree(r) for _ in range(20)]
    nodes = table(spark, [(x, f"d{i}", f"d{i}", 1) for i, x in enumerate(roots)])

    def shape(item):
        return (item.kind, item.heading, item.attrs, [" ".join(p.split()) if isinstance(p, str) else shape(p) for p in item.parts])

    made = {x["doc_id"]: x["xml"] for x in files.xml_documents(nodes).collect()}
    files.write_xml(nodes, str(tmp_path / "xml"))
    for i, root in enumerate(roots):
        assert shape(formats.structural("d", made[f"d{i}"].encode())[0][0]) == shape(root)
        (written,) = (tmp_path / "xml" / f"doc_id=d{i}").glob("*.txt")
        assert shape(formats.structural("d", written.read_bytes())[0][0]) == shape(root)
    assert "InPandas" not in files.xml_documents(nodes)._jdf.queryExecution().toString()


def volume(r, depth=0):
    if depth == 0:
        return Item("document", "Title 7", attrs={"document_type": "regulation"}, parts=[volume(r, 1) for _ in range(r.randint(0, 3))])
    if r.random() < 0.3:
        return Item("seqitem", f"§ {r.randint(1, 9)}", "", {}, ["text"])
    return Item("item", r.choice(STARTS), parts=[volume(r, depth + 1) for _ in range(r.randint(0, 3) if depth < 4 else 0)])


def merged_by_walking(found):
    """One volume after the other, with parents and places looked up anew for every container."""
    root, of = Item("document", "Title 7", attrs={"document_type": "regulation", "title": "7", "year": "2000"}), {}
    for number, top in found:
        of.update((id(x), number) for x in top.walk())
        root.parts += top.parts
    start = lambda x: " ".join(x.heading.split(" ")[:2]).lower().strip()
    begun, open_ = None, False
    for item in [x for x in root.walk() if x.kind == "item"]:
        if of[id(item)] != begun:
            begun, open_ = of[id(item)], True
        parent = next(x for x in root.walk() if any(p is item for p in x.parts))
        at = next(i for i, p in enumerate(parent.parts) if p is item)
        before = parent.parts[at - 1] if at else None
        open_ = open_ and before is not None and before.kind == "item" and bool(item.heading) and start(before) == start(item)
        if open_:
            before.parts += item.parts
            del parent.parts[at]
    return root, of


def expected(found):
    root, of = merged_by_walking(found)
    out, counts = [], {}

    def visit(item, parent, level, unit):
        if item is root:
            key = "cfr7v0_2000_000001"
        else:
            number = of[id(item)]
            counts[number] = counts.get(number, 0) + 1
            key = f"cfr7v{number}_2000_{counts[number]:06d}"
        unit = key if item.kind == "seqitem" else unit
        out.append(("cfr7_2000", len(out), key, parent, level, item.kind, item.heading, item.attrs, unit, item.texts(), len(item.parts)))
        for child in item.items():
            visit(child, key, level + 1, unit)

    visit(root, "", 0, None)
    return out


SHOWN = ["doc_id", "pos", "key", "parent_key", "level", "type", "heading", "attributes", "seqitem_key", "texts", "n_children"]


def merged(spark, found):
    nodes = table(spark, [(top, f"cfr7v{n}_2000", f"cfr7v{n}_2000", 1) for n, top in found])
    out = volumes.merged_volumes(nodes)
    rows = [tuple(r) for r in out.orderBy("pos").select(*SHOWN).collect()]
    assert [r[1] for r in rows] == [r["pos"] for r in out.orderBy("path").select("pos").collect()]
    return rows


def test_three_volumes_and_three_levels(spark):
    def chain(n, *below):
        return Item("document", "Title 7", parts=[Item("item", "Chapter I—x", parts=[Item("item", f"Part 5 of {n}", parts=[Item("item", "Subpart A", parts=[Item("seqitem", f"§ {n}", "", {}, [f"t{n}"])]), *below])])])

    found = [(2, chain(2)), (1, chain(1)), (10, chain(10, Item("item", "Subpart B")))]
    rows = merged(spark, found)
    assert [(r[4], r[5], r[6]) for r in rows] == [(0, "document", "Title 7"), (1, "item", "Chapter I—x"), (2, "item", "Part 5 of 1"), (3, "item", "Subpart A"), (4, "seqitem", "§ 1"), (4, "seqitem", "§ 2"), (4, "seqitem", "§ 10"), (3, "item", "Subpart B")]
    assert rows == expected(sorted(found, key=lambda x: x[0]))


@pytest.mark.parametrize("seed", range(6))
def test_merged_volumes_of_random_trees(spark, seed):
    """Containers that are empty, unnamed, or stand beside others of their name; volumes that have nothing."""
    r = random.Random(seed)
    found = [(n, volume(r)) for n in range(1, r.randint(3, 9))]
    assert merged(spark, found) == expected(found)


def test_merged_volumes_odd_input(spark):
    nodes = table(spark, [(Item("document", "Title 7"), "cfr7v1_2000", "cfr7v1_2000", 1)])
    bad = spark.createDataFrame([("x.xml", 0, *[None] * 14, "ParseError: x")], tree.NODE_SCHEMA)
    assert sorted((r["key"] or "", r["error"] or "") for r in volumes.merged_volumes(nodes.unionByName(bad)).collect()) == [("", "ParseError: x"), ("cfr7v0_2000_000001", "")]
    assert volumes.merged_volumes(nodes.where("false")).count() == 0


def test_headings_of_chapters():
    """A chapter without a heading has that of its table of contents, which stands before it as a chapter; the first one that of its volume."""

    def headings(inner):
        (root, *_), *_ = formats.regulation("CFR-2000-title7-vol1.xml", f"<CFRDOC>{inner}</CFRDOC>".encode())
        return [x.heading for x in root.items()]

    section = "<SECTION><SECTNO>§ 1</SECTNO><SUBJECT>s</SUBJECT><P>t</P></SECTION>"
    toc = "<CHAPTER><TOC><TOCHD><HD>Chapter II—Of it</HD></TOCHD></TOC><LRH>l</LRH></CHAPTER>"
    bare = f"<CHAPTER>{section}</CHAPTER>"
    volume_toc = "<FMTR><TOC><TITLENO><CHAPTI><SUBJECT>Other</SUBJECT></CHAPTI><CHAPTI><SUBJECT>Chapter III </SUBJECT></CHAPTI></TITLENO></TOC></FMTR>"
    assert headings(f"<TITLE>{toc}{bare}</TITLE>") == ["Chapter II—Of it"] * 2
    assert headings(f"<TITLE>{bare}{bare}</TITLE>") == ["CHAPTER", "CHAPTER"]
    assert headings(f"{volume_toc}<TITLE>{bare}{bare}</TITLE>") == ["Chapter III", "CHAPTER"]
    assert headings(f"{volume_toc}<TITLE><CHAPTER><HD>Own</HD>{section}</CHAPTER>{bare}</TITLE>") == ["Own", "CHAPTER"]
    assert headings(f"<TITLE><CHAPTER><RESERVED>Chapter V [Reserved]</RESERVED>{section}</CHAPTER></TITLE>") == ["Chapter V [Reserved]"]


def test_volumes_are_parsed_once(spark, sf, tmp_path, monkeypatch):
    import os
    import uuid

    from citeloom.plans import documents

    folder, parse = str(tmp_path), documents.formats.volume

    def noted(path, data):
        open(os.path.join(folder, f"{os.path.basename(path)}-{uuid.uuid4().hex}"), "w").close()
        return parse(path, data)

    monkeypatch.setattr(documents.formats, "volume", noted)
    assert documents.merged_volumes(spark, sf).count()
    names = [name.rsplit("-", 1)[0] for name in os.listdir(folder)]
    assert names and len(names) == len(set(names))
