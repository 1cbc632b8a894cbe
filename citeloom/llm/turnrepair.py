"""Repair of the turns of conversations: the cheapest edits that bring roles into order and faulty turns out.

A turn is a symbol: its role's initial and its fault. A conversation is the signature of its turns, and equal
signatures have equal edits. Different signatures are sorted, so that a worker walks the prefix trie of its part with a
stack: the layers of costs of a prefix are made once for all signatures that share it, and a signature's end reads its
edits from the layers on its path. Rows are joined with the edits by one sort, and pass one after another, so no
conversation is held as a whole.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from citeloom.llm import common

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What may come next: nothing is there yet, a system turn, a user turn, an assistant turn is the last.
START, SYSTEM, USER, PAIR = range(4)
NEXT = {START: ("s", "u"), SYSTEM: ("u",), USER: ("a",), PAIR: ("u",)}
AFTER = {"s": SYSTEM, "u": USER, "a": PAIR}
FAR = 1 << 60
#: Turns whose symbols are gathered at once, and rows that pass to Python at once.
CHUNK, ROWS = 4_096, 1_000
Layer = tuple[int, int, int, int]


# -- edits of a signature -------------------------------------------------------------------------------------------


def edits_of(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """``(edit, cost, state)`` that a turn allows: ``D``, then ``K``, then rerolings to ``U`` or ``A``, which is the order of their initials."""
    yield "D", DELETE, state
    if symbol != "x":
        extra, role = TRUNCATED if symbol.isupper() else 0, symbol.lower()
        if role in NEXT[state]:
            yield "K", extra, AFTER[role]
        to = NEXT[state][-1]
        yield to.upper(), REROLE + extra, AFTER[to]


def inserted(costs: list[int]) -> Layer:
    """Costs with turns put in: one user turn from anywhere, and one assistant turn behind a user turn."""
    user = min(costs[USER], min(costs[START], costs[SYSTEM], costs[PAIR]) + INSERT)
    return costs[START], costs[SYSTEM], user, min(costs[PAIR], user + INSERT)


def layer_after(layer: Layer, symbol: str) -> Layer:
    costs = [FAR] * 4
    for state in range(4):
        for _, cost, to in edits_of(symbol, state):
            costs[to] = min(costs[to], layer[state] + cost)
    return inserted(costs)


def cheapest(signature: str, layers: list[Layer]) -> tuple[int, str]:
    """``(cost, plan)`` from the layers of all prefixes; of plans of equal cost the one whose initials come first as ASCII.

    A plan has ``D`` and ``K`` for turns that go or stay, ``U`` and ``A`` for new roles, ``u`` and ``a`` for turns put in.
    Going back, the states on cheapest ways are marked; going forward, the first initial that stays on one is taken. No
    way is the start of another one, as what it lacks are insertions, which cost something.
    """
    n = len(signature)
    best = min(layers[n][START], layers[n][PAIR])
    marks: list[set[int]] = [set() for _ in range(n)] + [{s for s in (START, PAIR) if layers[n][s] == best}]
    for d in range(n, -1, -1):
        own, here = layers[d], marks[d]
        if d < n:
            here.update(s for s in range(4) for _, cost, to in edits_of(signature[d], s) if to in marks[d + 1] and own[s] + cost == layers[d + 1][to])
        if PAIR in here and own[USER] + INSERT == own[PAIR]:
            here.add(USER)
        if USER in here:
            here.update(s for s in (START, SYSTEM, PAIR) if own[s] + INSERT == own[USER])
    plan, d, state = [], 0, START
    while d < n or state not in (START, PAIR) or layers[n][state] != best:
        own = layers[d]
        ways = [(e, own[state] + cost, to) for e, cost, to in edits_of(signature[d], state) if to in marks[d + 1] and own[state] + cost == layers[d + 1][to]] if d < n else []
        put = NEXT[state][-1]
        if (not ways or ways[0][0] != "D") and AFTER[put] in marks[d] and own[state] + INSERT == own[AFTER[put]]:
            plan.append(put)
            state = AFTER[put]
            continue
        edit, _, state = ways[0]
        plan.append(edit)
        d += 1
    return best, "".join(plan)


def walk(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """``(signature, cost, plan)`` for sorted signatures; the stack holds the layers from the trie's root to the last one's end."""
    layers, before = [inserted([0, FAR, FAR, FAR])], ""
    for signature in signatures:
        shared = len(os.path.commonprefix((before, signature)))
        del layers[shared + 1 :]
        for symbol in signature[shared:]:
            layers.append(layer_after(layers[-1], symbol))
        yield signature, *cheapest(signature, layers)
        before = signature


def plans(signatures: DataFrame) -> DataFrame:
    """``(signature, cost, plan)`` of every different signature of the column ``signature``; a range of the sorted ones is a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = walk(s for b in batches for s in b.column(0).to_pylist())
        while some := list(itertools.islice(answers, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["signature", "cost", "plan"])

    return signatures.select("signature").distinct().orderBy("signature").mapInArrow(run, "signature string, cost bigint, plan string")


# -- conversations --------------------------------------------------------------------------------------------------


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("_text").asc()]


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, plan)`` of every conversation of ``rows``, and of ``ids`` if given.

    Takes ``(conv_id, turn, role, text)``. Turns go by their number, nulls first; those of one number by role, then by a
    checksum of their text. The first fault of a turn counts: blank (nothing but white space), duplicate (an earlier turn
    has its role and text), truncated (no ``.``, ``!`` or ``?`` at its end). ``gaps`` are the numbers missing between the
    least and the largest, ``illegal`` the neighbours whose roles don't start with ``su``, ``ua`` or ``au``. Null roles
    and texts count as one space. A null ``conv_id`` is a conversation. Conversations that only ``ids`` has get zeros
    and an empty plan; an empty table gives no rows. Texts don't move, only their checksums do.

    A conversation's turns are sorted by one task, and its signature and plan are strings of one character a turn.
    """
    text = F.coalesce("text", F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), -1, 1)
    facts = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.md5(text)).alias("_text"), (last == "").alias("_blank"), (~last.isin(".", "!", "?")).alias("_open"))
    facts = facts.repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "_text").orderBy(F.col("turn").asc_nulls_first())
    facts = facts.withColumn("_again", (F.row_number().over(seen) > 1) & ~F.col("_blank"))
    line = Window.partitionBy("conv_id").orderBy(*_order(), F.col("_again"))
    facts = facts.withColumn("_pos", F.row_number().over(line)).withColumn("_initial", F.substring("role", 1, 1)).withColumn("_before", F.lag("_initial").over(line)).withColumn("_turn", F.lag("turn").over(line))
    stays = ~F.col("_blank") & ~F.col("_again")
    role = F.when(F.col("_initial").isin("s", "u", "a"), F.col("_initial")).otherwise("o")
    symbol = F.when(~stays, "x").when(F.col("_open"), F.upper(role)).otherwise(role)
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    joined = lambda at, piece: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), piece.alias("x")))), lambda s: s["x"]), "")
    chunks = facts.groupBy("conv_id", F.floor((F.col("_pos") - 1) / CHUNK).alias("_chunk")).agg(
        joined("_pos", symbol).alias("_piece"),
        F.min("turn").alias("_least"),
        F.max("turn").alias("_most"),
        one(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))).alias("_turns"),
        one(F.col("_blank")).alias("blank"),
        one(F.col("_again")).alias("duplicate"),
        one(stays & F.col("_open")).alias("truncated"),
        one(~F.concat("_before", "_initial").isin("su", "ua", "au")).alias("illegal"),
    )
    if ids is not None:
        chunks = chunks.unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    gaps = F.coalesce(F.max("_most") - F.min("_least") + 1 - F.sum("_turns"), F.lit(0)).cast("long")
    found = common.materialize(chunks.groupBy("conv_id").agg(gaps.alias("gaps"), *map(total, ("blank", "duplicate", "truncated", "illegal")), joined("_chunk", F.coalesce("_piece", F.lit(""))).alias("signature")))
    return common.join_small(found, common.materialize(plans(found), ROWS), ["signature"]).drop("signature")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, edit)``: the turns of ``rows`` after the plans of ``report``, each conversation's in order within a partition.

    ``edit`` is ``K`` for a turn that stays, ``R`` for one with a new role, ``I`` for one put in, without turn number and
    with an empty text. One sort brings plans and rows together; a worker holds one plan and one batch of rows.
    """
    text = F.coalesce("text", F.lit(" "))
    turns = rows.select("conv_id", F.lit(None).cast("string").alias("plan"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("_text"))
    heads = found.select("conv_id", F.coalesce("plan", F.lit("")).alias("plan"))
    both = heads.unionByName(turns, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", F.col("plan").isNull(), *_order())
    src = both.select("conv_id", "plan", "turn", "role", "text")
    schema = T.StructType([src.schema["conv_id"], src.schema["turn"], *T.StructType.fromDDL("role string, text string, edit string")])
    roles = {"u": "user", "a": "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, at, conv = "", 0, None

        def put_in() -> Iterator[tuple]:
            nonlocal at
            while at < len(plan) and plan[at] in roles:
                yield conv, None, roles[plan[at]], "", "I"
                at += 1

        def turned(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal plan, at, conv
            for key, head, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head is not None:
                    plan, at, conv = head, 0, key
                else:
                    edit = plan[at]
                    at += 1
                    if edit != "D":
                        yield key, turn, role if edit == "K" else roles[edit.lower()], text, "K" if edit == "K" else "R"
                yield from put_in()

        for batch in batches:
            types = (batch.schema.field(0).type, batch.schema.field(2).type, pa.string(), pa.string(), pa.string())
            out = list(turned(batch))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=schema.names)

    return src.mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, sha256)`` over ``role:text`` of consecutive turns, joined by newlines; takes what ``repaired`` returns, row by row."""
    src = turns.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    schema = T.StructType([src.schema["conv_id"], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind = None, None, None
        made = lambda done: pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], kind), pa.array([r[1] for r in done], pa.string())], names=schema.names)
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or key != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = key, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield made(done)
        if state is not None:
            yield made([(conv, state.hexdigest())])

    return src.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by a checksum of conversation and turn: dropped, emptied, without ends of sentences, twice, or a user's; nulls are one space first."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_hit")).where("_hit <> 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_hit") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")
