"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field (no generated classes), and the same tokenizer is rebuilt from parts of the
tokenizers library: the normaliser, the metaspace marker, the pieces with their scores (a unigram model keeps its
scores; a BPE model turns them into merge ranks) and byte fallback. ``verify_parity`` compares both libraries.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes of words and ids that a worker keeps (an entry's own 200 bytes included); beyond that it starts anew.
MAX_KNOWN_BYTES = 32_000_000
#: Words of one result of the library, and results of a batch that its threads share.
GROUP, GROUPS = 500, 16
# Piece types and model types of the SentencePiece model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_state: dict = {}


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    unk_id: int = 0
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes = b""


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of every field of a protobuf message."""
    pos = 0

    def varint() -> int:
        nonlocal pos
        value = shift = 0
        while True:
            byte = data[pos]
            pos += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while pos < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            n = varint()
            yield number, data[pos : pos + n]
            pos += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield number, data[pos : pos + n]
            pos += n
        else:
            raise ValueError(f"wire type {kind}")


def parse_model(data: bytes) -> Model:
    """Pieces, trainer and normaliser settings of a serialized model."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.model_type = v
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk_id = v
                elif n == 44:
                    m.unk_surface = v.decode("utf-8")
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    if m.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.model_type} is neither unigram nor BPE")
    return m


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces is a merge; a merge ranks by the score of what it makes."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for i, (piece, score, kind) in enumerate(pieces):
        if kind != NORMAL or len(piece) < 2:
            continue
        own = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        found += [(-score, i, ids[a], ids[b], a, b) for a, b in own]
    found.sort(key=lambda x: x[:4])
    return [(a, b) for *_, a, b in found]


def build(model: Model):
    """The tokenizers-library form of ``model``."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    else:
        unk = model.pieces[model.unk_id][0]
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=merges_of(model.pieces), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_whitespaces else " "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    mark = MARK if model.escape_whitespaces else " "
    if model.escape_whitespaces and not any(mark in p[k:] and p[k - 1] != mark for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED) for k in range(1, len(p))):
        # no piece has a marker after another character, so no merge crosses such a border: words can be encoded, and
        # cached, one by one
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{mark}*[^{mark}]+|{mark}+"), "isolated")
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(parts + [decoders.Strip(content=" ", left=1, right=0)] if model.add_dummy_prefix else parts)
    t.no_padding()
    t.no_truncation()
    return t


def _ascii_byte(piece: str) -> str | None:
    """The character of a byte piece below 128, which stands for itself wherever it is; None for other bytes."""
    value = int(piece[1:-1], 16)
    return chr(value) if value < 128 else None


class Codec:
    """Encodes and decodes batches; the library spreads a batch over its threads."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.tokenizer = build(self.model)
        #: Words are independent of each other if the tokenizer splits text into them.
        self.words = type(self.tokenizer)(self.tokenizer.model) if self.tokenizer.pre_tokenizer else None
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers
        self.before: dict[str, bytes] = {}  # the generation before
        self.odd: set[str] = set()  # words that have pieces which aren't plain, or don't decode to themselves
        self.held = 0
        plain = (NORMAL, USER_DEFINED, UNUSED)
        self.surface = [p if kind in plain else _ascii_byte(p) if kind == BYTE else self.model.unk_surface if kind == UNKNOWN else None for p, _, kind in self.model.pieces]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text. Where words are independent, each different word is encoded once, all new ones in batches."""
        if self.words is None:
            return [np.array(x.ids, dtype=np.int32) for x in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        split = [self.split(t) for t in texts]
        self._learn(split)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=np.int32) for words in split]

    def encode_and_check(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of every text, and whether they decode to the normalised text.

        Plain pieces decode to themselves one by one, so a text is right if all its words are; a word's own ids are decoded
        when it is new. Texts with any other word, or of a model whose words aren't independent, are decoded whole.
        """
        ids = self.encode(texts)
        sure = [False] * len(texts) if self.words is None else [self.odd.isdisjoint(self.split(t)) for t in texts]
        rest = [i for i, known in enumerate(sure) if not known]
        for i, back in zip(rest, self.decode([ids[i] for i in rest]), strict=True):
            sure[i] = back == self.normal(texts[i])
        return ids, sure

    def split(self, text: str | None) -> list[str]:
        """The words of the normalised text, each with the markers before it."""
        m = self.model
        if not text:
            return []
        if m.add_dummy_prefix and not (m.charsmap or m.remove_extra_whitespaces) and text[0] != " " and text[-1] != " " and MARK not in text and "  " not in text:
            return (MARK + text.replace(" ", f" {MARK}")).split(" ")
        return _WORDS.findall(self.normalised(text))

    def _learn(self, split: list[list[str]]) -> None:
        """Put all words of ``split`` into ``known``: from the generation before, or by encoding them."""
        if self.held > MAX_KNOWN_BYTES // 2:  # words that aren't met for a whole generation are forgotten
            self.before, self.known, self.held = self.known, {}, 0
            self.odd &= self.before.keys()
        known, before, new = self.known, self.before, []
        for word in {w for words in split for w in words if w not in known}:
            ids = before.get(word)
            if ids is None:
                new.append(word)
            else:
                known[word] = ids
                self.held += 200 + 4 * len(word) + len(ids)
        # one result of the library holds many words, which it tells apart by their numbers
        groups = [new[i : i + GROUP] for i in range(0, len(new), GROUP)]
        for i in range(0, len(groups), GROUPS):
            some = groups[i : i + GROUPS]
            for words, x in zip(some, self.words.encode_batch(some, is_pretokenized=True, add_special_tokens=False), strict=True):
                self._keep(words, x.ids, np.array(x.word_ids, dtype=np.int64))

    def _keep(self, words: list[str], ids: list[int], owner: np.ndarray) -> None:
        blob = np.array(ids, dtype=np.int32).tobytes()
        cuts = np.searchsorted(owner, np.arange(len(words) + 1))
        at = (4 * cuts).tolist()
        self.known.update((w, blob[a:b]) for w, a, b in zip(words, at[:-1], at[1:], strict=True))
        self.held += 200 * len(words) + 4 * sum(map(len, words)) + len(blob)
        pieces = list(map(self.surface.__getitem__, ids))
        ends = np.concatenate([[0], np.cumsum([-1_000_000 if p is None else len(p) for p in pieces], dtype=np.int64)])[cuts]
        if None in pieces or "".join(pieces) != "".join(words) or np.diff(ends).tolist() != list(map(len, words)):
            at = cuts.tolist()
            for word, a, b in zip(words, at[:-1], at[1:], strict=True):
                if None in pieces[a:b] or "".join(pieces[a:b]) != word:
                    self.odd.add(word)

    def decode(self, ids: list) -> list[str]:
        """Lists of plain pieces are joined here; an unknown piece is the model's surface for it; those with other bytes or control pieces go to the library's decoder."""
        out: list[str | None] = []
        for one in ids:
            try:
                text = "".join(map(self.surface.__getitem__, one.tolist() if isinstance(one, np.ndarray) else one)).replace(MARK, " ")
            except TypeError:
                text = None
            out.append(text[1:] if text and text[0] == " " and self.model.add_dummy_prefix and one[0] != self.model.unk_id else text)
        rest = [i for i, t in enumerate(out) if t is None]
        for i, t in zip(rest, self.tokenizer.decode_batch([[int(k) for k in ids[i]] for i in rest], skip_special_tokens=False), strict=True):
            out[i] = t
        return out

    def normalised(self, text: str | None) -> str:
        m = self.model
        if not text:
            return ""
        if m.charsmap or m.remove_extra_whitespaces or not m.escape_whitespaces or not m.add_dummy_prefix:
            return self.tokenizer.normalizer.normalize_str(text)
        return MARK + text.replace(" ", MARK)

    def normal(self, text: str | None) -> str:
        """What decoding gives back: the normalised text with spaces for markers and without the prefix."""
        if not text:
            return ""
        out = self.normalised(text).replace(MARK, " ")
        return out[1:] if self.model.add_dummy_prefix else out


def codec(path: str) -> Codec:
    if path not in _state:
        _state.clear()
        _state[path] = Codec(path)
    return _state[path]


def verify_parity(path: str, texts: list[str]) -> list[int]:
    """Positions of texts that the two libraries encode or decode differently; empty when they agree."""
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=path)
    mine = codec(path)
    ids = mine.encode(texts)
    theirs = other.encode(texts, num_threads=1)
    back, back_too = mine.decode(ids), other.decode(theirs)
    return [i for i in range(len(texts)) if ids[i].tolist() != theirs[i] or back[i] != back_too[i]]


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", n_tokens: str = "n_tokens", round_trip: str = "round_trip") -> DataFrame:
    """Add the ids of every whole text, their number, and whether decoding gives the normalised text back.

    Null and empty texts have no ids and a true round trip. Existing columns of the three names are replaced, repeated
    rows are coded alike, and an empty table stays empty. Rows are mapped in Arrow batches that are cut by bytes of
    text, so that a batch of very long texts stays small; nothing is shuffled.
    """

    def start():
        c = codec(path)

        def turn(texts: list) -> list[pa.Array]:
            some, ok = c.encode_and_check(texts)
            sizes = np.array([len(x) for x in some], dtype=np.int64)
            ends = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(sizes, dtype=np.int32)])
            values = np.concatenate(some) if some else np.empty(0, dtype=np.int32)
            return [pa.ListArray.from_arrays(ends, pa.array(values, type=pa.int32())), pa.array(sizes), pa.array(ok, type=pa.bool_())]

        return turn

    return common.map_texts(df, text, f"`{ids}` array<int>, `{n_tokens}` bigint, `{round_trip}` boolean", start)


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the text of every list of ids; null and empty lists give an empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for lists in batches:
            yield pd.Series(c.decode([[] if x is None else [int(i) for i in x] for x in lists]), dtype="object")

    return df.withColumn(text, run(F.col(f"`{ids}`")))
