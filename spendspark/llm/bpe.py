"""Operator 9: BPE encoding and decoding with a contiguous rank array.

A word is held as a short array of parts and a parallel array with the rank of each adjacent pair. The smallest rank is
found by a scan, the boundary behind it is deleted, and only the two neighbouring ranks are looked up again. New words of
a batch take these steps together, one row of an array each. Words longer than LONG symbols, where scans would be quadratic, keep the same order of merges in a heap.

The vocabulary is a public one in the ``tokenizers`` JSON format (word-end BPE: NFC, white space to one blank, lower case,
byte-level letters, end-of-word suffix); its path is a parameter. Encoded words are remembered in a task, up to a bound.

Cases: null text counts as empty; empty text has no ids and decodes to ''; texts of any length are encoded whole; the
strings of special tokens become their ids, as in the library; of equal ranks in a word the leftmost is merged first; a
vocabulary with more than 131,072 ids in its merges is refused; equal rows give equal results; extra columns pass through,
those named like an output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.common import arrow_columns

LONG, ROW, CACHED, GROUP_CHARS = 256, 32, 400_000, 2_000_000
_NEVER, NO_RANK = 1 << 60, 2**31 - 1
#: Fixed: what the vocabulary's pattern takes for white space.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _class(kind: str, highest: int) -> str:
    """The code points up to ``highest`` whose general category starts with ``kind``, as ranges for a character class."""
    ranges: list[list[int]] = []
    for c in range(highest + 1):
        if unicodedata.category(chr(c))[0] == kind:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=3)
def word_pattern(highest: int) -> re.Pattern:
    """The vocabulary file's word pattern for text in lower case with code points up to ``highest``; its alternatives begin
    with different characters but for the last two, so their order is free."""
    letter, number = _class("L", highest), _class("N", highest)
    return re.compile(f"[{letter}]+|[{number}]|'s|'t|'re|'ve|'m|'ll|'d|[^{letter}{number}{WHITE_SPACE}]+")


def words_of(text: str) -> list[str]:
    """The words of a text without special tokens, normalised."""
    if text.isascii():
        return word_pattern(0x7F).findall(text.lower())
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return word_pattern(0xFFFF if 2 * len(text) == len(text.encode("utf-16-le", "surrogatepass")) else sys.maxunicode).findall(text)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, added = data["model"], data["added_tokens"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = _byte_letters()
        self.inner, self.last = [ids[c] for c in letters], [ids[c + suffix] for c in letters]
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[ids[a], ids[b]] = rank
        self.made = [ids[a + b] for a, b in model["merges"]]
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_short(parts: list[int], v: Vocabulary) -> list[int]:
    """Scan, delete a boundary, refresh the two neighbours."""
    rank, made = v.ranks.get, v.made
    ranks = [rank(p, _NEVER) for p in zip(parts, parts[1:])]
    while ranks and (best := min(ranks)) < _NEVER:
        i = ranks.index(best)
        parts[i] = p = made[best]
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = rank((parts[i - 1], p), _NEVER)
        if i < len(ranks):
            ranks[i] = rank((p, parts[i + 1]), _NEVER)
    return parts


def merge_long(parts: list[int], v: Vocabulary) -> list[int]:
    """The same order of merges (rank, then place) from a heap over linked parts."""
    n, rank = len(parts), v.ranks.get
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j], after[i] = v.made[r], -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] >= 0 and (r := rank((parts[x], parts[after[x]]))) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
    return [p for p in parts if p >= 0]


class PairRanks:
    """Ranks of pairs of ids for whole arrays of pairs: an open table, and a second one for keys that meet in the first."""

    def __init__(self, ranks: dict[tuple[int, int], int]):
        if any(a >> 17 or b >> 17 for a, b in ranks):
            raise ValueError("pairs of ids from 131,072 on don't fit a key")
        keys = np.array([a << 17 | b for a, b in ranks] or [-2], dtype=np.int64)
        values = np.array(list(ranks.values()) or [0], dtype=np.int32)
        self.tables = []
        seed = 0x9E3779B97F4A7C15
        while len(keys):
            multiplier = np.uint64(seed)
            slot = self._slot(keys, multiplier)
            _, first = np.unique(slot, return_index=True)
            held, rank = np.full(1 << 20, -1, dtype=np.int64), np.full(1 << 20, NO_RANK, dtype=np.int32)
            held[slot[first]], rank[slot[first]] = keys[first], values[first]
            self.tables.append((multiplier, held, rank))
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, values, seed = keys[rest], values[rest], seed * 0xD1342543DE82EF95 + 2 & (1 << 64) - 1 | 1

    @staticmethod
    def _slot(keys: np.ndarray, multiplier: np.uint64) -> np.ndarray:
        return (keys.astype(np.uint64) * multiplier >> np.uint64(44)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 17 | right
        out = np.full(keys.shape, NO_RANK, dtype=np.int32)
        for multiplier, held, rank in self.tables:
            slot = self._slot(keys, multiplier)
            out = np.where(held[slot] == keys, rank[slot], out)
        return np.where((left < 0) | (right < 0), NO_RANK, out)


def merge_together(parts: np.ndarray, ranks_of: PairRanks, made: np.ndarray) -> np.ndarray:
    """``merge_short`` for many words at once: one row each, filled up with -1. Returns the rows with their final parts."""
    done = parts.copy()
    rows, ranks, columns = np.arange(len(parts)), ranks_of(parts[:, :-1], parts[:, 1:]), np.arange(parts.shape[1])
    while len(rows):
        place = ranks.argmin(axis=1)
        each = np.arange(len(rows))
        best = ranks[each, place]
        if (ended := best == NO_RANK).any():
            done[rows[ended]] = parts[ended]
            rows, parts, ranks, place, best = (x[~ended] for x in (rows, parts, ranks, place, best))
            each = np.arange(len(rows))
            if not len(rows):
                break
        source = columns + (columns > place[:, None])
        parts = np.take_along_axis(np.pad(parts, ((0, 0), (0, 1)), constant_values=-1), source, axis=1)
        parts[each, place] = made[best]
        ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 2)), constant_values=NO_RANK), source[:, :-1], axis=1)
        before, after = np.maximum(place - 1, 0), np.minimum(place + 1, parts.shape[1] - 1)
        refreshed = ranks_of(parts[each, place], np.where(after > place, parts[each, after], -1))
        inside = place < ranks.shape[1]
        ranks[each[inside], place[inside]] = refreshed[inside]
        left = place > 0
        ranks[each[left], before[left]] = ranks_of(parts[each, before], parts[each, place])[left]
    return done


class Encoder:
    """Whole texts to ids, packed as little-endian unsigned 32-bit integers.

    Remembers the ids of words, up to a bound. New words of a batch are merged together.
    """

    def __init__(self, path: str):
        self.v, self.words = vocabulary(path), {}
        v = self.v
        self.inner, self.last, self.made = (np.array(x or [0], dtype=np.int32) for x in (v.inner, v.last, v.made))
        self.ranks_of = PairRanks(v.ranks)

    def _merge_alone(self, word: str) -> bytes:
        raw = word.encode()
        parts = [self.v.inner[b] for b in raw]
        parts[-1] = self.v.last[raw[-1]]
        return np.array((merge_short if len(parts) <= LONG else merge_long)(parts, self.v), dtype="<u4").tobytes()

    def _merge_words(self, words: list[str]) -> None:
        """Learns ``words``, each of at most ROW bytes, a width of row at a time."""
        raws = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        for low, high in ((0, 8), (8, 16), (16, ROW)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(chosen):
                continue
            n = sizes[chosen]
            flat = np.frombuffer(b"".join([raws[i] for i in chosen]), dtype=np.uint8)
            ends = np.cumsum(n)
            ids = self.inner[flat]
            ids[ends - 1] = self.last[flat[ends - 1]]
            rows = np.full((len(chosen), high), -1, dtype=np.int32)
            rows[np.arange(high) < n[:, None]] = ids
            rows = merge_together(rows, self.ranks_of, self.made)
            kept = rows >= 0
            packed, ends = rows[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
            start = 0
            for i, end in zip(chosen.tolist(), ends, strict=True):
                self.words[words[i]] = packed[start:end]
                start = end

    def _plain(self, pieces: list[str]) -> list[bytes]:
        """The ids of texts without special tokens."""
        split = [words_of(t) for t in pieces]
        met = set().union(*split)
        new = {w for w in met if w not in self.words}
        if len(self.words) + len(new) > CACHED:
            self.words.clear()
            new = met
        long = {w for w in new if 4 * len(w) > ROW and len(w.encode()) > ROW}
        self._merge_words([w for w in new if w not in long])
        self.words.update((w, self._merge_alone(w)) for w in long)
        packed = [b"".join(map(self.words.__getitem__, words)) for words in split]
        for w in long:
            del self.words[w]
        return packed

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """All ids of each whole text; null counts as empty."""
        out: list[bytes] = []
        for group in _groups([t or "" for t in texts]):
            pieces, joints = [], []
            for t in group:
                if self.v.cut is None or not any(s in t for s in self.v.special):
                    joints.append([len(pieces)])
                    pieces.append(t)
                    continue
                joints.append([])
                at = 0
                for m in self.v.cut.finditer(t):
                    joints[-1] += [len(pieces), m[0]]
                    pieces.append(t[at : m.start()])
                    at = m.end()
                joints[-1].append(len(pieces))
                pieces.append(t[at:])
            packed = self._plain(pieces)
            out += [packed[j[0]] if len(j) == 1 else b"".join([packed[x] if isinstance(x, int) else self.v.special[x].to_bytes(4, "little") for x in j]) for j in joints]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, packed: bytes | None) -> str:
        """The tokens of the ids, joined as the library joins them where a vocabulary names no decoder."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(packed or b"", dtype="<u4").tolist()))


def _groups(texts: list[str]):
    """Runs of texts of about GROUP_CHARS characters, so that split texts stay small."""
    group, chars = [], 0
    for t in texts:
        group.append(t)
        chars += len(t)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


_IDS = [T.StructField("ids", T.BinaryType(), False), T.StructField("n_tokens", T.LongType(), False)]
_DECODED = T.StructField("decoded", T.StringType(), False)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (packed little-endian unsigned 32-bit) and ``n_tokens``; the text column stays."""

    def start():
        coder = Encoder(path)

        def run(texts):
            ids = coder.encode_many(texts)
            return [ids, [len(x) // 4 for x in ids]]

        return run

    return arrow_columns(df, text, _IDS, start)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` for packed ids."""

    def start():
        coder = Encoder(path)
        return lambda packed: [[coder.decode(x) for x in packed]]

    return arrow_columns(df, ids, [_DECODED], start)


def encode_and_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass of the data through Python."""

    def start():
        coder = Encoder(path)

        def run(texts):
            ids = coder.encode_many(texts)
            return [ids, [len(x) // 4 for x in ids], [coder.decode(x) for x in ids]]

        return run

    return arrow_columns(df, text, [*_IDS, _DECODED], start)


def op9(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    import public_tokenizers

    from spendspark.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__text"))
    out = encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"), "__text")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
