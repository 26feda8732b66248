"""Operator 8: best-fit packing by hierarchical residual packing.

Documents are tokenised once; only those longer than a sequence are cut. Each partition packs its pieces best-fit, longest
first, and emits the bins that are nearly full. Pieces of underfull bins go on to a level with a FAN_IN-th of the
partitions, where each underfull bin is one item for another round of best-fit. The last level emits all: that of one
partition, or the first that merges hardly any bins, so that no task gets all bins that nothing fits into.

Pieces carry lengths and checksums, not tokens. Each level is written to the shared folder: packing depends on which rows a
partition holds, and rereading a written table gives the same rows after an executor is lost.

Cases: a null or empty text is one piece that holds the closing id alone; texts of any length are cut whole, the last piece
may be shorter; equal lengths go by id and piece number; repeated rows are packed each on its own; rows without an id are
packed as well; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.bpe import Encoder
from spendspark.llm.common import arrow_columns, quoted, table, written

CAPACITY, CLOSING_ID = 2048, 0
#: A bin this full is emitted before the last level; partitions that meet in one of the next level; pieces for a partition.
NEARLY_FULL, FAN_IN, PIECES_EACH = 2048 - 8, 16, 40_000
#: A level that leaves more than this part of its bins is the last: merging has nothing to gain any more.
SHRINKS = 0.98
_PIECE = T.StructType([T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False)])


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[dict]:
    """Pieces of one document's packed ids, the closing id included."""
    whole = ids + CLOSING_ID.to_bytes(4, "little")
    step = 4 * capacity
    return [{"piece": k, "start": i // 4, "length": len(whole[i : i + step]) // 4, "ids_crc32": zlib.crc32(whole[i : i + step])} for k, i in enumerate(range(0, len(whole), step))]


def tokenised(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length and ids_crc32."""

    def start():
        coder = Encoder(path)
        return lambda texts: [[pieces_of(ids, capacity) for ids in coder.encode_many(texts)]]

    given = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("__text"))
    made = arrow_columns(given, "__text", [T.StructField("pieces", T.ArrayType(_PIECE, False), False)], start, keep_source=False)
    return made.select("doc_id", F.inline("pieces"))


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of indexes of ``sizes``, which come longest first: each goes where the least room is left."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # distinct amounts of room, sorted
    by_room: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, size)
        if at == len(rooms):
            room, b = capacity, len(bins)
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[b].append(i)
        if left := room - size:
            if left not in by_room:
                insort(rooms, left)
                by_room[left] = []
            by_room[left].append(b)
    return bins


_ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, lane int, done boolean"


def _level(rows: DataFrame, last: bool, capacity: int, level: int, nearly_full: int) -> DataFrame:
    """Packs the items of each partition; an item is a bin of the level below, or a piece by itself (negative bin number)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # One partition's pieces, as numbers only: PIECES_EACH of them, and fewer on the levels above.
        full = [b for b in batches if b.num_rows]
        if not full:
            return
        held = pa.Table.from_batches(full)
        ids = pa.compute.fill_null(held["doc_id"], -(2**63)).to_numpy()
        piece, length, bin_ = (held[c].to_numpy() for c in ("piece", "length", "bin"))
        start, crc = held["start"].to_numpy(), held["ids_crc32"].to_numpy()
        alone = bin_ < 0
        key = np.where(alone, np.arange(len(bin_)) + bin_.max() + 1, bin_)
        _, item = np.unique(key, return_inverse=True)
        size = np.bincount(item, weights=length).astype(np.int64)
        # Longest first; ties by the smallest id, piece and place, so that equal partitions pack alike.
        order = np.lexsort((crc, start, piece, ids))
        first = np.full(len(size), len(order))
        np.minimum.at(first, item[order], np.arange(len(order)))
        ranked = np.lexsort((first, -size))
        bins = best_fit(size[ranked].tolist(), capacity)
        place = np.empty(len(size), dtype=np.int64)
        number, fill = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
        for b, members in enumerate(bins):
            at = 0
            for m in ranked[members].tolist():
                place[m], number[m] = at, b
                at += int(size[m])
            fill[ranked[members]] = at
        # Within an item, pieces keep their order in the bin of the level below.
        within = np.zeros(len(item), dtype=np.int64)
        within[~alone] = held["offset"].to_numpy()[~alone]
        task = TaskContext.get().partitionId()
        out_bin = (level << 58) | (task << 34) | number[item]
        done = np.full(len(item), True) if last else fill[item] >= nearly_full
        yield pa.RecordBatch.from_arrays(
            [held["doc_id"].combine_chunks(), pa.array(piece), pa.array(start), pa.array(length), pa.array(crc), pa.array(out_bin), pa.array(place[item] + within), pa.array(np.full(len(item), task // FAN_IN, dtype=np.int32)), pa.array(done)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "lane", "done"],
        )

    return rows.mapInArrow(work, _ROWS)


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, pieces_each: int = PIECES_EACH) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    total = pieces.count()
    parts = max(1, -(-total // pieces_each))
    rows = pieces.select("*", F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("lane")).repartition(parts)
    finished, level, given = None, 0, None
    while True:
        last = parts == 1
        out = written(_level(rows, last, capacity, level, nearly_full), f"packed-{level}")
        made, open_ = out.agg(F.count_distinct("bin"), F.count_distinct(F.when(~F.col("done"), F.col("bin")))).first()
        # Bins that hardly merge any more, such as those of pieces longer than half a sequence, would all go to the last
        # task; they are emitted where they are.
        last = last or given is not None and made > SHRINKS * given
        done = (out if last else out.where("done")).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
        finished = done if finished is None else finished.unionAll(done)
        if last:
            return finished
        given, level, parts = open_, level + 1, -(-parts // FAN_IN)
        # Lanes are small whole numbers; a range of them to each partition keeps whole bins together.
        rows = out.where("NOT done").drop("done").repartition(parts, "lane")


def op8(spark, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def packed(docs: DataFrame, path: str) -> DataFrame:
    return pack(written(tokenised(docs, path), "pieces"))
