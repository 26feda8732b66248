"""Operator 6: copies among images by local descriptors.

Corners are found on scales half an octave apart, the strongest of each square, so they grow with the area. Around each, a
patch turned by its own orientation is put through TESTS comparisons of two points, which brightness and contrast do not
change. TABLES groups of KEY_BITS tests are keys; images that share MEET keys are compared: descriptors of which at most
FLIPS bits differ match, and two images are copies if at least VOTES matched corners (more among many) agree on one
similarity transform (scale, rotation and shift). So crops and edits are found and chance matches are not.

Found are crops, other brightness and contrast, noise, quarter turns and sizes that differ by half octaves. Turns by other
angles and sizes in between are found in part only, as their descriptors agree on few whole keys (README has figures).
KEY_BITS should grow with the logarithm of the number of corners; 32 serve some millions of images.

Images with the same bytes are one class. Each class meets the smallest class in each of its buckets, so copies are not
expanded into all pairs; links make components. That is the cheap part: behind an image of another scene at the head of a bucket
a link may be hidden. So a last pass takes every pair of images of different components that share enough keys, in blocks of
images that meet two by two: the result is that of all pairs that share MEET keys. Blocks are written once and read by each task
that needs them; pairs, which grow with the square of the images, are made and tested within a task and never stored.

Cases: null or unreadable media have no corners and are linked with nothing; a flat image has no corners; equal images are
one class; rows without an id are linked with nothing; ties go to the smallest id; extra columns are ignored; an empty table
gives an empty table. Media are binary greyscale images (PGM, P5, 8 bits).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.common import arrow_columns, quoted, small_enough, table, written
from spendspark.llm.near_dedup import connected

TESTS, TABLES, KEY_BITS, MEET, VOTES, TURNS, RADIUS = 256, 4, 32, 2, 5, 32, 7
#: Bits of TESTS in which descriptors of one place may differ, and how far in pixels a corner may lie from where the transform puts it.
FLIPS, NEAR = 40, 4.0
#: How far a transform's scale (in octaves) and angle may be from those of a match, and the share of chance matches that are not.
SCALES, ANGLE, _CHANCE = 0.6, np.pi / 9, 0.05
#: Steps between the two matches of a transform, and partners of one image for each part of a hot one.
AT_ONCE, PARTNERS = 64, 512
#: Corners of a block of the last pass, of which a task holds two, and the fewest blocks; pairs of keys that a task makes, pairs of
#: images that it compares, pairs of corners that it looks at and matches that it tries (whole pairs of images), at a time.
BLOCK, BLOCKS, PAIRS, TOGETHER, LOOKS, TRIED = 1 << 17, 5, 1 << 18, 512, 1 << 17, 1 << 14
#: Axes on which descriptors are compared first, and blocks that a task holds ready: they change time and memory only.
AXES, READY = 64, 2
#: Strongest corners of each square of WINDOW pixels: at full size, and on each smaller scale (half an octave each).
CORNERS, WINDOW = (24, 8), 96
#: Pixels of a stack of images.
PIXELS = 1 << 19
_MARGIN = 11
#: Signs of a vector that name its scene.
SIGNS = 12


@lru_cache(maxsize=1)
def _pattern() -> np.ndarray:
    """Offsets (turn, test, end, axis) of the compared points for each orientation."""
    draw = np.random.default_rng(1966)
    points = np.clip(draw.normal(0, 5, (TESTS, 2, 2)), -RADIUS, RADIUS)
    angles = 2 * np.pi * np.arange(TURNS) / TURNS
    turned = [np.stack([points[..., 0] * np.cos(a) - points[..., 1] * np.sin(a), points[..., 0] * np.sin(a) + points[..., 1] * np.cos(a)], axis=-1) for a in angles]
    return np.rint(np.stack(turned)).astype(np.int64)


def read_image(media: bytes | None) -> np.ndarray | None:
    """Pixels of a binary PGM image, or None."""
    try:
        magic, width, height, most, rest = (media or b"").split(maxsplit=4) if media and media[:2] == b"P5" else (b"", 0, 0, 0, b"")
        header = media.index(most + b"\n") + len(most) + 1 if magic else 0
        pixels = np.frombuffer(media[header:] if magic else b"", dtype=np.uint8)
        return pixels.reshape(int(height), int(width)).astype(np.float32) if magic and int(most) == 255 and len(rest) else None
    except ValueError:
        return None


def write_image(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2 * r + 1, edges repeated, of an image or a stack of them."""
    for axis in (-2, -1):
        first, last = np.take(x, [0], axis=axis), np.take(x, [-1], axis=axis)
        sums = np.cumsum(np.concatenate([first] * (r + 1) + [x] + [last] * r, axis=axis), axis=axis)
        n = x.shape[axis]
        cut = lambda a, axis=axis, n=n, sums=sums: sums[..., a : a + n, :] if axis == -2 else sums[..., a : a + n]
        x = cut(2 * r + 1) - cut(0)
    return x


def _smaller(image: np.ndarray) -> np.ndarray:
    """Images at 1 / sqrt(2) of their size, by bilinear interpolation."""
    for axis in (-2, -1):
        at = (np.arange(int(image.shape[axis] / np.sqrt(2))) + 0.5) * np.sqrt(2) - 0.5
        low = np.floor(at).astype(np.int64)
        part = (at - low).astype(np.float32)
        part = part[:, None] if axis == -2 else part
        image = np.take(image, low, axis=axis) * (1 - part) + np.take(image, np.minimum(low + 1, image.shape[axis] - 1), axis=axis) * part
    return image


def _halved(images: np.ndarray) -> np.ndarray:
    even = images[..., : images.shape[-2] // 2 * 2, : images.shape[-1] // 2 * 2]
    return (even[..., ::2, ::2] + even[..., 1::2, ::2] + even[..., ::2, 1::2] + even[..., 1::2, 1::2]) / 4


def _corners(images: np.ndarray, most: int) -> np.ndarray:
    """(image, y, x) of the strongest local maxima of the smaller eigenvalue of the structure tensor, away from the border: ``most``
    of each square of WINDOW of each image."""
    dy, dx = np.gradient(images, axis=(-2, -1))
    a, b, c = _box(dx * dx, 2), _box(dx * dy, 2), _box(dy * dy, 2)
    strength = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    height, width = images.shape[-2:]
    core = strength[:, _MARGIN:-_MARGIN, _MARGIN:-_MARGIN]
    peak = core > 25
    for y in (-1, 0, 1):
        for x in (-1, 0, 1):
            if y or x:
                peak &= core >= strength[:, _MARGIN + y : height - _MARGIN + y, _MARGIN + x : width - _MARGIN + x]
    found = np.argwhere(peak)
    square = (found[:, 0] * height + found[:, 1] // WINDOW) * width + found[:, 2] // WINDOW
    order = np.lexsort((found[:, 2], found[:, 1], -core[peak], square))
    square = square[order]
    rank = np.arange(len(order)) - np.searchsorted(square, square)
    return found[order[rank < most]] + [0, _MARGIN, _MARGIN]


#: A corner as it is stored: place in full size, level of its scale, orientation, and descriptor.
CORNER = np.dtype([("y", "<f4"), ("x", "<f4"), ("level", "u1"), ("turn", "u1"), ("bits", "u1", TESTS // 8)])


def _described(images: np.ndarray) -> list[np.ndarray]:
    """Corners of each of a stack of images of one size."""
    found, level, whole = [], 0, images
    while min(whole.shape[-2:]) > 2 * _MARGIN:
        for level in (level, level + 1):
            image = whole if level % 2 == 0 else _smaller(whole)
            if min(image.shape[-2:]) <= 2 * _MARGIN:
                continue
            at = _corners(image, CORNERS[min(level, 1)])
            smooth = _box(image, 2)
            span = np.arange(-RADIUS, RADIUS + 1)
            for i in range(0, len(at), 2048):
                n, y, x = at[i : i + 2048].T
                patch = smooth[n[:, None, None], y[:, None, None] + span[:, None], x[:, None, None] + span] * (span[:, None] ** 2 + span**2 <= RADIUS**2)
                angle = np.arctan2((patch * span[:, None]).sum(axis=(1, 2)), (patch * span).sum(axis=(1, 2)))
                turn = np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
                points = _pattern()[turn]
                values = smooth[n[:, None, None], y[:, None, None] + points[..., 1], x[:, None, None] + points[..., 0]]
                own = np.zeros(len(n), dtype=CORNER)
                own["bits"] = np.packbits(values[..., 0] < values[..., 1], axis=1)
                own["y"], own["x"] = (y + 0.5) * 2 ** (level / 2), (x + 0.5) * 2 ** (level / 2)
                own["level"], own["turn"] = level, turn
                found.append((n, own))
        level, whole = level + 1, _halved(whole)
    if not found:
        return [np.zeros(0, dtype=CORNER)] * len(images)
    n, own = (np.concatenate(f) for f in zip(*found))
    order = np.argsort(n, kind="stable")
    return np.split(own[order], np.searchsorted(n[order], np.arange(1, len(images))))


def describe_all(media: list[bytes | None]) -> list[np.ndarray]:
    """Corners of each image: the strongest of each square of WINDOW, on each scale. Images of one size are worked on together."""
    images = [read_image(m) for m in media]
    out = [np.zeros(0, dtype=CORNER)] * len(media)
    sizes: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        if image is not None:
            sizes.setdefault(image.shape, []).append(i)
    for shape, members in sizes.items():
        at_once = max(1, PIXELS // max(1, shape[0] * shape[1]))
        for k in range(0, len(members), at_once):
            part = members[k : k + at_once]
            for i, own in zip(part, _described(np.stack([images[i] for i in part]))):
                out[i] = own
    return out


def describe(media: bytes | None) -> np.ndarray:
    return describe_all([media])[0]


def keys_of(corners: np.ndarray) -> np.ndarray:
    """TABLES keys of each corner: the number of the table and KEY_BITS of the descriptor."""
    each = KEY_BITS // 8
    parts = corners["bits"][:, : TABLES * each].reshape(-1, TABLES, each)
    keys = np.tile(np.arange(TABLES) << KEY_BITS, (len(corners), 1))
    for k in range(each):
        keys |= parts[..., k].astype(np.int64) << 8 * k
    return keys


def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of two images whose descriptors differ in at most FLIPS bits."""
    p, q = (np.ascontiguousarray(np.ascontiguousarray(c["bits"]).view("<u8").T) for c in (a, b))
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for i in range(0, len(a), 256):
        flips = np.zeros((len(a[i : i + 256]), len(b)), dtype=np.uint16)
        for x, y in zip(p[:, i : i + 256], q):
            flips += np.bitwise_count(x[:, None] ^ y)
        at = np.flatnonzero(flips <= FLIPS)
        found.append((at // max(len(b), 1) + i, at % max(len(b), 1)))
    return tuple(np.concatenate(f) for f in zip(*found))


def _needed(n: int, area: float, tries: int) -> int:
    """Matches that a transform needs so that chance, with ``n`` matches strewn over ``area``, hardly gives them in ``tries``."""
    rate, k = n * math.pi * NEAR**2 / max(area, 1.0) * _CHANCE, 2
    term = left = math.exp(-rate)
    while tries * max(1 - left, 0.0) > 1e-6 and k < n:
        k, term = k + 1, term * rate / (k - 1)
        left += term
    return max(VOTES, k + 1)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether enough matched corners, at different places on both sides, agree on one similarity transform.

    Two matches give a transform; each match is tried with those a bounded number of steps after it. A match is for a
    transform that brings it within NEAR pixels, if its scales and orientations say so too.
    """
    return bool(alike_each(a, [b])[0])


def alike_each(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``alike`` of ``one`` and each of ``others``, worked on together."""
    corners = _unpacked(b"".join(o.tobytes() for o in others))
    x, y = matches(one, corners)
    of = np.repeat(np.arange(len(others)), [len(o) for o in others])[y]
    order = np.argsort(of, kind="stable")
    return _agreeing(of[order], one, x[order], corners, y[order], len(others))


def _agreeing(of: np.ndarray, ones: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, pairs: int) -> np.ndarray:
    """Which of ``pairs`` pairs of images are alike, by their matches (places ``x`` in ``ones`` and ``y`` in ``others``), which stand by
    pair (``of``), corner of the one and corner of the other."""
    found = np.zeros(pairs, dtype=bool)
    n = np.bincount(of, minlength=pairs)
    enough = n[of] >= VOTES
    of, x, y = of[enough], x[enough], y[enough]
    if not len(of):
        return found
    p, q = (c["x"][at] + 1j * c["y"][at] for c, at in ((ones, x), (others, y)))
    zoom, turns = (ones[c][x].astype(np.int16) - others[c][y] for c in ("level", "turn"))
    own = 2.0 ** (zoom / 2) * np.exp(2j * np.pi / TURNS * turns)

    def agrees(turn, of):
        """Places where scale and angle agree; angles are taken where the scale does."""
        ratio = turn / of
        at = np.flatnonzero(np.abs(np.log2(np.maximum(np.abs(ratio), 1e-9))) <= SCALES)
        return at[np.abs(np.angle(ratio[at])) <= ANGLE]

    # Two matches that agree with one transform are not farther from each other than twice what each may be from it: those of an
    # image stand by turn, and each is tried with the next ones.
    apart, wide = math.floor(4 * SCALES + 1e-9), math.floor(ANGLE * TURNS / np.pi + 1e-9)
    by, at = of * (2 * TURNS) + turns % TURNS, np.arange(len(of))
    low = turns % TURNS < wide
    by, at = np.append(by, by[low] + TURNS), np.append(at, at[low])
    order = np.argsort(by, kind="stable")
    by, at = by[order], at[order]
    size = np.searchsorted(by, by + wide, "right") - np.arange(len(by)) - 1
    size[by % (2 * TURNS) >= TURNS] = 0
    tried, scale, wider = [], (2.0 ** (zoom / 2)).astype(np.float32), np.float32(2**SCALES * 1.001)
    for k in _in_parts(size, 1 << 20):
        i = np.repeat(np.arange(k.start, k.stop), size[k])
        j = at[i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size[k]) - size[k], size[k])]
        i = at[i]
        i, j = np.minimum(i, j), np.maximum(i, j)
        fit = np.flatnonzero((j - i < AT_ONCE) & (np.abs(zoom[i] - zoom[j]) <= apart) & (j > i))
        i, j = i[fit], j[fit]
        here, there = p[j] - p[i], q[j] - q[i]
        long, other = np.abs(here), np.abs(there)
        fit = (long > 2 * NEAR) & (other > 2 * NEAR)
        for end in (i, j):
            # A little more than SCALES, without logarithms; ``agrees`` has the last word.
            by = other * scale[end]
            fit &= (long < by * wider) & (long * wider > by)
        fit = np.flatnonzero(fit)
        i, j, turn = i[fit], j[fit], here[fit] / there[fit]
        for end in (0, 1):
            good = agrees(turn, own[(i, j)[end]])
            i, j, turn = i[good], j[good], turn[good]
        tried.append((i, turn))
    if not tried:
        return found
    i, turn = (np.concatenate(v) for v in zip(*tried))
    starts = np.searchsorted(of, np.arange(pairs))
    sizes = n[of[i]]
    for k in _in_parts(sizes, 1 << 18):
        # All matches of the same image for each transform.
        size, which = sizes[k], np.repeat(np.arange(k.start, k.stop), sizes[k])
        there = np.repeat(starts[of[i[k]]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        near = np.abs(turn[which] * (q[there] - q[i[which]]) + p[i[which]] - p[there]) <= NEAR
        which, there = which[near], there[near]
        for_it = agrees(turn[which], own[there])
        which, there = which[for_it], there[for_it]
        votes = np.bincount(which - k.start, minlength=len(size))
        for t in np.flatnonzero(votes >= VOTES):
            image = of[i[k.start + t]]
            if not found[image]:
                all_ = slice(starts[image], starts[image] + n[image])
                area = max(float(np.ptp(p.real[all_]) * np.ptp(p.imag[all_])), 96.0**2)
                needed = _needed(int(n[image]), area, int(n[image]) * AT_ONCE)
                agreed = there[which == k.start + t] if votes[t] >= needed else there[:0]
                # Corners of several scales at one place are one piece of evidence.
                found[image] = votes[t] >= needed and all(len({(int(c.real // NEAR), int(c.imag // NEAR)) for c in side[agreed]}) >= needed for side in (p, q))
    return found


def _in_parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows whose sizes sum up to about ``most``."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield slice(at, to)
        at = to


def described(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds ``image_key`` (of the bytes; null for null), ``n_corners`` and ``corners`` (packed)."""

    def run(images):
        found = describe_all(images)
        return [[hashlib.md5(m, usedforsecurity=False).digest() if m is not None else None for m in images], [len(f) for f in found], [f.tobytes() for f in found]]

    fields = [T.StructField("image_key", T.BinaryType()), T.StructField("n_corners", T.LongType(), False), T.StructField("corners", T.BinaryType(), False)]
    return arrow_columns(df, media, fields, lambda: run)


def _unpacked(corners: bytes) -> np.ndarray:
    return np.frombuffer(corners, dtype=CORNER)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of each image; its pose is the level and orientation of the corner."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            corners = [_unpacked(c) for c in part["corners"].to_pylist()]
            own = np.concatenate(corners)
            sizes = [len(c) * TABLES for c in corners]
            pose = np.repeat(own["level"].astype(np.int64) * TURNS + own["turn"], TABLES)
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(own).ravel()), *[pa.array(np.repeat(part[c].to_numpy(), sizes)) for c in ("component", "node")], pa.array(pose)], names=["bucket", "component", "node", "pose"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket, component and node: the first row of a bucket with the first row of each other component, and
    by how many levels and turns their corners differ. Each turn counts for two cells, so that none is cut by a cell's edge."""
    bucket = component = first = pose = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b, c, n, p = (batch[k].to_numpy() for k in ("bucket", "component", "node", "pose"))
        new_bucket = np.append(b[0] != bucket, b[1:] != b[:-1])
        new = new_bucket | np.append(c[0] != component, c[1:] != c[:-1])
        at, group = np.flatnonzero(new_bucket), np.cumsum(new_bucket)
        # The first row of each row's bucket; the bucket of the batch's first rows may have begun before.
        firsts, poses = np.append(first or 0, n[at])[group], np.append(pose or 0, p[at])[group]
        out = new & ~new_bucket
        zoom, turn = poses[out] // TURNS - p[out] // TURNS, (poses[out] - p[out]) % TURNS
        cell = np.concatenate([zoom * TURNS + turn, zoom * TURNS + (turn + 1) % TURNS])
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(firsts[out], 2), pa.int64()), pa.array(np.tile(n[out], 2), pa.int64()), pa.array(cell, pa.int64())], names=["x", "y", "cell"])
        bucket, component, first, pose = b[-1], c[-1], firsts[-1], poses[-1]


def meeting(heads: DataFrame) -> DataFrame:
    """x, y and votes for images that meet in MEET keys of corners that differ alike in scale and orientation. heads: node,
    component, corners."""
    keyed = heads.select("node", "component", "corners").mapInArrow(_keyed, "bucket long, component long, node long, pose long")
    met = keyed.repartition("bucket").sortWithinPartitions("bucket", "component", "node").mapInArrow(_meetings, "x long, y long, cell long")
    return met.groupBy("x", "y", "cell").count().where(F.col("count") >= MEET).groupBy("x", "y").agg(F.max("count").alias("votes"))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by x: the corners of x, then those of its partners; the pairs that are alike."""
    held = one = None
    for batch in batches:
        xs, ys = [], []
        for x, y, corners in zip(*(batch[k] for k in ("x", "y", "corners"))):
            if not y.is_valid:
                held, one = x.as_py(), _unpacked(corners.as_py())
            elif held == x.as_py() and alike(one, _unpacked(corners.as_py())):
                xs.append(held)
                ys.append(y.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])


def verified(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a written table) whose images are copies. An image with many partners is dealt in parts of about PARTNERS."""
    parts, n = pairs.groupBy("x").agg(F.ceil(F.count("*") / PARTNERS).alias("parts")), pairs.count()
    corners = heads.select(F.col("node"), "corners")
    # Few pairs go to where the corners are, so that those are dealt once.
    ones = corners.join(small_enough(parts, n, 16), F.col("x") == F.col("node")).select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("y"), "corners")
    others = corners.join(small_enough(pairs.join(parts, "x"), n, 24), F.col("y") == F.col("node")).select("x", F.pmod(F.xxhash64("y"), F.col("parts")).alias("part"), "y", "corners")
    dealt = ones.unionByName(others).repartition("x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())
    return dealt.select("x", "y", "corners").mapInArrow(_verified, "x long, y long")


def _in_blocks(most: int):
    """Packs the images of a partition into blocks of at most ``most`` images and about BLOCK corners, each a row."""
    columns, schema = ("node", "component", "corners"), pa.schema([("block", pa.int64()), ("node", pa.list_(pa.int64())), ("component", pa.list_(pa.int64())), ("corners", pa.list_(pa.binary()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = ([], [], []), 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in columns)):
                more = len(row[2]) // CORNER.itemsize
                if held[0] and (len(held[0]) >= most or size + more > BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((number, *held), schema.types)], schema=schema)
                    held, size, number = ([], [], []), 0, number + 1
                for values, value in zip(held, row):
                    values.append(value)
                size += more
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((number, *held), schema.types)], schema=schema)

    return work


def _block(images: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, components and corners (sizes, all in a row, their shadows) of the images of a block, and for each key of each image the
    key, the image's place and the pose."""
    packed = images["corners"].to_pylist()
    sizes, own = np.array([len(c) // CORNER.itemsize for c in packed], dtype=np.int64), _unpacked(b"".join(packed))
    places = np.repeat(np.arange(len(packed), dtype=np.int32), sizes * TABLES)
    pose = np.repeat(own["level"].astype(np.int16) * TURNS + own["turn"], TABLES)
    return images["node"].to_numpy(), images["component"].to_numpy(), (sizes, own, _shadows(own)), keys_of(own).ravel(), places, pose


def _with_keys_of(a: tuple, b: tuple) -> tuple:
    """The rows of ``a`` (keys, places, poses) but for some whose key ``b`` doesn't have: a key is looked up by 24 bits of its product."""
    held = np.zeros(1 << 24, dtype=bool)
    at_a, at_b = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) for keys in (a[0], b[0]))
    held[at_b] = True
    rows = np.flatnonzero(held[at_a])
    return tuple(v[rows] for v in a)


def _met(a: tuple, b: tuple, ca: np.ndarray, cb: np.ndarray, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the images of two blocks (keys, places, poses) that meet in MEET keys of corners that differ alike in scale and orientation, and are of
    different components (``ca``, ``cb``: small numbers). ``once``: the blocks are one, each pair is wanted in one order.

    Nothing of a bucket is left out. Rows of ``b`` stand by key and component, so a row of ``a`` meets what stands before and
    after its own component there. Pairs are made for some images of ``a`` at a time.
    """
    if not once:
        # Most keys are of one block only.
        a, b = _with_keys_of(a, b), _with_keys_of(b, a)
    (key_a, place_a, pose_a), (key_b, place_b, pose_b) = a, b
    if not len(key_a) or not len(key_b):
        return
    order, many = np.lexsort((cb[place_b], key_b)), max(ca.max(), cb.max()) + 1
    key_b, place_b, pose_b = key_b[order], place_b[order], pose_b[order]
    new = np.append(True, key_b[1:] != key_b[:-1])
    begin, of_b = np.flatnonzero(new), np.cumsum(new) - 1
    buckets = key_b[begin]
    of_a = np.minimum(np.searchsorted(buckets, key_a), len(buckets) - 1)
    rows = np.flatnonzero(buckets[of_a] == key_a)
    of_a, own, code_b = of_a[rows], ca[place_a[rows]], of_b * many + cb[place_b]
    ranges = [(rows, np.searchsorted(code_b, of_a * many + own, "right"), np.append(begin, len(key_b))[of_a + 1])]
    if not once:
        ranges.append((rows, begin[of_a], np.searchsorted(code_b, of_a * many + own)))
    del of_b, code_b, new, key_b
    rows, low, high = (np.concatenate(r) for r in zip(*ranges))
    order = np.argsort(place_a[rows], kind="stable")
    order = order[high[order] > low[order]]
    rows, low, sizes = rows[order], low[order], (high - low)[order]
    # Whole images, about PAIRS pairs at a time: all keys of two images have to be counted together.
    begin = np.flatnonzero(np.append(True, np.diff(place_a[rows]) != 0)) if len(rows) else rows
    for part in _in_parts(np.add.reduceat(sizes, begin) if len(rows) else sizes, PAIRS):
        at, to = begin[part.start], np.append(begin, len(rows))[part.stop]
        n = sizes[at:to]
        there = np.repeat(low[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pose, other = np.repeat(pose_a[rows[at:to]], n), pose_b[there]
        turn = (pose - other) % TURNS
        pair = np.repeat(place_a[rows[at:to]].astype(np.int64), n) * len(cb) + place_b[there]
        # Differences of turns by one count together; the first turn stands behind the last one too.
        code = (pair * 64 + pose // TURNS - other // TURNS + 32) * (2 * TURNS) + turn
        code = np.sort(np.concatenate([code, code[turn == 0] + TURNS]))
        near = code[: len(code) - MEET + 1][code[MEET - 1 :] - code[: len(code) - MEET + 1] <= 1] // (128 * TURNS)
        near = near[np.append(True, near[1:] != near[:-1])] if len(near) else near
        yield near // len(cb), near % len(cb)


@lru_cache(maxsize=1)
def _axes() -> np.ndarray:
    """AXES orthogonal axes (bit, axis) along which descriptors of drawn scenes differ most. Any orthogonal ones would be right."""
    draw = np.random.default_rng(2011)
    scenes = [write_image(_box(draw.integers(20, 220, (24, 24)).astype(np.float32).repeat(4, axis=0).repeat(4, axis=1), 1) / 9) for _ in range(64)]
    bits = np.unpackbits(np.concatenate(describe_all(scenes))["bits"], axis=1) - 0.5
    return np.linalg.eigh(bits.T @ bits)[1][:, -AXES:].astype(np.float32)


def _shadows(corners: np.ndarray) -> np.ndarray:
    """Descriptors as points on the axes, then half of their squared length and 1. Points are never farther apart than descriptors: the
    square of their distance is at most the number of differing bits, so what is farther apart is no match."""
    axes, out = _axes(), np.ones((len(corners), AXES + 2), dtype=np.float32)
    for i in range(0, len(out), 1024):
        out[i : i + 1024, :AXES] = np.unpackbits(np.ascontiguousarray(corners["bits"][i : i + 1024]), axis=1).astype(np.float32) @ axes - axes.sum(axis=0) / 2
    out[:, AXES] = np.einsum("ij,ij->i", out[:, :AXES], out[:, :AXES]) / 2
    return out


def _all_matches(bits: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray, shadows: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``matches`` of many pairs of images: pair, corner of x and corner of y, in this order. ``bits``: words of all corners;
    ``ends``: where the corners of each image end; ``shadows``: of the first corners, among which those of x are, and of the last, with
    those of y. Pairs of one x should stand together.

    Bits are counted only where shadows are near enough, which leaves out no match."""
    begin, found = np.append(0, ends), [(np.zeros(0, dtype=np.int64),) * 3]
    if shadows is None:
        own = np.zeros(bits.shape[1], dtype=CORNER)
        own["bits"] = np.ascontiguousarray(bits.T).view(np.uint8)
        shadows = (_shadows(own),) * 2
    before = bits.shape[1] - len(shadows[1])
    for one in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else ():
        for first in range(begin[x[one[0]]], ends[x[one[0]]], 256):
            last = min(first + 256, ends[x[one[0]]])
            own, p = shadows[0][first:last], np.ascontiguousarray(bits[:, first:last])
            near = np.hstack([-own[:, :AXES], own[:, :AXES - 1 : -1]])
            sizes = ends[y[one]] - begin[y[one]]
            for k in _in_parts(sizes, LOOKS // len(own)):
                size = sizes[k]
                there = np.repeat(begin[y[one[k]]] - np.cumsum(size) + size, size) + np.arange(size.sum())
                # Half of the squared distance; the rounding of floats is far below what is added.
                at = np.flatnonzero(near @ shadows[1][there - before].T <= FLIPS / 2 + 0.1)
                i, q = at // max(len(there), 1), bits[:, there]
                j = at - i * len(there)
                flips = np.zeros(len(at), dtype=np.uint16)
                for u, v in zip(p, q):
                    flips += np.bitwise_count(u.take(i) ^ v.take(j))
                real = np.flatnonzero(flips <= FLIPS)
                i, j = i[real], j[real]
                found.append((np.repeat(one[k], size)[j], first + i, there[j]))
    return tuple(np.concatenate(f) for f in zip(*found))


def _links_of(parts: list[tuple]) -> tuple[list[int], list[int]]:
    """The links between images of different components in two blocks (or in one) that meet."""
    nodes, component = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    corners, ends = np.concatenate([p[2][1] for p in parts]), np.cumsum(np.concatenate([p[2][0] for p in parts]))
    bits = np.ascontiguousarray(np.ascontiguousarray(corners["bits"]).view("<u8").T)
    numbers = np.unique(component, return_inverse=True)[1]
    n, root, xs, ys = len(parts[0][0]), np.arange(len(numbers)), [], []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a, b in _met(parts[0][3:], parts[-1][3:], numbers[:n], numbers[-len(parts[-1][0]) :], len(parts) == 1):
        b = b + len(nodes) - len(parts[-1][0])
        for k in range(0, len(a), TOGETHER):
            x, y = a[k : k + TOGETHER], b[k : k + TOGETHER]
            # What came together meanwhile needs no further link.
            if xs:
                apart = np.array([find(i) != find(j) for i, j in zip(numbers[x], numbers[y])], dtype=bool)
                x, y = x[apart], y[apart]
            of, p, q = _all_matches(bits, ends, x, y, (parts[0][2][2], parts[-1][2][2]))
            # The smaller id first, as no order of blocks should matter.
            turned = (nodes[x] > nodes[y])[of]
            p, q = np.where(turned, (q, p), (p, q))
            order = np.argsort((of * len(corners) + p) * len(corners) + q)
            of, p, q = of[order], p[order], q[order]
            found = []
            for part in _in_parts(np.bincount(of, minlength=len(x)), TRIED):
                own = slice(*np.searchsorted(of, (part.start, part.stop)))
                found.append(_agreeing(of[own] - part.start, corners, p[own], corners, q[own], part.stop - part.start))
            for t in np.flatnonzero(np.concatenate(found)) if found else ():
                i, j = find(numbers[x[t]]), find(numbers[y[t]])
                if i != j:
                    root[j] = i
                    xs.append(min(nodes[x[t]], nodes[y[t]]))
                    ys.append(max(nodes[x[t]], nodes[y[t]]))
    return xs, ys


def _linked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each row's two blocks. The READY blocks used last are kept, as a block meets several in a task."""
    ready: dict[int, tuple] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            parts = []
            for side in "a" if batch["block_a"][row] == batch["block_b"][row] else "ab":
                number = batch[f"block_{side}"][row].as_py()
                block = ready.pop(number, None)
                if block is None:
                    while len(ready) >= READY:
                        del ready[next(iter(ready))]
                    block = _block(pa.table({c: batch[f"{c}_{side}"][row].values for c in ("node", "component", "corners")}))
                ready[number] = block
                parts.append(block)
            xs, ys = _links_of(parts)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])
        pa.default_memory_pool().release_unused()


def remaining(heads: DataFrame, n: int) -> DataFrame:
    """x and y for links between images of different components: every pair that meets in MEET keys is looked at, so none is left
    out. heads (about n rows): node, component, corners. Blocks meet two by two; each is written once, in a file of its own, and read
    where it meets another, so no copies of blocks are stored."""
    own = heads.select("node", "component", "corners").coalesce(max(BLOCKS, -(-n // 4096)))
    blocks = written(own.mapInArrow(_in_blocks(-(-n // BLOCKS)), "block long, node array<long>, component array<long>, corners array<binary>"), "image-blocks", maxRecordsPerFile=1, compression="uncompressed")
    a, b = (blocks.toDF(*[f"{c}_{side}" for c in blocks.columns]) for side in "ab")
    return a.join(b.hint("shuffle_replicate_nl"), F.col("block_a") <= F.col("block_b")).mapInArrow(_linked_blocks, "x long, y long")


def copies(df: DataFrame, media_id: str = "media_id", media: str = "media") -> DataFrame:
    """media_id, n_corners and component_id (the smallest id among an image's copies) for each row."""
    rows = written(described(df.select(F.col(quoted(media_id)).alias("media_id"), F.col(quoted(media)).alias("media"))), "images")
    usable = rows.where("image_key IS NOT NULL AND media_id IS NOT NULL")
    classes = written(usable.groupBy("image_key").agg(F.min("media_id").alias("node")), "image-classes")
    n = classes.count()
    same = (F.col("media_id") == F.col("node")) & (F.col("image_key") == F.col("key"))
    heads = usable.where("n_corners >= %d" % VOTES).join(small_enough(classes.withColumnRenamed("image_key", "key"), n, 48), same).select("node", "corners")

    links = components = None

    def placed(rows_: DataFrame, node: str, component: str) -> DataFrame:
        """Adds the component of an image, itself where it is linked with none so far."""
        if components is None:
            return rows_.withColumn(component, F.col(node))
        found = small_enough(components, n, 16).select(F.col("node").alias(node), F.col("component").alias("__c"))
        return rows_.join(found, node, "left").withColumn(component, F.coalesce("__c", node)).drop("__c")

    def linked(found: DataFrame) -> None:
        """Takes links, and makes components of all so far."""
        nonlocal links, components
        new = written(found.distinct(), "image-links")
        links = new if links is None else links.unionAll(new)
        if not new.isEmpty():
            components = written(connected(links), "image-components")

    # Most links at little cost: all with the head of a bucket, the best partner of each image first, as most others are of one
    # component with it then and need no test.
    pairs = written(meeting(placed(heads, "node", "component")), "image-meetings")
    best = written(pairs.groupBy("y").agg(F.max_by("x", F.struct("votes", -F.col("x"))).alias("x")).select("x", "y"), "image-pairs")
    linked(verified(best, heads))
    rest = placed(placed(pairs.join(best, ["x", "y"], "left_anti"), "x", "cx"), "y", "cy").where("cx <> cy")
    linked(verified(written(rest.select("x", "y"), "image-pairs"), heads))
    # Then every pair that meets and is of two components still, whoever is the head.
    linked(remaining(placed(heads, "node", "component"), n))
    final = placed(classes, "node", "c").select("image_key", "c")
    named = rows.select("media_id", "image_key", "n_corners").join(final, "image_key", "left")
    return named.select("media_id", "n_corners", F.when(F.col("media_id").isNotNull(), F.coalesce("c", "media_id")).alias("component_id"))


def drawn(vec_id: int | None, embedding: list[float] | None) -> bytes | None:
    """The image that stands for a vector: a scene that like vectors share, seen through edits that depend on the row's id.

    The scene is that of the signs of the vector's first SIGNS numbers. It is shown whole, cropped, with other brightness and
    contrast, or both; and as it is, with noise, turned by a quarter, or larger by the square root of two.
    """
    if embedding is None or not len(embedding):
        return None
    draw = np.random.default_rng(scene_number(embedding))
    cells = draw.integers(20, 220, (24, 24)).astype(np.float32)
    scene = _box(cells.repeat(4, axis=0).repeat(4, axis=1), 1) / 9
    i = vec_id or 0
    if i // 100 % 4 == 3:
        scene = _smaller(np.kron(scene, np.ones((2, 2), dtype=np.float32)))
    if i % 4 in (1, 3):
        scale = scene.shape[0] / 96
        top, left, side = (int(scale * v) for v in (4 * (i // 4 % 5) + 1, 4 * (i // 20 % 5) + 2, 76))
        scene = scene[top : top + side, left : left + side]
    if i % 4 in (2, 3):
        scene = scene * 0.7 + 40
    if i // 100 % 4 == 1:
        scene = scene + np.random.default_rng(i).normal(0, 3, scene.shape)
    if i // 100 % 4 == 2:
        scene = np.rot90(scene)
    return write_image(np.clip(scene, 0, 255))


def scene_number(embedding: list[float]) -> int:
    """Number of a vector's scene: the signs of its first SIGNS numbers, as bits."""
    return sum((v is not None and v > 0) << k for k, v in enumerate(embedding[:SIGNS]))


def media_table(embeddings: DataFrame) -> DataFrame:
    """media_id and media for each row of the vector table, as no table holds images."""
    return arrow_columns(embeddings.select(F.col("vec_id").alias("media_id"), F.struct("vec_id", "embedding").alias("__row")), "__row", [T.StructField("media", T.BinaryType())], lambda: lambda rows: [[drawn(r["vec_id"], r["embedding"]) for r in rows]])


def op6(spark, sf_dir: str) -> DataFrame:
    """Copies among the images of all rows of ``embeddings``."""
    out = copies(media_table(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return out.select(F.col("media_id").alias("vec_id"), "n_corners", "component_id", F.col("media_id").eqNullSafe(F.col("component_id")).alias("kept"))
