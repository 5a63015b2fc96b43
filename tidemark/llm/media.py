"""Media columns: copies of images, cropped or edited, by local descriptors.

Corners are found at several scales; the patch around each is turned to its intensity centroid
and described by binary tests.  Descriptors meet in Hamming tables, one for each band of their
bits; images that meet are verified by matching all their descriptors and counting the matches
that agree on one similarity transform.  Images with equal pixels are one node.  As for other
groups of copies, a bucket is paired with an anchor first, and only what is still apart is paired
afterwards, in blocks.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches, stored
from .graph import components

#: Pixels of an image that is decoded, at most.
PIXELS = 1 << 28
#: Scales, and the step between them; a corner is the strongest within so many pixels of its scale.
SCALES, STEP, APART = 4, 1.26, 7
#: A side under so many pixels is extended by two radii.
SMALL = 28
#: Rows around an image among others, and pixels that are worked on at once.
GAP, STACK = 8, 1 << 17
#: Buckets in which two images must meet to be compared; one is enough for an image of fewer than FEW corners.
MEET, FEW = 2, 12
#: Radius of a patch, bits of a descriptor, bands of the Hamming tables.
RADIUS, BITS, BANDS = 7, 128, 4
#: Numbers of 64 bits that hold a descriptor.
WORDS = BITS // 64
#: How a place is stored.
PLACE = np.dtype([("y", "<f4"), ("x", "<f4"), ("level", "u1"), ("turn", "u1")])
#: Elements of one block when a bucket is paired with itself.
BLOCK = 500
#: Bits in which matching descriptors may differ; matches that must agree, and their least share of the corners of the image that has fewer.
DISTANCE, AGREE, SHARE = 28, 6, 0.3
ANGLES = 32
#: Proposed transforms that are tried at once, and distances of descriptors.
PROPOSALS, DISTANCES = 256, 1 << 20
#: Characters in a row of a rendered page, and pixels of a character's side.
WIDTH, SIDE = 64, 1
# What isn't shown, and tags; those of the second group start a new row.
LAYOUT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|(</?(?:p|div|h[1-6]|br|tr|table|article|section|header|footer|main|nav|ul|ol|blockquote|pre|title)\b[^<>]*>?)|<[a-z/!?][^<>]*>?", re.DOTALL | re.IGNORECASE)

_rng = np.random.default_rng(11)
_dots = np.clip(np.rint(_rng.normal(0, RADIUS / 2.2, (BITS, 4))), -RADIUS + 2, RADIUS - 2)
_turns = 2 * np.pi * np.arange(ANGLES) / ANGLES
#: Offsets (dy, dx) of the two places of each test, for each quantised angle.
TESTS = np.stack([np.rint(np.stack([_dots[:, [0, 2]] * np.cos(a) + _dots[:, [1, 3]] * np.sin(a), -_dots[:, [0, 2]] * np.sin(a) + _dots[:, [1, 3]] * np.cos(a)], -1)).astype(int) for a in _turns])
_y, _x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_disc = (_y**2 + _x**2 <= RADIUS**2).astype(np.float32)
MOMENT_Y, MOMENT_X = (_y * _disc).ravel(), (_x * _disc).ravel()
PATCH_Y, PATCH_X = _y.ravel(), _x.ravel()


def _png(data: bytes) -> np.ndarray | None:
    at, idat, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    if head is None or head[6] or head[0] * head[1] > PIXELS:
        return None
    width, height, depth, channels = head[0], head[1], head[2], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    line_bytes, unit = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    raw = zlib.decompressobj().decompress(b"".join(idat), height * (line_bytes + 1))
    raw = np.frombuffer(raw, np.uint8).reshape(height, line_bytes + 1)
    out = np.zeros((height, line_bytes), np.uint8)
    for y in range(height):
        mode, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros_like(line)
        if mode == 0:
            out[y] = line
        elif mode == 2:
            out[y] = (line + up) & 255
        elif mode == 1:
            out[y] = (np.cumsum(line.reshape(-1, unit), 0) & 255).ravel()
        else:
            done = np.zeros(len(line) + unit, np.int32)
            for i, v in enumerate(line.tolist()):
                a, b, c = int(done[i]), int(up[i]), int(up[i - unit]) if i >= unit else 0
                if mode == 3:
                    done[i + unit] = (v + (a + b) // 2) & 255
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    done[i + unit] = (v + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
            out[y] = done[unit:]
    if depth == 16:
        samples = out[:, ::2]  # the upper byte of each
    elif depth < 8:
        bits = np.unpackbits(out, axis=1)[:, : width * channels * depth].reshape(height, width * channels, depth)
        samples = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)
        if head[3] != 3:
            samples = samples * np.uint8(255 // ((1 << depth) - 1))
    else:
        samples = out
    pixels = samples.reshape(height, width, channels)
    if head[3] == 3:
        return palette[pixels[..., 0]].mean(-1).astype(np.float32)
    return pixels[..., : 3 if channels >= 3 else 1].mean(-1).astype(np.float32)


def _netpbm(data: bytes) -> np.ndarray:
    parts, at = [], 2
    while len(parts) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        parts.append(int(data[at:end]))
        at = end
    channels = 3 if data[:2] == b"P6" else 1
    if parts[2] > 255 or parts[0] * parts[1] > PIXELS:
        raise ValueError("eight bits a sample are read")
    pixels = np.frombuffer(data, np.uint8, parts[0] * parts[1] * channels, at + 1)
    return pixels.reshape(parts[1], parts[0], channels).mean(-1).astype(np.float32)


def grey(data: bytes | None) -> np.ndarray | None:
    """Grey values of a PNG (not interlaced), PGM or PPM of at most PIXELS pixels; None for anything else."""
    try:
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        return _netpbm(data) if data and data[:2] in (b"P5", b"P6") else None
    except (ValueError, KeyError, IndexError, TypeError, zlib.error, struct.error):
        return None


def _blur(a: np.ndarray) -> np.ndarray:
    """a weighted 1, 2, 1 along both axes; edges go on."""
    down = a + a
    down[1:] += a[:-1]
    down[:-1] += a[1:]
    down[0] += a[0]
    down[-1] += a[-1]
    out = down + down
    out[:, 1:] += down[:, :-1]
    out[:, :-1] += down[:, 1:]
    out[:, 0] += down[:, 0]
    out[:, -1] += down[:, -1]
    out *= 0.0625
    return out


def _window_max(a: np.ndarray, axis: int) -> np.ndarray:
    """The largest value within APART places along an axis, itself included."""
    width = 2 * APART + 1
    pad = [(0, 0), (0, 0)]
    pad[axis] = (APART, APART)
    out, have = np.pad(a, pad, constant_values=-np.inf), 1
    out = out if axis == 0 else out.T
    while have < width:
        step = min(have, width - have)
        out = np.maximum(out[: len(out) - step], out[step:])
        have += step
    return out if axis == 0 else out.T


def _layout(heights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images above one another with GAP rows around each: image and row by stacked row, and where each image starts."""
    size = heights + 2 * GAP
    start = np.cumsum(size) - size
    image = np.repeat(np.arange(len(heights)), size)
    return image, np.arange(len(image)) - start[image] - GAP, start + GAP


def _describe_stack(images: list[np.ndarray], found: list[list[tuple[np.ndarray, np.ndarray]]]) -> None:
    """Append places and descriptors of images of one width; what is around an image doesn't change its result."""
    which, heights = np.arange(len(images)), np.array([len(x) for x in images])
    image, row, start = _layout(heights)
    at = np.clip(row, 0, heights[image] - 1) + (np.cumsum(heights) - heights)[image]
    level, scale = np.concatenate(images).astype(np.float32)[at], 1.0
    for k in range(SCALES):
        keep = heights >= 2 * RADIUS + 4
        if not keep.all():
            level = level[keep[image]]
            which, heights = which[keep], heights[keep]
            image, row, start = _layout(heights)
        if not len(which) or level.shape[1] < 2 * RADIUS + 4:
            return
        soft = _blur(level)
        gy, gx = np.gradient(soft)
        a, b, c = (_blur(x) for x in (gy * gy, gx * gx, gy * gx))
        response = a * b - c * c - 0.05 * (a + b) ** 2
        peak = (response > 1e-3) & (response >= _window_max(_window_max(response, 0), 1))
        peak[(row < RADIUS) | (row >= heights[image] - RADIUS)] = False
        peak[:, :RADIUS] = peak[:, -RADIUS:] = False
        y, x = np.nonzero(peak)
        if len(y):
            wide = level.shape[1]
            flat_, centre = soft.ravel(), y * wide + x
            patch = flat_[centre[:, None] + (PATCH_Y * wide + PATCH_X)]
            angle = np.arctan2(patch @ MOMENT_Y, patch @ MOMENT_X)
            turn = np.rint(angle / (2 * np.pi) * ANGLES).astype(int) % ANGLES
            values = flat_[centre[:, None, None] + (TESTS[..., 0] * wide + TESTS[..., 1])[turn]]
            bits = np.packbits(values[..., 0] < values[..., 1], axis=1)
            place = np.stack([(row[y] + 0.5) * scale, (x + 0.5) * scale, np.full(len(y), scale), angle], 1).astype(np.float32)
            edge = np.searchsorted(image[y], np.arange(len(which) + 1))
            for i, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                if hi > lo:
                    found[which[i]].append((place[lo:hi], bits[lo:hi]))
        if k + 1 < SCALES:
            smaller = (heights / STEP).astype(np.int64)
            width = int(level.shape[1] / STEP)
            base, to = _blur(level), _layout(smaller)
            sy = np.clip((np.clip(to[1], 0, np.maximum(smaller[to[0]] - 1, 0)) + 0.5) * STEP - 0.5, 0, None)
            sx = np.clip((np.arange(width) + 0.5) * STEP - 0.5, 0, None)
            y0, x0 = np.minimum(sy.astype(np.int64), heights[to[0]] - 2), np.minimum(sx.astype(np.int64), level.shape[1] - 2)
            fy, fx = (sy - y0)[:, None].astype(np.float32), (sx - x0)[None].astype(np.float32)
            y0 = y0 + start[to[0]]
            top, low = base[y0], base[y0 + 1]
            level = (top[:, x0] * (1 - fx) + top[:, x0 + 1] * fx) * (1 - fy) + (low[:, x0] * (1 - fx) + low[:, x0 + 1] * fx) * fy
            heights, scale = smaller, scale * STEP
            image, row, start = to


def describe_all(images: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each image, of its corners: places (y, x, scale, angle) in pixels, and descriptors (packed bits).

    Images of one width are worked on together, STACK pixels at once.
    """
    images = list(images)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in images]
    by_width: dict[int, list[int]] = {}
    for i, image in enumerate(images):
        if image is not None and image.size:
            # a side too short for patches goes on with its edge
            extra = [2 * RADIUS if n < SMALL else 0 for n in image.shape]
            if any(extra):
                image = np.pad(image, [(e, e) for e in extra], mode="edge")
                images[i] = image
            by_width.setdefault(image.shape[1], []).append(i)
    for held in by_width.values():
        at = 0
        while at < len(held):
            end, size = at, 0
            while end < len(held) and (end == at or size + images[held[end]].size <= STACK):
                size += images[held[end]].size
                end += 1
            part: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(end - at)]
            _describe_stack([images[i] for i in held[at:end]], part)
            for i, x in zip(held[at:end], part, strict=True):
                found[i] = x
            at = end
    none = (np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8))
    return [tuple(np.concatenate(x) for x in zip(*f, strict=True)) if f else none for f in found]


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and descriptors of one image."""
    return describe_all([image])[0]


def _best(pa_: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, float, float]:
    """Matches that agree on one similarity transform, at most, and the transform: a place of each image, cos and sin by the ratio."""
    none = (0, np.zeros(2), np.zeros(2), 1.0, 0.0)
    if not len(pa_) or not len(pb):
        return none
    da, db = da.view(np.uint64), db.view(np.uint64)
    apart = np.bitwise_count(da[:, None] ^ db[None]).sum(-1)
    i = np.arange(len(da))
    j = apart.argmin(1)
    good = (apart[i, j] <= DISTANCE) & (apart.argmin(0)[j] == i)
    i, j = i[good], j[good]
    if len(i) < AGREE:
        return none
    a, b = pa_[i], pb[j]
    ratio, turn = b[:, 2] / a[:, 2], b[:, 3] - a[:, 3]
    cos, sin = np.cos(turn) * ratio, np.sin(turn) * ratio
    # every match proposes a transform: matches (second axis) that agree with each proposal (first)
    best = none
    for lo in range(0, len(i), PROPOSALS):
        part = slice(lo, lo + PROPOSALS)
        dy, dx = a[None, :, 0] - a[part, None, 0], a[None, :, 1] - a[part, None, 1]
        c, s = cos[part, None], sin[part, None]
        ey = b[None, :, 0] - b[part, None, 0] - (dy * c + dx * s)
        ex = b[None, :, 1] - b[part, None, 1] - (dx * c - dy * s)
        number = (ey * ey + ex * ex <= (3.0 + 0.05 * np.hypot(dy, dx)) ** 2 * np.maximum(1.0, ratio[part, None]) ** 2).sum(1)
        k = int(number.argmax())
        if number[k] > best[0]:
            best = int(number[k]), a[lo + k, :2], b[lo + k, :2], float(cos[lo + k]), float(sin[lo + k])
    return best


def agreeing(pa_: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray) -> int:
    """Matches between two images' descriptors that agree on one similarity transform, at most."""
    return _best(pa_, da, pb, db)[0]


def linked(pa_: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray) -> bool:
    """Whether enough matches agree: AGREE, and SHARE of the corners of the image that has fewer."""
    if min(len(pa_), len(pb)) < AGREE:
        return False
    return agreeing(pa_, da, pb, db) >= max(AGREE, SHARE * min(len(pa_), len(pb)))


def packed(places: np.ndarray) -> bytes:
    """Places in PLACE bytes each: y and x, the scale's number and the angle in 256 steps."""
    out = np.zeros(len(places), PLACE)
    out["y"], out["x"] = places[:, 0], places[:, 1]
    out["level"] = np.rint(np.log(places[:, 2]) / np.log(STEP))
    out["turn"] = np.rint(places[:, 3] * (128 / np.pi)).astype(np.int64) & 255
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    p = np.frombuffer(data, PLACE)
    return np.stack([p["y"], p["x"], STEP ** p["level"].astype(np.float32), p["turn"] * np.float32(np.pi / 128)], 1)


def features(images: DataFrame) -> DataFrame:
    """Stored, one row per image of (id, image): row (a number), id, pixels (digest), n, places as bytes, and descriptors, WORDS numbers each."""

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for b in batches:
            decoded = [grey(data) for data in b.column(1).to_pylist()]
            described_ = describe_all(decoded)
            pixels = [b"" if x is None else struct.pack("<II", *x.shape) + hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in decoded]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + b.num_rows)), b.column(0), pa.array(pixels, pa.binary()), pa.array([len(p) for p, _ in described_], pa.int32()), pa.array([packed(p) for p, _ in described_], pa.binary()), pa.array([d.view(np.int64).ravel() for _, d in described_], pa.list_(pa.int64()))],
                ["row", "id", "pixels", "n", "places", "bits"],
            )
            row += b.num_rows

    kind = images.schema["id"].dataType.simpleString()
    return stored(images.mapInArrow(rows, f"row long, id {kind}, pixels binary, n int, places binary, bits array<long>"), "features")


def described(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All descriptors of a column of arrays, and how many each row has."""
    return column.flatten().to_numpy().reshape(-1, WORDS), np.diff(column.offsets.to_numpy()) // WORDS


def possible(bits: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether one image's descriptors have enough matches, before any consensus, in each of several others', which follow one another.

    A match needs a distance of at most DISTANCE that is least for both descriptors.
    """
    a, b = bits.view(np.uint64), others.view(np.uint64)
    need = np.maximum(AGREE, SHARE * np.minimum(len(a), sizes))
    out = need <= np.minimum(len(a), sizes)
    if not len(a) or not out.any():
        return out & False
    apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
    full = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[full]
    owner = np.repeat(np.arange(len(full)), sizes[full])
    nearest = apart.argmin(0)
    least = apart[nearest, np.arange(len(b))]
    mutual = (least <= DISTANCE) & (np.minimum.reduceat(apart, begin, axis=1)[nearest, owner] == least)
    matches = np.zeros(len(sizes), np.int64)
    matches[full] = np.bincount(owner[mutual], minlength=len(full))
    return out & (matches >= need)


def confirmed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored pairs (a, b) of nodes whose matches agree; places are only joined where there are enough matches."""

    @lean
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, (ours, n_ours), (others, sizes) = b.column(0).to_numpy(), described(b.column(2)), described(b.column(3))
            begin, end_of = np.cumsum(n_ours) - n_ours, np.cumsum(sizes)
            ok = np.zeros(len(ids), bool)
            runs = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            for lo, hi in zip(runs.tolist(), np.append(runs[1:], len(ids)).tolist(), strict=True):
                mine = ours[begin[lo] : begin[lo] + n_ours[lo]]
                at = lo
                while at < hi:  # so many at once that the distances stay few
                    end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:hi]) * max(1, len(mine)), DISTANCES, "right")))
                    ok[at:end] = possible(mine, others[end_of[at] - sizes[at] : end_of[end - 1]], sizes[at:end])
                    at = end
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])

    @lean
    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [[unpacked(x) for x in b.column(i).to_pylist()] for i in (2, 4)]
            bits = [np.split(d.view(np.uint8).reshape(-1, BITS // 8), np.cumsum(n)[:-1]) if len(n) else [] for d, n in (described(b.column(3)), described(b.column(5)))]
            keep = pa.array([linked(*x) for x in zip(places[0], bits[0], places[1], bits[1], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    x = nodes.select(F.col("node").alias("a"), F.col("places").alias("pa"), F.col("bits").alias("da"))
    y = nodes.select(F.col("node").alias("b"), F.col("places").alias("pb"), F.col("bits").alias("db"))
    some = pairs.join(y.select("b", "db"), "b").join(x.select("a", "da"), "a").select("a", "b", "da", "db").mapInArrow(match, "a long, b long")
    some = stored(some, "image-matches")
    return stored(some.join(x, "a").join(y, "b").select("a", "b", "pa", "da", "pb", "db").mapInArrow(agree, "a long, b long"), "image-links")


def still_apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that meet often enough and whose labels differ; long buckets are paired in blocks."""
    named = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    named = named.join(open_, "token").withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int"))
    x = named.select("token", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("a"), F.col("label").alias("la"), F.col("few").alias("fa"))
    y = named.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("few").alias("fb"))
    met = x.join(y, ["token", "block"]).where("la <> lb AND a < b")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("fa") | F.col("fb")).alias("few")).where((F.col("c") >= MEET) | F.col("few")).select("a", "b")


def image_copies(images: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """One row per image: id, n_features, component_id (least id that it reaches by links).

    Two images are linked when their pixels are equal, or AGREE matches, and SHARE of the corners
    of the image that has fewer, agree on one shift, turn and scale.

    Images are compared that meet in MEET buckets, or in one where one has fewer than FEW corners,
    however many images a bucket holds.  They are compared with the anchors of their buckets first;
    then two that are still in different groups, all pairs of them: buckets of images that stay
    apart, as by a frame that many have, cost the square of their size.

    Corners that tie for a place are both kept.  Null,
    empty and unreadable images (JPEG, interlaced PNG) and flat ones have no features; unreadable
    ones have no links.  Rows that repeat an id are separate images; a null id is a component's id
    only when all of its are null; an empty table gives an empty result; other columns are ignored.
    """
    spark = images.sparkSession
    small_batches(spark, 256)
    table = features(images.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{image_col}`").alias("image")))
    readable = table.where("length(pixels) > 0")
    # images of equal pixels are one node, the row of one of them
    same = stored(readable.groupBy("pixels").agg(F.min("id").alias("first_id"), F.min("row").alias("node")), "image-nodes")
    nodes = table.join(same.select("node"), table["row"] == F.col("node"), "left_semi").where("n > 0").select(F.col("row").alias("node"), "n", "places", "bits")
    # each band of each descriptor names a bucket
    per_word = BANDS // WORDS
    band = f"shiftrightunsigned(get(bits, i div {per_word}), {64 // per_word} * pmod(i, {per_word})) & {(1 << 64 // per_word) - 1}"
    tokens = F.expr(f"array_distinct(transform(sequence(0, n * {BANDS} - 1), i -> xxhash64(pmod(i, {BANDS}), {band})))")
    listed = nodes.select("node", (F.col("n") < FEW).alias("few"), F.explode(tokens).alias("token"))
    shared = listed.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    met = stored(listed.join(shared, "token").select("token", "node", "k", "few"), "buckets")
    # an anchor for every bucket in use; what is still apart is paired afterwards
    least = met.groupBy("token").agg(F.min(F.struct("node", "few")).alias("x")).select("token", F.col("x.node").alias("a"), F.col("x.few").alias("a_few"))
    first = met.join(least, "token").where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max(F.col("few") | F.col("a_few")).alias("few")).where((F.col("c") >= MEET) | F.col("few"))
    first = stored(first.select("a", "b"), "image-pairs")
    links = confirmed(first, nodes)
    labels = components(links)
    second = stored(still_apart(met, labels).join(first, ["a", "b"], "left_anti"), "image-pairs")
    if not second.isEmpty():
        links = stored(links.unionByName(confirmed(second, nodes)), "image-links")
        labels = components(links)
    named = same.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = stored(named.join(least, "label").select("pixels", "component_id"), "image-classes")
    inside = readable.select("id", "n", "pixels").join(classes, "pixels").select("id", "n", "component_id")
    outside = table.where("length(pixels) = 0").select("id", "n", F.col("id").alias("component_id"))
    return inside.unionByName(outside).select(F.col("id").alias(id_col), F.col("n").alias("n_features"), "component_id")


def render(html: Column) -> Column:
    """A page's visible text drawn as a PGM image, WIDTH characters a row and SIDE pixels square a character.

    A paragraph, heading or other block of text starts a new row; items of lists flow on.
    """
    shades = np.random.default_rng(5).integers(0, 256, 1 << 16).astype(np.uint8)

    @F.arrow_udf("binary")
    def draw(pages: pa.Array) -> pa.Array:
        out = []
        for h in pages.to_pylist():
            lines = (" ".join(x.split()) for x in LAYOUT.sub(lambda m: "\n" if m[2] else " ", h or "").split("\n"))
            # what is left of a block's last row repeats it, as blank stretches look alike everywhere
            cells = "".join(((x + " ") * (WIDTH // (len(x) + 1) + 2))[: -(-len(x) // WIDTH) * WIDTH] for x in lines)
            cp = np.frombuffer(cells.encode("utf-32-le", "surrogatepass"), np.uint32)
            # shades of neighbouring letters together, so that strokes are wider than a pixel
            image = cp * np.uint32(31)
            image[1:] += cp[:-1]
            image = shades[image & np.uint32(0xFFFF)]
            image[cp == 32] = 255
            image = image.reshape(-1, WIDTH)
            if SIDE > 1:
                image = image.repeat(SIDE, 0).repeat(SIDE, 1)
            out.append(b"P5 %d %d 255\n" % (image.shape[1], len(image)) + image.tobytes())
        return pa.array(out, pa.binary())

    return draw(html)


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images, so each page is drawn as one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return image_copies(pages.select("page_id", render(F.col("html")).alias("image")), "page_id", "image")
