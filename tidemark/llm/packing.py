"""Best-fit packing of token sequences by swap-based local search.

Texts become pieces of at most `capacity` tokens in one pass; only their lengths matter for the
plan.  There are at most `capacity` different lengths, so the plan is made from the histogram of
lengths, whose size is fixed whatever the input's: bins with equal contents are one kind with a
number of copies.  Best fit, longest first, gives the first plan, which local search improves: the
emptiest kind exchanges one for one or two for one with another underfull kind, or moves a
document there, by the exchange that raises the sum of squared fills most, until bins run empty
and the lower bound is met, or no exchange raises the sum.  All partners and all pairs are looked
through, by a table of the most that one or two pieces come to.  Pieces get their places by their
rank among pieces of their length, from counts by task, so nothing is sorted or gathered.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, stored
from .tokens import encoder

CAPACITY = 2048
#: Kinds with up to so many lengths are looked through together; those with more apart.
NARROW = 8
#: The search ends after so many exchanges for each kind of underfull bin without a bin less.
PATIENCE = 2

#: A kind of bin: its contents as sorted (length, count) pairs.
Kind = tuple[tuple[int, int], ...]


def fill(kind: Kind) -> int:
    return sum(s * n for s, n in kind)


def changed(kind: Kind, out: dict[int, int], into: dict[int, int]) -> Kind:
    have = Counter(dict(kind))
    have.subtract(out)
    have.update(into)
    return tuple(sorted((s, n) for s, n in have.items() if n))


def lower_bound(sizes: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by pieces that can't share (Martello and Toth's L2)."""
    total = np.zeros(capacity + 1, np.int64)
    for s, n in sizes.items():
        total[s] = n
    number, volume = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(total * np.arange(capacity + 1))])
    half, best = capacity // 2, -(-int(volume[-1]) // capacity)
    for small in range(half + 1):
        large = int(number[-1] - number[capacity - small + 1])
        middle = int(number[capacity - small + 1] - number[half + 1])
        room = middle * capacity - int(volume[capacity - small + 1] - volume[half + 1])
        rest = int(volume[half + 1] - volume[small])
        best = max(best, large + middle + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(sizes: dict[int, int], capacity: int) -> Counter[Kind]:
    """Best fit, longest first, over lengths with counts: kinds of bins with their numbers."""
    by_room: list[Counter[Kind]] = [Counter() for _ in range(capacity + 1)]
    by_room[capacity][()] = sum(sizes.values())
    for s in sorted(sizes, reverse=True):
        left = sizes[s]
        room = s
        while left:
            while not by_room[room]:
                room += 1
            kind = next(iter(by_room[room]))
            copies, each = by_room[room][kind], min(room // s, left)
            used = min(copies, left // each)
            by_room[room][kind] -= used
            if not by_room[room][kind]:
                del by_room[room][kind]
            by_room[room - each * s][changed(kind, {}, {s: each})] += used
            left -= used * each
            room = s
    out: Counter[Kind] = Counter()
    for kinds in by_room:
        out.update(kinds)
    del out[()]
    return out


def next_fit(sizes: dict[int, int], capacity: int) -> Counter[Kind]:
    """Bins filled one after the other, longest pieces first, never looking back: a poor plan to measure the search by."""
    out: Counter[Kind] = Counter()
    held: dict[int, int] = {}
    room = capacity
    for s in sorted(sizes, reverse=True):
        left = sizes[s]
        if held and (n := min(left, room // s)):
            held[s], room, left = n, room - n * s, left - n
        if not left:
            continue
        if held:
            out[tuple(sorted(held.items()))] += 1
            held, room = {}, capacity
        each = capacity // s
        if left >= each:
            out[((s, each),)] += left // each
        if left % each:
            held, room = {s: left % each}, capacity - left % each * s
    if held:
        out[tuple(sorted(held.items()))] += 1
    return out


class Underfull:
    """The underfull kinds of a packing by slot: room, lengths (padded with 0) and number of copies."""

    def __init__(self, bins: Counter[Kind], capacity: int) -> None:
        self.capacity, self.copies = capacity, dict.fromkeys(bins, 0)
        self.kinds: list[Kind] = []
        self.slot: dict[Kind, int] = {}
        self.free: list[int] = []
        self.room, self.width = np.zeros(64, np.int64), np.zeros(64, np.int64)  # width 0: no kind
        self.lengths = np.zeros((64, NARROW + 1), np.int64)
        for kind, n in bins.items():
            self.add(kind, n)

    def add(self, kind: Kind, n: int) -> None:
        have = self.copies.get(kind, 0) + n
        if have:
            self.copies[kind] = have
        else:
            self.copies.pop(kind, None)
        if not have and kind in self.slot:
            i = self.slot.pop(kind)
            self.width[i] = 0
            self.free.append(i)
        elif have and kind not in self.slot and (room := self.capacity - fill(kind)):
            i = self.free.pop() if self.free else len(self.kinds)
            if i == len(self.kinds):
                self.kinds.append(kind)
            self.kinds[i] = kind
            if i >= len(self.room):
                self.room, self.width, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.room, self.width, self.lengths))
            if len(kind) >= self.lengths.shape[1]:
                self.lengths = np.hstack([self.lengths, np.zeros((len(self.lengths), len(kind)), np.int64)])
            self.slot[kind], self.room[i], self.width[i] = i, room, len(kind)
            self.lengths[i] = 0
            self.lengths[i, 1 : len(kind) + 1] = [s for s, _ in kind]

    def partner(self, poor: int) -> tuple[int, int, int] | None:
        """The slot, and the tokens that go there and come back (0 for none), of the exchange that raises the sum of squared fills most."""
        ours, room = self.kinds[poor], self.room[poor]
        x, n = np.array([s for s, _ in ours], np.int64), np.array([n for _, n in ours])
        two = x[:, None] + x[None, :]
        allowed = (two <= self.capacity) & (~np.eye(len(x), dtype=bool) | (n[:, None] > 1))
        # the most that one or two of our pieces come to, up to each number of tokens
        most = np.zeros(self.capacity + 1, np.int64)
        most[x] = x
        most[two[allowed]] = two[allowed]
        most = np.maximum.accumulate(most)
        best: tuple[int, int, int, int] | None = None
        for slots, columns in ((np.flatnonzero((self.width > 0) & (self.width <= NARROW)), NARROW + 1), (np.flatnonzero(self.width > NARROW), self.lengths.shape[1])):
            if self.copies[ours] < 2:
                slots = slots[slots != poor]
            if not len(slots):
                continue
            back, theirs = self.lengths[slots, :columns], self.room[slots, None]
            gain = most[np.minimum(back + theirs, self.capacity)] - back
            gain[:, 1:][back[:, 1:] == 0] = 0
            rise = np.where(gain > 0, gain * (room - theirs + gain), 0)  # half of it
            at = int(rise.argmax())
            r, c = divmod(at, columns)
            if rise[r, c] > 0 and (best is None or rise[r, c] > best[0]):
                best = int(rise[r, c]), int(slots[r]), int(back[r, c] + gain[r, c]), int(back[r, c])
        return best and best[1:]


def split(kind: Kind, tokens: int) -> dict[int, int]:
    """One piece of the kind, or two, with so many tokens."""
    have = dict(kind)
    if tokens in have:
        return {tokens: 1}
    a = next(s for s in have if tokens - s in have and (tokens != 2 * s or have[s] > 1))
    return {a: 2} if tokens == 2 * a else {a: 1, tokens - a: 1}


def local_search(bins: Counter[Kind], capacity: int, bound: int) -> Counter[Kind]:
    """bins after exchanges that each raise the sum of squared fills; never more bins than before."""
    state, total = Underfull(bins, capacity), sum(bins.values())
    least, since, stuck = total, 0, set()
    while total > bound and since <= PATIENCE * len(state.slot):
        rest = np.flatnonzero(state.width)
        rest = [i for i in rest[np.argsort(-state.room[rest], kind="stable")][: len(stuck) + 1].tolist() if state.kinds[i] not in stuck]
        if not rest:
            break
        poor = state.kinds[rest[0]]
        found = state.partner(rest[0])
        if found is None:
            stuck.add(poor)
            continue
        rich = state.kinds[found[0]]
        out, back = split(poor, found[1]), {found[2]: 1} if found[2] else {}
        times = state.copies[poor] // 2 if rich == poor else min(state.copies[poor], state.copies[rich])
        for kind, gone, came in ((poor, out, back), (rich, back, out)):
            state.add(kind, -times)
            if new := changed(kind, gone, came):
                state.add(new, times)
            else:
                total -= times
        stuck.clear()
        since += 1
        if total < least:
            least, since = total, 0
    return Counter(state.copies)


def plan(sizes: dict[int, int], capacity: int = CAPACITY) -> Counter[Kind]:
    """Kinds of bins, with their numbers, that hold exactly these lengths."""
    return local_search(best_fit(sizes, capacity), capacity, lower_bound(sizes, capacity))


def places(bins: Counter[Kind], capacity: int) -> dict[str, np.ndarray]:
    """For each length, stretches of ranks: key (length and first rank), pieces per bin, first bin, first offset."""
    rows, base, taken = [], 0, Counter()
    for kind, copies in sorted(bins.items()):
        offset = 0
        for s, n in kind:
            rows.append((s, taken[s], n, base, offset))
            taken[s] += n * copies
            offset += s * n
        base += copies
    rows.sort()
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 5
    return dict(zip(("size", "rank", "each", "bin", "offset"), columns, strict=True))


def piece_table(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str, separator: int) -> DataFrame:
    """Stored pieces: doc, piece, start, length, crc, part and the place among the part's pieces of that length."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen, part = encoder(path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                raw = np.append(ids, np.uint32(separator)).astype("<u4")
                n = len(raw)
                start, end, piece = 0, n if n <= capacity else n % capacity or capacity, 0
                while start < n:
                    rows.append((doc, piece, start, end - start, zlib.crc32(raw[start:end].tobytes()), part, seen[end - start]))
                    seen[end - start] += 1
                    start, end, piece = end, end + capacity, piece + 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc", "piece", "start", "length", "crc", "part", "place"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stored(rows.mapInArrow(cut, f"doc {kind}, piece int, start long, length long, crc long, part int, place long"), "pieces")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", separator: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and one separator; null and empty texts are the separator alone.
    A longer one than capacity is cut into pieces of capacity, of which the first may be shorter.
    Repeated rows are packed once each; null ids are kept; an empty table gives an empty result.
    Which of several pieces of one length takes which place is arbitrary.
    """
    small_batches(docs.sparkSession)
    pieces = piece_table(docs, tokenizer, capacity, id_col, text_col, separator)
    sizes = {int(r.length): r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    at = places(plan(sizes, capacity), capacity)
    counts = pieces.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    shift = 1 << 44
    keys = at["size"] * shift + at["rank"]

    @lean
    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, place, before_ = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5, 6))
            rank = before_ + place
            row = np.searchsorted(keys, length * shift + rank, "right") - 1
            k = rank - at["rank"][row]
            sequence, offset = at["bin"][row] + k // at["each"][row], at["offset"][row] + k % at["each"][row] * length
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)], ["doc", "piece", "start", "length", "crc", "sequence_id", "offset"])

    kind = pieces.schema["doc"].dataType.simpleString()
    seated = pieces.join(ranks, ["part", "length"]).select("doc", "piece", "start", "length", "crc", "place", "before").mapInArrow(seat, f"doc {kind}, piece int, start long, length long, crc long, sequence_id long, offset long")
    return seated.select(F.col("doc").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
