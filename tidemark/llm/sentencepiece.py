"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text's blanks become the meta symbol, one is put before it, and words (a run of blanks with
what follows) are merged on their own, as no piece has a blank after another character.  An
agenda takes adjacent symbols whose join is a piece, best score first, leftmost of equals.  A
candidate that is taken from the agenda is skipped where a hash keyed by seed, document, number
of the word in it and place in the word falls under the dropout.  So a seed always gives a
document the same pieces on every machine, while other seeds, and every other occurrence of a
word, are drawn anew.  Characters without a piece become bytes, and so does a literal meta symbol,
which makes decoding lossless.

The agendas of all words of a block are worked off side by side, one candidate of each word a
round, by array operations; only words over LONGEST characters have an agenda of their own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_batches
from .texts import FACTORS, mixed

META = "▁"
DROPOUT, SEED = 0.1, 17
#: Code points that are handled at once, about.
BLOCK = 1 << 19
#: Words up to so many characters are merged side by side, in classes of these sizes.
CLASSES = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48)
LONGEST = CLASSES[-1]
#: Bits of a place in a word of at most LONGEST characters, and a rank that no piece has.
PLACE, NEVER = 6, np.int32(2**31 - 1)
MASK = (1 << 64) - 1
MIXERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Draws are compared by their upper DRAWN bits.
DRAWN = 53


def drawn(key: np.ndarray, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The draw of a candidate: symbols from i to j and j to end of the word with that key."""
    m = [np.uint64(x) for x in MIXERS]
    i = i.astype(np.uint64)
    u = key + i * m[0] + j.astype(np.uint64) * m[1] + (end.astype(np.uint64) - i) * m[2]
    u = (u ^ (u >> np.uint64(30))) * m[1]
    u = (u ^ (u >> np.uint64(27))) * m[2]
    return (u ^ (u >> np.uint64(31))) >> np.uint64(64 - DRAWN)


class Model:
    """A BPE model with byte fallback: symbols, their joins, and bytes by id.

    A symbol is a piece (its id), a character that is only part of pieces, or OTHER (`other`).
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        usable = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if usable[i]}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not model.is_byte(i) for i in self.byte_ids) or any(META in p.lstrip(META) for p in self.ids):
            raise ValueError("a BPE model with byte fallback and blanks only at the start of pieces is needed")
        values = [p.replace(META, " ").encode() if usable[i] else b"" for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids):
            values[i] = bytes([b])
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(values), np.uint8)
        if len(self.ids) >> (30 - PLACE):
            raise ValueError("too many pieces")
        places = {s: r for r, s in enumerate(sorted({-model.get_score(i) for i in self.ids.values()}))}
        self.rank = {p: places[-model.get_score(i)] for p, i in self.ids.items()}
        self._joins()

    def _joins(self) -> None:
        """Symbols by code point, and an open-addressed table of the joins of two symbols."""
        symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            symbols.setdefault(c, len(self.pieces) + len(symbols) - len(self.ids))
        self.other = len(self.pieces) + len(symbols) - len(self.ids)
        self.of_code = np.full(0x110000, self.other, np.int32)
        for s, i in symbols.items():
            if len(s) == 1 and s != META:
                self.of_code[ord(s)] = i
        self.of_code[32] = symbols.get(META, self.other)
        self.rank_of = np.zeros(self.other + 1, np.int32)
        for p, i in self.ids.items():
            self.rank_of[i] = self.rank[p]
        pairs = {(a * (self.other + 1) + b): i for p, i in self.ids.items() for k in range(1, len(p)) if (a := symbols.get(p[:k])) is not None and (b := symbols.get(p[k:])) is not None}
        self.shift = np.uint64(64 - max(12, (8 * len(pairs)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.joined = np.full(len(self.keys), -1, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of several, the last one gets the place
            won = self.keys[at] == keys[todo]
            self.joined[at[won]] = values[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(MIXERS[0])) >> self.shift).view(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make together, or -1."""
        keys = a.astype(np.int64) * (self.other + 1) + b
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.joined[at], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.joined[at[hit]]
            go = ~hit & (held >= 0)
            todo, at = todo[go], at[go]
        return out

    def merge(self, word: str, dropout: float, key: int) -> list[int]:
        """Ids of one word, blanks already as meta symbols, by an agenda of its own."""
        n = len(word)
        # a symbol is the place where it starts; after has its end, or -1 once it was merged into the one before
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        limit = int(min(1.0, dropout) * (1 << DRAWN))
        rank, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        # (rank, start, start of the right symbol, end): equal ranks go from left to right
        agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, end = pop(agenda)
            if after[i] != j or after[j] != end:
                continue
            if limit:
                u = (key + i * MIXERS[0] + j * MIXERS[1] + (end - i) * MIXERS[2]) & MASK
                u = ((u ^ (u >> 30)) * MIXERS[1]) & MASK
                u = ((u ^ (u >> 27)) * MIXERS[2]) & MASK
                if (u ^ (u >> 31)) >> (64 - DRAWN) < limit:
                    continue
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
                if (r := rank(word[i : after[end]])) is not None:
                    push(agenda, (r, i, end, after[end]))
            if (k := before[i]) >= 0 and (r := rank(word[k:end])) is not None:
                push(agenda, (r, k, i, end))
        out: list[int] = []
        at = 0
        while at < n:
            s = word[at : after[at]]
            i = self.ids.get(s)
            out += [i] if i is not None else [self.byte_ids[b] for b in s.encode()]
            at = after[at]
        return out

    def merge_all(self, symbols: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
        """Symbols (places x words, OTHER after a word's end) after all merges; -1 where one was merged into the one before.

        The agenda of a word is its column of `agenda`: rank and place of the candidate that starts there.
        """
        n, count = symbols.shape
        out = np.empty((n, count), np.int32)
        column = np.arange(count)
        # row n stands for what is before the first and after the last symbol
        symbol = np.vstack([symbols, np.full((1, count), self.other, np.int32)])
        piece = np.full((n + 1, count), -1, np.int32)
        piece[: n - 1] = self.join(symbol[: n - 1].ravel(), symbol[1:n].ravel()).reshape(n - 1, count)
        agenda = np.full((n + 1, count), NEVER, np.int32)
        agenda[: n - 1] = np.where(piece[: n - 1] >= 0, self.rank_of[piece[: n - 1]] << PLACE | np.arange(n - 1, dtype=np.int32)[:, None], NEVER)
        after = np.repeat(np.arange(1, n + 2, dtype=np.int64)[:, None], count, 1)
        before = np.repeat(np.r_[n, np.arange(n)].astype(np.int64)[:, None], count, 1)
        here = np.arange(count)
        while True:
            best = agenda[: n - 1].min(0) if n > 1 else np.full(len(column), NEVER, np.int32)
            open_ = best < NEVER
            left = int(np.count_nonzero(open_))
            if left < 0.8 * len(column):
                done = ~open_
                out[:, column[done]] = symbol[:n, done]
                if not left:
                    return out
                keep = np.flatnonzero(open_)
                symbol, piece, agenda, after, before = (np.take(x, keep, 1) for x in (symbol, piece, agenda, after, before))
                column, best, keys = column[keep], best[keep], keys[keep]
                here = c = np.arange(left)
            elif left < len(column):
                c = here[open_]
                best = best[c]
            else:
                c = here
            wide = len(column)
            symbol_, piece_, agenda_, after_, before_ = (x.reshape(-1) for x in (symbol, piece, agenda, after, before))
            i = (best & ((1 << PLACE) - 1)).astype(np.int64)
            at = i * wide + c
            j = after_[at]
            end = after_[j * wide + c]
            if limit:
                skipped = drawn(keys[c], i, j, end) < np.uint64(limit)
                agenda_[at[skipped]] = NEVER
                go = np.flatnonzero(~skipped)
                c, i, j, end, at = c[go], i[go], j[go], end[go], at[go]
            made = piece_[at]
            symbol_[at] = made
            gone = j * wide + c
            symbol_[gone] = -1
            agenda_[gone] = NEVER
            after_[at] = end
            past = end * wide + c
            before_[past] = i
            first = before_[at]
            ahead = first * wide + c
            for where, place, a, b in ((at, i, made, symbol_[past]), (ahead, first, symbol_[ahead], made)):
                p = self.join(a, b)
                piece_[where] = p
                agenda_[where] = np.where(p >= 0, self.rank_of[p] << PLACE | place.astype(np.int32), NEVER)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes: its pieces', without the blank that encoding put first."""
        return self.spelled(ids)[0].tobytes()[1:]

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where those of each id end."""
        n = self.sizes[ids]
        done = np.cumsum(n)
        return self.bytes[np.repeat(self.begin[ids] - done + n, n) + np.arange(done[-1] if len(done) else 0)], done


class Encoder:
    def __init__(self, path: str, dropout: float, seed: int) -> None:
        self.model, self.dropout, self.seed = Model(path), dropout, seed
        self.limit = int(min(1.0, max(0.0, dropout)) * (1 << DRAWN))

    def block(self, texts: list[str], keys: list[int], first_word: list[int]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of parts of texts that start at words, and the number of words of each."""
        model, joined = self.model, "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        at = np.cumsum(sizes) - sizes
        blank, alone = cp == 32, (cp == 10) | (cp == ord(META))
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start |= alone
        start[1:] |= alone[:-1]
        start[at] = True
        begin = np.flatnonzero(start)
        length = np.diff(np.append(begin, len(cp)))
        edge = np.searchsorted(begin, np.append(at, len(cp)))
        number = np.diff(edge)
        order = np.arange(len(begin)) - np.repeat(edge[:-1], number) + np.repeat(np.array(first_word, np.int64), number)
        word_key = mixed(np.repeat(np.array(keys, np.uint64), number) + order.astype(np.uint64) * FACTORS[11])
        symbols = model.of_code[cp]
        final = symbols.copy()  # by place; -1 where merged into the symbol before
        padded = np.append(symbols, np.full(LONGEST, model.other, np.int32))
        by_size = np.searchsorted(CLASSES, length)
        for k, n in enumerate(CLASSES):
            words = np.flatnonzero((by_size == k) & (length > 1))
            if not len(words):
                continue
            place = begin[words] + np.arange(n)[:, None]
            inside = np.arange(n)[:, None] < length[words]
            done = model.merge_all(np.where(inside, padded[place], np.int32(model.other)), word_key[words], self.limit)
            final[place[inside]] = done[inside]
        extra: dict[int, list[int]] = {}
        for w in np.flatnonzero(length > LONGEST).tolist():
            a, b = int(begin[w]), int(begin[w] + length[w])
            extra[a] = model.merge(joined[a:b].replace(" ", META), self.dropout, int(word_key[w]))
            final[a:b] = -1
            final[a] = model.other
        for a in np.flatnonzero(final >= len(model.pieces)).tolist():  # characters without a piece
            if a not in extra:
                extra[a] = [model.byte_ids[b] for b in joined[a].encode("utf-8", "surrogatepass")]
        kept = np.flatnonzero(final >= 0)
        ids = final[kept].astype(np.uint32)
        if extra:
            where = np.array(sorted(extra), np.int64)
            many = np.ones(len(kept), np.int64)
            slot = np.searchsorted(kept, where)
            many[slot] = [len(extra[a]) for a in where.tolist()]
            begins = np.cumsum(many) - many
            ids = np.repeat(ids, many)
            for s, a in zip(begins[slot].tolist(), where.tolist(), strict=True):
                ids[s : s + len(extra[a])] = extra[a]
            ends = np.append(begins, len(ids))
        else:
            ends = np.arange(len(kept) + 1)
        return np.split(ids, ends[np.searchsorted(kept, at[1:])]), number.tolist()

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        words: dict[int, int] = {}  # words of a text in parts that are done
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                done, number = self.block([t for _, t in held], [keys[i] for i, _ in held], [words.get(i, 0) for i, _ in held])
                for (i, _), ids, n in zip(held, done, number, strict=True):
                    parts[i].append(ids)
                    words[i] = words.get(i, 0) + n
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            text, at = " " + text, 0
            while at < len(text):
                end = len(text) if len(text) - at <= BLOCK else word_start(text, at + BLOCK)
                held.append((i, text[at:end]))
                size += end - at
                at = end
                if size >= BLOCK or at < len(text):
                    flush()
        flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]


def word_start(text: str, at: int) -> int:
    """The first place from at on where a word starts after a letter, or the text's end."""
    while (at := text.find(" ", at)) >= 0:
        if text[at - 1] != " ":
            return at
        at += 1
    return len(text)


_encoders: dict[tuple[str, float, int], Encoder] = {}


def encoder(path: str, dropout: float, seed: int) -> Encoder:
    key = (path, dropout, seed)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, dropout, seed)
    return _encoders[key]


def sp_encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """All columns of docs plus ids (array of int); with digest, id, n_pieces, ids_crc32 and lossless only.

    lossless says whether decoding the ids gave the text's bytes.  Null and empty texts have no
    ids; null ids key like 0; repeated rows get equal ids; an empty table gives an empty one; a
    clashing column name gets a leading underscore.  dropout 0 gives the model's own encoding.
    """
    small_batches(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("0")), F.lit(seed))
    text = F.col(f"`{text_col}`").cast("string")

    def ids_of(batch: pa.RecordBatch, k: int) -> tuple[list[str], list[np.ndarray]]:
        texts = [t or "" for t in batch.column(k).to_pylist()]
        return texts, encoder(model, dropout, seed).encode(texts, [x & MASK for x in batch.column(k + 1).to_pylist()])

    if digest:

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, ids = ids_of(b, 1)
                code = encoder(model, dropout, seed).model
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([code.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)], pa.bool_())],
                    [id_col, "n_pieces", "ids_crc32", "lossless"],
                )

        kind = docs.schema[id_col].dataType.simpleString()
        return docs.select(F.col(f"`{id_col}`"), text, key).mapInArrow(rows, f"`{id_col}` {kind}, n_pieces long, ids_crc32 long, lossless boolean")

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array, keys: pa.Array) -> pa.Array:
        _, ids = ids_of(pa.RecordBatch.from_arrays([texts, keys], ["t", "k"]), 0)
        return pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))

    return docs.withColumn(fresh(docs.columns, "ids"), encode(text, key))


def sp_decode(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text that ids_col stands for in text_col; null ids give a null text."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        code = encoder(model, 0.0, 0).model
        return pa.array([None if x is None else code.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return rows.withColumn(text_col, decode(F.col(f"`{ids_col}`")))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sp_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
