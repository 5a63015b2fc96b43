"""Byte-level BPE ids by whole batches.

Pre-tokens are found with array operations over code points, fingerprinted, and looked up in a
table that each Python worker fills as it goes; only pre-tokens it hasn't seen are merged, by
tiktoken with the vocabulary of the same file.  Texts with characters outside the class table are
left to the tokenizers library itself.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np

from .texts import span_hashes

#: Code points with a class here; texts with others take the library's own path.
LIMIT = 0x250
#: Pre-tokens that a worker remembers; beyond that it starts afresh.
REMEMBERED = 400_000
#: Code points that are handled at once.
BLOCK = 1 << 18
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
# White space below LIMIT, the contractions, and the split pattern they belong to.
WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CLASS = np.array([SPACE if c in WHITE else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LIMIT)], np.uint8)
VALUE = np.random.default_rng(7).integers(1, 2**63, LIMIT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def starts_of_tokens(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; first marks where texts start."""
    kind = CLASS[cp]
    white = kind == SPACE
    before = np.empty_like(kind)
    before[0], before[1:] = 0, kind[:-1]
    before_cp = np.empty_like(cp)
    before_cp[0], before_cp[1:] = 0, cp[:-1]
    text_end = np.ones(len(cp), bool)
    text_end[:-1] = first[1:]
    solid_next = np.zeros(len(cp), bool)
    solid_next[:-1] = ~white[1:]
    solid_next &= ~text_end
    out = np.where(white, (before != SPACE) | solid_next, np.where(before == SPACE, before_cp != 32, kind != before))
    out |= first
    quotes = np.flatnonzero(cp == 39)
    if len(quotes):
        free = first[quotes] | (before[quotes] == LETTER) | (before[quotes] == NUMBER) | ((before[quotes] == SPACE) & (before_cp[quotes] != 32))
        quotes = quotes[free & ~text_end[quotes]]
        one = cp[quotes + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pairs = quotes[~short & ~text_end[np.minimum(quotes + 1, len(cp) - 1)]]
        a, b = cp[pairs + 1], cp[pairs + 2] if len(pairs) else cp[pairs]
        long = pairs[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        for at, n in ((quotes[short], 2), (long, 3)):
            out[at] = True
            for k in range(1, n):
                out[at + k] = False
            after = at + n
            out[after[after < len(cp)]] = True
    return out


def safe_cut(text: str, at: int) -> int:
    """The first place from at on where a text may be cut: a blank between letters, before which no pre-token goes on."""
    while (at := text.find(" ", at)) >= 0:
        if at + 1 < len(text) and text[at - 1].isascii() and text[at - 1].isalpha() and text[at + 1].isascii() and text[at + 1].isalpha():
            return at
        at += 1
    return len(text)


class Remembered:
    """Ids by fingerprint of a pre-token: an open-addressed table over one pool of ids."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.mask = (1 << 16) - 1
        self.keys, self.slots = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        self.pool, self.pooled = np.zeros(1 << 18, np.uint32), 0
        self.begin, self.count, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each fingerprint, or -1."""
        out = np.full(len(h), -1, np.int64)
        todo, at = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            key = self.keys[at]
            hit = key == h[todo]
            out[todo[hit]] = self.slots[at[hit]]
            go = ~hit & (key != 0)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out

    def insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        todo, at = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[todo[free]]  # of several, the last one gets the place
            won = free & (self.keys[at] == h[todo])
            self.slots[at[won]] = entry[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.mask

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        n = np.array([len(x) for x in ids], np.int64)
        total = int(n.sum())
        while self.pooled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + len(h) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.pool[self.pooled : self.pooled + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        entry = np.arange(self.known, self.known + len(h))
        self.count[entry] = n
        self.begin[entry] = self.pooled + np.cumsum(n) - n
        if 2 * (self.known + len(h)) > self.mask:
            held, slots = self.keys[self.keys != 0], self.slots[self.keys != 0]
            while 2 * (self.known + len(h)) > self.mask:
                self.mask = 2 * self.mask + 1
            self.keys, self.slots = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
            self.insert(held, slots)
        self.insert(h, entry)
        self.known += len(h)
        self.pooled += total

    def gather(self, h: np.ndarray, merge: Callable[[np.ndarray], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in turn, and where each one's end; merge gives those of the unknown, by place."""
        h[h == 0] = 1
        if self.known > REMEMBERED:
            self.reset()
        entry = self.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            fresh, where = np.unique(h[new], return_index=True)
            self.add(fresh, merge(new[where]))
            entry[new] = self.find(h[new])
        n = self.count[entry]
        done = np.cumsum(n)
        return self.pool[np.repeat(self.begin[entry] - done + n, n) + np.arange(done[-1] if len(done) else 0)], done


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.fast = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec["model"].get("ignore_merges")
        special = {t["content"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, special_tokens={}).encode_ordinary if self.fast else None
        self.words = Remembered()

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of non-empty texts, BLOCK code points or so in all."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        at = np.cumsum(sizes) - sizes
        odd = np.maximum.reduceat(cp, at) >= LIMIT
        if odd.any():
            plain = iter(self.block([t for t, o in zip(texts, odd, strict=True) if not o]) if not odd.all() else [])
            return [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if o else next(plain) for t, o in zip(texts, odd, strict=True)]
        first = np.zeros(len(cp), bool)
        first[at] = True
        begin = np.flatnonzero(starts_of_tokens(cp, first))
        end = np.append(begin[1:], len(cp))
        ids, done = self.words.gather(span_hashes(VALUE[cp], begin, end), lambda at_: [self.merge(joined[a:b]) for a, b in zip(begin[at_].tolist(), end[at_].tolist(), strict=True)])
        last = np.searchsorted(begin, np.append(at[1:], len(cp)))
        stop = done[last - 1]
        return np.split(ids, stop[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without special tokens."""
        if not self.fast:
            return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                for (i, _), ids in zip(held, self.block([t for _, t in held]), strict=True):
                    parts[i].append(ids)
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = len(text) if len(text) - at <= BLOCK else safe_cut(text, at + BLOCK)
                held.append((i, text[at:end]))
                size += end - at
                at = end
                if size >= BLOCK // 2:
                    flush()
        flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
