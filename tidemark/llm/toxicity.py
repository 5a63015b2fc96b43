"""Toxicity by a weighted finite-state pattern grammar.

Words map to classes (insult, threat, target, negation, report, other) through a lexicon.  Small
transducers for negation, target and reported speech run over the classes of a clause; their
product is one transducer, precomputed as a table, whose arcs emit a pattern for each insult or
threat in its context.  The insult class, words or word beginnings, is learned from labels by
grouped counts of the words that stand where the transducers find neither negation nor reported
speech, so a word that is as often denied or quoted in harmless documents is learned too.
Documents are scored by the weighted sum of the patterns that their clauses match, through a
logistic function, in which a target only adds; one without a match gets the base rate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches, stored

#: Labelled rows that the lexicon and the weights are learned from, at most (those of smallest hash).
SAMPLE = 16_000
#: Lengths of word beginnings that may enter the lexicon.
STEMS = (4, 5, 6, 7, 8)

# Seed words of the grammar's classes.
THREAT = "kill hurt destroy beat stab shoot tuer frapper détruire töten schlagen zerstören matar golpear destruir"
TARGET = "you your yours u ya yourself he she they them him her tu toi vous votre te du dich dir ihr euch sie tú ti usted ustedes vosotros"
NEGATION = "not never no isn't aren't don't without ne pas jamais nicht kein keine nie nunca jamás sin"
REPORT = "said says say wrote writes quoted quote called claimed reported dit écrit sagte schrieb dijo escribió"

CLASSES = ("other", "insult", "threat", "target", "negation", "report")
OTHER, INSULT, THREATS, TARGETS, NEGATES, REPORTS = range(6)
PATTERNS = ("insult", "insult_target", "threat", "threat_target", "negated", "reported")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;\n]+")


class Transducer(NamedTuple):
    """Deterministic: step[state][class] is (next state, output)."""

    step: list[list[tuple[int, int]]]


def negation(reach: int = 3) -> Transducer:
    """Outputs 1 for the words up to reach after a negation."""
    return Transducer([[(reach, 0) if c == NEGATES else (max(0, s - 1), int(s > 0)) for c in range(6)] for s in range(reach + 1)])


def latch(of: int) -> Transducer:
    """Outputs 1 from the word after the first of that class on, until the clause ends."""
    return Transducer([[(1 if s or c == of else 0, s) for c in range(6)] for s in range(2)])


def compose(parts: list[Transducer]) -> tuple[list[list[tuple[int, int]]], int]:
    """The product transducer: step[state][class] is (next, pattern or -1); and its number of states."""
    states = list(product(*(range(len(p.step)) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    table = []
    for s in states:
        row = []
        for c in range(6):
            moves = [p.step[x][c] for p, x in zip(parts, s, strict=True)]
            negated, aimed, reported = (m[1] for m in moves)
            pattern = -1
            if c in (INSULT, THREATS):
                pattern = 4 if negated else 5 if reported else (0 if c == INSULT else 2) + aimed
            row.append((number[tuple(m[0] for m in moves)], pattern))
        table.append(row)
    return table, len(states)


class Grammar:
    """Lexicon, product transducer and weights; plain data, so that it can be shipped to tasks."""

    def __init__(self, terms: dict[str, float], weights: list[float], bias: float) -> None:
        """terms: insult words, or beginnings with a final *, and their weights."""
        self.terms, self.weights, self.bias = terms, weights, bias
        self.table, _ = compose([negation(), latch(TARGETS), latch(REPORTS)])
        self.seeds = {w: c for c, words in ((TARGETS, TARGET), (NEGATES, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words.split()}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self._found = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}

    def classify(self, word: str) -> tuple[int, float]:
        w = self.terms.get(word)
        if w is None and self.stems:
            w = next((self.stems[s] for n in self.lengths if n <= len(word) and (s := word[:n]) in self.stems), None)
        if w is not None:
            return INSULT, w
        c = self.seeds.get(word, OTHER)
        return c, 3.0 if c == THREATS else 0.0

    def plain_words(self, text: str) -> set[str]:
        """Words of lower-cased text that stand somewhere neither negated nor in reported speech."""
        out = set()
        for clause in CLAUSE.split(text):
            state = 0
            for m in WORD.finditer(clause):
                if self.table[state][INSULT][1] in (0, 1):
                    out.add(m[0])
                state = self.table[state][self.seeds.get(m[0], OTHER)][0]
        return out

    def hits(self, text: str) -> Iterator[int]:
        """Places in lower-cased text where a word starts that may be an insult or a threat."""
        if self._found is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for t in [*(t.rstrip("*") for t in self.terms), *THREAT.split()]:
                found.add_word(t, len(t))
            found.make_automaton()
            self._found = found
        for end, n in self._found.iter(text):
            at = end - n + 1
            if at == 0 or not text[at - 1].isalpha():
                yield at

    def features(self, text: str | None) -> np.ndarray:
        """Sum of the matched words' weights for each pattern, log(1 + x); what is aimed at a target counts for both."""
        out = [0.0] * len(PATTERNS)
        if text:
            low, done = text.lower(), -1
            for at in self.hits(low):
                if at < done:
                    continue
                start = max((m + 1 for m in (low.rfind(c, 0, at) for c in ".!?;\n")), default=0)
                ends = CLAUSE.search(low, at)
                done, state = ends.start() if ends else len(low), 0
                aimed = False
                matched = []
                for m in WORD.finditer(low, start, done):
                    c, w = self.classify(m[0])
                    aimed |= c == TARGETS
                    state, pattern = self.table[state][c]
                    if pattern >= 0:
                        matched.append((pattern, w))
                for pattern, w in matched:  # a target may also follow
                    out[pattern - (pattern in (1, 3))] += w
                    if pattern in (1, 3) or aimed and pattern in (0, 2):
                        out[pattern | 1] += w
        return np.log1p(np.array(out))

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.features(text) @ np.array(self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], float]:
    """Weights and bias by Newton steps; weights are kept at zero or more, bar those that excuse."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    keep = np.diag([*[ridge] * x.shape[1], 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        step = np.linalg.solve((xb * (p * (1 - p))[:, None]).T @ xb + keep, xb.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return [float(max(0.0, v)) if i < 4 else float(v) for i, v in enumerate(w[:-1])], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: str) -> Grammar:
    """A grammar from at most SAMPLE labelled rows for which the SQL condition usable(id) holds."""
    rows = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull()).where(usable)
    sample = stored(rows.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE), "labelled")
    # one text of an id that repeats
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")).join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    texts = stored(texts, "labelled-texts")
    n_pos, n_all = texts.agg(F.coalesce(F.sum("_y"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_pos or n_pos == n_all:
        return Grammar({}, [0.0, 0.0, 0.5, 1.0, 0.0, 0.0], math.log((n_pos + 0.5) / (n_all - n_pos + 0.5)) if n_all else -3.0)
    blank = Grammar({}, [0.0] * 6, 0.0)

    @lean
    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(blank.plain_words(t.lower())) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["_y", "words"])

    words = texts.select("_y", "_text").mapInArrow(plain, "_y int, words array<string>").select("_y", F.explode("words").alias("w")).where(F.length("w") >= 3)
    stems = F.array(F.col("w"), *[F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in STEMS])
    counts = words.select("_y", F.explode(F.array_compact(stems)).alias("term")).groupBy("term").agg(F.sum("_y").alias("pos"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("pos") + 0.1) / (n_pos + 1.0)) - F.log((F.col("n") - F.col("pos") + 0.1) / (n_all - n_pos + 1.0))
    # at most 400 times the plain words of a mean toxic document
    found = (
        counts.where((F.col("pos") >= max(3, n_pos // 400)) & (F.col("pos") >= 0.9 * F.col("n")))
        .withColumn("odds", odds)
        .where(F.col("odds") >= 3.0)
        .orderBy(F.col("pos").desc(), F.length("term"), "term")
        .collect()
    )
    terms: dict[str, float] = {}
    for r in found:  # a beginning stands for the words and longer beginnings that it covers
        plain = r.term.rstrip("*")
        if not any(plain.startswith(t[:-1]) for t in terms if t.endswith("*")):
            terms[r.term] = float(r.odds)
    draft = Grammar(terms, [0.0] * 6, 0.0)

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["_y"], "x": [draft.features(t).tolist() for t in b["_text"]]})

    seen = texts.select("_y", "_text").mapInPandas(rows_of, "y int, x array<double>").toPandas()
    weights, bias = logistic(np.array(seen["x"].tolist()), seen["y"].to_numpy(float))
    return Grammar(terms, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels of rows whose crc32(id as text) % 5 is 0 are never read for learning; null labels and
    labels without a document are ignored; without labels the built-in threat words alone count.
    A null text counts as empty; null ids are not held out.  Whole texts are scored, row by row,
    so repeated rows score alike; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    grammar = learn(docs, labels, id_col, text_col, label_col, "crc32(CAST(_id AS STRING)) % 5 <> 0")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(t) for t in texts], dtype=float)

    scored = docs.select(F.col(f"`{id_col}`").alias(id_col), score(F.col(f"`{text_col}`")).alias("score"))
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
