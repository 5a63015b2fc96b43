"""Language ID by Bayesian evidence fusion.

A byte-trigram model per language is fitted on a bounded sample of declared rows.  The evidence
of a row is its text's likelihood, tempered for dependent trigrams; the language its markup
declares and its address's suffix, each through a confusion table; and the prior of its host,
smoothed towards its domain and that towards the corpus.  Tables and priors are grouped counts
of all rows.  Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, small_batches, stored
from .texts import flat

#: Rows of each declared language that the text model is fitted on, about (a share of the hashes of their keys), and fewest rows.
SAMPLE, LEAST_ROWS = 3_000, 3
#: Hashed trigrams; weight of the upper level in a prior.
BUCKETS, KAPPA = 1 << 16, 20.0
#: Chance of no known language, and least posterior of an accepted one.
UNKNOWN, LEAST = 0.01, 0.5
#: Rows of one host that are joined to one copy of its prior.
PER_SALT = 50_000
#: Bytes whose trigrams are scored at once.
BLOCK = 1 << 19

# Country suffixes of addresses and the language that they suggest.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}

# Letters in lower case (bytes over 127 as they are), everything else one blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)

# a tag ends before the next one at the latest, so that no text is read twice
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[a-z/!?][^<>]*>?", re.DOTALL | re.IGNORECASE)


def coded(column: pa.Array) -> Iterator[tuple[np.ndarray, slice, np.ndarray, np.ndarray]]:
    """Blocks of a column: the hashed trigram of every place, -1 where it isn't inside a text or is
    blank; the texts that the block touches, and where in it they start and end."""
    data, starts, ends = flat(column)
    for at in range(0, len(data), BLOCK):
        stop = min(at + BLOCK, len(data))
        b = FOLD[data[at : stop + 2]].astype(np.uint32)
        out = np.full(stop - at, -1, np.int32)
        if len(b) > 2:
            mix = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
            code = (mix >> np.uint32(16)).astype(np.int32)
            code[(b[1:-1] == 32) & ((b[:-2] == 32) | (b[2:] == 32))] = -1
            out[: len(code)] = code
        rows = slice(int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, stop, "left")))
        begin, end = np.maximum(starts[rows] - at, 0), ends[rows] - at
        for k in (1, 2):  # trigrams that go on past their text
            last = end[end > begin] - k
            out[last[(last >= 0) & (last < len(out))]] = -1
        yield out, rows, begin, np.minimum(end, len(out))


def text_scores(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the trigrams' log-likelihoods by language (texts x languages) and the number of trigrams; table is languages x trigrams."""
    out, n = np.zeros((len(column), len(table))), np.zeros(len(column), np.int64)
    for codes, rows, begin, end in coded(column):
        some = end > begin
        if not some.any():
            continue
        which, begin = np.arange(rows.start, rows.stop)[some], begin[some]
        n[which] += np.add.reduceat(codes >= 0, begin, dtype=np.int64)
        for k, likelihood in enumerate(table):  # its last place, for -1, is zero
            out[which, k] += np.add.reduceat(likelihood[codes], begin, dtype=np.float64)
    return out, n


def declared_language(html: Column) -> Column:
    """The language that a page's markup declares, two letters in lower case, or null."""
    head = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2})", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-z]{2})", 1)
    return F.lower(F.coalesce(F.nullif(head, F.lit("")), F.nullif(meta, F.lit(""))))


def address_parts(url: Column) -> dict[str, Column]:
    """Host, domain (last two labels) and suffix (country suffix, else a two-letter first path step) of an address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    top = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    known = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    step = F.lower(F.regexp_extract(url, r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[/?#.]|$)", 1))
    return {"host": F.nullif(host, F.lit("")), "domain": F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), "suffix": F.coalesce(F.try_element_at(known, top), F.nullif(step, F.lit("")))}


def visible(texts: pa.Array, markup: pa.Array) -> pa.Array:
    """texts, those marked as markup without their tags."""
    if not any(marks := markup.to_pylist()):
        return texts
    return pa.array([HIDDEN.sub(" ", t) if m and t else t for t, m in zip(texts.to_pylist(), marks, strict=True)], pa.string())


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods (languages + 1 x BUCKETS + 1); the last language is none, the last place zero."""
    known = rows.where(F.col("declared").isNotNull()).groupBy("declared").count().where(F.col("count") >= LEAST_ROWS).collect()  # two-letter codes
    languages = sorted(r.declared for r in known)
    table = np.zeros((len(languages) + 1, BUCKETS + 1))
    if languages:
        # by hash of the key: no sort, and the same rows each time
        shares = {r.declared: int(min(1.0, SAMPLE / r["count"]) * (1 << 20)) + 1 for r in known}
        share = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("declared"))
        sample = rows.where(F.col("declared").isin(languages)).where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share).select("declared", "text", "markup")

        @lean
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                said = b.column(0).to_pylist()
                for codes, rows_, begin, end in coded(visible(b.column(1), b.column(2))):
                    for x, s, e in zip(said[rows_], begin.tolist(), end.tolist(), strict=True):
                        part = codes[s:e]
                        np.add.at(sums.setdefault(x, np.zeros(BUCKETS, np.int64)), part[part >= 0], 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "counts"])

        for r in sample.repartition(8).mapInArrow(count, "lang string, counts binary").toLocalIterator():
            table[languages.index(r.lang), :BUCKETS] += np.frombuffer(r.counts, np.int64)
    seen = table[:, :BUCKETS]
    share = (seen.sum(0) + 0.5) / (seen.sum() + 0.5 * BUCKETS)
    table[:, :BUCKETS] = np.log((seen + 50.0 * share) / (seen.sum(1, keepdims=True) + 50.0))
    table[-1, :BUCKETS] = -math.log(BUCKETS / 8)
    return languages, table.astype(np.float32)


def language_id(rows: DataFrame) -> DataFrame:
    """key, lang, confidence, kept for rows of (key, text, markup, declared, host, domain, suffix).

    lang is the language of greatest posterior, "und" for none; kept is false for "und", for a
    posterior under LEAST and for texts without letters (null and empty ones included).  Null
    declared, suffix, host or domain are no evidence.  Repeated rows get equal results; without
    any declared language every row is "und"; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    small_batches(spark)
    languages, table = fit(rows)
    n_lang = len(languages) + 1

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, n = text_scores(visible(b.column(1), b.column(6)), table)
            # neighbouring trigrams overlap, so their evidence grows with the root of their number
            scaled = total / np.maximum(n, 1)[:, None] * np.sqrt(n)[:, None] * 3.0
            best = np.where(n > 0, total.argmax(1), n_lang - 1).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * n_lang, n_lang), pa.int32()), pa.array(scaled.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(i) for i in range(2, 6)], pa.array(n), pa.array(best), values], ["key", "declared", "host", "domain", "suffix", "n", "best", "scores"])

    key_type = rows.schema["key"].dataType.simpleString()
    scored = stored(
        rows.select("key", "text", "declared", "host", "domain", "suffix", "markup").mapInArrow(score, f"key {key_type}, declared string, host string, domain string, suffix string, n long, best int, scores array<double>"),
        "language-scores",
    )
    sure = scored.where((F.col("n") >= 5) & (F.col("best") < n_lang - 1))

    def confusion(column: str) -> dict[str, list[float]]:
        """log P(value | language) of every value; values are two-letter codes, so they are few."""
        got: dict[str, np.ndarray] = {}
        for r in sure.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v"), "best").count().collect():
            got.setdefault(r.v, np.zeros(n_lang))[r.best] = r["count"]
        total = sum(got.values(), np.zeros(n_lang))
        share = {v: (c.sum() + 1) / (total.sum() + len(got) + 1) for v, c in got.items()}
        return {v: np.log((c + 5 * share[v]) / (total + 5)) for v, c in got.items()}

    said = {c: confusion(c) for c in ("declared", "suffix")}
    everywhere = np.zeros(n_lang)
    for r in sure.groupBy("best").count().collect():
        everywhere[r.best] = r["count"]
    everywhere = (everywhere + 1) / (everywhere.sum() + n_lang)
    base = np.append(everywhere[:-1] / everywhere[:-1].sum() * (1 - UNKNOWN), UNKNOWN) if languages else np.ones(1)

    sums = [F.sum((F.col("best") == i).cast("double")).alias(f"c{i}") for i in range(n_lang)]
    hosts = sure.where(F.col("host").isNotNull()).groupBy("host").agg(F.min("domain").alias("domain"), *sums, F.count(F.lit(1)).alias("n_host"))
    domains = sure.where(F.col("domain").isNotNull()).groupBy(F.col("domain").alias("d")).agg(*[F.sum((F.col("best") == i).cast("double")).alias(f"d{i}") for i in range(n_lang)], F.count(F.lit(1)).alias("n_domain"))
    upper = [(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) + KAPPA * float(base[i])) / (F.coalesce(F.col("n_domain"), F.lit(0)) + KAPPA) for i in range(n_lang)]
    prior = F.array(*[(F.col(f"c{i}") + KAPPA * u) / (F.col("n_host") + KAPPA) for i, u in enumerate(upper)])
    priors = stored(hosts.join(domains, F.col("domain") == F.col("d"), "left").select("host", prior.alias("prior"), F.ceil(F.col("n_host") / PER_SALT).cast("int").alias("salts")), "host-priors")
    # hot hosts: their rows are dealt over copies of the prior
    hot = priors.where("salts > 1").select("host", "salts")
    salted = scored.join(hot.hint("broadcast") if hot.count() <= 10_000 else hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = priors.select("host", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "prior")
    joined = salted.join(copies, ["host", "salt"], "left")

    names = np.array([*languages, "und"])
    none = np.zeros(n_lang)

    def evidence(values: pa.Array, table: dict[str, np.ndarray]) -> np.ndarray:
        coded_ = values.dictionary_encode()
        rows_ = np.stack([table.get(v, none) for v in coded_.dictionary.to_pylist()] + [none])
        return rows_[coded_.indices.fill_null(len(rows_) - 1).to_numpy()]

    @lean
    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = b.column(1).flatten().to_numpy().reshape(b.num_rows, n_lang) + evidence(b.column(3), said["declared"]) + evidence(b.column(4), said["suffix"])
            prior_ = np.repeat(base[None], b.num_rows, 0)
            prior_[np.asarray(b.column(5).is_valid())] = np.maximum(b.column(5).flatten().to_numpy().reshape(-1, n_lang), 1e-9)
            z += np.log(prior_)
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            letters = b.column(2).to_numpy() > 0
            best = np.where(letters, p.argmax(1), n_lang - 1)
            confidence = p[np.arange(len(p)), best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(confidence), pa.array(letters & (best < n_lang - 1) & (confidence >= LEAST))], ["key", "lang", "confidence", "kept"])

    return joined.select("key", "scores", "n", "declared", "suffix", "prior").mapInArrow(fuse, f"key {key_type}, lang string, confidence double, kept boolean")


def document_rows(docs: DataFrame, key: Column) -> DataFrame:
    """Rows of evidence from documents: the two-letter code that their lang starts with is what is declared, their source the host."""
    said = F.nullif(F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2})(?:$|[^A-Za-z])", 1)), F.lit(""))
    domain = F.nullif(F.regexp_extract("source", r"([^.]+\.[^.]+)$", 1), F.lit(""))
    return docs.select(key.alias("key"), F.col("text"), F.lit(False).alias("markup"), said.alias("declared"), F.nullif(F.col("source"), F.lit("")).alias("host"), domain.alias("domain"), F.lit(None).cast("string").alias("suffix"))


def page_rows(pages: DataFrame, key: Column) -> DataFrame:
    """Rows of evidence from pages: markup, whose visible text counts, its declared language, and the address."""
    url = address_parts(F.col("url"))
    return pages.select(key.alias("key"), F.col("html").alias("text"), F.lit(True).alias("markup"), declared_language(F.col("html")).alias("declared"), *[url[c].alias(c) for c in ("host", "domain", "suffix")])


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is known; all columns pass through, whatever their names."""
    key = F.struct(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"))
    doc, th, mark = fresh(docs.columns, "_gone_doc"), fresh(docs.columns, "_gone_th"), fresh(docs.columns, "_th")
    gone = stored(language_id(document_rows(docs, key)).where("NOT kept").select(F.col("key.doc").alias(doc), F.col("key.th").alias(th)).distinct(), "rejected")
    side = F.broadcast(gone) if gone.count() <= 100_000 else gone
    return docs.withColumn(mark, F.xxhash64("text")).join(side, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(th)), "left_anti").drop(mark)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together: page_id is null for documents and doc_id for pages."""
    none = F.lit(None).cast("long")
    docs = document_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id")))
    pages = page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"), F.struct(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id")))
    return language_id(docs.unionByName(pages)).select("key.doc_id", "key.page_id", "lang", "confidence", "kept")
