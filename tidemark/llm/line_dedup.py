"""Line dedup by content-defined chunks of lines, with DataFrame and SQL functions only.

A cyclic-polynomial rolling hash over the hashes of the last two lines decides where a chunk
ends, so boundaries depend on nearby lines alone and survive shifts.  Chunks of two lines or
more that occur anywhere else are candidates; the first occurrence, by (id, text hash, chunk),
stays and later ones go.  As in exact dedup, bytes are equal when their SHA-256 is.

Chunks need a boundary on both sides, so passages of a few lines are mostly lost between them.
With passages=True (the query and the pipeline) every window of min_lines non-blank lines is a
candidate, and every line of LONG_LINE bytes: whatever stands elsewhere is a union of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, resolve_groups, stored

#: A line pair ends a chunk with chance 1 in DIVISOR.
DIVISOR = 2
#: Non-blank lines that a chunk needs to be removable.
MIN_LINES = 2
#: Bytes from which a line is a window by itself.
LONG_LINE = 256
#: Numbers (lines that go, and eight a text) that are broadcast at most; more are joined by a shuffle.
BROADCAST = 4_000_000


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _chunked(docs: DataFrame, text: str, keep: list[str], divisor: int) -> DataFrame:
    """keep, _lines and _starts (first line of each chunk, and the line count at the end).

    explode(array(x)) evaluates x once; plain projections could be inlined into the lambdas.
    """
    return (
        docs.withColumn("_lines", F.explode(F.array(_lines(text))))
        .withColumn("_h", F.explode(F.array(F.transform("_lines", lambda x: F.xxhash64(x)))))
        .withColumn("_n", F.size("_lines"))
        .withColumn(
            "_rolled",
            F.explode(
                F.array(
                    F.zip_with(
                        F.expr("slice(_h, 1, greatest(_n - 2, 0))"),
                        F.expr("slice(_h, 2, greatest(_n - 2, 0))"),
                        lambda a, b: F.shiftleft(a, 1).bitwiseXOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b),
                    )
                )
            ),
        )
        .withColumn(
            "_starts",
            F.explode(
                F.array(
                    F.concat(
                        F.array(F.lit(0)),
                        F.array_compact(F.transform("_rolled", lambda r, i: F.when(F.pmod(r.bitwiseXOR(F.shiftrightunsigned(r, 29)), F.lit(divisor)) == 0, i + 2))),
                        F.array(F.col("_n")),
                    )
                )
            ),
        )
        .select(*keep, "_lines", "_h", "_starts")
    )


#: _spans with the digest of each one's bytes.
DIGESTED = "transform(_spans, s -> named_struct('first', s.first, 'length', s.length, 'digest', unhex(sha2(cast(array_join(slice(_lines, s.first + 1, s.length), '\\n') AS binary), 256))))"


def _chunk_spans(docs: DataFrame, text: str, keep: list[str], divisor: int, min_lines: int) -> DataFrame:
    """keep and _spans: first line, length and digest of the bytes of each chunk that may go."""
    solid = "size(filter(slice(_lines, s.first + 1, s.length), x -> length(trim(x)) > 0))"
    return (
        _chunked(docs, text, keep, divisor)
        .withColumn("_spans", F.expr("transform(sequence(0, size(_starts) - 2), c -> named_struct('first', _starts[c], 'length', _starts[c + 1] - _starts[c]))"))
        .withColumn("_spans", F.expr(f"filter(_spans, s -> s.length >= {min_lines} AND {solid} >= {min_lines})"))
        .select(*keep, F.expr(DIGESTED).alias("_spans"))
    )


def _window_spans(docs: DataFrame, text: str, keep: list[str], min_lines: int) -> DataFrame:
    """As _chunk_spans, of every window of min_lines non-blank lines, blank ones between included, and every long line."""
    return (
        docs.withColumn("_lines", F.explode(F.array(_lines(text))))
        .withColumn("_solid", F.explode(F.array(F.expr("filter(sequence(0, size(_lines) - 1), i -> length(trim(_lines[i])) > 0)"))))
        .withColumn(
            "_spans",
            F.expr(
                f"""concat(
                    if(size(_solid) < {min_lines}, array(), transform(sequence(0, greatest(size(_solid) - {min_lines}, 0)),
                        k -> named_struct('first', _solid[k], 'length', _solid[k + {min_lines} - 1] - _solid[k] + 1))),
                    transform(filter(_solid, i -> octet_length(_lines[i]) >= {LONG_LINE}), i -> named_struct('first', i, 'length', 1)))"""
            ),
        )
        .select(*keep, F.expr(DIGESTED).alias("_spans"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, min_lines: int = MIN_LINES, passages: bool = False) -> DataFrame:
    """All columns of docs with repeated chunks taken out of the text, plus n_lines, n_removed (lines).

    A null text stays null with no lines removed; an empty text stays empty; texts under two lines
    never change.  Rows repeated with the same id and text are treated alike and don't count as
    repeats of each other.  Of equal chunks the one with the smallest (id, hash of the text,
    place) stays.  Blank lines don't count towards min_lines.  Other columns pass through.

    With passages, all lines of a window go that stood before, but for one that overlaps its first
    occurrence.  Every line that goes still stands at its first place; a first occurrence may lose
    lines that it shares with an earlier window.
    """
    names = docs.columns
    doc, text, th = "_doc", "_text", "_th"
    out_lines, out_removed = fresh(names, "n_lines"), fresh(names, "n_removed")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").alias(doc), F.col(f"`{text_col}`").alias(text)).withColumn(th, F.xxhash64(text))

    rows = base.select(doc, th, text)
    spans = _window_spans(rows, text, [doc, th], min_lines) if passages else _chunk_spans(rows, text, [doc, th], divisor, min_lines)
    # one row per chunk or window
    chunks = spans.select(doc, th, F.explode("_spans").alias("s")).select("s.digest", F.struct(F.col(doc).alias("doc"), F.col(th).alias("th"), "s.first", "s.length").alias("pos"))
    settled = resolve_groups(stored(chunks, "chunks"), "digest", "pos", largest=False)
    apart = F.expr("NOT (pos.doc <=> winner.doc AND pos.th = winner.th AND pos.first < winner.first + winner.length)")
    gone = F.expr("array_sort(array_distinct(flatten(collect_set(sequence(pos.first, pos.first + pos.length - 1)))))")
    drops = stored(settled.where((F.col("pos") > F.col("winner")) & apart).groupBy(F.col("pos.doc").alias("d_doc"), F.col("pos.th").alias("d_th")).agg(gone.alias("_drops")), "drops")
    weight = drops.agg(F.sum(F.size("_drops") + 8)).first()[0] or 0

    side = F.broadcast(drops) if weight <= BROADCAST else drops
    joined = base.join(side, F.col(doc).eqNullSafe(F.col("d_doc")) & (F.col(th) == F.col("d_th")), "left")
    cut = F.col("_drops").isNotNull() & F.coalesce(F.contains(F.col(text), F.lit("\n")), F.lit(False))
    untouched = joined.where(~cut).select("_row", F.col(text).alias("_new"), F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text))).alias("_total"), F.lit(0).alias("_gone"))
    changed = (
        joined.where(cut)
        .withColumn("_lines", F.explode(F.array(_lines(text))))
        # lines that go, between the places before the first line and after the last
        .withColumn("_bounds", F.explode(F.array(F.expr("concat(array(-1), _drops, array(size(_lines)))"))))
        .withColumn("_left", F.explode(F.array(F.expr("flatten(transform(sequence(0, size(_bounds) - 2), k -> slice(_lines, _bounds[k] + 2, _bounds[k + 1] - _bounds[k] - 1)))"))))
        .select("_row", F.array_join("_left", "\n").alias("_new"), F.size("_lines").alias("_total"), (F.size("_lines") - F.size("_left")).alias("_gone"))
    )
    whole = untouched.unionByName(changed)
    return whole.select(*[(F.col("_new") if c == text_col else F.col("_row")[c]).alias(c) for c in names], F.col("_total").alias(out_lines), F.col("_gone").alias(out_removed))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), passages=True).select("doc_id", "text", "n_lines", "n_removed")


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, a, list_filter(range(1, len(a) + 1), lambda i: length(trim(a[i], ' ')) > 0) AS solid FROM l),
sp AS (
  SELECT doc_id, a, unnest(list_concat(
    list_transform(range(1, len(solid)), lambda k: {'first': solid[k], 'last': solid[k + 1]}),
    list_transform(list_filter(solid, lambda i: strlen(a[i]) >= 256), lambda i: {'first': i, 'last': i}))) AS s FROM x),
g AS (SELECT doc_id, s.first AS f, s.last AS t, array_to_string(a[s.first:s.last], chr(10)) AS g FROM sp),
h AS (SELECT *, first_value(doc_id) OVER o AS wd, first_value(f) OVER o AS wf, first_value(t) OVER o AS wt FROM g WINDOW o AS (PARTITION BY g ORDER BY doc_id, f, t)),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(f, t + 1)))) AS gone FROM h WHERE (doc_id, f, t) > (wd, wf, wt) AND NOT (doc_id = wd AND f <= wt) GROUP BY 1)
SELECT d.doc_id, CASE WHEN gone IS NULL OR NOT contains(d.text, chr(10)) THEN d.text ELSE array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: NOT list_contains(gone, i)), lambda i: a[i]), chr(10)) END AS text,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(a) END AS INTEGER) AS n_lines, CAST(CASE WHEN gone IS NULL OR NOT contains(d.text, chr(10)) THEN 0 ELSE len(gone) END AS INTEGER) AS n_removed
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
