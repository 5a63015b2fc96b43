"""N-gram Jaccard join by grouped prefixes.

Shingles are ordered rarest first by counts in a fixed number of hash buckets.  Two sets that
reach the threshold share a shingle among the first few of each (their prefixes), so only
prefixes are indexed.  Documents with equal sets are one node; nodes with equal size and prefix
are one group, of which one row is indexed.  Lists of groups by shingle give group pairs,
filtered by size and position; they are expanded to nodes and verified on the texts.

Only connectivity is asked for, so a long list isn't paired with itself: its groups are paired
with anchors first, components are found, and only nodes that are still in different components
are then paired, in blocks.  No list is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HEAVY_TRACKED, lean, small_batches, stored
from .graph import components
from .texts import FACTORS, flat, mixed, shingle_sets, words

WORDS, PERCENT = 5, 80
#: Hash buckets of the shingle counts, and rows that they travel in.
BUCKETS, CHUNKS = 1 << 20, 64
#: Groups in a list up to which all its pairs are made at once.
SHORT = 4
#: A shingle seen so often (or FACTOR times the mean bucket, which is FACTOR / BUCKETS of all
#: shingles) has its list dealt over many tasks; a task holds LONG elements of a list at most.
LONG, FACTOR = 20_000, 8
#: Places of a prefix that one task puts in order.
STRETCH = 128
#: Elements of one block when a list is paired with itself.
BLOCK = 500
#: Ids that are broadcast to pick texts at most; more are joined by a shuffle.
PICKED = 400_000


def least_overlap(x: np.ndarray | int, y: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Common elements that sets of x and y elements need."""
    return -(-(percent * (x + y)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def shingle_counts(texts: DataFrame, n_words: int) -> np.ndarray:
    """How often shingles of each hash bucket occur, from all texts; BUCKETS numbers."""
    size = BUCKETS // CHUNKS

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            word, _ = words(*flat(b.column(0)))
            sums = np.zeros(max(0, len(word) - n_words + 1), np.uint64)
            for k in range(n_words):
                sums += word[k : k + len(sums)] * FACTORS[k]
            total += np.bincount((mixed(sums) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        for c in range(CHUNKS):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total[c * size : (c + 1) * size].astype("<i4").tobytes()], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(x, "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype("<i4").tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    kind = "chunk int, counts binary"
    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(count, kind).repartition(CHUNKS, "chunk").mapInArrow(add, kind).collect():  # CHUNKS rows
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.counts, "<i4")
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that equal sets share."""
    return int(s.sum().astype(np.int64)), int(mixed(s ^ FACTORS[13]).sum().astype(np.int64))


def prefix_table(docs: DataFrame, counts: np.ndarray, n_words: int, percent: int, hot: int) -> DataFrame:
    """Stored, for each row: rid, doc, n, sig1, sig2, gid, and the prefix where the task's first row of a group has it.

    places is each prefix shingle's rank, negative (minus one) for those with counts over hot.
    """
    order = np.minimum(counts, (1 << 31) - 1).astype(np.uint32)

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, seen = TaskContext.get().partitionId() << 32, set()
        for b in batches:
            n, one, two, group, prefixes, places = [], [], [], [], [], []
            for s in shingle_sets(b.column(1), n_words):
                n.append(len(s))
                a, c = signature(s) if len(s) else (0, 0)
                one.append(a)
                two.append(c)
                g, prefix, place = 0, None, None
                if len(s):
                    freq = order[(s >> np.uint64(44)).astype(np.int64)]
                    pick = np.argsort(freq, kind="stable")[: prefix_length(len(s), percent)]  # ties by hash
                    first = s[pick]
                    g = int(mixed(np.append(first, np.uint64(len(s)))).sum().astype(np.int64))
                    if g not in seen:
                        seen.add(g)
                        place = np.arange(len(first), dtype=np.int32)
                        place[freq[pick] > hot] = -1 - place[freq[pick] > hot]
                        prefix = first.astype(np.int64)
                group.append(g)
                prefixes.append(prefix)
                places.append(place)
            ids = np.arange(rid, rid + len(n))
            rid += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), b.column(0), *(pa.array(x, pa.int64()) for x in (n, one, two, group)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                ["rid", "doc", "n", "sig1", "sig2", "gid", "prefix", "places"],
            )

    kind = docs.schema["doc"].dataType.simpleString()
    return stored(docs.mapInArrow(rows, f"rid long, doc {kind}, n long, sig1 long, sig2 long, gid long, prefix array<long>, places array<int>"), "prefixes")


def possible(nx: np.ndarray, px: np.ndarray, ny: np.ndarray, py: np.ndarray, percent: int) -> np.ndarray:
    """Size and position filters for elements x and y of one list.

    A pair need only pass in the list of its first common shingle, before which it has none.
    """
    small, large = np.minimum(nx, ny), np.maximum(nx, ny)
    return (100 * small >= percent * large) & (1 + np.minimum(nx - px - 1, ny - py - 1) >= least_overlap(nx, ny, percent))


def listed_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Stored rows of two kinds from lists by token: pairs (token null) and the elements of long lists.

    Pairs are (a, b) of groups' representatives, multi where a group has several members.  A list
    over SHORT is paired with anchors, one in each stretch of sizes that reach the first of it;
    one over LONG passes through with star set and no anchor, which it gets by size class later,
    so no task holds more than LONG elements, however long its lists.
    """
    names = ["token", "a", "b", "n", "pos", "multi", "star"]

    @lean
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(a: np.ndarray, b: np.ndarray, multi: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, pa.array(multi), pa.array(np.zeros(len(a), bool))], names)

        def listed(t: np.ndarray, r: np.ndarray, n: np.ndarray, p: np.ndarray, m: np.ndarray, star: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(t), pa.nulls(len(t), pa.int64()), pa.array(r), pa.array(n), pa.array(p), pa.array(m > 0), pa.array(np.full(len(t), star))], names)

        def work(t: np.ndarray, r: np.ndarray, n: np.ndarray, p: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            begin = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            size = np.diff(np.append(begin, len(t)))
            each = np.repeat(size, size)
            keep = (each > 1) & (each <= SHORT)
            if keep.any():
                tt, rr, nn, pp, mm = t[keep], r[keep], n[keep], p[keep], m[keep]
                for d in range(1, SHORT):
                    i = np.flatnonzero(tt[d:] == tt[:-d])
                    i = i[possible(nn[i], pp[i], nn[i + d], pp[i + d], percent)]
                    if len(i):
                        yield made(rr[i], rr[i + d], mm[i] + mm[i + d] > 0)
            for s, k in zip(begin[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
                nn, rr, pp, mm = n[s : s + k], r[s : s + k], p[s : s + k], m[s : s + k]
                yield listed(t[s : s + k], rr, nn, pp, mm, False)
                at = 0
                while at < k:
                    end = int(np.searchsorted(nn, nn[at] * 100 // percent, "right"))
                    # the fewest shingles before the list's own: likeliest what the others were made from
                    anchor = at + int(pp[at:end].argmin())
                    j = np.flatnonzero(possible(nn[anchor], pp[anchor], nn, pp, percent))
                    j = j[j != anchor]
                    if len(j):
                        yield made(np.full(len(j), rr[anchor]), rr[j], mm[j] + mm[anchor] > 0)
                    at = end

        held = [np.zeros(0, np.int64)] * 5
        passing: int | None = None  # the token of a list over LONG that is under way
        for b in batches:
            columns = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            if passing is not None:
                cut = int(np.searchsorted(columns[0], passing, "right"))
                if cut:
                    yield listed(*(x[:cut] for x in columns), True)
                columns = [x[cut:] for x in columns]
                if not len(columns[0]):
                    continue
                passing = None
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left")) if len(columns[0]) else 0
            if cut:
                yield from work(*(x[:cut] for x in columns))
            held = [x[cut:] for x in columns]
            if len(held[0]) > LONG:
                passing = int(held[0][0])
                yield listed(*held, True)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from work(*held)

    ordered = postings.repartition("token").sortWithinPartitions("token", "n", "rep").select("token", "rep", "n", "pos", F.col("multi").cast("long"))
    return stored(ordered.mapInArrow(pairs, "token long, a long, b long, n long, pos long, multi boolean, star boolean"), "pairs")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Stored pairs (a, b) of nodes that reach the threshold, by their texts' sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    wanted = stored(ends.select("node", F.col("first_doc").alias("w_doc"), "sig1", "sig2"), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= PICKED else wanted
    texts = docs.join(side, F.col("doc").eqNullSafe(F.col("w_doc"))).select("node", "sig1", "sig2", "text")

    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column(0).to_numpy(), b.column(4).to_numpy()
            left, right = b.column(3), b.column(7)
            # rows of one left text follow one another; an id that repeats may bring several texts
            turn = np.ones(len(a), bool)
            if len(a) > 1:
                turn[1:] = (a[1:] != a[:-1]) | np.asarray(pc.not_equal(left[1:], left[:-1]))
            first = shingle_sets(left.take(pa.array(np.flatnonzero(turn))), n_words)
            which = np.cumsum(turn) - 1
            ok = np.zeros(len(a), bool)
            signed: dict[int, bool] = {}
            sig = [x.to_numpy() for x in (b.column(1), b.column(2), b.column(5), b.column(6))]
            for i, y in enumerate(shingle_sets(right, n_words)):
                w = int(which[i])
                x = first[w]
                # a text of another row with the same id isn't the node's
                if w not in signed:
                    signed[w] = signature(x) == (sig[0][i], sig[1][i])
                if signed[w] and signature(y) == (sig[2][i], sig[3][i]):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("sig1").alias("a1"), F.col("sig2").alias("a2"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("sig1").alias("b1"), F.col("sig2").alias("b2"), F.col("text").alias("b_text"))
    both = pairs.join(right, "b").join(left, "a").select("a", "a1", "a2", "a_text", "b", "b1", "b2", "b_text")
    return stored(both.mapInArrow(check, "a long, b long").distinct(), "links")


def cross_pairs(elements: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one list that are in different components and pass the filters, in blocks."""
    named = elements.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named.select("token", "node", "n", "pos", "prev", "label").distinct(), "elements")
    lists = named.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    open_lists = stored(named.join(lists, "token"), "open-lists")
    x = open_lists.select("token", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("prev").alias("va"), F.col("label").alias("la"))
    y = open_lists.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("prev").alias("vb"), F.col("label").alias("lb"))
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("la") != F.col("lb")) & (F.col("a") < F.col("b"))
    near &= (1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    near &= F.col("va").isNull() | F.col("vb").isNull() | (F.col("va") != F.col("vb"))
    return x.join(y, ["token", "block"]).where(near).select("a", "b").distinct()


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable by links).

    Words are runs of bytes other than blanks and control white space, A-Z in lower case; a set is
    the distinct n_words-word shingles, or the whole sequence of a shorter text.  Null, empty and
    blank texts have empty sets and no links.  Rows that repeat an id are separate documents; a
    null id never is a component's id unless all of its are null.  Shingles are compared by 64-bit
    fingerprints.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    base = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = shingle_counts(base.select("text"), n_words)
    hot = max(LONG, FACTOR * int(counts.mean()))
    table = prefix_table(base, counts, n_words, percent, hot)
    del counts

    nodes = stored(table.where("n > 0").groupBy("sig1", "sig2", "n", "gid").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = nodes.groupBy("gid").agg(F.min("node").alias("rep"), (F.count(F.lit(1)) > 1).alias("multi"))
    # every task wrote its first row of a group; one of them is indexed, under the group's representative
    once = table.where("prefix IS NOT NULL").groupBy("gid").agg(F.min_by(F.struct("n", "prefix", "places"), "rid").alias("x"))
    postings = stored(
        once.join(groups, "gid").select("rep", "multi", F.col("x.n").cast("int").alias("n"), F.explode(F.arrays_zip("x.prefix", "x.places")).alias("y")).select(F.col("y.prefix").alias("token"), "rep", "multi", "n", F.col("y.places").alias("pos")),
        "postings",
    )
    found = listed_pairs(postings.where("pos >= 0"), percent)

    # group pairs, expanded to nodes: representatives now, all members in the second phase
    group_pairs = found.where("token IS NULL").select("a", "b").distinct()
    members = stored(nodes.join(groups.where("multi"), "gid").select("rep", "node", F.col("n").alias("size")), "members")
    within = members.select(F.col("rep").alias("a"), F.col("node").alias("b"))

    # lists that anchors stand for: long ones, hot shingles, and groups of several nodes
    long = found.where("token IS NOT NULL").select("token", F.col("b").alias("rep"), "n", "pos", "multi", "star")
    long = long.unionByName(postings.where("pos < 0").select("token", "rep", F.col("n").cast("long").alias("n"), (-1 - F.col("pos")).cast("long").alias("pos"), "multi", F.lit(True).alias("star")))
    # the long list before this one in the row's prefix: rows that share it have met there already;
    # by stretches of places, so that a long prefix isn't one task's
    stretch = Window.partitionBy("rep", F.floor(F.col("pos") / STRETCH)).orderBy("pos")
    long = long.withColumn("prev", F.lag("token").over(stretch))
    # a pair with a group of several nodes is a list of its own, named by the pair
    none = F.lit(None).cast("long")
    wide = found.where("token IS NULL AND multi").select("a", "b").distinct().select(F.xxhash64("a", "b").alias("token"), F.explode(F.array("a", "b")).alias("rep"), F.lit(0).cast("long").alias("pos"), none.alias("prev"), F.lit(False).alias("star"))
    sizes = nodes.select(F.col("node").alias("rep"), F.col("n").cast("long").alias("n"))
    wide = wide.join(sizes, "rep").select("token", "rep", "n", "pos", "prev", "star")
    listed = long.select("token", "rep", "n", "pos", "prev", "star").unionByName(wide)
    # members of one group have one size
    others = listed.join(members.where("rep <> node").select("rep", "node"), "rep").select("token", "node", "n", "pos", "prev", "star")
    elements = listed.select("token", F.col("rep").alias("node"), "n", "pos", "prev", "star").unionByName(others)
    elements = elements.unionByName(members.select(F.xxhash64("rep").alias("token"), "node", F.col("size").alias("n"), F.lit(0).cast("long").alias("pos"), none.alias("prev"), F.lit(False).alias("star")))
    elements = stored(elements.distinct(), "long-lists")
    # anchors of lists that passed through: one by size class
    anchors = elements.where("star").withColumn("class", F.floor(F.log("n") / float(np.log(100 / percent))))
    starred = anchors.join(anchors.groupBy("token", "class").agg(F.min_by("node", F.struct("pos", "node")).alias("a")), ["token", "class"]).select("a", F.col("node").alias("b"))

    first = stored(group_pairs.unionByName(within).unionByName(starred).where("a <> b").distinct(), "node-pairs")
    links = verified(first, nodes, base, n_words, percent)
    labels = components(links)
    second = stored(cross_pairs(elements, labels, percent).join(first, ["a", "b"], "left_anti"), "node-pairs")
    if not second.isEmpty():
        links = stored(links.unionByName(verified(second, nodes, base, n_words, percent)), "links")
        labels = components(links)

    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    classes = stored(named.join(least, "label").select("sig1", "sig2", "n", "copies", "component_id"), "classes")
    return with_classes(table, classes, id_col)


def with_classes(table: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """Each row with its node's class; nodes of very many rows are broadcast, at most HEAVY_TRACKED."""
    rows = table.select("doc", "n", "sig1", "sig2")
    floor = max(1, table.count() // HEAVY_TRACKED)
    key = ["sig1", "sig2", "n"]
    hot, cold = classes.where(F.col("copies") > floor).drop("copies"), classes.where(F.col("copies") <= floor).drop("copies")
    full = rows.where("n > 0")
    out = [("doc", id_col), ("n", "n_shingles"), ("component_id", "component_id")]
    pick: list[Column] = [F.col(a).alias(b) for a, b in out]
    some = full.join(F.broadcast(hot), key).select(*pick)
    rest = full.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key).select(*pick)
    none = rows.where("n = 0").withColumn("component_id", F.col("doc")).select(*pick)
    return some.unionByName(rest).unionByName(none)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.z)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(z) AS c FROM r GROUP BY 1) c USING (doc_id)
"""
