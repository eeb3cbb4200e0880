"""MinHash near-dedup with tensored banding.

Two small collections of `m` bands (of three minhashes each) are computed for a document; the m * m
table keys are all pairs of a band of the first with a band of the second. That needs 6 m minhashes
where m * m independent tables of six would need 6 m * m: about a square root. At similarity s both
collections hold a matching band with probability (1 - (1 - s^3)^m)^2, for m = 11 and s = 0.8 0.9992.

Documents of equal shingle sets, told by a SHA-256 over the whole sorted set, are one class before any key is made. In each table bucket the
class that shares most buckets with others (the hub, so that a family of copies meets its original)
is paired with every other member: pairs grow with members, not with their square. All pairs are
verified on full shingle sets. Linked classes are joined into components. Documents that share a bucket
with another component then meet once more, by an exact prefix and position filter over their full
sets, and the pairs it leaves are verified too: no link between members other than the hub is lost.
Pairs within a component can't change it.

Defined cases: null texts and texts without words have empty sets and link with nothing, equal ones
included; with fewer words than a shingle has, the whole sequence is the only shingle; ties go to the
smaller doc_id; rows that share a doc_id are one document: each row links, and all
have one component; a null doc_id takes no part and
is its own component; columns besides doc_id and text don't enter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from claimlens.llm.shared import Words, bounded, discard, mix, slices, small_batches, stored, texts_of, written

BANDS = 11
BAND_ROWS = 3
SHINGLE = 5
PERCENT = 80
_SEED = 20_240_917


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, text after text, and where each text's begin."""
    words = Words(texts)
    # lower() of bytes changes A-Z alone
    hashes = words.per_word((xxhash.xxh3_64_intdigest(w.encode().lower()) for w in words.distinct), np.uint64)
    keys, at = words.windows(hashes, n)
    doc = words.doc[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(few):
        # the sequence as one shingle, told from others by its length
        whole = np.empty(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for i, d in enumerate(few):
                key = np.uint64(words.counts[d] + 1000)
                for h in hashes[words.starts[d] : words.starts[d + 1]]:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h)
                whole[i] = key
        keys, doc = np.concatenate([keys, whole]), np.concatenate([doc, few])
    with np.errstate(over="ignore"):
        salted = keys ^ mix(doc.astype(np.uint64) + np.uint64(0x51ED270B))
    first = np.sort(np.unique(salted, return_index=True)[1])
    keys, doc = keys[first], doc[first]
    if len(few):
        order = np.argsort(doc, kind="stable")
        keys, doc = keys[order], doc[order]
    return keys, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(keys: np.ndarray, starts: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a SHA-256 over each whole sorted set, and its 2 * bands band hashes; rows of empty sets are 0."""
    n = len(starts) - 1
    full = np.flatnonzero(np.diff(starts) > 0)
    ids, out = np.zeros((n, 2), np.uint64), np.zeros((n, 2 * bands), np.uint64)
    if not len(full):
        return ids, out
    begin = starts[:-1][full]
    odd = np.random.default_rng(_SEED).integers(0, 1 << 63, 2 * bands * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    for d in full:
        digest = hashlib.sha256(np.sort(keys[starts[d] : starts[d + 1]]).tobytes()).digest()
        ids[d] = np.frombuffer(digest, np.uint64, 2)
    with np.errstate(over="ignore"):
        for band in range(2 * bands):
            key = np.full(len(full), np.uint64(band + 1))
            for k in range(BAND_ROWS):
                # the multiplier permutes the low bits, the shift brings high ones down again
                value = keys * odd[band * BAND_ROWS + k]
                value ^= value >> np.uint64(32)
                value *= np.uint64(0x9FB21C651E98DF25)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, begin))
            out[full, band] = key
    return ids, out


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(starts.astype(np.int32), values.view(np.int64))


def sketch(docs: DataFrame, shingle: int, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, id_a, id_b (equal for equal sets), bands (array of 2 * bands longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, starts = shingle_sets(texts_of(part), shingle)
                ids, hashes = signatures(keys, starts, bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(starts).astype(np.int64)),
                        pa.array(ids[:, 0].copy().view(np.int64)),
                        pa.array(ids[:, 1].copy().view(np.int64)),
                        _lists(hashes.ravel(), np.arange(len(hashes) + 1) * hashes.shape[1]),
                    ],
                    ["doc_id", "n_shingles", "id_a", "id_b", "bands"],
                )

    longs = [StructField(c, LongType()) for c in ("n_shingles", "id_a", "id_b")]
    out = StructType([docs.schema["doc_id"], *longs, StructField("bands", ArrayType(LongType()))])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def full_sets(docs: DataFrame, shingle: int, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of `keep`, shingles: the whole set of every row."""
    kept = ["doc_id", *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, starts = shingle_sets(texts_of(part), shingle)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _lists(keys, starts)], [*kept, "shingles"])

    out = StructType([*(docs.schema[c] for c in kept), StructField("shingles", ArrayType(LongType()))])
    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over links (a, b), for every node of some link.

    Each round takes the least label of the neighbours and then that label's own label, so that the
    distance to the root halves. A hub has very many links and a root very many nodes, so each join has a
    written table on either side: adaptive execution can then split the partition of a hot key. A round's
    tables are removed once the next has read them.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges, edges_at = stored(both, "links")
    first = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels, labels_at = stored(first, "labels")
    while True:
        least = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("seen"))
        lowered, lowered_at = stored(
            labels.join(least, labels["node"] == least["a"]).select("node", F.least("root", "seen").alias("root"), F.col("root").alias("was")),
            "lowered",
        )
        own = lowered.select(F.col("node").alias("at"), F.col("root").alias("further"))
        jumped = lowered.join(own, F.col("root") == F.col("at"), "left").select(
            "node", F.coalesce(F.least("root", "further"), "root").alias("root"), "was"
        )
        now, now_at = stored(jumped, "labels")
        for read in (labels_at, lowered_at):
            discard(spark, read)
        labels, labels_at = now.select("node", "root"), now_at
        if now.filter("root <> was").isEmpty():
            discard(spark, edges_at)
            return labels


def near_duplicates(
    docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    # all that runs in Python is stored inside
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, shingle, percent, bands)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, bands: int) -> DataFrame:
    rows = written(sketch(docs, shingle, bands), "sketch")
    real = rows.filter(F.col("n_shingles") > 0).filter(F.col("doc_id").isNotNull())
    same = ["n_shingles", "id_a", "id_b"]
    # a class of equal sets stands for its documents; the hot group of copies is one row from here on
    classes = written(real.groupBy(*same).agg(F.min("doc_id").alias("doc"), F.any_value("bands").alias("bands")), "classes")
    tables = F.flatten(
        F.transform(
            F.slice("bands", 1, bands),
            lambda x, i: F.transform(F.slice(F.col("bands"), bands + 1, bands), lambda y, j: F.xxhash64(x, y, i * bands + j)),
        )
    )
    # a class has a key once at most, but a hot key may have very many classes: they are counted by a partial
    # aggregate, and the join of two tables can be split where a key is hot
    keyed = classes.select("doc", F.col("n_shingles").alias("n"), F.explode(F.array_distinct(tables)).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "keys")
    member = written(keyed.join(shared, "key"), "buckets")

    classed = real.select("doc_id", *same).join(classes.select(*same, "doc"), same)
    copies = classed.filter("doc_id <> doc").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    found = written(copies, "copies")
    tested = _untested(_hub_pairs(member), None, percent)
    found = found.union(_verified(tested, docs, shingle, percent))
    left = _across(member, components(found))
    if left is not None:
        rest = _untested(_prefix_pairs(left, docs, shingle, percent), tested, percent)
        found = found.union(_verified(rest, docs, shingle, percent))
    root = components(found)
    linked = rows.join(bounded(root), F.col("doc_id") == F.col("node"), "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return linked.withColumn("component_id", own).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _hub_pairs(member: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each bucket member with the bucket's hub."""
    degrees = member.groupBy("doc").agg(F.sum("members").alias("degree"))
    hub = F.max(F.struct("degree", (-F.col("doc")).alias("minus"), "n")).alias("hub")
    hubs = written(member.join(degrees, "doc").groupBy("key").agg(hub).select("key", "hub.minus", F.col("hub.n").alias("n_b")), "hubs")
    hubbed = member.join(hubs, "key")
    return hubbed.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), (-F.col("minus")).alias("b"), "n_b").filter("a <> b")


def _prefix_pairs(open_docs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, n_a, b, n_b): pairs in different components, of (doc, root), that can still be similar.

    Shingles are put in the order of how many of these documents have them. Two sets as similar as asked
    share one of the first n - ceil(p n) + 1 of each, and behind the first that they share, both have
    enough left for the whole overlap. A document with many shingles of its own spends its prefix on
    them, so a large family of copies doesn't meet all its odd members.
    """
    part = f"{percent} / 100D"
    ids = open_docs.select(F.col("doc").alias("doc_id"), "root")
    texts = docs.select("doc_id", "text").join(bounded(ids), "doc_id")
    sets = full_sets(texts, shingle, ["root"]).withColumn("n", F.size("shingles")).withColumn("set_id", F.xxhash64("shingles"))
    tokens = written(sets.select("doc_id", "root", "set_id", "n", F.explode("shingles").alias("s")), "tokens")
    often = tokens.groupBy("s").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
    often = written(often, "often")
    order = Window.partitionBy("doc_id", "set_id").orderBy("df", "s")
    ranked = tokens.join(often, "s").withColumn("place", F.row_number().over(order) - 1)
    first = ranked.filter(f"place <= n - ceil({part} * n) and low < high")
    first = written(first.select("s", F.col("doc_id").alias("doc"), "root", "n", (F.col("n") - F.col("place")).alias("rest")), "prefixes")
    needed = F.expr(f"ceil({part} / (1 + {part}) * (x.n + y.n) - 1e-9)")
    similar = (
        (F.col("x.s") == F.col("y.s"))
        & (F.col("x.root") < F.col("y.root"))
        & (F.least("x.rest", "y.rest") >= needed)
    )
    one = [F.col("x.doc").alias("a"), F.col("x.n").alias("n_a")]
    return first.alias("x").join(first.alias("y"), similar).select(*one, F.col("y.doc").alias("b"), F.col("y.n").alias("n_b"))


def _untested(pairs: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """Distinct (a, b), the smaller id first, that are new and that sizes alone don't rule out."""
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    new = pairs.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return written(new if tested is None else new.join(tested, ["a", "b"], "left_anti"), "pairs")


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    members = docs.select("doc_id", "text").join(bounded(ids), "doc_id", "left_semi")
    sets = written(full_sets(members, shingle), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    whole = F.size("of_a") + F.size("of_b") - common
    close = pairs.join(left, "a").join(right, "b").filter(100 * common >= percent * whole)
    return written(close.select("a", "b"), "links")


def _across(member: DataFrame, roots: DataFrame) -> DataFrame | None:
    """doc, root of the documents in buckets that hold several components; None if there are none.

    Of a bucket of two the only pair has been tested.
    """
    rooted = member.drop("members").join(roots, F.col("doc") == F.col("node"), "left")
    rooted = written(rooted.withColumn("root", F.coalesce("root", "doc")).drop("node"), "rooted")
    bucket = rooted.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = written(bucket.filter("low < high and members > 2").select("key"), "open-keys")
    left = written(rooted.join(mixed, "key").select("doc", "root").distinct(), "open")
    return None if left.isEmpty() else left


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """All columns of the rows of `docs` that near_duplicates keeps: of each component the document with
    the smallest doc_id."""
    gone = near_duplicates(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    gone = written(gone, "gone")
    return docs.alias("d").join(bounded(gone).alias("g"), F.col("d.doc_id") == F.col("g.gone_id"), "left_anti")
