"""Benchmark decontamination: SimHash of item-sized windows, looked up by Hamming blocks.

Every start of an item-sized window counts, also those between the places at which words of an item
line up, as an insertion makes them. A window that can reach the similarity holds 5-grams of the item
that weigh at least that share of the item, so starts are found by a running sum over the places of
shared 5-grams: where it stays below the bound, no window can match and none is fingerprinted. All
others get a 64-bit SimHash over their weighted 5-grams, as the items do. The items'
fingerprints are indexed by 8 blocks of 8 bits, each with all values within one bit: by the pigeonhole
principle every fingerprint within 15 bits agrees with some indexed block, so none is missed. No radius
is exact for a similarity, since edited passages near 0.8 lie up to 20 bits off and more; so pairs are also
found by an exact prefix filter: a pair at the threshold shares some of the item's heaviest 5-grams, taken
until they weigh more than the item can lack. Either way pairs are held to exact weighted similarity: sum
of lesser weights over sum of greater weights, a 5-gram weighing its count times ln(1 + items / items that
have it).

Words are lower-cased. Defined cases: null and empty texts match nothing; a text shorter than an item
is one window; items of fewer than five
words are ordinary phrases and match nothing; equal items each match; rows of the benchmark are told
apart by item_id and text, a null item_id being one like any other, and equal rows count once; repeated
rows of documents count once for each doc_id and window, rows that share a doc_id are one document;
an empty benchmark matches nothing; columns besides doc_id, item_id and text don't enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.shared import WORD, bounded, written

N = 5
RADIUS = 15
SIMILARITY = 0.8
#: Distinct item 5-grams up to which they are kept as a constant of the plan; beyond, they are joined.
INLINE_GRAMS = 20_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def _gram(words: Column, i: Column) -> Column:
    """The hash of the words i to i + 4 (from 0)."""
    return F.xxhash64(*[F.get(words, i + k) for k in range(N)])


def _with(value: Column, use) -> Column:
    """use(value), an array, with `value` computed once: bound to a lambda variable, the optimizer can't
    repeat its expression for every element."""
    return F.flatten(F.transform(F.array(value), use))


def _starts(words: Column) -> Column:
    last = F.size(words) - N
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column) -> Column:
    return F.transform(_starts(words), lambda i: _gram(words, i))


def item_grams(benchmark: DataFrame) -> DataFrame:
    """item, item_id, item_words, at, gram: every 5-gram of every item.

    `item` is a key that is never null, a hash of id and text; rows that agree in both count once.
    """
    told = F.col("item_id").cast("string")
    name = F.coalesce(F.concat(F.length(told).cast("string"), F.lit(":"), told), F.lit("-"))
    keyed = benchmark.select(F.md5(F.concat(name, F.lit(":"), F.coalesce("text", F.lit("")))).alias("item"), "item_id", "text")
    words = words_of(F.col("text"))
    return keyed.dropDuplicates(["item"]).select(
        "item", "item_id", F.size(words).alias("item_words"), F.posexplode(_with(words, _grams)).alias("at", "gram")
    )


def _hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """row, doc_id, words, hits (array of places and 5-grams): the rows with some item's 5-gram, numbered."""
    known = grams.select("gram").distinct()
    some = known.limit(INLINE_GRAMS + 1).collect()
    words = words_of(F.col("text"))
    place = lambda w, i: F.struct(i.alias("at"), _gram(w, i).alias("gram"))
    if len(some) <= INLINE_GRAMS:
        values = [r["gram"] for r in some] or [0]
        found = _with(words, lambda w: F.transform(F.filter(_starts(w), lambda i: _gram(w, i).isin(values)), lambda i: place(w, i)))
        hit = docs.select("doc_id", "text", found.alias("hits")).filter(F.size("hits") > 0)
        hit = hit.select("doc_id", words.alias("words"), "hits")
    else:
        # a large benchmark: the grams meet in a shuffled join, and only documents with a hit are read again
        key = ["doc_id", F.xxhash64("text").alias("doc_hash")]
        spread = docs.select(*key, F.posexplode(_with(words, _grams)).alias("at", "gram"))
        at = F.collect_set(F.struct("at", "gram")).alias("hits")
        places = written(spread.join(known, "gram").groupBy("doc_id", "doc_hash").agg(at), "places")
        same = [F.col("k.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("k.doc_hash") == F.col("f.doc_hash")]
        both = docs.select(*key, "text").alias("k").join(bounded(places).alias("f"), same)
        hit = both.select("k.doc_id", words_of(F.col("k.text")).alias("words"), "f.hits")
    return written(hit.withColumn("row", F.monotonically_increasing_id()), "hits")


def _windows(hits: DataFrame, item_weights: DataFrame, similarity: float) -> DataFrame:
    """row, n_words, start of every window of an item's length whose 5-grams of that item weigh enough.

    The lesser weights of a window and an item are at most what the window's places with a 5-gram of the
    item weigh, and the greater ones at least what the item weighs. That weight changes only where a place
    enters or leaves the window, so it is a running sum over two events a place.
    """
    whole = item_weights.groupBy("item").agg(F.sum("weight").alias("whole"))
    wanted = item_weights.select("item", "item_words", "gram", "idf").join(whole, "item")
    places = hits.select("row", F.size("words").alias("doc_words"), F.explode("hits").alias("h"))
    marks = places.select("row", "doc_words", "h.at", "h.gram").join(bounded(wanted), "gram")
    enters = F.struct(F.greatest(F.lit(0), F.col("at") - (F.col("item_words") - N)).alias("start"), F.col("idf").alias("change"))
    leaves = F.struct((F.col("at") + 1).alias("start"), (-F.col("idf")).alias("change"))
    key = ["row", "item", "item_words", "doc_words", "whole"]
    events = marks.select(*key, F.explode(F.array(enters, leaves)).alias("e")).groupBy(*key, "e.start").agg(F.sum("e.change").alias("change"))
    along = Window.partitionBy("row", "item").orderBy("start")
    last = F.least(F.lead("start").over(along) - 1, F.greatest(F.lit(0), F.col("doc_words") - F.col("item_words")))
    level = F.sum("change").over(along.rowsBetween(Window.unboundedPreceding, 0))
    spans = events.withColumn("last", last).withColumn("level", level)
    # the margin is far above what rounding to 9 digits and the running sum give away
    able = spans.filter(F.col("level") >= (similarity - 1e-6) * F.col("whole")).filter("start <= last")
    return able.select("row", F.col("item_words").alias("n_words"), F.explode(F.sequence("start", "last")).alias("start")).distinct()


def _fingerprints(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """`simhash` of each group of (gram, weight): bit b is set if the weights of grams with bit b set
    outweigh the others."""
    votes = [
        F.sum(F.when(F.shiftrightunsigned("gram", b).bitwiseAND(1) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"v{b}")
        for b in range(64)
    ]
    voted = weighted.groupBy(*keys).agg(*votes)
    # bit 63 is the sign; shifting a long wraps round as it should
    bits = [F.when(F.col(f"v{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    whole = bits[0]
    for bit in bits[1:]:
        whole = whole.bitwiseOR(bit)
    return voted.select(*keys, whole.alias("simhash"))


def _blocks(simhash: Column, near: bool) -> Column:
    """(block, value) of the 8 bytes; with `near` also every value one bit off."""
    flips = [0, *(1 << i for i in range(8))] if near else [0]
    byte = [F.shiftrightunsigned(simhash, 8 * b).bitwiseAND(255).cast("int") for b in range(8)]
    return F.array(*[
        F.struct(F.lit(b).alias("block"), byte[b].bitwiseXOR(F.lit(f)).alias("value")) for b in range(8) for f in flips
    ])


def _prefixes(item_weights: DataFrame, similarity: float) -> DataFrame:
    """item, item_words, gram: each item's heaviest grams, just more than 1 - similarity of its weight.

    The sum of greater weights is the item's weight at least, so a window without any of these grams is
    below the similarity; the margin is far above what rounding to 9 digits gives away.
    """
    heaviest = Window.partitionBy("item", "item_words").orderBy(F.col("df"), F.col("weight").desc(), "gram")
    before = F.coalesce(F.sum("weight").over(heaviest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum("weight").over(Window.partitionBy("item", "item_words"))
    kept = item_weights.withColumn("before", before).withColumn("whole", whole)
    return kept.filter(F.col("before") <= (1 - similarity + 1e-6) * F.col("whole")).select("item", "item_words", "gram")


def contaminated_windows(
    docs: DataFrame, benchmark: DataFrame, *, radius: int = RADIUS, similarity: float = SIMILARITY
) -> DataFrame:
    """doc_id, item_id, start (first word of the window, from 0), n_words, hamming, similarity: for
    each document and item the most similar window, the first of equals. `radius` is that of the index
    and doesn't bound `hamming`."""
    if radius > 15:
        raise ValueError("eight blocks within one bit each guarantee a radius of 15 at most")
    grams = written(item_grams(benchmark), "items")
    n_items = F.lit(grams.select("item").distinct().count()).cast("double")
    idf = grams.groupBy("gram").agg(F.count_distinct("item").alias("df"))
    idf = idf.select("gram", "df", F.log1p(n_items / F.col("df")).alias("idf"))
    rarest = F.log1p(n_items)
    item_weights = grams.groupBy("item", "item_words", "gram").agg(F.count("*").alias("tf")).join(idf, "gram")
    item_weights = written(item_weights.withColumn("weight", F.col("tf") * F.col("idf")), "item-weights")

    hits = _hits(docs, grams)
    laid = _windows(hits, item_weights, similarity).join(hits.select("row", "doc_id", "words"), "row")
    cut = F.slice("words", F.col("start") + 1, F.col("n_words"))
    shape = F.md5(F.concat_ws(" ", F.col("n_words").cast("string"), cut))
    windows = written(laid.select("doc_id", "start", "n_words", shape.alias("shape"), _with(cut, _grams).alias("grams")), "windows")
    # equal windows of many documents are fingerprinted and verified once
    contents = windows.groupBy("shape", "n_words").agg(F.first("grams").alias("grams"))
    counted = contents.select("shape", "n_words", F.explode("grams").alias("gram")).groupBy("shape", "n_words", "gram").agg(F.count("*").alias("tf"))
    weighted = counted.join(idf, "gram", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", rarest))
    weighted = written(weighted.select("shape", "n_words", "gram", "weight"), "window-weights")

    prints = _fingerprints(weighted, ["shape", "n_words"])
    item_prints = _fingerprints(item_weights, ["item", "item_words"])
    index = item_prints.withColumn("b", F.explode(_blocks(F.col("simhash"), True)))
    probes = prints.withColumn("b", F.explode(_blocks(F.col("simhash"), False)))
    distance = F.bit_count(F.col("w.simhash").bitwiseXOR(F.col("i.simhash")))
    near = probes.alias("w").join(
        index.alias("i"),
        (F.col("w.n_words") == F.col("i.item_words"))
        & (F.col("w.b.block") == F.col("i.b.block"))
        & (F.col("w.b.value") == F.col("i.b.value"))
        & (distance <= radius),
    )
    prefixes = _prefixes(item_weights, similarity)
    shared = weighted.alias("w").join(
        prefixes.alias("p"), (F.col("w.gram") == F.col("p.gram")) & (F.col("w.n_words") == F.col("p.item_words"))
    )
    pairs = near.select("w.shape", "i.item").union(shared.select("w.shape", "p.item")).distinct()
    # exact similarity: the lesser weights by a join on grams, the greater from the totals
    lesser = (
        pairs.join(weighted.select("shape", "gram", F.col("weight").alias("w")), "shape")
        .join(item_weights.select("item", "gram", F.col("weight").alias("v")), ["item", "gram"])
        .groupBy("shape", "item")
        .agg(F.sum(F.least("w", "v")).alias("lesser"))
    )
    whole_w = weighted.groupBy("shape").agg(F.sum("weight").alias("all_w"))
    whole_v = item_weights.groupBy("item").agg(F.sum("weight").alias("all_v"))
    close = (
        lesser.join(whole_w, "shape")
        .join(whole_v, "item")
        .withColumn("similarity", F.round(F.col("lesser") / (F.col("all_w") + F.col("all_v") - F.col("lesser")), 9))
        .filter(F.col("similarity") >= similarity)
    )
    close = (
        close.alias("c")
        .join(prints.alias("w"), F.col("c.shape") == F.col("w.shape"))
        .join(item_prints.alias("i"), F.col("c.item") == F.col("i.item"))
        .select("c.shape", "c.item", distance.alias("hamming"), "c.similarity")
    )
    names = bounded(grams.select("item", "item_id").distinct())
    # one window may stand in very many documents; the matches of windows are far fewer than those
    matched = windows.select("doc_id", "start", "n_words", "shape").join(bounded(written(close, "matches")), "shape").join(names, "item")
    best = F.max_by(F.struct("start", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    found = matched.groupBy("doc_id", "item").agg(F.first("item_id").alias("item_id"), best.alias("best"))
    return found.select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the rows of `docs` whose doc_id has no matching window; a null doc_id is matched
    like any other."""
    bad = written(contaminated_windows(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct(), "leaks")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.bad_id"))
    return docs.alias("d").join(bounded(bad).alias("b"), same, "left_anti")
