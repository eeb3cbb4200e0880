"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are densities of an insult and a threat lexicon (plain and disguised spellings apart), of a
lexicon of words and stems that one half of the sample shows to go with the label, insults within five
words of a second person, capitals, punctuation and disguised spelling. Trees and the calibration are
fitted on the driver from the other half. The sample is bounded, of labelled rows outside the held-out fold;
every document is then scored from its own text alone.

Defined cases: null and empty texts have features of 0 and so the score of an empty text; repeated rows
each get their row; with labels of one class only, or none, the score is the share of label 1 (0.5
without labels); rows without a label or with a null one aren't learned from; documents that share a
doc_id are learned from with that doc_id's label; other columns don't enter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from claimlens.llm.shared import Words, held_out, slices, texts_of, written

SAMPLE_ROWS = 8_000
#: Learned lexicon: entries at most, least log-likelihood ratio (about six standard errors), stem lengths.
LEXICON_ENTRIES = 400
LEXICON_RATIO = 30.0
STEMS = range(4, 10)
THRESHOLD = 0.3
NEAR = 5
#: Fixed word lists.
INSULTS = """arsehole asshole bastard bimbo bitch bootlicker brat clown coward cretin creep crook cunt
degenerate dickhead dimwit dipshit disgusting douche dumb dumbass dunce dweeb failure fool freak fucker
garbage gross halfwit hideous idiot idiotic imbecile inbred jackass jerk lame leech liar loser lowlife
lunatic maggot moron moronic motherfucker nitwit parasite pathetic pig prick psycho pussy rat repulsive
retard retarded scum scumbag shithead simpleton slob slut sleazy sucker swine trash trashy twat twit
ugly useless vermin vile wanker weirdo whore worthless wretch
arschloch depp dummkopf hurensohn idioten schlampe trottel vollidiot wichser abschaum
abruti connard connasse crétin enculé imbécile ordure salaud salope débile
cabrón estúpido gilipollas idiota imbécil pendejo puta escoria basura inútil stupid stupide""".split()
THREATS = """beat burn bury crush destroy die drown exterminate hang hate hurt kill murder perish rape
shoot slaughter stab strangle suffer""".split()
SECOND_PERSON = """you your yours yourself u ur ya thou du dich dir dein deine ihr euch euer
tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros""".split()
_LEET = str.maketrans("013457@$!|", "oieastasil")
FEATURES = (
    "insults", "insult_count", "insult_kinds", "near_you", "threats", "disguised_insults", "second_person",
    "capital_words", "capital_letters", "exclamations", "questions", "punctuation", "disguised_words", "length",
    "learned", "learned_count", "learned_kinds",
)


def word_kind(word: str, lexicon: frozenset[str] = frozenset()) -> tuple[bool, ...]:
    """Whether a word is an insult, threat, disguised insult, second person, in capitals, disguised, learned."""
    low = word.lower()
    bare = low.strip(".,;:!?\"'()[]{}<>*_-~`«»¡¿…")
    letters = sum(c.isalpha() for c in word)
    inner = len(bare) - sum(c.isalpha() or c in "-'’" for c in bare)
    disguised = 0 < inner < len(bare) and letters > 0
    insult = bare in _INSULTS
    hidden = False
    if not insult and disguised:
        plain = re.sub(r"[\W_\d]", "", bare.translate(_LEET))
        hidden = plain in _INSULTS or ("*" in bare and len(bare) > 3 and _masked(bare))
    learned = bool(lexicon) and any(f"{bare[:k]}*" in lexicon for k in STEMS if k <= len(bare))
    return insult, bare in _THREATS, hidden, bare in _SECOND, letters > 1 and word.isupper(), disguised, learned


def _masked(word: str) -> bool:
    pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in word))
    return any(len(i) == len(word) and pattern.fullmatch(i) for i in _INSULTS)


_INSULTS, _THREATS, _SECOND = frozenset(INSULTS), frozenset(THREATS), frozenset(SECOND_PERSON)


def features(texts: pa.Array, memo: dict[str, tuple[bool, ...]], lexicon: frozenset[str] = frozenset()) -> np.ndarray:
    """A row of FEATURES for each text."""
    if len(memo) > 400_000:
        memo.clear()
    words = Words(texts)
    for w in words.distinct:
        if w not in memo:
            memo[w] = word_kind(w, lexicon)
    kinds = np.array([memo[w] for w in words.distinct], bool).reshape(-1, 7)[words.codes]
    n, chars = words.counts, np.asarray(pc.utf8_length(texts), dtype=np.int64)
    per_word, per_char = 1 / np.maximum(n, 1), 1 / np.maximum(chars, 1)
    bad = kinds[:, 0] | kinds[:, 2]
    # running counts of second persons, cut at the text's bounds
    running = np.concatenate([[0], np.cumsum(kinds[:, 3])])
    at = np.arange(len(words.codes))
    low = np.maximum(at - NEAR, words.starts[words.doc])
    high = np.minimum(at + NEAR + 1, words.starts[words.doc + 1])
    near = bad & (running[high] > running[low])
    insults, learned = words.sums(bad.astype(np.int64)), words.sums(kinds[:, 6].astype(np.int64))

    def different(which: np.ndarray) -> np.ndarray:
        pairs = np.unique(words.doc[which] * (len(words.distinct) + 1) + words.codes[which])
        return np.bincount(pairs // (len(words.distinct) + 1), minlength=len(texts))

    def count(pattern: str) -> np.ndarray:
        return np.asarray(pc.count_substring_regex(texts, pattern), dtype=np.int64)

    return np.column_stack([
        insults * per_word,
        np.log1p(insults),
        different(bad),
        words.sums(near.astype(np.int64)) * per_word,
        words.sums(kinds[:, 1].astype(np.int64)) * per_word,
        words.sums(kinds[:, 2].astype(np.int64)) * per_word,
        words.sums(kinds[:, 3].astype(np.int64)) * per_word,
        words.sums(kinds[:, 4].astype(np.int64)) * per_word,
        count(r"\p{Lu}") * per_char,
        count("!") * per_char,
        count(r"\?") * per_char,
        count(r"[[:punct:]]") * per_char,
        words.sums(kinds[:, 5].astype(np.int64)) * per_word,
        np.log1p(n),
        learned * per_word,
        np.log1p(learned),
        different(kinds[:, 6]),
    ])


@dataclass
class Boosted:
    """Trees of equal depth, each an array of (feature, cut) by heap place and its leaf values."""

    base: float
    rate: float
    cuts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] | None = None
    lexicon: frozenset[str] = frozenset()

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.cuts:
            place = np.zeros(len(x), np.int64)
            while place.size and place[0] < len(feature):
                place = 2 * place + 1 + (x[rows, feature[place]] > cut[place])
            out += self.rate * leaf[place - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if self.steps is None:
            return 1 / (1 + np.exp(-raw))
        return np.interp(raw, *self.steps)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and increasing values, from the mean of each distinct x."""
    knots, place = np.unique(x, return_inverse=True)
    weight = np.bincount(place).astype(float)
    value = np.bincount(place, y) / weight
    pools: list[list[float]] = []
    for i in range(len(knots)):
        pools.append([value[i], weight[i], 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            total = pools[-1][1] + w
            pools[-1] = [(pools[-1][0] * pools[-1][1] + v * w) / total, total, pools[-1][2] + n]
    return knots, np.concatenate([np.full(int(n), v) for v, _, n in pools])


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, seed: int = 5) -> Boosted:
    """Second-order boosting of the logistic loss; every fourth row calibrates instead of training."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Boosted(float(np.log(p / (1 - p))), rate)
    held = np.random.default_rng(seed).permutation(len(y)) % 4 == 0
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 2:
        held[:] = False
    train_x, train_y = x[~held], y[~held]
    model = Boosted(float(np.log(train_y.mean() / (1 - train_y.mean()))), rate)
    edges = [np.unique(np.quantile(train_x[:, f], np.linspace(0, 1, 65))[:-1]) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, train_x[:, f], side="left") for f, e in enumerate(edges)])
    raw = np.full(len(train_y), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = train_y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        place = np.zeros(len(train_y), np.int64)
        for node in range(inner):
            own = place == node
            best = 1e-6
            split = None
            for f, e in enumerate(edges if own.any() else []):
                gs = np.cumsum(np.bincount(bins[own, f], g[own], len(e) + 1))
                hs = np.cumsum(np.bincount(bins[own, f], h[own], len(e) + 1))
                left_g, left_h = gs[:-1], hs[:-1]
                right_g, right_h = gs[-1] - left_g, hs[-1] - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                gain[(left_h < 0.5) | (right_h < 0.5)] = 0
                if len(gain) and gain.max() > best:
                    best, split = gain.max(), (f, int(gain.argmax()))
            right = np.zeros(len(own), bool)
            if split:
                feature[node], cut[node] = split[0], edges[split[0]][split[1]]
                right = bins[:, split[0]] > split[1]
            place[own] = 2 * node + 1 + right[own]
        leaf = np.bincount(place - inner, g, 2**depth) / (np.bincount(place - inner, h, 2**depth) + 1)
        model.cuts.append((feature, cut, leaf))
        raw += rate * leaf[place - inner]
    check = held if held.any() else ~held
    model.steps = isotonic(model.raw(x[check]), y[check].astype(float))
    return model


def _featured(docs: DataFrame, keep: list[str], lexicon: frozenset[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for part in slices(batch):
                rows = features(texts_of(part), memo, lexicon)
                values = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES), rows.ravel())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), values], [*keep, "features"])

    out = StructType([*(docs.schema[c] for c in keep), StructField("features", ArrayType(DoubleType()))])
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def learn_lexicon(sample: DataFrame, entries: int = LEXICON_ENTRIES, ratio: float = LEXICON_RATIO) -> frozenset[str]:
    """Stems ("stem*") that documents of label 1 have far oftener: at most `entries`, by the
    log-likelihood ratio of their document counts. `sample` has text and toxic."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}[\p{L}\p{M}]*)"), F.lit(1)))
    word = sample.select("doc_id", "toxic", F.explode(words).alias("w"))
    cuts = F.filter(F.array(*[F.when(F.length("w") >= k, F.substring("w", 1, k)) for k in STEMS]), lambda x: x.isNotNull())
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return frozenset()
    # a stem counts as present with one word, or, where it is a common syllable, only with three
    per_doc = word.select("doc_id", "toxic", F.explode(cuts).alias("stem")).groupBy("doc_id", "toxic", "stem").agg(F.count("*").alias("n"))
    levels = F.explode(F.when(F.col("n") >= 3, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1))))
    counted = per_doc.select("toxic", "stem", levels.alias("level")).groupBy("stem", "level").agg(
        F.count_if(F.col("toxic") == 1).cast("double").alias("a"), F.count_if(F.col("toxic") == 0).cast("double").alias("b")
    )
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    g2 = 2 * (F.col("a") * F.ln(F.col("a") / (n1 * share)) + F.when(F.col("b") > 0, F.col("b") * F.ln(F.col("b") / (n0 * share))).otherwise(0.0))
    often = counted.filter((F.col("a") >= 5) & (F.col("a") / n1 > 5 * F.col("b") / n0)).withColumn("g2", g2)
    often = often.groupBy("stem").agg(F.max("g2").alias("g2"))
    top = often.filter(F.col("g2") >= ratio).orderBy(F.col("g2").desc(), "stem").limit(entries)
    return frozenset(f"{r['stem']}*" for r in top.select("stem").collect())


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Boosted:
    """A model from at most `sample_rows` labelled rows of either class, drawn by a hash of doc_id; one
    half of them gives the lexicon, the other the trees."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [
        usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        for label in (0, 1)
    ]
    # 2 * sample_rows ids at most
    sample = written(docs.select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id"), "labelled")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    lexicon = learn_lexicon(sample.filter(half == 0))
    rows = _featured(sample.filter(half == 1), ["doc_id", "toxic"], lexicon)
    got = rows.orderBy(F.xxhash64("doc_id", "features")).limit(2 * sample_rows).toArrow()
    x = np.asarray(got["features"].combine_chunks().flatten(), dtype=float).reshape(-1, len(FEATURES))
    model = fit(x, np.asarray(got["toxic"], dtype=np.int64))
    model.lexicon = lexicon
    return model


def score_toxicity(docs: DataFrame, model: Boosted, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, scored from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for part in slices(batch):
                score = model.score(features(texts_of(part), memo, model.lexicon))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = StructType([docs.schema["doc_id"], StructField("score", DoubleType())])
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
