"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled running text: excerpts of a bounded sample of labelled
rows outside the held-out fold. A whole text is parsed against every language from its first character to
its last, across words, into greedy phrases: each the longest match that the automaton yields, or
one character where it has none. The language with the fewest phrases per character wins.

Texts are lower-cased before, and every run of other characters than letters and marks becomes one space.

Defined cases: a text that is null or has no letter is `und` with score 0; a tie goes to the language
first by code point; no labelled rows at all make every text `und`; rows whose lang is null aren't
learned from; repeated rows each get their row, and count once among the labelled rows drawn; more
languages than MAX_LANGUAGES are refused and not cut; other columns don't enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from claimlens.llm.shared import held_out, slices, texts_of

#: Bounds of what is learned from: rows of each language, characters of each row, languages.
SAMPLE_ROWS = 250
EXCERPT_CHARS = 200
MAX_LANGUAGES = 200
SHARPNESS = 40.0


class SuffixAutomaton:
    """The smallest automaton of all substrings of a text."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[state] = twin
            last = state

    def phrases(self, text: str) -> int:
        """Number of longest-match phrases; a character that never occurs is a phrase of its own."""
        step, state, count = self.next, 0, 0
        for c in text:
            to = step[state].get(c)
            if to is None:
                if state:
                    count += 1
                to = step[0].get(c)
                if to is None:
                    count += 1
                    to = 0
            state = to
        return count + (state != 0)


def plain_texts(texts: pa.Array) -> list[str]:
    """Letters and marks in lower case, one space for all between, before and after."""
    low = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    return [f" {t.strip(' ')} " for t in low.to_pylist()]


class CrossParser:
    def __init__(self, references: dict[str, str]):
        self.langs = sorted(references)
        self.automata = [SuffixAutomaton(references[lang]) for lang in self.langs]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its score; equal texts are parsed once."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        encoded = texts.dictionary_encode()
        lettered = np.asarray(pc.match_substring_regex(encoded.dictionary, r"\p{L}"))
        plain = plain_texts(encoded.dictionary)
        rate = np.array([[a.phrases(t) / len(t) for a in self.automata] if real else [0.0] * len(self.langs) for t, real in zip(plain, lettered, strict=True)])
        rate = rate.reshape(-1, len(self.langs))
        likely = np.exp(-SHARPNESS * (rate - rate.min(axis=1, keepdims=True)))
        score = np.where(lettered, 1 / likely.sum(axis=1), 0.0)
        best = [self.langs[b] if real else "und" for b, real in zip(rate.argmin(axis=1), lettered, strict=True)]
        codes = np.asarray(encoded.indices, dtype=np.int64)
        return [best[c] for c in codes], score[codes]


@lru_cache(maxsize=2)
def _parser(references: tuple[tuple[str, str], ...]) -> CrossParser:
    """One parser for all tasks of a Python worker."""
    return CrossParser(dict(references))


def fit_languages(
    docs: DataFrame, sample_rows: int = SAMPLE_ROWS, excerpt_chars: int = EXCERPT_CHARS, max_languages: int = MAX_LANGUAGES
) -> dict[str, str]:
    """lang -> reference text: excerpts of at most `sample_rows` rows of each language.

    Rows are counted by language first; a hash of their id then draws about twice the rows wanted, which
    meet on the driver in the order of that hash: at most about 2 * languages * sample_rows excerpts.
    """
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages to learn from them all")
    if not sizes:
        return {}
    draw = F.xxhash64("doc_id")
    steps = 1 << 40
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(steps * min(1.0, 2 * sample_rows / n)))])
    drawn = known.withColumn("draw", draw).filter(F.pmod(draw, F.lit(steps)) < F.element_at(shares, F.col("lang")))
    # from a place that the hash chooses, so that not only beginnings are learned from
    room = F.greatest(F.lit(1), F.length("text") - excerpt_chars)
    excerpt = F.substr("text", (F.pmod(F.shiftright("draw", 20), room) + 1).cast("int"), F.lit(excerpt_chars))
    rows = drawn.withColumn("excerpt", excerpt).filter(F.col("excerpt").rlike(r"\p{L}"))
    # rows that share an id are drawn together, so one of them stands for all
    rows = rows.groupBy("lang", "draw").agg(F.min("excerpt").alias("excerpt")).collect()
    chosen: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["draw"] % steps, r["draw"])):
        chosen.setdefault(r["lang"], []).append(r["excerpt"])
    return {lang: "".join(plain_texts(pa.array(found[:sample_rows], pa.large_string()))) for lang, found in chosen.items()}


def predict_languages(docs: DataFrame, references: dict[str, str]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from the text alone."""
    told = tuple(sorted(references.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(told)
        for batch in batches:
            for part in slices(batch):
                langs, score = parser.predict(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    out = StructType([docs.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
