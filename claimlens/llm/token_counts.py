"""Token counts of a unigram vocabulary by a count-only Viterbi.

An Aho-Corasick automaton over the vocabulary yields every piece that ends at a position, longest
first; dynamic programming carries the best score and the number of pieces of a best path to each
position, and no path. Ties follow the tokenizer: the best path is replaced only by a strictly greater score,
with piece starts tried from left to right, so the longest last piece wins. A character that no piece
covers costs the least score less 10 and counts as its UTF-8 bytes (byte fallback). Control, unknown
and byte pieces match no text.

A space is written as U+2581, with one before the text. No piece has U+2581 after another character,
so no path crosses from a word to the next space and the best path of a text is that of its words; equal words are
counted once and remembered. Scores in these vocabularies are whole numbers, so sums are exact.

Defined cases: null and empty texts have 0 tokens; a text without spaces is one word, however long;
runs of spaces belong to the word after them; repeated rows each get their row; the columns besides
doc_id and text don't enter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from claimlens.llm.quality import TOKENIZERS
from claimlens.llm.shared import slices, texts_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 200_000


class UnigramCounter:
    """Counts tokens of texts by a vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("a piece goes on after a space: words can't be counted alone")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}

    def word(self, unit: str) -> int:
        """Tokens of one unit: a run of SPACE and what follows up to the next."""
        n = len(unit)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0
        best, pieces = None, 0

        def close(upto: int, best, pieces) -> None:
            # the unknown edge starts last, so it wins only by a greater score
            single = score[upto - 1] + self.unknown
            if best is None or (single > best and not has_single):
                best, pieces = single, count[upto - 1] + len(unit[upto - 1].encode("utf-8", "surrogatepass"))
            score[upto], count[upto] = best, pieces

        has_single = False
        for end, (length, own) in self.automaton.iter(unit):
            while done < end:
                done += 1
                close(done, best, pieces)
                best, has_single = None, False
            start = end + 1 - length
            if length == 1:
                has_single = True
            value = score[start] + own
            if best is None or value > best:
                best, pieces = value, count[start] + 1
        while done < n:
            done += 1
            close(done, best, pieces)
            best, has_single = None, False
        return count[n]

    def words(self, units: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = []
        for unit in units:
            got = memo.get(unit)
            if got is None:
                got = memo[unit] = self.word(unit)
            out.append(got)
        return out

    def text(self, text: str) -> int:
        if not text:
            return 0
        return sum(self.words(re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))))


@cache
def load_counter(path: str) -> UnigramCounter:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    usual = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in usual])


def counts_of(texts: pa.Array, counter: UnigramCounter) -> np.ndarray:
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    if not len(flat):
        return np.zeros(len(texts), np.int64)
    encoded = flat.dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), sizes)
    words = encoded.dictionary.to_pylist()
    codes = np.asarray(encoded.indices, dtype=np.int64)
    # words that hold U+2581 themselves, and empty ones between spaces, run together with their neighbours
    odd = np.fromiter((not w or SPACE in w for w in words), bool, len(words))
    uneven = np.zeros(len(texts), bool)
    uneven[doc[odd[codes]]] = True
    each = np.zeros(len(words), np.int64)
    plain = np.flatnonzero(~odd)
    each[plain] = counter.words([SPACE + words[i] for i in plain])
    total = np.bincount(doc, each[codes], len(texts)).astype(np.int64)
    for i in np.flatnonzero(uneven):
        total[i] = counter.text(texts[i].as_py())
    return total


def token_counts(docs: DataFrame, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(model)
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts_of(texts, counter)), pc.utf8_length(texts).cast(pa.int64())],
                    ["doc_id", "n_tokens", "n_chars"],
                )

    out = StructType([docs.schema["doc_id"], StructField("n_tokens", LongType()), StructField("n_chars", LongType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)
