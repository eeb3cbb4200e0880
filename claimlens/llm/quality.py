"""Quality rules: how well public vocabularies fit a text.

Every word is encoded with a space before it by two public vocabularies, a byte-level one and one of
pieces with byte fallback. A text has characters per token for both, the share of its piece tokens
that are byte fallbacks, and the entropy of its byte-level tokens. Bands of these by the script of
most words reject texts that tokenizers break up (symbol noise, all capitals, encoded data) or that say
the same over and over. Base rules on words and repetition come before.

Words repeat, so a batch is dictionary-encoded in Arrow and each distinct word is encoded once; counts
over words are NumPy sums. Memory follows the slice (about 1 MB of text) and a bounded memo of words.

Defined cases: null and empty texts have no words and fail the base rules, with all measures 0; words
without letters belong to the script `other`; a tie between scripts goes to the first in BANDS; one very
long text is a slice of its own; repeated rows each get their row; other columns don't enter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.shared import Words, mix, release, slices, texts_of

TOKENIZERS = "/opt/tokenizers"
MEMO_WORDS = 60_000
#: Every token of a slice is laid out, so slices are smaller here.
SLICE_BYTES = 1 << 20
#: Fixed values. By script: code points at which its letters begin and end; least and greatest
#: characters per byte-level token; least letters per byte-level token; least characters per piece;
#: greatest share of byte fallbacks; least bits of entropy for a text of 100 tokens or more.
BANDS = {
    "latin": ((0x41, 0x24F), (1.6, 6.5), 1.4, 1.3, 0.10, 3.0),
    "greek": ((0x370, 0x3FF), (0.4, 3.0), 0.3, 0.4, 0.60, 3.0),
    "cyrillic": ((0x400, 0x52F), (0.4, 4.0), 0.3, 0.6, 0.60, 3.0),
    "hebrew_arabic": ((0x590, 0x77F), (0.3, 3.0), 0.2, 0.4, 0.80, 3.0),
    "other": ((0x780, 0x10FFFF), (0.2, 3.0), 0.1, 0.2, 0.95, 2.5),
}
SCRIPTS = list(BANDS)
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, script string, chars_per_token double, letters_per_token double, chars_per_piece double, "
    "byte_share double, token_entropy double"
)


@cache
def _encoders(folder: str):
    import sentencepiece
    import tiktoken

    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    # every word stands alone, so the pattern only has to keep it whole up to the vocabulary's own classes
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
    return bpe, pieces, is_byte


def script_of(word: str) -> int:
    if "A" <= word[:1] <= "z" and word[:1].isalpha():
        return 0
    for c in word:
        if c.isalpha():
            at = ord(c)
            for i, (bounds, *_) in enumerate(BANDS.values()):
                if bounds[0] <= at <= bounds[1]:
                    return i
    return len(SCRIPTS) - 1


class _Memo:
    """word -> (byte-level token ids, pieces, byte pieces, script, letters), for as many words as fit."""

    def __init__(self, folder: str):
        self.bpe, self.pieces, self.is_byte = _encoders(folder)
        self.known: dict[str, tuple[tuple[int, ...], int, int, int, int]] = {}

    def of(self, words: list[str]) -> list[tuple[tuple[int, ...], int, int, int, int]]:
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        made = {}
        ids = self.pieces.encode(new, num_threads=1) if new else []
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flags = np.concatenate([[0], np.cumsum(self.is_byte[np.fromiter(chain.from_iterable(ids), np.int64)])])
        ends = np.cumsum(sizes)
        n_bytes = (flags[ends] - flags[ends - sizes]).tolist()
        encode = self.bpe.encode_ordinary
        for w, n, k in zip(new, sizes.tolist(), n_bytes, strict=True):
            letters = len(w) if w.isalpha() else sum(map(str.isalpha, w))
            made[w] = (tuple(encode(" " + w)), n, k, script_of(w), letters)
        found = [made[w] if w in made else self.known[w] for w in words]
        self.known.update(made)
        return found


def repeated_words(words: Words, n: int = 5) -> np.ndarray:
    """Whether each word stands in an n-word window that its text has twice or more."""
    covered = np.zeros(len(words.codes) + 1, np.int64)
    keys, at = words.windows(mix(words.codes.astype(np.uint64) + np.uint64(7)), n)
    if len(keys):
        with np.errstate(over="ignore"):
            keys = mix(keys + words.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + n, -1)
    return np.cumsum(covered)[:-1] > 0


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text, its lines with a word that equal an earlier line of it."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    if not len(flat):
        return np.zeros(len(texts), np.int64)
    encoded = flat.dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    worded = np.asarray(pc.match_substring_regex(encoded.dictionary, r"[^\x20\x09-\x0D]"))
    codes = np.asarray(encoded.indices, dtype=np.int64)
    real = worded[codes]
    keys = doc[real] * len(worded) + codes[real]
    lines = np.bincount(doc[real], minlength=len(texts))
    return lines - np.bincount(np.unique(keys) // len(worded), minlength=len(texts))


def entropy(doc: np.ndarray, token: np.ndarray, n_docs: int, vocabulary: int) -> np.ndarray:
    """Bits of entropy of each text's tokens."""
    keys = np.sort(doc * vocabulary + token)
    if not len(keys):
        return np.zeros(n_docs)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.concatenate([begin, [len(keys)]])).astype(float)
    owner = keys[begin] // vocabulary
    total = np.bincount(owner, count, n_docs)
    return np.log2(np.maximum(total, 1)) - np.bincount(owner, count * np.log2(count), n_docs) / np.maximum(total, 1)


def measures(texts: pa.Array, memo: _Memo) -> dict[str, np.ndarray]:
    words = Words(texts)
    n = len(texts)
    found = memo.of(words.distinct)
    lengths = words.per_word(map(len, words.distinct), np.int64)
    chars, count = words.sums(lengths), words.counts
    tokens = words.per_word((len(f[0]) for f in found), np.int64)
    letters = words.sums(words.per_word((f[4] for f in found), np.int64))
    pieces = words.sums(words.per_word((f[1] for f in found), np.int64))
    n_bytes = words.sums(words.per_word((f[2] for f in found), np.int64))
    script = words.per_word((f[3] for f in found), np.int64)
    votes = np.bincount(words.doc * len(SCRIPTS) + script, minlength=n * len(SCRIPTS)).reshape(n, -1)
    # tokens of every word, text after text
    flat = np.fromiter((t for f in found for t in f[0]), np.int64)
    first = np.cumsum([0, *(len(f[0]) for f in found)])[:-1]
    ends = np.cumsum(tokens)
    where = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - tokens, tokens)
    stream = flat[np.repeat(first[words.codes], tokens) + where] if len(where) else np.empty(0, np.int64)
    n_tokens = words.sums(tokens)
    bits = entropy(np.repeat(words.doc, tokens), stream, n, 1 << 17)
    repeats = words.sums(repeated_words(words).astype(np.int64))
    failed = (count < 10) | (100 * repeats > 20 * count)
    by_token, by_piece = chars / np.maximum(n_tokens, 1), chars / np.maximum(pieces, 1)
    by_letter = letters / np.maximum(n_tokens, 1)
    share = n_bytes / np.maximum(pieces, 1)
    which = votes.argmax(axis=1)
    low, high, letter, piece, most, least = (
        np.array(x)[which] for x in zip(*[(*b[1], *b[2:]) for b in BANDS.values()], strict=True)
    )
    fits = (by_token >= low) & (by_token <= high) & (by_letter >= letter) & (by_piece >= piece) & (share <= most)
    fits &= (n_tokens < 100) | (bits >= least)
    return {
        "n_words": count,
        "word_chars": chars,
        "n_symbols": np.asarray(pc.count_substring_regex(texts, r"[#*$%&|<>]"), dtype=np.int64),
        "n_dup_lines": duplicate_lines(texts),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": ~failed & fits,
        "script": np.array(SCRIPTS, object)[which],
        "chars_per_token": by_token,
        "letters_per_token": by_letter,
        "chars_per_piece": by_piece,
        "byte_share": share,
        "token_entropy": bits,
    }


def _map(columns: list[str], schema: pa.Schema, folder: str, only_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(folder)
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                got = measures(texts_of(part), memo)
                if only_kept:
                    yield part.filter(pa.array(got["kept"]))
                    continue
                arrays = [part.column(c) for c in columns]
                arrays += [pa.array(got[f.name], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, *schema.names])
        # the worker may live on idle beside the next stages
        del memo
        _encoders.cache_clear()
        release()

    return run


def quality_measures(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id and all measures, with `kept`, of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(SCHEMA)
    out = StructType([docs.schema["doc_id"], *made.fields])
    run = _map(["doc_id"], to_arrow_schema(made), tokenizers, False)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def keep_quality(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns unchanged, in one pass without a shuffle."""
    return docs.mapInArrow(_map([], pa.schema([]), tokenizers, True), docs.schema)
