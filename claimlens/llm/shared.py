"""Helpers that several operators of this subpackage share.

Words are runs of characters other than space and U+0009..U+000D; every operator here counts them
the same way, whether on the JVM side (`WORD`) or over Arrow buffers (`Words`).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.sources.scratch import discard, intermediates, stored, written

__all__ = ["discard", "intermediates", "stored", "written"]

WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one vectorised step works on, so that memory follows this and not the batch.
SLICE_BYTES = 3 << 20
#: Bytes up to which a side of a join is broadcast, and what a row takes besides its values.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 40
#: Rows that meet a Python worker at once, inside `small_batches`.
BATCH_ROWS = 2000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """A scope whose Arrow batches have `rows` rows at most: both sides hold whole batches besides what they
    work on. For steps that run inside the scope; the session's own setting returns at its end."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(rows if before <= 0 else min(before, rows)))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def _held_bytes(field: T.StructField) -> Column:
    """About what a value takes in a hashed relation."""
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(field.name), F.lit(0)) * 8 + 32
    return F.lit(max(8, 8 * len(getattr(field.dataType, "fields", ()))))


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, of scalars and flat arrays, with a broadcast hint if its rows are checked to take at most
    `limit` bytes in memory; a shuffled join remains otherwise."""
    row = F.lit(ROW_BYTES)
    for f in df.schema:
        row = row + _held_bytes(f)
    taken = df.select(row.cast("long").alias("bytes")).agg(F.sum("bytes")).first()[0] or 0
    return F.broadcast(df) if taken <= limit else df


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of(column: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """The fold that no model of this subpackage learns from: crc32(doc_id as text) mod 4 = 2."""
    return crc32_of(doc_id) % 4 == 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that linear combinations of codes spread evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch as large strings of their own, nulls as empty.

    A slice is copied: some Arrow string kernels misread arrays that begin within a buffer.
    """
    texts = batch.column(column)
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batch of about `size` (SLICE_BYTES) of text each; a longer text stands alone."""
    size = SLICE_BYTES if size is None else size
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(sizes.astype(np.int64))
    begin = 0
    while begin < len(ends):
        floor = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, floor + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on, and an executor's limit counts them all."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """The words of some texts as codes into their distinct words.

    codes: for each word its place in `distinct`; doc: for each word its text's place;
    starts[i]:starts[i + 1]: the words of text i.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        encoded = flat.dictionary_encode() if len(flat) else pa.array([], pa.large_string()).dictionary_encode()
        codes = np.asarray(encoded.indices, dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
        distinct = encoded.dictionary.to_pylist()
        # a text that begins or ends in white space yields an empty string there
        if "" in (found := {w: i for i, w in enumerate(distinct) if w == ""}):
            real = codes != found[""]
            codes, doc = codes[real], doc[real]
        self.codes, self.doc, self.distinct = codes, doc, distinct
        self.starts = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.counts = np.diff(self.starts)

    def per_word(self, values: Iterable, dtype) -> np.ndarray:
        """`values` of the distinct words, dealt to every word."""
        return np.fromiter(values, dtype, len(self.distinct))[self.codes]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each text; 0 for a text without words."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words that lie in one text, and where they begin."""
        if len(hashes) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        count = len(hashes) - n + 1
        key = np.zeros(count, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count] + np.uint64(1))
        whole = self.doc[:count] == self.doc[n - 1 :]
        return key[whole], np.flatnonzero(whole)
