"""Words of a claim, the pieces that cover them, and the masks drawn over them.

A word is letters and digits, with one inner hyphen or apostrophe at most, or one punctuation mark.
Spans are half open, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens.functions.stats import let

WORD = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)?|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
GAP = r"[_\s\x1c-\x1f\x85\p{Z}]+"
#: The function words that are masked only where a claim has no others.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "was", "were", "is", "are", "in", "on", "of", "for",
    "to", "at", "by", "with", "from", "as", "that", "this", "he", "she", "it", "they",
)
#: Characters whose full case folding a lower-casing misses and that matter to emptiness or STOPWORDS.
_FOLD_FROM, _FOLD_TO = "ſͅẖẗẘẙ", "sιhtwy"
POLICY = "fixed-v1"
RATE_LOW, RATE_SPAN = 0.25, 0.35


def word_spans(text: Column) -> Column:
    """array<struct<text, start, end>> of the words, in order."""
    tiles = F.regexp_extract_all(text, F.lit(f"({WORD}|{GAP})"), F.lit(1))
    empty = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<text:string,start:int,end:int>>").alias("spans"),
    )

    def step(acc: Column, tile: Column) -> Column:
        end = acc["at"] + F.length(tile)
        span = F.struct(tile.alias("text"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(tile.rlike(rf"\A{GAP}\z"), acc["spans"]).otherwise(F.array_append(acc["spans"], span)).alias("spans"),
        )

    return F.aggregate(tiles, empty, step, lambda acc: acc["spans"])


def normalized(word: Column) -> Column:
    """The word's letters and digits, case folded."""
    return F.regexp_replace(F.lower(F.translate(word, _FOLD_FROM, _FOLD_TO)), r"[^\p{L}\p{N}]", "")


def is_maskable(word: Column) -> Column:
    """Whether a word has a letter or digit; a longer one than punctuation always has."""
    return (F.length(word) > 1) | (normalized(word) != "")


def is_content(word: Column) -> Column:
    """Whether a word is maskable and no stop word. Normalising takes away one character of a word at most (its
    hyphen or apostrophe), so only short words are normalised."""
    longest = 1 + max(map(len, STOPWORDS))
    return (F.length(word) > longest) | ~normalized(word).isin("", *STOPWORDS)


def eligible_words(words: Column) -> Column:
    """Indices of the words that masks are drawn from: content words, else all with a letter or digit."""

    def those(test) -> Column:
        return F.array_compact(F.transform(words, lambda w, i: F.when(test(w), i)))

    return let(those(is_content), lambda c: F.when(F.size(c) > 0, c).otherwise(those(is_maskable)))


def word_pieces(spans: Column, offsets: Column) -> Column:
    """For each word the indices of the pieces that overlap it; empty pieces overlap nothing."""
    indexed = F.transform(offsets, lambda o, i: F.struct(F.get(o, F.lit(0)).alias("from"), F.get(o, F.lit(1)).alias("to"), i.alias("i")))
    return F.transform(
        spans,
        lambda w: F.transform(
            F.filter(indexed, lambda o: (o["to"] > o["from"]) & (o["to"] > w["start"]) & (o["from"] < w["end"])), lambda o: o["i"]
        ),
    )


def alignment_errors(text: Column, spans: Column, offsets: Column, pieces: Column) -> Column:
    """array<string>: offsets that are malformed, words without a piece, pieces of two words."""
    bad_offset = F.exists(
        offsets,
        lambda o: (F.size(o) != 2) | (F.get(o, F.lit(0)) < 0) | (F.get(o, F.lit(1)) < F.get(o, F.lit(0))) | (F.get(o, F.lit(1)) > F.length(text)),
    )
    both = F.filter(F.arrays_zip(spans.alias("span"), pieces.alias("own")), lambda z: normalized(z["span"]["text"]) != "")
    owned = F.flatten(F.transform(both, lambda z: z["own"]))
    return F.array_compact(
        F.array(
            F.when(bad_offset, F.lit("offset outside the claim")),
            F.when(F.exists(both, lambda z: F.size(z["own"]) == 0), F.lit("word without a piece")),
            F.when(F.size(owned) != F.size(F.array_distinct(owned)), F.lit("piece overlaps two words")),
        )
    )


def mask_digest(seed: Column, example_id: Column, arm: Column, mask_index: Column) -> Column:
    parts = [F.lit(POLICY), seed, example_id, arm, mask_index]
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]).cast("binary"), 256)


def mask_rate(digest: Column) -> Column:
    """The rate in the policy's band that the digest's first 64 bits choose."""
    unit = F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)
    return RATE_LOW + RATE_SPAN * unit


def masked_words(eligible: Column, digest: Column) -> Column:
    """The chosen word indices, ascending: the first by a hash rank, as many as the rate says."""
    n = F.size(eligible)
    wanted = F.greatest(F.lit(1), F.least(n, F.rint(mask_rate(digest) * n).cast("int")))

    def rank(i: Column) -> Column:
        return F.struct(F.sha2(F.concat_ws("\0", digest, i.cast("string")).cast("binary"), 256).alias("draw"), i.alias("i"))

    first = F.slice(F.array_sort(F.transform(eligible, rank)), F.lit(1), wanted)
    return F.when(n > 0, F.array_sort(F.transform(first, lambda s: s["i"])))


def mask_geometry(token_ids: Column, pieces: Column, chosen: Column, mask_id: int) -> Column:
    """struct<piece_indices, target_ids, masked_input_ids, error> of masking all pieces of the words."""
    own = F.transform(chosen, lambda w: F.get(pieces, w.cast("int")))
    flat = F.flatten(own)
    error = (
        F.when(F.exists(chosen, lambda w: (w < 0) | (w >= F.size(pieces))), F.lit("word out of range"))
        .when(F.exists(own, lambda p: F.size(p) == 0), F.lit("word without a piece"))
        .when(F.exists(flat, lambda p: (p < 0) | (p >= F.size(token_ids))), F.lit("piece outside the tokens"))
        .when(F.size(F.array_distinct(flat)) != F.size(flat), F.lit("piece of two selected words"))
        .when(F.size(flat) < 1, F.lit("no piece"))
    )

    def built(at: Column) -> Column:
        return F.struct(
            at.alias("piece_indices"),
            F.transform(at, lambda i: F.get(token_ids, i)).alias("target_ids"),
            F.transform(token_ids, lambda t, i: F.when(F.array_contains(at, i), F.lit(mask_id)).otherwise(t)).alias("masked_input_ids"),
            error.alias("error"),
        )

    return let(F.array_sort(F.coalesce(flat, F.array().cast("array<int>"))), built)
