"""Column builders against plain Python versions of their definitions."""

import hashlib
import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from claimlens.functions import identity, stats, text

TINY = 2.2250738585072014e-308


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_known_statistics(spark):
    got = one(spark, stats.position_statistics(doubles([0.7, 0.2, 0.1]), F.lit(0)))
    p = [0.7, 0.2, 0.1]
    entropy, collision = -sum(x * math.log(x) for x in p), sum(x * x for x in p)
    assert (got["target_id"], got["top_id"], got["top_alternative_id"], got["top_mismatch"]) == (0, 0, 1, 0.0)
    for name, want in {
        "ce": -math.log(0.7),
        "entropy": entropy,
        "collision_probability": collision,
        "collision_entropy": -math.log(collision),
        "delta": -math.log(0.7) - entropy,
        "swap_llr": math.log(0.2) - math.log(0.7),
        "expected_drift": 1 - 0.7,
        "expected_dispersion": 1 - collision,
    }.items():
        assert got[name] == pytest.approx(want, rel=1e-12, abs=1e-12), name


def test_zero_probability_is_clipped(spark):
    got = one(spark, stats.position_statistics(doubles([1.0, 0.0, 0.0]), F.lit(1)))
    assert got["ce"] == pytest.approx(-math.log(TINY))
    assert got["top_alternative_id"] == 0 and got["top_mismatch"] == 1.0 and got["entropy"] == 0.0


def test_ties_take_the_first(spark):
    got = one(spark, stats.position_statistics(doubles([0.25] * 4), F.lit(0)))
    assert (got["top_id"], got["top_alternative_id"]) == (0, 1)


@pytest.mark.parametrize(
    ("p", "target"), [([0.5, 0.6], 0), ([1.0], 0), ([-0.1, 1.1], 0), ([0.5, float("nan")], 0), ([0.5, 0.5], 2), ([0.5, 0.5], -1)]
)
def test_invalid_distributions_are_null(spark, p, target):
    assert one(spark, stats.position_statistics(doubles(p), F.lit(target))) is None


def test_softmax_is_stable(spark):
    got = one(spark, stats.softmax(doubles([1000.0, 1001.0])))
    assert got == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    assert one(spark, stats.softmax(doubles([1.0, float("inf")]))) is None
    assert one(spark, stats.softmax(doubles([1.0]))) is None


WORDS = re.compile(r"[^\W_]+(?:[-'][^\W_]+)?|[^\w\s]")


def plain_norm(word):
    return "".join(c for c in word.casefold() if c.isalnum())


@pytest.mark.parametrize(
    "value", ["", "  ", "Alder maps to 17.", "it's a well-known co-op-thing -- no_one's", "naïve Ünïcode, 東京!\n\tx y", "a' -b c-", "___"]
)
def test_word_spans(spark, value):
    got = [tuple(s) for s in one(spark, text.word_spans(F.lit(value)))]
    assert got == [(m.group(), m.start(), m.end()) for m in WORDS.finditer(value)]
    words = [w for w, _, _ in got]
    norm = spark.createDataFrame([(words,)], "w array<string>").select(F.transform("w", text.normalized)).first()[0]
    assert norm == [plain_norm(w) for w in words]


def test_folding_of_rare_letters(spark):
    for c in "ſẖẗẘẙİß":
        want, got = plain_norm(c), one(spark, text.normalized(F.lit(c)))
        assert (got != "") == (want != "")
        assert c == "ß" or unicodedata.normalize("NFC", got)[:1] == want[:1]


def digest_of(*parts):
    return hashlib.sha256("\0".join(str(p) for p in parts).encode()).hexdigest()


def check_mask(value, example, mask, rate, chosen):
    """What a mask has to be, by its definition: a rate in the band that the digest names, that share of the
    eligible words to the nearest (even) number, and no word left out that ranks before one taken."""
    words = {i: plain_norm(m.group()) for i, m in enumerate(WORDS.finditer(value))}
    content = {i for i, w in words.items() if w and w not in text.STOPWORDS}
    eligible = content or {i for i, w in words.items() if w}
    base = digest_of("fixed-v1", 7, example, "prior", mask)
    assert rate == 0.25 + 0.35 * (int(base[:16], 16) / 18446744073709551616.0) and 0.25 <= rate <= 0.6
    assert chosen == sorted(set(chosen)) and set(chosen) <= eligible
    wanted = rate * len(eligible)
    assert len(chosen) == 1 or abs(len(chosen) - wanted) < 0.5 or (abs(len(chosen) - wanted) == 0.5 and len(chosen) % 2 == 0)
    rank = lambda i: (digest_of(base, i), i)
    assert all(rank(taken) < rank(left) for taken in chosen for left in eligible - set(chosen))
    return len(eligible)


def test_masks_match_their_definition_in_any_order(spark):
    rng = random.Random(3)
    vocabulary = "the a of river stone counts seven it-is don't , . ! north over light 42".split()
    claims = [(f"e{i}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(40)] + [("stop", "the a of")]
    df = spark.createDataFrame(claims[::-1], "example_id string, claim string").repartition(3)
    df = df.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(3))))
    digest = text.mask_digest(F.lit(7), F.col("example_id"), F.lit("prior"), F.col("m"))
    rows = df.select(
        "example_id", "m", text.mask_rate(digest), text.masked_words(text.eligible_words(text.word_spans(F.col("claim"))["text"]), digest)
    ).collect()
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows}
    for example, claim in claims:
        if any(plain_norm(m.group()) for m in WORDS.finditer(claim)):
            for m in range(4):
                check_mask(claim, example, m, *got[example, m])
        else:
            assert got[example, 0][1] is None


def test_alignment_and_geometry(spark):
    claim, offsets = "Alder maps to 17.", [[0, 0], [0, 5], [6, 10], [11, 13], [14, 15], [15, 16], [16, 17]]
    df = spark.createDataFrame([(claim, offsets, [0, 11, 12, 13, 14, 15, 16])], "t string, o array<array<int>>, ids array<int>")
    df = df.withColumn("s", text.word_spans(F.col("t"))).withColumn("p", text.word_pieces(F.col("s"), F.col("o")))
    row = df.select("p", text.alignment_errors(F.col("t"), F.col("s"), F.col("o"), F.col("p")).alias("e")).first()
    assert row["p"] == [[1], [2], [3], [4, 5], [6]] and row["e"] == []
    g = df.select(text.mask_geometry(F.col("ids"), F.col("p"), F.array(F.lit(0), F.lit(3)), 99).alias("g")).first()["g"]
    assert (g["piece_indices"], g["target_ids"], g["masked_input_ids"]) == ([1, 4, 5], [11, 14, 15], [0, 99, 12, 13, 99, 99, 16])
    for chosen in ([7], [-1]):
        bad = df.select(text.mask_geometry(F.col("ids"), F.col("p"), F.array(*map(F.lit, chosen)), 99).alias("g")).first()["g"]
        assert bad["error"] == "word out of range"


def test_alignment_errors(spark):
    for offsets, reason in (
        ([[0, 9]], "offset outside the claim"),
        ([[0, 1]], "word without a piece"),
        ([[0, 3]], "piece overlaps two words"),
    ):
        df = spark.createDataFrame([("a b", offsets)], "t string, o array<array<int>>").withColumn("s", text.word_spans(F.col("t")))
        df = df.withColumn("p", text.word_pieces(F.col("s"), F.col("o")))
        assert reason in df.select(text.alignment_errors(F.col("t"), F.col("s"), F.col("o"), F.col("p"))).first()[0]


FIELDS = {f: f"{f} é\"\\" for f in identity.STRING_FIELDS} | {
    "input_ids": [1, 99, 3],
    "attention_mask": [1, 1, 0],
    "masked_positions": [1],
    "target_ids": [2],
    "mask_rate": 0.5,
    "temperature": 1.0,
}


def columns(fields):
    return {k: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in fields.items()}


def test_work_id(spark):
    want = hashlib.sha256(json.dumps(FIELDS, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert one(spark, identity.work_id(columns(FIELDS))) == want
    assert one(spark, identity.work_errors(columns(FIELDS))) == []


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"arm": ""}, "empty string field"),
        ({"attention_mask": [1]}, "attention length"),
        ({"attention_mask": [1, 2, 0]}, "attention value"),
        ({"target_ids": [2, 3]}, "target length"),
        ({"masked_positions": [1, 1], "target_ids": [2, 2]}, "repeated position"),
        ({"masked_positions": [3]}, "position out of range"),
        ({"mask_rate": 0.0}, "mask rate"),
        ({"temperature": 0.0}, "temperature"),
        ({"scoring_protocol": "analytic-v1", "temperature": 1.5}, "analytic temperature"),
    ],
)
def test_work_errors(spark, change, reason):
    assert reason in one(spark, identity.work_errors(columns(FIELDS | change)))


def test_json_numbers(spark):
    rng = random.Random(1)
    values = [0.5, 1.0, 0.00095, 1e-05, 2.5e-07, 12345678.9, 1e7, 123456789012345.0, 1e16, 1.5e22, -0.00025, -2e-6, 0.25, 0.6]
    values += [rng.uniform(0.25, 0.6) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", identity.json_number(F.col("v")).alias("j")).collect()
    assert [r["j"] for r in got] == [json.dumps(r["v"]) for r in got]


def test_json_strings(spark):
    value = "tab\t nul\x01 us\x1f sub\x1a ü \"q\" \\ \n"
    assert one(spark, identity.json_string(F.lit(value))) == json.dumps(value, ensure_ascii=False)


def test_ids_digest(spark):
    ids = F.array(F.lit("b"), F.lit("a"))
    assert one(spark, identity.ids_digest(ids)) == hashlib.sha256(b"a\nb\n").hexdigest()
    assert one(spark, identity.ids_digest(ids, False)) == hashlib.sha256(b"a\nb").hexdigest()


def test_plan_digest_is_the_digest_of_its_ids(spark):
    ids = [f"{i * 7919 % 1000:064x}" for i in range(300)]
    plan = spark.createDataFrame([(i,) for i in ids], "work_id string").repartition(5)
    for newline in (False, True):
        want = hashlib.sha256(("\n".join(sorted(ids)) + ("\n" if newline else "")).encode()).hexdigest()
        assert identity.plan_digest(plan, final_newline=newline) == want
        assert plan.agg(identity.ids_digest(F.collect_list("work_id"), newline)).first()[0] == want


def test_canonical_json_of_nested_columns(spark):
    rows = [({"b": 'q"\\\x1f é', "a": [1.0, 1e-7, 12345678.0], "c": None}, True, 3), ({"b": None, "a": None, "c": 5}, None, -1)]
    df = spark.createDataFrame(rows, "x struct<b:string,a:array<double>,c:long>, y boolean, z int")
    whole = df.select(F.struct("z", "y", "x").alias("r"))
    got = [r[0] for r in whole.select(identity.json_value(F.col("r"), whole.schema["r"].dataType)).collect()]
    assert got == [json.dumps({"x": x, "y": y, "z": z}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x, y, z in rows]
    bad = spark.createDataFrame([([1.0, float("nan")],)], "x array<double>")
    assert bad.select(identity.json_value(F.col("x"), bad.schema["x"].dataType)).first()[0] is None
