"""The pipeline's stages against plain versions of each, on their own inputs."""

import collections
import os
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from claimlens.llm import quality, shared, sharding
from claimlens.llm.oracles import ORACLE_SQL
from claimlens.llm.queries import QUERIES
from tests_llm_plain import WORD, plain_components, plain_targets

PROSE = (
    "the council met on tuesday to discuss how the old harbour could be repaired before winter and several people "
    "from the village asked whether the money would be enough to pay for a new wall along the shore"
).split()


def prose(rng, n):
    return " ".join(f"{rng.choice(PROSE)}{rng.choice(['', 's', 'ed', 'ing'])}" for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [prose(rng, 25) for _ in range(3)]
    rows = [(i, prose(rng, rng.randint(12, 90)), "en", f"s{min(i % 7, 2)}") for i in range(150)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "s0") for i in range(15)] + [(230 + i, rows[3][1], "en", None) for i in range(10)]
    rows += [(300 + i, f"{prose(rng, 30)} {items[i % 3]} {prose(rng, 12)}", "en", "s1") for i in range(9)]
    rows += [(400, None, None, None), (401, "", "en", "s1"), (402, "too short", "en", "s2"), (403, "again and again " * 30, "en", "s2")]
    folder = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    current, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, current, folder)
        result.write.parquet(f"{folder}/{k}")
        out[name] = (current, spark.read.parquet(f"{folder}/{k}"))
        current = out[name][1]
    return folder, items, out


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_whole_run(spark, stages):
    folder, _, out = stages
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, (before, after) in list(out.items())[:-1]:
        assert after.columns == names, name
        assert after.exceptAll(before.join(after.select("doc_id").distinct(), "doc_id").select(*names)).distinct().isEmpty() or name == "mixing"
    with shared.intermediates(spark):
        result = corpus_pipeline.run(spark, folder)
        assert ids(result) == ids(out["sharding"][1])
        path = result.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_quality_stage(stages):
    before, after = stages[2]["quality rules"]
    kept = quality.quality_measures(before).filter("kept")
    assert ids(after) == ids(kept) and not {400, 401, 402, 403} & ids(after).keys()
    assert ids(before).keys() - ids(after).keys() == {400, 401, 402, 403}


def test_near_duplicate_stage(stages):
    before, after = stages[2]["near-duplicates"]
    roots = plain_components([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert ids(after).keys() == set(roots.values())
    assert after.filter(F.col("doc_id").between(230, 239)).isEmpty()


def test_decontamination_stage(stages):
    before, after = stages[2]["decontamination"]
    items = stages[1]
    dirty = {r["doc_id"] for r in before.collect() if any(i in r["text"] for i in items)}
    assert dirty and ids(after).keys() == ids(before).keys() - dirty


def test_mixing_stage(stages):
    before, after = stages[2]["mixing"]
    assert set(after.exceptAll(before).select("doc_id").collect()) <= set(before.select("doc_id").collect())
    assert max(ids(after).values()) <= 3
    size = lambda df: collections.Counter(s for r in df.collect() for s in [r["source"]] * len(WORD.findall(r["text"])))
    had, has = size(before), size(after)
    order = sorted(s for s in had if s is not None) + [None] * (None in had)
    longest = {s: max(len(WORD.findall(r["text"])) for r in before.collect() if r["source"] == s) for s in had}
    for s, want in plain_targets(had, {s: i % 3 + 1 for i, s in enumerate(order)}).items():
        # whole documents, and blocks of a hundredth of the least target at most
        assert abs(has[s] - want) <= 0.01 * want + longest[s] / 2 + 1, s


def test_sharding_stage(stages):
    before, after = stages[2]["sharding"]
    assert after.columns == [*before.columns, "shard"] and ids(before) == ids(after)
    bounds = sharding.shard_by_bytes(before, 40).select("doc_id", "shard").distinct()
    assert after.select("doc_id", "shard").join(bounds, ["doc_id", "shard"], "left_anti").count() <= 40


def test_registration():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert ORACLE_SQL.keys() <= QUERIES.keys()
