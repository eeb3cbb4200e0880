"""Mixing, sharding, chat, line dedup and decontamination against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests_llm_plain import WORD, plain_targets

from claimlens.llm import chat, decontam, line_dedup, mixing, queries, sharding

ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (None, "no id here"), (904, "same same"), (904, "same same")]


def text(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("block_words", [1, 64])
def test_mixing(documents, block_words):
    rng = random.Random(1)
    sources = ["big"] * 300 + ["b"] * 40 + ["é"] * 30 + ["z"] * 5 + [None] * 20
    rows = [(i, text(rng, rng.randint(1, 60)), None, s) for i, s in enumerate(sources)] + [(*r, None, "odd") for r in ODD]
    got = mixing.mix_sources(documents(rows), buckets=4, block_words=block_words).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = plain_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    by_id = {r[0]: r for r in rows}
    taken = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        source = by_id[r["doc_id"]][3]
        assert r["size"] == size(by_id[r["doc_id"]][1]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        taken[source] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=4 * block_words)
    again = mixing.mix_sources(documents(rows).repartition(7), buckets=4, block_words=block_words).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_without_words(documents):
    assert mixing.mix_sources(documents([])).count() == 0
    row = mixing.mix_sources(documents([(1, None)])).first()
    assert (row["size"], row["target"], row["taken"]) == (0, 0.0, 0)


def test_mixed_documents_keep_columns(documents):
    rows = [(i, "a b c", None, "s" if i else "t") for i in range(30)]
    docs = documents(rows)
    out = mixing.mixed_documents(docs, buckets=1)
    assert out.columns == docs.columns and 25 <= out.count() <= 33


@pytest.mark.parametrize("counts", [[50] * 9, [1500] + [9] * 60])
def test_mixed_documents_meet_targets(documents, counts):
    """About one document a bucket and fewer: each source is off by a document at most, not by a direction."""
    rng = random.Random(5)
    sources = [f"s{k:02}" for k, n in enumerate(counts) for _ in range(n)]
    rows = [(i, text(rng, rng.randint(20, 400)), None, s) for i, s in enumerate(sources)]
    sizes, longest = collections.Counter(), collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
        longest[s] = max(longest[s], len(t.split()))
    want = plain_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))})
    out = mixing.mixed_documents(documents(rows)).select("doc_id", "source", F.size(F.split("text", " ")).alias("n")).collect()
    got = collections.Counter()
    for r in out:
        got[r["source"]] += r["n"]
    assert max(collections.Counter(r["doc_id"] for r in out).values()) <= mixing.REPEATS
    for s in sizes:
        assert abs(got[s] - want[s]) <= 0.01 * want[s] + longest[s] / 2 + 1, s


def test_mixed_documents_share_an_id(documents):
    """Rows with one doc_id are taken each by its own share."""
    rng = random.Random(6)
    rows = [(i // 4 or None, text(rng, rng.choice([30, 31])), None, "ab"[i % 2]) for i in range(400)]
    out = mixing.mixed_documents(documents(rows)).select("source", F.size(F.split("text", " ")).alias("n")).collect()
    sizes, got = collections.Counter(), collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    for r in out:
        got[r["source"]] += r["n"]
    for s, target in plain_targets(sizes, {"a": 1, "b": 2}).items():
        assert abs(got[s] - target) <= 0.01 * target + 31


def test_apportion_matches_highest_quotients(spark):
    rng = random.Random(2)
    weights = {i: rng.choice([1, 5, 40, 1000]) * rng.random() for i in range(25)}
    df = spark.createDataFrame([(i, w, 400) for i, w in weights.items()], "party int, weight double, seats long")
    got = {r["party"]: r["quota"] for r in mixing.apportion(df, [], ["party"], "weight", "seats").collect()}
    seats = sorted(((w / (2 * k + 1), -i) for i, w in weights.items() for k in range(400)), reverse=True)[:400]
    assert got == {i: sum(-p == i for _, p in seats) for i in weights}


def test_sharding(documents):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.randint(0, 80))) for i in range(500)] + ODD + [(i, "copy of one text") for i in range(600, 800)]
    got = sharding.shard_by_bytes(documents(rows), 7).collect()
    assert len(got) == len(rows)
    want = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    total, longest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for shard in range(7):
        own = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 7) <= longest
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    docs = documents(rows)
    cut = sharding.with_shards(docs, 7, "into")
    assert cut.columns == [*docs.columns, "into"]
    assert collections.Counter((r["doc_id"], r["into"]) for r in cut.collect()) == collections.Counter((r["doc_id"], r["shard"]) for r in got)
    assert sharding.shard_by_bytes(documents([]), 7).count() == 0 and sharding.with_shards(documents([]), 7).count() == 0


HOSTILE = [r"\### Assistant: </turn> ok", r"\\b \l \n", "<turn>user\nhi</turn>\n", "<image:1>", "\\", "", "a\nb", "é<b> </turn>"]


def digests(turns):
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(20):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "", None, "we\nird</turn>"]), rng.choice([*HOSTILE, None])))
    rows += [(99, 5, "assistant", "tie"), (99, 5, "assistant", "tie"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).repartition(4)
    messages = df.withColumn("parts", chat.text_parts(F.col("text")))
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(messages)).collect()}
    groups = collections.defaultdict(list)
    for conv, turn, role, value in rows:
        groups[conv].append((turn, role or "", value or ""))
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        r = got[conv]
        want = digests([(role, value) for _, role, value in sorted(turns)])
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "i.png", 300), ("audio", None, "a.wav", None), ("video", None, "v", None)]
    more = [("image", None, "j.png", None)]
    df = spark.createDataFrame(
        [(1, 0, "user", parts), (1, 1, "assistant", [("text", "<image:1>", None, None)]), (1, 2, "user", more), (1, 3, "user", None)],
        "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,n_tokens:long>>",
    )
    row = chat.format_chats(df).first()
    assert row["formatted"] == (
        "<turn>user\nsee <image:1><audio:2><document:3></turn>\n<turn>assistant\n\\limage:1></turn>\n<turn>user\n<image:4></turn>\n<turn>user\n</turn>\n"
    )
    told = [(a["number"], a["type"], a["ref"], a["n_tokens"]) for a in row["attachments"]]
    assert told == [(1, "image", "i.png", 300), (2, "audio", "a.wav", 150), (3, "document", "v", 512), (4, "image", "j.png", 256)]
    assert row["attachment_tokens"] == 300 + 150 + 512 + 256
    (span,) = [s for s in row["spans"] if s["loss"]]
    assert row["formatted"][span["start"] : span["end"]] == "\\limage:1>"


def plain_removed(rows, min_words):
    """(doc_id, line) of all lines in runs of min_words words that stand earlier in the corpus."""
    docs = sorted({(d if d is not None else -math.inf, t or "") for d, t in rows})
    seen, gone = {}, set()
    for at, (d, t) in enumerate(docs):
        lines = [(i, x) for i, x in enumerate(t.split("\n")) if WORD.search(x)]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[i:j])
                if sum(len(WORD.findall(x)) for x in run) >= min_words:
                    if run in seen and seen[run] < (at, i):
                        gone |= {(d, n) for n, _ in lines[i:j]}
                    seen.setdefault(run, (at, i))
    return gone


def test_line_dedup(documents):
    rng = random.Random(5)
    pool = [text(rng, n, 9) for n in (1, 2, 3, 4, 7, 12, 20, 1, 5)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)] + ODD
    rows += [(200, "\n".join(pool * 3)), (201, "\n".join(pool * 3)), (201, "\n".join(pool * 3)), (None, "\n".join(pool * 3))]
    for min_words in (12, 30):
        got = line_dedup.removed_runs(documents(rows), min_words).collect()
        want = plain_removed(rows, min_words)
        texts = dict(rows)
        lines = set()
        for r in got:
            d = r["doc_id"] if r["doc_id"] is not None else -math.inf
            own = [n for n in range(r["first_line"], r["last_line"] + 1) if WORD.search(texts[r["doc_id"]].split("\n")[n])]
            assert r["n_lines"] == len(own)
            lines |= {(d, n) for n in own}
        assert lines == want
    assert line_dedup.removed_runs(documents([])).count() == 0


def test_line_dedup_of_interleaved_sources(documents):
    """Runs whose pieces come from several documents: overlapping, adjoining and nested passages."""
    rng = random.Random(35)
    sources = [[text(rng, rng.randint(1, 9), 10**6) for _ in range(14)] for _ in range(6)]
    rows = [(i, "\n".join(x)) for i, x in enumerate(sources)]
    for d in range(100, 160):
        lines = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(sources)
            at = rng.randrange(len(own))
            lines += own[at : at + rng.randint(1, 8)]
            lines += [text(rng, 4, 10**6)] * rng.choice([0, 0, 1])
        rows.append((d, "\n".join(lines)))
    for min_words in (10, 20):
        got = line_dedup.removed_runs(documents(rows), min_words).collect()
        lines = {(r["doc_id"], n) for r in got for n in range(r["first_line"], r["last_line"] + 1)}
        assert lines == plain_removed(rows, min_words)


def test_line_dedup_of_a_long_text(documents):
    """Over 1 MB each, with the second half of the one in the other."""
    rng = random.Random(36)
    lines = [text(rng, 10, 10**6) for _ in range(16_000)]
    other = [text(rng, 10, 10**6) for _ in range(8_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(other + lines[8_000:]))]
    assert min(len(t) for _, t in rows) > 1 << 20
    (run,) = line_dedup.removed_runs(documents(rows)).collect()
    assert (run["doc_id"], run["first_line"], run["last_line"], run["n_lines"]) == (2, 8_000, 15_999, 8_000)


def test_line_dedup_cuts_later_copies(documents):
    passage = text(random.Random(6), 60)
    docs = documents([(1, f"first\n{passage}\nend"), (2, f"other\n\n{passage}\ntail"), (3, "clean words"), (4, None)])
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {1: f"first\n{passage}\nend", 2: "other\n\ntail", 3: "clean words", 4: None}
    # rows that share an id and differ in text are cut each by its own runs; a hash tells which comes first
    docs = documents([(1, f"a\n{passage}"), (1, f"b\n{passage}"), (1, "c")])
    out = {r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out in ({f"a\n{passage}", "b", "c"}, {"a", f"b\n{passage}", "c"})


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def similarity_to(items):
    """similarity(window, item) by the weights of `items`, all as lists of words."""
    df = collections.Counter(g for it in items for g in set(grams(it)))
    weights = {}

    def weigh(words):
        key = tuple(words)
        if key not in weights:
            weights[key] = {g: n * math.log1p(len(items) / max(df[g], 1)) for g, n in collections.Counter(grams(words)).items()}
        return weights[key]

    def similarity(window, item):
        a, b = weigh(window), weigh(item)
        least = sum(min(x, b[g]) for g, x in a.items() if g in b)
        return least / (sum(a.values()) + sum(b.values()) - least) if a and b else 0

    return similarity


def best_windows(words, items, similarity):
    """item -> (greatest similarity, its first start) over all windows, where that is 0.8 or more."""
    own, found = set(grams(words)), {}
    for i, item in enumerate(items):
        if own & set(grams(item)):
            each = [(round(similarity(words[s : s + len(item)], item), 9), -s) for s in range(max(1, len(words) - len(item) + 1))]
            if max(each)[0] >= 0.8:
                found[i] = max(each)[0], -max(each)[1]
    return found


@pytest.mark.parametrize("inline", [True, False])
def test_decontamination(spark, documents, monkeypatch, inline):
    if not inline:
        monkeypatch.setattr(decontam, "INLINE_GRAMS", 3)
    rng = random.Random(7)
    items = [text(rng, n, 50) for n in (15, 20, 30, 30, 45, 4, 5)] + [""]
    items[3] = items[2]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    rows = [(i, text(rng, rng.randint(0, 120), 50)) for i in range(40)] + ODD
    for i, item in enumerate(items[:5]):
        rows.append((100 + i, f"{text(rng, 30)} {item.upper()}  {text(rng, 9)}"))
        words = item.split()
        words[-1] = "changed"
        rows.append((110 + i, " ".join(words)))
    rows += [(300 + i, items[0]) for i in range(50)] + [(400, items[6])]
    got = decontam.contaminated_windows(documents(rows), benchmark).collect()
    split = [t.split() for t in items]
    similarity_of = similarity_to([w for w in split if len(w) >= 5])
    want = {(d, i): x for d, t in rows for i, (x, _) in best_windows(WORD.findall((t or "").lower()), split, similarity_of).items()}
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    assert found.keys() == want.keys() and {(300, 0), (100, 4 - 4), (102, 2), (102, 3), (400, 6)} <= found.keys()
    for pair, similarity in want.items():
        assert found[pair] == pytest.approx(similarity, abs=1e-8)
    kept = decontam.decontaminate(documents(rows), benchmark)
    bad = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in bad)


def test_decontamination_of_edited_passages(spark, documents):
    """Passages with one or two words substituted, with similarities around the threshold."""
    rng = random.Random(17)
    items = [text(rng, rng.randint(15, 59)) for _ in range(60)]
    valid = [t.split() for t in items]
    similarity_of = similarity_to(valid)
    rows, want = [], {}
    while len(want) < 900:
        item = rng.choice(range(60))
        words = list(valid[item])
        for at in rng.sample(range(len(words)), rng.randint(1, 2)):
            words[at] = f"new{rng.randrange(10**6)}"
        similarity = round(similarity_of(words, valid[item]), 9)
        if 0.75 <= similarity < 0.85:
            if similarity >= 0.8:
                want[len(rows), item] = similarity
            rows.append((len(rows), " ".join(words)))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontam.contaminated_windows(documents(rows), benchmark).collect()
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    assert len(rows) > len(want) and max(r["hamming"] for r in got) > decontam.RADIUS
    assert found.keys() == want.keys()
    for pair, similarity in want.items():
        assert found[pair] == pytest.approx(similarity, abs=1e-8)


def test_decontamination_of_passages_with_insertions(spark, documents):
    """Words inserted or left out put the best window between the places where the item's words line up."""
    rng = random.Random(29)
    # 40 items of 52 words that share their first and last five: two inserted words leave 0.8019 at best,
    # and 0.7864 at the two places where the item's words line up
    head, tail = text(rng, 5, 10**6), text(rng, 5, 10**6)
    items = [f"{head} {text(rng, 42, 10**6)} {tail}" for _ in range(40)]
    valid = [t.split() for t in items]
    similarity_of = similarity_to(valid)
    inserted = [*valid[0][:26], "two", "more", *valid[0][26:]]
    assert [round(similarity_of(inserted[s : s + 52], valid[0]), 4) for s in range(3)] == [0.7864, 0.8019, 0.7864]
    rows = [(0, " ".join(inserted))]
    for d in range(1, 300):
        words = list(valid[rng.randrange(40)])
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 0, 1, 2])] = [f"new{rng.randrange(10**6)}" for _ in range(rng.randint(0, 4))]
        around = [text(rng, rng.choice([0, 3, 20])) for _ in range(2)]
        rows.append((d, f"{around[0]} {' '.join(words)} {around[1]} {items[5] if d % 50 == 0 else ''}"))
    want = {(d, i): found for d, t in rows for i, found in best_windows(t.split(), valid, similarity_of).items()}
    assert want[0, 0] == (pytest.approx(0.8019, abs=1e-4), 1)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontam.contaminated_windows(documents(rows), benchmark).collect()
    found = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in got}
    assert found.keys() == want.keys()
    for pair, (similarity, start) in want.items():
        assert found[pair] == (pytest.approx(similarity, abs=1e-8), start)
    assert 0 not in {r["doc_id"] for r in decontam.decontaminate(documents(rows), benchmark).select("doc_id").collect()}


def test_decontamination_of_a_long_text(spark, documents):
    """A text of over 1 MB with an item at its end, and with a phrase of an item repeated throughout."""
    rng = random.Random(31)
    item = text(rng, 40)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    phrase = " ".join(item.split()[:9])
    rows = [(1, text(rng, 220_000, 60_000) + " " + item), (2, " ".join([phrase] * 12_000)), (3, text(rng, 50))]
    assert len(rows[0][1]) > 1 << 20
    got = decontam.contaminated_windows(documents(rows), benchmark).collect()
    assert [(r["doc_id"], r["start"], r["similarity"]) for r in got] == [(1, 220_000, 1.0)]


def test_decontamination_with_null_and_repeated_items(spark, documents):
    rng = random.Random(23)
    a, b, c, d = (text(rng, n) for n in (20, 20, 30, 25))
    items = [(None, a), (None, b), (1, c), (2, d), (2, d), (3, c)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"{text(rng, 7)} {t} {text(rng, 9)}") for i, t in enumerate([a, b, c, d])] + [(9, text(rng, 60)), (None, a)]
    got = decontam.contaminated_windows(documents(rows), benchmark).collect()
    found = sorted((str(r["doc_id"]), str(r["item_id"]), r["n_words"], r["similarity"]) for r in got)
    assert found == [
        ("0", "None", 20, 1.0), ("1", "None", 20, 1.0), ("2", "1", 30, 1.0), ("2", "3", 30, 1.0), ("3", "2", 25, 1.0), ("None", "None", 20, 1.0)
    ]
    kept = decontam.decontaminate(documents(rows), benchmark)
    assert [r["doc_id"] for r in kept.select("doc_id").collect()] == [9]
    # rows that share an id are one document: with one of them dirty, all go
    shared = documents([(1, a), (1, text(rng, 30)), (2, text(rng, 30)), (2, text(rng, 40))])
    assert [r["doc_id"] for r in decontam.decontaminate(shared, benchmark).select("doc_id").collect()] == [2, 2]


def test_decontamination_of_nothing(spark, documents):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated_windows(documents([(1, "a b c d e f")]), empty).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated_windows(documents([]), one).count() == 0


def test_ranges_grow_with_rows(documents, monkeypatch):
    assert [sharding.range_count(n, 8, 100) for n in (0, 800, 801, 10_000)] == [8, 8, 9, 100]
    docs = documents([(i % 90, f"text {i % 60} " * (i % 7)) for i in range(300)] + ODD)
    few = sorted(map(tuple, sharding.shard_by_bytes(docs, 7).collect()), key=repr)
    monkeypatch.setattr(sharding.range_count, "__defaults__", (10,))
    assert sorted(map(tuple, sharding.shard_by_bytes(docs, 7).collect()), key=repr) == few


def test_buckets_grow_with_rows():
    assert [mixing.bucket_count(n) for n in (0, 8_388_608, 8_388_609, 10**9)] == [128, 128, 256, 16_384]


def test_mixing_of_a_long_text(documents):
    rows = [(1, "word " * 250_000, None, "a"), (2, "x y", None, "b"), (3, None, None, "b")]
    got = {r["doc_id"]: r for r in mixing.mix_sources(documents(rows)).collect()}
    assert got[1]["size"] == 250_000 and got[2]["taken"] <= 6 and got[3]["taken"] == 0
    assert got[1]["taken"] == pytest.approx(got[1]["target"], rel=0.01)


def test_chat_of_nothing_and_of_long_texts(spark):
    kind = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], kind).withColumn("parts", chat.text_parts(F.col("text")))
    assert chat.chat_digests(chat.format_chats(empty)).count() == 0
    long = "<turn>\\ é" * 130_000
    clashing = ("formatted", "spans", "turns", "seen", "begin", "head_len", "own", "attached", "written", "loss_text", "size")
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (2, None, None, None)], kind)
    df = df.withColumns({c: F.lit("own") for c in clashing}).withColumn("parts", chat.text_parts(F.col("text")))
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(df)).collect()}
    told = lambda c: tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256"))
    assert told(1) == digests([("user", long), ("assistant", long)]) and told(2) == digests([("", "")])


def test_native_plans_have_no_python(documents, spark, sf):
    docs = documents([(1, "a b c d e f")])
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for df in (mixing.mix_sources(docs), decontam.contaminated_windows(docs, benchmark), queries.op7_chat(spark, sf)):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD", "LocalRelation", "LocalTableScan"))
