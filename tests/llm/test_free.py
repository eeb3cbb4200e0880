"""Quality rules, near-dedup, token counts, toxicity and language ID against plain versions."""

import collections
import math
import random
import string
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests_llm_plain import WORD, plain_components, shingles

from claimlens.llm import langid, neardup, quality, shared, token_counts, toxicity

ODD = [
    (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "same same"), (904, "same same"), (905, "x " * 400),
    (906, "nbsp word em space"), (907, "ÇÈ Ê ʊ 東京 мир " * 9), (908, "a" * 5000), (909, "  two  spaces \n\n lines\n lines"),
]


def text(rng, n, vocabulary=400):
    return " ".join(f"word{rng.randrange(vocabulary)}" for _ in range(n))


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    for module in (shared, quality):
        monkeypatch.setattr(module, "SLICE_BYTES", 3000)


def plain_quality(value):
    words = WORD.findall(value or "")
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, repeats = set(), 0
    for line in (value or "").split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in value or "")
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, repeats, len(covered), failed


def test_quality_measures(documents):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.randint(0, 90), rng.choice([3, 400])) + "\n#a$" * rng.randint(0, 3)) for i in range(80)] + ODD
    got = quality.quality_measures(documents(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == collections.Counter((d, *plain_quality(t)) for d, t in rows)
    bpe, pieces, _ = quality._encoders(quality.TOKENIZERS)
    for r in got:
        words = WORD.findall(dict(rows)[r["doc_id"]] or "")
        tokens = [t for w in words for t in bpe.encode_ordinary(" " + w)]
        counts = collections.Counter(tokens)
        bits = -sum(n / len(tokens) * math.log2(n / len(tokens)) for n in counts.values()) if tokens else 0
        assert r["token_entropy"] == pytest.approx(bits, abs=1e-9)
        assert r["chars_per_token"] == pytest.approx(sum(map(len, words)) / max(len(tokens), 1))
        assert r["kept"] <= (not r["base_failed"])
    assert quality.quality_measures(documents([])).count() == 0


def plain_fertility(value):
    """Script, characters per piece, byte share, letters per token and the verdict, word by word."""
    bpe, pieces, is_byte = quality._encoders(quality.TOKENIZERS)
    words = WORD.findall(value or "")
    votes = collections.Counter()
    chars = n_pieces = n_bytes = letters = 0
    tokens = []
    for w in words:
        votes[next((name for c in w if c.isalpha() for name, (span, *_) in quality.BANDS.items() if span[0] <= ord(c) <= span[1]), "other")] += 1
        chars += len(w)
        letters += sum(c.isalpha() for c in w)
        ids = pieces.encode(w)
        n_pieces, n_bytes = n_pieces + len(ids), n_bytes + sum(bool(is_byte[i]) for i in ids)
        tokens += bpe.encode_ordinary(" " + w)
    script = max(quality.SCRIPTS, key=lambda name: (votes[name], -quality.SCRIPTS.index(name)))
    by_token, by_letter = chars / max(len(tokens), 1), letters / max(len(tokens), 1)
    by_piece, share = chars / max(n_pieces, 1), n_bytes / max(n_pieces, 1)
    bits = -sum(n / len(tokens) * math.log2(n / len(tokens)) for n in collections.Counter(tokens).values())
    _, (low, high), letter, piece, most, least = quality.BANDS[script]
    fits = low <= by_token <= high and by_letter >= letter and by_piece >= piece and share <= most and (len(tokens) < 100 or bits >= least)
    return script, by_piece, share, by_letter, fits and not plain_quality(value)[-1]


def test_quality_fertility_and_bands(documents):
    rng = random.Random(21)
    alphabets = ["abcdefgh", "ABCDEFGH#%", "αβγδεζ", "абвгдежз", "אבגדה", "東京大学", "éüößñ", "0123456789", "😀👍#", "\u0378\ue000"]
    rows = []
    for i in range(160):
        some = rng.choices(alphabets, k=rng.randint(1, 3))
        words = ["".join(rng.choices(rng.choice(some), k=rng.randint(1, 9))) for _ in range(rng.choice([0, 3, 15, 60, 150]))]
        rows.append((i, " ".join(words)))
    rows += ODD
    texts = {d: t for d, t in rows}
    got = quality.quality_measures(documents(rows)).collect()
    verdicts = set()
    for r in got:
        script, by_piece, share, by_letter, kept = plain_fertility(texts[r["doc_id"]])
        assert (r["script"], r["kept"]) == (script, kept), r
        for name, want in (("chars_per_piece", by_piece), ("byte_share", share), ("letters_per_token", by_letter)):
            assert r[name] == pytest.approx(want), name
        verdicts.add((r["script"], r["kept"]))
    assert len(verdicts) >= 7


def test_long_texts_and_empty_tables(spark, documents):
    """Texts of over 1 MB through every operator here, and no rows at all."""
    rng = random.Random(22)
    words = [f"w{rng.randrange(10**6)}" for _ in range(160_000)]
    edited_words = [w if rng.random() > 0.01 else "changed" for w in words]
    long, copy = " ".join(words), " ".join(edited_words)
    docs = documents([(1, long), (2, copy), (3, "short text here"), (4, "alpha beta " * 100_000), (5, "alpha beta " * 3), (6, "alpha beta " * 2)])
    assert min(map(len, (long, copy))) > 1 << 20
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert near[1] == (len(shingles(long, 5)), 1) and near[2][1] == 1 and near[4] == (2, 4)
    measured = {r["doc_id"]: r for r in quality.quality_measures(docs).collect()}
    assert measured[1]["n_words"] == 160_000 and measured[4]["n_repeat_words"] == 200_000
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()}
    assert counted[4] == counted[6] + 99_998 * (counted[5] - counted[6])
    scored = toxicity.score_toxicity(docs, toxicity.Boosted(0.0, 0.2)).collect()
    assert len(scored) == 6 and {r["score"] for r in scored} == {0.5}
    none = documents([])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)).count() == 0
    assert token_counts.token_counts(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0


def test_quality_verdicts(documents):
    prose = (
        "The council met on Tuesday to discuss how the old harbour could be repaired before winter, and several "
        "people from the village asked whether the money would be enough to pay for a new wall along the shore."
    )
    noise = " ".join(f"{w[:2].upper()}##{w[-1:]}%%$&" for w in prose.split())
    docs = documents([(1, prose), (2, noise), (3, None), (4, "Пароход вышел из порта рано утром, и никто не знал, когда он вернётся домой снова.")])
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_measures(docs).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True}
    out = quality.keep_quality(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 4]


def edited(rng, words, rate):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < rate else w for w in words.split())


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(documents, n):
    rng = random.Random(n)
    rows = [(i, text(rng, rng.randint(1, 120))) for i in range(60)] + ODD
    for family in range(6):
        base = text(rng, 150)
        # the original has the greatest id, so that it is not the smallest of any bucket
        rows += [(1000 * (family + 1) + k, edited(rng, base, rng.choice([0.005, 0.02, 0.06]))) for k in range(25)]
        rows.append((1000 * (family + 1) + 99, base))
    rows += [(8000 + k, "Exact  Copy of a\ttext".swapcase() if k % 2 else "exact copy of A text") for k in range(40)]
    rows += [(9000, rows[5][1]), (9000, rows[6][1])]
    docs = documents(rows)
    got = neardup.near_duplicates(docs, shingle=n).collect()
    want = plain_components(rows, n)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    for r in got:
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == collections.Counter((d, len(shingles(t, n))) for d, t in rows)
    out = neardup.drop_near_duplicates(docs, shingle=n)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(want.values())


def test_near_duplicates_of_null_and_empty(documents):
    assert neardup.near_duplicates(documents([])).count() == 0
    got = neardup.near_duplicates(documents([(None, "a b"), (None, "a b"), (3, None), (4, "")])).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["3", "4", "None", "None"] and all(r["kept"] for r in got)


def test_links_apart_from_the_hub_are_found(documents):
    """Heavily edited members that link with each other and not with the family's hub."""
    rng = random.Random(9)
    base = text(rng, 200)
    rows = [(k, edited(rng, base, 0.04)) for k in range(60)] + [(999, base)]
    for pair in range(12):
        odd = edited(rng, base, 0.09)
        rows += [(100 + 10 * pair + k, edited(rng, odd, 0.015)) for k in range(3)]
    got = neardup.near_duplicates(documents(rows), shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(rows, 2)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_token_counts_match_the_tokenizer(documents):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, models

    model = SentencePieceProcessor(model_file=f"{quality.TOKENIZERS}/piece_bpe_32k.model")
    usual = [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    ]
    least = min(s for _, s in usual)
    vocabulary = [("<unk>", least), *((f"<0x{b:02X}>", least) for b in range(256)), *usual]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    rng = random.Random(2)
    letters = "abcdefghijklmnop      étñü東ʊ\n., "
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 300)))) for i in range(60)] + [r for r in ODD if r[0] != 908]
    got = {(r["doc_id"], r["n_tokens"], r["n_chars"]) for r in token_counts.token_counts(documents(rows)).collect()}
    for d, t in rows:
        marked = token_counts.SPACE + t.replace(" ", token_counts.SPACE) if t else ""
        assert (d, len(tokenizer.encode(marked, add_special_tokens=False).ids) if t else 0, len(t or "")) in got


def test_token_ties_and_unknowns():
    counter = token_counts.UnigramCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("▁a", -2.0)])
    # equal scores: the piece that starts first wins
    assert counter.text("ab") == 2 and counter.text("") == 0 and counter.text("a b") == 3
    assert counter.text("é") == 3 and counter.text("東") == 4
    with pytest.raises(ValueError):
        token_counts.UnigramCounter([("a▁b", -1.0)])


def labelled(spark, documents, n=600):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = text(rng, rng.randint(20, 80)).split()
        for _ in range(rng.randint(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "You MORON!", "st*pid", "1diot", "scum."]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return documents(rows + ODD), spark.createDataFrame([*marks, (900, None), (5, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1)), dict(marks)


def test_toxicity_on_the_held_out_fold(spark, documents):
    docs, labels, truth = labelled(spark, documents)
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(got) == 600 + len(ODD)
    tested = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) >= 0.97 * len(tested)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, flipped)).collect()
    assert {(r["doc_id"], r["score"]) for r in again} == {(r["doc_id"], r["score"]) for r in got}


def test_toxicity_without_labels(spark, documents):
    docs, labels, _ = labelled(spark, documents, 20)
    for few, want in ((labels.limit(0), 0.5), (labels.filter("toxic = 0"), 0.0)):
        scores = {round(r["score"], 4) for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, few)).collect()}
        assert scores == {want}


def plain_features(value, lexicon):
    """The features of a text, word by word."""
    words = WORD.findall(value)
    kinds = [toxicity.word_kind(w, lexicon) for w in words]
    n, chars = max(len(words), 1), max(len(value), 1)
    bad = [k[0] or k[2] for k in kinds]
    near = sum(b and any(k[3] for k in kinds[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, b in enumerate(bad))
    count = lambda at: sum(k[at] for k in kinds)
    insults = sum(bad)
    return [
        insults / n, math.log1p(insults), len({w for w, b in zip(words, bad, strict=True) if b}), near / n, count(1) / n, count(2) / n, count(3) / n,
        count(4) / n, sum(unicodedata.category(c) == "Lu" for c in value) / chars, value.count("!") / chars, value.count("?") / chars,
        sum(c in string.punctuation for c in value) / chars, count(5) / n, math.log1p(len(words)), count(6) / n, math.log1p(count(6)),
        len({w for w, k in zip(words, kinds, strict=True) if k[6]}),
    ]


def test_toxicity_features():
    rng = random.Random(14)
    pool = ["idiot", "You", "st*pid", "1diot", "KILL", "river,", "LAKE", "zorgle", "zorgling", "a-b", "it's", "!!!", "Ünder", "b@d", "?", "du", "42"]
    values = ["", " ", *(" ".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(60))]
    lexicon = frozenset({"zorg*"})
    got = toxicity.features(pa.array(values, pa.large_string()), {}, lexicon)
    assert got.shape == (len(values), len(toxicity.FEATURES))
    for row, value in zip(got, values, strict=True):
        assert row.tolist() == pytest.approx(plain_features(value, lexicon))
    kinds = {w: toxicity.word_kind(w, lexicon) for w in pool}
    flags = ("insult", "threat", "hidden", "second", "capital", "disguised", "learned")
    told = {w: {f for f, x in zip(flags, k, strict=True) if x} for w, k in kinds.items()}
    assert told["idiot"] == {"insult"} and told["1diot"] == {"hidden", "disguised"} == told["st*pid"] and told["You"] == {"second"}
    assert told["KILL"] == {"threat", "capital"} and told["LAKE"] == {"capital"} and told["zorgling"] == {"learned"}
    assert not (told["river,"] or told["a-b"] or told["it's"] or told["42"] or told["!!!"])


def test_boosting_takes_the_best_split_and_walks_its_trees():
    rng = np.random.default_rng(15)
    x = np.round(rng.random((240, 4)), 2)
    y = (x[:, 2] + 0.3 * x[:, 0] + 0.2 * rng.random(240) > 0.8).astype(np.int64)
    model = toxicity.fit(x, y, trees=1, depth=1)
    train = np.random.default_rng(5).permutation(len(y)) % 4 != 0
    tx, ty = x[train], y[train]
    p = 1 / (1 + math.exp(-model.base))
    assert p == pytest.approx(ty.mean())

    def gain(f, cut):
        sides = [ty[tx[:, f] <= cut] - p, ty[tx[:, f] > cut] - p]
        part = lambda g: g.sum() ** 2 / (len(g) * p * (1 - p) + 1)
        return part(sides[0]) + part(sides[1]) - part(ty - p)

    (feature, cut, leaf), = model.cuts
    best = max(gain(f, c) for f in range(4) for c in np.unique(np.quantile(tx[:, f], np.linspace(0, 1, 65))[:-1]))
    assert gain(feature[0], cut[0]) == pytest.approx(best)
    for side, value in zip((tx[:, feature[0]] <= cut[0], tx[:, feature[0]] > cut[0]), leaf, strict=True):
        assert value == pytest.approx((ty[side] - p).sum() / (side.sum() * p * (1 - p) + 1))
    deep = toxicity.fit(x, y, trees=6, depth=3)

    def walk(row):
        total = deep.base
        for feature, cut, leaf in deep.cuts:
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
            total += deep.rate * leaf[at - len(feature)]
        return total

    assert deep.raw(x).tolist() == pytest.approx([walk(row) for row in x])


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 30, 400).astype(float)
    knots, values = toxicity.isotonic(x, (rng.random(400) < x / 30).astype(float))
    assert (np.diff(values) >= 0).all() and len(knots) == len(values)


def test_suffix_automaton():
    reference = "abcabxabcd"
    parts = {reference[i:j] for i in range(len(reference)) for j in range(i + 1, len(reference) + 1)}
    automaton = langid.SuffixAutomaton(reference)
    rng = random.Random(4)
    for _ in range(300):
        value = "".join(rng.choices("abcdxq", k=rng.randint(0, 14)))
        want = plain_phrases(value, parts)
        assert automaton.phrases(value) == want


def plain_phrases(value, parts):
    """Greedy longest matches over a set of all substrings; an unknown character is a phrase."""
    count = i = 0
    while i < len(value):
        j = i + 1
        while j < len(value) and value[i : j + 1] in parts:
            j += 1
        count, i = count + 1, j
    return count


def test_language_predictions_match_a_plain_parse(documents):
    rng = random.Random(12)
    references = {lang: " " + " ".join("".join(rng.choices(s, k=2)) for _ in range(25)) + " " for lang, s in SYLLABLES.items()}
    references["ab"] = references["aa"]
    parts = {lang: {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)} for lang, t in references.items()}
    rows = []
    for i in range(120):
        words = references[rng.choice(sorted(references))].split()
        at = rng.randrange(len(words))
        extra = ["".join(rng.choices("abkröüxq9-", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 4))]
        # runs of the reference as they stand, so that phrases go across words
        rows.append((i, ", ".join(words[at : at + rng.randint(1, 8)] + extra).upper()))
    rows += [(200, "ZZZ"), (201, "é"), (202, rows[0][1]), (202, rows[0][1]), *ODD]
    got = collections.Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.predict_languages(documents(rows), references).collect())
    want = collections.Counter()
    for d, t in rows:
        plain = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        if not plain:
            want[d, "und", 0.0] += 1
            continue
        value = f" {' '.join(plain)} "
        rate = {lang: plain_phrases(value, parts[lang]) / len(value) for lang in references}
        best = min(sorted(rate), key=rate.get)
        want[d, best, round(1 / sum(math.exp(-langid.SHARPNESS * (x - rate[best])) for x in rate.values()), 9)] += 1
    assert got == want and "ab" not in {lang for _, lang, _ in got}


def test_languages_are_bounded_and_repeats_count_once(documents):
    docs = documents([(i, f"word number {'abcdefghij'[i % 10]}", f"l{i}") for i in range(40) if not is_held_out(i)])
    with pytest.raises(ValueError):
        langid.fit_languages(docs, max_languages=5)
    rows = [(i, "eins zwei drei vier fünf", "de") for i in range(30) if not is_held_out(i)] + [(1, "eins zwei drei vier fünf", "de")] * 200
    learned = langid.fit_languages(documents(rows))
    assert learned["de"].count("drei") == len({d for d, *_ in rows})
    assert len(langid.fit_languages(documents(rows), sample_rows=5, excerpt_chars=9)["de"]) <= 5 * 11
    assert langid.fit_languages(documents([])) == {}
    assert langid.predict_languages(documents([]), learned).count() == 0


def test_language_of_a_long_text(documents):
    rng = random.Random(13)
    references = {lang: " " + " ".join("".join(rng.choices(s, k=2)) for _ in range(300)) + " " for lang, s in SYLLABLES.items()}
    long = " ".join("".join(rng.choices(SYLLABLES["bb"], k=2)) for _ in range(190_000))
    assert len(long) > 1 << 20
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(documents([(1, long), (2, "öl ün")]), references).collect()}
    assert got == {1: "bb", 2: "cc"}


SYLLABLES = {"aa": ["ba", "do", "ri", "ne"], "bb": ["kru", "sta", "zhe", "mno"], "cc": ["öl", "ün", "şe", "çi"]}


def test_language_on_the_held_out_fold(spark, documents):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))).capitalize() for _ in range(rng.randint(5, 40))]
        rows.append((i, ", ".join(words), lang if i % 10 else None))
    docs = documents(rows + [(900, None), (901, "123 !! --"), (902, "")])
    got = {r["doc_id"]: r for r in langid.predict_languages(docs, langid.fit_languages(docs)).collect()}
    for d in (900, 901, 902):
        assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
    tested = [r for r in rows if is_held_out(r[0]) and r[2]]
    assert sum(got[d]["lang_pred"] == lang for d, _, lang in tested) >= 0.98 * len(tested)
    assert all(r["held_out"] == is_held_out(d) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert {r["lang_pred"] for r in langid.predict_languages(docs, {}).collect()} == {"und"}


def test_words_match_the_pattern():
    values = [t or "" for _, t in ODD]
    words = shared.Words(pa.array(values, pa.large_string()))
    got = [[words.distinct[c] for c in words.codes[a:b]] for a, b in zip(words.starts, words.starts[1:], strict=False)]
    assert got == [WORD.findall(t) for t in values]
