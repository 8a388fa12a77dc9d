"""Language identification, the quality classifier and BPE."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lithospark.llm.bpe import Codec, encode_decode, op5_bpe, tokenizer_json
from lithospark.llm.language import identify, learn, op2_language_id
from lithospark.llm.quality import ABSTAIN, BAD, GOOD, LABELLERS, WeakLabels, judge, measures, op10_quality_classifier

from .conftest import prose


def test_languages_are_told_apart(docs, spark):
    got = {r.doc_id: r for r in identify(docs, learn(docs.where("doc_id < 40"))).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (60, 61, 62))
    assert got[0]["host"] == "extra"


def test_unknown_words_back_off(docs):
    model = learn(docs.where("doc_id < 60"))
    assert model.predict("greenstone")[0] == "en" and model.predict("rivièrez")[0] == "fr"
    assert model.predict("日本")[0] in ("en", "fr")


@pytest.mark.parametrize("vocabulary", [1, 7, 39, 40, 41])
def test_a_vocabulary_is_filled(spark, vocabulary):
    from lithospark.llm.language import _frequent

    words = [f"{a}{b}nd{c}" for a in "abcd" for b in "eiou" for c in "xyz"][:40]
    docs = spark.createDataFrame([(" ".join(words), "en")], "text string, lang string")
    model = learn(docs, vocabulary=vocabulary)
    for length, grams in model.rows.items():
        assert len(grams) <= 2 * vocabulary, length
    # Every word stands once, so none comes before another; nearly as many as fit are kept.
    assert len(model.rows.get(0, {})) >= min(vocabulary, 40) - 2
    counts = spark.createDataFrame([("k", f"g{i}", 1 + i // 10) for i in range(100)] + [("l", "h", 1)], "key string, gram string, n long")
    kept = [(r.key, r.n) for r in _frequent(counts, ["key"], 25).collect()]
    assert kept.count(("k", 10)) == 10 and kept.count(("k", 9)) == 10 and 3 <= kept.count(("k", 8)) <= 5 and ("l", 1) in kept and len(kept) <= 26


def test_rare_languages_are_learned_beside_large_ones(spark):
    pick = random.Random(14)
    word = lambda letters: "".join(pick.choice(letters) for _ in range(4))
    large, rare = [word("abcde") for _ in range(200)], [word("defgh") for _ in range(20)]
    text = lambda words: " ".join(pick.choice(words) for _ in range(30))
    rows = [(text(large), "large") for _ in range(2000)] + [(text(rare), "rare") for _ in range(10)] + [("gggg " * 30, "large")] * 1000
    model = learn(spark.createDataFrame(rows, "text string, lang string"), most=50, vocabulary=40)
    assert all(model.predict(text(rare))[0] == "rare" for _ in range(20))
    assert all(model.predict(text(large))[0] == "large" for _ in range(20))
    assert all(len(grams) <= 80 for grams in model.rows.values())
    # The repeated text counts once, and the prior is that of all different texts.
    assert model.languages == ["large", "rare"] and abs(float(np.exp(model.prior[0])) - 2001 / 2011) < 0.003


def plain_backoff(rows):
    """A predictor that counts and backs off by dictionaries alone."""
    import regex

    counts = {}
    for text, lang in set(rows):
        for word in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
            padded = f"_{word}_"
            for n, gram in [(0, word)] + [(n, padded[i : i + n]) for n in range(1, 6) for i in range(len(padded) - n + 1)]:
                counts.setdefault(n, {}).setdefault(gram, Counter())[lang] += 1
    langs = sorted({lang for _, lang in rows})
    mass = {n: Counter() for n in counts}
    for n, grams in counts.items():
        for c in grams.values():
            mass[n].update(c)
    log = lambda n, gram, lang: np.log(counts[n][gram][lang] + 0.1) - np.log(mass[n][lang] + 0.1 * (len(counts[n]) + 1))

    def predict(text):
        sums = {lang: np.log(mass[0][lang] / sum(mass[0].values())) for lang in langs}
        for word in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
            found, padded = [(0, word)] if word in counts[0] else [], f"_{word}_"
            for n in range(min(5, len(padded)), 0, -1):
                found = found or [(n, padded[i : i + n]) for i in range(len(padded) - n + 1) if padded[i : i + n] in counts[n]]
            for lang in langs:
                sums[lang] += np.mean([log(n, g, lang) for n, g in found]) if found else 0
        best = max(langs, key=lambda lang: sums[lang])
        return best, 1 / sum(np.exp(sums[lang] - sums[best]) for lang in langs)

    return predict


def test_predictions_like_a_plain_backoff(docs, rows):
    model, plain = learn(docs), plain_backoff([(r[1], r[2]) for r in rows if r[1] and r[2]])
    texts = ["house", "maisonette greenish", "xyzzy qwrt", "Ärger im Haus", "日本 語", "stone stone stone rivière", prose("fr", 40, 999), "the " * 50_000]
    for text in texts:
        (lang, score), (want, sure) = model.predict(text), plain(text)
        assert lang == want and score == pytest.approx(sure), text
    assert model.predict("12 !?") == ("und", 0.0)


def test_ties_copies_and_long_texts(spark):
    model = learn(spark.createDataFrame([("aa bb", "x"), ("aa bb", "y"), ("aa bb", "y")], "text string, lang string"))
    assert model.predict("aa") == ("x", pytest.approx(0.5)) and model.predict("aa bb " * 100_000)[0] == "x"
    got = identify(spark.createDataFrame([("aa",), ("aa",), ("bb " * 200_000,)], "text string"), model).collect()
    assert [r.lang_pred for r in got] == ["x"] * 3 and got[0] == got[1]


def test_language_of_nothing(none, docs):
    model = learn(none)
    assert identify(none, model).count() == 0
    assert {r.lang_pred for r in identify(docs, model).collect()} == {"und"}


def test_op2_learns_only_from_the_rest(spark, folder, rows):
    got = op2_language_id(spark, folder).collect()
    assert len(got) == len(rows)
    from zlib import crc32

    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def junk(kind: int, seed: int) -> str:
    words = prose("en", 80, seed).split()
    return " ".join([f"{w}***" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [f"{w} |" for w in words] if kind == 2 else ["same"] * 80)


def test_junk_goes_and_prose_stays(spark):
    pairs = [(i, prose("en" if i % 2 else "fr", 20 + i % 200, i), 1) for i in range(400)] + [(1000 + i, junk(i % 4, i), 0) for i in range(60)]
    got = {r.doc_id: r.kept for r in judge(spark.createDataFrame(pairs, "doc_id long, text string, y int")).collect()}
    assert sum(got[i] == bool(y) for i, _, y in pairs) >= 0.99 * len(pairs)
    assert all(got[i] for i, _, y in pairs if y)


def test_quality_of_odd_cases(docs, none):
    got = {r.doc_id: r for r in judge(docs).collect()}
    assert all(not got[i].kept and got[i].quality == 0 for i in (60, 61, 62))
    assert all(0 <= r.quality <= 1 and 0 <= r.weak_label <= 1 for r in got.values())
    assert got[1]["host"] == "extra" and got[1]["kept"] is True
    assert judge(none).count() == 0


def plain_em(patterns, rounds=200):
    """Two classes and independent votes, by loops over documents' patterns."""
    names = range(len(LABELLERS))
    good = {p: 0.02 if BAD in p else 0.98 for p in patterns}
    for _ in range(rounds):
        mass = {GOOD: sum(n * good[p] for p, n in patterns.items()), BAD: sum(n * (1 - good[p]) for p, n in patterns.items())}
        odds = {}
        for c in (GOOD, BAD):
            for k in names:
                said = {v: sum(n * (good[p] if c == GOOD else 1 - good[p]) for p, n in patterns.items() if p[k] == v) for v in (GOOD, BAD)}
                said[c] += 1.0
                said[1 - c] += 0.5
                odds[c, k] = {v: x / sum(said.values()) for v, x in said.items()}
        for p in patterns:
            like = {}
            for c in (GOOD, BAD):
                like[c] = (mass[c] + 1) / (sum(mass.values()) + 2)
                for k in names:
                    like[c] *= odds[c, k].get(p[k], 1)
            good[p] = like[GOOD] / (like[GOOD] + like[BAD])
    return good, [(odds[BAD, k][BAD], odds[GOOD, k][GOOD]) for k in names]


def test_weak_labels_like_a_plain_em():
    votes = lambda t: tuple(vote(next(measures([t.encode()]))[0]) for vote in LABELLERS.values())
    texts = [prose("en", 8 + i % 100, i) for i in range(200)] + [junk(i % 4, i) for i in range(40)] + ["AB C!! " * 9, "| x y z w v u t s r q p", "1 2 3"]
    patterns = Counter(map(votes, texts))
    model = WeakLabels(patterns)
    good, right = plain_em(patterns)
    assert np.allclose(model.posterior(np.array(list(good))), list(good.values()))
    assert np.allclose(list(model.accuracies().values()), right)
    assert good[votes(junk(0, 1))] < 0.01 < 0.99 < good[votes(prose("en", 100, 1))]
    assert WeakLabels({}).posterior(np.array([votes("x")])).shape == (1,)


def test_weak_labels_recover_known_accuracies():
    rng = np.random.default_rng(5)
    n, k = 60_000, len(LABELLERS)
    good = rng.random(n) < 0.8
    known = {BAD: rng.uniform(0.3, 0.95, k), GOOD: rng.uniform(0.9, 0.999, k)}
    right = rng.random((n, k)) < np.where(good[:, None], known[GOOD], known[BAD])
    votes = np.where(right == good[:, None], GOOD, BAD)
    votes[rng.random((n, k)) < 0.2] = ABSTAIN
    model = WeakLabels(Counter(map(tuple, votes.tolist())))
    found = np.array(list(model.accuracies().values()))
    assert np.abs(found[:, 0] - known[BAD]).max() < 0.03 and np.abs(found[:, 1] - known[GOOD]).max() < 0.01
    assert found[:, 0].max() - found[:, 0].min() > 0.3
    assert ((model.posterior(votes) > 0.5) == good).mean() > ((votes != BAD).all(axis=1) == good).mean()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_agrees_with_labels_it_has_not_seen(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    got = op10_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.label == 1) for r in got) >= 0.98 * len(got) and all(r.kept for r in got if r.label == 1)


def test_repetition_that_starts_late_is_seen(spark):
    pick = random.Random(17)
    cycle = lambda: " ".join(f"w{pick.randrange(3000)}".replace("0", "o") for _ in range(5)) + " "
    rich = lambda i: " ".join(prose("en", 100, 10 * i + k) for k in range(10)) + " "
    rows = [(i, prose("en", 50 + i, i)) for i in range(300)] + [(300 + i, junk(i % 4, i)) for i in range(40)] + [(400 + i, cycle() * 40) for i in range(12)]
    rows += [(900, rich(900) + "again " * 20_000), (901, rich(901) + cycle() * 4000), (902, rich(902) * 1 + rich(903) + rich(904))]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[900].kept and not got[901].kept and got[902].kept


def test_few_different_words_are_seen_anywhere():
    pick = random.Random(11)
    rich = lambda n: " ".join(f"w{pick.randrange(5000)}" for _ in range(n))
    poor = lambda n: "one two three four " * (n // 4)
    texts = [rich(1000) + " " + poor(3000), rich(1000) + " " + poor(1500), poor(1000) + rich(4000), rich(5003), poor(5003), rich(40) + " " + poor(900)]
    found = [f for f, _ in measures([t.encode() for t in texts])]
    assert [LABELLERS["few different words"](f) for f in found] == [BAD, BAD, GOOD, GOOD, BAD, BAD]
    for f, text in zip(found, texts, strict=True):
        words = text.split()
        ends = [*range(1000, len(words), 1000), len(words)]
        shares = [len(set(words[max(0, e - 1000) : e])) / min(1000, len(words)) for e in ends]
        adds = [b - a for a, b in zip([0, *ends], ends)]
        assert f["distinct"] == pytest.approx(sum(s * a for s, a in zip(shares, adds, strict=True)) / len(words))


SCRIPTS = {
    "zh": ("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "", "。"), "th": ("กขคงจชซญดตถทธนบปผพภมยรลวสหอ", "", " "),
    "ja": ("あいうえおかきくけこさしすせそたちつてとなにぬねの山川田", "", "。"), "ka": ("აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", " ", ". "),
}


def beyond_ascii(script: str, seed: int) -> str:
    pick = random.Random(seed)
    letters, gap, stop = SCRIPTS[script]
    word = lambda: "".join(pick.choice(letters) for _ in range(9 if gap else 2))
    return "".join(gap.join(word() for _ in range(pick.randrange(6, 15))) + stop for _ in range(pick.randrange(3, 20)))


@pytest.mark.parametrize("share", [0.01, 0.3])
def test_clean_documents_beyond_ascii_stay(spark, share):
    n = int(1000 * share)
    rows = [(i, beyond_ascii([*SCRIPTS][i % 4], i)) for i in range(n)] + [(i, prose("en" if i % 2 else "fr", 20 + i % 200, i)) for i in range(n, 950)]
    rows += [(i, junk(i % 4, i)) for i in range(950, 1000)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].kept and got[i].weak_label > 0.5 for i in range(950))
    assert not any(got[i].kept for i in range(950, 1000))


def test_lengths_are_in_letters():
    found = [f["length"] for f, _ in measures(["é😀 日本語x abc".encode(), b"", "ქართული".encode()])]
    assert found == [3, 0, 7]


def test_op10(spark, folder, rows):
    assert op10_quality_classifier(spark, folder).count() == len(rows)


@pytest.fixture(scope="module")
def both():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return Codec(tokenizer_json()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_library(both):
    pick = random.Random(3)
    texts = ["", " ", "a<|endoftext|>b <|endoftext|>", "aaaaaaa bbbbbbbb", "I'll don't\n\n x\x1c\x85", "😀 日本語 ½"]
    texts += ["".join(pick.choice("ab é\n\t 1'!<|>😀日") for _ in range(50)) for _ in range(500)]
    texts += [chr(c) + "a " + chr(c) for c in range(1, 0x3000, 7)]
    own, library = both
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(own.encode_batch(texts)) == want
    assert [own.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_round_trip_and_digests(both, docs, rows, none):
    got = {(r.doc_id, r.decoded): r for r in encode_decode(docs).collect()}
    for i, text, *_ in rows:
        r = got[i, text or ""]
        ids = both[1].encode(text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_decode(none).count() == 0


def test_op5(spark, folder, rows):
    assert op5_bpe(spark, folder).count() == len(rows)
