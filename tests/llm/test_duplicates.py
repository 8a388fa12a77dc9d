"""Fingerprints, near duplicates and repeated passages against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithospark.llm.components import components
from lithospark.llm.fingerprints import _TOP, SCALE, Sketch, edit_likeness, fingerprints, likeness, merged, op4_fingerprints, sketches
from lithospark.llm.near_dedup import Block, drop_near_duplicates, near_duplicates, op7_minhash_near_dedup
from lithospark.llm.shingles import Words, shingle_sets
from lithospark.llm.substring_dedup import PASSAGE, RUN, WINDOW, _keys, drop_repeated_passages, op6_substring_dedup, units

from .conftest import COLUMNS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def random_text(pick, n, words=5000):
    return " ".join(f"w{pick.randrange(words)}" for _ in range(n))


def family(pick, base, n, changes):
    """Copies of a text with some words changed, from few to many."""
    made = []
    for k in range(n):
        words = base.split()
        for _ in range(changes * k // n):
            words[pick.randrange(len(words))] = f"x{pick.random()}"
        made.append(" ".join(words))
    return made


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_shingle_sets_are_whole_and_exact():
    pick = random.Random(1)
    texts = ["", " \n", "One", "one two", "a b c d e", "A b\tC\x0bd\x0ce f", random_text(pick, 3000), random_text(pick, 3000) * 3, "é" * 10 + " x y z w v"]
    sizes = [len(s) for s in shingle_sets([t.encode() for t in texts])]
    assert sizes == [len(shingles(t)) for t in texts]
    a, b = shingle_sets(["THE big  dog ran off".encode(), "the\nbig dog ran off".encode()])
    assert a.tolist() == b.tolist()


def test_components(spark):
    pick = random.Random(2)
    linked = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(linked, "a long, b long")).collect()}
    want = roots({x for e in linked for x in e}, linked)
    assert all(got[i] == want[i] for i in got)
    assert {i for i in want if any(i in e and e[0] != e[1] for e in linked)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_lose_no_link(spark):
    pick = random.Random(4)
    texts = [random_text(pick, 120) for _ in range(60)]
    for changes in (4, 10, 24):
        texts += family(pick, random_text(pick, 200), 60, changes)
    texts += [texts[70]] * 5 + ["one two", "One  two", "three", "a b c d e f g", "a b c d e f g h", "", None]
    pick.shuffle(texts)
    sets = [shingles(t) for t in texts]
    linked = [
        (i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    want = roots(range(len(texts)), linked)
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def test_null_and_repeated_ids_link(spark):
    pick = random.Random(18)
    text = random_text(pick, 90).split()
    chain = [" ".join(text[k : k + 70]) for k in (0, 5, 10, 15, 20)]  # each is linked to its neighbours alone
    other = random_text(pick, 60)
    rows = [(5, chain[0]), (None, chain[1]), (9, chain[2]), (9, other), (9, chain[3]), (7, chain[4]), (3, other), (9, other), (None, "w x y z"), (None, "w x y z"), (None, "w x y z v")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, first string")
    sets = [shingles(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    groups = roots(range(len(rows)), linked)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in groups if groups[m] == groups[k] and rows[m][0] is not None]
        want[i, len(sets[k]), min(ids, default=None), bool(ids) and i == min(ids)] += 1
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == want and (None, 66, 5, False) in got and (None, 1, None, False) in got
    left = drop_near_duplicates(df)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(5, chain[0]), (3, other), (None, "w x y z"), (None, "w x y z v")], key=str)
    assert left.columns == df.columns


def test_near_duplicates_stand_odd_cases(docs, rows, none):
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[63].component_id == 5 and not by[63].kept and by[60].kept and by[60].n_shingles == 0 and by[61].component_id == 61
    assert by[None].kept is False and by[65].n_shingles == 1
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and 63 not in {r.doc_id for r in left.collect()} and left.where("doc_id is null").count() == 1
    assert left.where("doc_id = 64").count() == 1 and left.where("doc_id in (60, 61, 62)").count() == 3


def test_op7(spark, folder, rows):
    got = op7_minhash_near_dedup(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert got.count() == len(rows)


def test_blocks_find_what_a_plain_loop_finds():
    pick = random.Random(5)
    texts = family(pick, random_text(pick, 150), 32, 30)
    members = [(i, i, s) for i, s in enumerate(shingle_sets([t.encode() for t in texts]))]
    block = Block(members)
    got = {frozenset(x) for m in members for x in block.links(*m)}
    sets = [shingles(t) for t in texts]
    assert got == {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert list(Block([]).links(1, 1, members[0][2])) == []


def test_sketches_estimate_containment():
    pick = random.Random(6)
    whole = random_text(pick, 9000)
    part = " ".join(whole.split()[:700])
    a, b, c = sketches([whole, part, random_text(pick, 2000)])
    assert a.likeness(b) > 0.95 and b.likeness(c) == 0 and a.likeness(a) == 1
    assert str(Sketch.parse(str(a))) == str(a)
    assert str(sketches([part])[0].merge(a)) == str(a)
    empty, other = sketches(["", "x"])
    assert empty.likeness(empty) == 1 and empty.likeness(other) == 0


@pytest.mark.parametrize("n", [1, 3, 5, 20, 64, 65, 200, 500, 1000, 4000, 10_000])
def test_containment_between_unequal_texts_and_its_error(n):
    pick = random.Random(n)
    trials = 120 if n <= 1000 else 12
    off, allowed, missed, expected = [], [], 0, 0.0
    for _ in range(trials):
        large = np.array([pick.getrandbits(64) for _ in range(10_000)], dtype=np.uint64)
        share = pick.choice([0.0, 0.3, 0.8, 1.0])
        inside = round(share * n)
        small = np.concatenate((large[:inside], np.array([pick.getrandbits(64) for _ in range(n - inside)], dtype=np.uint64)))
        found = Sketch.of(small).likeness(Sketch.of(large))
        expected += (1 - 1 / SCALE) ** n
        if found is None:
            missed += 1
            continue
        assert share not in (0.0, 1.0) or found == share
        off.append(found - inside / n)
        allowed.append(share * (1 - share) / max(1, n / SCALE))
    # No estimate only where no hash of the small text is below the common threshold, which is known beforehand.
    assert abs(missed - expected) <= 4 * np.sqrt(expected) + 1
    assert abs(np.sum(off)) <= 5 * np.sqrt(np.sum(allowed)) + 1e-9
    if n >= 64:
        assert np.mean(np.square(off)) <= 2.5 * np.mean(allowed) + 1e-9


def test_fingerprints_as_columns(docs, none):
    got = fingerprints(docs).cache()
    assert got.where("doc_id = 5").first().fingerprint == got.where("doc_id = 63").first().fingerprint
    row = got.where("doc_id = 5").select(likeness(got.fingerprint, got.fingerprint), merged(got.fingerprint, got.fingerprint) == got.fingerprint).first()
    assert tuple(row) == (1, True)
    tiny, huge = (got.where(f"doc_id = {i}").first().fingerprint for i in (64, 5))
    unknown = got.limit(1).select(likeness(F.lit(str(Sketch(np.array([_TOP - 1]), _TOP))), F.lit(str(Sketch(np.arange(64), _TOP // 8)))).alias("x"))
    assert unknown.first().x is None and tiny != huge
    assert fingerprints(none).count() == 0


def test_edits_take_the_next_document(spark, none):
    pick = random.Random(7)
    rows = [(i * 3, random_text(pick, 1 + pick.randrange(60)) + "é😀" * (i % 3)) for i in range(500)] + [(1, ""), (2, None)]
    got = {r.doc_id: r for r in edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = sketches([text, new, following])
        assert (got[i].near_edited, got[i].near_next) == (a.likeness(b) or 0, a.likeness(c) or 0)
    assert edit_likeness(none).count() == 0
    assert edit_likeness(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first().near_next == 1


def test_edits_lose_no_row_beside_null_and_large_ids(spark):
    pick = random.Random(9)
    rows = [((1 << 60) + k, random_text(pick, 1 + pick.randrange(40))) for k in range(500)] + [(None, f"null {k} and more words here") for k in range(4)]
    got = edit_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    order = sorted((r for r in rows if r[0] is not None), reverse=True)
    by = {r.doc_id: r for r in got}
    for (i, text), (_, following) in zip(order, order[1:]):
        half = len(text) // 2
        assert by[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()


def test_null_fingerprints(spark):
    made = spark.createDataFrame([("a b c", None), (None, None), ("a b c", "a b c")], "x string, y string")
    some = lambda c: F.when(F.col(c).isNotNull(), F.col(f"f{c}"))
    for c in "xy":
        made = fingerprints(made, text_col=c).withColumnRenamed("fingerprint", f"f{c}")
    got = made.select("x", "y", likeness(some("x"), some("y")).alias("l"), merged(some("x"), some("y")).alias("m"), "fx").collect()
    assert [(r.l, r.m) for r in got] == [(None, got[0].fx), (None, None), (1.0, got[0].fx)]


def test_edits_stand_odd_cases(docs, rows):
    assert edit_likeness(docs).count() == len(rows)


def test_op4(spark, folder, rows):
    got = op4_fingerprints(spark, folder)
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    by = {r.doc_id: r for r in found}
    assert by[5].fingerprint == by[63].fingerprint and by[60].n_chars == 0 and by[65].n_chars == 150_000


def test_repeated_passages_go_once_kept(spark):
    pick = random.Random(8)
    passage = " ".join(random_text(pick, 9) + "." for _ in range(6))
    lines = lambda n: "\n".join(random_text(pick, 12) + "." for _ in range(n))
    rows = [(3, lines(3) + "\n" + passage + "\n" + lines(2)), (1, lines(2) + " " + passage.upper() + " " + lines(1)), (2, lines(4)), (4, "All rights reserved.\n" + lines(2)), (5, lines(1) + "\nAll rights reserved.")]
    got = {r.doc_id: r for r in drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    before = dict(rows)
    assert all(got[i].text == before[i] and got[i].removed == [] for i in (1, 2, 4, 5))
    (start, end), = [(s.start, s.end) for s in got[3].removed]
    raw = before[3].encode()
    assert raw[start:end].decode().strip() == passage and got[3].text == (raw[:start] + raw[end:]).decode()


def plain_pieces(text):
    """Words of a text and the numbers of those that begin a piece, by one loop over windows of each line."""
    begins, words = [], []
    for line in text.split("\n"):
        said = WORD.findall(line.translate(LOWER))
        if not said:
            continue
        at, cuts = len(words), {0}
        keys = _keys(Words([" ".join(said).encode()])).tolist()
        assert all((k < 1 << 63) == (w[-1] in ".!?") and k for k, w in zip(keys, said, strict=True))
        runs = []
        for k in range(len(said)):
            if k and said[k] == said[k - 1]:
                runs[-1][1] = k + 1
            else:
                runs.append([k, k + 1])
        runs = [(a, b) for a, b in runs if b - a >= RUN]
        for k in range(len(said) - WINDOW):  # the last word of the line ends its last windows
            window = keys[k : k + WINDOW]
            cuts |= {k + i + 1 for i in range(WINDOW) if window[i] == min(window)}
        cuts = {c for c in cuts if not any(a < c < b for a, b in runs)} | {c for run in runs for c in run}
        begins += [at + c for c in sorted(cuts) if c < len(said)]
        words += said
    return words, begins


def plain_removal(rows, least):
    """For each document the words that go, told by strings and one loop over all units in order."""
    first_doc, out = {}, {}
    found = {}
    for i, text in sorted(rows):
        words, begins = plain_pieces(text or "")
        lines = [k for k, line in enumerate((text or "").split("\n")) for _ in WORD.findall(line)]
        weight = lambda a, b: max(b - a, sum(map(len, words[a:b])) // 5)  # noqa: B023, E731
        edges = [*begins, len(words)]
        sizes = [weight(a, b) for a, b in zip(edges, edges[1:])]
        units = set()
        for k in range(len(sizes)):
            for m in range(k, len(sizes)):
                if sum(sizes[k : m + 1]) >= least:
                    units.add((edges[k], edges[m + 1]))
                    break
        for m in range(len(sizes)):
            if m + 1 == len(sizes) or lines[edges[m + 1]] != lines[edges[m]]:
                for k in range(m, -1, -1):
                    if lines[edges[k]] != lines[edges[m]]:
                        break
                    if sum(sizes[k : m + 1]) >= least:
                        units.add((edges[k], edges[m + 1]))
                        break
        found[i] = words, sorted(units)
        for a, b in units:
            first_doc.setdefault(tuple(words[a:b]), i)
    for i, (words, units) in found.items():
        gone, seen = set(), {}
        for a, b in units:
            said = tuple(words[a:b])
            if first_doc[said] != i:
                gone |= set(range(a, b))
            elif said in seen:
                gone |= set(range(max(a, seen[said]), b))
            else:
                seen[said] = b
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


@pytest.mark.parametrize("least", [PASSAGE, 1])
def test_repeated_passages_like_a_plain_loop(spark, least):
    pick = random.Random(9)
    pool = [random_text(pick, 5 + pick.randrange(60), 300) + pick.choice([".", "", "!"]) for _ in range(60)]
    pool += ["same " * 40, "Same same " * 30, "a b c d e " * 12, "x", " ".join(f"{c}!!" for c in "abcdefghij" * 3)]
    rows = [(pick.randrange(10**6), "".join(pick.choice(pool) + pick.choice([" ", "\n", "\n\n"]) for _ in range(1 + pick.randrange(8)))) for _ in range(300)]
    rows = list(dict(rows).items())
    got = {r.doc_id: r.text for r in drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), least=least).collect()}
    want = plain_removal(rows, least)
    assert all(WORD.findall(got[i].translate(LOWER)) == want[i] for i, _ in rows)
    assert sum(len(want[i]) < len(WORD.findall(text)) for i, text in rows) > 100


def test_nothing_goes_that_no_earlier_text_has(spark):
    pick = random.Random(15)
    shouted = lambda: " ".join(f"{pick.choice('abcdefgh')}!!" for _ in range(60))
    rows = [(1, "Same"), (2, "same " * 25), (3, "same " * 24)] + [(k, shouted()) for k in range(4, 60)]
    rows += [(60 + k, "All rights reserved.\nKeep off the grass.\n" + random_text(pick, 30)) for k in range(20)]
    assert all(r.removed == [] for r in drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_long_lines_go_whole_and_short_ones_on_demand(spark):
    pick = random.Random(16)
    lines = [random_text(pick, n) for n in range(PASSAGE, 80)]
    rows = [(2 * k, line) for k, line in enumerate(lines)] + [(2 * k + 1, f"{random_text(pick, 9)}\n{line}\n{random_text(pick, 9)}") for k, line in enumerate(lines)]
    got = {r.doc_id: r.text for r in drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].split("\n")[1] in line and len(got[i].split("\n")) == 2 for i, line in rows if i % 2)
    ten = [(k, f"{random_text(pick, 30)}\neleven words that three documents say in a line here now\n{random_text(pick, 30)}") for k in range(3)]
    got = drop_repeated_passages(spark.createDataFrame(ten, "doc_id long, text string"), least=1).collect()
    assert [("eleven words" in r.text, len(r.text.split())) for r in sorted(got)] == [(True, 71), (False, 60), (False, 60)]


def removed_words(one, two):
    """How many words of the second text go after the first."""
    first, second = units([one.encode(), two.encode()])
    known = set(zip(first.one.tolist(), first.two.tolist(), strict=True))
    hits = np.array([k for k, d in enumerate(zip(second.one.tolist(), second.two.tolist(), strict=True)) if d in known], dtype=np.int64)
    return sum(len(two.encode()[a:b].split()) for a, b in second.spans(len(two.encode()), hits))


def test_units_do_not_hang_on_what_stands_around():
    pick = random.Random(10)
    (found,) = units([b"A b.\nC d? e F\n\n G. "], 1)
    assert found.starts.tolist() == [0, 5, 16] and list(zip(found.first, found.last)) == [(0, 0), (1, 1), (2, 2)]
    texts = [random_text(pick, 20) + " Of" * n + " " + random_text(pick, 20) for n in (30, 30, 31)]
    shared = lambda a, b: set(a.one.tolist()) & set(b.one.tolist())
    one, two, three = units([t.encode() for t in texts])
    assert shared(one, two) and not shared(one, three)


def test_repeated_lines_of_few_words_go_by_their_length(spark):
    pick = random.Random(12)
    han = lambda n: "".join(chr(0x4E00 + pick.randrange(3000)) for _ in range(n))
    lines = [han(120) + "。", "x".join(str(pick.random()) for _ in range(9)), " ".join(f"donaudampfschiff{pick.randrange(10**6)}" for _ in range(8)) + "."]
    short = [han(60), "All rights reserved."]
    rows = [(i, f"{han(200)}\n{line}\n{random_text(pick, 15)}.") for line in lines + short for i in (2 * (lines + short).index(line), 2 * (lines + short).index(line) + 1)]
    got = {r.doc_id: r.text for r in drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        gone = i % 2 and i < 2 * len(lines)
        assert got[i] == (text.replace(lines[i // 2] + "\n", "") if gone else text)


def test_every_passage_of_51_words_loses_20():
    lost = []
    for seed in range(1500):
        pick = random.Random(seed)
        # Sentences of any length, or none at all.
        stops = pick.choice([0, 0.02, 0.05, 0.1, 0.3])
        said = lambda n: " ".join(f"w{pick.randrange(3000)}" + "." * (pick.random() < stops) for _ in range(n))  # noqa: B023, E731
        passage = said(51)
        edges = [said(pick.randrange(60)) for _ in range(4)]
        gap = pick.choice([" ", " ", "\n"])
        one, two = (f"{a}{gap}{passage} {b}" for a, b in zip(edges[:2], edges[2:], strict=True))
        gone = removed_words(one, two)
        if gone < PASSAGE:
            lost.append((seed, gone))
    assert lost == []


def test_units_do_not_hang_on_other_texts():
    texts = [t.encode() for t in ["same same", "same same same x", "", "a b same", "same same same", random_text(random.Random(13), 100), "", "c " * 40]]
    alone = [next(units([t])) for t in texts]
    assert all(np.array_equal(a, b) for f, g in zip(alone, units(texts), strict=True) for a, b in zip(f, g, strict=True))


def test_repeated_passages_stand_odd_cases(docs, rows, none):
    got = drop_repeated_passages(docs)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and by[60].text is None and by[61].text == "" and by[63].text == "" and by[5].text == rows[5][1]
    assert by[64].text == "twice the same row." and by[65].text == "word " * 30_000 and by[1]["h"] == "extra"
    assert drop_repeated_passages(none).count() == 0
    assert COLUMNS.startswith("doc_id") and prose("en", 3, 1)
