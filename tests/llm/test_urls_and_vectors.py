"""URL filters and nearest neighbours."""

from __future__ import annotations

import os

import numpy as np
import pytest

from lithospark.llm.urls import RULES, SOFT, STRICT, Vocabulary, filter_urls, op8_url_filters, read_vocabulary
from lithospark.llm.vectors import nearest_neighbours, op9_nearest_neighbours

URLS = {
    None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/casino": ("", "", None, "block"), "no scheme/xcasino": ("", "", None, "allow"),
    "https://a.example.com/search?q=Porn": ("a.example.com", "/search", None, "block"), "http://a.com/go#to=casino": ("a.com", "/go", None, "block"),
    "casino://a.com/": ("a.com", "/", None, "allow"), "http://a.com/?u=http://free/bets": ("a.com", "/", None, "block"), "http://a.com/" + "y" * 200_000 + "?spam": ("a.com", "/" + "y" * 200_000, None, "block"),
    "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"), "http://x.net": ("x.net", "", None, "allow"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://b.example.com/de/1": ("b.example.com", "/de/1", "example.com/de/", "block"),
    "x://www.a.org/fr/casino": ("www.a.org", "/fr/casino", "org/fr/", "allow"), "http://casino-win.com/": ("casino-win.com", "/", None, "block"),
    "http://casinos.com/": ("casinos.com", "/", None, "allow"), "http://free.com/": ("free.com", "/", None, "allow"), "http://free-bets.com/a/b": ("free-bets.com", "/a/b", None, "block"),
    "http://free-free.com/": ("free-free.com", "/", None, "allow"), "a://b?c://d/e": ("b", "", None, "allow"), "http://É.com/Ä#x": ("É.com", "/Ä", None, "allow"),
}


def test_rules_and_vocabulary(spark):
    rows = spark.createDataFrame([(i, u, "extra", "extra") for i, u in enumerate(URLS)], "page_id long, url string, rule string, other string")
    got = filter_urls(rows).orderBy("page_id").collect()
    for r, (url, want) in zip(got, URLS.items(), strict=True):
        assert (r.host, r.path, r.rule, r.verdict) == want, url
    assert got[0].other == "extra" and filter_urls(rows.where("false")).count() == 0


def test_rejects_like_a_plain_search():
    import random
    import re

    pick, own = random.Random(1), Vocabulary()
    for _ in range(2000):
        text = "".join(pick.choice([*STRICT, *SOFT, "a", "-", "/", ".", "1", "é"]) for _ in range(pick.randrange(6)))
        hit = lambda terms: {t for t in terms if re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", text)}  # noqa: B023, E731
        assert own.rejects(text) == bool(hit(STRICT) or len(hit(SOFT)) >= own.soft_hits), text


def test_of_equally_long_rules_the_later_wins(spark):
    rows = spark.createDataFrame([("http://a.bc/d/e",), ("http://x.a.bc/d/e",)], "url string")
    for rules in ([("a.bc", "/d/", "block"), ("bc", "/d/e", "allow")], [("bc", "/d/e", "allow"), ("a.bc", "/d/", "block")]):
        longest = max(rules, key=lambda r: len(r[0] + r[1]))
        assert {r.verdict for r in filter_urls(rows, rules=rules).collect()} == {longest[2]}
    for rules in ([("a.bc", "/d", "block"), ("bc", "/d/e", "allow")], [("bc", "/d/e", "allow"), ("a.bc", "/d", "block")]):
        assert {(r.rule, r.verdict) for r in filter_urls(rows, rules=rules).collect()} == {(rules[1][0] + rules[1][1], rules[1][2])}


def test_rules_from_a_table_like_a_plain_search(spark):
    import random

    pick = random.Random(8)
    names = ["a.com", "b.a.com", "c.b.a.com", "com", "x.org", "org", "É.com", "localhost"]
    rules = [(pick.choice(names), pick.choice(["/", "/p", "/p/q", "/p/q/r/"]), pick.choice(["allow", "block"])) for _ in range(12)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values()) + [(f"h{k}.net", "/", "block") for k in range(100_000)] + [(None, "/", "block"), ("com", None, "block")]
    urls = [f"http://{pick.choice(['', 'w.', 'w.v.'])}{pick.choice([*names, 'h7.net', 'other', 'A.COM'])}{pick.choice(['', '/', '/p', '/p/q', '/p/q/r/s', '/z'])}" for _ in range(400)] + [None, "", "no scheme"]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in filter_urls(pages, rules=table, vocabulary=Vocabulary([], [])).collect()}
    assert len(got) == len(urls)
    for k in range(len(urls)):
        r = got[k]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and p and (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow")), urls[k]
    small = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    plain = lambda df: sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in df.collect())
    known = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    assert plain(filter_urls(known, rules=small)) == plain(filter_urls(known))


def test_a_large_vocabulary_from_a_file(spark, tmp_path):
    import pickle
    import time

    terms = [f"Term{k}x" for k in range(100_000)]
    (tmp_path / "terms.tsv").write_text("".join(f"{t}\t{'soft' if k % 2 else 'strict'}\n" for k, t in enumerate(terms)) + "\n")
    own = read_vocabulary(spark, str(tmp_path / "terms.tsv"))
    urls = spark.createDataFrame([("http://a.com/term0x",), ("http://a.com/term1x",), ("http://a.com/term1x?term3x",), ("http://a.com/aterm0x",)], "url string")
    assert [r.verdict for r in filter_urls(urls, vocabulary=own).collect()] == ["block", "allow", "block", "allow"]
    sent, few = pickle.loads(pickle.dumps(own)), Vocabulary()

    def took(v):
        v.rejects("warm up")
        best = []
        for _ in range(5):
            start = time.perf_counter()
            for k in range(5000):
                v.rejects(f"a.example.com/some/path/{k}")
            best.append(time.perf_counter() - start)
        return min(best)

    assert sent.strict == own.strict and took(sent) < 3 * took(few)
    (tmp_path / "bad.tsv").write_text("word\tloud\n")
    with pytest.raises(ValueError, match="not a term"):
        read_vocabulary(spark, str(tmp_path / "bad.tsv"))
    assert [r.verdict for r in filter_urls(urls, vocabulary=Vocabulary([], [])).collect()] == ["allow"] * 4


def test_op8(spark):
    got = op8_url_filters(spark, "/root/testdata/sf0.001") if os.path.isdir("/root/testdata/sf0.001") else pytest.skip("no test tables")
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:140] = x[100]
    return x


def test_recall_scores_and_order(spark, vectors):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = nearest_neighbours(rows, rows.where("vec_id % 50 = 0"), shard_rows=800).collect()
    x = vectors.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in own}
        score = unit @ unit[q]
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        score[q] = -2
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(3000), -score))[:5].tolist()))
    assert hits >= 0.9 * 5 * 60
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r.rank)] == [101, 102, 103, 104, 105]


def exact(rows, queries, k):
    """For each query row the best candidates by a plain loop: ``(query_id, rank, vec_id, score)``."""
    out = []
    for own, q in queries:
        left, skipped = [], False
        for i, v in rows:
            if not skipped and i == own and v == q:
                skipped = True
                continue
            left.append((-float((np.array(v) * np.array(q)).sum() / (np.sqrt((np.array(v) ** 2).sum()) * np.sqrt((np.array(q) ** 2).sum()))), i))
        out += [(own, rank, i, -s) for rank, (s, i) in enumerate(sorted(left)[:k], 1)]
    return sorted(out)


def test_rows_that_repeat_are_candidates_each(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(0, rows[0][1])] * 3 + [(0, rows[1][1]), (50, rows[2][1]), (7, rows[0][1]), (50, rows[50][1]), (61, [2 * x for x in rows[0][1]])] + [(80, rows[3][1])] * 400
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = [r for r in rows if r[0] in (0, 50)]
    got = [tuple(r) for r in nearest_neighbours(df, df.where("vec_id in (0, 50)"), k=5, shard_rows=30).collect()]
    want = exact(rows, queries, 5)
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(sorted(got), want, strict=True))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_on_embeddings(spark):
    folder = "/root/testdata/sf0.1"
    got = op9_nearest_neighbours(spark, folder)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v and np.isfinite(v).all() and any(v)]
    want = exact(rows, [r for r in rows if r[0] % 50 == 0], 5)
    found = {(r.query_id, r.vec_id) for r in got.collect()}
    assert len(found) == len(want) and sum((q, v) in found for q, _, v, _ in want) >= 0.95 * len(want)


def test_recall_in_a_large_shard():
    from lithospark.llm.vectors import BEAM, Graph, shards_for

    assert [shards_for(n, 65_536) for n in (0, 1, 5000, 60_000, 1_000_000, 10_000_000)] == [1, 1, 2, 15, 16, 153]
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 32))[rng.integers(0, 100, 20_000)] + 0.6 * rng.normal(size=(20_000, 32))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    found, _ = Graph.build(unit).search(unit[::100], BEAM)
    best = np.argsort(-(unit[::100] @ unit.T), axis=1)[:, :6]
    assert np.mean([np.isin(b, f).mean() for b, f in zip(best, found, strict=True)]) >= 0.95


def test_recall_in_a_shard_of_full_size_with_large_clusters():
    from lithospark.llm.vectors import BEAM, SHARD_ROWS, Graph

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))[rng.integers(0, 300, SHARD_ROWS)] + 0.6 * rng.normal(size=(SHARD_ROWS, 64))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    asked = unit[:: SHARD_ROWS // 500]
    found, _ = Graph.build(unit).search(asked, BEAM)
    best = np.argsort(-(asked @ unit.T), axis=1)[:, :6]
    assert np.mean([np.isin(b, f).mean() for b, f in zip(best, found, strict=True)]) >= 0.95


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "extra") for i, v in rows], "vec_id long, embedding array<float>, size string")
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest_neighbours(df, df).collect()]
    # Both rows of 9 are candidates, and each is a query.
    assert sorted(got) == [(0, 1, 9), (0, 2, 9), (0, 3, 1), (1, 1, 0), (1, 2, 9), (1, 3, 9)] + [(9, r, v) for r, v in ((1, 0), (2, 9), (3, 1)) for _ in range(2)]
    assert nearest_neighbours(df.where("false"), df).count() == 0 == nearest_neighbours(df, df.where("false")).count()
