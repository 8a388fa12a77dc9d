"""The manifest against a plain tree, whatever the size of its blocks."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithospark.llm.merkle import FIELDS, LEVELS, climb, folded, leaf, manifest, op12_merkle_manifest, siblings

from .conftest import COLUMNS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return sha(*map(field, (row[0], row[3], row[2], row[4], text)))


def tree(leaves):
    """The root, and for each leaf what stands left and right of it level by level."""
    paths, members, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], leaves
    while len(level) > 1:
        above, theirs = [], []
        for start in range(0, len(level), 16):
            run = level[start : start + 16]
            for k in range(len(run)):
                for m in members[start + k]:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            theirs.append([m for part in members[start : start + 16] for m in part])
        level, members = above, theirs
    return level[0], paths


def plain(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append((row, leaf_of(row, row[1])))
    made = []
    for name in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(sources[name], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        made.append((own, *tree([d for _, d in own])))
    root, upper = tree([subroot for _, subroot, _ in made])
    out = []
    for (own, subroot, lower), top in zip(made, upper, strict=True):
        for (row, d), path in zip(own, lower, strict=True):
            path, node = path + top, d
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf_of(row, row[1] and row[1].translate(LOWER))
            for left, right in path:
                node = sha(left, node, right)
            out.append((row[0], d, subroot, root, sha(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_op12(spark, folder, rows):
    got = found(op12_merkle_manifest(spark, folder))
    assert got == plain(rows)


@pytest.mark.parametrize("levels", [1, 2, LEVELS])
def test_many_blocks_null_ids_and_copies(spark, levels):
    rows = [(i % 700 if i % 11 else None, f"T{i % 50}", None, "s" if i % 3 else None, i % 5) for i in range(2000)]
    rows += [(5, "Copy", "x", "s", 1)] * 400 + [(6, "é", "x", "É", 1), (7, "", "", "", 0)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    values = {c: F.col(c) for c in FIELDS} | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(*values.values()))
    assert found(manifest(docs, claimed=claimed, levels=levels)) == plain(rows)
    assert 0 < sum(not r[-1] for r in plain(rows)) < len(rows)


def test_odd_cases(docs, rows, none):
    got = manifest(docs, with_path=True)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "path", "verified"]
    got = got.collect()
    assert len(got) == len(rows) and all(r.verified for r in got) and len({r.root for r in got}) == 1
    for r in got:
        assert folded(r.leaf.encode(), [(p.left.encode(), p.right.encode()) for p in r.path]).decode() == r.root
    assert manifest(none).count() == 0


def test_a_row_alone_is_the_root(spark):
    row = (1, "Alone", "en", None, 5)
    got = manifest(spark.createDataFrame([row], COLUMNS)).first()
    assert got.leaf == got.subroot == got.root == leaf_of(row, "Alone") and got.proof_sha256 == sha() and got.verified


def test_every_field_counts_and_none_runs_into_the_next(spark):
    base = (12, "ab", "c", "s", 3)
    others = [base, (1, "ab", "c", "s", 3), (12, "abc", "", "s", 3), (12, "ab", None, "s", 3), (12, "ab", "-", "s", 3), (12, "ab", "c", "s", None), (12, "2:ab", "c", "s", 3)]
    got = [r.leaf for r in manifest(spark.createDataFrame(others, COLUMNS)).collect()]
    assert len(set(got)) == len(others)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4096])
def test_blocks_like_a_plain_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    root, paths = tree(leaves)
    own = climb(np.frombuffer("".join(leaves).encode(), dtype=np.uint8).reshape(-1, 64), n)
    assert own[-1].tobytes().decode() == root
    for i in {0, n // 2, n - 1}:
        assert [(a.decode(), b.decode()) for a, b in siblings(own, i)] == paths[i]
