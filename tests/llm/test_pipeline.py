"""The stages one after the other, and the queries that SQL can express."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.test_queries import FOLDER, agrees, duck  # noqa: F401

from .conftest import COLUMNS
from .test_duplicates import LOWER, PASSAGE, WORD, plain_removal, roots, shingles
from .test_shards_and_mix import expected


def test_stages_keep_the_columns_of_documents(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), COLUMNS)
        assert docs.columns == before.columns, name
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    last = corpus_pipeline.tokens(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder)
    assert Counter(map(str, got.collect())) == Counter(map(str, last.collect()))
    assert {r.doc_id for r in got.collect()} <= {r[0] for r in rows}


def test_columns_of_clashing_names_come_through(spark, docs, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, empty = stage(spark, docs, ""), stage(spark, none, "")
        assert got.columns == docs.columns == empty.columns, name
        assert {tuple(r)[5:] for r in got.collect()} == {("extra",) * (len(docs.columns) - 5)}, name
        assert empty.count() == 0, name
    assert corpus_pipeline.tokens(spark, docs, "").count() == docs.count() and corpus_pipeline.tokens(spark, none, "").count() == 0


def test_an_empty_table_makes_an_empty_one(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_like_plain_versions(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null")
    rows = [r for r in rows if r[0] is not None]

    # What no labeller objects to is prose here, and the rest has no word or repeats one.
    want = {r[0] for r in rows if r[1] and len(set(r[1].split())) > 3}
    assert {r.doc_id for r in corpus_pipeline.good_documents(spark, docs, folder).collect()} >= want
    assert not {r.doc_id for r in corpus_pipeline.good_documents(spark, docs, folder).collect()} & {60, 61, 62}

    sets = {r[0]: shingles(r[1]) for r in rows}
    linked = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    kept = sorted(a for a, root in roots(sets, linked).items() if a == root)
    assert sorted(r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, folder).collect()) == kept

    left = {r.doc_id: r for r in corpus_pipeline.distinct_passages(spark, docs, folder).collect()}
    plain = plain_removal(list({r[0]: r[1] for r in rows}.items()), PASSAGE)
    assert {i: WORD.findall((r.text or "").translate(LOWER)) for i, r in left.items()} == plain
    assert all(r.n_chars == len(r.text) for i, r in left.items() if r.text is not None and len(plain[i]) < len(WORD.findall(dict((x[0], x[1]) for x in rows)[i])))

    sizes, targets = expected(rows)
    taken = Counter()
    for r in corpus_pipeline.mixed_sources(spark, docs, folder).collect():
        taken[r.source] += len(WORD.findall(r.text))
    assert all(targets[s] - 1 < taken[s] <= targets[s] + 1e-6 for s in sizes)

    public_tokenizers = pytest.importorskip("public_tokenizers")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = dict((r[0], r[1] or "") for r in rows)
    got = corpus_pipeline.tokens(spark, docs, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert all(r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids and len(r.ids) == r.n_tokens for r in got.collect())


@pytest.mark.parametrize("name", ["op3_mixing", "op8_url_filters"])
def test_agrees_with_sql(spark, duck, name):  # noqa: F811
    agrees(spark, duck, name)


CONTRACTS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op5_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_substring_dedup": "doc_id bigint, text string, removed array<struct<start:bigint,end:bigint>>",
    "op7_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_quality_classifier": "doc_id bigint, weak_label double, quality double, kept boolean",
    "op12_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op13_cross_tokenizer_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_and_rows_of_each_query(spark, folder, rows, tmp_path, name):
    got = entry.queries()[name](spark, folder)
    assert [f"{c} {kind}" for c, kind in got.dtypes] == CONTRACTS[name].split(", ")
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows)
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert entry.queries()[name](spark, str(tmp_path / "empty")).count() == 0


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {k[: k.index("_") + 1] for k in entry.queries() if k.startswith("op")}
    assert "pipeline" in entry.queries() and duckdb and FOLDER
