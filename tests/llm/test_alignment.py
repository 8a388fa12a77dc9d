"""Alignment against the two libraries and a plain loop over their tokens."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lithospark.llm.alignment import ByteTokens, PieceTokens, _aligned, _Names, align, linked, op13_cross_tokenizer_alignment, piece_model, with_counts
from lithospark.llm.bpe import byte_characters, tokenizer_json

from .conftest import COLUMNS


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


BACK = {c: b for b, c in byte_characters().items()}


def tokens(libraries, text):
    """Both sides' ids and byte strings."""
    a, b = libraries
    left = [(i, bytes(BACK[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("\u2581", " ").encode()
    return left, [(i, piece(b.id_to_piece(i))) for i in b.encode(text)]


def plain(libraries, texts):
    """Per text its groups and links."""
    made = []
    for text in texts:
        a, b = tokens(libraries, text or "")
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(x for _, x in side) != whole for side in (a, b)):
            made.append((0, 0, [], []))
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            ga, gb = [], []
            while i < len(a) and ends[0][i] <= cut:
                ga.append(a[i][0])
                i += 1
            while j < len(b) and ends[1][j] <= cut:
                gb.append(b[j][0])
                j += 1
            groups.append((ga, gb))
            links.append((ga[-1], gb[-1]))
        made.append((len(a), len(b), groups, links))
    return made


def expected(libraries, rows):
    made = plain(libraries, [r[1] for r in rows])
    counts = Counter(link for *_, links in made for link in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for row, (n_a, n_b, groups, links) in zip(rows, made, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((row[0], n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), text and hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def test_op13(spark, folder, rows, libraries):
    got = Counter(map(tuple, op13_cross_tokenizer_alignment(spark, folder).collect()))
    assert got == expected(libraries, rows)


ODD = ["<|endoftext|> a <s> </s> <unk>", "  two  spaces ", " ", "   ", "tab\tnew\n\nline\r", "\u2581mark \u2581", "a\u2581b", "e\u0301 \ufb01 \u00a0x", "\x00\x7f", "\U0001f600\U0001f468\u200d\U0001f469", "<0x41> <0xZZ>", "x" * 5000, "\u65e5\u672c\u8a9e", "1234567890", "a-b_c's we'll"]


def test_odd_texts_and_joins_by_shuffle(spark, libraries):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*ODD, *ODD[:4], None, ""])]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3).withColumn("row", F.col("doc_id") * 7)
    made = align(docs).join(docs.select("doc_id", "row"), "doc_id").cache()
    for limit in (0, 1_000_000):
        got = with_counts(made, 32_000, broadcast_pairs=limit)
        order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(map(tuple, got.select(*order).collect())) == expected(libraries, rows)


def test_groups_themselves_and_clashing_columns(docs, none, libraries, rows):
    got = align(docs, with_groups=True)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "groups"]
    for r in got.where("doc_id < 5").collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        _, _, groups, links = plain(libraries, [text])[0]
        assert r.groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert dict(zip(r.pairs, r.times, strict=True)) == Counter(a * 32_000 + b for a, b in links)
    assert align(none).count() == 0


def test_tokens_without_bytes_are_linked_each():
    a, b = np.array([1, 3, 3, 6]), np.array([3, 3, 5, 6])
    cuts, left, right = linked(a, b)
    assert cuts.tolist() == [3, 6]
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 3)]


def test_bytes_are_compared_only_where_they_may_differ():
    model = tokenizer_json()
    assert ByteTokens(model).exact and not PieceTokens(piece_model()).exact
    other = json.loads(model)
    merged = "".join(other["model"]["merges"][0]) if isinstance(other["model"]["merges"][0], list) else other["model"]["merges"][0].replace(" ", "")
    token = {"id": other["model"]["vocab"][merged], "content": "<other>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    other["added_tokens"] = [*other["added_tokens"], token]
    assert not ByteTokens(json.dumps(other)).exact


def test_groups_where_each_cut_ends_one_link_or_more():
    names = _Names(10, 10)
    for a_ends, b_ends, want in (([1, 3, 4], [3, 4], "1,2|1;3|2"), ([2, 4], [1, 2, 3, 4], "1|1,2;2|3,4"), ([2, 2, 4], [2, 4], "1,2|1;3|2")):
        a, b = (np.arange(1, len(e) + 1) for e in (a_ends, b_ends))
        made = _aligned(a, b, (np.array(a_ends), np.array(b_ends)), names)
        assert made["groups"] == want and made["n_links"] == sum(x == y for x in a_ends for y in b_ends)
