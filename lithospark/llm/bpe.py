"""BPE encoding and decoding with a pair occurrence index.

A batch of texts is split into pieces; the distinct pieces not met before are
laid end to end. An index maps each pair of neighbouring symbols to all its
places. Ranks are applied in ascending order, each to all its places at once,
and the lists of the pairs that this makes are extended.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, ship_package, sliced, table

#: Pieces whose ids a worker keeps at most; then it starts again.
KEPT_PIECES = 400_000
#: Fixed value: how byte-level vocabularies split a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary in JSON form."""

    def __init__(self, model: str) -> None:
        import regex

        read = json.loads(model)
        if read.get("normalizer") or read["pre_tokenizer"]["type"] != "ByteLevel" or read["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE vocabularies are read")
        vocab: dict[str, int] = read["model"]["vocab"]
        back = {c: b for b, c in byte_characters().items()}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items() if all(c in back for c in token)}
        self.first = np.array([vocab[c] for _, c in sorted(byte_characters().items())], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in read["model"]["merges"]]
        self.left, self.right, self.made = (
            np.array([vocab[t] for t in tokens], dtype=np.int64)
            for tokens in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])
        )
        # Applying a rank to all its places at once needs every symbol to be made before it is used.
        born = {int(t): rank for rank, t in reversed([*enumerate(self.made)])}
        if any(born.get(int(t), -1) >= rank for side in (self.left, self.right) for rank, t in enumerate(side)):
            raise ValueError("a merge comes before the merge that makes its part")
        keys = (self.left << 32) | self.right
        self.rank_of_key = np.argsort(keys)
        self.keys = keys[self.rank_of_key]
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in read["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours are not read")
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    def texts_to_pieces(self, text: str) -> list[str | int]:
        """The pieces of a text; an added token is given by its id."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pieces.findall(text)
        out: list[str | int] = []
        for part in self.split_special.split(text):
            out += [self.special[part]] if part in self.special else self.pieces.findall(part)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces not yet known, all of them through one index."""
        fresh = [p for p in pieces if p not in self.known]
        if not fresh:
            return
        # A byte that no UTF-8 text holds ends each piece.
        raw = np.frombuffer(b"\xff".join(p.encode() for p in fresh) + b"\xff", dtype=np.uint8)
        ends = np.flatnonzero(raw == 0xFF)
        symbols = self.first[raw]
        symbols[ends] = -1
        self._merge(symbols)
        left = symbols >= 0
        upto = np.cumsum(left)[ends].tolist()
        ids, start = symbols[left].tolist(), 0
        for p, end in zip(fresh, upto, strict=True):
            self.known[p] = tuple(ids[start:end])
            start = end

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == keys), self.rank_of_key[at], -1)

    def _merge(self, symbols: np.ndarray) -> None:
        """Applies all merges in place: the first of two places takes the new symbol, the other -2; -1 ends a piece."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            order = order[np.searchsorted(ranks[order], 0) :]
            if not len(order):
                return
            at, ranks = at[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                rank = int(ranks[i])
                if rank not in places:
                    heappush(active, rank)
                    places[rank] = []
                places[rank].append(at[i:j])

        index(np.arange(n - 1), self._ranks(symbols[:-1], symbols[1:]))
        while active:
            rank = heappop(active)
            found = places.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            at = at[symbols[at] == a]
            at = at[symbols[after[at]] == b]
            if a == b:
                at = self._from_the_left(at, after)
            if not len(at):
                continue
            gone = after[at]
            symbols[at], symbols[gone] = new, -2
            behind = after[at] = after[gone]
            before[behind] = at
            ahead = before[at]
            has = ahead >= 0
            ahead = ahead[has]
            made = np.full(len(ahead), new)
            index(
                np.concatenate((ahead, at)),
                np.concatenate((self._ranks(symbols[ahead], made), self._ranks(np.full(len(at), new), symbols[behind]))),
            )

    @staticmethod
    def _from_the_left(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of overlapping pairs of one symbol with itself, every other one."""
        taken, last = [], -1
        for i, j in zip(at.tolist(), after[at].tolist(), strict=True):
            if i != last:
                taken.append(i)
                last = j
        return np.array(taken, dtype=np.int64)

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text in turn."""
        split = [self.texts_to_pieces(t) for t in texts]
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        self.learn({p for p in set().union(*split) if type(p) is str})
        known = self.known
        for text, pieces in zip(texts, split, strict=True):
            if self.split_special is not None and any(s in text for s in self.special):
                yield [i for p in pieces for i in (known[p] if type(p) is str else (p,))]
            else:
                yield list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def tokenizer_json(path: str | None = None) -> str:
    """A vocabulary file, read by the driver (1.5 MB); by default the public 50k one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(
    docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Per document: its id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, on demand, ``ids`` and ``decoded``.

    A null text counts as empty: no tokens. Rows stay apart when ids repeat;
    other columns are not looked at. Texts are taken whole, however long; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(tokenizer_json(path))
    kind = dict(docs.dtypes)[id_col]
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for ids in own.encode_batch(texts):
                text = own.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(text)
            arrays = [batch.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)
        own.known.clear()  # a worker that goes on to other work holds no pieces

    quoted = id_col.replace("`", "``")
    return docs.select(column(id_col), column(text_col)).mapInArrow(
        run, f"`{quoted}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of what they decode to."""
    return encode_decode(table(spark, sf_dir, "documents"), with_ids=False)
