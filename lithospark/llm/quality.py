"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good or bad, or abstain; each fault is in sight of
several. Expectation-maximisation over the counts of vote patterns estimates
how often each labeller is right on good and on bad documents. The posterior
labels of a bounded sample train a linear scorer on hashed features, which then
judges every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, parts, ship_package, sliced, table, without
from .shingles import Words, blocks, mix, stream

#: Documents that the scorer is fitted on, about.
TRAIN_DOCUMENTS = 4_000
#: Hashed features.
WIDTH = 4096
#: Posterior of being good below which a document is rejected.
REJECT_BELOW = 0.5

#: Made-up right and wrong votes of each labeller on good and on bad documents, so that no estimate is 0 or 1.
PRIOR_RIGHT, PRIOR_WRONG = 1.0, 0.5
#: Words below which shares of a text's characters say nothing.
ENOUGH = 10

#: Words of the windows in which different words and different runs of three words are counted, and the shares of them
#: below which a window is monotonous.
WINDOW, MONOTONOUS, REPEATED = 1000, 0.15, 0.3
#: Steps in which the scorer sees a measure of repetition.
STEPS = 16

GOOD, BAD, ABSTAIN = 1, 0, 2

# Kinds of bytes: a lower-case letter or a byte beyond ASCII, an upper-case letter, a digit, a gap, a line feed, and each symbol.
_KIND = np.full(256, 0, dtype=np.int64)
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[0x20, 9, 11, 12, 13]], _KIND[10] = 3, 4
_SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum()]
_KIND[_SYMBOLS] = np.arange(5, 5 + len(_SYMBOLS))
_KINDS = 5 + len(_SYMBOLS)
_ODD = np.zeros(256, dtype=bool)
_ODD[[b for b in _SYMBOLS if chr(b) not in ".,;:'\"()-?!|"]] = True
_ODD_FACTORS = stream(31, 3) | np.uint64(1)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[_SYMBOLS] = True
_SAYS = ~_SYMBOL
_SAYS[:33] = _SAYS[127] = False


def _variety(hashes: np.ndarray, below: float) -> tuple[float, float]:
    """The share of different hashes, and the share of hashes in windows with fewer than so many, over windows of the whole text.

    The last window is as long as the others and so overlaps the one before; each weighs as much as it adds.
    """
    n = len(hashes)
    if not n:
        return 1.0, 0.0
    ends = np.append(np.arange(WINDOW, n, WINDOW), n)
    shares = np.array([len(np.unique(hashes[max(0, e - WINDOW) : e])) for e in ends.tolist()]) / min(n, WINDOW)
    weights = np.diff(ends, prepend=0) / n
    return float(shares @ weights), float((shares < below) @ weights)


def _in_runs(hashes: np.ndarray) -> int:
    """How many words stand in a run of three equal ones or more."""
    same = np.concatenate(([0], (hashes[1:] == hashes[:-1]).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(same))
    lengths = edges[1::2] - edges[::2] + 1
    return int(lengths[lengths >= 3].sum())


def measures(texts: list[bytes]) -> Iterator[tuple[dict[str, float], np.ndarray]]:
    """Of each text what the labellers look at, and the kinds of its bytes."""
    for i, j in blocks(texts):
        with np.errstate(over="ignore"):
            words = Words(texts[i:j])
        raw, kinds = words.raw, _KIND[words.raw]
        last = raw[words.ends - 1] if len(words.ends) else raw[:0]
        # Code points are counted at their first byte.
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        lengths = points[words.ends] - points[words.starts]
        odd, symbol = _ODD[raw], _SYMBOL[raw]
        says = np.concatenate(([0], np.cumsum(_SAYS[raw])))
        bare = says[words.ends] == says[words.starts]
        start = word = 0
        for end, until in zip(words.text_ends.tolist(), words.until.tolist(), strict=True):
            own, w, n = kinds[start : end - 1], slice(word, until), until - word
            size, letters = max(1, len(own)), max(1, int((own <= 1).sum()))
            beyond = int((raw[start : end - 1] >= 0xC0).sum())
            latin = int(((own == 0) & (raw[start : end - 1] < 0x80)).sum() + (own == 1).sum())
            hashes = words.hashes[w]
            distinct, monotonous = _variety(hashes, MONOTONOUS)
            with np.errstate(over="ignore"):
                threes = mix(hashes[:-2] * _ODD_FACTORS[0] + hashes[1:-1] * _ODD_FACTORS[1] + hashes[2:] * _ODD_FACTORS[2])
            phrases, repeated = _variety(threes, REPEATED)
            found = {
                "words": float(n),
                "odd": float(odd[start : end - 1].sum()) / size,
                "symbols": float(symbol[start : end - 1].sum()) / size,
                "upper": float((own == 1).sum()) / letters,
                "letters": float((own <= 1).sum()) / size,
                "shouted": float((last[w] == ord("!")).sum()) / max(1, n),
                "bars": float((raw[words.starts[w]] == ord("|")).sum()) / max(1, n),
                "stops": float((last[w] == ord(".")).sum()) / max(1, n),
                "bare": float(bare[w].sum()) / max(1, n),
                "runs": _in_runs(hashes) / max(1, n),
                "repeats": float((hashes[1:] == hashes[:-1]).sum()) / max(1, n - 1),
                "distinct": distinct,
                "monotonous": monotonous,
                "phrases": phrases,
                "repeated": repeated,
                "length": float(lengths[w].mean()) if n else 0.0,
                "beyond": beyond / max(1, beyond + latin),
            }
            yield found, own
            start, word = end, until


def _vote(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def _share(name: str, good: float, bad: float) -> Callable[[dict[str, float]], int]:
    """Votes by a share of a text that is long enough."""
    return lambda m: ABSTAIN if m["words"] < ENOUGH else _vote(m[name] < good, m[name] > bad)


#: Each labeller: good, bad or abstain, from a text's measures.
LABELLERS: dict[str, Callable[[dict[str, float]], int]] = {
    "odd symbols": _share("odd", 0.01, 0.04),
    "symbols": _share("symbols", 0.07, 0.11),
    "capitals": _share("upper", 0.15, 0.4),
    "shouting": _share("shouted", 0.02, 0.2),
    "tables": _share("bars", 0.02, 0.15),
    "bare marks": _share("bare", 0.03, 0.1),
    "repeated words": _share("repeats", 0.08, 0.3),
    "runs of a word": _share("runs", 0.05, 0.2),
    "few different words": lambda m: _vote(m["distinct"] > 0.35, m["monotonous"] >= 0.5 and m["words"] >= 2 * ENOUGH),
    "repeated phrases": lambda m: _vote(m["phrases"] > 0.6, m["repeated"] >= 0.5 and m["words"] >= 2 * ENOUGH),
    "letters": lambda m: ABSTAIN if m["words"] < ENOUGH else _vote(m["letters"] > 0.74, m["letters"] < 0.66),
    # Scripts beyond ASCII may have no spaces, so the length of their words says nothing.
    "word length": lambda m: ABSTAIN if m["beyond"] > 0.5 else _vote(3 <= m["length"] <= 9, m["length"] > 14 or m["length"] < 1.5),
    "sentences": lambda m: _vote(0.02 < m["stops"] < 0.5, False),
}


def features(found: dict[str, float], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: root shares of its byte kind trigrams, and the steps that its measures of repetition reach."""
    if len(kinds) >= 3:
        codes = (kinds[:-2] * _KINDS + kinds[1:-1]) * _KINDS + kinds[2:]
        counts = np.bincount((codes * 2654435761 >> 7) % (WIDTH - 3 * STEPS))
        at = np.flatnonzero(counts)
        values = np.sqrt(counts[at] / len(codes))
    else:
        at, values = np.empty(0, dtype=np.int64), np.empty(0)
    reached = [np.arange(int(min(1.0, found[name]) * STEPS)) + WIDTH - (k + 1) * STEPS for k, name in enumerate(("repeats", "distinct", "phrases"))]
    steps = np.concatenate(reached)
    return np.concatenate((at, steps)), np.concatenate((values, np.full(len(steps), 0.25)))


class WeakLabels:
    """How often each labeller votes right on good and on bad documents, by expectation-maximisation.

    Votes are independent given the class; abstaining says nothing. The first
    guess calls a document bad that any labeller objects to; from then on what
    counts is how far labellers agree, so an objection that others seldom share
    weighs little.
    """

    def __init__(self, patterns: dict[tuple[int, ...], int], rounds: int = 200) -> None:
        said = self._said(np.array(list(patterns) or [[ABSTAIN] * len(LABELLERS)], dtype=np.int64))
        counts = np.array(list(patterns.values()) or [1], dtype=float)
        good = np.where(said[:, :, BAD].any(axis=1), 0.02, 0.98)
        right = np.array([[PRIOR_RIGHT, PRIOR_WRONG], [PRIOR_WRONG, PRIOR_RIGHT]])[:, None]
        for _ in range(rounds):
            weight = np.stack((1 - good, good), axis=1) * counts[:, None]
            self.share = (weight.sum(axis=0) + 1) / (weight.sum() + 2)
            #: How often each labeller votes what, by class: [class, labeller, vote].
            self.cast = np.einsum("pc,plv->clv", weight, said) + right
            self.odds = self.cast / self.cast.sum(axis=2, keepdims=True)
            good = self._good(said)

    @staticmethod
    def _said(votes: np.ndarray) -> np.ndarray:
        return np.stack([votes == v for v in (BAD, GOOD)], axis=2).astype(float)

    def _good(self, said: np.ndarray) -> np.ndarray:
        logs = np.log(self.share)[None] + np.einsum("plv,clv->pc", said, np.log(self.odds))
        member = np.exp(logs - logs.max(axis=1, keepdims=True))
        return member[:, GOOD] / member.sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """How likely documents with these votes are good."""
        return self._good(self._said(votes))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each labeller, the shares of right votes on bad and on good documents."""
        return {name: (float(self.odds[BAD, k, BAD]), float(self.odds[GOOD, k, GOOD])) for k, name in enumerate(LABELLERS)}


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer of hashed features, for labels between 0 and 1."""
    weights = np.zeros(WIDTH + 1)
    if not rows:
        return weights
    x = np.zeros((len(rows), WIDTH + 1), dtype=np.float32)
    x[:, WIDTH] = 1
    for k, (at, values) in enumerate(rows):
        np.add.at(x[k], at, values)
    labels = labels.astype(np.float32)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        said = 1 / (1 + np.exp(-np.clip(x @ weights.astype(np.float32), -30, 30)))
        slope = x.T @ ((said - labels) / len(rows)) + 1e-5 * np.append(weights[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return weights


def _texts(batch: pa.RecordBatch, k: int) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(k).to_pylist()]


def _votes(docs: DataFrame, text_col: str) -> dict[tuple[int, ...], int]:
    """How many documents have each pattern of votes: 3 ** labellers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts: dict[str, int] = {}
            for found, _ in measures(_texts(batch, 0)):
                pattern = "".join(str(vote(found)) for vote in LABELLERS.values())
                counts[pattern] = counts.get(pattern, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select(column(text_col)).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {tuple(map(int, r.pattern)): r.n for r in rows.orderBy("pattern").collect()}


def _sample(docs: DataFrame, text_col: str, share: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and votes of documents with different texts, about so many of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [(*features(found, kinds), [vote(found) for vote in LABELLERS.values()]) for found, kinds in measures(_texts(batch, 0))]
            kinds = [pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int8())]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(3)], ["at", "x", "votes"])

    text = F.coalesce(column(text_col), F.lit(""))
    chosen = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * share)).distinct()
    rows = chosen.mapInArrow(run, "at array<int>, x array<float>, votes array<byte>").collect()
    rows.sort(key=lambda r: (r.at, r.x))
    return [(np.array(r.at), np.array(r.x)) for r in rows], np.array([list(r.votes) for r in rows], dtype=np.int64).reshape(-1, len(LABELLERS))


def judge(docs: DataFrame, *, text_col: str = "text", most: int = TRAIN_DOCUMENTS, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``docs`` with ``weak_label``, ``quality`` (both 0 to 1, 1: good) and ``kept``.

    ``weak_label`` is the weak-label model's posterior, ``quality`` the
    scorer's. Votes of all documents are counted; the scorer is fitted on about
    ``most`` of their texts, chosen by hash. Texts are measured whole, however
    long, and equal texts are judged alike. A text that is null or has no word
    is rejected, with quality 0. An empty table gives no rows; input columns of
    the added names give way.
    """
    spark = docs.sparkSession
    ship_package(spark)
    patterns = _votes(docs, text_col)
    total = sum(patterns.values())
    labels = WeakLabels(patterns)
    rows, votes = _sample(docs, text_col, min(1.0, most / max(1, total)))
    weights = fit(rows, labels.posterior(votes))
    shared = spark.sparkContext.broadcast((labels, weights))
    names = ("weak_label", "quality", "kept")
    docs = without(docs, *names)

    @F.pandas_udf("struct<weak_label: double, quality: double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labels, weights = shared.value
        for batch in parts(batches):
            votes, scores = [], []
            for found, kinds in measures([(t or "").encode() for t in batch]):
                votes.append([vote(found) for vote in LABELLERS.values()])
                at, x = features(found, kinds)
                raw = float(weights[at] @ x + weights[-1])
                scores.append(1 / (1 + np.exp(-np.clip(raw, -500, 500))) if found["words"] else 0.0)
            weak = labels.posterior(np.array(votes, dtype=np.int64).reshape(-1, len(LABELLERS)))
            yield pd.DataFrame({"weak_label": weak, "quality": scores})

    return docs.withColumn("__said", scored(column(text_col))).select(
        *[column(c) for c in docs.columns], "__said.*", (F.col("__said.quality") >= reject_below).alias("kept")
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "weak_label", "quality", "kept")
