"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unknown word
falls back to the longest character n-grams of it that are known, down to
single letters, and scores by their mean. A document's language has the
largest sum over its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, column, parts, ship_package, table

WORD = r"\p{L}[\p{L}\p{M}]*"
#: Different texts of each language learned from, about: a model of words and n-grams is no better for more.
TRAIN_DOCUMENTS = 20_000
#: Words, and n-grams of each length, that a model keeps of all languages together; each language has its share as many more.
VOCABULARY = 30_000
LONGEST = 5
#: Texts are chosen by their hash modulo this.
HASHES = 1 << 40
#: Added to every count.
SMOOTHING = 0.1
UNDETERMINED = "und"


class Model:
    """Log frequencies of words (length 0) and n-grams, one row a language."""

    def __init__(self, languages: list[str], prior: np.ndarray, rows: dict[int, dict[str, int]], logs: np.ndarray) -> None:
        import regex

        self.languages, self.prior, self.rows, self.logs = languages, prior, rows, logs
        self.words = regex.compile(WORD)
        self.room = max(20_000, 4_000_000 // max(1, len(languages)))
        self.forget()

    def forget(self) -> None:
        """Scores of the known words; those of others are added as they come."""
        self.place: dict[str, int] = dict(self.rows.get(0, {}))
        self.scores = np.zeros((len(self.logs) + self.room, len(self.languages)))
        self.scores[: len(self.logs)] = self.logs
        self.used = len(self.logs)

    def __reduce__(self):
        return Model, (self.languages, self.prior, self.rows, self.logs)

    def back_off(self, word: str) -> np.ndarray:
        """The score of an unknown word in each language."""
        padded = f"_{word}_"
        for n in range(min(LONGEST, len(padded)), 0, -1):
            known = self.rows.get(n, {})
            found = [known[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in known]
            if found:
                return self.logs[found].mean(axis=0)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a text and its posterior probability; ``und`` and 0 without a letter."""
        words = self.words.findall(text.lower()) if text else []
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        if self.used + len(words) > len(self.scores):
            self.forget()
            if self.used + len(words) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros((len(words), len(self.languages)))))
        place = self.place
        at = list(map(place.get, words))
        for k, known in enumerate(at):
            if known is None:
                word = words[k]
                if word not in place:
                    self.scores[self.used] = self.back_off(word)
                    place[word] = self.used
                    self.used += 1
                at[k] = place[word]
        sums = self.prior + self.scores[at].sum(axis=0)
        best = int(np.argmax(sums))
        return self.languages[best], float(1 / np.exp(sums - sums[best]).sum())


def held_out(id_: Column) -> Column:
    """Whether a document is kept from learning; one without an id is neither learned from nor held out."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(5)) == 0, F.lit(False))


#: Parts that the grams of one count are told apart by, where not all of them fit.
SLOTS = 4096


def _frequent(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of the rows of equal ``keys`` those with the greatest ``n``, ``most`` at most; of the last count that fits in part, some by a hash.

    Levels of equal counts are added up instead of ranking rows, so that no task
    gathers the rows of a key.
    """
    levels = counts.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("rows"))
    levels = levels.withColumn("upto", F.sum("rows").over(Window.partitionBy(*keys).orderBy(F.desc("n"))))
    over = F.col("upto") > most
    cut = levels.groupBy(*keys).agg(F.max(F.when(over, F.col("n"))).alias("cut"), (most - F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0))).alias("room"))
    slotted = counts.withColumn("slot", F.pmod(F.xxhash64("gram"), F.lit(SLOTS)).cast("int")).join(F.broadcast(cut), keys)  # a row for each language and length
    slots = slotted.where("n = cut").groupBy(*keys, "slot", "room").agg(F.count(F.lit(1)).alias("rows"))
    fits = slots.withColumn("upto", F.sum("rows").over(Window.partitionBy(*keys).orderBy("slot"))).where("upto <= room").groupBy(*keys).agg(F.max("slot").alias("last"))
    return slotted.join(F.broadcast(fits), keys, "left").where("cut is null or n > cut or (n = cut and slot <= last)").select(*counts.columns)


def learn(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCUMENTS, vocabulary: int = VOCABULARY
) -> Model:
    """A model of the documents that have a text and a language.

    About ``most`` different texts of each language, chosen by a hash of the
    text, are counted whole, however long; copies count once. The model holds
    the most frequent words and n-grams of each length, ``vocabulary`` of all
    languages together and ``vocabulary`` shared out evenly among the languages,
    so that none is lost among larger ones. A word that it does not hold is
    scored by its n-grams, down to single letters. What comes to the driver and
    goes to the workers is 48 bytes at most for each of ``vocabulary`` and
    language. Without a labelled text the model knows no language.
    """
    labelled = docs.where(column(text_col).isNotNull() & column(lang_col).isNotNull()).select(
        column(text_col).alias("text"), column(lang_col).alias("lang")
    )
    known = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")).collect()
    shares = {r.lang: min(1.0, most / max(1, r.texts)) for r in known}
    taken = docs.sparkSession.createDataFrame([(lang, int(HASHES * share)) for lang, share in shares.items()], "lang string, below long")
    chosen = F.pmod(F.xxhash64("text"), F.lit(HASHES)) < F.col("below")
    labelled = labelled.join(F.broadcast(taken), "lang").where(chosen).select("lang", "text").distinct()
    words = labelled.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("gram"))
    words = checkpointed(words.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")).withColumn("length", F.lit(0)))
    padded = F.concat(F.lit("_"), "gram", F.lit("_"))
    grams = (
        words.select("lang", "n", padded.alias("word"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("length"))
        .where("length <= char_length(word)")
        .select("lang", "n", "length", F.explode(F.expr("transform(sequence(1, char_length(word) - length + 1), i -> substring(word, i, length))")).alias("gram"))
        .groupBy("lang", "length", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counted = checkpointed(words.select("lang", "length", "gram", "n").unionByName(grams))
    sums = counted.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()

    together = checkpointed(counted.groupBy("length", "gram").agg(F.sum("n").alias("n")))
    kept = _frequent(together, ["length"], vocabulary).select("length", "gram")
    own = _frequent(counted, ["lang", "length"], max(1, vocabulary // max(1, len(shares)))).select("length", "gram")
    rows = counted.join(kept.unionByName(own).distinct(), ["length", "gram"]).collect()
    return _model(sums, rows, shares)


def _model(sums: list, rows: list, shares: dict[str, float]) -> Model:
    languages = sorted({r.lang for r in sums})
    at = {lang: k for k, lang in enumerate(languages)}
    mass = np.zeros((LONGEST + 1, len(languages)))
    for r in sums:
        mass[r.length, at[r.lang]] += r.n
    places: dict[int, dict[str, int]] = defaultdict(dict)
    number = 0
    for r in rows:
        if r.gram not in places[r.length]:
            places[r.length][r.gram] = number
            number += 1
    counts = np.zeros((number, len(languages)))
    length = np.zeros(number, dtype=np.int64)
    for r in rows:
        k = places[r.length][r.gram]
        counts[k, at[r.lang]], length[k] = r.n, r.length
    size = np.bincount(length, minlength=LONGEST + 1)[:, None]
    logs = np.log(counts + SMOOTHING) - np.log(mass + SMOOTHING * (size + 1))[length]
    # As many words as all texts of a language have, not those chosen alone.
    whole = np.maximum(mass[0], 1) / np.array([shares[lang] for lang in languages])
    prior = np.log(whole / max(1.0, whole.sum()))
    return Model(languages, prior, dict(places), logs)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if no language was learned. Of languages that score alike the first in
    code point order is said; equal texts get equal answers. Every row stays, an
    empty table gives no rows. Input columns of the two names give way.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in parts(batches):
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.withColumn("__said", predicted(column(text_col))).select(*[column(c) for c in kept], "__said.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    taught = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    return identify(docs.select("doc_id", "text"), learn(taught)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
