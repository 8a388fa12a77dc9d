"""URL filters: block and allow rules, then a weighted vocabulary.

An Aho-Corasick automaton finds every term of the vocabulary in one pass over
the url after its scheme. A hit counts where no letter or digit touches it. One
strict term rejects; soft terms reject only when several different ones hit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, column, ship_package, table, without

#: Host, path, verdict. The longest rule that fits a url wins.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
STRICT = ("adult", "casino", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT = (
    "ads", "bet", "bets", "bonus", "cheap", "click", "crack", "dating", "deal", "farm", "free", "jackpot",
    "loan", "pills", "poker", "sexy", "slots", "track", "win", "x",
)
SOFT_HITS = 2

_LOWER = str.maketrans(UPPER, LOWER)


class Vocabulary:
    """Strict and soft terms, A-Z lower-cased, and how many different soft ones reject."""

    def __init__(self, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS) -> None:
        self.strict = frozenset(t.translate(_LOWER) for t in strict if t)
        self.soft = frozenset(t.translate(_LOWER) for t in soft if t) - self.strict
        self.soft_hits = soft_hits

    def __reduce__(self):
        return Vocabulary, (sorted(self.strict), sorted(self.soft), self.soft_hits)

    @cached_property
    def automaton(self):
        """Made once in each worker that the vocabulary is sent to."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for weight, terms in ((False, self.soft), (True, self.strict)):
            for term in terms:
                made.add_word(term, (term, weight))
        if terms := len(made):
            made.make_automaton()
        return made if terms else None

    def rejects(self, text: str | None) -> bool:
        """Whether it rejects a url without its scheme."""
        if not text or self.automaton is None:
            return False
        text = text.translate(_LOWER)
        seen = set()
        for end, (term, weight) in self.automaton.iter(text):
            start = end - len(term) + 1
            if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            if weight:
                return True
            seen.add(term)
            if len(seen) >= self.soft_hits:
                return True
        return False


def read_vocabulary(spark: SparkSession, path: str, *, soft_hits: int = SOFT_HITS) -> Vocabulary:
    """A vocabulary from a text file of lines ``term<TAB>strict`` or ``term<TAB>soft``; it goes to every worker whole."""
    lines = [r.value.split("\t") for r in spark.read.text(path).where("trim(value) <> ''").collect()]
    if wrong := next((x for x in lines if len(x) != 2 or x[1].strip() not in ("strict", "soft")), None):
        raise ValueError(f"not a term and its weight: {wrong}")
    of = lambda weight: [term.strip() for term, said in lines if said.strip() == weight]
    return Vocabulary(of("strict"), of("soft"), soft_hits)


def without_scheme(url: Column) -> Column:
    """What follows the first ``://``; the url itself if it has none."""
    return F.regexp_replace(url, r"^(?s:.*?)://", "")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1)
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` with ``__rule``, the rule that fits ``__host`` and ``__path``, or null.

    Each different host meets the rules of itself and of the hosts above it by
    equal names, so a url costs what rules its own hosts have, however many
    there are in all.
    """
    labels = F.split("__host", r"\.")
    above = F.expr("transform(sequence(1, size(labels)), k -> array_join(slice(labels, k, size(labels)), '.'))")
    hosts = urls.select("__host").distinct().withColumn("labels", labels).select("__host", F.explode(above).alias("host"))
    known = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").where("host is not null and path is not null").distinct()
    name = F.concat("host", "path")
    fitting = hosts.join(known, "host").select("__host", F.struct(F.char_length(name).alias("length"), name.alias("rule"), "verdict", "path").alias("r"))
    fitting = fitting.groupBy("__host").agg(F.sort_array(F.collect_list("r"), asc=False).alias("__fitting"))
    met = urls.join(fitting, "__host", "left")
    return met.withColumn("__rule", F.get(F.filter("__fitting", lambda r: F.startswith(F.col("__path"), r["path"])), F.lit(0))).drop("__fitting")


def filter_urls(
    pages: DataFrame,
    *,
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] | DataFrame = RULES,
    vocabulary: Vocabulary | None = None,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    A rule fits its host and all hosts below it where the path starts with the
    rule's; the longest wins, of equally long ones the later. A few rules are a
    list, and become expressions; a table of any size (``host``, ``path``,
    ``verdict``; of equally long rules the one that comes later as text wins) is
    joined to the hosts. The vocabulary
    judges the rest, by the whole url after its scheme, query and fragment
    included. A url without ``://`` has an empty host and path and is judged as
    it stands; a null one has both empty and is allowed. Urls are taken whole,
    however long. Every row stays, repeated ones too; an empty table gives no
    rows; input columns of the four names give way.
    """
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary or Vocabulary())

    @F.pandas_udf("boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            yield pd.Series([own.rejects(x) for x in batch], dtype=bool)

    url = column(url_col)
    host, path = host_and_path(url)
    out = pages.select("*", judged(without_scheme(url)).alias("__bad"), host.alias("__host"), path.alias("__path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    if isinstance(rules, DataFrame):
        out = _with_rules(out, rules)
        rule, verdict = F.col("__rule.rule"), F.col("__rule.verdict")
        rules = ()
    for name, start, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("__host") == name) | F.col("__host").endswith("." + name)) & F.col("__path").startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    kept = [column(c) for c in without(pages, "host", "path", "rule", "verdict").columns]
    verdict = F.coalesce(verdict, F.when(F.col("__bad"), "block").otherwise("allow"))
    return out.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), verdict.alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def _bounded(terms: Sequence[str]) -> str:
    return "(^|[^\\p{L}\\p{N}])(" + "|".join(terms) + ")($|[^\\p{L}\\p{N}])"


_SOFT_SUM = " + ".join(f"CAST(regexp_matches(u, '{_bounded([t])}') AS INTEGER)" for t in SOFT)
OP8_SQL = f"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         translate(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE url END, '{UPPER}', '{LOWER}') AS u FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, u FROM a),
c AS (
  SELECT page_id, host, path, coalesce(u, '') AS u,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM b)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(u, '{_bounded(STRICT)}') THEN 'block'
       WHEN {_SOFT_SUM} >= {SOFT_HITS} THEN 'block'
       ELSE 'allow' END AS verdict
FROM c
"""
