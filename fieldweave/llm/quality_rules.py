"""Quality rules of documents and of their hosts.

Every text is measured; texts that break a rule fail. Failures are added up by host (the source
column), the hosts' failure rates are shrunk by a beta prior fitted to all hosts (method of moments),
and the verdict on each host goes back to its documents: those of a host whose shrunken rate is above
a bound are not kept. The bound comes from the fitted prior, too: ``deviations`` standard deviations above its
mean, so that a host goes when it fails much more often than hosts do here. It is never below
``spared_host_rate`` (a host is not rejected for failing rarely, however alike the others are) nor above ``max_host_rate``.

Null text has no words and fails. Documents without a host are judged by their own rules only. Ties
and repeated rows are separate documents; an empty table gives an empty result; columns of the input
other than id, host and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.common import WORD, cut, spread, table, written

_WORD = re.compile(WORD)
_FEW_HOSTS = 100_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines equal to an earlier one, words in repeated 3-word windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        reach = 0  # first word not yet counted
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=MEASURES, dtype="int64")


def base_failed(m: str, least_words: int, repeat_percent: int) -> Column:
    return (F.col(f"{m}.n_words") < least_words) | (100 * F.col(f"{m}.n_repeat_words") > repeat_percent * F.col(f"{m}.n_words"))


def host_rates(rows: DataFrame, deviations: float = 2.0, spared_host_rate: float = 0.2, max_host_rate: float = 0.5) -> DataFrame:
    """host, host_rate and rejected from rows of host and base_failed. The prior is one row; the table has a row a host."""
    hosts = cut(rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("bad")))
    n, mean = F.sum("n"), F.sum("bad") / F.sum("n")
    prior = hosts.agg(n.alias("all_n"), F.count(F.lit(1)).alias("hosts"), mean.alias("m"), (F.sum(F.col("bad") * F.col("bad") / F.col("n")) / n - mean * mean).alias("v"))
    spare = F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.col("v") - spare * F.col("hosts") / F.col("all_n"), F.lit(1e-9))
    prior = prior.select("m", F.least(F.greatest(spare / between - 1, F.lit(1.0)), F.lit(10_000.0)).alias("strength"))
    bound = F.least(F.greatest(F.col("m") + deviations * F.sqrt(spare / (F.col("strength") + 1)), F.lit(spared_host_rate)), F.lit(max_host_rate))
    shrunk = (F.col("bad") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(prior), F.lit(True), "left").select("host", shrunk.alias("host_rate"), (shrunk > bound).alias("rejected"))


def judge(docs: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text", least_words: int = 50, repeat_percent: int = 50, **bounds: float) -> DataFrame:
    """id, host, the five measures, base_failed, host_rate (null without a host) and kept, for every document; bounds are those of host_rates."""
    measured = spread(docs).select(F.col(id_column).alias("id"), F.col(host_column).alias("host"), measures(F.col(text_column)).alias("m"))
    rows = cut(measured.select("id", "host", "m.*", base_failed("m", least_words, repeat_percent).alias("base_failed")))
    hosts = cut(host_rates(rows, **bounds))
    if hosts.count() <= _FEW_HOSTS:  # then rows need not be shuffled by host
        hosts = F.broadcast(hosts)
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("rejected"), F.lit(False))
    return rows.join(hosts, "host", "left").select(F.col("id").alias(id_column), "host", *MEASURES, "base_failed", "host_rate", kept.alias("kept"))


def keep_passed(docs: DataFrame, host_column: str = "source", text_column: str = "text", least_words: int = 50, repeat_percent: int = 50, **bounds: float) -> DataFrame:
    """docs without the rows that fail or whose host is rejected; columns stay as they are. Texts are measured once and written with the outcome."""
    failed = base_failed("__m", least_words, repeat_percent)
    measured = written(spread(docs).withColumn("__m", measures(F.col(text_column))).withColumn("__failed", failed).drop("__m"))
    rows = measured.select(F.col(host_column).alias("host"), F.col("__failed").alias("base_failed"))
    rejected = cut(host_rates(rows, **bounds).where("rejected").select(F.col("host").alias("__host")))
    if rejected.count() <= _FEW_HOSTS:
        rejected = F.broadcast(rejected)
    return measured.where(~F.col("__failed")).join(rejected, F.col(host_column) == F.col("__host"), "left_anti").select(*docs.columns)


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


SQL = r"""
WITH words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM ruled WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT sum(n)::DOUBLE AS all_n, count(*) AS hosts, sum(bad) / sum(n) AS m,
         sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) * (sum(bad) / sum(n)) AS v FROM hosts
), prior AS (
  SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * hosts / all_n, 1e-9) - 1, 1.0), 10000.0) AS strength FROM moments
), rates AS (
  SELECT source, (bad + m * strength) / (n + strength) > least(greatest(m + 2 * sqrt(m * (1 - m) / (strength + 1)), 0.2), 0.5) AS rejected FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM ruled LEFT JOIN rates USING (source)
"""
