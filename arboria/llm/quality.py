"""Quality rules with host verdicts [operator 10].

Each text gets counts and the base rule; these and three softer rules say whether a document failed.  Failures
are added up by host (for documents: their source), an empirical beta prior is fitted to the hosts' rates by
moments, and each host's rate is shrunk towards it: few documents say little, many speak for themselves.  Hosts of
which by that four in five documents fail (a shrunk rate above `host_rate`) are rejected, and the verdict goes back to their
documents, with the numbers that it follows from.

Hot hosts: counts are added up before the shuffle, so a host with a third of all rows sends one row a task.  The
verdict table is joined on narrow rows; only Spark's own run-time size check makes it a broadcast.

Defined results: null text has no words (so the base rule fails); null host is a host of its own; repeated rows
give a row each; an empty table gives no rows; other columns are carried along untouched by `annotated`, and of no
concern elsewhere, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 5
#: Hosts with a higher shrunk rate of failures are rejected.
HOST_RATE = 0.8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(windows: np.ndarray) -> int:
    """Words inside windows that stand twice or more; windows: hashes of a text's consecutive windows."""
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    edge = np.zeros(len(windows) + WINDOW, np.int64)
    edge[:-WINDOW] += hit
    edge[WINDOW:] -= hit
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def text_counts(column) -> list[np.ndarray]:
    """The columns of _COUNTS for a binary column of texts."""
    buf, off = C.flat(column)
    out = [np.zeros(len(off) - 1, np.int64) for _ in range(5)]
    for a, b in C.chunks(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        s, e, w = C.spans(part, o, C.NOT_SPACE)
        out[0][a:b] = np.diff(w)
        for k, flag in ((1, C.NOT_SPACE[part] & ((part & 0xC0) != 0x80)), (2, _SYMBOL[part])):
            out[k][a:b] = np.diff(np.concatenate([[0], np.cumsum(flag)])[o])
        shingles, so = C.shingle_hashes(C.word_hashes(part, s, e), w, WINDOW)
        data, so = part.tobytes(), so.tolist()
        out[3][a:b] = [dup_lines(data[x:y]) for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
        out[4][a:b] = [repeat_words(shingles[x:y]) if y - x > 1 else 0 for x, y in zip(so[:-1], so[1:], strict=True)]
    return out


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def any_failed():
    """What counts against a document's host: the base rule, many symbols, many equal lines, or odd word lengths."""
    symbols = 10 * F.col("n_symbols") > F.col("n_words")
    lines = F.col("n_dup_lines") > 5
    length = (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))
    return base_failed() | symbols | lines | length


def annotated(docs: DataFrame, host: str = "source", carry=("doc_id",)) -> DataFrame:
    """row (a struct of the carried columns), host and the counts of each document."""
    C.short_batches(docs.sparkSession)
    counts = C.per_text(lambda texts: [pa.array(x) for x in text_counts(texts)], _COUNTS)
    rows = docs.select(F.struct(*carry).alias("row"), F.col(host).cast("string").alias("host"), counts(C.text_bytes()).alias("counts"))
    return rows.select("row", "host", "counts.*").withColumn("base_failed", base_failed())


def host_rates(rows: DataFrame, most: float = 100.0) -> DataFrame:
    """host, host_docs, host_failures and host_rate, the shrunk rate, of each host, from annotated rows.

    The prior weighs one document at least and `most` at most; where hosts differ no more than chance makes them,
    that is `most`.
    """
    hosts = C.stash(rows.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(any_failed().cast("long")).alias("host_failures")), "hosts")
    rate = F.col("host_failures") / F.col("host_docs")
    n, failures, var, inverse = hosts.agg(F.sum("host_docs"), F.sum("host_failures"), F.var_pop(rate), F.avg(1 / F.col("host_docs"))).first()
    mean = (failures or 0) / n if n else 0.0
    between = (var or 0.0) - mean * (1 - mean) * (inverse or 0.0)
    weight = min(most, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else most
    return hosts.withColumn("host_rate", (F.col("host_failures") + F.lit(weight * mean)) / (F.col("host_docs") + F.lit(weight)))


def judged(rows: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """Annotated rows (a stash) with the facts about their host, and kept."""
    hosts = host_rates(rows)
    out = rows.join(hosts.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_")), "left").drop("host_")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= host_rate))


def quality_rules(docs: DataFrame, host: str = "source", host_rate: float = HOST_RATE, carry=("doc_id",)) -> DataFrame:
    """row, host, the counts, base_failed, host_docs, host_failures, host_rate and kept of each document."""
    return judged(C.stash(annotated(docs, host, carry), "quality"), host_rate)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(C.table(spark, sf_dir, "documents"))
    counts = [c.split()[0] for c in _COUNTS.split(", ")]
    return out.select("row.doc_id", *counts, "base_failed", "host_docs", "host_failures", F.round("host_rate", 9).alias("host_rate"), "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d
), dup AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.rid = rep.rid LEFT JOIN dup ON d.rid = dup.rid
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), f AS (
  SELECT *, base_failed OR 10 * n_symbols > n_words OR n_dup_lines > 5 OR word_chars > 15 * n_words OR word_chars < 2 * n_words AS any_failed FROM b
), hosts AS (
  SELECT source, count(*) AS n, sum(any_failed::INT) AS failures FROM f GROUP BY source
), prior AS (
  SELECT sum(failures) / sum(n) AS mean, var_pop(failures / n) - sum(failures) / sum(n) * (1 - sum(failures) / sum(n)) * avg(1.0::DOUBLE / n) AS between_ FROM hosts
), weighted AS (
  SELECT mean, CASE WHEN between_ > 0 THEN least(100.0, greatest(1.0, mean * (1 - mean) / between_ - 1)) ELSE 100.0 END AS weight FROM prior
), rates AS (
  SELECT source, n, failures, (failures + weight * mean) / (n + weight) AS rate FROM hosts, weighted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n AS host_docs, failures::BIGINT AS host_failures,
       round(rate, 9) AS host_rate, NOT base_failed AND rate <= 0.8 AS kept FROM f JOIN rates ON rates.source IS NOT DISTINCT FROM f.source
"""
