"""What operators leave on disk and take of executors' memory beside their rows."""

from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from arboria.llm import common as C
from arboria.llm import context_mixing, line_dedup, token_store


def shuffled(spark) -> set:
    """Shuffle files of the session."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}


def test_a_stash_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    rows = spark.range(20_000).withColumn("k", F.col("id") % 7)
    kept = C.stash(rows.groupBy("k").agg(F.sum("id").alias("s")).repartition(3, "s"), "sums")
    assert not shuffled(spark) - before
    assert kept.count() == 7 and kept.agg(F.sum("s")).first()[0] == sum(range(20_000))
    assert spark.conf.get(C._FREED) == "false"


def test_rows_of_the_driver_need_no_python_on_executors(spark):
    rows = C.of_driver(spark, [(1, 2, "a"), (None, 3, None)], "k int, n long, s string")
    assert rows.collect() == [(1, 2, "a"), (None, 3, None)] and rows.dtypes == [("k", "int"), ("n", "bigint"), ("s", "string")]
    assert C.of_driver(spark, [], "k int, n long").collect() == []
    summed = C.running(spark.range(1000).withColumn("w", F.lit(2).cast("long")), F.col("id").asc(), "w")
    assert "ExistingRDD" not in summed._jdf.queryExecution().toString()
    assert summed.where("before <> 2 * id").count() == 0 and summed._total == 2000
    C.drop(summed)


def test_encoding_and_shards_take_one_pass(spark, sf):
    docs = C.table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    bounds = np.array([30, 90], np.int64)
    coded = token_store.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), bounds=bounds)
    assert "ArrowEvalPython" not in coded._jdf.queryExecution().toString()
    want = {r[0]: r[1] for r in docs.select("doc_id", C.shard_of(spark, "doc_id", bounds)).collect()}
    assert {r.doc_id: r.shard for r in coded.collect()} == want and set(want.values()) == {0, 1, 2}


def test_lines_leave_no_shuffle_files(spark, sf):
    before = shuffled(spark)
    lines, links = line_dedup.line_dedup(C.table(spark, sf, "documents"))
    assert not shuffled(spark) - before
    C.drop(lines, links)


def test_context_mixing_leaves_no_shuffle_files(spark, sf):
    before = shuffled(spark)
    scores = context_mixing.score_documents(C.table(spark, sf, "documents"))  # all but the last step ran
    assert not [f for f in shuffled(spark) - before if f.stat().st_size > 1 << 14]
    assert scores.columns[:2] == ["doc_id", "held_out"]


def moved(spark):
    """Rows that all stages so far wrote to shuffles."""
    jvm, none = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_lines_that_are_alone_are_moved_twice(spark):
    """Once to the block of their line, once as what a block of documents asks for: not to each join of lines with links."""
    rows = [(i, "\n".join(f"{i * 7 + k} {(i * 7 + k) * 7919 % 100003} alone {(i * 7 + k) ** 3}" for k in range(7))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = moved(spark)
    got = line_dedup.deduplicated(df)
    assert moved(spark) - before < 3 * 7 * 600
    assert got.agg({"n_lines": "sum"}).first()[0] == 7 * 600


def test_sketches_and_distinct_keys_are_those_of_each_line():
    lines = ["a", "ab", "été 🙂 x", "aaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog", "b" * 70]
    assert line_dedup.sketches(lines).tolist() == [int(line_dedup.sketches([x])[0]) for x in lines] and line_dedup.sketches([]).tolist() == []
    for least in (0, 10, 100):
        whole = line_dedup.Lines(lines)
        want = {}
        for x, k, mine in zip(*(c.tolist() for c in whole.keys(2, least)), strict=True):
            want[x, k] = want.get((x, k), False) or mine
        got = list(zip(*(c.tolist() for c in whole.distinct_keys(2, least)), strict=True))
        assert got == [(x, k, want[x, k]) for x, k in sorted(want)]
