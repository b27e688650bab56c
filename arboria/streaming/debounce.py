"""Debouncing as keyed state of a stream, with timers: what is pending lies in the checkpoint, so a restart loses nothing and
repeats nothing.  Keys, null among them, are of a type that text tells apart.

quieted()   by processing time, for watching files: a path is passed on once nothing has come for it for so long
settled()   by event time, for logs: the last of each burst is passed on once the watermark says that no other can follow

On a log that has no late rows settled() gives what watch.debounced() gives in batch, of all that the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a bucket that are joined with its bursts at once; where there are more bursts, as many as these.
_ROWS = 100_000
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State with timers needs the state store of Spark that has them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _keyed(rows: DataFrame, key: str):
    """A key as text that is never null (whole numbers beside a null key would reach pandas as floats), and the way back."""
    kind = rows.schema[key].dataType
    own = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key_text")
    return own, F.when(F.col("key_text") != "", F.substring("key_text", 2, 1 << 30).cast(kind)).alias(key)


class _Quiet(StatefulProcessor):
    """A key's latest change, and one timer, put off by each further change."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = [int(pdf["at_last"].max()) for pdf in rows if len(pdf)]
        if self.last.exists():
            seen.append(self.last.get()[0])
        self.last.update((max(seen),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            at = self.last.get()[0]
            self.last.clear()
            yield pd.DataFrame({"key_text": [key[0]], "at_last": [at]})

    def close(self) -> None:
        pass


def quieted(changes: DataFrame, seconds: float, key: str = "rel", at: str = "mtime") -> DataFrame:
    """key, at: each key's latest change, once `seconds` of processing time have passed without another."""
    keyed_state(changes.sparkSession)
    own, back = _keyed(changes, key)
    rows = changes.select(own, F.col(at).cast("long").alias("at_last"))
    out = rows.groupBy("key_text").transformWithStateInPandas(_Quiet(int(seconds * 1000)), "key_text string, at_last long", "Append", "ProcessingTime")
    return out.select(back, F.col("at_last").alias(at))


class _Settled(StatefulProcessor):
    """The bursts of a bucket's keys that the watermark has not settled yet, and one timer, for the first of their ends: states and
    timers of each key, or of each end, cost many times what all else does.

    A burst is its first and last change: between these every change has another within the time, so none is an end.  A timer
    may come early (its burst went on since); it never comes late.
    """

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.pending = handle, handle.getValueState("pending", "bursts binary")

    def _known(self) -> pd.DataFrame:
        held = self.pending.get()
        return pa.ipc.open_stream(held[0]).read_pandas() if held else pd.DataFrame({"key_text": [], "first": [], "last": []}).astype({"first": "int64", "last": "int64"})

    def _keep(self, bursts: pd.DataFrame) -> None:
        table, sink = pa.Table.from_pandas(bursts, pa.schema([("key_text", pa.string()), ("first", pa.int64()), ("last", pa.int64())]), preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.pending.update((sink.getvalue().to_pybytes(),))

    def _wait(self, bursts: pd.DataFrame) -> None:
        """A timer for the first end: past the watermark always, as one that expires is deleted by its time after it was handled."""
        self.handle.registerTimer(int(bursts["last"].min()) // 1000 + self.millis)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = bursts = self._known()
        for new in _gathered(rows, lambda: max(_ROWS, len(bursts))):
            bursts = _bursts(pd.concat([bursts, pd.DataFrame({"key_text": new["key_text"], "first": new["at_us"], "last": new["at_us"]})]), 1000 * self.millis)
        self._keep(bursts)
        if known.empty or bursts["last"].min() < known["last"].min():
            self._wait(bursts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        settled = known["last"] // 1000 + self.millis <= timerValues.getCurrentWatermarkInMs()
        done, left = known[settled], known[~settled]
        if left.empty:
            self.pending.clear()
        else:
            if len(done):
                self._keep(left)
            self._wait(left)
        if len(done):
            yield pd.DataFrame({"key_text": done["key_text"], "at_us": done["last"]})

    def close(self) -> None:
        pass


def _gathered(rows: Iterator[pd.DataFrame], size: Callable[[], int]) -> Iterator[pd.DataFrame]:
    """Frames of at least size() rows, and what is left."""
    some, n = [], 0
    for pdf in rows:
        some.append(pdf[["key_text", "at_us"]])
        n += len(pdf)
        if n >= size():
            yield pd.concat(some)
            some, n = [], 0
    if some:
        yield pd.concat(some)


def _bursts(spans: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Spans (key_text, first, last), those of a key joined where one begins less than `gap` after another's end."""
    codes, keys = pd.factorize(spans["key_text"])
    first, last = spans["first"].to_numpy(np.int64), spans["last"].to_numpy(np.int64)
    order = np.lexsort((first, codes))
    codes, first = codes[order], first[order]
    last = pd.Series(last[order]).groupby(codes).cummax().to_numpy()
    ends = np.append((codes[1:] != codes[:-1]) | (first[1:] - last[:-1] >= gap), True)
    starts = np.append(True, ends[:-1])
    return pd.DataFrame({"key_text": np.asarray(keys, object)[codes[starts]], "first": first[starts], "last": last[ends]})


def settled(events: DataFrame, key: str, at: str, seconds: float, delay: str = "0 seconds", buckets: int = 4096) -> DataFrame:
    """key, at: changes that no other of the key follows within `seconds`, once the watermark (the latest time less `delay`) has passed that.

    State lies by bucket, keys being dealt by hash; a checkpoint holds for the number of buckets that it was made with.
    """
    keyed_state(events.sparkSession)
    own, back = _keyed(events, key)
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).where(F.col(at).isNotNull()).select(own, at, F.unix_micros(at).alias("at_us"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key_text"), F.lit(buckets))).groupBy("bucket")
    out = dealt.transformWithStateInPandas(_Settled(int(seconds * 1000)), "key_text string, at_us long", "Append", "EventTime")
    return out.select(back, F.timestamp_micros("at_us").alias(at))
