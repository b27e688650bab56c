"""Watching a tree: a streaming source of changed files, debouncing, and incremental indexing.

Spark's file source does not report a file again that has changed, so changes come from a Python data source.  It
compares listings: a file is reported when it is new, gone, or has another modification time than at the last look, even
an older one.  The first look is at the call, so nothing is ingested at the start.  A restarted stream, which has no last
look, reports what was modified since its offset; the next ingest finds what is gone.  With a quiet time, a path goes into
keyed state with a timer (see debounce) and is ingested only once it has stayed as it is for that long, so a burst of
writes is one change, over a restart too.  Each micro-batch's paths are ingested: only these files are read and parsed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources import scan
from . import debounce

TEMPORARY = ("~", ".tmp", ".swp", ".part")


def latest(files) -> int:
    return max((at for _, at in files), default=0)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, suffixes: tuple[str, ...], since: str | None):
        self.root, self.suffixes, self.since = root, suffixes, since
        self.known: dict[str, int] | None = None

    def _now(self) -> dict[str, int]:
        return {rel: at for rel, _, at in scan.listed(self.root, self.suffixes) if not rel.endswith(TEMPORARY)}

    def initialOffset(self) -> dict:
        return {"at": int(self.since) if self.since else latest(self._now().items()), "n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self._now()
        if self.known is None:
            self.known = {rel: at for rel, at in now.items() if at <= start["at"]}
        changed = [(rel, at) for rel, at in now.items() if self.known.get(rel) != at]
        gone = [rel for rel in self.known if rel not in now]
        for rel in gone:
            del self.known[rel]
        self.known.update(changed)
        rows = [*changed, *((rel, start["at"]) for rel in gone)]
        return iter(rows), {"at": max(latest(changed), start["at"]), "n": start.get("n", 0) + bool(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for r in self._now().items() if start["at"] < r[1] <= end["at"]])


class FileChanges(DataSource):
    """Format "file_changes": rel, mtime (ns) of files new, modified or gone since the last batch.  Options: path, suffixes, since (ns)."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "rel string, mtime long"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], tuple(self.options.get("suffixes", ".py").split(",")), self.options.get("since"))


def changes(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py",), quiet: float = 0.0) -> DataFrame:
    """Changes from now on: what the tree holds at this call is the baseline.  quiet: seconds without a further change of a path."""
    spark.dataSource.register(FileChanges)
    since = latest([(rel, at) for rel, _, at in scan.listed(root, suffixes)])
    rows = spark.readStream.format("file_changes").option("path", root).option("suffixes", ",".join(suffixes)).option("since", str(since or 1)).load()
    return debounce.quieted(rows, quiet) if quiet > 0 else rows


def debounced(events: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Of each path's changes those that no other follows within `seconds`: the last of each burst."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = events.withColumn("_next", following)
    return rows.where(F.col("_next").isNull() | (micros("_next") - micros(at) >= int(seconds * 1e6))).drop("_next")


def settled(batch: DataFrame, key: str = "rel", at: str = "mtime") -> DataFrame:
    """A micro-batch's latest change of each path."""
    return batch.groupBy(key).agg(F.max(at).alias(at))


def watch(spark: SparkSession, root: str, ingest: Callable[[list[str]], dict], checkpoint: str, seconds: float = 1.0, said: Callable[[dict], None] | None = None, quiet: float = 0.0):
    """Starts a stream that hands each batch's changed paths to ingest(); a failure is said, not raised."""

    def each(batch: DataFrame, n: int) -> None:
        paths = [r.rel for r in settled(batch).orderBy("rel").collect()]
        if not paths:
            return
        try:
            event = ingest(paths) | {"batch": n, "paths": paths}
        except Exception as e:  # one bad file must not end the watch
            event = {"batch": n, "paths": paths, "error": str(e)[:500]}
        if said:
            said(event)

    return changes(spark, root, quiet=quiet).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
