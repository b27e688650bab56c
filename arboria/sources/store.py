"""A versioned Parquet store of nodes, links and caches.

Nodes lie in buckets of their source path (256 of them, or 16 to the power `digits`), links in those of their first
end, files and their symbols in those of the path.  A commit writes only the buckets whose fingerprint changed, into a
directory of its version, and then replaces the pointer file CURRENT, by which readers find the directory of each bucket:
a reader sees one whole version, whatever is being written, and a crash before the pointer leaves the last version.
Directories that neither the current nor the last version reads are then removed.  The manifest has an entry a bucket and
table, so the driver holds a bounded list.

Queries pass over a file that can't be read, so a damaged bucket hides its own rows only.  What a commit is made of is
read strictly: it fails rather than write the loss as the new state.  repair() finds damaged buckets; from then on commits
go without what they held, and indexing their roots again brings it back.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {"nodes": "source_path", "links": "from", "files": "rel", "symbols": "rel"}
#: Fields that do not count as a change.
UNSEEN = {"created_at", "updated_at"}


def bucket(column: str, digits: int = 2):
    return F.left(F.sha1(F.coalesce(F.col(f"`{column}`"), F.lit("")).cast("binary")), F.lit(digits))


def fingerprints(rows: DataFrame) -> DataFrame:
    """bucket, fp: a hash of each bucket's rows that does not depend on their order, on times or on vectors' values."""
    fields = []
    for f in sorted(rows.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if f.name in UNSEEN or f.name == "bucket":
            continue
        kind = f.dataType.simpleString()
        fields.append((F.size(c) if f.name == "embedding" else F.round(c, 6) if kind == "double" else c).alias(f.name))
    one = F.sha2(F.to_json(F.struct(*fields)), 256)
    return rows.select("bucket", F.conv(F.left(one, F.lit(15)), 16, 10).cast("decimal(20,0)").alias("a"), F.conv(F.substring(one, 16, 15), 16, 10).cast("decimal(20,0)").alias("b")).groupBy("bucket").agg(F.sha2(F.concat_ws("|", F.sum("a").cast("string"), F.sum("b").cast("string"), F.count("*").cast("string")), 256).alias("fp"))


def open_schema(schema) -> dict:
    """As JSON, fields by name, all of them nullable: how rows were made doesn't count as a change."""

    def opened(kind):
        if isinstance(kind, dict):
            kind = {k: opened(v) for k, v in kind.items()}
            for k in ("nullable", "containsNull", "valueContainsNull"):
                if k in kind:
                    kind[k] = True
        return [opened(x) for x in kind] if isinstance(kind, list) else kind

    out = opened(schema.jsonValue())
    return out | {"fields": sorted(out["fields"], key=lambda f: f["name"])}


def of_bucket(buckets: dict[str, int]) -> list[str]:
    """Directories of buckets by their versions."""
    return [f"v={v}/bucket={b}" for b, v in buckets.items()]


class Store:
    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # ---- the pointer

    def manifest(self) -> dict:
        """Of the current version; an unreadable pointer is set aside and the store starts empty."""
        empty = {"version": 0, "buckets": {}, "fingerprints": {}, "schemas": {}, "active_root": None, "limits": {}, "digits": self.digits}
        if not self._fs.exists(self._p("CURRENT")):
            return empty
        try:
            return empty | {"digits": 2} | json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/CURRENT").collect()))
        except ValueError:
            self._fs.rename(self._p("CURRENT"), self._p("CURRENT.corrupt"))
            return empty

    def _point(self, manifest: dict) -> None:
        out = self._fs.create(self._p("_CURRENT.tmp"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._p("_CURRENT.tmp"), self._p("CURRENT"), options)

    # ---- reading and writing

    def read(self, table: str, manifest: dict | None = None, strict: bool = False) -> DataFrame | None:
        """The table as of the (given or current) manifest.

        strict: for what the next commit is made of.  A bucket that can't be read then fails, so that no commit takes a
        loss for the new state; only buckets that repair() has found are read as far as they can be.
        """
        from pyspark.sql.types import StructType

        m = manifest or self.manifest()
        if table not in m["schemas"]:
            return None
        schema = StructType.fromJson(m["schemas"][table])
        buckets = m["buckets"].get(table, {})
        sound = set(m["fingerprints"].get(table, {})) & set(buckets) if strict else set()
        out = None
        for some, lenient in (({b: v for b, v in buckets.items() if b not in sound}, "true"), ({b: buckets[b] for b in sound}, "false")):
            of_version: dict[int, list[str]] = {}
            for b, v in sorted(some.items()):
                of_version.setdefault(v, []).append(b)
            # one pattern a version; buckets that are not there are left out of it
            globs = {f"{self.path}/{table}/v={v}/bucket={{{','.join(bs)}}}": len(bs) for v, bs in of_version.items()}
            there = {g: len(self._fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(g)) or []) for g in globs}
            if lenient == "false" and self._holding(globs) != set(of_bucket(some)):
                raise RuntimeError(f"buckets of {table} are missing: put them back, or repair() and index their roots again")
            read = [g for g, n in there.items() if n]
            if read:
                rows = self.spark.read.schema(schema).option("ignoreCorruptFiles", lenient).option("ignoreMissingFiles", lenient).parquet(*read)
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _holding(self, globs) -> set[str]:
        """The bucket directories (v=.../bucket=...) of some patterns that hold a file."""
        files = (f for g in globs for f in self._fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{g}/*.parquet")) or [])
        return {"/".join(f.getPath().toString().split("/")[-3:-1]) for f in files}

    def commit(self, tables: dict[str, DataFrame], active_root: str | None = None, limits: dict | None = None) -> dict:
        """Writes the changed buckets of whole tables and moves the pointer; says how many buckets were written.

        limits: of roots, by which they are indexed again.
        """
        m = self.manifest()
        before = json.loads(json.dumps(m["buckets"]))
        version, report = m["version"] + 1, {}
        for name, rows in tables.items():
            keyed = rows.withColumn("bucket", bucket(KEYS[name], m["digits"]))
            new = {r.bucket: r.fp for r in fingerprints(keyed).collect()}
            schema = open_schema(rows.schema)
            old = m["fingerprints"].get(name, {}) if m["schemas"].get(name) == schema else {}
            dirty = sorted(b for b, fp in new.items() if old.get(b) != fp)
            if dirty:
                keyed.where(F.col("bucket").isin(*dirty)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{name}/v={version}")
            kept = m["buckets"].get(name, {})
            m["buckets"][name] = {b: version if b in dirty else kept[b] for b in new}
            m["fingerprints"][name], m["schemas"][name] = new, schema
            report[name] = len(dirty)
        m["version"], m["active_root"] = version, active_root or m["active_root"]
        m["limits"] |= limits or {}
        self._point(m)
        self._reap(before, m["buckets"])
        return report

    def _reap(self, *alive: dict) -> None:
        """Removes bucket directories that none of the given versions reads."""
        for table in KEYS:
            if not self._fs.exists(self._p(table)):
                continue
            read = {f"v={v}/bucket={b}" for buckets in alive for b, v in buckets.get(table, {}).items()}
            for v in self._fs.listStatus(self._p(table)):
                version, left = v.getPath().getName(), 0
                for b in self._fs.listStatus(v.getPath()):
                    name = b.getPath().getName()
                    if name.startswith("bucket=") and f"{version}/{name}" not in read:
                        self._fs.delete(b.getPath(), True)
                    else:
                        left += name.startswith("bucket=")
                if not left:
                    self._fs.delete(v.getPath(), True)

    def repair(self) -> dict:
        """Buckets whose rows are not those that were committed; they count as changed in the next commit."""
        m, out = self.manifest(), {}
        for name, known in m["fingerprints"].items():
            rows = self.read(name, m)
            now = {r.bucket: r.fp for r in fingerprints(rows.withColumn("bucket", bucket(KEYS[name], m["digits"]))).collect()}
            out[name] = sorted(b for b, fp in known.items() if now.get(b) != fp)
            m["fingerprints"][name] = {b: fp for b, fp in known.items() if now.get(b) == fp}
        if any(out.values()):
            self._point(m)
        return out

    def stats(self) -> dict:
        """Buckets of the current version and their bytes."""
        m, count, size = self.manifest(), 0, 0
        for name, buckets in m["buckets"].items():
            for b, v in buckets.items():
                p = self._p(f"{name}/v={v}/bucket={b}")
                if self._fs.exists(p):
                    count, size = count + 1, size + self._fs.getContentSummary(p).getLength()
        return {"path": self.path, "count": count, "bytes": size}

    def migrated(self, document: str) -> dict:
        """Takes over a graph that is one JSON document of nodes and links; a store that has rows stays as it is."""
        if self.manifest()["buckets"]:
            return {"status": "already_stored", "count": self.stats()["count"]}
        whole = self.spark.read.option("multiLine", "true").json(document)
        tables = {}
        for name, key in (("nodes", "source_path"), ("links", "from")):
            if name in whole.columns and "struct" in whole.schema[name].dataType.simpleString():
                rows = whole.select(F.inline(name))
                tables[name] = rows if key in rows.columns else rows.withColumn(key, F.lit(None).cast("string"))
        self.commit(tables)
        return {"status": "migrated", "from": "inline", "count": self.stats()["count"]}

    def reset(self) -> None:
        """Forgets everything, of all roots."""
        m = self.manifest()
        self._point({"version": m["version"] + 1, "buckets": {}, "fingerprints": {}, "schemas": {}, "active_root": None, "limits": {}, "digits": m["digits"]})


def other_roots(rows: DataFrame, root: str) -> DataFrame:
    """What stays when a root is indexed anew."""
    return rows.where(F.col("index_root").isNull() | (F.col("index_root") != root))


def spliced(old: DataFrame, new: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """old without the keys of `gone` and of new, and new."""
    return old.join(gone.select(key).unionByName(new.select(key)).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def reusable(files: DataFrame, registry: DataFrame, live: DataFrame) -> DataFrame:
    """Files (rel, sha1) that the registry (rel, sha1, node_ids) has unchanged, all of whose nodes are still live (id)."""
    same = files.join(registry, ["rel", "sha1"])
    ids = same.select("rel", "sha1", F.explode("node_ids").alias("id")).join(live.select("id", F.lit(1).alias("there")), "id", "left")
    return ids.groupBy("rel", "sha1").agg(F.bool_and(F.col("there").isNotNull()).alias("ok")).where("ok").select("rel", "sha1")
