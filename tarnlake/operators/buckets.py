"""Keyed tables of which a merge rewrites only the buckets that a batch touches.

A table is a folder of generations of bucket folders and a manifest for each version: which generation holds each
bucket. A merge reads the buckets of the batch's keys, writes their new content as a new generation and then puts the next manifest in
place by one rename, so readers see the old table or the new one and a crash leaves nothing that a reader sees. Untouched buckets are neither read nor
written; within touched ones, rows of other keys pass by without a shuffle while the batch's keys are few enough to broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a batch that are broadcast at most; beyond it they are joined by a shuffle of the touched buckets.
BROADCAST_KEYS = 500_000
BUCKET = "_bucket"


class Bucketed:
    """``buckets`` bounds the number of folders, and of names in a manifest. ``bucket`` may name another column for a row's bucket than its key's hash."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64, bucket: Column | None = None):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.bucket = F.pmod(F.xxhash64(*key) if bucket is None else bucket, F.lit(buckets)).cast("int")
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._p(f"{self.path}/manifest")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"schema": DDL, "parts": {bucket: generation}} of a version, the newest by default."""
        held = self.versions()
        v = held[-1] if version is None else version
        if v not in held:
            raise ValueError(f"{self.path} has no version {v}")
        return json.loads(self.spark.read.text(f"{self.path}/manifest/v={v}", wholetext=True).first()[0])

    def _commit(self, version: int, manifest: dict) -> int:
        """Put a manifest in place; of two writers of one version the second fails, and its generation is never read."""
        draft, final = self._p(f"{self.path}/draft-{version}-{manifest['writer']}"), self._p(f"{self.path}/manifest/v={version}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(self._p(f"{self.path}/manifest"))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: version {version} was written by another job")
        return version

    def _write(self, rows: DataFrame, parts: dict[str, str], touched: list[int], version: int, schema: str) -> int:
        """``rows`` of the touched buckets as a new generation; buckets without a row leave the table."""
        name = f"g{version}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
        rows.withColumn(BUCKET, self.bucket).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        made = {s.getPath().getName().split("=")[1] for s in self._fs.listStatus(self._p(f"{self.path}/{name}")) if s.getPath().getName().startswith(BUCKET)}
        stay = {b: g for b, g in parts.items() if int(b) not in touched}
        return self._commit(version, {"schema": schema, "writer": name, "parts": stay | dict.fromkeys(sorted(made), name)})

    def create(self, df: DataFrame) -> int:
        """The first version."""
        return self._write(df.repartition(self.bucket), {}, list(range(self.buckets)), 0, _ddl(df))

    def _folders(self, parts: dict[str, str], only: list[int] | None = None) -> list[str]:
        return [f"{self.path}/{g}/{BUCKET}={b}" for b, g in parts.items() if only is None or int(b) in only]

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, of all buckets or of those named."""
        m = self.manifest(version)
        folders = self._folders(m["parts"], only)
        return self.spark.read.schema(m["schema"]).parquet(*folders) if folders else self.spark.createDataFrame([], m["schema"])

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket.alias("b")).distinct().collect())

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Apply a batch; returns the buckets that were rewritten.

        ``apply`` takes (the held rows of the batch's keys, the batch) and gives the new rows of these keys: any of the pure functions of
        ``merge`` does. A batch that leaves every row of its keys as it is writes nothing, so a replay is the same table and the same version. Null keys are keys.
        """
        v, m = self.versions()[-1], self.manifest()
        keys = changes.select(*self.key).distinct().cache()
        try:
            buckets = self.touched(keys)
            if not buckets:
                return []
            marked = keys.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)])
            marked = F.broadcast(marked) if keys.count() <= BROADCAST_KEYS else marked
            on = lambda df: reduce(lambda a, b: a & b, [df[k].eqNullSafe(marked[f"_k{i}"]) for i, k in enumerate(self.key)])
            held = self.read(v, buckets)
            own = held.join(marked, on(held), "left_semi")
            # The table keeps its types: sums and unions of decimals widen.
            new = apply(own, changes).select(*[F.col(f.name).cast(f.dataType) for f in held.schema.fields]).cache()
            # Rows that one side has more often than the other, by one pass over both.
            signed = new.withColumn("_sign", F.lit(1)).unionByName(own.withColumn("_sign", F.lit(-1)))
            moved = signed.groupBy(*new.columns).agg(F.sum("_sign").alias("_more")).where("_more <> 0").select(*self.key)
            real = self.touched(moved)
            if real:
                rest = self.read(v, real)
                others = rest.join(marked, on(rest), "left_anti")
                rows = others.unionByName(new.where(self.bucket.isin(real)).repartition(self.bucket))
                self._write(rows, m["parts"], real, v + 1, m["schema"])
            new.unpersist()
            return real
        finally:
            keys.unpersist()

    def changed_buckets(self, old: int, new: int) -> list[int]:
        """The buckets of which two versions differ, from their manifests alone."""
        a, b = self.manifest(old)["parts"], self.manifest(new)["parts"]
        return sorted(int(k) for k in a.keys() | b.keys() if a.get(k) != b.get(k))

    def marks(self) -> dict[str, int]:
        """The version that each consumer of changes (``feed.Consumer``) has committed."""
        top, out = self._p(f"{self.path}/consumers"), {}
        for c in self._fs.listStatus(top) if self._fs.exists(top) else []:
            seen = [int(s.getPath().getName()[2:]) for s in self._fs.listStatus(c.getPath()) if s.getPath().getName().startswith("v=")]
            if seen:
                out[c.getPath().getName()] = max(seen)
        return out

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete old manifests, and the bucket folders that no kept one names, half-written ones included. The versions that consumers
        have reached stay, so that they can go on from there. No merge may run meanwhile."""
        held = self.versions()
        kept = sorted({*held[-max(1, keep) :], *self.marks().values()} & set(held))
        live = {f for v in kept for f in self._folders(self.manifest(v)["parts"])}
        for v in set(held) - set(kept):
            self._fs.delete(self._p(f"{self.path}/manifest/v={v}"), False)
        gone = []
        for top in self._fs.listStatus(self._p(self.path)):
            name = top.getPath().getName()
            if name.startswith("draft-"):
                self._fs.delete(top.getPath(), False)
            elif name.startswith("g"):
                own = [s.getPath().getName() for s in self._fs.listStatus(top.getPath())]
                dead = [n for n in own if n.startswith(BUCKET) and f"{self.path}/{name}/{n}" not in live]
                for n in dead:
                    self._fs.delete(self._p(f"{self.path}/{name}/{n}"), True)
                gone += [f"{name}/{n}" for n in dead]
                if len(dead) == sum(n.startswith(BUCKET) for n in own):
                    self._fs.delete(top.getPath(), True)
        return sorted(gone)




def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
