"""Versions of a table whose rows stay readable (U4, S19, K2): row files by bucket, named in a manifest that is committed by one rename.

A version is a manifest: schema, and for each bucket of keys the digest of its rows and the folder that holds them. A commit writes only buckets
whose rows differ from the version before, so unchanged rows are stored once however many versions there are. Row folders
are never changed. The manifest is written beside its place and renamed to it; a rename onto a version that another commit took fails, and until
then readers see the version before. A commit that fails leaves some unread files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a table, as many entries in each manifest.
BUCKETS = 32


class Conflict(RuntimeError):
    """Another commit took the version, or the live one isn't what the caller has seen."""


class Versions:
    """Versions of one table in a folder that the driver and all executors reach. keys: what rows are dealt to buckets by."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), list(keys), buckets

    def _path(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self) -> Any:
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Versions there are, ascending."""
        fs, place = self._fs(), self._path("manifests")
        if not fs.exists(place):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n[:-5].isdigit() and n.endswith(".json"))

    def live(self) -> int:
        """The newest version; 0 if there is none."""
        return max(self.numbers(), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{version}.json").collect()))

    def commit(self, rows: DataFrame, seen: int | None = None, note: str = "") -> int:
        """Make rows the newest version and return its number. seen: the live version that rows were made from; another one is a Conflict."""
        before = self.live()
        if seen is not None and seen != before:
            raise Conflict(f"version {before} is live, not {seen}")
        last = self.manifest(before)["buckets"] if before else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # Equal rows cancel in no sum: hashes are added as whole numbers, by row, and rows are counted.
        one, other = (F.sum(F.xxhash64(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), F.lit(i)).cast("decimal(20,0)")) for i in (1, 2))
        digests = {str(r["b"]): f"{r['n']}:{r['x']}:{r['y']}" for r in rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), one.alias("x"), other.alias("y")).collect()}
        schema = json.loads(rows.schema.json())
        if before and self.manifest(before)["schema"] != schema:
            last = {}
        changed = sorted(int(b) for b, d in digests.items() if last.get(b, {}).get("digest") != d)
        part = f"rows/{uuid.uuid4().hex}"
        if changed:
            rows.withColumn("_bucket", bucket).filter(F.col("_bucket").isin(changed)).write.partitionBy("_bucket").parquet(f"{self.folder}/{part}")
        buckets = {b: {"digest": d, "part": f"{part}/_bucket={b}" if int(b) in changed else last[b]["part"]} for b, d in digests.items()}
        version, name = before + 1, f"manifests/_{uuid.uuid4().hex}"
        fs = self._fs()
        fs.mkdirs(self._path("manifests"))
        out = fs.create(self._path(name), False)
        try:
            out.write(json.dumps({"version": version, "note": note, "schema": schema, "buckets": buckets}).encode())
        finally:
            out.close()
        if fs.exists(self._path(f"manifests/{version}.json")) or not fs.rename(self._path(name), self._path(f"manifests/{version}.json")):
            raise Conflict(f"version {version} was committed meanwhile")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, of the live one by default; only its files are read."""
        number = self.live() if version is None else version
        if number not in self.numbers():
            raise LookupError(f"there is no version {number}")
        told = self.manifest(number)
        schema = T.StructType.fromJson(told["schema"])
        parts = sorted({b["part"] for b in told["buckets"].values()})
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in parts))

    def history(self) -> DataFrame:
        """version, note, rows, written (buckets that the version wrote)."""
        told, out, before = [self.manifest(n) for n in self.numbers()], [], {}
        for m in told:
            parts = {b: v["part"] for b, v in m["buckets"].items()}
            out.append((m["version"], m["note"], sum(int(v["digest"].split(":")[0]) for v in m["buckets"].values()), sum(before.get(b) != p for b, p in parts.items())))
            before = parts
        return self.spark.createDataFrame(out, "version int, note string, rows long, written int")
