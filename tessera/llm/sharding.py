"""Size-tiered compaction of immutable shards under versioned manifests.

Arrivals are appended as small immutable Parquet shards.  A shard's tier is the
logarithm of its size; as soon as a tier has ``fan_in`` shards they are merged
into files of about ``target_bytes``.  Nothing is changed in place: each append
or compaction writes new files and then commits a manifest of the next version.
A writer claims the version by creating a file that must not exist and then
renames its complete manifest to the version's name, so of two writers one
fails.  Readers see one version or the next; a job that dies in between leaves
files that no manifest names and maybe a claim, which ``unclaim`` removes.

The driver holds a manifest's list of files, some 200 bytes for each: 32 MB for
5 TB of files of 32 MB.  Larger tables take larger ``target_bytes``.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import clean_name, without_leftovers

TARGET_BYTES = 32 << 20
BASE_BYTES = 1 << 20
FAN_IN = 4
#: A round of merges is committed in so many parts at most.
PARTS = 4


class ManifestConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """Shards of one table below ``root``, a folder that all machines share.

    Rows keep all their columns, whatever their names, nulls, ties and repeated
    rows among them, and texts of any length; a table without rows is a version
    without rows.  All appended tables have the columns and types of the first.
    """

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = TARGET_BYTES, base_bytes: int = BASE_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.base_bytes, self.fan_in = target_bytes, base_bytes, fan_in
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # files and manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default of the newest; version 0 is empty."""
        have = self.versions()
        version = version if version is not None else (have[-1] if have else 0)
        if version == 0:
            return {"version": 0, "shards": [], "schema": None}
        rows = self.spark.read.text(f"{self.root}/manifests/v{version:010d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        new = {"version": base["version"] + 1, "parent": base["version"], "schema": schema, "shards": shards}
        folder = f"{self.root}/manifests"
        self._fs.mkdirs(self._path(folder))
        final = f"{folder}/v{new['version']:010d}"
        try:
            self._fs.create(self._path(f"{final}.claim"), False).close()  # fails if it exists
        except Exception as e:
            raise ManifestConflict(f"version {new['version']} is taken") from e
        temporary = self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(json.dumps(new).encode())
        out.close()
        if self._fs.exists(self._path(f"{final}.json")) or not self._fs.rename(temporary, self._path(f"{final}.json")):
            self._fs.delete(temporary, False)
            raise ManifestConflict(f"version {new['version']} exists")
        return new

    def unclaim(self) -> None:
        """Free the next version of a claim whose writer has died; no writer may be at work."""
        self._fs.delete(self._path(f"{self.root}/manifests/v{self.manifest()['version'] + 1:010d}.claim"), False)

    def _listed(self, folder: str) -> list[dict]:
        """The files that a job has written, with bytes, rows and tier."""
        sizes = {}
        walk = self._fs.listFiles(self._path(folder), True)
        while walk.hasNext():
            s = walk.next()
            if s.getPath().getName().endswith(".parquet"):
                path = s.getPath().toString()
                sizes[self._place(path)] = (path, s.getLen())
        if not sizes:
            return []
        counted = self.spark.read.parquet(folder).groupBy(self._place_column().alias("f")).count().collect()  # a row per file
        return [{"path": sizes[r["f"]][0], "bytes": sizes[r["f"]][1], "rows": r["count"], "tier": self.tier(sizes[r["f"]][1])} for r in sorted(counted, key=lambda r: r["f"])]

    @staticmethod
    def _place(path: str) -> str:
        """What stands behind the data folder: file names alone repeat, as a task names its files alike in all partition folders."""
        return path.rpartition("/data/")[2]

    @staticmethod
    def _place_column():
        return F.substring_index("_metadata.file_path", "/data/", -1)

    @staticmethod
    def _kinds(schema: dict) -> list:
        return [(f["name"], f["type"]) for f in schema["fields"]]

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / self.base_bytes, self.fan_in)))

    # operations

    def arrivals(self, rows: int, size: int) -> int:
        """Rows of a shard, so that ``rows`` of ``size`` bytes in all make small shards that are due: of a quarter of a run at most, ``fan_in`` at least."""
        shards = max(self.fan_in, math.ceil(size / max(1, self.target_bytes // (2 * self.fan_in))))
        return max(1, rows // shards)

    def append(self, df: DataFrame, rows_per_shard: int = 0) -> dict:
        """Write ``df`` as shards of at most ``rows_per_shard`` rows (0: one per partition) and commit them."""
        base, folder = self.manifest(), f"{self.root}/data/{uuid.uuid4().hex}"
        if base["schema"] and self._kinds(json.loads(base["schema"])) != self._kinds(json.loads(df.schema.json())):
            raise ValueError("the rows have other columns than the table")
        df.write.option("maxRecordsPerFile", rows_per_shard).parquet(folder)
        return self._commit(base, base["shards"] + self._listed(folder), df.schema.json())

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of shards to merge: of each tier with ``fan_in`` shards or more, in runs of about the target size."""
        groups: list[list[dict]] = []
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target_bytes / 2:
                tiers.setdefault(s["tier"], []).append(s)
        for _, own in sorted(tiers.items()):
            if len(own) < self.fan_in:
                continue
            runs = max(1, round(sum(s["bytes"] for s in own) / self.target_bytes))
            bins: list[list[dict]] = [[] for _ in range(runs)]
            for i, s in enumerate(sorted(own, key=lambda s: (-s["bytes"], s["path"]))):
                bins[i % runs if (i // runs) % 2 == 0 else runs - 1 - i % runs].append(s)
            groups += [b for b in bins if len(b) > 1]
        return groups

    def compact(self, keep: int | None = None) -> dict | None:
        """One round of merges; None if no tier is due.

        The groups are merged and committed in up to PARTS parts, or fewer that busy all cores.
        With ``keep`` older versions are vacuumed after each, so that a table and its merged copy are never
        both whole on disk.
        """
        base = self.manifest()
        groups = self.plan(base["shards"])
        if not groups:
            return None
        at_once = max(self.spark.sparkContext.defaultParallelism, math.ceil(len(groups) / PARTS))
        for first in range(0, len(groups), at_once):
            base = self._merge(base, groups[first : first + at_once])
            if keep is not None:
                self.vacuum(keep)
        return base

    def _merge(self, base: dict, groups: list[list[dict]]) -> dict:
        """Merge each group into one file and commit.

        Nothing is committed if the merged files do not hold as many rows as their sources.
        """
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        of = [(self._place(s["path"]), g) for g, own in enumerate(groups) for s in own]
        rows = self.spark.read.schema(self._schema(base)).parquet(*[s["path"] for own in groups for s in own])
        file, group = clean_name(rows, "shard_file"), clean_name(rows, "shard_group")
        which = self.spark.createDataFrame(of, f"{file} string, {group} int")
        merged = rows.withColumn(file, self._place_column()).join(F.broadcast(which), file).select(*[F.col(f"`{c}`") for c in rows.columns], group)  # a row per file of the manifest, which the driver holds
        # a group makes one file of about the target size, by a task of its own
        with without_leftovers(self.spark):
            merged.repartitionById(len(groups), F.col(group)).write.partitionBy(group).parquet(folder)
        gone = {s["path"] for own in groups for s in own}
        made, want = self._listed(folder), sum(s["rows"] for own in groups for s in own)
        if sum(s["rows"] for s in made) != want:
            raise RuntimeError(f"merged shards in {folder} hold {sum(s['rows'] for s in made)} rows of {want}")
        return self._commit(base, [s for s in base["shards"] if s["path"] not in gone] + made, base["schema"])

    def settle(self, keep: int | None = None) -> dict:
        """Compact until no tier is due."""
        while self.compact(keep) is not None:
            pass
        return self.manifest()

    @staticmethod
    def _schema(manifest: dict) -> StructType:
        return StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else StructType()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with ``shard``, the number of their shard in its manifest.

        Where the table has a column ``shard``, the number's is the first of ``shard_``, ``shard__``, ...
        that it has not.
        """
        found = self.manifest(version)
        rows = self.spark.read.schema(self._schema(found)).parquet(*[s["path"] for s in found["shards"]]) if found["shards"] else self.spark.createDataFrame([], self._schema(found))
        file, shard = clean_name(rows, "shard_file"), clean_name(rows, "shard")
        numbers = [(self._place(s["path"]), i) for i, s in enumerate(found["shards"])]
        which = self.spark.createDataFrame(numbers, f"{file} string, {shard} int")
        place = self._place_column() if found["shards"] else F.lit("")
        return rows.withColumn(file, place).join(F.broadcast(which), file).select(*[F.col(f"`{c}`") for c in rows.columns], shard)  # a row per file

    def vacuum(self, keep: int = 1) -> int:
        """Delete files that none of the ``keep`` newest manifests names; returns how many."""
        named = {s["path"] for v in self.versions()[-keep:] for s in self.manifest(v)["shards"]}
        gone, walk = [], self._fs.listFiles(self._path(f"{self.root}/data"), True)
        while walk.hasNext():
            p = walk.next().getPath()
            if p.getName().endswith(".parquet") and p.toString() not in named:
                gone.append(p)
        for p in gone:
            self._fs.delete(p, False)
        for v in self.versions()[:-keep]:
            for kind in ("json", "claim"):
                self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.{kind}"), False)
        return len(gone)
