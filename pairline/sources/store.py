"""Tables that are updated in place: buckets by key, and a manifest that names each bucket's folders.

Rows are dealt into a fixed number of buckets by a hash of their key. A change writes the buckets that it touches to a new
folder and commits by renaming one small file, manifest-00000012.json, to its place; a run that breaks before that leaves
the last version as it is, and a reader keeps the folders of the version that it opened. Two writers of one version: the second
rename fails. vacuum() deletes the folders that the last version does not name.

Keys may be null (such rows are in one bucket); an update by an empty table commits nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new store; rewriting one is a task's work.
BUCKETS = 64


class Store:
    """A bucketed table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = (), schema: str = "", buckets: int = BUCKETS):
        """Open the store, or begin one with these keys, this schema and this many buckets."""
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self.files = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self.version() is None:
            self._commit({"version": 0, "keys": list(keys), "schema": schema, "buckets": buckets, "folders": {}})
        told = self._manifest()
        self.keys, self.schema, self.buckets = tuple(told["keys"]), told["schema"], told["buckets"]

    def version(self) -> int | None:
        """The last committed version; None if there is none."""
        found = self.files.globStatus(self._path(f"{self.path}/manifest-*.json"))
        names = [f.getPath().getName() for f in found or []]
        return max((int(n.removeprefix("manifest-").removesuffix(".json")) for n in names), default=None)

    def _manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        lines = self.spark.read.text(f"{self.path}/manifest-{v:08d}.json", wholetext=True).collect()  # one small file
        return json.loads(lines[0]["value"])

    def _commit(self, manifest: dict) -> None:
        final = self._path(f"{self.path}/manifest-{manifest['version']:08d}.json")
        draft = self._path(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = self.files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.files.exists(final) or not self.files.rename(draft, final):
            self.files.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} was committed by another writer")

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        chosen = [(b, folder) for b, folders in manifest["folders"].items() for folder in folders if buckets is None or int(b) in buckets]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{folder}/bucket={b}" for b, folder in chosen])

    def read(self, buckets: set[int] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some buckets, of the last version or an earlier one that was not vacuumed."""
        return self._read(self._manifest(version), buckets)

    def touched(self, df: DataFrame) -> set[int]:
        """The buckets that the keys of df lie in; a number for each bucket at most."""
        return {r["bucket"] for r in df.select(self.bucket_of().alias("bucket")).distinct().collect()}

    def _write(self, df: DataFrame) -> tuple[str, set[int]]:
        """A new folder with df by bucket, and the buckets that have rows."""
        folder = uuid.uuid4().hex
        place = f"{self.path}/data/{folder}"
        names = self.spark.createDataFrame([], self.schema).columns
        df.select(*names, self.bucket_of().alias("bucket")).repartition(min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").write.partitionBy("bucket").parquet(place)
        found = self.files.globStatus(self._path(f"{place}/bucket=*")) or []
        return folder, {int(f.getPath().getName().removeprefix("bucket=")) for f in found}

    def append(self, df: DataFrame) -> int:
        """Add rows beside those that are there; gives the number of buckets touched. Nothing is read or rewritten."""
        old = self._manifest()
        folder, buckets = self._write(df)
        if buckets:
            folders = {b: [*old["folders"].get(str(b), []), folder] for b in buckets}
            self._commit({**old, "version": old["version"] + 1, "folders": old["folders"] | {str(b): f for b, f in folders.items()}})
        return len(buckets)

    def update(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Put merge(old, new) in the place of the buckets that new's keys lie in; gives their number.

        merge gets the old rows of these buckets only; it must neither make nor move rows of other keys.
        """
        old, buckets = self._manifest(), self.touched(new)
        if buckets:
            folder, kept = self._write(merge(self._read(old, buckets), new))
            folders = {str(b): [folder] if b in kept else [] for b in buckets}
            self._commit({**old, "version": old["version"] + 1, "folders": old["folders"] | folders})
        return len(buckets)

    def vacuum(self) -> int:
        """Delete the folders and manifests that the last version does not need; gives the number of folders deleted."""
        told = self._manifest()
        named = {f for folders in told["folders"].values() for f in folders}
        gone = 0
        for f in self.files.globStatus(self._path(f"{self.path}/data/*")) or []:
            if f.getPath().getName() not in named:
                self.files.delete(f.getPath(), True)
                gone += 1
        for v in range(told["version"]):
            self.files.delete(self._path(f"{self.path}/manifest-{v:08d}.json"), False)
        return gone
