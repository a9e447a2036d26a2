"""Keyed tables in versioned folders: a write goes to a new version, and a pointer file names the current one.

A table written with keys lies in hash buckets of them. Its version is a manifest that names each bucket's folder and rows; a
change reads and writes the buckets its keys fall into, and the new manifest names the others where they are.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorewright.plans.lineage import cut

#: Rows of a bucket, about. Buckets are a power of two, and double once they hold twice as many.
BUCKET_ROWS = 50_000
#: A manifest has at most as many lines; buckets of larger tables are larger.
MOST_BUCKETS = 2**15
_BUCKET = "_bucket"


class Manifest(NamedTuple):
    keys: list[str]
    buckets: int
    parts: dict[int, tuple[str, int]]  # bucket: its folder below the table's, its rows


class Snapshots:
    """Tables of one root folder. One writer at a time; readers see whole versions only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def version(self, table: str) -> str | None:
        """The current version's name, or None. Pointers are numbered, and the last one counts: making one is atomic where
        renaming is."""
        names = self._names(f"{self.root}/{table}/_pointers")
        return names[-1].split("-", 1)[1] if names else None

    def manifest(self, table: str, name: str | None) -> Manifest | None:
        """A version's manifest; None where it has no keys."""
        p, fs = self._fs(f"{self.root}/{table}/_manifests/{name}")
        if name is None or not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            said = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(said["keys"], said["buckets"], {int(b): tuple(part) for b, part in said["parts"].items()})

    def read(self, table: str, schema: str) -> DataFrame:
        name = self.version(table)
        held = self.manifest(table, name)
        return self._of(table, schema, [name] if name and held is None else [folder for folder, _ in held.parts.values()] if held else [])

    def _of(self, table: str, schema: str | StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/{f}" for f in folders])

    def write(self, table: str, rows: DataFrame, keys: list[str] | None = None) -> str:
        """A new version of the table; the old one stays for `restore`. With keys it lies in buckets, whose number follows the
        count of the rows, so these should be cheap to read twice."""
        name = uuid.uuid4().hex
        if keys is None:
            rows.write.parquet(f"{self.root}/{table}/{name}")
        else:
            wanted = min(MOST_BUCKETS, 1 << max(0, -(-rows.count() // BUCKET_ROWS) - 1).bit_length())
            self._record(table, name, Manifest(keys, wanted, self._bucketed(table, rows, keys, wanted, wanted)))
        self._point(table, name)
        return name

    def _bucketed(self, table: str, rows: DataFrame, keys: list[str], buckets: int, tasks: int) -> dict[int, tuple[str, int]]:
        """Rows written to the buckets they fall into."""
        run = uuid.uuid4().hex
        placed = rows.withColumn(_BUCKET, _place(rows.schema, keys, buckets)).repartition(max(1, tasks), _BUCKET)
        placed.write.partitionBy(_BUCKET).parquet(f"{self.root}/{table}/{run}")
        written = self.spark.read.schema(f"{_BUCKET} int").parquet(f"{self.root}/{table}/{run}")
        return {r[0]: (f"{run}/{_BUCKET}={r[0]}", r[1]) for r in written.groupBy(_BUCKET).count().collect()}  # a row a bucket

    def _record(self, table: str, name: str, made: Manifest) -> None:
        p, fs = self._fs(f"{self.root}/{table}/_manifests/{name}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(made._asdict()).encode()))
        out.hsync()
        out.close()

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows added to the current version of a table without keys, whose other files stay as they are."""
        name = self.version(table)
        if name is None:
            self.write(table, rows)
        elif self.manifest(table, name):
            raise ValueError(f"{table} has keys: merge into it")
        else:
            rows.write.mode("append").parquet(f"{self.root}/{table}/{name}")

    def _point(self, table: str, name: str) -> None:
        p, fs = self._fs(f"{self.root}/{table}/_pointers")
        fs.mkdirs(p)
        names = self._names(f"{self.root}/{table}/_pointers")
        number = int(names[-1].split("-", 1)[0]) + 1 if names else 0
        staged, _ = self._fs(f"{self.root}/{table}/_staged-{name}")
        fs.create(staged, True).close()
        final, _ = self._fs(f"{self.root}/{table}/_pointers/{number:09d}-{name}")
        if not fs.rename(staged, final):
            raise OSError(f"{table}: another writer was faster")

    def restore(self, table: str, name: str) -> None:
        """Make an earlier version current again."""
        self._point(table, name)

    def merge(self, table: str, schema: str, rows: DataFrame, keys: list[str]) -> str:
        """Upsert rows by keys: old rows without a new one, and the new ones."""
        rows = cut(rows)
        return self.replace(table, schema, rows.select(*keys), rows, keys)

    def delete(self, table: str, schema: str, gone: DataFrame, keys: list[str]) -> str:
        return self.replace(table, schema, cut(gone.select(*keys)), None, keys)

    def replace(self, table: str, schema: str, gone: DataFrame, rows: DataFrame | None, keys: list[str]) -> str:
        """Rows in place of those with the keys of gone. Both are read several times and must not change between. A table that
        has no buckets of these keys yet is written whole, once."""
        types = self.spark.createDataFrame([], schema).schema
        typed = lambda df, names: df.select(*[F.col(c).cast(types[c].dataType).alias(c) for c in names])
        gone, rows = typed(gone, keys).distinct(), None if rows is None else typed(rows, types.fieldNames())
        name = self.version(table)
        held = self.manifest(table, name)

        def changed(old: DataFrame) -> DataFrame:
            left = old.join(gone, keys, "left_anti").select(*types.fieldNames())
            return left if rows is None else left.unionByName(rows)

        if held is None or held.keys != keys:
            return self.write(table, changed(self.read(table, schema)), keys)
        asked = gone if rows is None else gone.unionAll(rows.select(*keys))
        hit = [r[0] for r in asked.select(_place(types, keys, held.buckets)).distinct().collect()]  # at most a row a bucket
        if not hit:
            return name
        old = self._of(table, types, [held.parts[b][0] for b in hit if b in held.parts])
        made = self._bucketed(table, changed(old), keys, held.buckets, len(hit))
        parts = {b: part for b, part in held.parts.items() if b not in set(hit)} | made
        if sum(n for _, n in parts.values()) > 2 * held.buckets * BUCKET_ROWS and held.buckets < MOST_BUCKETS:
            return self.write(table, self._of(table, types, [folder for folder, _ in parts.values()]), keys)
        name = uuid.uuid4().hex
        self._record(table, name, held._replace(parts=parts))
        self._point(table, name)
        return name

    def vacuum(self, table: str, keep: int = 2) -> int:
        """Delete what none of the last `keep` versions holds, lost writes too; gives how many folders went. Readers of older
        versions must be done and no write under way."""
        top = f"{self.root}/{table}"
        names = self._names(f"{top}/_pointers")
        kept = {n.split("-", 1)[1] for n in names[-max(1, keep) :]}
        held: set[str] = set()  # paths below the table's folder
        for version in kept:
            made = self.manifest(table, version)
            held |= {version} if made is None else {folder for folder, _ in made.parts.values()}
        drop = lambda path: self._fs(f"{top}/{path}")[1].delete(self._fs(f"{top}/{path}")[0], True)
        for pointer in names[: -max(1, keep)]:
            drop(f"_pointers/{pointer}")
        for version in set(self._names(f"{top}/_manifests")) - kept:
            drop(f"_manifests/{version}")
        runs = {h.split("/")[0] for h in held}
        gone = [n for n in self._names(top) if n not in ("_pointers", "_manifests") and n not in runs]
        gone += [f"{run}/{part}" for run in runs for part in self._names(f"{top}/{run}") if part.startswith(f"{_BUCKET}=") and f"{run}/{part}" not in held]
        for path in gone:
            drop(path)
        return len(gone)


def _place(types: StructType, keys: list[str], buckets: int) -> Column:
    """The bucket of a row's keys, as the types of the table's schema hash."""
    return F.pmod(F.xxhash64(*[F.col(k).cast(types[k].dataType) for k in keys]), F.lit(buckets)).cast("int").alias(_BUCKET)
