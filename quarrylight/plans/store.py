"""The index on disk (S12, K1, I1, U12-U13): Parquet tables of a snapshot, and a pointer to the newest.

The chunk table lies in buckets by a hash of the file key, about ``FILES_A_BUCKET``
files each, so their number follows the table.  A snapshot lists the folder of
every bucket; ``patch`` writes the buckets that changed files fall in and takes
over the others as they are.  ``save`` writes all of them, and a patch does too
when the table has outgrown its buckets.  Either then swaps the pointer file by an
atomic rename, so readers see the old or the new snapshot and never half of one;
``keep`` older snapshots stay for readers that are still at work.

The folder is one that the driver and all executors see under the same path;
Spark gets it as a ``file:`` URI whatever its default file system is.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import maintenance

TABLES = {"files": schema.FILES, "git_states": schema.GIT_STATES, "dirty": schema.DIRTY, "meta": schema.META}
FILES_A_BUCKET, LEAST_BUCKETS, OUTGROWN = 1_000, 16, 4


def _uri(path: Path) -> str:
    return f"file://{path.resolve()}"  # Spark wants the characters as they are


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.spark, self.folder = spark, Path(folder)

    @property
    def _pointer(self) -> Path:
        return self.folder / "CURRENT"

    def current(self) -> Path | None:
        return self.folder / self._pointer.read_text().strip() if self._pointer.exists() else None

    @staticmethod
    def _buckets(snapshot: Path) -> dict:
        return json.loads((snapshot / "chunks.json").read_text())

    def _chunks(self, folders: list[str]) -> DataFrame:
        if not folders:
            return schema.empty(self.spark, schema.CHUNKS)
        return self.spark.read.schema(schema.CHUNKS).parquet(*[_uri(self.folder / x) for x in folders])

    def load(self, model: str | None = None) -> dict[str, DataFrame] | None:
        """The tables, or None without a snapshot or if its version, embedder or model is another."""
        at = self.current()
        if at is None or not (at / "chunks.json").exists():
            return None
        meta = self.spark.read.schema(schema.META).parquet(_uri(at / "meta")).first()
        if meta is None or meta["version"] != schema.FORMAT_VERSION or model is not None and meta["model"] != model:
            return None
        tables = {name: self.spark.read.schema(kind).parquet(_uri(at / name)) for name, kind in TABLES.items()}
        return tables | {"chunks": self._chunks(list(self._buckets(at)["folders"].values()))}

    def empty(self) -> dict[str, DataFrame]:
        return {name: schema.empty(self.spark, kind) for name, kind in (TABLES | {"chunks": schema.CHUNKS}).items()}

    def _write_buckets(self, chunks: DataFrame, buckets: int) -> dict[str, str]:
        """Writes rows by bucket; the folder of each bucket that got any."""
        data = self.folder / f"data-{uuid.uuid4().hex}"
        placed = chunks.withColumn("bucket", bucket_of(F.col("file_key"), buckets)).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "file_key", "chunk_ord")
        placed.write.partitionBy("bucket").parquet(_uri(data))
        return {p.name.split("=")[1]: f"{data.name}/{p.name}" for p in data.glob("bucket=*")}

    def _publish(self, tables: dict[str, DataFrame], buckets: dict, model: str, embedder: str, keep: int) -> None:
        at = self.folder / f"snapshot-{uuid.uuid4().hex}"
        meta = self.spark.createDataFrame([(schema.FORMAT_VERSION, embedder, model)], schema.META)
        for name in TABLES:
            (meta if name == "meta" else tables[name]).write.parquet(_uri(at / name))
        (at / "chunks.json").write_text(json.dumps(buckets))
        before = self.current()
        fresh = self.folder / f".{at.name}"
        fresh.write_text(at.name)
        os.replace(fresh, self._pointer)
        old = sorted((p for p in self.folder.glob("snapshot-*") if p not in (at, before)), key=lambda p: p.stat().st_mtime)
        for p in old[: max(0, len(old) - keep + 1)]:
            shutil.rmtree(p, ignore_errors=True)
        used = {x for p in self.folder.glob("snapshot-*/chunks.json") for x in json.loads(p.read_text())["folders"].values()}
        for p in self.folder.glob("data-*"):
            for b in p.glob("bucket=*"):
                if f"{p.name}/{b.name}" not in used:
                    shutil.rmtree(b, ignore_errors=True)
            if not any(p.glob("bucket=*")):
                shutil.rmtree(p, ignore_errors=True)

    def _wanted(self, files: DataFrame) -> int:
        return max(LEAST_BUCKETS, 1 << (files.count() // FILES_A_BUCKET).bit_length())

    def save(self, tables: dict[str, DataFrame], model: str, embedder: str = "local", keep: int = 1) -> None:
        """A snapshot of whole tables."""
        buckets = self._wanted(tables["files"])
        self._publish(tables, {"buckets": buckets, "folders": self._write_buckets(tables["chunks"], buckets)}, model, embedder, keep)

    def patch(self, tables: dict[str, DataFrame], gone: DataFrame, fresh: DataFrame, model: str, embedder: str = "local", keep: int = 1) -> None:
        """A snapshot whose chunks lack the files of ``gone`` (``file_key``) and have the rows of ``fresh``; the other tables are whole.

        ``gone`` names every file that ``fresh`` has rows of.
        """
        at = self.current()
        held = self._buckets(at) if at is not None else {"buckets": LEAST_BUCKETS, "folders": {}}
        if self._wanted(tables["files"]) > OUTGROWN * held["buckets"]:
            whole = maintenance.patched(self._chunks(list(held["folders"].values())), gone, fresh, ["file_key"])
            return self.save(tables | {"chunks": whole}, model, embedder, keep)
        touched = {str(r[0]) for r in gone.select(bucket_of(F.col("file_key"), held["buckets"])).distinct().collect()}  # at most one row a bucket
        before = self._chunks([f for b, f in held["folders"].items() if b in touched])
        folders = {b: f for b, f in held["folders"].items() if b not in touched}
        folders |= self._write_buckets(maintenance.patched(before, gone, fresh, ["file_key"]), held["buckets"])
        self._publish(tables, {"buckets": held["buckets"], "folders": folders}, model, embedder, keep)

    def keep_chunks(self, tables: dict[str, DataFrame], model: str, embedder: str = "local", keep: int = 1) -> None:
        """A snapshot with other tables and the chunks as they are."""
        at = self.current()
        self._publish(tables, self._buckets(at) if at is not None else {"buckets": LEAST_BUCKETS, "folders": {}}, model, embedder, keep)
