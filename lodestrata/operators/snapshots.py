"""Snapshot maintenance: dedupe, upsert, merge, replay."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the largest order columns of each key; an aggregate, so tasks reduce before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *(F.col("r")[c].alias(c) for c in rest))


def merge(old: DataFrame, new: DataFrame, removed: DataFrame, keys: list[str], path: str = "file_path") -> DataFrame:
    """old without the removed paths and without rows that new replaces, and new."""
    return old.join(removed.select(path).distinct(), path, "left_anti").join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def replace_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of any key that new has, and new: what a source writes replaces all it wrote before."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


#: First-wins keys of the tables of an index.
KEYS = {"chunks": ["symbol_id", "file_path", "start_line"], "edges": ["src", "dst", "relation"]}


class SnapshotStore:
    """Tables under snapshot folders in a shared root. Numbered pointer files name the snapshots that are in force.

    A snapshot is written whole before its pointer, so readers see the old or the new one. A pointer is created only if no
    other writer has created that number, so of two writers one gets an error and none is lost. Earlier snapshots stay
    until vacuum(), so rollback() has what it returns to.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def _pointers(self) -> list[str]:
        return sorted(x for x in self._names("pointers") if x.endswith(".json"))

    def header(self) -> dict:
        """number, history (snapshot names, the active last) and meta of the newest pointer."""
        found = self._pointers()
        if not found:
            return {"number": 0, "history": [], "meta": {}}
        text = self.spark.read.option("wholetext", "true").text(f"{self.root}/pointers/{found[-1]}").first()
        return json.loads(text.value)

    def _point(self, header: dict, history: list[str], meta: dict) -> None:
        n = header["number"] + 1
        out = self.fs.create(self._path(f"pointers/{n:012d}.json"), False)  # an error if it exists
        out.write(bytearray(json.dumps({"number": n, "history": history, "meta": meta}).encode()))
        out.close()

    def replace(self, meta: dict | None = None, **tables: DataFrame) -> str:
        """Writes a whole snapshot, of equal keys the first row by the table's other columns, and makes it the active one."""
        header, name = self.header(), uuid.uuid4().hex
        for t, df in tables.items():
            keys = KEYS.get(t)
            df = first_wins(df, keys, [F.to_json(F.struct(*(c for c in df.columns if c not in keys)))]) if keys and set(keys) < set(df.columns) else df
            df.write.parquet(f"{self.root}/{name}/{t}")
        self._point(header, [*header["history"], name], {**header["meta"], **(meta or {})})
        return name

    def load(self, table: str, order: list[str] | None = None) -> DataFrame:
        history = self.header()["history"]
        if not history:
            raise LookupError("no snapshot")
        df = self.spark.read.parquet(f"{self.root}/{history[-1]}/{table}")
        return df.orderBy(*order) if order else df

    def note(self, **meta) -> None:
        """Advances values of the header, as the last indexed commit, without a new snapshot."""
        header = self.header()
        self._point(header, header["history"], {**header["meta"], **meta})

    def rollback(self) -> str:
        header = self.header()
        if len(header["history"]) < 2:
            raise ValueError("no parent snapshot")
        self._point(header, header["history"][:-1], header["meta"])
        return header["history"][-2]

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all snapshots but the last `keep` of the history; no reader may still use them."""
        kept = set(self.header()["history"][-keep:])
        gone = [x for x in self._names("") if x != "pointers" and x not in kept]
        for x in gone:
            self.fs.delete(self._path(x), True)
        return gone

    def reset(self) -> None:
        self.fs.delete(self._path(""), True)


class Log:
    """An append-only table in a folder; each append is a set of files of its own, so appends don't disturb readers."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def append(self, rows: DataFrame) -> None:
        empty = self.spark.createDataFrame([], self.schema)
        rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema)).write.mode("append").parquet(self.folder)

    def read(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def reset(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
