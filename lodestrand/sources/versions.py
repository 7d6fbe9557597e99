"""Tables in buckets with atomic versions, on any Hadoop file system."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # parts of a table, each rewritten only by writes that touch it
KEPT = 3  # manifests, with what they name, that stay for replays and readers


class VersionedTable:
    """Rows fall into BUCKETS by a hash of their key. Version n lies below d<n> as far as it is new, and manifest m<n> names the folder of every bucket.

    A manifest appears by one rename, so a version is there whole or not at all, and readers of an
    older one go on reading it. Manifests before the last KEPT go, and folders that none names.
    """

    def __init__(self, spark: SparkSession, target: str, schema: str, key: list[str]):
        self.spark, self.target, self.schema, self.key, self.jvm = spark, target, schema, key, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}" if name else self.target)

    def _names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self._path(""))] if self.fs.exists(self._path("")) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names() if n[0] == "m" and n[1:].isdigit())

    def _manifest(self, number: int | None) -> dict[int, str]:
        if number is None:
            return {}
        stream = self.fs.open(self._path(f"m{number}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {int(b): folder for b, _, folder in (line.partition(" ") for line in text.splitlines())}

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.target}/{f}" for f in folders))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(BUCKETS)).cast("int")

    def read(self, number: int | None = None) -> DataFrame:
        """The last version, or version number; empty before the first."""
        known = self._manifest(max(self.numbers(), default=None) if number is None else number)
        return self._rows(sorted(known.values()))

    def rewrite(self, change: Callable[[DataFrame], DataFrame], touched: set[int] | None = None, number: int | None = None) -> int:
        """Make the next version, or version number from the newest before it: the rows of touched buckets (all by default) become what change makes of them."""
        before = max((n for n in self.numbers() if number is None or n < number), default=None)
        number = (-1 if before is None else before) + 1 if number is None else number
        known = self._manifest(before)
        touched = set(range(BUCKETS)) if touched is None else touched
        changed = change(self._rows([known[b] for b in sorted(touched) if b in known]))
        changed.withColumn("b", self.bucket()).repartition(F.col("b")).write.partitionBy("b").mode("overwrite").parquet(f"{self.target}/d{number}")
        made = {b: f"d{number}/b={b}" for b in touched if self.fs.exists(self._path(f"d{number}/b={b}"))}
        self._publish(number, {b: f for b, f in known.items() if b not in touched} | made)
        self._sweep(number)
        return number

    def touched_by(self, rows: DataFrame) -> set[int]:
        """The buckets of rows (at most BUCKETS numbers reach the driver)."""
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def _publish(self, number: int, folders: dict[int, str]) -> None:
        """Write the manifest beside its place and rename it there, over one that a failed try has left."""
        stream = self.fs.create(self._path(f"_m{number}"), True)
        try:
            stream.write(bytearray("".join(f"{b} {f}\n" for b, f in sorted(folders.items())).encode()))
        finally:
            stream.close()
        over = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf).rename(self._path(f"_m{number}"), self._path(f"m{number}"), over)

    def _sweep(self, number: int, kept: int = KEPT) -> None:
        numbers = [n for n in self.numbers() if n <= number]
        stay = numbers[-kept:]
        named = {f.split("/")[0] for n in stay for f in self._manifest(n).values()}
        for n in numbers[:-kept]:
            self.fs.delete(self._path(f"m{n}"), False)
        for name in self._names():
            if name[0] == "d" and name[1:].isdigit() and int(name[1:]) < min(stay, default=0) and name not in named:
                self.fs.delete(self._path(name), True)

    def vacuum(self) -> None:
        """Drop all versions but the last, and what only they hold."""
        self._sweep(max(self.numbers(), default=0), 1)

    def backup(self, to: str) -> int:
        """Copy the last version to another folder as its first; its rows, once both counts agree."""
        rows = self.read()
        copy = VersionedTable(self.spark, to, self.schema, self.key)
        copy.rewrite(lambda _: rows)
        n, m = rows.count(), copy.read().count()
        if n != m:
            raise RuntimeError(f"the copy has {m} of {n} rows")
        return n
