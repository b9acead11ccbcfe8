"""Tables in versions: created, widened by columns and merged by key.

A version is a folder of Parquet files beside the others.  It counts once its
mark exists, and marks are made by one rename, so readers see a version whole
or not at all.  The newest mark is the table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """A keyed table under ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark._jvm  # noqa: SLF001
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def numbers(self) -> list[int]:
        marks = self._at(f"{self.path}/marks")
        if not self._fs.exists(marks):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(marks) if s.getPath().getName().isdigit())

    def read(self, number: int | None = None) -> DataFrame:
        numbers = self.numbers()
        if not numbers or (number is not None and number not in numbers):
            raise ValueError(f"no version {number if number is not None else ''} under {self.path}")
        return self.spark.read.parquet(self.folder(number or numbers[-1]))

    def write(self, rows: DataFrame) -> int:
        """A new version; fails if another writer has taken its number."""
        number = self.next()
        rows.write.parquet(self.folder(number))  # errors if the folder is there
        return self.publish(number)

    def next(self) -> int:
        return (self.numbers() or [0])[-1] + 1

    def folder(self, number: int) -> str:
        return f"{self.path}/versions/{number}"

    def publish(self, number: int) -> int:
        """Makes a written folder a version."""
        draft = self._at(f"{self.path}/drafts/{number}")
        self._fs.create(draft, False).close()
        self._fs.mkdirs(self._at(f"{self.path}/marks"))
        if not self._fs.rename(draft, self._at(f"{self.path}/marks/{number}")):
            raise ValueError(f"version {number} is taken")
        return number

    def create(self, rows: DataFrame) -> int:
        """The first version; nothing if there is one."""
        numbers = self.numbers()
        return numbers[-1] if numbers else self.write(rows)

    def add_columns(self, columns: dict[str, str]) -> int:
        """Nullable columns (name: type) that the table lacks; no new version
        if it has them all."""
        now = self.read()
        have = {c.lower() for c in now.columns}
        new = {c: t for c, t in columns.items() if c.lower() not in have}
        return self.write(now.select("*", *(F.lit(None).cast(t).alias(c) for c, t in new.items()))) if new else self.numbers()[-1]

    def merge(self, patch: DataFrame, allowed: Iterable[str], stamp: str, stamp_col: str = "updated_at") -> int:
        """Rows of ``patch`` (the key and any allowed columns) into the table:
        columns of rows that are there are replaced, other rows are added, and
        both are stamped.  Columns that are not allowed are refused; of rows
        that repeat a key the largest is taken; a patch that changes nothing
        makes no new version."""
        unknown = set(patch.columns) - set(allowed) - {self.key}
        if unknown:
            raise ValueError(f"columns not allowed: {sorted(unknown)}")
        now = self.read()
        put = [c for c in patch.columns if c != self.key]
        one = patch.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*put)).alias("put"))
        both = now.alias("o").join(one.select(F.col(self.key).alias("put_key"), "put"), F.col(f"o.{self.key}") == F.col("put_key"), "full")
        own = F.col(f"o.{self.key}")
        same = F.lit(True)
        for c in put:
            same &= F.col(f"o.{c}").eqNullSafe(F.col(f"put.{c}").cast(now.schema[c].dataType))
        changed = F.col("put_key").isNotNull() & (own.isNull() | ~same)
        out = []
        for c in now.columns:
            old = F.col(f"o.{c}")
            if c == self.key:
                new = F.coalesce(old, F.col("put_key"))
            elif c == stamp_col:
                new = F.when(changed, F.lit(stamp).cast(now.schema[c].dataType)).otherwise(old)
            elif c in put:
                new = F.when(F.col("put_key").isNotNull(), F.col(f"put.{c}").cast(now.schema[c].dataType)).otherwise(old)
            else:
                new = old
            out.append(new.alias(c))
        if not both.filter(changed).limit(1).count():
            return self.numbers()[-1]
        return self.write(both.select(out))
