"""Keyed results of a stream, kept as one folder of folded rows per micro-batch.

Each micro-batch is folded by the job's rule (the first upload per hash, the newest run per document, sums per window) and
written under its own number; a replayed batch overwrites its folder. The rule is associative and
commutative, so readers fold all folders once more, and nothing is ever too late to count. ``rewrite`` folds what is
there into one base table, between two runs or once a day; after it readers start from the base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fold = Callable[[DataFrame], DataFrame]

NUMBER = "batch_number"


class Partials:
    def __init__(self, spark: SparkSession, root: str, fold: Fold):
        self.spark, self.root, self.fold = spark, root.rstrip("/"), fold

    def append(self, batch: DataFrame, number: int) -> None:
        self.fold(batch).write.mode("overwrite").parquet(f"{self.root}/data/{NUMBER}={number}")

    def _hadoop(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def last_base(self) -> int | None:
        """Number of the last micro-batch that a complete base holds."""
        fs, path = self._hadoop("base")
        if not fs.exists(path):
            return None
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(path)]
        return max((n for n in numbers if fs.exists(self._hadoop(f"base/{n}/_SUCCESS")[1])), default=None)

    def _rows(self, schema: T.StructType, base: int | None) -> DataFrame:
        fs, path = self._hadoop("data")
        rows = self.spark.createDataFrame([], schema)
        if fs.exists(path):
            numbered = T.StructType([*schema.fields, T.StructField(NUMBER, T.LongType())])
            batches = self.spark.read.schema(numbered).parquet(f"{self.root}/data")
            # The number is the folder's, so folders that the base holds are not read.
            rows = batches.filter(F.col(NUMBER) > (-1 if base is None else base)).drop(NUMBER)
        return rows if base is None else self.spark.read.schema(schema).parquet(f"{self.root}/base/{base}").unionByName(rows)

    def read(self, schema: T.StructType | str) -> DataFrame:
        """The folded rows of all micro-batches so far. ``schema`` is that of folded rows."""
        return self.fold(self._rows(_struct(schema), self.last_base()))

    def rewrite(self, schema: T.StructType | str, number: int) -> None:
        """Write one base of all micro-batches up to ``number``, which have to be complete."""
        struct = _struct(schema)
        fs, path = self._hadoop("data")
        base = self.last_base()
        if not fs.exists(path) or (base is not None and base >= number):
            return
        numbered = T.StructType([*struct.fields, T.StructField(NUMBER, T.LongType())])
        batches = self.spark.read.schema(numbered).parquet(f"{self.root}/data")
        rows = batches.filter((F.col(NUMBER) > (-1 if base is None else base)) & (F.col(NUMBER) <= number)).drop(NUMBER)
        if base is not None:
            rows = rows.unionByName(self.spark.read.schema(struct).parquet(f"{self.root}/base/{base}"))
        self.fold(rows).write.mode("overwrite").parquet(f"{self.root}/base/{number}")


def _struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
