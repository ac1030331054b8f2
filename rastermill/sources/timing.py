"""What stages of a job cost: rows, bytes and seconds of each written table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import folder_of, save

MEASURES = "place int, stage string, rows long, bytes long, seconds double"


class Stages:
    """Runs stages one after the other and keeps count.

    Each stage's result is written to the shared folder. Its rows are counted by an observation while they are
    written, so that nothing is computed twice; bytes are those of the files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.measured = spark, []

    def run(self, name: str, made: DataFrame) -> DataFrame:
        seen, began = Observation(), time.time()
        out = save(made.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        self.measured.append((len(self.measured), name, seen.get["rows"], _size(self.spark, folder_of(out)), time.time() - began))
        return out

    def chain(self, docs: DataFrame, stages: Iterable[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
        """The result of stages that each take the one before."""
        for name, stage in stages:
            docs = self.run(name, stage(docs))
        return docs

    def table(self) -> DataFrame:
        """(place, stage, rows, bytes, seconds) of all stages so far."""
        return self.spark.createDataFrame(self.measured, MEASURES)


def _size(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
