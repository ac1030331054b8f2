"""Dealing rows to buckets, and reading whole buckets in a task.

A bucket beyond a number of rows is cut into pieces by a hash, and every pair of its pieces is a bucket of
its own. No task holds more than two pieces, and every pair of rows still meets exactly once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save


def deal(rows: DataFrame, by: str, piece: int) -> DataFrame:
    """`rows` (with a long `key`) sorted by bucket: `key`, `i`, `j`, and `left`, true for rows of piece i.

    Where i = j all pairs of the bucket are to be compared, else those of a left and another row. `by` is
    the column whose hash deals a large bucket to pieces; equal values share a piece.
    """
    hot = save(rows.groupBy("key").count().where(F.col("count") > piece).select(F.col("key").alias("_key"), F.ceil(F.col("count") / piece).cast("int").alias("_n")), "hot-buckets")
    if hot.isEmpty():
        parts = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "left": F.lit(True)})
    else:
        own = rows.join(hot, F.col("key") == F.col("_key"), "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_p", F.pmod(F.xxhash64(by), F.col("_n")).cast("int"))
        each = own.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        parts = each.withColumns({"i": F.least("_p", "_q"), "j": F.greatest("_p", "_q"), "left": F.col("_p") <= F.col("_q")}).drop("_key", "_n", "_p", "_q")
    return parts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def whole_buckets(batches):
    """(table, ends): tables of whole buckets from batches that `deal` sorted, with each bucket's end."""
    rest = None
    for x in batches:
        if not x.num_rows:
            continue
        t = pa.Table.from_batches([x]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([x])])
        key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        if len(new):
            yield t.slice(0, int(new[-1])), new
            t = t.slice(int(new[-1]))
        rest = t
    if rest is not None:
        yield rest, np.array([rest.num_rows])


class Roots:
    """Which rows of a task are known to be connected; `of` names the smallest row of each group."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while len(a):
            x, y = of[a], of[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
            while not ((up := of[of]) == of).all():
                of[:] = up
