"""Summaries and comparisons of benchmark rows, and areas of chains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import roles
from ..sources.shared import save
from . import pictures as kernels
from .edges import composite_white, edge_pixels, gap_pixels
from .images import diff_metrics
from .pictures import Pictures


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows from order lines: tax and discount as errors, quantity as segments; the largest failed."""
    made = roles.table(spark, sf_dir, "lineitem").join(roles.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return made.select(
        F.concat("l_returnflag", "l_linestatus").alias("engine"), F.col("p_brand").alias("category"), F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("variant"), F.col("l_tax").alias("mean_delta_e"),
        F.col("l_discount").alias("boundary_error"), F.col("l_quantity").cast("long").alias("segments"), F.floor("l_extendedprice").cast("long").alias("bytes"), (F.col("l_quantity") > 48).alias("failed"),
    )


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, means and sums of each group; failed rows count but have no part in quality."""
    good = lambda c: F.when(~F.col("failed") & ~F.isnan(F.col(c).cast("double")), F.col(c))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("failed").cast("int")).alias("n_failed"), F.round(F.avg(good("mean_delta_e")), 6).alias("mean_delta_e"), F.round(F.avg(good("boundary_error")), 6).alias("boundary_error"),
        F.sum(good("segments")).alias("segments"), F.max("bytes").alias("max_bytes"),
    )


def with_baseline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each case, and a baseline: a table of its own, here of the rows of the case before. Made once, read twice."""
    lines = roles.table(spark, sf_dir, "lineitem")
    engine = F.concat("l_returnflag", "l_linestatus")
    own = lines.join(roles.table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    sums = [F.avg("l_tax").alias("mean_delta_e"), F.avg("l_discount").alias("boundary_error"), F.sum(F.col("l_quantity").cast("long")).alias("segments"), F.sum(F.floor("l_extendedprice").cast("long")).alias("bytes")]
    now = save(own.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("variant"), engine.alias("engine")).agg(*sums), "rows")
    return now, now.withColumn("case_id", F.col("case_id") + 1)


def verdicts(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """new, WORSE, better or unchanged against the baseline row of the same case, variant and engine."""
    keys = ["case_id", "variant", "engine"]
    both = now.join(baseline.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("mean_delta_e", "boundary_error", "segments", "bytes")]), keys, "left")
    change = lambda c: F.round(F.col(c) - F.col(f"b_{c}"), 6)
    worse = (change("mean_delta_e") > 0.02) | (change("boundary_error") > 0.02) | (F.col("segments") > F.col("b_segments") * 1.15) | (F.col("bytes") > F.col("b_bytes") * 1.3)
    better = (change("mean_delta_e") < -0.01) | (change("boundary_error") < -0.01) | (F.col("segments") < F.col("b_segments") * 0.9)
    return both.select(*keys, F.when(F.col("b_bytes").isNull(), "new").when(worse, "WORSE").when(better, "better").otherwise("unchanged").alias("verdict"))


def chain_areas(events: DataFrame) -> DataFrame:
    """Shoelace area of each user's closed chain of points (value, days), in order of time."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at, "event_id")
    p = events.select("user_id", "event_id", "ts", F.col("value").alias("px"), (at / 86400e6).alias("py"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    q = p.withColumns({"nx": F.coalesce(F.lead("px").over(w), F.first("px").over(whole)), "ny": F.coalesce(F.lead("py").over(w), F.first("py").over(whole))})
    return q.groupBy("user_id").agg(F.count("*").alias("n"), (F.round(F.sum(F.col("px") * (F.col("ny") - 19700) - F.col("nx") * (F.col("py") - 19700)) / 2, 3) + 0).alias("area"))


def by_case(rows: DataFrame) -> DataFrame:
    """One row for each case (a category here), variant and engine: mean error of the rows that didn't fail."""
    good = rows.where("not failed")
    return good.groupBy(F.col("category").alias("case_id"), "variant", "engine").agg(F.avg("mean_delta_e").alias("mean_delta_e"))


def against(rows: DataFrame, engine: str, other: str, tolerance) -> DataFrame:
    """Rows of one engine beside those of another for the same case and variant; `within` its error times a tolerance."""
    mine = rows.where(F.col("engine") == engine).drop("engine")
    theirs = rows.where(F.col("engine") == other).select("case_id", "variant", F.col("mean_delta_e").alias("other_delta_e"))
    both = mine.join(theirs, ["case_id", "variant"])
    return both.withColumn("within", F.round(F.col("mean_delta_e") - F.col("other_delta_e") * tolerance, 9) <= 0)


def rounded(rows: DataFrame, digits: int = 3) -> DataFrame:
    """All fractional columns rounded, as a baseline keeps them."""
    return rows.select(*[F.round(c, digits).alias(c) if t in ("double", "float") or t.startswith("decimal") else F.col(c) for c, t in rows.dtypes])


def with_sentinels(rows: DataFrame) -> DataFrame:
    """Failed rows with errors that are no numbers and counts of zero: they count, and nothing can rest on them."""
    nan, gone = F.lit(float("nan")), F.col("failed")
    return rows.withColumns({**{c: F.when(gone, nan).otherwise(F.col(c)) for c in ("mean_delta_e", "boundary_error")}, **{c: F.when(gone, 0).otherwise(F.col(c)) for c in ("segments", "bytes")}})


def category_times(rows: DataFrame) -> DataFrame:
    """Means of each category and engine: of errors without failed rows, of times with them."""
    return rows.groupBy("category", "engine").agg(F.count("*").alias("n"), F.round(F.avg(F.when(~F.col("failed"), F.col("mean_delta_e"))), 6).alias("mean_delta_e"), F.round(F.avg("trace_ms"), 4).alias("mean_ms"))


def corpus(core: DataFrame, real: DataFrame, include_real: bool) -> DataFrame:
    return core.unionByName(real) if include_real else core


def markdown(summary: DataFrame, *columns: str) -> DataFrame:
    """(place, line): a summary as lines of a Markdown table, in order of the first column."""
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    cells = [F.col(c).cast("decimal(38,3)").cast("string") if t in ("double", "float") else F.col(c).cast("string") for c, t in summary.select(*columns).dtypes]
    body = summary.select((F.row_number().over(Window.orderBy(columns[0])) + 1).cast("long").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("-")) for c in cells]), F.lit(" |")).alias("line"))
    top = summary.sparkSession.range(2).select(F.col("id").alias("place"), F.element_at(F.array(*map(F.lit, head)), (F.col("id") + 1).cast("int")).alias("line"))
    return top.union(body)


def trace_quality(truth: DataFrame, traced: DataFrame, scale: float = 1.0) -> DataFrame:
    """How a trace differs from the picture it was made of, a row for each image, both seen on white paper.

    mean_delta_e and bad_pixel_pct: mean OKLab distance times 100, and pixels beyond 0.1; boundary_error: those pixels
    over the truth's edge pixels and `scale`, the picture's pixels for each of the source's; alpha_error_pct; gaps_per_10k:
    see-through pixels amid opaque ones; edge_length_ratio: edge pixels of the trace over those of the truth.
    """
    seen = [composite_white(p.na.fill(0, ["r", "g", "b"])) for p in (truth, traced)]
    edge = [edge_pixels(p) for p in seen]
    d = diff_metrics(*seen).join(edge[0].hint("merge"), "image_id").join(edge[1].withColumnRenamed("edges", "traced_edges").hint("merge"), "image_id").join(gap_pixels(truth, traced).hint("merge"), "image_id")
    return _shares(d, scale)


def resampled_quality(pictures: Pictures, kernel: list[dict[int, float]], scale: float = 1.0) -> DataFrame:
    """`trace_quality` of pictures against what a kernel of one place (`details.gaussian`) makes of them, in one pass."""

    def run(pile):
        n, h, w = pile.shape
        alpha = pile.planes["a"]
        colours, clear = kernels.samples(pile, kernel, 0, h)
        truth, traced = kernels.on_white(np.stack([pile.planes[c] for c in "rgb"]), alpha), kernels.on_white(colours, clear)
        d = np.sqrt(kernels.squares(truth - traced)).reshape(n, -1)
        columns = [
            (pile.ids, pa.int64()), (np.full(n, h * w), pa.int64()), (d.mean(axis=1), pa.float64()), ((d > 0.1).sum(axis=1), pa.int64()), (np.abs(alpha - clear).reshape(n, -1).mean(axis=1), pa.float64()),
            (kernels.edges(truth), pa.int64()), (kernels.edges(traced), pa.int64()), ((alpha == 255).sum(axis=(1, 2)), pa.int64()), (kernels.gaps(alpha, clear), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], [k.split()[0] for k in MEASURES.split(", ")])

    return _shares(pictures.map(run, MEASURES), scale)


MEASURES = "image_id long, n long, mean_delta double, n_bad long, alpha_error double, edges long, traced_edges long, opaque long, gaps long"


def _shares(d: DataFrame, scale: float) -> DataFrame:
    """The measures of `trace_quality` from counts and means of each image."""
    over = lambda a, b, empty: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(empty))
    return d.select(
        "image_id", (F.col("mean_delta") * 100).alias("mean_delta_e"), (over("n_bad", "n", 0.0) * 100).alias("bad_pixel_pct"), (over("n_bad", "edges", 0.0) / scale).alias("boundary_error"),
        (F.col("alpha_error") / 255.0 * 100).alias("alpha_error_pct"), (over("gaps", "opaque", 0.0) * 10_000).alias("gaps_per_10k"), over("traced_edges", "edges", 1.0).alias("edge_length_ratio"),
    )
