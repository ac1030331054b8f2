"""What grows with the input: no side of pixels is broadcast, and tasks become more, not larger."""

import pytest
from pyspark.sql import functions as F

from rastermill.operators import details, images
from rastermill.plans import thin

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sketches(spark):
    p = thin._sketches(spark, SF).where("image_id <= 2")
    return p, images.palette_of_dominant(p)


def test_pixels_are_not_broadcast(spark, sketches):
    p, palette = sketches
    labels = details.mixed_labels(p, palette)
    for df in (details.ridge_mask(p, 32), labels, details.thin_coverage(labels, palette), details.unexplained(p, palette, 0.045), details.detail_colours(p, palette)):
        assert "Broadcast" not in plan(df)
    hits = spark.range(50).select(F.lit(0).cast("long").alias("image_id"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("mark"))
    assert "Broadcast" not in plan(details.reached(hits, 1, 6))


def test_tasks_grow_in_number(spark, sketches, monkeypatch):
    from rastermill.sources import shared

    p = sketches[0]
    monkeypatch.setattr(shared, "PIXELS", 200)
    want = -(-p.count() // 200)
    assert shared.tasks_for(p) == want > 10
    assert details.ridge_hits(p, 32).rdd.getNumPartitions() == details.resample(p, details.bilinear(2)).rdd.getNumPartitions() == want


def test_drawings_know_their_left_neighbours(spark):
    from pyspark.sql import Window

    from rastermill.sources import roles

    p = roles.drawings(spark, SF, 64, beside=True)
    lag = F.lag("r").over(Window.partitionBy("image_id", "y").orderBy("x"))
    assert p.withColumn("lag", lag).where(~F.col("before").eqNullSafe(F.col("lag"))).count() == 0
    from rastermill.plans import traces

    assert "Sort " not in plan(traces.drawing_statistics(spark, SF))


def test_pixels_on_no_grid_are_not_moved(spark):
    rows = [(k, x, y) for k, n in enumerate((8, 12, 20)) for x in range(n) for y in range(n)]
    p = spark.createDataFrame(rows, "image_id long, x int, y int")
    got = {(r.image_id, r.x, r.y) for r in images.sampled(p, 16).collect()}
    assert got == {(k, x, y) for k, x, y in rows if x % (2, 3, 5)[k] == y % (2, 3, 5)[k] == 0}
    assert "% 5" in plan(images.sampled(p, 16))


def test_drawn_pixels_are_not_moved(spark):
    from rastermill.operators import labelling
    from rastermill.plans import traces

    labels = labelling.blended(*traces._small(spark, SF))
    shown = labels._jdf.queryExecution().executedPlan().toString()
    assert shown.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in shown  # pictures are dealt out, once for each side
    assert labels.select("image_id").count() == 10


def test_labels_of_blends_take_more_tasks_not_larger(spark, tmp_path, monkeypatch):
    """Pictures of suppliers with large keys, and without a nation or a balance, against the SQL; nothing but pictures is dealt out."""
    import duckdb

    from rastermill.plans import queries, traces
    from rastermill.sources import shared

    con, at = duckdb.connect(), tmp_path / "supplier.parquet"
    con.execute(f"copy (select i * 3000000000 as s_suppkey, case when i <> 3 then i % 7 end::int as s_nationkey, case when i <> 8 then 1234.5 * i - 2000 end::double as s_acctbal from range(12) t(i)) to '{at}' (format parquet)")
    con.execute(f"create view supplier as select * from '{at}'")
    monkeypatch.setattr(shared, "PIXELS", 1 << 17)
    found = queries.QUERIES["labels_of_blends"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 12 * traces._SIDE ** 2 // shared.PIXELS == 6
    got = found.collect()
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in shown and "Broadcast" not in shown
    want = con.execute(f"select image_id, x, y, label from ({queries.ORACLES['labels_of_blends']})").fetchall()
    assert found.columns == ["image_id", "x", "y", "label"] and len(want) == 12 * 128 * 128
    assert sorted(map(tuple, got)) == sorted(want)


def test_slivers_draw_their_pictures_once(spark, monkeypatch):
    from rastermill.plans import engine

    seen, real = [], engine.images.neighbour_pairs
    monkeypatch.setattr(engine.images, "neighbour_pairs", lambda p: seen.append(p) or real(p))
    engine.slivers_absorbed(spark, SF)
    assert seen[0].inputFiles() and all("rastermill-bands-" in f for f in seen[0].inputFiles())


def suppliers(tmp_path, n=12):
    """A table of suppliers with large keys, one without a nation and one without a balance, known to DuckDB as well."""
    import duckdb

    con, at = duckdb.connect(), tmp_path / "supplier.parquet"
    con.execute(f"copy (select i * 3000000000 as s_suppkey, case when i <> 3 then i % 7 end::int as s_nationkey, case when i <> 8 then 1234.5 * i - 2000 end::double as s_acctbal from range({n}) t(i)) to '{at}' (format parquet)")
    con.execute(f"create view supplier as select * from '{at}'")
    return con


@pytest.mark.parametrize("name", ["labels_of_mixtures", "labels_of_thin_features", "unexplained_pixels", "ridge_mask", "trace_quality"])
def test_sketches_stay_where_they_are_drawn(spark, tmp_path, monkeypatch, name):
    """Pictures are dealt out once, to more tasks as they become more; nothing of theirs is moved or written, and rows are the SQL's."""
    from rastermill.plans import queries
    from rastermill.sources import shared

    con = suppliers(tmp_path)
    monkeypatch.setattr(shared, "PIXELS", 2 * thin._SIDE**2)
    mark = shared.written(spark)
    found = queries.QUERIES[name](spark, str(tmp_path))
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() == 6 and shared.written(spark) == mark
    assert shown.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in shown and "Sort" not in shown
    want = con.execute(f"select {', '.join(found.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert want and sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["ridges_restored", "detail_colours", "palette_with_details"])
def test_pixels_of_sketches_are_neither_joined_nor_written(spark, tmp_path, name):
    from rastermill.plans import queries
    from rastermill.sources import shared

    con, mark = suppliers(tmp_path), shared.written(spark)
    found = queries.QUERIES[name](spark, str(tmp_path))
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert shared.written(spark) - mark == (name != "ridges_restored")  # palettes alone
    assert ", x#" not in "".join(line for line in shown.splitlines() if "Join" in line or "Window" in line)
    want = con.execute(f"select {', '.join(found.columns)} from ({queries.ORACLES[name]})").fetchall()
    none = lambda rows: sorted(tuple((v is None, v) for v in r) for r in rows)
    assert want and none(map(tuple, found.collect())) == none(want)
