"""What surrounds a trace: slivers, quality, markup, providers, stages, leases."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.operators import absorption, benchmarks, details, markup, providers
from rastermill.sources import shared, timing
from rastermill.streaming import leases

REGION = "image_id long, region long, inner int, area int, r double, g double, b double, grp long, fixed boolean"
PATH = "image_id long, grp long, stops array<struct<r: double, g: double, b: double>>"


def test_slivers_join_by_path_by_blend_and_through_others(spark):
    rows = [
        (1, 0, 90, 100, 0.5, 0.5, 0.5, 7, False),
        (1, 1, 0, 9, 0.52, 0.5, 0.5, None, False),  # on the path
        (1, 2, 9, 10, 0.5, 0.5, 0.5, None, False),  # broad
        (1, 3, 0, 9, 0.75, 0.5, 0.25, None, False),  # half of the gradient's end, half of 4
        (1, 4, 50, 60, 1.0, 0.5, 0.0, None, False),
        (1, 5, 0, 9, 0.5, 0.55, 0.5, None, False),  # only beside 1
        (1, 6, 0, 9, 0.5, 0.5, 0.5, None, True),  # not to be moved
        (1, 8, 0, 9, 0.1, 0.9, 0.9, None, False),  # another colour
        (2, 1, 0, 9, 0.5, 0.5, 0.5, None, False),  # an image without gradients
    ]
    paths = spark.createDataFrame([(1, 7, [(0.4, 0.4, 0.4), (0.5, 0.5, 0.5)])], PATH)
    borders = spark.createDataFrame([(1, 0, k) for k in (1, 2, 3, 6, 8)] + [(1, 3, 4), (1, 1, 5)], "image_id long, low long, high long")
    regions = spark.createDataFrame(rows, REGION)
    got = {(r.image_id, r.region): r.grp for r in absorption.absorb_slivers(regions, borders, paths).collect()}
    assert got == {(1, 0): 7, (1, 1): 7, (1, 2): None, (1, 3): 7, (1, 4): None, (1, 5): 7, (1, 6): None, (1, 8): None, (2, 1): None}
    once = {(r.image_id, r.region): r.grp for r in absorption.absorb_slivers(regions, borders, paths, rounds=1).collect()}
    assert once == got | {(1, 5): None}
    assert absorption.absorb_slivers(regions.limit(0), borders, paths).count() == 0


def test_a_perfect_trace_has_no_faults(spark):
    rows = [(k, x, y, 200 * (x > 3), 40, 9, 0 if k and y == 0 else 255) for k in (0, 1) for x in range(8) for y in range(8)]
    p = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")
    for r in benchmarks.trace_quality(p, p).collect():
        assert (r.mean_delta_e, r.bad_pixel_pct, r.boundary_error, r.alpha_error_pct, r.gaps_per_10k, r.edge_length_ratio) == (0, 0, 0, 0, 0, 1)
    moved = p.withColumn("r", F.when(F.col("x") > 4, 200).otherwise(0)).withColumn("a", F.when((F.col("x") == 2) & (F.col("y") == 3), 0).otherwise(F.col("a")))
    r = benchmarks.trace_quality(p, moved, scale=2).where("image_id = 0").first()
    assert r.bad_pixel_pct == pytest.approx(9 / 64 * 100) and r.boundary_error == pytest.approx(9 / 7 / 2) and r.gaps_per_10k == pytest.approx(10_000 / 64)


def clean(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.t for r in rows.select("i", markup.cleaned(F.col("t")).alias("t")).orderBy("i").collect()]


def test_groups_of_any_depth(spark):
    deep = "<g>" * 300 + " " + "</g>" * 300
    assert clean(spark, f"<svg>{deep}</svg>", f"<svg>{'<g>' * 60}<rect/>{'</g>' * 60}</svg>") == ["<svg></svg>", f"<svg>{'<g>' * 60}<rect/>{'</g>' * 60}</svg>"]
    assert clean(spark, '<g a="1"><g/>x<g> <g/>\n</g></g>', "</g> <g>", "<gx></gx><g></g>", "", '<path d=""></path><path id="p" d=" "/><path d="m0 0"/>', None) == ['<g a="1">x</g>', "</g> <g>", "<gx></gx>", "", '<path d="m0 0"/>', None]


def test_groups_against_repeated_replacement(spark):
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choice(["<g>", "<g id='a'>", "</g>", " ", "\n", "x", "<rect/>"]) for _ in range(rng.randrange(30))) for _ in range(150)]

    def plain(t):
        while (s := re.sub(r"<g(?=[\s/>])[^<>]*>\s*</g>", "", t)) != t:
            t = s
        return t

    assert clean(spark, *texts) == [plain(t) for t in texts]


def test_the_root_says_one_size(spark):
    rows = [('<?xml?><svg width="3" viewBox="1 2 3 4" id="a" height="9"><path/></svg> ',), ("<svg><svg/></svg>",), ("no drawing",)]
    d = spark.createDataFrame(rows, "t string").select(markup.sized(F.col("t"), F.lit(20), F.lit(8)).alias("t"))
    got = [tuple(r) for r in d.select("t", markup.aspect(F.col("t"))).collect()]
    assert got == [('<?xml?><svg id="a" width="20" height="8" viewBox="0 0 20 8"><path/></svg>', 2.5), ('<svg width="20" height="8" viewBox="0 0 20 8"><svg/></svg>', 2.5), ("no drawing", 1.0)]


def test_only_what_failed_goes_on(spark, tmp_path):
    rows = [(k, bytes([k]) * 4 if k != 5 else None, 1, 1) for k in range(8)]
    asked = str(tmp_path)

    def first(body, w, h):
        if body[0] == 1:
            raise MemoryError
        if body[0] % 2:
            raise ValueError
        return b"first"

    def second(body, w, h):
        open(f"{asked}/{body[0]}", "x").close()
        if body[0] == 7:
            raise ValueError
        return b"second"

    got = {r.image_id: (r.provider, None if r.result is None else bytes(r.result), r.failure) for r in providers.convert(spark.createDataFrame(rows, "image_id long, body binary, width int, height int"), [("a", first), ("b", second)]).collect()}
    assert got == {**{k: ("a", b"first", None) for k in (0, 2, 4, 6)}, 1: ("a", None, "memory"), 3: ("b", b"second", None), 5: ("b", None, "error"), 7: ("b", None, "error")}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["3", "7"]  # each once


def test_stages_are_measured(spark):
    stages = timing.Stages(spark)
    out = stages.chain(spark.range(10), [("all", lambda d: d), ("even", lambda d: d.where("id % 2 = 0"))])
    got = stages.table().collect()
    assert out.count() == 5 and [(r.place, r.stage, r.rows) for r in got] == [(0, "all", 10), (1, "even", 5)] and all(r.bytes > 0 and r.seconds > 0 for r in got)
    assert shared.folder_of(out) is not None


MINUTE = 60_000


def test_what_time_does_to_a_job():
    works = lambda tries: tries == 2
    step = lambda s, t, what: leases.delivered(s, t, what, 300, works)
    s = step(leases.FRESH, 0, "crash")
    assert s == ("processing", 1, 0, 0, 0, 0, 5 * MINUTE)
    assert step(s, 4 * MINUTE, "success") == ("processing", 1, 1, 0, 0, 0, 5 * MINUTE)
    assert leases.advance(s, 5 * MINUTE, works) == ("queued", 1, 0, 1, 0, 0, None)
    assert step(s, 6 * MINUTE, "success") == ("completed", 2, 0, 1, 0, 0, None)
    bad = step(leases.FRESH, 0, "permanent")
    assert bad == ("failing", 1, 0, 0, 0, 1, MINUTE)  # the first try to fail it didn't work
    assert leases.advance(bad, 2 * MINUTE - 1, works)[0] == "failing" and leases.advance(bad, 2 * MINUTE, works) == ("failed", 1, 0, 0, 1, 2, None)
    third = step(("queued", 2, 0, 0, 0, 0, None), 0, "crash")
    assert leases.advance(third, 7 * MINUTE, works) == ("failed", 3, 0, 1, 1, 2, None)
    assert step(bad, MINUTE // 2, "success") == bad


def test_timers_fire_between_batches(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rng = random.Random(4)
    rows = sorted((start + timedelta(seconds=rng.randrange(3600)), k, k % 12, rng.choice(["crash", "crash", "transient", "permanent", "success"])) for k in range(60))
    refundable = lambda job, tries: (job + tries) % 3 == 0
    schema = "job_id long, delivery_id long, made_at timestamp, outcome string"
    for n in range(4):
        part = rows[15 * n : 15 * n + 15]
        spark.createDataFrame([(job, k, at, what) for at, k, job, what in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    got = {r.job_id: tuple(r)[1:] for r in leases.to_the_end(spark, lambda: leases.states(read(), 300, refundable), ["job_id"], ["status", "attempts", "held", "ended", "refunds"]).collect()}
    want, last = {}, rows[-1][0]
    for job in range(12):
        s, works = leases.FRESH, lambda tries, job=job: refundable(job, tries)
        for at, _, j, what in rows:
            if j == job:
                s = leases.delivered(s, int(at.timestamp() * 1000), what, 300, works)
        want[job] = leases.advance(s, int(last.timestamp() * 1000), works)[:5]
    assert got == want


def test_samples_of_no_pixels(spark):
    none = spark.createDataFrame([], "image_id long, x int, y int, r int, g int, b int, a int")
    assert details.resample(none, details.bilinear(2)).count() == 0 and details.ridge_mask(none, 20).count() == 0
    assert benchmarks.trace_quality(none, none).count() == 0 and np.isclose(sum(details.catmull_rom(3)[0].values()), 1)
