"""Scenarios of the conversion service with known answers."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rastermill.functions import rules
from rastermill.operators import ledger, service
from rastermill.streaming import ledger as stream

T0 = datetime(2026, 10, 3, 12)
REQUEST = "request_id long, user_id long, made_at timestamp, type string, amount long, job_id long, grant_key string"


def requests(spark, rows):
    return spark.createDataFrame([(i, u, T0 + timedelta(seconds=i), t, a, j, g) for i, (u, t, a, j, g) in enumerate(rows)], REQUEST)


def test_ledger_scenario(spark):
    rows = [
        (1, "credit", 10, None, "signup"), (1, "credit", 10, None, "signup"), (1, "debit", 3, 7, None), (1, "debit", 3, 7, None), (1, "refund", 3, 7, None), (1, "refund", 3, 7, None),
        (1, "credit", 5, None, "promo-1"), (1, "credit", 5, None, "promo-1"), (1, "debit", 16, 8, None), (2, "credit", 3, None, None), *[(2, "debit", 1, j, None) for j in range(10)],
    ]
    got = {r["user_id"]: (r["balance"], r["rejected"]) for r in ledger.fold(ledger.dedupe(requests(spark, rows))).collect()}
    assert got == {1: (15, 1), 2: (0, 7)}
    assert [r["job_id"] for r in ledger.refundable(ledger.dedupe(requests(spark, rows))).collect()] == [7]
    assert stream.apply_entry(15, "debit", 16) == (15, False)


def test_rolling_limits(spark):
    limits = spark.createDataFrame([("free", 20, 100, 250 << 20)], "plan string, per_ten_minutes int, per_day int, storage_quota_bytes long")
    people = spark.createDataFrame([(1, "free")], "user_id long, plan string")
    schema = "upload_id long, user_id long, created_at timestamp, size_bytes long"
    busy = spark.createDataFrame([(i, 1, T0 + timedelta(seconds=i), 10) for i in range(21)], schema)
    assert [(r["upload_id"], r["rule"], r["retry_after"]) for r in service.usage_breaches(busy, people, limits).collect()] == [(20, "ten_minutes", 600)]
    calm = spark.createDataFrame([(i, 1, T0 + timedelta(minutes=5 * i), 10) for i in range(96)], schema)
    assert service.usage_breaches(calm, people, limits).count() == 0
    assert service.usage_breaches(calm.limit(0), people, limits).count() == 0


def test_orphans_both_ways(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (2,), (3,)], "k long")
    assert [r["k"] for r in service.without_row(a, b, "k").collect()] == [1]
    assert [r["k"] for r in service.without_row(b, a, "k").collect()] == [3]
    assert [r["k"] for r in service.with_row(a, b, "k").collect()] == [2]


def test_insert_update_delete(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, version int")
    state, lost = service.insert_unique(t, spark.createDataFrame([(2, "x", 1), (3, "y", 1), (3, "z", 1)], t.schema), "id")
    assert sorted((r["id"], r["v"]) for r in state.collect()) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(r["v"] for r in lost.collect()) == ["x", "z"]
    state, lost = service.update_versioned(t, spark.createDataFrame([(1, "n", 1), (2, "m", 0)], t.schema), "id", ["v"])
    assert sorted(map(tuple, state.collect())) == [(1, "n", 2), (2, "b", 1)]
    assert [r["id"] for r in lost.collect()] == [2]
    uploads = spark.createDataFrame([(1,), (2,)], "upload_id long")
    jobs = spark.createDataFrame([(10, 1), (20, 2)], "job_id long, upload_id long")
    results = spark.createDataFrame([(10, "a"), (20, "b")], "job_id long, key string")
    moves = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "request_id long, job_id long")
    u, j, r, m = service.delete_cascade(uploads, jobs, results, moves, uploads.where("upload_id = 1"))
    assert [[r.asDict() for r in x.collect()] for x in (u, j, r)] == [[{"upload_id": 2}], [{"job_id": 20, "upload_id": 2}], [{"job_id": 20, "key": "b"}]]
    assert {x["request_id"]: x["job_id"] for x in m.collect()} == {1: None, 2: 20, 3: None}


def test_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert [get(rules.credit_cost(F.lit(p), F.lit(n), F.lit(q))) for p, n, q in ((True, 1, False), (False, 1, False), (False, 3, True))] == [2, 1, 5]
    assert [get(rules.retry_seconds(F.lit(n))) for n in (1, 2, 3)] == [15, 30, 60]
    assert get(rules.extension(F.lit("a.B.JPEG"))) == "jpeg" and get(rules.extension(F.lit("none"))) == ""
    ok = lambda *a: get(rules.upload_error(*map(F.lit, a), F.lit(5 << 20)))
    assert ok("a.png", "image/png", 10, 10, 10) is None
    assert ok(" ", "text/plain", 0, 0, 0) == "name" and ok("a.png", "image/jpeg", 10, 1, 1) == "extension"
    assert ok("a.jpg", "image/jpeg", 3 << 20, 10, 10) == "padding" and ok("a.png", "image/png", 10, 30000, 30000) == "dimensions"
