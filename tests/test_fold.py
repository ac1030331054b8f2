"""Folds of long histories in bounded memory."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from rastermill.operators import ledger
from rastermill.streaming import chunks

SCHEMA = "request_id long, user_id long, made_at timestamp, type string, amount long"


def test_fold_gathers_nothing_and_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), datetime(2026, 1, 1) + timedelta(seconds=rng.randrange(500)), rng.choice(["credit", "debit", "debit", "refund"]), rng.choice([1, 5, 20, None])) for i in range(5000)]
    want = {}
    for _, user, _, kind, amount in sorted(rows, key=lambda r: (r[2], r[0])):
        b, a, r = want.get(user, (0, 0, 0))
        d = None if amount is None else -amount if kind == "debit" else amount
        want[user] = (b + d, a + 1, r) if d is not None and b + d >= 0 else (b, a, r + 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        folded = ledger.fold(spark.createDataFrame(rows, SCHEMA))
        assert {r["user_id"]: (r["balance"], r["accepted"], r["rejected"]) for r in folded.collect()} == want
        assert ledger.fold(spark.createDataFrame([], SCHEMA)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in folded._jdf.queryExecution().toString()


def test_rows_are_merged_in_order(monkeypatch):
    monkeypatch.setattr(chunks, "RUN", 30)
    rng = random.Random(2)
    rows = [(pd.Timestamp(2026, 1, 1) + pd.Timedelta(seconds=rng.randrange(50)) if rng.random() < 0.9 else pd.NaT, i, rng.choice(["a", None])) for i in range(1000)]
    rng.shuffle(rows)
    whole = pd.DataFrame(rows, columns=["at", "n", "v"])
    got = list(chunks.in_order((whole[i : i + 7] for i in range(0, 1000, 7)), "at", "n"))
    assert [r.n for r in got] == whole.sort_values(["at", "n"])["n"].tolist()
    assert [r.n for r in chunks.in_order([whole[:9]], "at", "n")] == whole[:9].sort_values(["at", "n"])["n"].tolist() and list(chunks.in_order([], "at")) == []


@pytest.mark.parametrize("most", (30, 5000))
def test_single_rows_are_sorted_without_frames(monkeypatch, most):
    from pyspark.sql import Row

    monkeypatch.setattr(chunks, "RUN", most)
    made = []
    monkeypatch.setattr(chunks.tempfile, "TemporaryDirectory", lambda real=chunks.tempfile.TemporaryDirectory: made.append(1) or real())
    rng = random.Random(3)
    rows = [Row(at=pd.Timestamp(2026, 1, 1).to_pydatetime() + pd.Timedelta(seconds=rng.randrange(50)) if rng.random() < 0.9 else None, n=i) for i in range(1000)]
    want = sorted(rows, key=lambda r: (r.at is None, r.at or pd.Timestamp(0), r.n))
    rng.shuffle(rows)
    assert [r.n for r in chunks.rows_in_order(iter(rows), "at", "n")] == [r.n for r in want]
    assert len(made) == (most == 30) and list(chunks.rows_in_order([], "at")) == []


def test_a_ledger_goes_on_in_the_next_batch(spark, tmp_path):
    from rastermill.streaming import leases
    from rastermill.streaming import ledger as stream

    start = pd.Timestamp(2026, 1, 1)
    rows = [(k, 1, (start + pd.Timedelta(seconds=k)).to_pydatetime(), kind, amount, job, grant) for k, (kind, amount, job, grant) in enumerate([("credit", 9, None, "promo"), ("debit", 5, 1, None), ("debit", 5, 2, None), ("credit", 9, None, "promo"), ("debit", 5, 1, None), ("refund", 5, 1, None), ("refund", 5, 1, None), ("credit", 2, None, None)])]
    schema = "request_id long, user_id long, made_at timestamp, type string, amount long, job_id long, grant_key string"
    for n in range(2):
        spark.createDataFrame(rows[4 * n : 4 * n + 4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    read = lambda: stream.balances(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*"))
    last = leases.to_the_end(spark, read, ["user_id"], ["balance", "accepted", "rejected"]).collect()
    assert [tuple(r) for r in last] == [(1, 11, 4, 1)]
