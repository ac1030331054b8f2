"""The credit ledger in batch: idempotent entries, refunds, and balances that never fall below zero."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe(requests: DataFrame) -> DataFrame:
    """Requests that count: the first of each grant key of a user, else of each job and type.

    Plain credits without a key always count.
    """
    keyed = F.when(F.col("grant_key").isNotNull(), F.concat(F.lit("g:"), "grant_key")).when((F.col("type") != "credit") & F.col("job_id").isNotNull(), F.concat("type", F.lit(":"), F.col("job_id").cast("string"))).otherwise(F.concat(F.lit("r:"), F.col("request_id").cast("string")))
    first = Window.partitionBy("user_id", "_key").orderBy("made_at", "request_id")
    return requests.withColumn("_key", keyed).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_key", "_r")


def signed(amount, kind):
    return F.when(kind == "debit", -amount).otherwise(amount)


def balances(entries: DataFrame) -> DataFrame:
    return entries.groupBy("user_id").agg(F.sum(signed(F.col("amount"), F.col("type"))).alias("balance"), F.count("*").alias("n_entries"))


def refundable(entries: DataFrame) -> DataFrame:
    """Debits that a refund of the same user and job follows: a refund of a job never debited is none."""
    asked = entries.where("type = 'refund'").groupBy("user_id", "job_id").agg(F.min("made_at").alias("refund_at"))
    return entries.where("type = 'debit'").join(asked, ["user_id", "job_id"]).where(F.col("refund_at") > F.col("made_at")).select("user_id", "job_id", "request_id", "amount")


def fold(entries: DataFrame) -> DataFrame:
    """Balance of each user when debits beyond it are rejected, and how many were.

    Each rejection changes what follows, so a user's entries are folded in order: they are sorted within
    partitions and read batch by batch, with one balance carried along. No user's entries are gathered.
    """

    def run(batches):
        user, balance, accepted, rejected, any_row = None, 0, 0, 0, False
        for b in batches:
            done = []
            for u, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not any_row or u != user:
                    if any_row:
                        done.append((user, balance, accepted, rejected))
                    user, balance, accepted, rejected, any_row = u, 0, 0, 0, True
                if d is not None and balance + d >= 0:
                    balance, accepted = balance + d, accepted + 1
                else:
                    rejected += 1
            yield rows(done)
        if any_row:
            yield rows([(user, balance, accepted, rejected)])

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*done) if done else [[]] * 4)], ["user_id", "balance", "accepted", "rejected"])

    moves = entries.select(F.col("user_id").cast("long").alias("user_id"), "made_at", "request_id", signed(F.col("amount"), F.col("type")).cast("long").alias("d"))
    ordered = moves.repartition("user_id").sortWithinPartitions("user_id", "made_at", "request_id")
    return ordered.select("user_id", "d").mapInArrow(run, "user_id long, balance long, accepted long, rejected long")
