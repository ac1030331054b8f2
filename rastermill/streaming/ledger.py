"""The credit ledger as a keyed state machine over a stream; the batch fold is its twin."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import roles
from .chunks import rows_in_order
from .leases import to_the_end

#: Entries of one user that a batch remembers itself; the state is asked for more.
KNOWN = 100_000
OUTPUT = "user_id long, balance long, accepted long, rejected long"


def entry_key(request_id, kind, job_id, grant_key) -> str:
    """What makes a repeated request the same entry: the grant key, else job and type, else nothing."""
    if grant_key is not None:
        return f"g:{grant_key}"
    if kind != "credit" and job_id is not None:
        return f"{kind}:{job_id}"
    return f"r:{request_id}"


def apply_entry(balance: int, kind: str, amount: int) -> tuple[int, bool]:
    """(balance after, accepted): a debit beyond the balance is refused."""
    after = balance - amount if kind == "debit" else balance + amount
    return (after, True) if after >= 0 else (balance, False)


class Ledger(StatefulProcessor):
    """A user's totals as one value, and the entries seen as a map: an entry is looked up and added by itself, so a batch
    costs what it holds, whatever came before. With `remember`, entries are forgotten after so many milliseconds."""

    def __init__(self, remember: int | None = None):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "balance long, accepted long, rejected long")
        self.seen = handle.getMapState("seen", "entry string", "known boolean", self.remember)

    def handleInputRows(self, key, rows, timerValues):
        totals, known = self.totals.get(), set()
        balance, accepted, rejected = totals or (0, 0, 0)
        for row in rows_in_order(rows, "made_at", "request_id"):
            job = None if pd.isna(row.job_id) else int(row.job_id)
            entry = entry_key(row.request_id, row.type, job, None if pd.isna(row.grant_key) else row.grant_key)
            if entry in known:
                continue
            if len(known) < KNOWN:
                known.add(entry)
            if (totals is not None or len(known) >= KNOWN) and self.seen.containsKey((entry,)):  # a new user has no entries but this batch's
                continue
            self.seen.updateValue((entry,), (True,))
            balance, ok = apply_entry(balance, row.type, int(row.amount))
            accepted, rejected = accepted + ok, rejected + (not ok)
        self.totals.update((balance, accepted, rejected))
        yield Row(user_id=int(key[0]), balance=balance, accepted=accepted, rejected=rejected)

    def close(self) -> None:
        pass


def balances(requests: DataFrame, remember: int | None = None) -> DataFrame:
    """A stream of each user's balance after every batch that touched it. The session's state store must be RocksDB."""
    return requests.groupBy("user_id").transformWithState(statefulProcessor=Ledger(remember), outputStructType=OUTPUT, outputMode="Update", timeMode="None" if remember is None else "ProcessingTime")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read all that is there, once, and return the last balance of each user."""
    events = lambda: spark.readStream.schema(roles.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return to_the_end(spark, lambda: balances(roles.ledger_of(events())), ["user_id"], ["balance", "accepted", "rejected"])
