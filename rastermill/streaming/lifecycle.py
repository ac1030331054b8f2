"""Job lifecycle over a stream of queue deliveries: one decision for each, one state for each job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.rules import MAX_ATTEMPTS
from ..sources import roles
from .chunks import rows_in_order
from .leases import to_the_end

STATE = "status string, attempts int, refunds int"


def decide(status: str, attempts: int, outcome: str) -> tuple[str, int, str, bool]:
    """(status after, attempts after, action, refund) of one delivery.

    A finished job is only acknowledged. Success completes; a cause that a retry can't mend, or the last
    attempt, fails the job and refunds it; anything else goes back to the queue.
    """
    if status in ("completed", "failed"):
        return status, attempts, "ack", False
    attempts += 1
    if outcome == "success":
        return "completed", attempts, "ack", False
    if outcome == "permanent" or attempts >= MAX_ATTEMPTS:
        return "failed", attempts, "ack", True
    return "queued", attempts, "retry", False


def deliveries(events: DataFrame) -> DataFrame:
    """Queue deliveries from events, eight for a job: purchases succeed, errors are permanent, the rest may be tried again."""
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "permanent").otherwise("transient")
    return events.select(F.floor(F.col("event_id") / 8).alias("job_id"), F.col("event_id").alias("delivery_id"), F.col("ts").alias("made_at"), outcome.alias("outcome"))


class Lifecycle(StatefulProcessor):
    """One value a job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues):
        status, attempts, refunds = self.job.get() or ("queued", 0, 0)
        for row in rows_in_order(rows, "made_at", "delivery_id"):
            status, attempts, _, refund = decide(status, attempts, row.outcome)
            refunds += refund
        self.job.update((status, attempts, refunds))
        yield Row(job_id=key[0], status=status, attempts=attempts, refunds=refunds)

    def close(self) -> None:
        pass


def states(deliveries: DataFrame) -> DataFrame:
    """A stream of (job_id, status, attempts, refunds), a row whenever a job has deliveries. The state store must be RocksDB."""
    return deliveries.groupBy("job_id").transformWithState(statefulProcessor=Lifecycle(), outputStructType="job_id long, " + STATE, outputMode="Update", timeMode="None")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read all that is there, once, and return each job's last state."""
    events = lambda: spark.readStream.schema(roles.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return to_the_end(spark, lambda: states(deliveries(events())), ["job_id"], ["status", "attempts", "refunds"])
