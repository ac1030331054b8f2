"""Queries over jobs, uploads, results and objects. Column names follow `sources.roles`."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

ACTIVE = ("queued", "processing")


def job_pages(jobs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Of each user's jobs, newest first, the rows of one page, with the total and whether more follow.

    Ranks are cut off at the page inside the window's sort; totals are a count of their own, so no user's jobs
    are held for it.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    page = jobs.withColumn("place", F.row_number().over(newest)).where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    total = jobs.groupBy("user_id").agg(F.count("*").alias("total"))
    return page.join(total, "user_id").withColumn("has_more", F.col("total") > offset + limit)


def history(jobs: DataFrame, results: DataFrame, limit: int = 20) -> DataFrame:
    """A page of jobs with the lists of their own results; only results of those jobs are gathered."""
    page = job_pages(jobs, limit)
    own = page.select("job_id", "user_id", "place", "total", "has_more").join(results.select("job_id", "user_id", "line"), ["job_id", "user_id"], "left")
    return own.groupBy("job_id", "user_id", "place", "total", "has_more").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def without_row(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys that no row has: orphaned objects, or the other way round rows whose object is missing."""
    return keys.join(rows.select(key).distinct(), key, "left_anti")


def with_row(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return keys.join(rows.select(key).distinct(), key, "left_semi")


def retention_candidates(jobs: DataFrame, results: DataFrame, before, batch: int = 50) -> DataFrame:
    """The oldest uploads whose jobs are all finished before a time, with their numbers of jobs and results."""
    old = jobs.groupBy("upload_id").agg(F.max("created_at").alias("newest"), F.min("created_at").alias("oldest"), F.count("*").alias("n_jobs")).where(F.col("newest") < before)
    idle = old.join(jobs.where(F.col("status").isin(*ACTIVE)).select("upload_id").distinct(), "upload_id", "left_anti")
    first = idle.orderBy("oldest", "upload_id").limit(batch)
    of = jobs.select("upload_id", "job_id").join(results.groupBy("job_id").agg(F.count("*").alias("n")), "job_id").groupBy("upload_id").agg(F.sum("n").alias("n_results"))
    return first.join(of, "upload_id", "left").select("upload_id", "n_jobs", F.coalesce("n_results", F.lit(0)).alias("n_results"))


def stored_bytes(profiles: DataFrame, results: DataFrame) -> DataFrame:
    """Bytes of each user, zero for users without results."""
    sums = results.groupBy("user_id").agg(F.sum("file_size_bytes").alias("bytes"))
    return profiles.select("user_id").join(sums, "user_id", "left").select("user_id", F.coalesce("bytes", F.lit(0)).alias("stored_bytes"))


def violations(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that should be unique and aren't."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def rolling_counts(uploads: DataFrame, **seconds: int) -> DataFrame:
    """For each upload, how many its user made in the time up to it: one count for each named span."""
    t = F.unix_micros(F.col("created_at").cast("timestamp"))
    own = uploads.withColumn("_t", t)
    for name, s in seconds.items():
        own = own.withColumn(name, F.count("*").over(Window.partitionBy("user_id").orderBy("_t").rangeBetween(-s * 1_000_000, 0)))
    return own.drop("_t")


def usage_breaches(uploads: DataFrame, profiles: DataFrame, limits: DataFrame) -> DataFrame:
    """Uploads at which a rolling count or the stored bytes pass the limit of the user's plan.

    Counts break a limit when they reach it before the upload, bytes when they pass it. The two columns of
    limits are per_ten_minutes and per_day; the wait is the one that the first broken rule asks for.
    """
    counted = rolling_counts(uploads, n_ten_minutes=600, n_day=86400)
    sized = counted.withColumn("stored", F.sum("size_bytes").over(Window.partitionBy("user_id").orderBy("created_at", "upload_id").rowsBetween(Window.unboundedPreceding, 0)))
    known = sized.join(profiles.select("user_id", "plan"), "user_id", "left").withColumn("plan", F.coalesce("plan", F.lit("free"))).join(F.broadcast(limits), "plan")
    broken = F.when(F.col("n_ten_minutes") > F.col("per_ten_minutes"), "ten_minutes").when(F.col("n_day") > F.col("per_day"), "day").when(F.col("stored") > F.col("storage_quota_bytes"), "quota")
    wait = F.when(F.col("rule") == "ten_minutes", 600).when(F.col("rule") == "day", 3600)
    return known.withColumn("rule", broken).where("rule is not null").withColumn("retry_after", wait).select("upload_id", "user_id", "plan", "rule", "retry_after", "n_ten_minutes", "n_day", "stored")


def stale_jobs(jobs: DataFrame, now, processing_seconds: int = 1200, queued_seconds: int = 3600) -> DataFrame:
    """Active jobs that have been so for too long, with their age in seconds."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    over = F.when(F.col("status") == "processing", age > processing_seconds).when(F.col("status") == "queued", age > queued_seconds)
    return jobs.withColumn("age_seconds", age).where(over)


def one_active(jobs: DataFrame) -> DataFrame:
    """The job that wins each upload's single active place: the first made; later ones are told its id."""
    first = Window.partitionBy("upload_id").orderBy("created_at", "job_id")
    return jobs.where(F.col("status").isin(*ACTIVE)).withColumns({"rank": F.row_number().over(first), "winner": F.first("job_id").over(first)})


def latest_result(results: DataFrame) -> DataFrame:
    """The newest result of each job; of equally new ones the last line, then the largest."""
    best = F.max(F.struct("created_at", "line", "file_size_bytes", "user_id")).alias("m")
    return results.groupBy("job_id").agg(best).select("job_id", "m.line", "m.file_size_bytes", "m.user_id")


def insert_unique(table: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(next state, conflicts): new rows go in unless their key is taken; of equal new keys the first wins."""
    ranked = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*new.columns)))
    taken = ranked.join(table.select(key).distinct(), key, "left_semi")
    free = ranked.join(table.select(key).distinct(), key, "left_anti")
    return table.unionByName(free.where("_r = 1").drop("_r")), taken.unionByName(free.where("_r > 1")).drop("_r")


def update_versioned(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(next state, conflicts): a change applies only to the version that it has seen."""
    new = changes.select(F.col(key).alias("_key"), F.col("version").alias("_version"), *[F.col(c).alias(f"_{c}") for c in columns])
    met = table.join(new, (F.col(key) == F.col("_key")) & (F.col("version") == F.col("_version")), "left")
    hit = F.col("_key").isNotNull()
    state = met.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else (F.col(c) + hit.cast("int")).alias(c) if c == "version" else F.col(c) for c in table.columns])
    return state, changes.join(table.select(key, "version"), [key, "version"], "left_anti")


def delete_cascade(uploads: DataFrame, jobs: DataFrame, results: DataFrame, ledger: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the uploads in `gone`; ledger rows stay and forget their job."""
    lost = jobs.join(gone.select("upload_id"), "upload_id", "left_semi").select("job_id")
    forgot = ledger.join(lost.withColumn("_lost", F.lit(True)), "job_id", "left").withColumn("job_id", F.when(F.col("_lost").isNull(), F.col("job_id"))).drop("_lost")
    return uploads.join(gone, "upload_id", "left_anti"), jobs.join(gone, "upload_id", "left_anti"), results.join(lost, "job_id", "left_anti"), forgot.select(*ledger.columns)


def _as_key(asked, kind):
    """A text as a key of this type, or null if it isn't how such a key is written."""
    key = asked.try_cast(kind)
    return F.when(key.cast("string") == asked, key)


def find(table: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal what is asked for, a text: an id that can't be one finds nothing, and is no error.

    What is asked is made a value of the column's type, so that the column itself is compared and files are skipped
    by their statistics.
    """
    for name, value in equal.items():
        table = table.where(F.col(name) == _as_key(F.lit(str(value)), table.schema[name].dataType))
    return table


def lookup(asked: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`asked` (a column `asked` of texts) with the rows that they name, or nulls."""
    sought = asked.withColumn("_sought", _as_key(F.col("asked"), table.schema[key].dataType))
    return sought.join(table.withColumn("_key", F.col(key)), F.col("_sought") == F.col("_key"), "left").drop("_key", "_sought")


def download_access(requests: DataFrame, results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (caller, key) with a status: 404 without such a result, 403 if it is another user's, 410 if its job isn't completed."""
    held = requests.join(results.select("key", F.col("user_id").alias("_owner"), "job_id"), "key", "left").join(jobs.select("job_id", F.col("status").alias("_status")), "job_id", "left")
    status = F.when(F.col("_owner").isNull(), 404).when(F.col("_owner") != F.col("caller"), 403).when(F.coalesce("_status", F.lit("")) != "completed", 410).otherwise(200)
    return held.select(*requests.columns, "job_id", status.alias("http_status"))


def sweep(objects: DataFrame, rows: DataFrame, now, shard, grace_seconds: int = rules.GRACE_SECONDS) -> DataFrame:
    """Objects (key, uploaded) of one shard that are older than the grace and that no row has."""
    mine = objects.where(F.startswith("key", rules.shard_prefix(shard)) & (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("uploaded").cast("timestamp")) > grace_seconds))
    return without_row(mine, rows, "key")


def stale_batch(jobs: DataFrame, now, batch: int = 50) -> DataFrame:
    """Of each kind of stale job the oldest ones: two sorts that stop at a batch, not a window over all."""
    found = stale_jobs(jobs, now)
    first = [found.where(F.col("status") == s).orderBy("created_at", "job_id").limit(batch) for s in ACTIVE]
    return first[0].unionByName(first[1])


def active_job_breaches(jobs: DataFrame, profiles: DataFrame, limits: DataFrame) -> DataFrame:
    """Users who may not start another job now: as many active ones as their plan allows, or more."""
    active = jobs.where(F.col("status").isin(*ACTIVE)).groupBy("user_id").agg(F.count("*").alias("n_active"))
    known = active.join(profiles.select("user_id", "plan"), "user_id", "left").withColumn("plan", F.coalesce("plan", F.lit("free")))
    over = known.join(F.broadcast(limits.select("plan", "max_active_jobs")), "plan").where(F.col("n_active") >= F.col("max_active_jobs"))
    return over.select("user_id", "plan", "n_active", "max_active_jobs", F.lit(30).alias("retry_after"))


def public_ledger(entries: DataFrame, limit: int = 20) -> DataFrame:
    """Newest entries of each user, as they may be shown: without grant keys; the id breaks ties."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("made_at"), F.desc("request_id"))
    return entries.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit).select("user_id", "place", "request_id", "type", "amount", "job_id", "made_at")


def decisions(deliveries: DataFrame, most: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """What becomes of each queue delivery (job_id, delivery_id, made_at, outcome), in order of time.

    `attempt` counts a job's deliveries. Until it is done, success acknowledges, a permanent error or the last
    attempt fails the job (`fail`: acknowledged and refunded, `dead` where only attempts ran out), anything else
    is tried again after a delay that doubles. Later deliveries of a done job are acknowledged.
    """
    w = Window.partitionBy("job_id").orderBy("made_at", "delivery_id")
    d = deliveries.withColumn("attempt", F.row_number().over(w))
    ends = (F.col("outcome") != "transient") | (F.col("attempt") >= most)
    d = d.withColumn("_done", F.coalesce(F.max(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    action = F.when(F.col("_done") | (F.col("outcome") == "success"), "ack").when(ends, "fail").otherwise("retry")
    d = d.withColumn("action", action).withColumn("delay_seconds", F.when(F.col("action") == "retry", rules.retry_seconds(F.col("attempt"))))
    return d.withColumn("dead", (F.col("action") == "fail") & (F.col("outcome") == "transient")).drop("_done")


def lease_claims(claims: DataFrame, lease_seconds: int = rules.LEASE_SECONDS) -> DataFrame:
    """(job_id, delivery_id, decision, wait): claims of jobs (job_id, delivery_id, made_at) in order of time.

    A job without a lease, or whose lease is over, is claimed (`claim`, `takeover`) for a lease from then on; while
    it is held a delivery is told to come back (`held`) when it ends, and doesn't lengthen it. Each decision rests on
    the one before, so a job's claims are read in order with its lease carried along; none are gathered.
    """

    def run(batches):
        job, until = None, None
        for b in batches:
            out, waits = [], []
            for j, at in zip(b.column("job_id").to_pylist(), b.column("at").to_pylist(), strict=True):
                if j != job:
                    job, until = j, None
                held = until is not None and until > at
                out.append("held" if held else "claim" if until is None else "takeover")
                waits.append(min(-(-(until - at) // 1_000_000) + 5, 900) if held else None)
                if not held:
                    until = at + lease_seconds * 1_000_000
            yield pa.RecordBatch.from_arrays([b.column("job_id"), b.column("delivery_id"), pa.array(out, pa.string()), pa.array(waits, pa.int64())], ["job_id", "delivery_id", "decision", "wait"])

    at = claims.select(F.col("job_id").cast("long").alias("job_id"), F.col("delivery_id").cast("long").alias("delivery_id"), F.unix_micros(F.col("made_at").cast("timestamp")).alias("at")).where("job_id is not null and at is not null")
    return at.repartition("job_id").sortWithinPartitions("job_id", "at", "delivery_id").mapInArrow(run, "job_id long, delivery_id long, decision string, wait long")
