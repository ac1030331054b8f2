"""Fixed rules of the conversion service as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Plan, monthly credits, largest file, uploads in 10 minutes, uploads in a day, stored bytes, active jobs.
PLAN_LIMITS = [
    ("free", 10, 5 << 20, 20, 100, 250 << 20, 2),
    ("starter", 100, 15 << 20, 60, 600, 2 << 30, 4),
    ("pro", 500, 15 << 20, 60, 1000, 10 << 30, 6),
    ("business", 5000, 15 << 20, 120, 3000, 50 << 30, 10),
]
#: Mime type, extensions.
UPLOAD_TYPES = {"image/png": ["png"], "image/jpeg": ["jpg", "jpeg"], "image/webp": ["webp"]}
#: Error class, public code, HTTP status.
ERRORS = [("validation", "VALIDATION_ERROR", 400), ("unauthorized", "UNAUTHORIZED", 401), ("forbidden", "FORBIDDEN", 403), ("not_found", "NOT_FOUND", 404), ("conflict", "CONFLICT", 409), ("credits", "INSUFFICIENT_CREDITS", 402), ("rate", "RATE_LIMITED", 429), ("quota", "QUOTA_EXCEEDED", 413)]
MAX_ATTEMPTS = 3
SHARDS, SLOT_SECONDS = 32, 900


def plan_limits(spark: SparkSession) -> DataFrame:
    """Four rows: small enough to broadcast by construction."""
    return spark.createDataFrame(PLAN_LIMITS, "plan string, monthly_credits int, max_file_bytes long, per_ten_minutes int, per_day int, storage_quota_bytes long, max_active_jobs int")


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def upload_error(name: Column, mime: Column, size: Column, width: Column, height: Column, max_bytes: Column, shown: Column | None = None) -> Column:
    """The first rule that an upload breaks, in a fixed order, or null. `shown` is the type that its first bytes show, if
    they are known: it must be the one that was told."""
    allowed = F.create_map(*[x for m, e in UPLOAD_TYPES.items() for x in (F.lit(m), F.array(*map(F.lit, e)))])
    fits = F.array_contains(F.coalesce(F.try_element_at(allowed, mime), F.array().cast("array<string>")), extension(name))
    return (
        F.when(F.length(F.trim(name)) == 0, "name")
        .when(~mime.isin(*UPLOAD_TYPES), "mime")
        .when(~fits, "extension")
        .when(size <= 0, "empty")
        .when(size > max_bytes, "too_large")
        .when(F.lit(False) if shown is None else ~F.coalesce(shown == mime, F.lit(False)), "magic")
        .when((width > 12000) | (height > 12000) | (width * height > 4000000), "dimensions")
        .when((mime != "image/png") & (size > (2 << 20) + 3 * width * height), "padding")
    )


def credit_cost(professional: Column, formats: Column, print_ready: Column) -> Column:
    """One credit, one for each format after the first, two for print quality; twice that in professional mode."""
    base = F.lit(1) + F.greatest(formats - 1, F.lit(0)) + F.when(print_ready, 2).otherwise(0)
    return (base * F.when(professional, 2).otherwise(1)).cast("int")


def retry_seconds(attempt: Column) -> Column:
    return (F.lit(15) * F.pow(F.lit(2), attempt - 1)).cast("long")


def lease_wait(remaining: Column) -> Column:
    return F.least(remaining + 5, F.lit(900))


def shard_of_slot(ts: Column) -> Column:
    """Which of the key shards a sweep at this time covers."""
    return F.pmod(F.floor(F.unix_seconds(ts.cast("timestamp")) / SLOT_SECONDS), F.lit(SHARDS)).cast("int")


#: Seconds that an orphaned object is left alone, and that a claimed job belongs to its worker.
GRACE_SECONDS, LEASE_SECONDS = 86400, 300


def shard_prefix(shard: Column) -> Column:
    """Keys that a shard covers: uploads, then conversions, by the first hex digit of the owner; any whole number is a shard."""
    at = F.pmod(shard, F.lit(SHARDS))
    kind = F.when(at < SHARDS // 2, "uploads/").otherwise("conversions/")
    return F.concat(kind, F.substr(F.lit("0123456789abcdef"), F.pmod(at, F.lit(SHARDS // 2)).cast("int") + 1, F.lit(1)))


def page_limit(asked: Column, default: int = 20, most: int = 100, whole: bool = True) -> Column:
    """Rows of a page from an argument's text: the default where it isn't a positive (whole) number."""
    n = asked.try_cast("double")
    good = (n > 0) & ~F.isnan(n) & (F.abs(n) < float("inf")) & ((n == F.floor(n)) if whole else F.lit(True))
    return F.when(good, F.least(n, F.lit(float(most)))).otherwise(float(default))


def page_offset(asked: Column, whole: bool = True) -> Column:
    n = asked.try_cast("double")
    good = (n >= 0) & ~F.isnan(n) & (F.abs(n) < float("inf")) & ((n == F.floor(n)) if whole else F.lit(True))
    return F.when(good, n).otherwise(0.0)


def is_settings(text: Column) -> Column:
    """Whether a JSON text is an object whose values are all numbers."""
    bag = F.from_json(text, "map<string,variant>")
    number = lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.lit(False))
    return F.coalesce(F.ltrim(text).startswith("{") & F.forall(F.map_values(bag), number), F.lit(False))


def error_code(kind: Column) -> Column:
    out = F.lit("INTERNAL_ERROR")
    for name, code, _ in ERRORS:
        out = F.when(kind == name, code).otherwise(out)
    return out


def error_status(kind: Column) -> Column:
    out = F.lit(500)
    for name, _, status in ERRORS:
        out = F.when(kind == name, status).otherwise(out)
    return out


def is_permanent(message: Column, attempt: Column) -> Column:
    """Whether a failed job is given up: a cause that a retry can't mend, or the last attempt."""
    return message.rlike("^Failed to decode |^Unsupported |out of memory") | (attempt >= MAX_ATTEMPTS)
