"""The registered queries and, where SQL can express them, the same in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, rules, signing
from ..operators import benchmarks, images, ledger, markup, palette, raster, regions, service
from ..sources import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_JOBS = "(select o_orderkey as job_id, o_custkey as user_id, o_custkey as upload_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'processing' end as status, o_orderdate as created_at from orders)"
_RESULTS = f"(select l_orderkey as job_id, case when l_suppkey % 7 = 0 then j.user_id + 1 else j.user_id end as user_id, l_linenumber as line, cast(floor(l_extendedprice) as bigint) as file_size_bytes, l_shipdate as created_at from lineitem join {_JOBS} j on l_orderkey = j.job_id)"
_PROFILES = "(select c_custkey as user_id, c_name as display_name, case c_mktsegment when 'BUILDING' then 'starter' when 'AUTOMOBILE' then 'pro' when 'MACHINERY' then 'business' else 'free' end as plan from customer)"
_UPLOADS = "(select event_id as upload_id, user_id, ts as created_at, cast(floor(abs(value) * 1000) as bigint) as size_bytes from events)"
_LEDGER = """(select event_id as request_id, user_id, ts as made_at, case event_type when 'purchase' then 'credit' when 'click' then 'debit' else 'refund' end as type, cast(floor(abs(value)) as bigint) % 20 + 1 as amount,
  case when event_type <> 'purchase' then event_id % 997 end as job_id, case when event_type = 'purchase' and event_id % 5 = 0 then 'promo-' || (event_id % 3) end as grant_key from events where event_type in ('purchase', 'click', 'error'))"""
_DEDUPED = f"""(select * exclude (r) from (select *, row_number() over (partition by user_id, case when grant_key is not null then 'g:' || grant_key when type <> 'credit' and job_id is not null then type || ':' || job_id else 'r:' || request_id end order by made_at, request_id) as r from {_LEDGER}) where r = 1)"""


def _level(k: int) -> str:
    return f"cast(least(4, greatest(0, floor((e[(i + {k}) % len(e) + 1]::double + 0.25::double) * 10))) * 60 as int)"


_PIXELS = f"""(select image_id, i % 8 as x, cast(floor(i / 8) as int) as y, {_level(0)} as r, {_level(8)} as g, {_level(16)} as b, case when e[i + 1] < -0.2::double then 0 else 255 end as a
  from (select vec_id as image_id, embedding as e, unnest(range(0, len(embedding)))::int as i from embeddings))"""

def _linear(c: str) -> str:
    return f"(case when {c} / 255.0::double <= 0.04045::double then {c} / 255.0::double / 12.92::double else pow(({c} / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) end)"


def _dot(w, xs) -> str:
    return "(" + " + ".join(f"({a!r})::double * {x}" for a, x in zip(w, xs, strict=True)) + ")"


def _lab(pixels: str) -> str:
    roots = [f"cbrt({_dot(w, ['rl', 'gl', 'bl'])}) as c{i}" for i, w in enumerate(color.TO_LMS)]
    lab = [f"{_dot(w, ['c0', 'c1', 'c2'])} as {n}" for w, n in zip(color.TO_LAB, "lmn", strict=True)]
    light = f"select *, {_linear('r')} as rl, {_linear('g')} as gl, {_linear('b')} as bl from {pixels}"
    return f"(select * exclude (c0, c1, c2, rl, gl, bl), {', '.join(lab)} from (select *, {', '.join(roots)} from ({light})))"


_LUMA = "(0.299::double * r + 0.587::double * g + 0.114::double * b)"
_QUANT = "(cast(floor(r / 8.0::double + 0.5) as bigint) * 65536 + cast(floor(g / 8.0::double + 0.5) as bigint) * 256 + cast(floor(b / 8.0::double + 0.5) as bigint))"


def _text(c):  # timestamps leave as text, alike in both engines
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# ---------------------------------------------------------------- jobs, uploads, results, objects


@query(f"select job_id, user_id, status, {_stamp('created_at')} as created_at, place, total, total > 20 as has_more from (select *, row_number() over (partition by user_id order by created_at desc, job_id desc) as place, count(*) over (partition by user_id) as total from {_JOBS}) where place <= 20")
def jobs_page(spark, sf_dir):
    """First page of each user's jobs."""
    return service.job_pages(roles.jobs(spark, sf_dir)).select("job_id", "user_id", "status", _text("created_at").alias("created_at"), "place", "total", "has_more")


@query(f"""select p.job_id, p.user_id, place, coalesce(lines, '') as lines, coalesce(n, 0) as n_results from (select * from (select *, row_number() over (partition by user_id order by created_at desc, job_id desc) as place from {_JOBS}) where place <= 20) p
left join (select job_id, user_id, string_agg(line::varchar, ',' order by line) as lines, count(*) as n from {_RESULTS} group by job_id, user_id) c on p.job_id = c.job_id and p.user_id = c.user_id""")
def history_with_results(spark, sf_dir):
    """A page of jobs and the results of the same user; jobs without results stay."""
    h = service.history(roles.jobs(spark, sf_dir), roles.conversions(spark, sf_dir))
    return h.select("job_id", "user_id", "place", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), F.size("lines").cast("long").alias("n_results"))


@query("select 'objects/' || doc_id as key, 'no row' as why from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id) union all select 'rows/' || doc_id, 'no object' from labels where not exists (select 1 from documents where labels.doc_id = documents.doc_id)")
def orphan_objects(spark, sf_dir):
    """Objects (documents) without a row (label), and rows without an object."""
    objects, rows = roles.table(spark, sf_dir, "documents").select("doc_id"), roles.table(spark, sf_dir, "labels").select("doc_id")
    lost = service.without_row(objects, rows, "doc_id").select(F.concat(F.lit("objects/"), F.col("doc_id").cast("string")).alias("key"), F.lit("no row").alias("why"))
    return lost.unionByName(service.without_row(rows, objects, "doc_id").select(F.concat(F.lit("rows/"), F.col("doc_id").cast("string")).alias("key"), F.lit("no object").alias("why")))


@query("select l_orderkey as job_id, l_linenumber as line, l_partkey as part from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F')")
def rows_missing_object(spark, sf_dir):
    """Results whose job isn't completed: the anti join in the other direction."""
    rows = roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    return service.without_row(rows, roles.jobs(spark, sf_dir).where("status = 'completed'"), "job_id")


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def existing_keys(spark, sf_dir):
    return service.with_row(roles.table(spark, sf_dir, "documents").select("doc_id"), roles.table(spark, sf_dir, "labels"), "doc_id")


@query(f"""with j as (select * replace (upload_id * 100 + month(created_at) as upload_id) from {_JOBS}), u as (select upload_id, max(created_at) as newest, min(created_at) as oldest, count(*) as n_jobs from j group by upload_id),
f as (select * from u where newest < timestamp '2100-01-01' and upload_id not in (select upload_id from j where status in ('queued', 'processing')) order by oldest, upload_id limit 50)
select f.upload_id, n_jobs, coalesce((select count(*) from {_RESULTS} r join j on r.job_id = j.job_id where j.upload_id = f.upload_id), 0) as n_results from f""")
def retention_candidates(spark, sf_dir):
    """The oldest 50 uploads whose jobs are all finished; an upload is a customer's of one month of the year."""
    jobs = roles.jobs(spark, sf_dir).withColumn("upload_id", F.col("upload_id") * 100 + F.month("created_at"))
    return service.retention_candidates(jobs, roles.conversions(spark, sf_dir), F.lit("2100-01-01").cast("timestamp_ntz"))


@query(f"select p.user_id, cast(coalesce(sum(file_size_bytes), 0) as bigint) as stored_bytes from {_PROFILES} p left join {_RESULTS} r on p.user_id = r.user_id group by p.user_id")
def stored_bytes_by_user(spark, sf_dir):
    return service.stored_bytes(roles.profiles(spark, sf_dir), roles.conversions(spark, sf_dir))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_violations(spark, sf_dir):
    return service.violations(roles.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_COUNTS = "count(*) over (partition by user_id order by created_at range between interval {} preceding and current row) as {}"


@query(f"select upload_id, user_id, {_COUNTS.format('10 minutes', 'n_ten_minutes')}, {_COUNTS.format('24 hours', 'n_day')} from {_UPLOADS}")
def rolling_upload_counts(spark, sf_dir):
    return service.rolling_counts(roles.uploads(spark, sf_dir), n_ten_minutes=600, n_day=86400).select("upload_id", "user_id", "n_ten_minutes", "n_day")


#: Limits low enough to be broken by the given events: plan, in ten minutes, in a day, stored bytes.
LOW_LIMITS = [("free", 1, 4, 1 << 21), ("starter", 2, 6, 1 << 22), ("pro", 2, 7, 1 << 23), ("business", 3, 8, 1 << 24)]


@query(f"""with c as (select upload_id, user_id, {_COUNTS.format('10 minutes', 'n_ten_minutes')}, {_COUNTS.format('24 hours', 'n_day')}, cast(sum(size_bytes) over (partition by user_id order by created_at, upload_id rows unbounded preceding) as bigint) as stored from {_UPLOADS}),
l(plan, per_ten_minutes, per_day, quota) as (values {', '.join(map(str, LOW_LIMITS))}),
b as (select c.*, l.plan, case when n_ten_minutes > per_ten_minutes then 'ten_minutes' when n_day > per_day then 'day' when stored > quota then 'quota' end as rule from c left join {_PROFILES} p on c.user_id = p.user_id join l on l.plan = coalesce(p.plan, 'free'))
select upload_id, user_id, plan, rule, case rule when 'ten_minutes' then 600 when 'day' then 3600 end as retry_after, n_ten_minutes, n_day, stored from b where rule is not null""")
def usage_limit_breaches(spark, sf_dir):
    """Rolling counts and stored bytes against the plan of each user: the flagship query."""
    limits = spark.createDataFrame(LOW_LIMITS, "plan string, per_ten_minutes int, per_day int, storage_quota_bytes long")
    return service.usage_breaches(roles.uploads(spark, sf_dir), roles.profiles(spark, sf_dir), limits)


@query(f"select job_id, status, cast(epoch(timestamp '{roles.NOW}') - epoch(created_at) as bigint) as age_seconds from {_JOBS} where status in ('queued', 'processing') and epoch(timestamp '{roles.NOW}') - epoch(created_at) > case status when 'processing' then 1200 else 3600 end")
def stale_jobs(spark, sf_dir):
    return service.stale_jobs(roles.jobs(spark, sf_dir), F.lit(roles.NOW)).select("job_id", "status", "age_seconds")


@query(f"select job_id, upload_id, row_number() over w as rank, first_value(job_id) over w as winner from {_JOBS} where status in ('queued', 'processing') window w as (partition by upload_id order by created_at, job_id)")
def one_active_per_upload(spark, sf_dir):
    return service.one_active(roles.jobs(spark, sf_dir)).select("job_id", "upload_id", "rank", "winner")


@query(f"select job_id, line, file_size_bytes, user_id from (select *, row_number() over (partition by job_id order by created_at desc, line desc, file_size_bytes desc, user_id desc) as r from {_RESULTS}) where r = 1")
def latest_result_per_job(spark, sf_dir):
    return service.latest_result(roles.conversions(spark, sf_dir))


@query(f"select r_name as role, plan, plan <> 'free' or r_name = 'ASIA' as allowed from region cross join (select distinct plan from {_PROFILES}) where r_name <> 'EUROPE'")
def privilege_matrix(spark, sf_dir):
    """Every role with every plan: a product of two small sets of distinct values."""
    names = roles.table(spark, sf_dir, "region").select(F.col("r_name").alias("role")).where("role <> 'EUROPE'")
    plans = roles.profiles(spark, sf_dir).select("plan").distinct()
    return names.crossJoin(plans).withColumn("allowed", (F.col("plan") != "free") | (F.col("role") == "ASIA"))


@query("select event_id, nullif(json_extract_string(props, '$.k'), '') as k, coalesce(nullif(json_extract_string(props, '$.name'), ''), 'user ' || user_id) as name from events")
def json_props(spark, sf_dir):
    """A field of a JSON text, and another with a default where it is missing or empty."""
    e = roles.table(spark, sf_dir, "events")
    name = F.coalesce(F.nullif(F.get_json_object("props", "$.name"), F.lit("")), F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return e.select("event_id", F.nullif(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), name.alias("name"))


@query("""with u as (select doc_id, case doc_id % 5 when 0 then '' when 1 then 'scan.PNG' when 2 then 'photo.jpeg' when 3 then 'a.b.webp' else 'note.txt' end as name, case doc_id % 7 when 0 then 'image/png' when 1 then 'text/plain' when 2 then 'image/webp' else case doc_id % 5 when 1 then 'image/png' when 2 then 'image/jpeg' else 'image/webp' end end as mime,
 n_chars * 1000 as size, n_chars % 13000 as w, doc_id % 5000 as h from documents), e as (select *, lower(regexp_extract(name, '\\.([^.]*)$', 1)) as ext from u)
select doc_id, case when length(trim(name)) = 0 then 'name' when mime not in ('image/png', 'image/jpeg', 'image/webp') then 'mime' when not ((mime = 'image/png' and ext = 'png') or (mime = 'image/jpeg' and ext in ('jpg', 'jpeg')) or (mime = 'image/webp' and ext = 'webp')) then 'extension'
 when size <= 0 then 'empty' when size > 15728640 then 'too_large' when w > 12000 or h > 12000 or w * h > 4000000 then 'dimensions' when mime <> 'image/png' and size > 2097152 + 3 * w * h then 'padding' end as error from e""")
def validate_uploads(spark, sf_dir):
    """The first broken rule of uploads made up from documents: name and type by id, size by length."""
    d = roles.table(spark, sf_dir, "documents")
    five, seven = F.col("doc_id") % 5, F.col("doc_id") % 7
    name = F.when(five == 0, "").when(five == 1, "scan.PNG").when(five == 2, "photo.jpeg").when(five == 3, "a.b.webp").otherwise("note.txt")
    mime = F.when(seven == 0, "image/png").when(seven == 1, "text/plain").when(seven == 2, "image/webp").when(five == 1, "image/png").when(five == 2, "image/jpeg").otherwise("image/webp")
    return d.select("doc_id", rules.upload_error(name, mime, F.col("n_chars") * 1000, F.col("n_chars") % 13000, F.col("doc_id") % 5000, F.lit(15 << 20)).alias("error"))


@query("""select l_orderkey as job_id, l_linenumber as line, cast(15 * pow(2, l_linenumber - 1) as bigint) as retry_seconds, least(cast(l_quantity as int) * 30 + 5, 900) as lease_wait, cast(floor(epoch(l_shipdate) / 900) as bigint) % 32 as shard,
 l_linenumber >= 3 as permanent from lineitem""")
def backoff_schedule(spark, sf_dir):
    """Waits of failed attempts (the line number) and the shard that a sweep at the time covers."""
    attempt = F.col("l_linenumber")
    return roles.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), attempt.alias("line"), rules.retry_seconds(attempt).alias("retry_seconds"), rules.lease_wait(F.col("l_quantity").cast("int") * 30).alias("lease_wait"),
        rules.shard_of_slot(F.col("l_shipdate")).cast("long").alias("shard"), rules.is_permanent(F.lit("timed out"), attempt).alias("permanent"),
    )


_KINDS = [k for k, _, _ in rules.ERRORS] + ["other"]


@query(f"with k as (select event_id, (array{_KINDS})[event_id % {len(_KINDS)} + 1] as kind from events) select event_id, kind, case kind " + " ".join(f"when '{k}' then '{c}'" for k, c, _ in rules.ERRORS) + " else 'INTERNAL_ERROR' end as code, case kind " + " ".join(f"when '{k}' then {s}" for k, _, s in rules.ERRORS) + " else 500 end as status from k")
def error_codes(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS) + 1).cast("int"))
    return roles.table(spark, sf_dir, "events").select("event_id", kind.alias("kind")).select("event_id", "kind", rules.error_code(F.col("kind")).alias("code"), rules.error_status(F.col("kind")).alias("status"))


@query("select o_orderkey as job_id, cast((1 + greatest(cast(floor(o_totalprice) as bigint) % 5 - 1, 0) + case when o_orderkey % 3 = 0 then 2 else 0 end) * case when o_orderstatus = 'F' then 2 else 1 end as int) as credits from orders")
def credit_cost(spark, sf_dir):
    o = roles.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), rules.credit_cost(F.col("o_orderstatus") == "F", F.floor("o_totalprice").cast("long") % 5, F.col("o_orderkey") % 3 == 0).alias("credits"))


# ---------------------------------------------------------------- ledger


@query(f"select user_id, cast(sum(case type when 'debit' then -amount else amount end) as bigint) as balance, count(*) as n_entries from {_DEDUPED} group by user_id")
def ledger_balances(spark, sf_dir):
    return ledger.balances(ledger.dedupe(roles.ledger_requests(spark, sf_dir)))


@query(f"select request_id, user_id, type, amount, job_id, grant_key from {_DEDUPED}")
def ledger_dedupe(spark, sf_dir):
    return ledger.dedupe(roles.ledger_requests(spark, sf_dir)).select("request_id", "user_id", "type", "amount", "job_id", "grant_key")


@query(f"""with recursive s as (select user_id, row_number() over (partition by user_id order by made_at, request_id) as k, case type when 'debit' then -amount else amount end as d from {_DEDUPED}),
f as (select user_id, 0::bigint as k, 0::bigint as balance, 0::bigint as accepted, 0::bigint as rejected from (select distinct user_id from s)
union all select f.user_id, s.k, case when balance + d >= 0 then balance + d else balance end, accepted + (balance + d >= 0)::int, rejected + (balance + d < 0)::int from f join s on f.user_id = s.user_id and s.k = f.k + 1)
select user_id, arg_max(balance, k) as balance, max(accepted) as accepted, max(rejected) as rejected from f group by user_id""")
def ledger_overdraft_fold(spark, sf_dir):
    return ledger.fold(ledger.dedupe(roles.ledger_requests(spark, sf_dir)))


@query(f"select d.user_id, d.job_id, d.request_id, d.amount from {_DEDUPED} d where type = 'debit' and (select min(made_at) from {_DEDUPED} r where r.type = 'refund' and r.user_id = d.user_id and r.job_id = d.job_id) > d.made_at")
def refund_eligible(spark, sf_dir):
    return ledger.refundable(ledger.dedupe(roles.ledger_requests(spark, sf_dir)))


@query(f"""with n as (select c_custkey as user_id, 10 as amount, 'signup' as grant_key from customer), h as (select distinct user_id from {_LEDGER} where grant_key is not null)
select user_id, amount, grant_key from n where user_id not in (select user_id from h)""")
def grant_backfill(spark, sf_dir):
    """Signup grants of users that have no keyed grant yet: insert, and do nothing on a conflict."""
    new = roles.profiles(spark, sf_dir).select("user_id", F.lit(10).alias("amount"), F.lit("signup").alias("grant_key"))
    return service.without_row(new, roles.ledger_requests(spark, sf_dir).where("grant_key is not null"), "user_id")


@query("""with c as (select o_orderkey as job_id, o_orderkey % 3 as version, 'x' as status from orders where o_orderkey % 4 = 0)
select o.o_orderkey as job_id, case when c.job_id is not null then 'x' else o_orderstatus end as status, case when c.job_id is not null then 2 else 1 end as version from orders o left join c on c.job_id = o.o_orderkey and c.version = 1""")
def versioned_update(spark, sf_dir):
    """Optimistic locking: of the changes to every fourth job, those that saw version 1 apply."""
    o = roles.table(spark, sf_dir, "orders")
    table = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    changes = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("x").alias("status"), (F.col("o_orderkey") % 3).cast("int").alias("version"))
    return service.update_versioned(table, changes, "job_id", ["status"])[0]


# ---------------------------------------------------------------- images (8 x 8 pixels, from embeddings)

_SIGNED = f"select *, {_LUMA} - lag({_LUMA}) over (partition by image_id, y order by x) as d from {_PIXELS}"
_STATS = f"""(select image_id, count(*) as n, count(distinct {_QUANT}) as colours, count(*) filter (a < 250) as transparent, count(*) filter (greatest(r, g, b) - least(r, g, b) <= 10) as gray, count(d) as compared, count(*) filter (abs(d) > 24) as edges,
 count(*) filter (abs(d) >= 4 and abs(d) <= 24 and sign(d) * before < 0) as noisy from (select *, last_value(case when d <> 0 then sign(d) end ignore nulls) over (partition by image_id, y order by x rows between unbounded preceding and 1 preceding) as before from ({_SIGNED})) group by image_id)"""


@query(f"select * from {_STATS}")
def img_analysis(spark, sf_dir):
    return images.analyse(roles.pixels(spark, sf_dir))


@query(f"""with s as (select *, transparent / n::double >= 0.01 as has_alpha, coalesce(edges / nullif(compared, 0)::double, 0) as edge_share from {_STATS}), c as (select *, least(1, 0.5 * least(1, colours / 64.0::double) + 0.5 * least(1, edge_share * 4)) as complexity from s)
select image_id, round(complexity, 6) as complexity, case when complexity >= 0.6 then 'photo' when colours > 32 then 'illustration' when colours <= 16 and has_alpha then 'sticker' when colours <= 6 and complexity < 0.2 then 'icon' else 'logo' end as kind from c""")
def img_preset(spark, sf_dir):
    return images.recommend(images.analyse(roles.pixels(spark, sf_dir))).select("image_id", F.round("complexity", 6).alias("complexity"), "kind")


_DOMINANT = f"(select * exclude (seen) from (select *, row_number() over (partition by image_id order by n desc, seen) as place from (select image_id, {_QUANT} as colour, count(*) as n, min(y * 65536 + x) as seen from {_PIXELS} group by all)) where place <= 5)"


@query(f"select * from {_DOMINANT}")
def img_dominant_colors(spark, sf_dir):
    return images.dominant(roles.pixels(spark, sf_dir))


def _leads(f: str) -> str:
    return ", ".join(f"{f}({c}) over (partition by image_id, {p} order by {o}) as {c}_{o}" for c in "rgb" for p, o in (("y", "x"), ("x", "y")))


@query(f"select image_id, count(*) as n, count(*) filter ({' and '.join(f'abs({c} - {c}_{o}) <= 60' for c in 'rgb' for o in 'xy')}) as n_flat from (select *, {_leads('lead')} from {_PIXELS}) where r_x is not null and r_y is not null group by image_id")
def img_flat_fraction(spark, sf_dir):
    return images.flat_fraction(roles.pixels(spark, sf_dir), levels=60)


_AROUND = " + ".join(f"{f}(l) over (partition by image_id, {p} order by {o})" for p, o, f in (("y", "x", "lag"), ("y", "x", "lead"), ("x", "y", "lag"), ("x", "y", "lead")))


@query(f"""with v as (select image_id, abs(4 * l - ({_AROUND})) as v from (select *, {_LUMA} as l from {_PIXELS})), k as (select *, row_number() over (partition by image_id order by v) as k, count(*) over (partition by image_id) as m from v where v is not null)
select image_id, round(v * 1.4826::double / sqrt(20.0), 6) as sigma from k where k = floor(m / 2) + 1""")
def img_noise_sigma(spark, sf_dir):
    return images.noise_sigma(roles.pixels(spark, sf_dir))


_HALVED = f"(select image_id, cast(floor(x / 2) as int) as x, cast(floor(y / 2) as int) as y, {', '.join(f'cast(coalesce(floor(sum({c} * a) / nullif(sum(a), 0)::double + 0.5), 0) as int) as {c}' for c in 'rgb')}, cast(floor(avg(a) + 0.5) as int) as a from {_PIXELS} group by 1, 2, 3)"


@query(f"select * from {_HALVED}")
def img_box_downscale(spark, sf_dir):
    return images.box_downscale(roles.pixels(spark, sf_dir))


@query(f"select image_id, x, y, round(l, 6) as l, round(m, 6) as m, round(n, 6) as n from {_lab(_PIXELS)}")
def img_oklab(spark, sf_dir):
    return images.with_oklab(roles.pixels(spark, sf_dir)).select("image_id", "x", "y", *[F.round(c, 6).alias(c) for c in "lmn"])


_NEAR = " and ".join(f"coalesce({' + '.join(f'pow({c} - {f}({c}) over w{o}, 2)' for c in 'lmn')} <= 0.001225 and {f}(a) over w{o} >= 128, true)" for o in "xy" for f in ("lag", "lead"))


@query(f"select image_id, x, y, a >= 128 and {_NEAR} as flat from {_lab(_PIXELS)} window wx as (partition by image_id, y order by x), wy as (partition by image_id, x order by y)")
def img_flat_mask(spark, sf_dir):
    return images.flat_mask(roles.pixels(spark, sf_dir)).select("image_id", "x", "y", "flat")


@query(f"select image_id, {', '.join(f'cast(floor({c} / 0.008::double) as bigint) as bin_{c}' for c in 'lmn')}, count(*) as weight, {', '.join(f'cast(sum({c}) as bigint) as sum_{c}' for c in 'rgb')}, round(sum(l), 6) as sum_l, round(sum(l * l + m * m + n * n), 6) as sum_sq from {_lab(_PIXELS)} where a >= 128 group by 1, 2, 3, 4")
def palette_bins(spark, sf_dir):
    b = images.palette_bins(roles.pixels(spark, sf_dir))
    return b.select("image_id", "bin_l", "bin_m", "bin_n", "weight", "sum_r", "sum_g", "sum_b", F.round("sum_l", 6).alias("sum_l"), F.round("sum_sq", 6).alias("sum_sq"))


_BACK = f"(select image_id, place - 1 as label, n as weight, {', '.join(f'cast(least(255, (colour // {k}) % 256 * 8) as int) as {c}' for c, k in (('r', 65536), ('g', 256), ('b', 1)))} from {_DOMINANT})"
_PALETTE = f"(select * exclude (n), n as nn from (select image_id, label, weight, l, m, n from {_lab(_BACK)}))"


@query(f"""with p as {_PALETTE}, c as (select distinct image_id, r, g, b, l, m, n from {_lab(_PIXELS)}), d as (select c.image_id, r, g, b, label, row_number() over (partition by c.image_id, r, g, b order by round(pow(c.l - p.l, 2) + pow(c.m - p.m, 2) + pow(c.n - p.nn, 2), 9), label) as k from c join p on c.image_id = p.image_id)
select q.image_id, x, y, label from {_PIXELS} q join d on q.image_id = d.image_id and q.r = d.r and q.g = d.g and q.b = d.b where k = 1""")
def palette_nearest(spark, sf_dir):
    p = roles.pixels(spark, sf_dir)
    return images.nearest_colour(p, images.palette_of_dominant(p)).select("image_id", "x", "y", "label")


def _blend() -> str:
    ax = [("l", "l"), ("m", "m"), ("nn", "nn")]
    along = " + ".join(f"(c.{x} - p.{x}) * (q.{x} - p.{x})" for x, _ in ax)
    length = " + ".join(f"(q.{x} - p.{x}) * (q.{x} - p.{x})" for x, _ in ax)
    off = " + ".join(f"pow(c.{x} - p.{x} - t * (q.{x} - p.{x}), 2)" for x, _ in ax)
    cols = ", ".join(f"{k}.{x} as {k}{x}" for k in "cpq" for x, _ in ax)
    off = " + ".join(f"pow(c{x} - p{x} - t * (q{x} - p{x}), 2)" for x, _ in ax)
    return f"""with z as {_PALETTE}, t as (select c.image_id, c.label, {cols}, ({along}) / nullif({length}, 0) as t from z c join z p on c.image_id = p.image_id join z q on c.image_id = q.image_id
 where p.label < q.label and c.label <> p.label and c.label <> q.label and c.weight < p.weight and c.weight < q.weight) select distinct image_id, label from t where t > 0.08 and t < 0.92 and {off} < 0.0025"""


@query(_blend())
def palette_blend_filter(spark, sf_dir):
    return images.blend_colours(images.palette_of_dominant(roles.pixels(spark, sf_dir)), residual=0.05, lighter=1)


@query(f"select image_id, x, y, case when lower(hex(r)) is null then null else '#' || case when r % 17 = 0 and g % 17 = 0 and b % 17 = 0 then substr(h, 1, 1) || substr(h, 3, 1) || substr(h, 5, 1) else h end end as hex from (select *, {' || '.join(f'lpad(lower(hex({c})), 2, chr(48))' for c in 'rgb')} as h from {_PIXELS})")
def hex_colors(spark, sf_dir):
    return roles.pixels(spark, sf_dir).select("image_id", "x", "y", color.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


# ---------------------------------------------------------------- regions: labels are lightness levels of the red channel

_LABELS = f"(select image_id, x, y, r, cast(r / 60 as bigint) as region from {_PIXELS})"


def _labels(spark, sf_dir):
    return roles.pixels(spark, sf_dir).select("image_id", "x", "y", "r", (F.col("r") / 60).cast("long").alias("region"))


@query(f"""with recursive p as {_LABELS}, f as (select image_id, x, y, region, y * 8 + x as c from p union select f.image_id, p.x, p.y, p.region, f.c from f join p on f.image_id = p.image_id and f.region = p.region and abs(f.x - p.x) + abs(f.y - p.y) = 1),
m as (select image_id, x, y, region, min(c) as root from f group by all) select image_id, root, region, count(*) as area from m group by all""")
def region_components(spark, sf_dir):
    """Connected regions of equal label: a kernel on whole images, named by their first pixel."""
    c = regions.components(_labels(spark, sf_dir).withColumnRenamed("region", "label"))
    return c.groupBy("image_id", "root", F.col("label").alias("region")).agg(F.count("*").alias("area"))


_SIDES = f"(select image_id, region as p, lead(region) over (partition by image_id, y order by x) as q from {_LABELS} union all select image_id, region, lead(region) over (partition by image_id, x order by y) from {_LABELS})"
_PAIRS = f"(select image_id, least(p, q) as low, greatest(p, q) as high, count(*) as border from {_SIDES} where q is not null and p <> q group by 1, 2, 3)"


@query(f"select * from {_PAIRS}")
def region_adjacency(spark, sf_dir):
    return images.neighbour_pairs(_labels(spark, sf_dir))


@query(f"""with e as (select image_id, region, sum(border) as boundary from (select image_id, low as region, border from {_PAIRS} union all select image_id, high, border from {_PAIRS}) group by 1, 2)
select a.image_id, a.region, area, cast(coalesce(boundary, 0) as bigint) as boundary, round(area / nullif(boundary, 0)::double, 6) as thickness from (select image_id, region, count(*) as area from {_LABELS} group by 1, 2) a left join e on a.image_id = e.image_id and a.region = e.region""")
def region_thickness(spark, sf_dir):
    return images.region_sizes(_labels(spark, sf_dir)).withColumn("thickness", F.round("thickness", 6))


_CRACKS = f"""(with p as (select *, coalesce(lag(region) over (partition by image_id, y order by x), -1) as h, lead(region) over (partition by image_id, y order by x) is null as hl, coalesce(lag(region) over (partition by image_id, x order by y), -1) as v, lead(region) over (partition by image_id, x order by y) is null as vl from {_LABELS})
 select image_id, x as x1, y as y1, x as x2, y + 1 as y2 from p where region <> h union all select image_id, x + 1, y, x + 1, y + 1 from p where hl union all select image_id, x, y, x + 1, y from p where region <> v union all select image_id, x, y + 1, x + 1, y + 1 from p where vl)"""


@query(f"select * from {_CRACKS}")
def cracks(spark, sf_dir):
    return images.cracks(_labels(spark, sf_dir))


@query(f"select image_id, x, y, count(*) as degree from (select image_id, x1 as x, y1 as y from {_CRACKS} union all select image_id, x2, y2 from {_CRACKS}) group by 1, 2, 3 having count(*) >= 3")
def junctions(spark, sf_dir):
    return images.junctions(images.cracks(_labels(spark, sf_dir)))


_FIT_LABELS = f"(select image_id, x, y, g as value, cast(floor(r / 120) as bigint) as region from {_PIXELS})"
_FITS = f"""(with s as (select image_id, region, count(*) as n, {', '.join(f'sum({e})::double as {k}' for k, e in (('sx', 'x'), ('sy', 'y'), ('sxx', 'x * x'), ('sxy', 'x * y'), ('syy', 'y * y'), ('sv', 'value'), ('sxv', 'x * value'), ('syv', 'y * value'), ('svv', 'value * value')))} from {_FIT_LABELS} group by 1, 2),
 c as (select *, sxx - sx * sx / n as cxx, syy - sy * sy / n as cyy, sxy - sx * sy / n as cxy, sxv - sx * sv / n as cxv, syv - sy * sv / n as cyv, svv - sv * sv / n as cvv from s), d as (select *, cxx * cyy - cxy * cxy as det from c),
 e as (select *, case when det > 1e-9 then (cxv * cyy - cyv * cxy) / det else 0 end as slope_x, case when det > 1e-9 then (cyv * cxx - cxv * cxy) / det else 0 end as slope_y from d)
 select image_id, region, n, slope_x, slope_y, cvv as flat_error, greatest(0, cvv - case when det > 1e-9 then slope_x * cxv + slope_y * cyv else 0 end) as fit_error from e)"""


def _fit_labels(spark, sf_dir):
    return roles.pixels(spark, sf_dir).select("image_id", "x", "y", F.col("g").alias("value"), F.floor(F.col("r") / 120).cast("long").alias("region"))


_ROUND4 = ", ".join(f"round({c}, 4) + 0 as {c}" for c in ("slope_x", "slope_y", "flat_error", "fit_error"))


def _rounded(df: DataFrame) -> list:
    return [(F.round(c, 4) + 0).alias(c) for c in ("slope_x", "slope_y", "flat_error", "fit_error")]


@query(f"select image_id, region, n, {_ROUND4} from {_FITS}")
def region_linear_fit(spark, sf_dir):
    f = images.linear_fits(_fit_labels(spark, sf_dir), value="value")
    return f.select("image_id", "region", "n", *_rounded(f))


@query(f"select image_id, region, n from {_FITS} where n >= 4 and flat_error > 1 and fit_error < 0.5 * flat_error - 0.001")
def gradient_validation(spark, sf_dir):
    """Regions where a plane halves the error of a flat fill at least: the only ones that keep a gradient."""
    return images.linear_fits(_fit_labels(spark, sf_dir), value="value").where("n >= 4 and flat_error > 1 and fit_error < 0.5D * flat_error - 0.001D").select("image_id", "region", "n")


@query(f"""with t as {_lab(_PIXELS)}, h as {_lab(_HALVED)}, b as (select t.image_id, sqrt(pow(t.l - h.l, 2) + pow(t.m - h.m, 2) + pow(t.n - h.n, 2)) as d, abs(t.a - h.a) as da from t join h on t.image_id = h.image_id and t.x // 2 = h.x and t.y // 2 = h.y)
select image_id, count(*) as n, round(avg(d), 6) as mean_delta, count(*) filter (d > 0.1) as n_bad, round(avg(da), 6) as alpha_error from b group by image_id""")
def image_diff_metrics(spark, sf_dir):
    """Each image against its own half-size version blown up again."""
    p = roles.pixels(spark, sf_dir)
    half = images.box_downscale(p)
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))
    grown = half.withColumn("o", offsets).select("image_id", (F.col("x") * 2 + F.col("o.dx")).alias("x"), (F.col("y") * 2 + F.col("o.dy")).alias("y"), "r", "g", "b", "a")
    m = images.diff_metrics(p, grown)
    return m.select("image_id", "n", F.round("mean_delta", 6).alias("mean_delta"), "n_bad", F.round("alpha_error", 6).alias("alpha_error"))


@query("""with p as (select vec_id, label, unnest(embedding)::double as v, unnest(range(0, len(embedding))) as i from embeddings), c as (select label, i, avg(v) as c from p group by 1, 2),
d as (select p.vec_id, c.label, sum((v - c) * (v - c)) as d from p join c on p.i = c.i group by 1, 2) select vec_id, arg_min(label, (round(d, 9), label)) as label, round(min(d), 5) as distance from d group by 1""")
def embedding_nearest_centroid(spark, sf_dir):
    """Each vector with the closest of the label means: an argmin over a small set of centroids."""
    return regions.nearest_centroid(roles.table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- markup and benchmark rows


@query(r"""with c as (select page_id, len(regexp_extract_all(html, '<p[ >]')) as n_paths, len(regexp_extract_all(html, '<[a-zA-Z]')) as n_nodes, strlen(html) as bytes, len(regexp_extract_all(html, '<li>')) as n_curves from pages)
select page_id, n_paths, n_nodes, bytes, round(n_curves / nullif(n_nodes, 0)::double, 6) as curve_ratio, concat_ws(',', case when n_paths > 50 then 'too-many-paths' end, case when n_nodes < 4 then 'missing-details' end, case when n_curves / nullif(n_nodes, 0)::double < 0.15 then 'jagged' end, case when n_paths > 50 and bytes / n_paths < 40 then 'noisy' end, case when bytes > 20000 then 'oversized' end) as flags from c""")
def page_markup_structure(spark, sf_dir):
    """Counts of elements and problem flags: pages stand in for SVG files, paragraphs for paths, list items for curves."""
    return markup.structure(roles.table(spark, sf_dir, "pages"))


_ROWS = """(select l_returnflag || l_linestatus as engine, p_brand as category, l_orderkey as case_id, l_linenumber as variant, l_tax as mean_delta_e, l_discount as boundary_error, cast(l_quantity as bigint) as segments, cast(floor(l_extendedprice) as bigint) as bytes, l_quantity > 48 as failed from lineitem join part on l_partkey = p_partkey)"""


@query(f"""select engine, count(*) as n, count(*) filter (failed) as n_failed, round(avg(mean_delta_e) filter (not failed), 6) as mean_delta_e, round(avg(boundary_error) filter (not failed), 6) as boundary_error, cast(sum(segments) filter (not failed) as bigint) as segments, max(bytes) as max_bytes from {_ROWS} group by engine""")
def engine_summary(spark, sf_dir):
    return benchmarks.summary(benchmarks.rows(spark, sf_dir), "engine")


@query(f"""select category, engine, count(*) as n, count(*) filter (failed) as n_failed, round(avg(mean_delta_e) filter (not failed), 6) as mean_delta_e, round(avg(boundary_error) filter (not failed), 6) as boundary_error, cast(sum(segments) filter (not failed) as bigint) as segments, max(bytes) as max_bytes from {_ROWS} group by category, engine""")
def category_summary(spark, sf_dir):
    return benchmarks.summary(benchmarks.rows(spark, sf_dir), "category", "engine")


@query(f"""with g as (select case_id, variant, engine, avg(mean_delta_e) as mean_delta_e, avg(boundary_error) as boundary_error, sum(segments)::double as segments, sum(bytes)::double as bytes from {_ROWS} group by 1, 2, 3), b as (select case_id + 1 as case_id, variant, engine, mean_delta_e as b_delta, boundary_error as b_edge, segments as b_segments, bytes as b_bytes from g)
select g.case_id, g.variant, g.engine, case when b_delta is null then 'new' when round(mean_delta_e - b_delta, 6) > 0.02 or round(boundary_error - b_edge, 6) > 0.02 or segments > b_segments * 1.15 or bytes > b_bytes * 1.3 then 'WORSE' when round(mean_delta_e - b_delta, 6) < -0.01 or round(boundary_error - b_edge, 6) < -0.01 or segments < b_segments * 0.9 then 'better' else 'unchanged' end as verdict from g left join b on g.case_id = b.case_id and g.variant = b.variant and g.engine = b.engine""")
def baseline_compare(spark, sf_dir):
    """Rows against a baseline (the row of the case before), with a verdict."""
    return benchmarks.verdicts(*benchmarks.with_baseline(spark, sf_dir))


@query("""with p as (select user_id, value as px, epoch(ts) / 86400.0 as py, row_number() over (partition by user_id order by ts, event_id) as k from events), q as (select *, coalesce(lead(px) over w, first_value(px) over w) as nx, coalesce(lead(py) over w, first_value(py) over w) as ny from p window w as (partition by user_id order by k))
select user_id, count(*) as n, round(sum((px - 0) * (ny - 19700) - nx * (py - 19700)) / 2, 3) + 0 as area from q group by 1""")
def chain_area(spark, sf_dir):
    """Shoelace area of the closed chain that each user's events draw over (value, day)."""
    return benchmarks.chain_areas(roles.table(spark, sf_dir, "events"))


@query()
def trace_svg(spark, sf_dir):
    """Images to SVG outlines: components, shared boundaries and path text, one image a unit of work."""
    return regions.trace(_labels(spark, sf_dir).withColumnRenamed("region", "label"))


@query(ORACLES["ledger_overdraft_fold"])
def stream_ledger(spark, sf_dir):
    """The ledger fold as a stateful stream over the events table, run to its end."""
    from ..streaming import ledger as stream

    return stream.run(spark, sf_dir)


@query("""with d as (select event_id // 8 as job_id, event_id, ts, case event_type when 'purchase' then 'success' when 'error' then 'permanent' else 'transient' end as outcome from events),
k as (select *, row_number() over (partition by job_id order by ts, event_id) as k from d), f as (select job_id, min(case when outcome <> 'transient' or k >= 3 then k end) as last, count(*) as n from k group by job_id)
select f.job_id, case when last is null then 'queued' when k.outcome = 'success' then 'completed' else 'failed' end as status, cast(coalesce(last, n) as int) as attempts, case when last is not null and k.outcome <> 'success' then 1 else 0 end as refunds from f left join k on f.job_id = k.job_id and f.last = k.k""")
def stream_lifecycle(spark, sf_dir):
    """The job state machine as a stateful stream over queue deliveries, run to its end."""
    from ..streaming import lifecycle

    return lifecycle.run(spark, sf_dir)


_KEY = b"a key of our own"
_IN, _OUT = ("".join(f"\\x{b:02X}" for b in p) for p in signing.pads(_KEY))


@query(f"""with d as (select doc_id, 'documents/' || doc_id || '?expires=' || (1700000000 + doc_id) as link from documents), s as (select *, sha256('{_OUT}'::blob || unhex(sha256('{_IN}'::blob || link::blob))) as signature from d)
select doc_id, link, signature, case when doc_id % 3 = 0 then 'forbidden' when 1700000000 + doc_id < 1700000500 then 'expired' end as error from s""")
def signed_links(spark, sf_dir):
    """Links to stored objects with their signature; every third is presented with a wrong one."""
    expires = F.col("doc_id") + 1_700_000_000
    d = roles.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit("?expires="), expires.cast("string")).alias("link"))
    s = d.withColumn("signature", signing.hmac_sha256(_KEY, F.col("link")))
    given = F.when(F.col("doc_id") % 3 == 0, "0").otherwise(F.col("signature"))
    return s.withColumn("error", signing.link_error(F.col("signature"), given, expires, F.lit(1_700_000_500)))


@query(f"select engine, round(avg(mean_delta_e), 6) as mean_delta_e, round(max(boundary_error), 6) as max_edge, cast(sum(segments) as bigint) as segments, avg(mean_delta_e) <= 0.04 and max(boundary_error) <= 0.3 and sum(segments) <= 1000000000 as within from {_ROWS} where not failed group by engine")
def budget_gate(spark, sf_dir):
    """Means, maxima and sums of each engine against its budgets."""
    g = benchmarks.rows(spark, sf_dir).where("not failed").groupBy("engine").agg(F.avg("mean_delta_e").alias("d"), F.max("boundary_error").alias("e"), F.sum("segments").alias("segments"))
    return g.select("engine", F.round("d", 6).alias("mean_delta_e"), F.round("e", 6).alias("max_edge"), "segments", ((F.col("d") <= 0.04) & (F.col("e") <= 0.3) & (F.col("segments") <= 1_000_000_000)).alias("within"))


@query()
def palette_extract(spark, sf_dir):
    """A palette of each image by seeds, means and merging over its OKLab cells."""
    return palette.extract(images.palette_bins(roles.pixels(spark, sf_dir)))


@query()
def img_denoise(spark, sf_dir):
    """Each image after the bilateral filter."""
    return raster.apply(roles.pixels(spark, sf_dir), lambda image: raster.bilateral(image, 2, 22.0))


@query()
def img_upscale(spark, sf_dir):
    """Each image at twice its size, then blurred as before labelling."""
    return raster.apply(roles.pixels(spark, sf_dir), lambda image: raster.blur(raster.upscale(image, 2), 0.9))
