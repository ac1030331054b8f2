"""Registered queries on requests to the service, on queue deliveries, and on benchmark rows of two engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import presets, rules, sizing
from ..operators import benchmarks, images, service
from ..sources import roles
from .queries import _JOBS, _LABELS, _LEDGER, _PIXELS, _PROFILES, _RESULTS, _ROWS, _STATS, _labels, _stamp, _text, query

# results, objects, lists

_KEYED = f"(select *, 'results/' || job_id || '/' || line as key from {_RESULTS})"
_ASKED = "(select l_orderkey * 10 + l_linenumber as request_id, o_custkey as caller, 'results/' || l_orderkey || '/' || l_linenumber as key from lineitem join orders on l_orderkey = o_orderkey union all select event_id, user_id, 'results/' || event_id || '/1' from events)"


@query(f"select a.request_id, a.caller, a.key, r.job_id, case when r.user_id is null then 404 when r.user_id <> a.caller then 403 when coalesce(j.status, '') <> 'completed' then 410 else 200 end as http_status from {_ASKED} a left join {_KEYED} r on a.key = r.key left join {_JOBS} j on r.job_id = j.job_id")
def download_access(spark, sf_dir):
    """Requests for results by key: jobs' owners ask for theirs, and events for whatever their number says."""
    key = lambda job, line: F.concat(F.lit("results/"), job.cast("string"), F.lit("/"), line.cast("string"))
    owners = roles.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = owners.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("o_custkey").alias("caller"), key(F.col("l_orderkey"), F.col("l_linenumber")).alias("key"))
    asked = asked.unionByName(roles.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("caller"), key(F.col("event_id"), F.lit(1)).alias("key")))
    results = roles.conversions(spark, sf_dir).withColumn("key", key(F.col("job_id"), F.col("line")))
    return service.download_access(asked, results, roles.jobs(spark, sf_dir))


@query("select event_id as upload_id, user_id, event_type as kind from events where user_id::varchar = '7' and event_type = 'click'")
def uploads_of_user_and_kind(spark, sf_dir):
    """Two equalities at once; both reach the scan's rows as filters."""
    return service.find(roles.uploads(spark, sf_dir), user_id="7", kind="click").select("upload_id", "user_id", "kind")


@query("with a as (select l_orderkey as id, case when l_linenumber % 2 = 0 then 'no-number-' || l_partkey else (l_partkey * 3)::varchar end as asked from lineitem) select id, asked, p_name as name from a left join part on asked = p_partkey::varchar")
def lookup_by_text_id(spark, sf_dir):
    """Parts asked for by the text of an id: malformed and unknown ones find nothing."""
    wrong = F.concat(F.lit("no-number-"), F.col("l_partkey").cast("string"))
    asked = roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, wrong).otherwise((F.col("l_partkey") * 3).cast("string")).alias("asked"))
    return service.lookup(asked, roles.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), "p_partkey").select("id", "asked", "name")


_SHARD = "epoch(timestamp '2024-01-20 07:31:00') / 900"
_OBJECTS = "(select case when event_id % 2 = 0 then 'uploads/' else 'conversions/' end || md5(user_id::varchar) || '/' || event_id as key, ts as uploaded from events)"


@query(f"""with s as (select cast(floor({_SHARD}) as bigint) % 32 as s), p as (select case when s < 16 then 'uploads/' else 'conversions/' end || substr('0123456789abcdef', cast(s % 16 as int) + 1, 1) as prefix from s)
select key from {_OBJECTS} where starts_with(key, (select prefix from p)) and epoch(timestamp '2024-01-20 07:31:00') - epoch(uploaded) > 86400 and key not in (select case when doc_id % 2 = 0 then 'uploads/' else 'conversions/' end || md5((doc_id % 50)::varchar) || '/' || doc_id from documents)""")
def sharded_sweep(spark, sf_dir):
    """Objects of one time slot's shard, older than a day, that no row has."""
    def key(owner, i):
        return F.concat(F.when(i % 2 == 0, "uploads/").otherwise("conversions/"), F.md5(owner.cast("string")), F.lit("/"), i.cast("string")).alias("key")

    now = F.lit("2024-01-20 07:31:00").cast("timestamp")
    objects = roles.table(spark, sf_dir, "events").select(key(F.col("user_id"), F.col("event_id")), F.col("ts").alias("uploaded"))
    rows = roles.table(spark, sf_dir, "documents").select(key(F.col("doc_id") % 50, F.col("doc_id")))
    return service.sweep(objects, rows, now, rules.shard_of_slot(now)).select("key")


@query("select l_orderkey as id, l_linenumber as line, case when m < 16 then 'uploads/' else 'conversions/' end || substr('0123456789abcdef', cast(m % 16 as int) + 1, 1) as prefix from (select *, ((l_partkey - 1000) % 32 + 32) % 32 as m from lineitem)")
def shard_prefixes(spark, sf_dir):
    return roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), rules.shard_prefix(F.col("l_partkey") - 1000).alias("prefix"))


@query(f"select job_id, status from (select * from (select * from {_JOBS} where status = 'queued' and epoch(timestamp '{roles.NOW}') - epoch(created_at) > 3600 order by created_at, job_id limit 50) union all select * from (select * from {_JOBS} where status = 'processing' and epoch(timestamp '{roles.NOW}') - epoch(created_at) > 1200 order by created_at, job_id limit 50))")
def stale_batch(spark, sf_dir):
    """What one run of the sweep takes on: the oldest 50 of each kind."""
    return service.stale_batch(roles.jobs(spark, sf_dir), F.lit(roles.NOW)).select("job_id", "status")


_LIMITS = "(values " + ", ".join(f"('{p[0]}', {p[6]})" for p in rules.PLAN_LIMITS) + ")"


@query(f"select a.user_id, coalesce(p.plan, 'free') as plan, n_active, max_active_jobs, 30 as retry_after from (select user_id, count(*) as n_active from {_JOBS} where status in ('queued', 'processing') group by user_id) a left join {_PROFILES} p on a.user_id = p.user_id join {_LIMITS} l(plan, max_active_jobs) on l.plan = coalesce(p.plan, 'free') where n_active >= max_active_jobs")
def active_job_limits(spark, sf_dir):
    """Users at the limit of active jobs of their plan."""
    return service.active_job_breaches(roles.jobs(spark, sf_dir), roles.profiles(spark, sf_dir), rules.plan_limits(spark))


@query(f"select user_id, place, request_id, type, amount, job_id, {_stamp('made_at')} as made_at from (select *, row_number() over (partition by user_id order by made_at desc, request_id desc) as place from {_LEDGER}) where place <= 20")
def ledger_list(spark, sf_dir):
    """The newest ledger entries of each user, without the keys of grants."""
    return service.public_ledger(roles.ledger_requests(spark, sf_dir)).withColumn("made_at", _text("made_at"))


@query("""with a as (select event_id, case event_id % 6 when 0 then null when 1 then value::varchar when 2 then floor(value)::bigint::varchar when 3 then 'ten' when 4 then (event_id % 300)::varchar else '-' || (event_id % 9) end as asked from events), n as (select *, try_cast(asked as double) as n from a)
select event_id, case when n > 0 and n = floor(n) then least(n, 100) else 20 end as whole_limit, case when n > 0 then least(n, 100) else 20 end as any_limit, case when n >= 0 and n = floor(n) then n else 0 end as start from n""")
def page_arguments(spark, sf_dir):
    """Limits and offsets from texts that may be missing, fractional, negative or no numbers."""
    k = F.col("event_id") % 6
    asked = F.when(k == 0, None).when(k == 1, F.col("value").cast("string")).when(k == 2, F.floor("value").cast("long").cast("string")).when(k == 3, "ten").when(k == 4, (F.col("event_id") % 300).cast("string")).otherwise(F.concat(F.lit("-"), (F.col("event_id") % 9).cast("string")))
    a = roles.table(spark, sf_dir, "events").select("event_id", asked.alias("asked"))
    return a.select("event_id", rules.page_limit(F.col("asked")).alias("whole_limit"), rules.page_limit(F.col("asked"), whole=False).alias("any_limit"), rules.page_offset(F.col("asked")).alias("start"))


@query("""with s as (select event_id, case event_id % 5 when 0 then props when 1 then '[1]' when 2 then '{"k": "' || event_type || '"}' when 3 then '{"a": 1, "b": ' || props || '}' else '{"a": 1.5, "b": -' || user_id || '}' end as settings from events)
select event_id, json_type(settings) = 'OBJECT' and len(list_filter(json_keys(settings), lambda k: json_type(settings, '$.' || k) not in ('UBIGINT', 'BIGINT', 'DOUBLE'))) = 0 as valid from s""")
def settings_valid(spark, sf_dir):
    """Settings must be a JSON object of numbers: arrays, texts and nested objects are refused."""
    k, props = F.col("event_id") % 5, F.col("props")
    text = F.when(k == 0, props).when(k == 1, "[1]").when(k == 2, F.concat(F.lit('{"k": "'), "event_type", F.lit('"}'))).when(k == 3, F.concat(F.lit('{"a": 1, "b": '), props, F.lit("}"))).otherwise(F.concat(F.lit('{"a": 1.5, "b": -'), F.col("user_id").cast("string"), F.lit("}")))
    return roles.table(spark, sf_dir, "events").select("event_id", rules.is_settings(text).alias("valid"))


# deliveries

_DELIVERIES = "(select o_custkey as job_id, o_orderkey as delivery_id, o_orderdate as made_at, case o_orderpriority when '1-URGENT' then 'success' when '2-HIGH' then 'permanent' else 'transient' end as outcome from orders)"
_DECISIONS = f"""(with a as (select *, row_number() over w as attempt from {_DELIVERIES} window w as (partition by job_id order by made_at, delivery_id)),
 d as (select *, coalesce(max(case when outcome <> 'transient' or attempt >= 3 then 1 else 0 end) over (partition by job_id order by made_at, delivery_id rows between unbounded preceding and 1 preceding), 0) = 1 as done from a),
 e as (select *, case when done or outcome = 'success' then 'ack' when outcome <> 'transient' or attempt >= 3 then 'fail' else 'retry' end as action from d)
 select job_id, delivery_id, attempt, action, case when action = 'retry' then cast(15 * pow(2, attempt - 1) as bigint) end as delay_seconds, action = 'fail' and outcome = 'transient' as dead from e)"""


def _deliveries(spark, sf_dir):
    """Orders as deliveries of one job for each customer."""
    outcome = F.when(F.col("o_orderpriority") == "1-URGENT", "success").when(F.col("o_orderpriority") == "2-HIGH", "permanent").otherwise("transient")
    return roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("delivery_id"), F.col("o_orderdate").alias("made_at"), outcome.alias("outcome"))


@query(f"select * from {_DECISIONS}")
def delivery_decisions(spark, sf_dir):
    """Acknowledge, retry after a delay, or fail: one decision for each delivery."""
    return service.decisions(_deliveries(spark, sf_dir)).select("job_id", "delivery_id", "attempt", "action", "delay_seconds", "dead")


@query(f"select job_id, 'failed' as status, '{sizing.FAILED}' as error, 1 as refunds from {_DECISIONS} where dead")
def dead_letters(spark, sf_dir):
    """Jobs that ran out of attempts: failed with a fixed sentence, and refunded once."""
    dead = service.decisions(_deliveries(spark, sf_dir)).where("dead")
    return dead.select("job_id", F.lit("failed").alias("status"), F.lit(sizing.FAILED).alias("error"), F.lit(1).alias("refunds"))


@query("""with recursive c as (select user_id as job_id, event_id as delivery_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
f as (select job_id, delivery_id, k, 'claim' as decision, null::bigint as wait, t + 300000000 as until from c where k = 1
union all select c.job_id, c.delivery_id, c.k, case when f.until > c.t then 'held' else 'takeover' end, case when f.until > c.t then least(cast(ceil((f.until - c.t) / 1000000.0) as bigint) + 5, 900) end, case when f.until > c.t then f.until else c.t + 300000000 end from f join c on f.job_id = c.job_id and c.k = f.k + 1)
select job_id, delivery_id, decision, wait from f""")
def lease_claims(spark, sf_dir):
    """Claims of a user's job as the user's events come: the lease of the first holds off others for five minutes."""
    e = roles.table(spark, sf_dir, "events")
    return service.lease_claims(e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("delivery_id"), F.col("ts").alias("made_at")))


# presets

_TYPED = f"""(with s as (select *, transparent / n::double >= 0.01 as has_alpha, coalesce(edges / nullif(compared, 0)::double, 0) as edge_share, coalesce(noisy / nullif(compared, 0)::double, 0) as noise, gray / n::double >= 0.97 as is_gray from {_STATS}),
 c as (select *, least(1, 0.5 * least(1, colours / 64.0::double) + 0.5 * least(1, edge_share * 4)) as complexity from s), k as (select *, case when complexity >= 0.6 then 'photo' when colours > 32 then 'illustration' else 'logo' end as kind from c) select * from k)"""


@query(f"""select image_id, kind, case when kind = 'photo' then 'photo' when is_gray and noise >= 0.15 then 'sketch' when kind = 'illustration' then 'illustration' when is_gray and has_alpha then 'signature' when is_gray and colours <= 4 and edge_share >= 0.065 then 'qrCode'
 when has_alpha and colours <= 16 then 'sticker' when colours <= 6 and complexity < 0.2 then 'icon' else 'logo' end as preset, case when n * 64 < 4096 then 'low' when kind = 'photo' then case when complexity >= 0.85 then 'low' else 'medium' end when complexity >= 0.75 then 'medium' else 'high' end as quality,
 1 as credits, cast(floor(150 + n * 64 / 4000.0::double + 0.5) as bigint) as ms from {_TYPED}""")
def trace_presets(spark, sf_dir):
    """Type, trace preset and estimates of each image, as if it were of eight times its size on both sides."""
    s = images.recommend(images.analyse(roles.pixels(spark, sf_dir)))
    s = s.withColumns({"kind": presets.image_type(F.col("kind")), "noise": F.coalesce(F.try_divide("noisy", "compared"), F.lit(0.0)), "pixels": F.col("n") * 64})
    preset = presets.trace_preset(F.col("kind"), F.col("is_gray"), F.col("has_alpha"), F.col("colours"), F.col("complexity"), F.col("edge_share"), F.col("noise"), F.lit(1.0))
    return s.select("image_id", "kind", preset.alias("preset"), presets.estimated_quality(F.col("pixels"), F.col("complexity"), F.col("kind")).alias("quality"), F.lit(1).alias("credits"), presets.estimated_ms(F.col("pixels")).alias("ms"))


_PRESET_OF = "case o_orderpriority when '1-URGENT' then 'qrCode' when '2-HIGH' then 'sketch' when '3-MEDIUM' then 'photo' when '5-LOW' then 'none such' end"


def _option(name: str) -> str:
    later = {p: o[name] for p, o in presets.PRESETS.items() if name in o}
    base = {m: o[name] for m, o in presets.MODES.items() if name in o}
    case = lambda of, d: f"case {of} " + " ".join(f"when '{k}' then '{v}'" for k, v in d.items()) + " end" if d else "null"
    return f"coalesce({case('preset', later)}, {case('mode', base)}) as {name}"


_OPTIONS = ("maxColors", "mergeDistance", "gradients", "denoise", "speckleArea", "snapCorners")


@query(f"select job_id, {', '.join(map(_option, _OPTIONS))} from (select o_orderkey as job_id, case when o_orderstatus = 'F' then 'professional' else 'quick' end as mode, {_PRESET_OF} as preset from orders)")
def engine_options(spark, sf_dir):
    """Options of each job: those of its mode, then what its preset changes."""
    preset = F.when(F.col("o_orderpriority") == "1-URGENT", "qrCode").when(F.col("o_orderpriority") == "2-HIGH", "sketch").when(F.col("o_orderpriority") == "3-MEDIUM", "photo").when(F.col("o_orderpriority") == "5-LOW", "none such")
    mode = F.when(F.col("o_orderstatus") == "F", "professional").otherwise("quick")
    whole = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), presets.merged(presets.options_of(mode, presets.MODES), presets.options_of(preset, presets.PRESETS)).alias("o"))
    return whole.select("job_id", *[F.try_element_at("o", F.lit(k)).alias(k) for k in _OPTIONS])


# images

_PURE = f"(select *, row_number() over (partition by image_id, region order by g desc, y, x) as k, count(*) over (partition by image_id, region) as n from (select p.image_id, p.x, p.y, p.r, p.g, p.b, l.region from {_PIXELS} p join {_LABELS} l on p.image_id = l.image_id and p.x = l.x and p.y = l.y))"


@query(f"select image_id, region, count(*) as n, round(avg(r), 6) as r, round(avg(g), 6) as g, round(avg(b), 6) as b from {_PURE} where k <= greatest(1, ceil(n * 0.4::double)) group by 1, 2")
def purest_colours(spark, sf_dir):
    """Mean colours of the greenest 40 % of each label's pixels."""
    p = roles.pixels(spark, sf_dir).withColumn("region", (F.col("r") / 60).cast("long"))
    return images.purest(p, F.desc("g")).select("image_id", "region", "n", *[F.round(c, 6).alias(c) for c in "rgb"])


_CANDIDATES = "list_filter([region, lag(region) over wx, lead(region) over wx, lag(region) over wy, lead(region) over wy], lambda v: v is not null)"


@query(f"with c as (select image_id, x, y, {_CANDIDATES} as c from {_LABELS} window wx as (partition by image_id, y order by x), wy as (partition by image_id, x order by y)) select image_id, x, y, list_aggregate(list_filter(c, lambda v, i: list_position(c, v) = i), 'string_agg', ',') as candidates from c")
def label_candidates(spark, sf_dir):
    """Labels that a pixel may take: its own, then those beside it, each once in the order found."""
    found = images.label_candidates(_labels(spark, sf_dir))
    return found.select("image_id", "x", "y", F.array_join(F.transform("candidates", lambda v: v.cast("string")), ",").alias("candidates"))


# benchmark rows of two engines

_CASES = f"(select category as case_id, variant, engine, avg(mean_delta_e) as mean_delta_e from {_ROWS} where not failed group by 1, 2, 3)"


def _against(engine: str, other: str, tolerance: str) -> str:
    return f"select a.case_id, a.variant, round(a.mean_delta_e, 6) as mean_delta_e, round(b.mean_delta_e, 6) as other_delta_e, round(a.mean_delta_e - b.mean_delta_e * {tolerance}, 9) <= 0 as within from {_CASES} a join {_CASES} b on a.case_id = b.case_id and a.variant = b.variant where a.engine = '{engine}' and b.engine = '{other}'"


def _pairs(spark, sf_dir, engine, other, tolerance):
    rows = benchmarks.by_case(benchmarks.rows(spark, sf_dir))
    found = benchmarks.against(rows, engine, other, tolerance)
    return found.select("case_id", "variant", F.round("mean_delta_e", 6).alias("mean_delta_e"), F.round("other_delta_e", 6).alias("other_delta_e"), "within")


@query(_against("RF", "AF", "case when a.case_id like 'Brand#1%' then 1.2::double else 1.05::double end"))
def gate_against_legacy(spark, sf_dir):
    """Cases of one engine against the old one, with more tolerance for one kind of case."""
    return _pairs(spark, sf_dir, "RF", "AF", F.when(F.col("case_id").startswith("Brand#1"), 1.2).otherwise(1.05))


@query(_against("NO", "RF", "1.05::double"))
def professional_against_quick(spark, sf_dir):
    return _pairs(spark, sf_dir, "NO", "RF", F.lit(1.05))


@query(f"select case_id, variant, engine, round(mean_delta_e, 3) as mean_delta_e from {_CASES}")
def rounded_baseline(spark, sf_dir):
    """Benchmark rows as a baseline keeps them: numbers of three places."""
    return benchmarks.rounded(benchmarks.by_case(benchmarks.rows(spark, sf_dir)))


@query(f"select engine, count(*) as n, count(*) filter (failed) as n_nan, cast(sum(case when failed then 0 else segments end) as bigint) as segments, cast(sum(case when failed then 0 else bytes end) as bigint) as bytes from {_ROWS} group by engine")
def failed_rows(spark, sf_dir):
    """Failed rows hold no numbers for errors and zeros for counts."""
    r = benchmarks.with_sentinels(benchmarks.rows(spark, sf_dir))
    return r.groupBy("engine").agg(F.count("*").alias("n"), F.count_if(F.isnan("mean_delta_e") & F.isnan("boundary_error")).alias("n_nan"), F.sum("segments").alias("segments"), F.sum("bytes").alias("bytes"))


@query(f"select category, engine, count(*) as n, round(avg(mean_delta_e) filter (not failed), 6) as mean_delta_e, round(avg(bytes / 100.0::double), 4) as mean_ms from {_ROWS} group by 1, 2")
def category_times(spark, sf_dir):
    return benchmarks.category_times(benchmarks.rows(spark, sf_dir).withColumn("trace_ms", F.col("bytes") / 100.0))


@query("select p_partkey as case_id, p_brand as category, 'core' as origin from part union all select s_suppkey, s_name, 'real' from supplier")
def corpus_union(spark, sf_dir):
    """The core cases, and the real-world ones where they are asked for."""
    core = roles.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("category"), F.lit("core").alias("origin"))
    real = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_name").alias("category"), F.lit("real").alias("origin"))
    return benchmarks.corpus(core, real, include_real=True)


@query(f"""with s as (select engine, count(*) as n, cast(sum(segments) filter (not failed) as bigint) as segments, max(bytes) as max_bytes from {_ROWS} group by engine)
select 0::bigint as place, '| engine | n | segments | max_bytes |' as line union all select 1, '|---|---|---|---|' union all select row_number() over (order by engine) + 1, '| ' || engine || ' | ' || n || ' | ' || segments || ' | ' || max_bytes || ' |' from s""")
def summary_table(spark, sf_dir):
    """The summary of engines as lines of a Markdown table."""
    return benchmarks.markdown(benchmarks.summary(benchmarks.rows(spark, sf_dir), "engine"), "engine", "n", "segments", "max_bytes")
