"""Registered queries on measures and rules that need few steps each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, presets, rules
from ..operators import details, edges, gradients, images, markup, service
from ..sources import images as files
from ..sources import roles
from .queries import _JOBS, _NEAR, _PIXELS, _RESULTS, _STATS, ORACLES, _lab, query
from .requests import _PRESET_OF
from .shapes import _RAMPS, _ROOTS, _TINTS, _placed
from .thin import _LINEAR, _SKETCH, _SUMS, _sketches, _sums, _taps_sql
from .traces import _DRAWN
from .traces import _SIDE as _WIDE

# images


@query(f"""with f as (select image_id, a, a >= 128 and {_NEAR} as flat from {_lab(_PIXELS)} window wx as (partition by image_id, y order by x), wy as (partition by image_id, x order by y)),
s as (select image_id, count(*) filter (a >= 128) as n_opaque, count(*) filter (flat) as n_flat, n_flat < greatest(16, n_opaque * 0.05::double) as use_all from f group by 1)
select f.image_id, any_value(n_opaque) as n_opaque, any_value(n_flat) as n_flat, any_value(use_all) as use_all, count(*) filter (a >= 128 and (use_all or flat)) as used from f join s on s.image_id = f.image_id group by 1""")
def img_palette_support(spark, sf_dir):
    """How many pixels tell an image's colours: the flat ones, or all opaque ones where those are too few."""
    p = roles.pixels(spark, sf_dir)
    used = images.palette_pixels(p).groupBy("image_id").agg(F.count("*").alias("used"))
    return images.palette_support(images.flat_mask(p)).join(used.hint("merge"), "image_id", "left").na.fill(0, ["used"])


_Y = "(0.299::double * r + 0.587::double * g + 0.114::double * b)"


@query(f"select image_id, x, y, round({_Y}, 6) as luma, round((b - {_Y}) * 0.564::double, 6) as cb, round((r - {_Y}) * 0.713::double, 6) as cr, r as r_back, g as g_back, b as b_back from {_SKETCH}")
def img_ycbcr(spark, sf_dir):
    """Luma and chroma of sketches' pixels, and back."""
    y, cb, cr = color.ycbcr(F.col("r"), F.col("g"), F.col("b"))
    p = _sketches(spark, sf_dir).select("image_id", "x", "y", y.alias("luma"), cb.alias("cb"), cr.alias("cr"))
    back = color.from_ycbcr(F.col("luma"), F.col("cb"), F.col("cr"))
    return p.select("image_id", "x", "y", *[F.round(c, 6).alias(c) for c in ("luma", "cb", "cr")], *[F.round(v).cast("int").alias(f"{c}_back") for c, v in zip("rgb", back, strict=True)])


_BLUR_25 = "(select 0 as i, k, exp(-k * k / (2 * 0.8::double * 0.8::double)) / (select sum(exp(-j * j / (2 * 0.8::double * 0.8::double))) from range(-2, 3) q(j)) as w from range(-2, 3) p(k))"
_SOFT = f"(select image_id, x, y, {', '.join(f'coalesce({c}, 0) as {c}' for c in 'rgb')}, a from {_taps_sql('px', _BLUR_25, 1)})"


@query(f"with px as materialized {_SKETCH} select image_id, {_SUMS} from {_SOFT} group by 1")
def img_blur(spark, sf_dir):
    """Sketches blurred over two and a half standard deviations, as before tracing."""
    return _sums(details.resample(_sketches(spark, sf_dir), details.gaussian(0.8, 2.5)).na.fill(0, ["r", "g", "b"]))


@query(f"""with px as materialized {_SKETCH}, s as (select image_id, x, y, {', '.join(f'case when a > 0 and a < 255 then least(255, floor({c} * 255 / a::double + 0.5))::int else {c} end as {c}' for c in 'rgb')}, a from {_SOFT}),
f as (select image_id, x, y, {', '.join(f'floor({c} * (a / 255.0::double) + 255 * (1 - a / 255.0::double) + 0.5)::int as {c}' for c in 'rgb')}, 255 as a from s) select image_id, {_SUMS} from f group by 1""")
def img_flattened(spark, sf_dir):
    """Colours that were multiplied by alpha made straight, then laid on white as for a file without alpha."""
    soft = details.resample(_sketches(spark, sf_dir), details.gaussian(0.8, 2.5)).na.fill(0, ["r", "g", "b"])
    return _sums(edges.flattened(edges.straight(soft)))


_FEW = f"(select * from {_DRAWN} where x % 4 = 0 and y % 4 = 0)"


@query(_STATS.replace(_PIXELS, _FEW)[1:-1])
def img_analysis_sampled(spark, sf_dir):
    """Statistics of large drawings from so many evenly spaced pixels at most, neighbours being the sampled ones."""
    return images.analyse(images.sampled(roles.drawings(spark, sf_dir, _WIDE), most=4_000))


@query(f"select image_id, region, n, round(rms, 6) + 0 as rms, round(ramp, 6) + 0 as ramp from {_RAMPS} where n >= 4 and ramp >= 0.02::double and rms <= 0.26::double")
def gradient_ramp_regions(spark, sf_dir):
    """Regions that a ramp is worth drawing for, with loose limits."""
    f = gradients.linear_ramps(_placed(spark, sf_dir)).where(gradients.has_ramp(least=4, rms=0.26))
    return f.select("image_id", "region", "n", *[(F.round(c, 6) + 0).alias(c) for c in ("rms", "ramp")])


# markup

_PATHS = """(select c_custkey as id, '<svg><g>' || repeat('<path fill="red" d="M0 0' || repeat('L1 1', c_custkey % 5) || repeat('C1 1 2 2 3 3', c_nationkey % 3) || 'z"/>', c_custkey % 70) || '</g></svg>' as t, c_custkey % 2 = 0 as curved from customer)"""


@query(f"""with d as (select id, t, curved, regexp_extract_all(t, '<path\\s[^<>]*?\\sd="([^"]*)"', 1) as p from {_PATHS} ), e as (select id, curved, len(p) as paths, strlen(t) as bytes, length(array_to_string(p, '')) as data_bytes, array_to_string(p, ' ') as a from (select id, t, curved, regexp_extract_all(t, ' d="([^"]*)"', 1) as p from d)),
f as (select *, length(regexp_replace(a, '[^LlCcQq]', '', 'g')) as drawn, length(regexp_replace(a, '[^CcQq]', '', 'g')) as curves, length(regexp_replace(a, '[^LlCcQqMm]', '', 'g')) as nodes from e), g as (select *, coalesce(curves / nullif(drawn, 0)::double, 0) as ratio from f)
select id, paths, bytes, data_bytes, nodes, round(ratio, 6) as curve_ratio, concat_ws(',', case when paths > 60 then 'too-many-paths' end, case when nodes < 4 then 'missing-details' end, case when curved and ratio < 0.15::double then 'jagged-edges' end, case when paths > 50 and data_bytes / paths::double < 40 then 'noisy-svg' end, case when bytes > 4000 then 'oversized-svg' end, case when nodes > 250 then 'node-count-exploded' end) as flags from g""")
def svg_proxies(spark, sf_dir):
    """Paths, nodes, curves and problem flags of SVG drawings made from customers."""
    c = roles.table(spark, sf_dir, "customer")
    n = lambda c, k: (F.col(c) % k).cast("int")
    path = F.concat(F.lit('<path fill="red" d="M0 0'), F.repeat(F.lit("L1 1"), n("c_custkey", 5)), F.repeat(F.lit("C1 1 2 2 3 3"), n("c_nationkey", 3)), F.lit('z"/>'))
    text = F.concat(F.lit("<svg><g>"), F.repeat(path, n("c_custkey", 70)), F.lit("</g></svg>"))
    d = c.select(F.col("c_custkey").alias("id"), text.alias("svg"))
    return markup.proxies(d, "id", "svg", F.col("id") % 2 == 0, max_bytes=4000, max_paths=60, max_nodes=250).withColumn("curve_ratio", F.round("curve_ratio", 6))


# rules


@query(f"""with j as (select case when o_orderstatus = 'F' then 'professional' else 'quick' end as mode, coalesce({_PRESET_OF}, 'none') as preset from orders), d(option, value) as (values {', '.join(f"('{k}', '{v}')" for k, v in presets.DEFAULTS.items())}),
m(mode, option, value) as (values {', '.join(f"('{m}', '{k}', '{v}')" for m, o in presets.MODES.items() for k, v in o.items())}), p(preset, option, value) as (values {', '.join(f"('{n}', '{k}', '{v}')" for n, o in presets.PRESETS.items() for k, v in o.items())})
select j.mode, j.preset, d.option, coalesce(p.value, m.value, d.value) as value, count(*) as jobs from j cross join d left join m on m.mode = j.mode and m.option = d.option left join p on p.preset = j.preset and p.option = d.option group by all""")
def engine_options_in_full(spark, sf_dir):
    """Every engine option of each mode and preset that jobs ask for: the defaults, the mode's, then the preset's."""
    o = roles.table(spark, sf_dir, "orders")
    preset = F.when(F.col("o_orderpriority") == "1-URGENT", "qrCode").when(F.col("o_orderpriority") == "2-HIGH", "sketch").when(F.col("o_orderpriority") == "3-MEDIUM", "photo").when(F.col("o_orderpriority") == "5-LOW", "none such").otherwise("none")
    j = o.groupBy(F.when(F.col("o_orderstatus") == "F", "professional").otherwise("quick").alias("mode"), preset.alias("preset")).agg(F.count("*").alias("jobs"))
    every = presets.merged(presets.options_of(F.lit("engine"), {"engine": presets.DEFAULTS}), presets.options_of(F.col("mode"), presets.MODES), presets.options_of(F.col("preset"), presets.PRESETS))
    return j.select("mode", "preset", F.explode(every).alias("option", "value"), "jobs")


_HEADS = {"image/png": "89504E470D0A1A0A0000000D", "image/jpeg": "FFD8FFE000104A4649460001", "image/webp": "524946460000000057454250"}
_TYPES = list(_HEADS)


@query(f"""with u as (select doc_id, n_chars * 400 as size, case doc_id % 3 when 0 then 'image/png' when 1 then 'image/jpeg' else 'image/webp' end as mime, case doc_id % 3 when 0 then 'a.png' when 1 then 'b.jpg' else 'c.webp' end as name, unhex(case (doc_id // 3 + doc_id % 3) % 4 when 0 then '{_HEADS[_TYPES[0]]}' when 1 then '{_HEADS[_TYPES[1]]}' when 2 then '{_HEADS[_TYPES[2]]}' else '00' end) as content from documents),
k as (select *, case when starts_with(hex(content), '89504E470D0A1A0A') then 'image/png' when starts_with(hex(content), 'FFD8FF') then 'image/jpeg' when regexp_matches(hex(content), '^52494646.{{8}}57454250') then 'image/webp' end as shown from u)
select doc_id, shown, case when size <= 0 then 'empty' when size > 5242880 then 'too_large' when shown is null or shown <> mime then 'magic' when mime <> 'image/png' and size > 2097152 + 3 * 100 then 'padding' end as error from k""")
def validate_contents(spark, sf_dir):
    """Uploads made up from documents, with first bytes that may show another type than they tell."""
    d = roles.table(spark, sf_dir, "documents")
    three, four = F.col("doc_id") % 3, (F.floor(F.col("doc_id") / 3) + F.col("doc_id") % 3) % 4
    pick = lambda by, values, last: F.when(by == 0, values[0]).when(by == 1, values[1]).otherwise(last) if len(values) == 2 else F.when(by == 0, values[0]).when(by == 1, values[1]).when(by == 2, values[2]).otherwise(last)
    content = F.unhex(pick(four, [F.lit(h) for h in _HEADS.values()], F.lit("00")))
    d = d.select("doc_id", (F.col("n_chars") * 400).alias("size"), pick(three, [F.lit(t) for t in _TYPES[:2]], F.lit(_TYPES[2])).alias("mime"), pick(three, [F.lit("a.png"), F.lit("b.jpg")], F.lit("c.webp")).alias("name"), files.kind(content).alias("shown"))
    return d.select("doc_id", "shown", rules.upload_error(F.col("name"), F.col("mime"), F.col("size"), F.lit(10), F.lit(10), F.lit(5 << 20), F.col("shown")).alias("error"))


# changes of tables


@query("""with t as (select c_custkey as user_id, c_name as name from customer where c_acctbal < 0), n as (select o_custkey as user_id, 'new ' || min(o_orderkey) as name from orders group by 1 union all select c_custkey, 'second' from customer where c_mktsegment = 'BUILDING'),
r as (select *, row_number() over (partition by user_id order by user_id, name) as k from n), s as (select 'stored' as what, user_id, name from t union all select case when user_id in (select user_id from t) or k > 1 then 'conflict' else 'stored' end, user_id, name from r) select what, user_id, name from s""")
def insert_or_conflict(spark, sf_dir):
    """Accounts that go in unless their owner has one; the rest are told as conflicts."""
    c = roles.table(spark, sf_dir, "customer")
    there = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    orders = roles.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.concat(F.lit("new "), F.min("o_orderkey").cast("string")).alias("name"))
    new = orders.unionByName(c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.lit("second").alias("name")))
    state, conflicts = service.insert_unique(there, new, "user_id")
    return state.select(F.lit("stored").alias("what"), "user_id", "name").unionByName(conflicts.select(F.lit("conflict").alias("what"), "user_id", "name"))


@query(f"""with gone as (select c_custkey as upload_id from customer where c_acctbal < 0), lost as (select job_id from {_JOBS} where upload_id in (select upload_id from gone))
select 'uploads' as kept, count(*) as n, 0 as forgotten from customer where c_custkey not in (select upload_id from gone) union all select 'jobs', count(*), 0 from {_JOBS} where job_id not in (select job_id from lost)
union all select 'results', count(*), 0 from {_RESULTS} where job_id not in (select job_id from lost) union all select 'ledger', count(*), count(*) filter (o_orderkey in (select job_id from lost)) from orders""")
def delete_with_cascade(spark, sf_dir):
    """What is left of each table when uploads go; ledger rows stay and forget their job."""
    c = roles.table(spark, sf_dir, "customer")
    uploads, gone = c.select(F.col("c_custkey").alias("upload_id")), c.where("c_acctbal < 0").select(F.col("c_custkey").alias("upload_id"))
    ledger = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_totalprice").alias("amount"))
    left = service.delete_cascade(uploads, roles.jobs(spark, sf_dir), roles.conversions(spark, sf_dir), ledger, gone)
    counts = [t.agg(F.count("*").alias("n"), (F.count_if(F.col("job_id").isNull()) if name == "ledger" else F.lit(0).cast("long")).alias("forgotten")).select(F.lit(name).alias("kept"), "n", "forgotten") for name, t in zip(("uploads", "jobs", "results", "ledger"), left, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


# filters by kernels, against sums over neighbours


def _filtered(source: str, weights: str, factor: int, side: int) -> str:
    """`source` weighted by (i, k, w): the place within a pixel, the offset and the weight; edges repeat, without alpha colours are 0."""
    at = lambda c, k: f"greatest(0, least({side - 1}, m.{c} + {k}))"
    byte = lambda v: f"round_even(greatest(0, least(255, round({v}, 9))), 0)::int"
    fine = f"select m.image_id, m.x * {factor} + u.i as x, m.y * {factor} + v.i as y, {at('x', 'u.k')} as px, {at('y', 'v.k')} as py, u.w * v.w as w from {source} m, {weights} u, {weights} v"
    sums = f"select f.image_id, f.x, f.y, {', '.join(f'sum(p.{c} * p.a * w) as {c}' for c in 'rgb')}, sum(p.a * w) as alpha from ({fine}) f join {source} p on p.image_id = f.image_id and p.x = f.px and p.y = f.py group by 1, 2, 3"
    return f"(select image_id, x, y, {', '.join(f'case when round(alpha, 9) > 0 then {byte(f'{c} / alpha')} else 0 end as {c}' for c in 'rgb')}, {byte('alpha')} as a from ({sums}))"


_BLUR_09 = "(select 0 as i, k, exp(-0.5::double * pow(k / 0.9::double, 2)) / (select sum(exp(-0.5::double * pow(j / 0.9::double, 2))) from range(-3, 4) q(j)) as w from range(-3, 4) p(k))"
ORACLES["img_upscale"] = f"with p as materialized {_PIXELS}, u as materialized {_filtered('p', _LINEAR, 2, 8)} select * from {_filtered('u', _BLUR_09, 1, 16)}"

_LIKE = "exp(-(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) / (2 * pow(2 / 1.5::double, 2)) - (pow(q.r - p.r, 2) + pow(q.g - p.g, 2) + pow(q.b - p.b, 2)) / (2 * 22.0::double * 22.0::double)) * q.a"
ORACLES["img_denoise"] = f"""with p as materialized {_PIXELS}, s as (select p.image_id, p.x, p.y, p.a, {', '.join(f'sum(q.{c} * {_LIKE}) as {c}' for c in 'rgb')}, sum({_LIKE}) as w from p join p q on q.image_id = p.image_id and q.x between p.x - 2 and p.x + 2 and q.y between p.y - 2 and p.y + 2 group by 1, 2, 3, 4)
select image_id, x, y, {', '.join(f'case when w > 0 then round_even(greatest(0, least(255, {c} / w)), 0)::int else 0 end as {c}' for c in 'rgb')}, a from s"""

_CLOSER = "round(" + " + ".join("pow(p.{c} - {{0}}.{c}, 2)".format(c=c) for c in "lmn") + ", 9)"
ORACLES["blend_slivers_dissolved"] = f"""with s as materialized ({ORACLES['blend_slivers']}), c as materialized {_ROOTS}, p as materialized {_lab(_PIXELS)}, t as materialized {_lab(_TINTS)}
select c.image_id, c.x, c.y, case when s.region is null then c.label when {_CLOSER.format('f')} <= {_CLOSER.format('z')} then s.first else s.second end as label from c join p on p.image_id = c.image_id and p.x = c.x and p.y = c.y
left join s on s.image_id = c.image_id and s.region = c.region left join t f on f.image_id = s.image_id and f.label = s.first left join t z on z.image_id = s.image_id and z.label = s.second"""
