"""Registered queries on ramps inside regions, on region borders, and on what a trace will need."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sizing
from ..operators import edges, gradients, images, markup, regions
from ..sources import roles
from .queries import _HALVED, _LABELS, _PIXELS, _lab, _labels, query

# regions: the upper and the lower half of an image; transparent pixels are nobody's

_TILES = f"(select *, case when a = 0 then -1 else y // 4 end as region from {_PIXELS})"
_AROUND = [f"coalesce({side}(region) over (partition by image_id, {line} order by {along}) <> region, false)" for line, along in (("y", "x"), ("x", "y")) for side in ("lag", "lead")]
_DISTANCES = f"""(with e as (select *, ({' or '.join(_AROUND)}) as edge from {_TILES})
 select e.image_id, e.x, e.y, any_value(e.region) as region, any_value(e.r) as r, any_value(e.g) as g, any_value(e.b) as b, least(3, coalesce(min(1 + greatest(abs(e.x - q.x), abs(e.y - q.y))), 3))::int as distance
 from e left join (select image_id, x, y from e where edge) q on e.image_id = q.image_id and abs(e.x - q.x) <= 1 and abs(e.y - q.y) <= 1 group by 1, 2, 3)"""


def _tiles(spark, sf_dir):
    return roles.pixels(spark, sf_dir).withColumn("region", F.when(F.col("a") == 0, -1).otherwise(F.floor(F.col("y") / 4)).cast("long"))


@query(f"select image_id, x, y, region, distance from {_DISTANCES}")
def region_edge_distance(spark, sf_dir):
    return gradients.edge_distance(_tiles(spark, sf_dir)).select("image_id", "x", "y", "region", "distance")


def _placed(spark, sf_dir):
    return gradients.edge_distance(_tiles(spark, sf_dir)).where("region >= 0").select("image_id", "x", "y", "r", "g", "b", "region", "distance")


def _ramps_sql() -> str:
    sums = {"sx": "x", "sy": "y", "sxx": "x * x", "sxy": "x * y", "syy": "y * y"} | {k: e for c in "rgb" for k, e in ((f"s{c}", c), (f"sx{c}", f"{c} * x"), (f"sy{c}", f"{c} * y"), (f"s{c}{c}", f"{c} * {c}"))}
    spread = {"cxx": ("sxx", "sx", "sx"), "cxy": ("sxy", "sx", "sy"), "cyy": ("syy", "sy", "sy")} | {k: e for c in "rgb" for k, e in ((f"cx{c}", (f"sx{c}", "sx", f"s{c}")), (f"cy{c}", (f"sy{c}", "sy", f"s{c}")), (f"c{c}{c}", (f"s{c}{c}", f"s{c}", f"s{c}")))}
    total = lambda e: "(" + " + ".join(e.format(c=c) for c in "rgb") + ")"
    return f"""(with s as (select image_id, region, count(*) as n, {', '.join(f'sum({e})::double as {k}' for k, e in sums.items())} from {_DISTANCES} where distance > 1 and region >= 0 group by 1, 2),
 c as (select *, {', '.join(f'{u} - {p} * {q} / n as {k}' for k, (u, p, q) in spread.items())} from s), d as (select *, case when cxx * cyy - cxy * cxy > 1e-9 then cxx * cyy - cxy * cxy end as det from c),
 f as (select *, {', '.join(f'coalesce((cx{c} * cyy - cy{c} * cxy) / det, 0::double) as a{c}, coalesce((cy{c} * cxx - cx{c} * cxy) / det, 0::double) as b{c}' for c in 'rgb')} from d),
 e as (select *, {', '.join(f'greatest(0::double, c{c}{c} - a{c} * cx{c} - b{c} * cy{c}) as e{c}' for c in 'rgb')}, atan2(2 * {total('a{c} * b{c}')}, {total('a{c} * a{c}')} - {total('b{c} * b{c}')}) / 2 as turn from f),
 g as (select *, cos(turn) as ux, sin(turn) as uy from e), h as (select *, {', '.join(f'(a{c} * ux + b{c} * uy) / 255 as slope_{c}' for c in 'rgb')} from g)
 select image_id, region, n, sx / n as cx, sy / n as cy, sqrt({total('e{c}')} / (3 * n)) / 255 as rms, ux, uy, slope_r, slope_g, slope_b,
 sqrt({total('slope_{c} * slope_{c}')}) * 4 * sqrt(greatest(0::double, (cxx * ux * ux + 2 * cxy * ux * uy + cyy * uy * uy) / n)) as ramp from h)"""


_RAMPS = _ramps_sql()
_ALONG = f"(with s as (select p.*, x * ux + y * uy as u from {_DISTANCES} p join {_RAMPS} f on p.image_id = f.image_id and p.region = f.region) select *, round((u - min(u) over w) / greatest(1e-9, max(u) over w - min(u) over w), 9) as t from s window w as (partition by image_id, region))"


@query(f"select image_id, region, n, round(rms, 6) + 0 as rms, round(ramp, 6) + 0 as ramp, round(slope_r, 6) + 0 as slope_r, round(slope_g, 6) + 0 as slope_g, round(slope_b, 6) + 0 as slope_b from {_RAMPS}")
def gradient_linear_ramps(spark, sf_dir):
    """Direction, slope and residual of the plane through all channels of each region."""
    f = gradients.linear_ramps(_placed(spark, sf_dir))
    return f.select("image_id", "region", "n", *[(F.round(c, 6) + 0).alias(c) for c in ("rms", "ramp", "slope_r", "slope_g", "slope_b")])


@query(f"select image_id, region, least(5, floor(round(t * 6, 7)))::int as bin, count(*) as n, round(avg(r), 6) as r, round(avg(g), 6) as g, round(avg(b), 6) as b from {_ALONG} where distance > 1 group by 1, 2, 3 having count(*) >= 3")
def gradient_profile(spark, sf_dir):
    """Mean colours along each region's ramp."""
    p = _placed(spark, sf_dir)
    found = gradients.profile(gradients.along_axis(p, gradients.linear_ramps(p)), bins=6, least=3)
    return found.select("image_id", "region", "bin", "n", *[F.round(c, 6).alias(c) for c in "rgb"])


_WHOLE = _RAMPS.replace(_DISTANCES, f"(select * replace (0 as region) from {_DISTANCES} where region >= 0)")
_TOUCH = f"(select distinct p.image_id from {_TILES} p join {_TILES} q on p.image_id = q.image_id and abs(p.x - q.x) + abs(p.y - q.y) = 1 where p.region = 0 and q.region = 1)"


@query(f"""with f as materialized (select image_id, region, n, rms from {_RAMPS} where n >= 4 and ramp >= 0.02 and rms <= 0.26), b as (select image_id, max(rms) as worse from f group by 1 having count(*) = 2),
one as (select b.image_id from b join {_WHOLE} w on b.image_id = w.image_id where b.image_id in (select image_id from {_TOUCH}) and round(rms, 9) <= 0.26 and round(rms, 9) <= round(worse * 1.6::double + 0.006::double, 9))
select image_id, region, cast(case when image_id in (select image_id from one) then 0 else region end as bigint) as grp, n from f""")
def gradient_groups(spark, sf_dir):
    """Neighbouring regions that one ramp fits about as well as one each, with loose limits."""
    tiles = _tiles(spark, sf_dir)
    return gradients.merged_ramps(gradients.ramp_sums(_placed(spark, sf_dir)), images.neighbour_pairs(tiles), least=4, ramp=0.02, rms=0.26)


_RADIAL_SUMS = ", ".join(f"sum({c} / 255.0::double) filter (distance > 1) as s{c}, sum({c} / 255.0::double * d) filter (distance > 1) as sd{c}, sum({c} / 255.0::double * {c} / 255.0::double) filter (distance > 1) as s{c}{c}" for c in "rgb")


@query(f"""with d as (select p.*, f.rms as linear_rms, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) as d from {_DISTANCES} p join {_RAMPS} f on p.image_id = f.image_id and p.region = f.region),
s as (select image_id, region, linear_rms, count(*) filter (distance > 1) as n, max(d) as radius, sum(d) filter (distance > 1) as sd, sum(d * d) filter (distance > 1) as sdd, {_RADIAL_SUMS} from d group by 1, 2, 3),
k as (select *, n * sdd - sd * sd as spread from s where n >= 16 and n * sdd - sd * sd > 1e-6), f as (select *, {', '.join(f'(n * sd{c} - sd * s{c}) / spread as k{c}' for c in 'rgb')} from k), g as (select *, {', '.join(f'(s{c} - k{c} * sd) / n as z{c}' for c in 'rgb')} from f),
h as (select *, round(sqrt(({' + '.join(f'greatest(0::double, s{c}{c} - z{c} * s{c} - k{c} * sd{c})' for c in 'rgb')}) / (3 * n)), 6) as rms, round(sqrt(kr * kr + kg * kg + kb * kb) * radius, 6) as ramp from g)
select image_id, region, n, round(radius, 6) as radius, rms, ramp, rms <= 0.02 and rms < round(round(linear_rms, 6) * 0.7::double, 6) and ramp >= 0.08 as accepted from h""")
def gradient_radial_ramps(spark, sf_dir):
    """Regions whose colour follows the distance from their middle."""
    p = _placed(spark, sf_dir)
    f = gradients.radial_ramps(p, gradients.linear_ramps(p))
    return f.select("image_id", "region", "n", F.round("radius", 6).alias("radius"), "rms", "ramp", "accepted")


@query()
def gradient_fills(spark, sf_dir):
    """Regions whose few-stop gradient is no worse than a flat fill, with both errors and the stops."""
    p = _placed(spark, sf_dir)
    linear = gradients.linear_ramps(p)
    placed = gradients.along_axis(p, linear)
    stops = gradients.linear_stops(gradients.profile(placed, bins=6, least=3), linear, bins=6)
    return gradients.fill_errors(placed, stops).join(stops.hint("merge"), ["image_id", "region"]).where("kept").select("image_id", "region", F.round("flat_error", 4).alias("flat_error"), F.round("gradient_error", 4).alias("gradient_error"), "stops")


_RIMS = f"(with d as (select p.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) as d from {_DISTANCES} p join {_RAMPS} f on p.image_id = f.image_id and p.region = f.region) select *, round(d / greatest(1e-9, max(d) over (partition by image_id, region)), 9) as t from d)"


@query(f"select p.image_id, p.region, least(3, floor(round(t * 4, 7)))::int as bin, count(*) as n, round(avg(p.r), 6) as r, round(avg(p.g), 6) as g, round(avg(p.b), 6) as b from {_RIMS} p join (select image_id, region from {_RIMS} where distance > 1 group by 1, 2 having count(*) >= 4 and count(*) * sum(d * d) - sum(d) * sum(d) > 1e-6) q on p.image_id = q.image_id and p.region = q.region where distance > 1 group by 1, 2, 3 having count(*) >= 2")
def gradient_radial_profile(spark, sf_dir):
    """Mean colours from the centre of each region to its rim."""
    p = _placed(spark, sf_dir)
    radial = gradients.radial_ramps(p, gradients.linear_ramps(p), least=4)
    found = gradients.profile(gradients.around_centre(p, radial), bins=4, least=2)
    return found.select("image_id", "region", "bin", "n", *[F.round(c, 6).alias(c) for c in "rgb"])


@query()
def gradient_radial_stops(spark, sf_dir):
    """Few-stop radial gradients of all regions that allow a fit."""
    p = _placed(spark, sf_dir)
    radial = gradients.radial_ramps(p, gradients.linear_ramps(p), least=4)
    return gradients.radial_stops(gradients.profile(gradients.around_centre(p, radial), bins=4, least=2), radial, bins=4)


def _number(v: str, digits: int) -> str:
    return f"regexp_replace(cast(floor(({v}) * 1e{digits} + 0.5::double) / 1e{digits} + 0 as varchar), '\\.0$', '')"


_HEX = " || ".join(f"format('{{:02x}}', floor({c} + 0.5::double)::int)" for c in "rgb")
_SHORT = "'#' || case when " + " and ".join(f"h[{i}] = h[{i + 1}]" for i in (1, 3, 5)) + " then h[1] || h[3] || h[5] else h end"
_ENDS_OF = ", ".join(f"c{d} + ({end} - (cx * ux + cy * uy)) * u{d} + 0.5::double as {d}{k}" for k, end in ((1, "lo"), (2, "hi")) for d in "xy")
_PLACE = " || ".join(f"' {k}=\"' || {_number(k, 2)} || '\"'" for k in ("x1", "y1", "x2", "y2"))


@query(f"""with b as (select image_id, region, least(2, floor(round(t * 3, 7)))::int as bin, avg(r) as r, avg(g) as g, avg(b) as b from {_ALONG} where distance > 1 group by 1, 2, 3 having count(*) >= 3),
s as (select image_id, region, string_agg('<stop offset="' || {_number('(bin + 0.5::double) / 3', 3)} || '" stop-color="' || {_SHORT} || '"/>', '' order by bin) as stops from (select *, {_HEX} as h from b) group by 1, 2),
u as (select p.image_id, p.region, cx, cy, ux, uy, min(x * ux + y * uy) as lo, max(x * ux + y * uy) as hi from {_DISTANCES} p join {_RAMPS} f on p.image_id = f.image_id and p.region = f.region group by all),
e as (select u.image_id, u.region, stops, row_number() over (partition by u.image_id order by u.region) - 1 as g, {_ENDS_OF} from u join s on u.image_id = s.image_id and u.region = s.region)
select image_id, '<defs>' || string_agg('<linearGradient id="g' || g || '" gradientUnits="userSpaceOnUse"' || {_PLACE} || '>' || stops || '</linearGradient>', '' order by g) || '</defs>' as defs from e group by 1""")
def gradient_definitions(spark, sf_dir):
    """SVG text that defines a gradient for each region that has a profile."""
    p = _placed(spark, sf_dir)
    linear = gradients.linear_ramps(p)
    profile = gradients.profile(gradients.along_axis(p, linear), bins=3, least=3)
    sample = F.struct(((F.col("bin") + 0.5) / 3).alias("offset"), "r", "g", "b")
    stops = profile.groupBy("image_id", "region").agg(F.array_sort(F.collect_list(sample)).alias("stops"))
    return markup.gradient_definitions(gradients.linear_ends(p, linear).join(stops.hint("merge"), ["image_id", "region"]).withColumn("shape", F.lit("linear")))


# borders

_GROWN = f"(select image_id, x * 2 + dx as x, y * 2 + dy as y, r, g, b, a from {_HALVED} cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dx, dy))"


def _grown(pixels):
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))
    return images.box_downscale(pixels).withColumn("o", offsets).select("image_id", (F.col("x") * 2 + F.col("o.dx")).alias("x"), (F.col("y") * 2 + F.col("o.dy")).alias("y"), "r", "g", "b", "a")


def _edges_sql(pixels: str) -> str:
    white = f"(select image_id, x, y, a, {', '.join(f'floor({c} * (a / 255.0::double) + 255 * (1 - a / 255.0::double) + 0.5)::int as {c}' for c in 'rgb')} from {pixels})"
    leads = ", ".join(f"lead({c}) over (partition by image_id, {line} order by {along}) as {c}{line}" for line, along in (("y", "x"), ("x", "y")) for c in "lmn")
    far = " or ".join(" + ".join(f"({c} - {c}{line}) * ({c} - {c}{line})" for c in "lmn") + " > 0.1::double * 0.1::double" for line in "yx")
    return f"(select image_id, count(*) filter (ly is not null and lx is not null and ({far})) as edges from (select *, {leads} from {_lab(white)}) group by image_id)"



@query(f"select t.image_id, t.edges, g.edges as traced_edges, round(g.edges / nullif(t.edges, 0)::double, 6) as edge_ratio from {_edges_sql(_PIXELS)} t join {_edges_sql(_GROWN)} g on t.image_id = g.image_id")
def img_edge_ratio(spark, sf_dir):
    """Edges of each image on white, against those left in its half-size version blown up again."""
    p = roles.pixels(spark, sf_dir)
    truth, traced = (edges.edge_pixels(edges.composite_white(x)) for x in (p, _grown(p)))
    both = truth.join(traced.withColumnRenamed("edges", "traced_edges").hint("merge"), "image_id")
    return both.withColumn("edge_ratio", F.round(F.try_divide(F.col("traced_edges"), F.col("edges")), 6))


@query(f"""with n as (select p.image_id, p.x, p.y, p.a, min(q.a) as low, count(*) as around from {_PIXELS} p join {_PIXELS} q on p.image_id = q.image_id and abs(p.x - q.x) <= 2 and abs(p.y - q.y) <= 2 group by 1, 2, 3, 4)
select n.image_id, count(*) filter (n.a = 255) as opaque, count(*) filter (low = 255 and around = 25 and (n.x * 3 + n.y) % 4 = 0) as gaps from n group by 1""")
def img_gaps(spark, sf_dir):
    """Holes deep inside opaque areas: every fourth pixel was knocked out."""
    p = roles.pixels(spark, sf_dir)
    holed = p.withColumn("a", F.when((F.col("x") * 3 + F.col("y")) % 4 == 0, 0).otherwise(F.col("a")))
    return edges.gap_pixels(p, holed)


_ROOTS = f"""(with recursive p as {_LABELS}, f as (select image_id, x, y, region, y * 8 + x as c from p union select f.image_id, p.x, p.y, p.region, f.c from f join p on f.image_id = p.image_id and f.region = p.region and abs(f.x - p.x) + abs(f.y - p.y) = 1) select image_id, x, y, region as label, min(c) as region from f group by all)"""
_TINTS = f"(select image_id, cast(r / 60 as bigint) as label, floor(avg(r) + 0.5)::int as r, floor(avg(g) + 0.5)::int as g, floor(avg(b) + 0.5)::int as b from {_PIXELS} group by 1, 2)"


@query(f"""with c as {_ROOTS}, s as (select p.image_id, p.region, p.label, q.region as r2, q.label as other from c p join c q on p.image_id = q.image_id and abs(p.x - q.x) + abs(p.y - q.y) = 1 and p.region <> q.region),
thin as (select a.image_id, a.region from (select image_id, region, count(*) as area from c group by all) a join (select image_id, region, count(*) as boundary from s group by all) b on a.image_id = b.image_id and a.region = b.region where area / boundary::double < 0.5),
b as (select s.image_id, s.region, s.label, other, row_number() over (partition by s.image_id, s.region order by count(*) desc, other) as k from s join thin t on s.image_id = t.image_id and s.region = t.region where other <> s.label group by 1, 2, 3, 4),
w as (select image_id, region, label, max(other) filter (k = 1) as first, max(other) filter (k = 2) as second from b group by 1, 2, 3 having count(*) >= 2),
v as (select w.image_id, w.region, w.first, w.second, {', '.join(f'(z.{c} - f.{c}) / 255.0::double as d{c}, (o.{c} - f.{c}) / 255.0::double as w{c}' for c in 'rgb')} from w join {_TINTS} o on o.image_id = w.image_id and o.label = w.label join {_TINTS} f on f.image_id = w.image_id and f.label = w.first join {_TINTS} z on z.image_id = w.image_id and z.label = w.second),
u as (select *, (wr * dr + wg * dg + wb * db) / nullif(dr * dr + dg * dg + db * db, 0) as t from v)
select image_id, region, first, second from u where round(t, 9) between 0.05 and 0.95 and round(sqrt(pow(wr - dr * t, 2) + pow(wg - dg * t, 2) + pow(wb - db * t, 2)), 9) < 0.12""")
def blend_slivers(spark, sf_dir):
    """Thin regions coloured like a blend of their two main neighbours."""
    return edges.slivers(*_with_tints(spark, sf_dir), half_thickness=0.5)


def _with_tints(spark, sf_dir):
    found = regions.components(_labels(spark, sf_dir).withColumnRenamed("region", "label")).withColumnRenamed("root", "region")
    p = roles.pixels(spark, sf_dir)
    tints = p.groupBy("image_id", (F.col("r") / 60).cast("long").alias("label")).agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgb"])
    return found.join(p.hint("merge"), ["image_id", "x", "y"]), tints


@query()
def blend_slivers_dissolved(spark, sf_dir):
    """Labels after each pixel of such a region went to the closer neighbour."""
    return edges.dissolve(*_with_tints(spark, sf_dir), half_thickness=0.5)


_ENDS = "(select user_id % 50 as jx, user_id % 40 as jy, user_id % 7 as image_id, cos(value) as dx, sin(value) as dy, user_id % 50 + (event_id % 5 - 2) / 4.0::double as cx, user_id % 40 + (event_id % 3 - 1) / 4.0::double as cy, event_id % 9 + 1 as support from events)"


@query(f"""with s as (select image_id, jx, jy, 0.02::double + sum(sqrt(support) * dy * dy) as a, sum(sqrt(support) * -dy * dx) as b, 0.02::double + sum(sqrt(support) * dx * dx) as c, sum(sqrt(support) * -dy * w) as d, sum(sqrt(support) * dx * w) as e from (select *, -dy * (cx - jx) + dx * (cy - jy) as w from {_ENDS}) group by 1, 2, 3),
o as (select *, (c * d - b * e) / (a * c - b * b) as ox, (a * e - b * d) / (a * c - b * b) as oy from s), m as (select *, case when ox * ox + oy * oy > 0.01 then 0.1::double / sqrt(ox * ox + oy * oy) else 1 end as k from o)
select image_id, jx, jy, round(jx + case when jx in (0, 49) then 0 else ox * k end, 5) as x, round(jy + case when jy in (0, 39) then 0 else oy * k end, 5) as y from m""")
def junction_refinement(spark, sf_dir):
    """Junctions moved to where their lines meet; a user's events stand in for lines that end in one junction."""
    e, u = roles.table(spark, sf_dir, "events"), F.col("user_id")
    ends = e.select((u % 7).alias("image_id"), (u % 50).alias("jx"), (u % 40).alias("jy"), F.cos("value").alias("dx"), F.sin("value").alias("dy"), (u % 50 + (F.col("event_id") % 5 - 2) / 4).alias("cx"), (u % 40 + (F.col("event_id") % 3 - 1) / 4).alias("cy"), (F.col("event_id") % 9 + 1).alias("support"))
    size = ends.select("image_id", F.lit(49).alias("width"), F.lit(39).alias("height")).distinct()
    return edges.refine_junctions(ends, size, most=0.1).select("image_id", "jx", "jy", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


# sizes, names and messages

_SIZES = "(select p_partkey as id, p_partkey * 37 % 6000 + 1 as w, p_partkey * 91 % 5000 + 1 as h, p_partkey % 10 / 10.0::double as flat, p_size % 2 = 0 as lossy, p_retailprice / 1000 as sigma from part)"


@query(f"""with c as (select *, case when w * h <= 1200000 then 4000000 when flat < 0.7 then 1200000 else 4000000 end as cap from {_SIZES})
select id, cap, case when w * h <= cap then 1 else list_min(list_filter(range(2, 200), lambda k: ceil(w / k) * ceil(h / k) <= cap)) end::int as shrink, coalesce(list_max(list_filter([2, 3, 4], lambda k: k <= floor(sqrt(2000000 / (w * h)::double)) and w * h * k * k <= 4000000)), 1)::int as grow,
greatest(0, ceil(log10(5000.0::double / greatest(w, h))))::int as decimals, round(greatest(2, least(40, w * h * 5e-6)) * case when lossy then 3 else 1 end, 6) as speckle, round(case when lossy or sigma > 1.2 then greatest(case when lossy then 22 else 14 end, 3.5 * sigma) end, 6) as denoise from c""")
def trace_sizing(spark, sf_dir):
    """Working size, precision, speckles and denoising of images as large as parts' numbers say."""
    p, k = roles.table(spark, sf_dir, "part"), F.col("p_partkey")
    s = p.select(k.alias("id"), (k * 37 % 6000 + 1).alias("w"), (k * 91 % 5000 + 1).alias("h"), (k % 10 / 10).alias("flat"), (F.col("p_size") % 2 == 0).alias("lossy"), (F.col("p_retailprice") / 1000).alias("sigma"))
    w, h = F.col("w"), F.col("h")
    s = s.withColumn("cap", sizing.pixel_cap(w, h, F.col("flat")))
    return s.select("id", "cap", sizing.shrink_factor(w, h, F.col("cap")).alias("shrink"), sizing.grow_factor(w, h, F.lit(4_000_000)).alias("grow"), sizing.decimals(w, h).alias("decimals"), F.round(sizing.speckle_area(w, h, F.col("lossy")), 6).alias("speckle"), F.round(sizing.denoise_range(F.col("sigma"), F.col("lossy")), 6).alias("denoise"))


@query("select l_orderkey as id, l_linenumber as line, case when l_partkey % 4 = 0 then 'original' else (l_partkey % 4 * 256)::varchar || case when l_suppkey % 2 = 0 then 'jpg' else '' end || case when l_suppkey % 2 = 0 then 'q' || l_quantity::int else '' end || case when l_linenumber % 3 > 0 then 'blur' || (l_linenumber % 3) || '.5' else '' end end as variant from lineitem")
def variant_labels(spark, sf_dir):
    size, jpeg, line = F.col("l_partkey") % 4 * 256, F.col("l_suppkey") % 2 == 0, F.col("l_linenumber")
    blur = F.when(line % 3 > 0, line % 3 + 0.5).otherwise(0.0)
    return roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), line.alias("line"), sizing.variant_label(size, jpeg, F.when(jpeg, F.col("l_quantity").cast("int")), blur).alias("variant"))


@query("""select event_id, case event_id % 7 when 0 then 'Not enough credits for this conversion.' when 1 then 'The image is too large to convert.' when 2 then 'The image is too complex to convert. Try a smaller or simpler image.' when 3 then 'The image could not be read. It may be damaged or in an unsupported format.' when 4 then 'The image could not be read. It may be damaged or in an unsupported format.'
 else case when event_type = 'error' then 'The image could not be read. It may be damaged or in an unsupported format.' else 'The conversion failed. Any credits charged were refunded.' end end as sentence from events""")
def public_errors(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("credits", "too_large", "range", "unsupported", "validation", "other", "other")])
    message = F.when(F.col("event_type") == "error", "Failed to decode image/png: bad header").otherwise("boom")
    return roles.table(spark, sf_dir, "events").select("event_id", sizing.public_error(F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")), message).alias("sentence"))


@query("select l_orderkey as id, arg_min(l_returnflag || l_linestatus, (l_quantity, floor(l_extendedprice), l_returnflag || l_linestatus)) as engine, count(*) as n from lineitem group by 1")
def engine_pick(spark, sf_dir):
    """Of several results for a case the one with the fewest nodes, then bytes, then the first name."""
    engine = F.concat("l_returnflag", "l_linestatus")
    return roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min_by(engine, F.struct("l_quantity", F.floor("l_extendedprice"), engine)).alias("engine"), F.count("*").alias("n"))


@query("""select event_id, '{"level":"' || case when event_type = 'error' then 'error' else 'info' end || '","requestId":"' || event_id || '","path":"/' || event_type || '","status":' || case when event_type = 'error' then 500 else 200 end || ',"durationMs":' || floor(abs(value))::bigint || '}' as line from events""")
def request_log(spark, sf_dir):
    """One line of JSON for each request."""
    failed = F.col("event_type") == "error"
    line = F.to_json(F.struct(F.when(failed, "error").otherwise("info").alias("level"), F.col("event_id").cast("string").alias("requestId"), F.concat(F.lit("/"), F.col("event_type")).alias("path"), F.when(failed, 500).otherwise(200).alias("status"), F.floor(F.abs("value")).cast("long").alias("durationMs")))
    return roles.table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("""with p as (select user_id, event_id, event_id % 100 as x, floor(value)::bigint % 100 as y, row_number() over (partition by user_id order by ts, event_id) as k from events)
select user_id, event_id, sum(x) over w::bigint as sx, sum(y) over w::bigint as sy, sum(x * x) over w::bigint as sxx, sum(x * y) over w::bigint as sxy, sum(y * y) over w::bigint as syy from p window w as (partition by user_id order by k rows unbounded preceding)""")
def chain_prefix_sums(spark, sf_dir):
    """Running sums along each user's chain of points: any stretch of it can be fitted from two of them."""
    from pyspark.sql import Window

    e = roles.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 100).alias("x"), (F.floor("value").cast("long") % 100).alias("y"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    terms = {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y"), "syy": F.col("y") * F.col("y")}
    return e.select("user_id", "event_id", *[F.sum(t).over(w).alias(k) for k, t in terms.items()])


@query()
def traced_path_structure(spark, sf_dir):
    """Counts of paths, segments, curves and bytes in the SVG text of traced images."""
    traced = regions.trace(_labels(spark, sf_dir).withColumnRenamed("region", "label"))
    return markup.path_structure(traced, "image_id", "svg")


# masks and groups

_STRICT = f"(select p.image_id, p.x, p.y, bool_and(q.r >= 100) as mask from {_PIXELS} p join {_PIXELS} q on p.image_id = q.image_id and q.x - p.x in (0, 1) and q.y - p.y in (0, 1) group by 1, 2, 3)"


@query(f"""with o as (select i % 24 as x, i // 24 as y from range(576) t(i)), a as (select x, y, greatest(0, floor((x + 0.5::double) / 3 - 0.5::double))::int as u, greatest(0, floor((y + 0.5::double) / 3 - 0.5::double))::int as v from o)
select m.image_id, a.x, a.y, m.mask from a join {_STRICT} m on m.x = a.u and m.y = a.v""")
def mask_upscale(spark, sf_dir):
    """Bright pixels on a grid three times as fine, set where no dark one would be blended in."""
    return images.upscale_mask(roles.pixels(spark, sf_dir).select("image_id", "x", "y", (F.col("r") >= 100).alias("mask")), 3)


@query(f"""with recursive c as {_ROOTS}, v as (select c.image_id, c.region from c join {_PIXELS} p on c.image_id = p.image_id and c.x = p.x and c.y = p.y group by 1, 2 having max(g) - min(g) >= 40),
s as (select distinct p.image_id, p.region as a, q.region as b from c p join c q on p.image_id = q.image_id and abs(p.x - q.x) + abs(p.y - q.y) = 1 and p.region <> q.region where (p.image_id, p.region) in (select (image_id, region) from v) and (q.image_id, q.region) in (select (image_id, region) from v)),
w as (select image_id, a as region, a as grp from s union select w.image_id, s.b, w.grp from w join s on w.image_id = s.image_id and w.region = s.a)
select image_id, region, min(grp) as grp from w group by 1, 2""")
def region_varying_groups(spark, sf_dir):
    """Neighbouring regions that all vary in green, as groups: candidates for one gradient."""
    both, _ = _with_tints(spark, sf_dir)
    varying = both.groupBy("image_id", "region").agg((F.max("g") - F.min("g")).alias("range")).where("range >= 40")
    return regions.varying_groups(varying, images.neighbour_pairs(both))
