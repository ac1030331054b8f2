"""Structure of markup files by counting, and markup text of gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color


def structure(files: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """Counts of paths, nodes and curves, and what is wrong with a file by them."""
    count = lambda p: F.regexp_count(F.col(text_col), F.lit(p)).cast("long")
    c = files.select(F.col(id_col), count("<p[ >]").alias("n_paths"), count("<[a-zA-Z]").alias("n_nodes"), F.octet_length(text_col).cast("long").alias("bytes"), count("<li>").alias("n_curves"))
    ratio = F.try_divide(F.col("n_curves"), F.col("n_nodes"))
    flags = [(F.col("n_paths") > 50, "too-many-paths"), (F.col("n_nodes") < 4, "missing-details"), (ratio < 0.15, "jagged"), ((F.col("n_paths") > 50) & (F.try_divide(F.col("bytes"), F.col("n_paths")) < 40), "noisy"), (F.col("bytes") > 20000, "oversized")]
    return c.select(id_col, "n_paths", "n_nodes", "bytes", F.round(ratio, 6).alias("curve_ratio"), F.concat_ws(",", *[F.when(p, name) for p, name in flags]).alias("flags"))


#: How many numbers one segment of each path command takes.
ARITY = {"m": 2, "l": 2, "h": 1, "v": 1, "c": 6, "s": 4, "q": 4, "t": 2, "a": 7}


def path_structure(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bytes, paths, segments, curves) of SVG texts.

    A command letter may be followed by the numbers of several segments. The first pair after a move is the move
    itself, and further pairs are lines. Paths without fill don't count.
    """
    tags = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(r"(<path\b[^>]*>)"), F.lit(1)), lambda t: ~t.contains('fill="none"'))
    data = F.array_join(F.transform(tags, lambda t: F.regexp_extract(t, r'\bd="([^"]*)"', 1)), " ")
    runs = F.regexp_extract_all(data, F.lit(r"([a-df-zA-DF-Z][^a-df-zA-DF-Z]*)"), F.lit(1))
    arity = F.create_map(*[F.lit(x) for kv in ARITY.items() for x in kv])

    def segments(run, only=None):
        letter = F.lower(F.substring(run, 1, 1))
        n = F.floor(F.regexp_count(run, F.lit(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e-?[0-9]+)?")) / F.try_element_at(arity, letter))
        n = F.coalesce(F.when(letter == "m", F.greatest(F.lit(0), n - 1)).otherwise(n), F.lit(0)).cast("long")
        return n if only is None else F.when(letter.isin(*only), n).otherwise(F.lit(0).cast("long"))

    total = lambda only=None: F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + segments(r, only))
    return files.select(F.col(id_col), F.octet_length(text_col).cast("long").alias("bytes"), F.size(tags).cast("long").alias("paths"), total().alias("segments"), total("csqta").alias("curves"))


def proxies(files: DataFrame, id_col: str, text_col: str, curved: Column, max_bytes: int, max_paths: int, max_nodes: int) -> DataFrame:
    """(id, paths, bytes, data_bytes, nodes, curve_ratio, flags) of SVG texts: what tells a bad trace without drawing it.

    Nodes are commands that move, draw a line or a curve; the ratio is of curves to lines and curves. Flags name what
    is wrong, in a fixed order, joined by commas; `curved` says whether a picture's outline should have curves.
    """
    data = F.regexp_extract_all(F.col(text_col), F.lit(r'<path(?=\s)[^<>]*?\sd="([^"]*)"'), F.lit(1))
    count = lambda p: F.regexp_count(F.array_join(data, " "), F.lit(p)).cast("long")
    f = files.select(F.col(id_col), curved.alias("_curved"), F.size(data).cast("long").alias("paths"), F.octet_length(text_col).cast("long").alias("bytes"), F.char_length(F.array_join(data, "")).cast("long").alias("data_bytes"), count("[Mm]").alias("_moves"), count("[Ll]").alias("_lines"), count("[QqCc]").alias("_curves"))
    ratio = F.coalesce(F.try_divide(F.col("_curves"), F.col("_lines") + F.col("_curves")), F.lit(0.0))
    f = f.withColumns({"nodes": F.col("_moves") + F.col("_lines") + F.col("_curves"), "curve_ratio": ratio})
    small = F.coalesce(F.try_divide(F.col("data_bytes"), F.col("paths")), F.lit(0.0)) < 40
    flags = [(F.col("paths") > max_paths, "too-many-paths"), (F.col("nodes") < 4, "missing-details"), (F.col("_curved") & (ratio < 0.15), "jagged-edges"), ((F.col("paths") > 50) & small, "noisy-svg"), (F.col("bytes") > max_bytes, "oversized-svg"), (F.col("nodes") > max_nodes, "node-count-exploded")]
    return f.select(id_col, "paths", "bytes", "data_bytes", "nodes", "curve_ratio", F.concat_ws(",", *[F.when(p, name) for p, name in flags]).alias("flags"))


#: Tags of groups, and paths without a drawing command. None reaches beyond the next tag.
GROUP, GROUP_END = r"<g(?=[\s/>])[^<>]*+>", r"</g\s*+>"
NO_PATH = r"<path(?=\s)[^<>]*?\sd=\"\s*\"[^<>]*?(?:/>|>\s*</path>)"


def cleaned(text: Column) -> Column:
    """SVG text without paths that draw nothing and groups that hold nothing, however deep they are nested.

    Tags of groups with nothing between them but blanks form runs. Within a run, what an end tag closes is empty, so
    a stack of open tags tells in one pass what stays: ends of groups that began before, and groups that go on.
    """
    text = F.regexp_replace(text, NO_PATH, "")
    run = rf"(?:{GROUP}|{GROUP_END}|\s)+"
    state = "struct<before: string, open: array<string>>"

    def read(s: Column, token: Column) -> Column:
        n = F.size(s["open"])
        top = F.coalesce(F.try_element_at(s["open"], n), F.lit(""))
        below = F.when(n > 0, F.slice(s["open"], 1, F.greatest(F.lit(0), n - 1))).otherwise(s["open"])
        closes, blank = F.startswith(token, F.lit("</")), ~F.startswith(token, F.lit("<"))
        opens = ~closes & ~blank & ~F.endswith(token, F.lit("/>"))
        kept = F.when(closes | blank, token).otherwise("")  # a group in one tag holds nothing
        stack = F.when(opens, F.array_append(s["open"], token)).when(n == 0, s["open"]).when(closes, below).otherwise(F.array_append(below, F.concat(top, kept)))
        return F.struct(F.when((n == 0) & ~opens, F.concat(s["before"], kept)).otherwise(s["before"]).alias("before"), stack.alias("open"))

    def left(r: Column) -> Column:
        tokens = F.regexp_extract_all(r, F.lit(rf"({GROUP}|{GROUP_END}|\s+)"), F.lit(1))
        done = F.aggregate(tokens, F.struct(F.lit("").alias("before"), F.array().cast("array<string>").alias("open")).cast(state), read)
        return F.concat(done["before"], F.array_join(done["open"], ""))

    runs = F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1))
    return F.array_join(F.zip_with(F.split(text, run), runs, lambda between, r: F.concat(between, F.coalesce(left(r), F.lit("")))), "")


def sized(text: Column, width: Column, height: Column) -> Column:
    """SVG text whose root says this size, and this alone, as width, height and viewBox; without blanks around."""
    part = lambda k: F.regexp_extract(text, r"(?s)^(.*?)<svg\b([^>]*)>(.*)$", k)
    rest = F.btrim(F.regexp_replace(part(2), r'\s(width|height|viewBox)="[^"]*"', ""))
    w, h = width.cast("string"), height.cast("string")
    tag = F.concat(F.lit("<svg"), F.when(rest == "", "").otherwise(F.concat(F.lit(" "), rest)), F.lit(' width="'), w, F.lit('" height="'), h, F.lit('" viewBox="0 0 '), w, F.lit(" "), h, F.lit('">'))
    return F.btrim(F.when(text.rlike(r"<svg\b[^>]*>"), F.concat(part(1), tag, part(3))).otherwise(text), F.lit(" \t\r\n"))


def aspect(text: Column) -> Column:
    """Width over height by an SVG text's viewBox; 1 where it has none that begins at zero."""
    side = lambda k: F.regexp_extract(text, r'viewBox="0 0 ([0-9.]+) ([0-9.]+)"', k)
    return F.coalesce(F.try_divide(side(1).try_cast("double"), side(2).try_cast("double")), F.lit(1.0))


def number(value: Column, digits: int) -> Column:
    """A number in so many digits at most, without a trailing point or a minus before zero."""
    return F.regexp_replace((color.half_up(value * 10**digits) / 10**digits + 0).cast("string"), r"\.0$", "")


def gradient_definitions(fills: DataFrame, label: str = "region") -> DataFrame:
    """(image_id, defs): the SVG text that defines an image's gradients as g0, g1, ... in order of their regions.

    `fills` has (image_id, label, shape, place, stops): of a linear one x1, y1, x2, y2, of a radial one cx, cy,
    r. Images without fills have no row.
    """
    stop = lambda s: F.concat(F.lit('<stop offset="'), number(s["offset"], 3), F.lit('" stop-color="'), color.hex_colour(*[color.half_up(s[c]) for c in "rgb"]), F.lit('"/>'))
    names = F.when(F.col("shape") == "radial", F.array(*map(F.lit, ("cx", "cy", "r")))).otherwise(F.array(*map(F.lit, ("x1", "y1", "x2", "y2"))))
    place = F.zip_with(names, "place", lambda k, v: F.concat(F.lit(" "), k, F.lit('="'), number(v, 2), F.lit('"')))
    at = F.row_number().over(Window.partitionBy("image_id").orderBy(label)) - 1
    text = F.concat(
        F.lit("<"), "shape", F.lit('Gradient id="g'), at.cast("string"), F.lit('" gradientUnits="userSpaceOnUse"'), F.array_join(place, ""), F.lit(">"),
        F.array_join(F.transform("stops", stop), ""), F.lit("</"), "shape", F.lit("Gradient>"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), F.col("text").alias("v"))))
    each = fills.withColumn("text", text).groupBy("image_id").agg(ordered.alias("all"))
    return each.select("image_id", F.concat(F.lit("<defs>"), F.array_join(F.col("all.v"), ""), F.lit("</defs>")).alias("defs"))
