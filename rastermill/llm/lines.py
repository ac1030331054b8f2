"""Line dedup across documents with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save

#: White space that is stripped from a line before it is compared: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Drop lines that recur over documents; keep them in the largest id that holds them.

    A text is split at \\n. A line's key is the line stripped at both ends, A-Z in lower case. Keys of at
    least `min_chars` code points found in at least `min_docs` distinct documents lose every line, except in the
    document of the largest id. Returns all columns of `docs`, with the text replaced by what stays, and
    `n_lines`, `n_dropped` (an input column of one of those names gives way).

    A null or empty text is one empty line. Rows of one id are one document: they count once, and keep or lose
    a line together. A row without an id is no document: it counts for nothing, is never the keeper and
    loses nothing. An empty table gives an empty table.

    Each line is keyed and hashed once, into a written table of (id, text, position, hash); what recurs is
    counted and dropped from that table alone, and texts move once, to meet their dropped positions.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.struct(*[F.col(c) for c in names if c != text_col]).alias("_row"))
    rows = rows.withColumn("_of", F.xxhash64("_text"))  # tells rows of one id apart
    keys = rows.where("_id is not null").select("_id", "_of", F.posexplode(F.transform(F.split("_text", "\n"), _key)).alias("_pos", "_k"))
    held = save(keys.where(F.char_length("_k") >= min_chars).select("_id", "_of", "_pos", *_hashes("_k")), "lines")
    # at least as many rows as documents: cheap to count, and few lines pass
    often = save(held.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs).drop("_n"), "frequent-lines")
    at = save(held.join(often, ["_h1", "_h2"]), "frequent-places")
    common = at.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one")).groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.max("_id").alias("_keeper")).where(F.col("_n") >= min_docs)
    lost = at.join(save(common.drop("_n"), "common-lines"), ["_h1", "_h2"]).where(F.col("_id") < F.col("_keeper"))
    gone = lost.groupBy(F.col("_id").alias("_at"), F.col("_of").alias("_in")).agg(F.sort_array(F.collect_set("_pos")).alias("_lost"))
    done = rows.join(gone, (F.col("_id") == F.col("_at")) & (F.col("_of") == F.col("_in")), "left")
    lines = F.split("_text", "\n")
    kept = F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(F.array_join(_without(lines, F.col("_lost")), "\n"))
    out = {text_col: kept, **{c: F.col("_row")[c] for c in names if c != text_col}}
    return done.select(*[out[c].alias(c) for c in names], F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"))


def _key(line):
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(c: str) -> list:
    """128 bits of a key as two longs: cheap to group by, and no two of 10^12 keys meet by chance."""
    return [F.xxhash64(c).alias("_h1"), F.xxhash64(F.lit(1), F.col(c)).alias("_h2")]


def _without(items, lost):
    """An array without the (sorted) positions `lost`: the slices between them, so each item is touched once."""

    def stretch(whole, k):
        start = F.when(k == 0, 0).otherwise(F.get(lost, k - 1) + 1)
        end = F.when(k == F.size(lost), F.size(whole)).otherwise(F.get(lost, k))
        return F.slice(whole, start + 1, end - start)

    # the outer transform binds the array, which would otherwise be made again for each stretch
    between = F.transform(F.array(items), lambda whole: F.flatten(F.transform(F.sequence(F.lit(0), F.size(lost)), lambda k: stretch(whole, k))))
    return F.element_at(between, 1)
