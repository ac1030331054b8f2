"""How the sources of a language differ in the words they use: exact distances of smoothed shares, and top words."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import save

#: Bytes of UTF-8 text that belong to a term: letters and all beyond ASCII; A-Z in lower case, all else a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are cut into terms at a time, and counts that a task holds before it passes them on.
PIECE, HELD = 1 << 20, 600_000
#: 10^9 in factors, for long division.
STEPS = (1000, 1000, 1000)
COUNTS = "lang string, term string, docs long, held array<struct<source:string,n:long>>"


def terms(text: str | None):
    """The terms of a text as UTF-8 bytes, in lists; long texts are cut between terms."""
    raw, at = (text or "").encode().translate(TERM_BYTES), 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PIECE else raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, docs, held): rows that hold a term, and its occurrences by source, added up within each task so far.

    An empty term lists the groups that there are, with or without any terms.
    """

    def run(batches):
        counts, docs_of, held = defaultdict(Counter), defaultdict(Counter), 0

        def rows():
            for lang, of in docs_of.items():
                by_term = {t: [] for t in of}
                for source in (s for la, s in counts if la == lang):
                    for t, n in counts[lang, source].items():
                        by_term[t].append((source, n))
                pairs = [x for v in by_term.values() for x in v]
                offsets = np.cumsum([0, *map(len, by_term.values())])
                sums = pa.StructArray.from_arrays([pa.array([s for s, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], ["source", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(of), pa.string()), pa.array([t.decode() for t in of], pa.string()), pa.array(of.values(), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), sums)],
                    ["lang", "term", "docs", "held"],
                )

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine, seen = counts[lang, source], {b""}
                before = len(mine)
                mine[b""] = 1
                for some in terms(text):
                    mine.update(some)
                    seen.update(some)
                docs_of[lang].update(seen)
                held += len(mine) - before
                if held > HELD:
                    yield from rows()
                    counts.clear()
                    docs_of.clear()
                    held = 0
        yield from rows()

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    return plain.mapInArrow(run, COUNTS)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 5) / total) in long division by thousands, exact for totals below 9 x 10^15."""
    rest = count + 5
    out = F.call_function("div", rest, total)
    for step in STEPS:
        rest = F.pmod(rest, total) * step
        out = out * step + F.call_function("div", rest, total)
    return out + 1


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """The same of an array of counts."""
    rest = counts.astype(np.int64) + 5
    out = rest // total
    for step in STEPS:
        rest = rest % total * step
        out = out * step + rest // total
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray, run: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted arrays of what they share: runs of the short one leap through the long one by doubling."""
    here, there, at = [], [], 0
    for start in range(0, len(short), run):
        part = short[start : start + run]
        leap = run
        while at + leap < len(long) and long[at + leap] < part[-1]:
            leap *= 2
        window = long[at : at + leap + 1]
        spot = np.searchsorted(window, part)
        hit = np.flatnonzero(spot < len(window))
        hit = hit[window[spot[hit]] == part[hit]]
        here.append(hit + start)
        there.append(spot[hit] + at)
        at += int(spot[-1])
        if at >= len(long):
            break
    return (np.concatenate(here), np.concatenate(there)) if here else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def distance(a_ids: np.ndarray, a_counts: np.ndarray, a_total: int, b_ids: np.ndarray, b_counts: np.ndarray, b_total: int, size: int) -> int:
    """Sum of |share of a - share of b| over `size` terms, given the sorted ids and counts of those that occur."""
    if len(a_ids) > len(b_ids):
        return distance(b_ids, b_counts, b_total, a_ids, a_counts, a_total, size)
    a, b = shares(a_counts, a_total), shares(b_counts, b_total)
    a0, b0 = (int(shares(np.zeros(1, np.int64), t)[0]) for t in (a_total, b_total))
    i, j = gallop(a_ids, b_ids)
    alone = lambda p, own, zero: int(np.abs(p - zero).sum() - np.abs(p[own] - zero).sum())
    absent = size - len(a_ids) - len(b_ids) + len(i)
    return int(np.abs(a[i] - b[j]).sum()) + alone(a, i, b0) + alone(b, j, a0) + absent * abs(a0 - b0)


def _priced(batches):
    for batch in batches:
        col = {c: batch.column(c) for c in batch.schema.names}
        arrays = {c: (col[c].offsets.to_numpy(), col[c].values.to_numpy()) for c in ("a_ids", "a_ns", "b_ids", "b_ns")}
        whole = [col[c].to_numpy() for c in ("a_total", "b_total", "size")]
        out = []
        for k in range(batch.num_rows):
            a_ids, a_ns, b_ids, b_ns = (v[o[k] : o[k + 1]] for o, v in (arrays[c] for c in ("a_ids", "a_ns", "b_ids", "b_ns")))
            a_total, b_total, size = (int(w[k]) for w in whole)
            out.append(distance(a_ids, a_ns, a_total, b_ids, b_ns, b_total, size))
        yield pa.RecordBatch.from_arrays([col["lang"], col["a_source"], col["b_source"], pa.array(out, pa.int64())], ["lang", "a", "b", "value"])


def audit_sources(docs: DataFrame, min_docs: int = 30, top: int = 50, block: int = 8192, tile: int = 8, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other and from the whole.

    Terms are maximal runs of ASCII letters and characters beyond ASCII, A-Z in lower case. A language keeps the V
    terms that at least `min_docs` of its documents (rows) hold. A group (lang, source) and a language as a whole give
    a kept term of `count` occurrences the share 1 + floor(10^9 (count + 5) / (N + 5 V)), N being their count of all
    kept terms. Part `pair`: `item` is each other source, `value` the sum over kept terms of the shares'
    differences. Part `term`: `item` is a kept term that the group holds and gives a larger share than the
    language does, `value` the difference; the `top` largest. `rank` counts from 1 in each group and part, by
    value descending, then by the item's bytes.

    Null texts, langs and sources count as empty strings, and empty ones are groups like any other. Repeated rows
    count each. A group without terms still has its pairs; with V = 0 their value is 0. An empty table
    gives no rows.

    Occurrences are added up in each task before anything is moved. Kept terms get numbers within blocks of about
    `block` terms, so an array holds one group's part of one block; sources of a language go to tiles of about
    `tile`, and each pair of tiles and block is a unit of work of its own. Each unordered pair is priced once by a
    sparse merge and reported both ways.
    """
    added = save(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    word = F.col("term") != ""
    kept = added.where(word).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    kept = save(kept, "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"))
    most = sizes.agg(F.max("size")).first()[0] or 0
    n_blocks = max(1, -(-most // block))
    number = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term"))
    numbered = save(kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int")).withColumn("id", number), "numbered-terms")
    each = added.join(numbered, ["lang", "term"]).select("lang", "term", "block", "id", F.inline("held"))
    counts = save(each.groupBy("lang", "source", "term", "block", "id").agg(F.sum("n").alias("n")), "kept-counts")

    groups = added.where(~word).select("lang", F.inline("held")).select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    lang_sums = totals.groupBy("lang").agg(F.sum("sum").alias("lang_sum"))
    per = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").join(lang_sums, "lang", "left").na.fill(0, ["sum", "size", "lang_sum"])
    per = save(per.withColumns({"total": F.col("sum") + F.col("size") * 5, "lang_total": F.col("lang_sum") + F.col("size") * 5}), "groups")

    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    own = counts.join(of_lang, ["lang", "term"]).join(per.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    gain = share(F.col("n"), F.col("total")) - share(F.col("lang_n"), F.col("lang_total"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gain.alias("value")).where("value > 0")
    words = words.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    widest = per.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    n_tiles = max(1, -(-widest // tile))
    arrays = counts.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("held"))
    spans = numbered.groupBy("lang", "block").agg(F.count("*").alias("size"))
    none = F.array().cast("array<struct<id:int,n:long>>")
    # every group has a row in each block, with or without terms there
    full = per.where("size > 0").select("lang", "source", "total").join(spans, "lang").join(arrays, ["lang", "source", "block"], "left")
    full = full.select("lang", "source", "block", "total", "size", F.coalesce("held", none).alias("held"), F.pmod(F.xxhash64("source"), F.lit(n_tiles)).alias("tile"))
    full = save(full.select("lang", "source", "block", "total", "size", "tile", F.col("held.id").alias("ids"), F.col("held.n").alias("ns")), "group-blocks")

    def side(name: str, mine: Column, other: Column) -> DataFrame:
        dealt = full.withColumn("_other", F.explode(F.sequence(*(F.lit(x).cast("long") if isinstance(x, int) else x for x in ((0, F.col("tile")) if name == "b" else (F.col("tile"), n_tiles - 1))))))
        return dealt.select("lang", "block", mine.alias("low"), other.alias("high"), *(["size"] if name == "a" else []), *[F.col(c).alias(f"{name}_{c}") for c in ("source", "total", "ids", "ns")])

    a, b = side("a", F.col("tile"), F.col("_other")), side("b", F.col("_other"), F.col("tile"))
    pairs = a.join(b, ["lang", "block", "low", "high"]).where((F.col("low") < F.col("high")) | (F.col("a_source") < F.col("b_source")))
    near = pairs.mapInArrow(_priced, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    bare = per.where("size = 0").select("lang", "source")
    bare = bare.select("lang", F.col("source").alias("a")).join(bare.select("lang", F.col("source").alias("b")), "lang").where("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    links = near.unionByName(bare).select("lang", "value", both).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return links.withColumn("rank", F.row_number().over(by_value)).unionByName(words)
