"""How text filters interact: what each removes at each place of every order, and its Shapley share."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import BLANKS, UPPER

#: Failure conditions of (text, its words) by letter; None is the filter of texts that a smaller id has too.
FILTERS: dict[str, Callable[[Column, Column], Column] | None] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
    "C": lambda text, words: (F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))) * 100 > F.char_length(text) * 2,
    "D": lambda text, words: text.rlike("[#$%&*|]"),
    "E": None,
}
SUMS = ("n", "good", "toxic")


def words_of(text: Column) -> Column:
    """The maximal runs of other characters than space and U+0009 to U+000D, in order."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def failures(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters that they fail, bit k for the k-th.

    Rows shrink to ids, hashes and bits at once; no text is moved. Equal texts are found by 128 bits of hash, and
    their smallest id by aggregates, so a text of any number of copies is never in one task.
    """
    of, copies = F.col, next((i for i, c in enumerate(filters.values()) if c is None), None)
    rows = docs.select(of(id_col).alias("id"), F.coalesce(of(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(of(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", words_of(of("_text")))
    bits = [F.when(c(of("_text"), of("_words")), 1 << i).otherwise(0) for i, c in enumerate(filters.values()) if c is not None]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    narrow = rows.select("id", "part", mask.alias("mask"), F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit(1), "_text").alias("h2"))
    own = narrow.groupBy("id", "part", "mask", "h1", "h2").agg(F.count("*").alias("n"))
    flag = lambda c: F.max(F.when(of(c) == 1, 1).otherwise(0))
    told = labels.where("doc_id is not null").groupBy(of("doc_id").alias("_told")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    own = own.join(told, of("id") == of("_told"), "left").select("id", "part", "mask", "h1", "h2", "n", *[(F.coalesce(c, F.lit(0)) * of("n")).alias(c) for c in SUMS[1:]])
    if copies is None:
        return own.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in SUMS])
    free = of("id").isNull()  # a row without an id is nobody's copy, and nobody is its copy
    texts = own.groupBy("part", "mask", "h1", "h2").agg(*[F.sum(c).alias(c) for c in SUMS], *[F.sum(F.when(free, of(c)).otherwise(0)).alias(f"free_{c}") for c in SUMS], F.min(F.when(~free, F.struct("id", *SUMS))).alias("first"))
    texts = texts.withColumn("lead", F.min("first.id").over(Window.partitionBy("h1", "h2")))
    leads = F.coalesce(of("first.id") == of("lead"), F.lit(False))
    stay = [(of(f"free_{c}") + F.when(leads, of(f"first.{c}")).otherwise(0)).alias(c) for c in SUMS]
    both = F.array(F.struct(of("mask"), *stay), F.struct((of("mask") + (1 << copies)).alias("mask"), *[(of(c) - s).alias(c) for c, s in zip(SUMS, stay, strict=True)]))
    return texts.select("part", F.inline(both)).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in SUMS])


def removal_games(facts: DataFrame, k: int) -> DataFrame:
    """(part, total, lost, potential): arrays by coalition of filters, a coalition being the sum of its bits.

    `lost` holds what a coalition removes (n, good, toxic). `potential` is the Hart-Mas-Colell potential of the
    game in which a coalition is worth what it removes, P(S) = (v(S) + sum of P(S - i) over i in S) / |S|, times k!:
    that makes every one of them a whole number, as P adds up shares of at most k filters.
    """
    coalition = F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("s")
    each = facts.select("part", "mask", *SUMS, coalition)
    hit = F.col("s").bitwiseAND(F.col("mask")) != 0
    worth = each.groupBy("part", "s").agg(F.sum("n").alias("total"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in SUMS])
    games = worth.groupBy("part").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("s", *SUMS))).alias("lost"))

    def grown(p: Column, s: Column) -> Column:
        total = F.get(F.col("lost"), s)["n"] * factorial(k)
        for i in range(k):
            total = total + F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(p, s - (1 << i))).otherwise(0)
        return F.array_append(p, F.call_function("div", total, F.bit_count(s)))

    # in the order of their numbers, each coalition comes after those it contains
    potential = F.aggregate(F.sequence(F.lit(1), F.lit((1 << k) - 1)), F.array(F.lit(0).cast("long")), grown)
    return games.withColumn("potential", potential)


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does to the part's documents.

    kept: left after the step; removed: by this step; redundant: failing its filter, but removed earlier;
    unique_fails: failing its filter and no other; good_lost, toxic_lost: of the removed, those labelled so; shapley:
    what its filter removes, summed over all orders: the grand coalition's potential less that without the filter.
    All others are differences between two coalitions.

    A null text is empty, a null part the empty string. Equal texts are compared over the whole table, whatever
    other filters do; rows of one id don't remove each other, a row without an id is never removed as a copy and
    never removes one. An id with several labels is good (toxic) if one of them says so. Repeated rows count each.
    An empty table gives no rows. `filters` are at most six: orders grow as their factorial.
    """
    names, k = list(filters), len(filters)
    if not 1 <= k <= 6 or list(filters.values()).count(None) > 1:
        raise ValueError("one to six filters, at most one of them for copies")
    steps = [{"filter_order": "".join(o), "step": i + 1, "before": sum(1 << names.index(f) for f in o[:i]), "own": 1 << names.index(o[i])} for o in permutations(names) for i in range(k)]
    shape = "array<struct<filter_order:string,step:int,before:int,own:int>>"
    games = removal_games(failures(docs, labels, filters, id_col, text_col, part_col), k)
    at = games.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), shape)))
    own = F.col("own")
    everything = F.lit((1 << k) - 1)
    worth = lambda s: F.get("lost", s)
    after = F.col("before") + own
    gain = lambda c: worth(after)[c] - worth(F.col("before"))[c]
    return at.select(
        "part", "filter_order", "step", (F.col("total") - worth(after)["n"]).alias("kept"), gain("n").alias("removed"), (worth(own)["n"] - gain("n")).alias("redundant"),
        (worth(everything)["n"] - worth(everything - own)["n"]).alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        (F.get("potential", everything) - F.get("potential", everything - own)).alias("shapley"),
    )
