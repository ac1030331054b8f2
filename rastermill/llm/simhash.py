"""SimHash near-duplicate groups found through a Gray-ordered hierarchical index.

Fingerprints of one or more 64-bit words are dealt to buckets by the bits under a few masks. Inside a
bucket they are sorted by Gray rank, so that neighbours differ in few bits; runs of them form leaves and
runs of leaves upper nodes, each of which keeps the bits that all of its members share. Two nodes are
compared by their shared bits first: the differences found there bound every pair below, and pairs of
nodes beyond the limit are left out as a whole. What remains is compared bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import Roots, deal, whole_buckets
from .components import component_ids
from ..sources.shared import save

LEAF, FAN, BLOCK = 16, 16, 1 << 20
#: Buckets beyond this many fingerprints are compared piece by piece, each pair of pieces in a task.
PIECE = 4096


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, longs: int = 1) -> DataFrame:
    """(id, fp): `fp` holds `longs` big-endian 64-bit words of a text's SimHash over word shingles.

    A-Z is lower-cased; words are runs without space and U+0009 to U+000D; a shingle is `words` of them
    joined by a space, repeats included; a text of fewer words is one shingle. The first word of `fp` sums
    XXH64 (seed 42) of the shingles, further ones a mix of it; a bit is set if it is in over half of them.
    A null, empty or blank text has all bits clear.
    """

    def run(batches):
        for x in batches:
            ids, texts = x.columns
            fps = [_fingerprint(t, words, longs) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps, pa.binary())], ["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, fp binary")


def _fingerprint(text: str | None, words: int, longs: int) -> bytes:
    parts = (text or "").encode().lower().split()
    if not parts:
        return bytes(8 * longs)
    joined, ends = b" ".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    width = min(words, len(parts))
    starts = np.concatenate([[0], ends[: len(parts) - width]])
    digest = xxhash.xxh64_intdigest
    first = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64 * longs, np.int64)
    for at in range(0, len(first), 255 * 64):  # bounded memory for any length of text
        h = np.stack([_mix(first[at : at + 255 * 64], k) for k in range(longs)], axis=1)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(first)).tobytes()


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    if k == 0:
        return h
    x = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def exact_masks(radius: int, n: int) -> list[list[int]]:
    """Masks of one 64-bit word such that words within `radius` bits agree under one of them at least.

    The word is cut into more blocks than `radius`; two words that differ in `radius` bits agree in the
    rest of the blocks. More blocks are taken for more fingerprints, so that buckets stay small.
    """
    blocks = radius + 1
    while n > 64 << (64 * (blocks - radius) // blocks) and blocks < radius + 4:
        blocks += 1
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    parts = [((1 << int(e - s)) - 1) << int(s) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
    return [[sum(c)] for c in combinations(parts, blocks - radius)]


def band_masks(longs: int, bits: int) -> list[list[int]]:
    """Masks of `bits` bits of one of `longs` words: runs of neighbours, and bits at equal distances.

    Each word is cut up in both ways, so that every bit is under two masks. Two masks of one word share few
    bits, so that the second way finds most of what the first one misses.
    """
    runs = [((1 << bits) - 1) << s for s in range(0, 64 - bits + 1, bits)]
    step = 64 // bits
    combs = [sum(1 << (step * i + s) for i in range(bits)) for s in range(step)]
    return [[m if i == w else 0 for i in range(longs)] for w in range(longs) for m in runs + combs]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, longs: int = 8, limit: int = 92, masks: list[list[int]] | None = None) -> DataFrame:
    """(doc_id, fp, component_id): groups of texts whose fingerprints are linked.

    Two fingerprints link if they differ in at most `limit` bits and agree under one of `masks`; without
    masks and with one word, masks are chosen by which no link is lost. `component_id` is the smallest id
    that can be reached over links, the row's own included. The defaults are for a similarity of 0.8 of
    five-word shingle sets: the expected share of differing bits there is 0.152, so 512 bits differ in 78
    (standard deviation 8), and agree under one of 64 masks of 16 bits with a chance of 0.99.

    Equal fingerprints form a class; only classes are compared, and each class is named by its smallest
    id, so large groups of copies cost one row. Ids may repeat: such rows are one document with several
    texts. A row without an id has its fingerprint and joins the component of its class, but links nothing.
    An empty table gives an empty table.
    """
    own = save(fingerprints(docs, id_col, text_col, words, longs), "fingerprints")
    classes = save(own.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    named = classes.where("rep is not null")
    if masks is None:
        masks = exact_masks(limit, named.count()) if longs == 1 else band_masks(longs, 16)
    of = component_ids(named.select("rep"), "rep", index_links(named, limit, masks))
    members = save(named.join(of, F.col("rep") == F.col("node")).select(F.col("fp").alias("_fp"), "component_id"), "members")
    return own.join(members, F.col("fp") == F.col("_fp"), "left").select(F.col("id").alias("doc_id"), "fp", "component_id")


def index_links(classes: DataFrame, limit: int, masks: list[list[int]]) -> DataFrame:
    """(a, b) edges that connect all fingerprints of (rep, fp) within `limit` bits that share a bucket.

    Edges span what is linked inside a bucket; they aren't all pairs.
    """
    dealt = classes.select("rep", "fp").mapInArrow(lambda batches: _deal(batches, masks), "key long, rep long, fp binary")
    return deal(dealt, "rep", PIECE).mapInArrow(lambda batches: _search(batches, limit), "a long, b long").distinct()


def _words(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), ">u8").astype(np.uint64).reshape(len(rows), -1)


def _deal(batches, masks):
    for x in batches:
        if not x.num_rows:
            continue
        rep, fp = x.columns
        w = _words(fp)
        keys = []
        for k, mask in enumerate(masks):
            h = np.full(len(w), k + 1, np.uint64)
            for i, m in enumerate(mask):
                if m:
                    h = _mix(h ^ (w[:, i] & np.uint64(m)), i + 1)
            keys.append(h.view(np.int64))
        for k in keys:
            yield pa.RecordBatch.from_arrays([pa.array(k), rep, fp], ["key", "rep", "fp"])


def _search(batches, limit):
    for t, ends in whole_buckets(batches):
        yield from _linked(t, ends, limit)


def _linked(t: pa.Table, ends: np.ndarray, limit: int):
    rep, left, w = t.column("rep").to_numpy(), t.column("left").to_numpy(), _words(t.column("fp"))
    cross = t.column("i").to_numpy() != t.column("j").to_numpy()
    bucket = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    order = np.lexsort([*reversed(_gray_rank(w)), bucket])
    rep, left, cross, w, bucket = rep[order], left[order], cross[order], w[order], bucket[order]
    root = Roots(len(rep))
    leaf = _runs(bucket, LEAF)
    leaf_bits = _shared(w, w, leaf)
    up = _runs(bucket[leaf[:-1]], FAN)
    up_bits = _shared(*leaf_bits, up)
    up_bucket = bucket[leaf[up[:-1]]]
    tops = _runs(up_bucket, 1 << 40)
    for a, b in _pairs_within(tops):
        a, b = _close(up_bits, a, b, limit)
        for c, d in _pairs_between(up, a, b):
            c, d = _close(leaf_bits, c, d, limit)
            for e, f in _pairs_between(leaf, c, d):
                keep = (~cross[e]) | (left[e] != left[f])
                e, f = e[keep], f[keep]
                keep = root.of[e] != root.of[f]
                e, f = e[keep], f[keep]
                near = np.bitwise_count(w[e] ^ w[f]).sum(axis=1, dtype=np.int64) <= limit
                root.join(e[near], f[near])
    moved = np.flatnonzero(root.of != np.arange(len(rep)))
    a, b = rep[moved], rep[root.of[moved]]
    apart = a != b
    if apart.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[apart]), pa.array(np.minimum(a, b)[apart])], ["a", "b"])


def _gray_rank(w: np.ndarray) -> list[np.ndarray]:
    """The place of each word in the reflected Gray sequence, most significant word first."""
    out = []
    for i in range(w.shape[1]):
        x = w[:, i].copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        out.append(x)
    return out


def _runs(group: np.ndarray, most: int) -> np.ndarray:
    """Borders of runs of at most `most` equal neighbours."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    at = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    return np.r_[np.flatnonzero(at % most == 0), len(group)]


def _shared(ones: np.ndarray, some: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run: the bits set in all members, and those set in any."""
    return np.bitwise_and.reduceat(ones, runs[:-1], axis=0), np.bitwise_or.reduceat(some, runs[:-1], axis=0)


def _close(bits, a, b, limit):
    """Pairs of nodes that the bits shared inside each don't tell apart by more than `limit`."""
    ones, some = bits
    least = np.bitwise_count((ones[a] & ~some[b]) | (ones[b] & ~some[a])).sum(axis=1, dtype=np.int64)
    return a[least <= limit], b[least <= limit]


def _pairs_within(runs: np.ndarray):
    """All (a, b), a <= b, of each run, in blocks."""
    size = np.diff(runs)
    item = np.arange(runs[-1])
    end = np.repeat(runs[1:], size)
    yield from _expand(item, item, end - item)


def _pairs_between(runs: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Members (e, f) of each pair of runs; of a run with itself, e < f where members are rows or e <= f."""
    for s in range(0, len(a), BLOCK // (LEAF * FAN)):
        x, y = a[s : s + BLOCK // (LEAF * FAN)], b[s : s + BLOCK // (LEAF * FAN)]
        n = runs[x + 1] - runs[x]
        e = np.repeat(runs[x], n) + _count_up(n)
        own, last = np.repeat(x == y, n), np.repeat(runs[y + 1], n)
        yield from _expand(e, np.where(own, e, np.repeat(runs[y], n)), last - np.where(own, e, np.repeat(runs[y], n)))


def _expand(left: np.ndarray, start: np.ndarray, n: np.ndarray):
    """(left, start), (left, start + 1), ... n of each, in blocks of bounded size."""
    total = np.cumsum(n)
    s = 0
    while s < len(n):
        base = total[s - 1] if s else 0
        e = max(s + 1, int(np.searchsorted(total, base + BLOCK, "right")))
        yield np.repeat(left[s:e], n[s:e]), np.repeat(start[s:e], n[s:e]) + _count_up(n[s:e])
        s = e


def _count_up(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
