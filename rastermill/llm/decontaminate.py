"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of benchmark items that one pass over the documents looks for.
BLOCK_CHARS = 4_000_000
BITS = 22
#: Diagonals that are counted at a time, hits that are spread out at a time, and how often a q-gram must stand in an
#: item and in a window to be counted by remainders.
WINDOW, BLOCK_HITS, OFTEN = 1 << 16, 1 << 21, 16


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 8, edit_rate: float = 0.1) -> DataFrame:
    """(doc_id, item_id, start, end, edits): where a document holds an item with few edits.

    Texts are compared in lower case with runs of white space as one space. An item of m characters may
    take k = floor(edit_rate * m) edits (less for short items, so that the count below still decides). By the
    q-gram lemma, a place within k edits shares m - q + 1 - q * k q-grams or more with the item on diagonals
    at most k apart. Distinct places of the item with a shared q-gram are counted in diagonal bands of width
    2k that overlap by half; bands that reach the count are aligned, and places within k edits returned, one a
    band. `start` and `end` count code points of the given text.

    Items under 2q characters are looked for without edits, as whole words: no letter or digit may adjoin
    a letter or digit at their ends (scripts written without spaces, from U+2E80 on, are free of that). All
    of their places are returned.

    Items and texts that are null or blank match nothing. An item without an id is looked for like others, its
    rows hold a null there. Rows of equal ids are looked through each for itself; a document without an id
    keeps null there. The benchmark goes to the tasks in blocks of at most about `BLOCK_CHARS` characters, one
    pass over the documents each, and texts are counted window by window, so that a task's memory is bounded
    however large either is, and however often a text repeats itself.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits int"
    found = None
    for items in _blocks(benchmark, item_col, item_text_col):
        part = src.mapInArrow(lambda batches, items=items: _run(batches, QGramIndex(items.value, q, edit_rate)), schema)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 8, edit_rate: float = 0.1) -> DataFrame:
    """The rows of `docs`, with all columns, in which `find_passages` finds nothing; no row is moved."""
    for items in _blocks(benchmark, item_col, item_text_col):

        def run(batches, items=items):
            index = QGramIndex(items.value, q, edit_rate)
            for b in batches:
                clean = [not (t and index.search(t, first=True)) for t in b.column(text_col).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str):
    """The items, block by block, as broadcast lists of (id, text) of bounded size."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("length(trim(t)) > 0")
    n = -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // BLOCK_CHARS)
    for block in range(n):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block).collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in own])


def _run(batches, index):
    for b in batches:
        rows = [(doc, *hit) for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if text for hit in index.search(text)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "edits"])


def lower_table() -> np.ndarray:
    """Code points up to U+FFFF in lower case, where that is one of them, and white space as a space."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            out[i] = 32
        elif len(x := c.lower()) == 1 and c != x:
            out[i] = ord(x)
    return out


def normalised(text: str, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each stood): lower case, runs of white space as one space."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(raw < 1 << 16, lower[raw & 0xFFFF], raw)
    space = low == 32
    at = np.flatnonzero(~(space & np.r_[False, space[:-1]])) if len(low) else np.zeros(0, np.int64)
    return low[at], at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """One number for each q-gram, of the low bytes of its characters; equal q-grams have equal numbers."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = np.concatenate([codes.astype(np.uint8), np.zeros(16, np.uint8)])
    out = np.empty(-(-n // 8) * 8, np.uint64)
    for r in range(8):
        out[r::8] = np.frombuffer(low[r : r + len(out)].tobytes(), "<u8")
    return out[:n] & np.uint64((1 << 8 * q) - 1)


class QGramIndex:
    def __init__(self, items: list[tuple[int | None, str]], q: int, edit_rate: float):
        self.lower = lower = lower_table()
        self.q, self.items, self.short = q, [], []
        codes, owner, place = [], [], []
        for item, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            c, _ = normalised(text.strip(), lower)
            if len(c) < 2 * q:
                self.short.append((item, c.tobytes().decode("utf-32-le", "surrogatepass")))
                continue
            k = min(int(edit_rate * len(c)), (len(c) - q - 1) // q)
            g = grams(c, q)
            codes.append(g)
            owner.append(np.full(len(g), len(self.items)))
            place.append(np.arange(len(g)))
            self.items.append((item, c, k, len(g) - q * k))
        g, o, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, owner, place))
        order = np.argsort(g, kind="stable")
        self.owner, self.place = o[order], p[order]
        self.codes, self.first = np.unique(g[order].astype(np.uint64), return_index=True)
        self.count = np.diff(np.r_[self.first, len(g)])
        #: How often a q-gram stands in one item at most: entries of one are in order of items.
        number = np.repeat(np.arange(len(self.codes)), self.count)
        new = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (self.owner[1:] != self.owner[:-1])]) if len(number) else np.zeros(0, np.int64)
        self.most = np.zeros(len(self.codes), np.int64)
        np.maximum.at(self.most, number[new], np.diff(np.r_[new, len(number)]))
        self.present = np.zeros(1 << BITS, bool)
        self.present[_slot(self.codes)] = True
        self.width = np.array([max(1, k) for _, _, k, _ in self.items], np.int64)
        self.least = np.array([t for *_, t in self.items], np.int64)
        #: Beyond its own stretch of diagonals a window reads what a band that starts in it may reach.
        self.reach = max((len(c) + 2 * max(1, k) for _, c, k, _ in self.items), default=0)
        self.window = max(WINDOW, self.reach)

    def search(self, text: str, first: bool = False) -> list[tuple[int | None, int, int, int]]:
        """(item, start, end, edits) of each place found; of the first alone if that is asked for."""
        codes, at = normalised(text, self.lower)
        words = None
        found = []
        if self.short:
            words = codes.tobytes().decode("utf-32-le", "surrogatepass")
            found = [(i, int(at[s]), int(at[e - 1]) + 1, 0) for i, s, e in self.exact_short(words, first)]
        if not self.items or first and found:
            return found
        last: dict[int, int] = {}
        for i, b in self.bands(grams(codes, self.q)):  # b: the diagonal that the band starts on
            item, c, k, _ = self.items[i]
            if b < last.get(i, -(1 << 62)):
                continue  # the half of this band that holds a place found already
            if words is None:
                words = codes.tobytes().decode("utf-32-le", "surrogatepass")
            hit = self.align(codes, words, c, b, k)
            if hit:
                s, e, edits = hit
                found.append((item, int(at[s]), int(at[e - 1]) + 1, edits))
                last[i] = s + k + 1
                if first:
                    break
        return found

    def bands(self, g: np.ndarray):
        """(item number, first diagonal of a band) wherever enough places of the item share a q-gram with the text `g` in the band.

        Diagonals are cut into stretches, and the text is read one stretch, and what its bands reach, at a time.
        """
        here = np.flatnonzero(self.present[_slot(g)])
        if len(here):
            slot = np.minimum(np.searchsorted(self.codes, g[here]), len(self.codes) - 1)
            real = self.codes[slot] == g[here]
            here, slot = here[real], slot[real]
        if not len(here):
            return
        low = -self.reach
        while low <= int(here[-1]):
            s, e = np.searchsorted(here, [low, low + self.window + self.reach])
            if e - s >= self.least.min():
                yield from self.counted(here[s:e], slot[s:e], low, low + self.window)
            low += self.window
            if s < len(here) and here[s] > low + self.reach:  # nothing shared for a while
                low += (int(here[s]) - self.reach - low) // self.window * self.window

    def counted(self, here: np.ndarray, slot: np.ndarray, low: int, high: int):
        """Bands that start on a diagonal from `low` to before `high`, in order of items and bands.

        For each place of an item it matters in which bands it is hit, not how often: a text that repeats
        itself hits again and again. Hits are spread out in blocks, each reduced to distinct (place, band).
        """
        base = low - 2 * self.reach  # bands are numbered from the one that this diagonal is in
        span = high - low + 4 * self.reach + 4
        kinds: list[np.ndarray] = []
        heavy = np.zeros(len(slot), bool)
        if (self.most[slot] >= OFTEN).any():
            times = np.bincount(slot, minlength=len(self.codes))
            heavy = (self.most[slot] >= OFTEN) & (times[slot] >= OFTEN)
        light, light_slot = here[~heavy], slot[~heavy]
        ends = np.cumsum(self.count[light_slot])
        if not heavy.any() and ends[-1] <= BLOCK_HITS and not self.may_reach(light, light_slot, base, span):
            return
        at = 0
        while at < len(light):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_HITS, side="right")))
            entry, _, band = self.hits(light[at:to], light_slot[at:to], base)
            key = entry * span + band
            kinds.append(np.unique(np.concatenate([key, key - 1])))
            if len(kinds) > 8:
                kinds = [np.unique(np.concatenate(kinds))]
            at = to
        total: dict[int, np.ndarray] = {}
        if kinds:
            key = kinds[0] if len(kinds) == 1 else np.unique(np.concatenate(kinds))
            pair, shared = np.unique(self.owner[key // span] * span + key % span, return_counts=True)
        else:
            pair, shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in np.unique(slot[heavy]).tolist():
            self.count_repeated(here[heavy & (slot == k)], k, base, span, total)
        out = []
        for i, sums in total.items():
            own = (pair >= i * span) & (pair < (i + 1) * span)
            sums[pair[own] % span] += shared[own]
            enough = np.flatnonzero(sums >= self.least[i])
            out += [(i, int(b)) for b in enough]
        plain = shared >= self.least[pair // span]
        out += [(int(p // span), int(p % span)) for p in pair[plain] if int(p // span) not in total]
        for i, b in sorted(out):
            w = int(self.width[i])
            start = (b + base // w) * w
            if low <= start < high:
                yield i, start

    def hits(self, at: np.ndarray, slot: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of the index that are hit, their items and bands."""
        n = self.count[slot]
        entry = np.repeat(self.first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = self.owner[entry]
        width = self.width[owner]
        return entry, owner, (np.repeat(at, n) - self.place[entry]) // width - base // width

    def may_reach(self, at: np.ndarray, slot: np.ndarray, base: int, span: int) -> bool:
        """Whether any band has hits enough, repeated ones included: most texts end here."""
        _, owner, band = self.hits(at, slot, base)
        half = np.sort(owner * span + band)
        new = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
        key, n = half[new], np.diff(np.r_[new, len(half)])
        beside = np.r_[np.where(key[1:] == key[:-1] + 1, n[1:], 0), 0]
        before = np.r_[0, np.where(key[1:] == key[:-1] + 1, n[:-1], 0)]
        return bool((n + np.maximum(beside, before) >= self.least[key // span]).any())

    def count_repeated(self, at: np.ndarray, k: int, base: int, span: int, total: dict[int, np.ndarray]) -> None:
        """Add the places of items that have the q-gram `k`, which the text has at `at`, to the sums by band.

        Places alike in their remainder by the band's width are hit in bands at equal distances, so those
        are found once for a remainder.
        """
        entries = slice(self.first[k], self.first[k] + self.count[k])
        owners, places = self.owner[entries], self.place[entries]
        for i in np.unique(owners).tolist():
            w, own = int(self.width[i]), places[owners == i]
            if i not in total:
                total[i] = np.zeros(span // w + 4, np.int32)
            sums = total[i]
            for r in np.unique(own % w).tolist():
                half = np.unique((at - r) // w - base // w)
                hit = np.unique(np.concatenate([half, half - 1]))
                for p in own[own % w == r].tolist():
                    sums[hit - p // w] += 1

    def align(self, codes, words, c, band, k):
        """Best place (start, end, edits) on the diagonals of a band, or None beyond k edits."""
        lo, hi = max(0, band - k), band + 2 * max(1, k) + k
        s = words.find(c.tobytes().decode("utf-32-le", "surrogatepass"), lo, hi + len(c) + 1)
        if s >= 0:
            return s, s + len(c), 0
        end, edits = banded(codes, c, band - k, hi, most=k)
        if edits > k:
            return None
        back, _ = banded(codes[:end][::-1], c[::-1], 0, 0, k)
        return max(0, end - back), end, edits

    def exact_short(self, words: str, first: bool = False) -> list[tuple[int | None, int, int]]:
        """(item, start, end) of every place of each short item that is a whole word there."""
        out = []
        for item, c in self.short:
            s = words.find(c)
            while s >= 0:
                e = s + len(c)
                if not (s and _joined(words[s - 1], c[0])) and not (e < len(words) and _joined(c[-1], words[e])):
                    out.append((item, s, e))
                    if first:
                        return out
                s = words.find(c, s + 1)
        return out


def _joined(a: str, b: str) -> bool:
    """Whether two neighbours are of one word, in a script that puts spaces between words."""
    return a.isalnum() and b.isalnum() and a < "\u2e80" and b < "\u2e80"


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def banded(codes: np.ndarray, c: np.ndarray, first: int, last: int, free: int | None = None, most: int | None = None) -> tuple[int, int]:
    """(end, edits) of the cheapest alignment of all of `c` that starts on a diagonal in [first, last].

    Cell t of row i stands for the text before `first + t + i`, so a row of the table is as wide as the
    band. With `free` the alignment starts at 0 and may drift that far to either side. Beyond `most` edits
    the answer is only known to be more.
    """
    pad = 0 if free is None else free
    lo, width = first - pad, last - first + 1 + 2 * pad
    window = np.full(len(c) + width, 0xFFFFFFFF, np.uint32)
    s, e = max(0, lo), min(len(codes), lo + len(window))
    if e > s:
        window[s - lo : e - lo] = codes[s:e]
    t = np.arange(width)
    row = np.zeros(width, np.int64) if free is None else np.abs(t - pad) + np.where(t < pad, 1 << 20, 0)
    for i in range(len(c)):
        best = row + (window[i : i + width] != c[i])
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        row = np.minimum.accumulate(best - t) + t
        if most is not None and i % 16 == 15 and row.min() > most:  # it can only grow from here
            break
    at = int(np.argmin(row))
    return min(max(lo + at + len(c), 1), len(codes)), int(row[at])
