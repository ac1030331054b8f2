"""Language of a text by partial matching: a tree of byte contexts for each language, and how short it codes the text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .divergence import terms

#: Bytes of context at most, and labelled rows of a language that its tree is grown from at most, by a hash.
ORDER, MAX_ROWS = 4, 5_000
#: Numbers that the table of ready code lengths holds at most: it only saves time.
MEMO = 1 << 24
#: Bytes that are coded at a time, grams that are counted at a time, and bytes of evidence that a score counts at most.
PIECE, COUNTED, EVIDENCE = 1 << 18, 1 << 21, 64
UNKNOWN = "und"
HASH = np.uint64(0x9E3779B97F4A7C15)


def learnable(id_col: str) -> Column:
    """crc32 of the id as text leaves no 1 when divided by 3; false without an id."""
    return F.coalesce(_part(id_col) != 1, F.lit(False))


def held_out(id_col: str) -> Column:
    return F.coalesce(_part(id_col) == 1, F.lit(False))


def _part(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def streams(texts):
    """(number of the text, bytes): runs of letters and characters beyond ASCII, A-Z in lower case, a blank after
    each. Every piece starts with `ORDER` bytes of context: what came before it, or blanks."""
    for i, text in enumerate(texts):
        before = b" " * ORDER
        for some in terms(text):
            if some:
                piece = before + b" ".join(some) + b" "
                yield i, piece
                before = piece[-ORDER:]


def grams(data: bytes) -> np.ndarray:
    """Each byte after the first `ORDER`, as the last byte of a number that the `ORDER` bytes before it begin."""
    x = np.frombuffer(data, np.uint8)
    out = np.zeros(max(0, len(x) - ORDER), np.uint64)
    for k in range(ORDER + 1):
        out = out << np.uint64(8) | x[k : k + len(out)]
    return out


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows (lang, text)."""

    def counted(of: dict):
        for lang, found in of.items():
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    def run(batches):
        of: dict = {}
        held = 0
        for b in batches:
            langs, texts = (c.to_pylist() for c in b.columns)
            for i, piece in streams(texts):
                of.setdefault(langs[i], []).append(grams(piece))
                held += len(piece)
                if held >= COUNTED:
                    yield from counted(of)
                    of, held = {}, 0
        yield from counted(of)

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted `keys`, and whether they hold what is wanted."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def grow(keys: np.ndarray, counts: np.ndarray) -> list[dict]:
    """The levels of a tree, from no context up to `ORDER` bytes, of sorted grams and their counts.

    A level has its grams and counts; its contexts with `n`, the occurrences, and `t`, the kinds of bytes that
    followed; and `n_left`, `t_left`: what the next shorter context still offers once those kinds are excluded.
    """
    levels: list[dict] = []
    for k in range(ORDER + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        own, inverse = np.unique(keys & mask, return_inverse=True)
        n = np.bincount(inverse, counts, len(own)).astype(np.int64)
        contexts, first = np.unique(own >> np.uint64(8), return_index=True)
        level = {"grams": own, "counts": n, "contexts": contexts, "n": np.add.reduceat(n, first) if len(own) else n, "t": np.diff(np.append(first, len(own)))}
        if not len(own):
            level["n_left"] = level["t_left"] = n
        elif k:
            shorter, at = levels[-1], _find(levels[-1]["grams"], own & (mask >> np.uint64(8)))[0]
            suffix = _find(shorter["contexts"], contexts & (mask >> np.uint64(16)))[0]
            level["n_left"] = shorter["n"][suffix] - np.add.reduceat(shorter["counts"][at], first)
            level["t_left"] = shorter["t"][suffix] - level["t"]
        levels.append(level)
    return levels


def code_lengths(levels: list[dict], wanted: np.ndarray) -> np.ndarray:
    """Bits of each byte after its context: the tree's statistics stay as they are.

    The longest known context is asked first. A byte it knows costs log2((n + t) / count); else an escape of
    log2((n + t) / t) leads to the next shorter one, without the bytes that are excluded by then. What no context
    knows is one of the bytes that remain. So the probabilities of all bytes add up to one.
    """
    bits = np.zeros(len(wanted))
    todo = np.arange(len(wanted))
    n_left = np.full(len(wanted), -1, np.int64)  # not escaped from anywhere yet
    t_left = np.full(len(wanted), -1, np.int64)
    for k in range(ORDER, -1, -1):
        level, mask = levels[k], np.uint64((1 << 8 * (k + 1)) - 1)
        gram = wanted[todo] & mask
        c, known = _find(level["contexts"], gram >> np.uint64(8))
        todo, gram, c, later = todo[known], gram[known], c[known], todo[~known]
        fresh = n_left[todo] < 0
        n, t = np.where(fresh, level["n"][c], n_left[todo]), np.where(fresh, level["t"][c], t_left[todo])
        g, seen = _find(level["grams"], gram)
        bits[todo[seen]] += np.log2((n[seen] + t[seen]) / level["counts"][g[seen]])
        missed = ~seen
        todo, c, n, t = todo[missed], c[missed], n[missed], t[missed]
        bits[todo[t > 0]] += np.log2((n[t > 0] + t[t > 0]) / t[t > 0])
        if k:
            n_left[todo], t_left[todo] = level["n_left"][c], level["t_left"][c]
        todo = np.concatenate([todo, later])
    bits[todo] += np.log2(256 - len(levels[0]["grams"]))
    return bits


def _slots(keys: np.ndarray) -> np.ndarray:
    """Place in `keys` by hashed slot, or -1; about a quarter of the slots are taken, and a taken one leads to the next."""
    size = 1 << max(4, int(4 * len(keys) - 1).bit_length()) if len(keys) else 16
    slots, shift = np.full(size, -1, np.int32), np.uint64(64 - size.bit_length() + 1)
    left, at = np.arange(len(keys), dtype=np.int32), (keys * HASH >> shift).astype(np.int64)
    while len(left):
        free = slots[at] < 0
        slots[at[free]] = left[free]
        lost = slots[at] != left
        left, at = left[lost], (at[lost] + 1) & (size - 1)
    return slots


def compiled(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    """A model of plain arrays: trees by language, and ready code lengths in all languages of the grams they know.

    Were there too many, those of the most frequent stay ready; others are worked out when they occur.
    """
    trees = [grow(*counts[x]) for x in langs]
    keys, at = np.unique(np.concatenate([counts[x][0] for x in langs] or [np.zeros(0, np.uint64)]), return_inverse=True)
    if len(keys) * len(langs) > MEMO:
        n = np.bincount(at, np.concatenate([counts[x][1] for x in langs]))
        keys = np.sort(keys[np.argsort(-n, kind="stable")[: MEMO // len(langs)]])
    ready = np.stack([code_lengths(t, keys) for t in trees], axis=1) if langs else np.zeros((0, 0))
    return {"langs": langs, "trees": trees, "keys": keys, "ready": ready, "slots": _slots(keys)}


def lengths(model: dict, wanted: np.ndarray) -> np.ndarray:
    """Code lengths of grams, a column for each language."""
    keys, slots = model["keys"], model["slots"]
    place = np.full(len(wanted), -1, np.int32)
    if len(keys):
        left, at = np.arange(len(wanted)), (wanted * HASH >> np.uint64(64 - len(slots).bit_length() + 1)).astype(np.int64)
        while len(left):
            found = slots[at]
            hit = keys[found] == wanted[left]  # an empty slot, -1, asks for the last key: harmless
            place[left[hit]] = found[hit]
            on = ~hit & (found >= 0)
            left, at = left[on], (at[on] + 1) & (len(slots) - 1)
    out = model["ready"][place] if len(keys) else np.zeros((len(wanted), len(model["langs"])))
    missed = np.flatnonzero(place < 0)
    for k, tree in enumerate(model["trees"] if len(missed) else []):
        out[missed, k] = code_lengths(tree, wanted[missed])
    return out


def text_lengths(model: dict, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text in each language, and the number of bytes that were coded."""
    bits, n = np.zeros((len(texts), len(model["langs"]))), np.zeros(len(texts), np.int64)
    held: list[tuple[int, bytes]] = []

    def code():
        each = lengths(model, grams(b"".join(p for _, p in held)))
        start = 0
        for i, p in held:
            bits[i] += each[start : start + len(p) - ORDER].sum(0)
            n[i] += len(p) - ORDER
            start += len(p)

    size = 0
    for i, piece in streams(texts):
        held.append((i, piece))
        size += len(piece)
        if size >= PIECE:
            code()
            held, size = [], 0
    if held:
        code()
    return bits, n


def predictions(model: dict, texts: list) -> tuple[list[str], np.ndarray]:
    """The language that codes each text shortest (of equal ones the first), and how far ahead of others it is, 0 to 1."""
    langs = model["langs"]
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    bits, n = text_lengths(model, texts)
    best = bits.argmin(1)
    ahead = (bits - bits.min(1, keepdims=True)) * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
    score = 1 / np.exp2(-ahead).sum(1)
    spoken = [t is not None and any(map(str.isalpha, t)) for t in texts]
    return [langs[b] if s else UNKNOWN for b, s in zip(best, spoken, strict=True)], np.where(spoken, score, 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> dict:
    """A model of the learnable rows of `docs` that have a lang and a text, about `max_rows` of each lang at most."""
    known = docs.where(learnable(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)).alias("_h"))
    n_of = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    full = [(x, (1 << 20) * max_rows // n) for x, n in n_of.items() if n > max_rows]
    if full:
        bound = F.broadcast(docs.sparkSession.createDataFrame(full, "_lang string, _bound long"))
        rows = rows.join(bound, F.col("lang") == F.col("_lang"), "left").where(F.col("_bound").isNull() | (F.col("_h") < F.col("_bound")))
    found = gram_counts(rows.select("lang", "text")).toArrow().to_pandas()
    counts = {}
    for lang, own in found.groupby("lang"):
        own = own.sort_values("gram")
        counts[lang] = own["gram"].to_numpy(np.uint64), own["n"].to_numpy(np.int64)
    return compiled(sorted(counts), counts)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs`.

    Trees are grown from about `max_rows` rows a language at most, whole texts, chosen by a hash of id and text
    among those whose crc32 of the id doesn't leave 1 when divided by 3; every row is then scored, by all of its
    text. Grams of those rows, added up in Spark, come to the driver: at most what so many texts hold. `score` is the
    language's share of all languages' probabilities of the text, as if it had 64 bytes where it has more.

    A null text, or one without a letter, is `und` with score 0, and so is every text when there was nothing to
    learn from. Rows without an id or lang are scored, but teach nothing. Repeated rows count each. Of languages that
    code a text equally short the first by name is taken. An empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, max_rows))

    def run(batches):
        for b in batches:
            ids, held, texts = b.columns
            langs, scores = predictions(model.value, texts.to_pylist())
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
