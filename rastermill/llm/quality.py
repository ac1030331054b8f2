"""Quality scores: random Fourier features of text statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save

#: Labelled rows a model is fitted on at most, chosen by a hash of the id.
MAX_ROWS = 400_000
#: Rows that calibrate alone; with fewer, all labelled rows do.
LEAST_CHECKS = 50
#: Tasks that sum normal equations; each sends one matrix to the driver.
TASKS = 12
SYMBOLS = b"|%#$*&!?.,;:-_=+<>()[]{}@/\\\"'"


def statistics(text: str | None) -> np.ndarray:
    """What a text looks like as numbers; it costs one pass over bytes and one over words."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digit = seen[97:123].sum(), seen[65:91].sum(), seen[48:58].sum()
    high, blank, breaks = seen[128:].sum(), seen[32] + seen[9:14].sum(), seen[10]
    symbols = seen[list(SYMBOLS)]
    words = raw.lower().split()
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds = len(set(words))
    lines = raw.lower().split(b"\n")
    loud = upper / max(1, upper + lower)
    return np.array(
        [
            np.log1p(len(raw)), np.log1p(len(words)), lower / n, loud, digit / n, high / n, blank / n, np.log1p(breaks), len(words) / max(1, breaks + 1) ** 0.5,
            sizes.mean(), sizes.std(), np.log1p(sizes.max()), (sizes <= 3).mean(), (sizes >= 12).mean(), kinds / k, np.log1p(kinds), len(set(lines)) / len(lines),
            np.log1p(symbols.sum() / n * 100), *np.log1p(symbols[:12] / k * 10), (symbols > 0).mean(), seen[46] / k,
        ]
    )


N_STATISTICS = 32


@dataclass
class QualityModel:
    """A fitted scorer. `weights` is None where there was nothing to learn from: `knots[1]` is the score."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.weights is None else self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def held_out(id_col: str):
    """crc32 of the id as text leaves 2 when divided by 4; false without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) for each row."""

    def run(batches):
        for b in batches:
            ids, texts = b.columns
            x = [statistics(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, x array<double>")


def usable_labels(labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, y, checks) of at most about `max_rows` ids that a model may be fitted on: those of the smallest hashes.

    Labels of an id that occurs more than once are averaged; held-out ids and null labels and ids don't count.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    usable = save(known.where(~held_out("doc_id")).select("doc_id", "y", (part == 3).alias("checks")), "usable-labels")
    n = usable.count()
    return usable if n <= max_rows else usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))


def fit_quality(stats: DataFrame, usable: DataFrame, n_features: int = 320, width: float = 4.0, ridge: float = 1e-3, seed: int = 17) -> QualityModel:
    """Fit on `text_statistics` of the documents that `usable_labels` tells, or of all.

    Those whose crc32 leaves 3 calibrate and the rest fit. Where fewer than `LEAST_CHECKS` calibrate, or all of one
    label, those that fit calibrate too: so few say little about a curve. Without usable labels the score is 1
    for every text, and with one kind of label that label.
    """
    train = save(stats.join(usable, F.col("id") == F.col("doc_id")).select("id", "x", "y", "checks"), "labelled")
    n, least, most = train.agg(F.count("*"), F.min("y"), F.max("y")).first()
    rng = np.random.default_rng(seed)
    flat = QualityModel(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), rng.normal(0, 1 / width, (N_STATISTICS, n_features)), rng.uniform(0, 2 * np.pi, n_features), None, (np.array([0.0, 1.0]), np.ones(2)))
    if not n or least == most:
        flat.knots = (np.array([0.0, 1.0]), np.full(2, float(least) if n else 1.0))
        return flat
    train = train.repartition(TASKS)
    sums = _gather(train, lambda x, y, c: [np.r_[len(x), x.sum(0), (x * x).sum(0)]])
    m, s = sums[0][1 : N_STATISTICS + 1] / sums[0][0], sums[0][N_STATISTICS + 1 :] / sums[0][0]
    flat.mean, flat.scale = m, np.sqrt(np.maximum(s - m * m, 1e-9))

    def equations(x, y, checks):
        f, t = flat.features(x[~checks]), y[~checks]
        return [(f.T @ f).ravel(), f.T @ t]

    gram, moment = _gather(train, equations)
    gram = gram.reshape(n_features + 1, -1)
    model = QualityModel(flat.mean, flat.scale, flat.directions, flat.phases, np.linalg.solve(gram + ridge * max(1.0, gram[-1, -1]) / 100 * np.eye(len(gram)), moment), flat.knots)
    bins = np.linspace(-0.5, 1.5, 513)

    def counts(x, y, checks):
        at = np.clip(np.digitize(model.raw(x), bins) - 1, 0, 511)
        return [np.bincount(at[c], w, 512) for c in (checks, ~checks) for w in (np.ones(c.sum()), y[c])]

    n_checks, y_checks, n_fit, y_fit = _gather(train, counts)
    if n_checks.sum() < LEAST_CHECKS or y_checks.sum() in (0, n_checks.sum()):
        n_checks, y_checks = n_checks + n_fit, y_checks + y_fit
    model.knots = isotonic((bins[:-1] + bins[1:]) / 2, y_checks, n_checks)
    return model


def _gather(train: DataFrame, sums) -> list[np.ndarray]:
    """Add up, over tasks, the arrays that `sums` makes of each batch."""

    def run(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            got = sums(x, b.column("y").to_numpy(), b.column("checks").to_numpy(zero_copy_only=False))
            total = got if total is None else [p + q for p, q in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(t, "<f8").tobytes() for t in total], pa.binary()), pa.array(range(len(total)), pa.int32())], ["sums", "i"])

    out: dict[int, np.ndarray] = {}
    for r in train.select("x", "y", "checks").mapInArrow(run, "sums binary, i int").collect():
        out[r["i"]] = out.get(r["i"], 0) + np.frombuffer(bytes(r["sums"]), "<f8")
    return [out[i] for i in sorted(out)]


def isotonic(at: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing means of total / n, pooled from the left where they would fall."""
    pools: list[list[float]] = []
    for x, t, k in zip(at[n > 0], total[n > 0], n[n > 0], strict=True):
        pools.append([x, x, t, k])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, t2, k2 = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + t2, pools[-1][3] + k2]
    xs = [v for lo, hi, _, _ in pools for v in (lo, hi)]
    ys = [t / k for _, _, t, k in pools for _ in (0, 1)]
    return np.array(xs), np.array(ys)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`, empty and null texts too.

    The model is `fit_quality`'s; where fewer than `LEAST_CHECKS` labelled rows were set aside to calibrate it, all do.
    """
    stats = save(text_statistics(docs, id_col, text_col), "statistics")
    model = fit_quality(stats, usable_labels(labels))

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(x) if len(x) else np.zeros(0))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, with all columns, whose score is at least `threshold`; no row is moved.

    The model is fitted on labelled documents alone. Their ids are at most about `MAX_ROWS`, 16 bytes each, so
    they go to all tasks, which take statistics of what they tell and, later, of every document that is scored.
    """
    usable = usable_labels(labels)
    known = F.broadcast(usable.select(F.col("doc_id").alias("known")))
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, F.col("id") == F.col("known"), "left_semi")
    model = fit_quality(text_statistics(told, "id", "text"), usable)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t) for t in b.column(text_col).to_pylist()])
                yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
