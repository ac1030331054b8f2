"""Near-duplicate vectors of one label by tiled comparison along principal axes."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import Roots, deal, whole_buckets
from .components import component_ids
from ..sources.shared import save

#: Distinct vectors that the principal axes are fitted on at most, and the tasks that sum their moments.
SAMPLE, TASKS = 100_000, 8
#: Vectors of a label and cell that meet in one task; rows of a tile; axes added at a time; leading axes that make cells.
PIECE, TILE, STEP, CELL_AXES = 4096, 512, 16, 2
SLACK = 1e-9


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors of equal label link if their cosine, in double precision, is at least `threshold`. `n_links`
    counts the other rows linked directly, `component_id` is the smallest id that links reach, the row's
    own included, and `kept` marks the row that names its component. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without a label or an id, link with nothing; vectors of
    different lengths don't link either.

    Equal vectors of a label are one class, compared once and counted as often as they occur. Rows of one
    id count as one node in components. The principal axes come from a bounded sample and decide only how
    fast pairs are ruled out, never which. An empty table gives an empty table.
    """
    v, own_label = F.col(vector_col), F.col(label_col).cast("string")
    clean = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.coalesce(F.col(id_col).isNotNull() & own_label.isNotNull() & (F.size(v) > 0) & clean & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), own_label.alias("label"), F.when(usable, v.cast("array<double>")).alias("v"))
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v", "label")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v", "label"))})
    classes = save(rows.where("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")), "vectors")
    found = save(_search_all(classes, threshold), "vector-links")
    links = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    of = component_ids(classes.select("rep"), "rep", found.select("a", "b"))
    told = classes.select("h1", "h2", "rep", "n").join(links, ["h1", "h2"], "left").join(of, F.col("rep") == F.col("node")).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "h1", "h2").join(save(told, "classes"), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length in a bounded sample: orthonormal axes, the most varied first."""
    n = classes.count()
    some = classes if n <= SAMPLE else classes.where(F.pmod(F.col("h2"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n))

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for u in _by_length(b.column("v")):
                x = _unit(u[1])
                total[x.shape[1]] = total.get(x.shape[1], 0) + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["d", "m"])

    moments: dict[int, np.ndarray] = {}
    for r in some.select("v").repartition(TASKS).mapInArrow(run, "d int, m binary").collect():
        moments[r["d"]] = moments.get(r["d"], 0) + np.frombuffer(bytes(r["m"]), np.float64).reshape(r["d"], -1)
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in moments.items()}


def _by_length(column):
    """(row numbers, matrix) for each vector length of an Arrow list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _search_all(classes: DataFrame, threshold: float) -> DataFrame:
    """(h1, h2, links, a, b): for classes with links, how many rows they link to, and an edge (a, b) to a
    class they are connected with. Edges span what is connected; they aren't all pairs."""
    axes = classes.sparkSession.sparkContext.broadcast(principal_axes(classes))
    # unit vectors within the threshold are at most this far apart, on every axis
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    ahead = [o for o in product((-1, 0, 1), repeat=CELL_AXES) if o > (0,) * CELL_AXES]

    def deal_cells(batches):
        for b in batches:
            for at, x in _by_length(b.column("v")):
                t = pa.Table.from_batches([b]).take(pa.array(at))
                y = _unit(x) @ axes.value.get(x.shape[1], np.eye(x.shape[1]))
                cells = np.floor(y[:, :CELL_AXES] / width).astype(np.int64)
                cells = np.hstack([cells, np.zeros((len(x), CELL_AXES - cells.shape[1]), np.int64)])
                label = np.array([hash_text(s) for s in t.column("label").to_pylist()], np.uint64)
                for o in [(0,) * CELL_AXES, *ahead]:
                    key = label * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1])
                    for c in range(CELL_AXES):
                        key = (key ^ (cells[:, c] + o[c]).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                        key ^= key >> np.uint64(29)
                    guest = np.full(len(x), any(o))
                    yield from pa.table([pa.array(key.view(np.int64)), pa.array(guest), *(t.column(c) for c in ("h1", "h2", "rep", "n", "label", "v"))], ["key", "guest", "h1", "h2", "rep", "n", "label", "v"]).combine_chunks().to_batches()

    dealt = classes.mapInArrow(deal_cells, "key long, guest boolean, h1 long, h2 long, rep long, n long, label string, v array<double>")

    def search(batches):
        for t, ends in whole_buckets(batches):
            t = t.combine_chunks()
            for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if e - s > 1:
                    yield from _bucket(t.slice(s, e - s), axes.value, threshold)

    return deal(dealt, "h1", PIECE).mapInArrow(search, "h1 long, h2 long, links long, a long, b long")


def hash_text(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s)


def _bucket(t: pa.Table, axes, threshold: float):
    label = np.array(t.column("label").to_pylist())
    v = t.column("v").combine_chunks()
    for at, x in _by_length(v):
        for name in np.unique(label[at]).tolist():  # one label and length, but for rare equal keys
            own = np.flatnonzero(label[at] == name)
            if len(own) > 1:
                yield from _tiles(t.take(pa.array(at[own])), x[own], axes, threshold)


def _tiles(t: pa.Table, x: np.ndarray, axes, threshold: float):
    y = _unit(x) @ axes.get(x.shape[1], np.eye(x.shape[1]))
    order = np.argsort(y[:, 0], kind="stable")
    t, x, y = t.take(pa.array(order)), x[order], y[order]
    guest, left, rep, n = (t.column(c).to_numpy() for c in ("guest", "left", "rep", "n"))
    cross = t.column("i")[0] != t.column("j")[0]
    norm = np.sqrt((x * x).sum(axis=1))
    rest = np.sqrt(np.maximum(0, np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]))  # norms from axis k on
    rest = np.hstack([rest, np.zeros((len(y), 1))])
    links, roots, reach = np.zeros(len(x), np.int64), Roots(len(x)), np.sqrt(2 - 2 * threshold) + SLACK
    for s in range(0, len(x), TILE):
        for u in range(s, len(x), TILE):
            a, b = slice(s, s + TILE), slice(u, u + TILE)
            if y[b][0, 0] - y[a][-1, 0] > reach:
                break
            ok = ~(guest[a][:, None] & guest[b][None, :])
            if cross:
                ok &= left[a][:, None] != left[b][None, :]
            if s == u:
                ok &= np.arange(len(y[a]))[:, None] < np.arange(len(y[b]))[None, :]
            i, j = _candidates(y[a], y[b], rest[a], rest[b], ok, threshold - SLACK)
            i, j = i + s, j + u
            if len(i):
                near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold * norm[i] * norm[j]
                i, j = i[near], j[near]
                links += np.bincount(i, n[j], len(x)).astype(np.int64) + np.bincount(j, n[i], len(x)).astype(np.int64)
                roots.join(i, j)
    some = np.flatnonzero(links)
    if len(some):
        yield from t.take(pa.array(some)).select(["h1", "h2"]).append_column("links", pa.array(links[some])).append_column("a", pa.array(rep[some])).append_column("b", pa.array(rep[roots.of[some]])).combine_chunks().to_batches()


def _candidates(a, b, rest_a, rest_b, ok, least):
    """Pairs of two tiles whose cosine may reach `least`.

    Products are summed over a few leading axes at a time. What the remaining axes can add is at most the
    product of the two suffix norms; when no pair can reach the threshold any more the tile is done, and
    when few can, only those go on.
    """
    d, total = a.shape[1], np.zeros(ok.shape)
    for k in range(0, d, STEP):
        e = min(k + STEP, d)
        total += a[:, k:e] @ b[:, k:e].T
        ok &= total + rest_a[:, e, None] * rest_b[None, :, e] >= least
        alive = np.count_nonzero(ok)
        if alive == 0:
            break
        if alive * 20 < ok.size:
            i, j = np.nonzero(ok)
            part = total[i, j]
            for k2 in range(e, d, STEP):
                e2 = min(k2 + STEP, d)
                part = part + np.einsum("ij,ij->i", a[i, k2:e2], b[j, k2:e2])
                keep = part + rest_a[i, e2] * rest_b[j, e2] >= least
                i, j, part = i[keep], j[keep], part[keep]
            return i, j
    return np.nonzero(ok)
