"""Operators on documents: against brute force, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rastermill.llm import decontaminate, lines, packing, quality, simhash, tokens, wordpiece
from rastermill.llm.components import component_ids
from rastermill.llm.queries import ORACLES, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "no id at all"), (5, "x " * 40_000), (6, "Ünïcode ñandú 漢字 \U0001f600 end"), (7, "a\n" * 2000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "k", 1) for r in ODD], DOCS + ", _id string, n_lines int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(rng, n, kinds=500):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


# ---------------------------------------------------------------- components


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(300, 340)] + [(7, 7), (None, 3)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    nodes = list(range(1100))
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            of[max(x, y)] = min(x, y)
    got = component_ids(spark.createDataFrame([(n,) for n in nodes], "v long"), "v", spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component_id"] for r in got.collect()} == {n: root(n) for n in nodes}


# ---------------------------------------------------------------- op10


def plain_line_dedup(rows):
    held = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = {}
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        n = len((t or "").split("\n"))
        out[i] = (n, n - len(kept), "\n".join(kept))
    return out


def test_line_dedup_equals_plain(spark):
    rng = random.Random(2)
    pool = [words(rng, 5) + "." * rng.randrange(3) for _ in range(12)] + ["short", "", "   "]
    rows = [(i, "\n".join((" " * rng.randrange(2)) + rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)] + [(90, None), (91, "")]
    got = lines.dedup_lines(spark.createDataFrame(rows, DOCS))
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == plain_line_dedup(rows)


def test_line_dedup_odd_inputs(spark, odd, none):
    got = lines.dedup_lines(odd)
    assert got.columns == ["doc_id", "text", "_id", "n_lines", "n_dropped"] and got.count() == len(ODD)
    assert {(r["doc_id"], r["n_lines"]) for r in got.collect()} >= {(1, 1), (2, 1), (7, 2001)}
    assert lines.dedup_lines(none).count() == 0


def test_lines_count_distinct_documents(spark):
    line, other = "the very same line that is long", "another line that is long enough"
    two = spark.createDataFrame([(i, line) for i in (1, 2, 2, None)], DOCS)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(two).collect()) == [(0, line), (1, line), (2, line), (2, line)]
    rows = [(1, f"x\n{line}"), (1, f"{line}\n{other}\ny"), (2, line), (3, f"{line}\n{line}\nz"), (None, line)]
    got = sorted((r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, line, 0), (1, f"{other}\ny", 1), (1, "x", 1), (2, "", 1), (3, f"{line}\n{line}\nz", 0)]


def test_lines_of_one_document_many_dropped(spark):
    """Every second line of a long text recurs: the slices between them are what stays."""
    common = [f"recurring line number {i} of many" for i in range(3000)]
    text = "\n".join(x for i, c in enumerate(common) for x in (c, f"own {i}"))
    rows = [(1, text), (2, "\n".join(common)), (3, "\n".join(reversed(common)))]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (6000, 3000, "\n".join(f"own {i}" for i in range(3000))), 2: (3000, 3000, ""), 3: (3000, 0, rows[2][1])}


# ---------------------------------------------------------------- op5


def plain_fingerprint(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    sh = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def near_copies(rng, n):
    rows, i = [], 0
    for _ in range(n):
        base = words(rng, rng.randrange(1, 120)).split()
        for _ in range(rng.choice((1, 1, 2, 6))):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(500)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def test_simhash_equals_brute_force(spark):
    rows = near_copies(random.Random(3), 90) + [(9001, None), (9000, ""), (9002, "A  b\tC d e"), (9003, "a b c d e")]
    want = {i: plain_fingerprint(t, 4) for i, t in rows}
    of = {i: i for i in want}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in want:
        for b in want:
            if a < b and (want[a] ^ want[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), words=4, longs=1, limit=4).select("doc_id", F.lower(F.hex("fp")).alias("f"), "component_id").collect()
    assert {r["doc_id"]: (int(r["f"], 16), r["component_id"]) for r in got} == {i: (want[i], root(i)) for i in want}


def test_index_loses_no_link_in_hot_buckets(spark, monkeypatch):
    """Dense groups, cut into pieces, against all pairs."""
    monkeypatch.setattr(simhash, "PIECE", 40)
    rng = np.random.default_rng(4)
    fps = set()
    for centre in rng.integers(0, 1 << 62, 12):
        for _ in range(25):
            f = int(centre)
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    rows = [(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(fps)]
    for radius in (2, 4):
        edges = simhash.index_links(spark.createDataFrame(rows, "rep long, fp binary"), radius, simhash.exact_masks(radius, len(rows)))
        got = component_ids(spark.createDataFrame(rows, "rep long, fp binary"), "rep", edges)
        of = list(range(len(fps)))

        def root(i, of=of):
            while of[i] != i:
                i = of[i]
            return i

        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= radius:
                    x, y = root(a), root(b)
                    of[max(x, y)] = min(x, y)
        assert {r["node"]: r["component_id"] for r in got.collect()} == {i: root(i) for i in range(len(fps))}


def test_masks_cover_every_pair_in_reach():
    rng = random.Random(5)
    for n in (10, 10**6, 10**9):
        masks = simhash.exact_masks(4, n)
        for _ in range(200):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(d & m[0] == 0 for m in masks)


def test_every_bit_is_under_two_masks():
    masks = simhash.band_masks(8, 16)
    assert len(masks) == 64 and all(sum(m.bit_count() for m in mask) == 16 for mask in masks)
    for w in range(8):
        assert all(sum(mask[w] >> b & 1 for mask in masks) == 2 for b in range(64))


def test_pairs_at_the_threshold_share_a_mask_and_the_limit():
    """Shingle sets of which 9 in 10 elements are common: a similarity of 0.82."""
    rng = np.random.default_rng(8)
    masks = np.array([[m & 0xFFFFFFFFFFFFFFFF for m in mask] for mask in simhash.band_masks(8, 16)], np.uint64)
    found = 0
    for _ in range(300):
        h = rng.integers(0, 1 << 63, 440, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 440, dtype=np.uint64)
        bits = np.unpackbits(np.stack([simhash._mix(h, k) for k in range(8)], 1).astype(">u8").view(np.uint8).reshape(440, -1), axis=1)
        a, b = (np.packbits(2 * bits[s].sum(0) > 400).view(">u8").astype(np.uint64) for s in (slice(0, 400), slice(40, 440)))
        apart = a ^ b
        found += np.bitwise_count(apart).sum() <= 92 and bool(((apart & masks) == 0).all(1).any())
    assert found >= 270


def test_similar_texts_form_groups(spark):
    rng = random.Random(6)
    rows = []
    for g in range(20):
        base = words(rng, 300, 5000).split()
        for c in range(3):
            w = list(base)
            for _ in range(2 * c):
                w[rng.randrange(len(w))] = "changed"
            rows.append((10 * g + c, " ".join(w)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), words=5).collect()
    assert all(r["component_id"] == r["doc_id"] - r["doc_id"] % 10 for r in got)


def test_simhash_odd_inputs(odd, none):
    got = simhash.near_duplicates(odd, words=4, longs=1, limit=4).collect()
    assert len(got) == len(ODD)
    blank = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert all(bytes(r["fp"]) == bytes(8) and r["component_id"] == 1 for r in blank)
    assert simhash.near_duplicates(none).count() == 0


# ---------------------------------------------------------------- op4 and op6


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizer(tokenizer):
    with open(tokenizer_path(), encoding="utf-8") as f:
        bpe = tokens.ByteBpe(f.read(), piece=40)
    rng = random.Random(7)
    texts = ["", " ", "  a  b ", "\n\nx \n y", "don't  we'll\tgo", "a<|endoftext|>b", "ñandú 漢字 x   y", "tail ", "1 234 5,6", "  a  b"] + ["".join(rng.choice("ab1 .\n'é ") for _ in range(60)) for _ in range(300)]
    rare = [chr(c) for c in (*range(1, 33), 0x7F, 0x85, 0xA0, 0xAD, 0x300, 0x1680, 0x2003, 0x2028, 0x200B, 0x3000, 0xFEFF, 0x1F600, 0x10FFFF)]
    texts += ["".join(rng.choice(rare) if rng.random() < 0.3 else rng.choice("  abcZ9'sl-漢") for _ in range(rng.randrange(1, 200))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing_round_trip(spark, tokenizer, odd):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op4_packing"](spark, SF).toPandas()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= 1024 and (1024 - sizes).sum() <= 1024 * spark.read.parquet(f"{SF}/documents.parquet").rdd.getNumPartitions()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]]
    for i, d in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(docs[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert d.doc_tokens.eq(len(ids)).all() and d.start.tolist() == [0, *d.length.cumsum()[:-1]] and d.length.sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(d.start, d.length, strict=True)] == d.ids_crc32.tolist()
    assert set(got.doc_id) == set(docs)
    pieces = packing.pack(odd, tokenizer_path()).toPandas()
    assert pieces[pieces.doc_id == 1].length.tolist() == [1] and len(pieces[pieces.doc_id == 4]) >= 2


def test_packer_leaves_one_short_window():
    rng = random.Random(8)
    p = packing.Packer(64)
    total = most = 0
    for i in range(5000):
        n = rng.randrange(1, 150)
        p.add(i, np.full(n, i, "<u4").tobytes())
        total += n
        most = max(most, sum(map(len, p.open.values())))
    assert most < 200
    p.close()
    sizes = defaultdict(int)
    for _, _, n, ids, _, seq, offset in p.done:
        assert len(ids) == 4 * n and offset == sizes[seq]
        sizes[seq] += n
    assert sum(sizes.values()) == total and max(sizes.values()) <= 64 and sum(v < 64 for v in sizes.values()) <= 1


def test_placement_has_the_least_sum_of_squares():
    rng = random.Random(14)
    p = packing.Packer(16)
    for _ in range(3000):
        p.levels[1:16] = [rng.choice((0, 0, 1, 2, 5)) for _ in range(15)]
        size = rng.randrange(1, 16)

        def after(level, size=size):
            n = p.levels[1:16].tolist()
            if level:
                n[level - 1] -= 1
            if level + size < 16:
                n[level + size - 1] += 1
            return sum(x * x for x in n)

        open_to = [0] + [level for level in range(1, 16 - size + 1) if p.levels[level]]
        assert p.best(size) == max(open_to, key=lambda level: (-after(level), level))


def greedy(pieces, word):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_counts_what_greedy_matching_gives():
    rng = random.Random(9)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))).encode() for _ in range(rng.randrange(1, 25))}
        automaton = wordpiece.build(pieces)
        for _ in range(100):
            w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))).encode()
            assert wordpiece.count_pieces(automaton, w) == greedy(pieces, w), (pieces, w)


def test_token_counts(spark, odd, none):
    with open(tokenizer_path(), encoding="utf-8") as f:
        pieces = set(tokens.vocabulary(f.read()))
    docs = {r["doc_id"]: (r["text"] or "").encode().split()[:400] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(15).collect()}
    short = spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in docs.items()], DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in wordpiece.token_counts(short, tokenizer_path()).collect()}
    assert got == {i: (len(w), sum(greedy(pieces, b" " + x) for x in w)) for i, w in docs.items()}
    assert wordpiece.token_counts(odd, tokenizer_path()).count() == len(ODD) and wordpiece.token_counts(none, tokenizer_path()).count() == 0


# ---------------------------------------------------------------- op2


def test_quality_on_held_out_rows(spark):
    got = QUERIES["op2_quality"](spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert ((got.score >= 0) & (got.score <= 1) & (got.predicted == (got.score >= 0.7))).all()
    m = got[got.held_out].merge(labels, on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.98
    assert (m[m.quality == 1].predicted == 1).mean() > 0.99


def test_quality_never_reads_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score_quality(docs, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert np.allclose(a.score, b.score)


def test_quality_odd_inputs(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    got = quality.score_quality(odd, labels)
    assert got.count() == len(ODD) and got.where("score is null or held_out is null").count() == 0
    assert quality.score_quality(none, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {1.0}
    kept = {r["doc_id"] for r in quality.keep_good(odd, labels).collect()}
    assert kept == {r["doc_id"] for r in quality.score_quality(odd, labels).where("predicted = 1").collect()}
    assert quality.keep_good(odd, labels.limit(0)).count() == len(ODD) and quality.keep_good(odd, labels).columns == odd.columns


def test_isotonic_equals_plain_pooling():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = rng.integers(0, 5, 50).astype(float)
        y = np.minimum(n, rng.integers(0, 5, 50))
        x, v = quality.isotonic(np.arange(50.0), y, n)
        assert (np.diff(v) >= 0).all() and (np.diff(x) >= 0).all()
        some = np.flatnonzero(n)
        got = np.interp(some, x, v)
        assert np.isclose((got * n[some]).sum(), y.sum())
        # the least-squares fit of a non-decreasing curve: the greatest of least means of stretches
        want = [max(min(y[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, 50) if n[i : j + 1].sum()) for i in range(k + 1) if n[i : k + 1].sum()) for k in some]
        assert np.allclose(got, want)


def test_weights_equal_a_dense_solve(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats, usable = quality.text_statistics(docs), quality.usable_labels(labels)
    model = quality.fit_quality(stats, usable, n_features=40)
    rows = docs.join(labels, "doc_id").where(~quality.held_out("doc_id")).select("doc_id", "text", "quality").collect()
    x = np.array([quality.statistics(r["text"]) for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum(x.var(0), 1e-9)), rtol=1e-4)
    fits = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 4 != 3 for r in rows])
    f, y = model.features(x[fits]), np.array([float(r["quality"]) for r in rows])[fits]
    assert f.shape == (fits.sum(), 41) and np.allclose(np.linalg.norm(f[:, :-1], axis=1) ** 2, 1, atol=0.6)
    ridge = np.sqrt(1e-3 * len(y) / 100)
    want, *_ = np.linalg.lstsq(np.vstack([f, ridge * np.eye(41)]), np.r_[y, np.zeros(41)], rcond=None)
    assert np.allclose(model.weights, want, atol=1e-6)
    few = quality.usable_labels(labels, max_rows=50)
    assert 20 <= few.count() <= 90 and few.join(usable, ["doc_id", "y", "checks"], "left_anti").count() == 0


def test_random_waves_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(2)
    n, width = 20_000, 4.0
    model = quality.QualityModel(np.zeros(quality.N_STATISTICS), np.ones(quality.N_STATISTICS), rng.normal(0, 1 / width, (quality.N_STATISTICS, n)), rng.uniform(0, 2 * np.pi, n), None, (np.zeros(1), np.zeros(1)))
    z = rng.normal(size=(6, quality.N_STATISTICS)) / 2
    f = model.features(z)[:, :-1]
    apart = ((z[:, None] - z[None]) ** 2).sum(2)
    assert np.abs(f @ f.T - np.exp(-apart / (2 * width**2))).max() < 0.04


# ---------------------------------------------------------------- op1


def plain_distance(text, item):
    """Fewest edits of `item` to a substring of `text`."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_passages_equal_brute_force(spark):
    rng = random.Random(10)
    items = [(i, words(rng, rng.randrange(8, 20), 60)) for i in range(12)]
    docs = []
    for i in range(70):
        _, t = rng.choice(items)
        t = list(t)
        for _ in range(rng.randrange(0, 14)):
            at, kind = rng.randrange(len(t)), rng.random()
            t[at : at + 1] = [] if kind < 0.3 else [t[at], rng.choice("abxyz")] if kind < 0.6 else [rng.choice("abxyz")]
        body = "".join(t).upper() if i % 3 == 0 else "".join(t).replace(" ", "\n ", 2)
        docs.append((i, words(rng, rng.randrange(20), 60) + " " + body + " " + words(rng, rng.randrange(20), 60)))
    flat = lambda t: re.sub(r"\s+", " ", t.lower())
    want = set()
    for d, t in docs:
        for i, x in items:
            m = len(x)
            if plain_distance(flat(t), flat(x)) <= min(int(0.1 * m), (m - 9) // 8):
                want.add((d, i))
    got = decontaminate.find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    text = dict(docs)
    for r in got:
        assert abs(plain_distance(flat(text[r["doc_id"]][r["start"] : r["end"]]), dict(items)[r["item_id"]]) - r["edits"]) <= 1


def test_passages_in_blocks_and_odd_inputs(spark, odd, none, monkeypatch):
    bench, docs = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    whole = {tuple(r) for r in decontaminate.find_passages(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert {tuple(r) for r in decontaminate.find_passages(docs, bench).collect()} == whole and whole
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - {h[0] for h in whole}
    items = spark.createDataFrame([(1, None), (2, ""), (3, "漢字"), (None, "x x x"), (4, "no id at all")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_passages(odd, items).collect()}
    assert got == {(5, None), (6, 3), (None, 4)}
    assert decontaminate.find_passages(none, items).count() == 0 and decontaminate.find_passages(odd, items.limit(0)).count() == 0


def plain_bands(index, g):
    """(item, first diagonal) of bands by looking at every pair of equal q-grams."""
    where = defaultdict(list)
    for t, x in enumerate(g.tolist()):
        where[x].append(t)
    out = set()
    for i, (_, c, k, least) in enumerate(index.items):
        w, held = max(1, k), defaultdict(set)
        for p, x in enumerate(decontaminate.grams(c, index.q).tolist()):
            for t in where[x]:
                for b in ((t - p) // w, (t - p) // w - 1):
                    held[b].add(p)
        out |= {(i, b * w) for b, places in held.items() if len(places) >= least}
    return out


def test_bands_equal_plain_counts_in_any_window(monkeypatch):
    rng = random.Random(12)
    items = [(1, "a" * 60), (2, "ab" * 40), (3, "abcde " * 12), (4, words(rng, 20, 50)), (5, words(rng, 12, 50)), (6, "xyz" * 6 + words(rng, 10, 50))]
    texts = ["a" * 300, "ab" * 90 + "a" * 70, words(rng, 30, 50) + items[3][1] + "a" * 50, "abcde " * 50 + items[5][1], items[4][1][:60] + "zz" + items[4][1][60:] + "xyz" * 30, ""]
    for window, block, often in ((1 << 16, 1 << 21, 16), (8, 50, 2), (300, 7, 1000)):
        for name, value in (("WINDOW", window), ("BLOCK_HITS", block), ("OFTEN", often)):
            monkeypatch.setattr(decontaminate, name, value)
        index = decontaminate.QGramIndex(items, 8, 0.1)
        for t in texts:
            g = decontaminate.grams(decontaminate.normalised(t, index.lower)[0], 8)
            got = list(index.bands(g))
            assert len(got) == len(set(got)) and set(got) == plain_bands(index, g), t


def test_periodic_texts_take_bounded_time_and_memory():
    import resource
    import time

    index = decontaminate.QGramIndex([(1, "a" * 500), (2, "ab" * 300), (None, "abc " * 100)], 8, 0.1)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    found = index.search("a" * 1_000_000)
    assert {f[0] for f in found} == {1} and sum(f[3] == 0 and f[2] - f[1] == 500 for f in found) > 10_000 and all(f[3] <= 50 for f in found)
    assert {f[0] for f in index.search("xa" + "ab" * 200_000)} == {2}
    assert {f[0] for f in index.search("abc  " * 60_000)} == {None}
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_every_place_of_a_short_item_as_a_whole_word(spark):
    docs = [(1, "No, a snowy day; no.\nNO"), (2, "snow piano nod"), (3, "他写漢字了 漢字"), (4, "x1 1x no_no")]
    items = [(1, "no"), (2, "漢字"), (3, "x")]
    got = sorted(map(tuple, decontaminate.find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == [(1, 1, 0, 2, 0), (1, 1, 17, 19, 0), (1, 1, 21, 23, 0), (3, 2, 2, 4, 0), (3, 2, 6, 8, 0), (4, 1, 6, 8, 0), (4, 1, 9, 11, 0)]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()] == [2]


# ---------------------------------------------------------------- registered SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    order = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert order(got) == order(want)


def test_kept_hash_is_of_the_text(spark):
    assert {r["kept_sha256"] for r in QUERIES["op10_line_dedup"](spark, SF).collect()} == {hashlib.sha256((r["text"]).encode()).hexdigest() for r in lines.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
