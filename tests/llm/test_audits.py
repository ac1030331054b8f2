"""Filter interaction and source divergence against plain counting."""

import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rastermill.llm import divergence, interaction

DOCS = "doc_id long, text string, lang string, source string, n int, part string, mask int"
LONG = "word " * 150_000 + "Ende#"


def doc_rows():
    rng = np.random.default_rng(5)
    said = [" ".join(rng.choice(["the", "LOUD", "cat", "sat", "#tag", "quick", "brown", "Fox"], size=int(n))) for n in rng.integers(0, 260, 40)]
    rows = [(i, said[int(rng.integers(40))], "en", f"s{i % 3}", 1, "x", 7) for i in range(120)]
    rows += [(7, rows[7][1], "en", "s1", 1, "x", 7), (7, rows[8][1], None, None, 1, "x", 7), (None, rows[0][1], "en", "s0", 1, None, None), (None, None, None, None, None, None, None)]
    return rows + [(200, None, "en", "s0", 1, "x", 7), (201, "", "en", None, 1, "x", 7), (202, " \t\n", "en", "", 1, "x", 7), (203, LONG, "de", "s9", 1, "x", 7), (204, LONG, "de", "s8", 1, "x", 7)]


def label_rows():
    rng = np.random.default_rng(6)
    return [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 210, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1)]


def played(docs, labels):
    first, good, toxic = {}, Counter(), Counter()
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    parts = defaultdict(list)
    for i, text, _, source, *_ in docs:
        x = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 2 * len(x), "D": bool(re.search("[#$%&*|]", x)), "E": i is not None and i > first[x]}
        parts[source or ""].append(({f for f, v in fails.items() if v}, i is not None and good[i], i is not None and toxic[i]))
    out, share = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                share[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {key: (*v, share[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_every_order_step_by_step(spark):
    docs, labels = doc_rows(), label_rows()
    got = interaction.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = played(docs, labels)
    assert len(got) == len(want) == 120 * 5 * len({(d[3] or "") for d in docs})
    for r in got:
        assert tuple(r[3:]) == want[r["part"], r["filter_order"], r["step"]]


def test_nothing_to_audit(spark):
    none = spark.createDataFrame([], DOCS)
    assert interaction.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert divergence.audit_sources(none).count() == 0


def test_shapley_of_other_filters(spark):
    facts = spark.createDataFrame([("p", 0b011, 6, 0, 0), ("p", 0b100, 1, 0, 0), ("p", 0, 9, 0, 0)], "part string, mask int, n long, good long, toxic long")
    row = interaction.removal_games(facts, 3).first()
    assert [row["potential"][7] - row["potential"][7 - (1 << i)] for i in range(3)] == [18, 18, 6]  # 3, 3 and 1, times 3!
    only = {"short": lambda text, words: interaction.F.char_length(text) < 3}
    got = interaction.audit(spark.createDataFrame([(1, "ab"), (2, "abc")], "doc_id long, text string").withColumn("source", interaction.F.lit("s")), spark.createDataFrame([], "doc_id long, quality int, toxic int"), only).collect()
    assert [(r["filter_order"], r["kept"], r["removed"], r["shapley"]) for r in got] == [("short", 1, 1, 1)]
    with pytest.raises(ValueError):
        interaction.audit(None, None, {})


def plain_divergence(docs, min_docs, top):
    of, held = Counter(), Counter()
    groups = {(d[2] or "", d[3] or "") for d in docs}
    for _, text, lang, source, *_ in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        of.update((lang or "", source or "", t) for t in found)
        held.update((lang or "", t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (la, t), n in held.items() if la == lang and n >= min_docs)
        mine = sorted(s for la, s in groups if la == lang)
        share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        total = {s: sum(of[lang, s, t] for t in kept) for s in mine}
        p = {s: [share(of[lang, s, t], total[s]) for t in kept] for s in mine} if kept else {s: [] for s in mine}
        q = [share(sum(of[lang, s, t] for s in mine), sum(total.values())) for t in kept]
        for s in mine:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in mine if o != s)
            words = sorted((y - x, t.encode(), t) for t, x, y in zip(kept, p[s], q, strict=True) if of[lang, s, t] and x > y)[:top]
            out += [(lang, s, part, item, -v, k) for part, rows in (("pair", pairs), ("term", words)) for k, (v, _, item) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs, top, block, tile", [(1, 3, 2, 1), (3, 50, 8192, 8), (2, 2, 3, 2), (10**6, 5, 8, 8)])
def test_shares_of_all_groups(spark, min_docs, top, block, tile):
    docs = doc_rows() + [(300 + i, f"Größe WORT{chr(65 + i % 7)} naïve—　x{chr(0x4E00 + i % 3)} zÉ", lang, s, 1, "x", 7) for i in range(30) for lang, s in (("de", f"s{i % 4}"), ("fr", None))]
    docs += [(400, "1234 #%", "de", "empty", 1, "x", 7)]
    got = divergence.audit_sources(spark.createDataFrame(docs, DOCS), min_docs, top, block, tile).collect()
    assert sorted(map(tuple, got)) == plain_divergence(docs, min_docs, top)


def test_long_texts_are_cut_between_terms(monkeypatch):
    whole = Counter(next(divergence.terms("Der die  das Ärger12x " * 50)))
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert sum(map(Counter, divergence.terms("Der die  das Ärger12x " * 50)), Counter()) == whole


def test_tasks_pass_counts_on_when_they_hold_many(spark, monkeypatch):
    docs = doc_rows()
    monkeypatch.setattr(divergence, "HELD", 3)
    assert sorted(map(tuple, divergence.audit_sources(spark.createDataFrame(docs, DOCS), 3).collect())) == plain_divergence(docs, 3, 50)


ids = st.lists(st.integers(0, 400), unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ids, ids, st.integers(1, 9))
def test_gallop_finds_what_two_arrays_share(a, b, run):
    i, j = divergence.gallop(np.array(a, np.int64), np.array(b, np.int64), run)
    assert [a[k] for k in i] == [b[k] for k in j] == sorted(set(a) & set(b))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**15), min_size=1, max_size=5), st.integers(1, 8 * 10**15))
def test_long_division_is_exact(counts, total):
    total = max(total, max(counts) + 5)
    assert divergence.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 5) // total for c in counts]


def test_distance_counts_absent_terms():
    for a, b in combinations([[], [(1, 4)], [(1, 2), (3, 9)], [(2, 1), (3, 1), (4, 8)]], 2):
        size, (p, q) = 6, ({k: dict(x).get(k, 0) for k in range(6)} for x in (a, b))
        ta, tb = sum(p.values()) + 30, sum(q.values()) + 30
        want = sum(abs((10**9 * (p[k] + 5)) // ta - (10**9 * (q[k] + 5)) // tb) for k in range(6))
        parts = [np.array([x[k] for x in v], np.int64) for v in (a, b) for k in (0, 1)]
        assert divergence.distance(parts[0], parts[1], ta, parts[2], parts[3], tb, size) == want
