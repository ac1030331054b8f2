"""Code lengths against a plain coder, and languages of held-out documents."""

from collections import Counter
from math import log2
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rastermill.llm import langid

SF = "/root/testdata/sf0.01"


def counted(*texts):
    keys, n = np.unique(np.concatenate([langid.grams(p) for _, p in langid.streams(texts)] or [np.zeros(0, np.uint64)]), return_counts=True)
    return keys, n.astype(np.int64)


def plain_bits(trained: bytes, context: bytes, byte: int) -> float:
    """Partial matching with escapes by the number of kinds, and exclusions, from the text itself."""
    excluded, bits = set(), 0.0
    for k in range(langid.ORDER, -1, -1):
        c = context[len(context) - k :]
        follows = Counter(trained[p] for p in range(langid.ORDER, len(trained)) if trained[p - k : p] == c)
        if not follows:
            continue
        left = {s: n for s, n in follows.items() if s not in excluded}
        total = sum(left.values()) + len(left)
        if byte in left:
            return bits + log2(total / left[byte])
        if left:
            bits += log2(total / len(left))
        excluded |= set(follows)
    return bits + log2(256 - len(excluded))


words = st.text("abcdé ", max_size=40)


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_bits_of_each_byte(train, text):
    learned = next(iter(langid.streams([train])), (0, b""))[1]
    coded = next(iter(langid.streams([text])), (0, b""))[1]
    model = langid.compiled(["x"], {"x": counted(train)})
    want = [plain_bits(learned, coded[p - langid.ORDER : p], coded[p]) for p in range(langid.ORDER, len(coded))]
    np.testing.assert_allclose(langid.lengths(model, langid.grams(coded))[:, 0], want, rtol=1e-9, atol=1e-9)


@settings(max_examples=30, deadline=None)
@given(words, st.binary(min_size=langid.ORDER, max_size=langid.ORDER))
def test_probabilities_of_all_bytes_add_up_to_one(train, context):
    levels = langid.grow(*counted(train))
    for c in (context, b"    ", b"   a", b"ab c"):
        at = np.uint64(int.from_bytes(c, "big") << 8) + np.arange(256, dtype=np.uint64)
        assert abs(np.exp2(-langid.code_lengths(levels, at)).sum() - 1) < 1e-9


def test_ready_lengths_only_save_time(monkeypatch):
    counts = {x: counted(t) for x, t in {"a": "one two three two one", "b": "eins zwei drei zwei eins", "c": "un deux trois"}.items()}
    texts = ["two zwei deux", "three", "", None, "12 34", "ööö", "drei un one" * 50]
    whole = langid.text_lengths(langid.compiled(list("abc"), counts), texts)
    monkeypatch.setattr(langid, "MEMO", 9)
    monkeypatch.setattr(langid, "PIECE", 11)
    few = langid.compiled(list("abc"), counts)
    assert len(few["keys"]) == 3
    np.testing.assert_allclose(langid.text_lengths(few, texts)[0], whole[0])


def test_long_texts_come_in_pieces(monkeypatch):
    model = langid.compiled(["x"], {"x": counted("some words to learn from, some more words")})
    text = "Some other words - and MORE of them; ärger " * 40
    whole = langid.text_lengths(model, [text])
    monkeypatch.setattr("rastermill.llm.divergence.PIECE", 23)
    pieces = langid.text_lengths(model, [text])
    np.testing.assert_allclose(pieces[0], whole[0])
    assert pieces[1] == whole[1] == len(" ".join(__import__("re").findall(r"[a-zä]+", text.lower())).encode()) + 1


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.predict_languages(docs).collect()}
    told = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(told) == docs.count()
    out = [i for i, r in got.items() if r["held_out"]]
    assert out == [i for i in got if crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == told[i] for i in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


SCHEMA = "doc_id long, text string, lang string, source string, _h int, gram int, n int"


def row(i, text, lang):
    return (i, text, lang, "s", 1, 2, 3)


def test_odd_rows(spark):
    said = {"en": "the quick brown fox jumps over the lazy dog and the other dogs", "de": "der schnelle braune Fuchs springt über den faulen Hund und die anderen Hunde"}
    rows = [row(i, said[x], x) for i in range(40) for x in said] + [row(None, "nur so", "xx"), row(50, "teaches nothing", None), row(51, None, "en"), row(52, "", "en"), row(53, "123 #% —", "de"), row(54, said["de"] * 20_000, None), row(55, "the fox", None), row(55, "the fox", None)]
    got = langid.predict_languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    of = lambda i: [(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == i]
    assert of(51) == of(52) == of(53) == [("und", 0.0)]
    assert of(54)[0][0] == "de" and of(54)[0][1] > 0.99 and len(of(55)) == 2 and of(55)[0] == of(55)[1] and of(55)[0][0] == "en"
    assert {r["lang_pred"] for r in got} == {"en", "de", "und"}
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]


def test_nothing_to_learn_and_nothing_to_read(spark):
    assert langid.predict_languages(spark.createDataFrame([], SCHEMA)).count() == 0
    got = langid.predict_languages(spark.createDataFrame([row(1, "some text", None)], SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]


def test_ties_go_to_the_first_name(spark):
    got = langid.predict_languages(spark.createDataFrame([row(i, "same words", x) for i in range(9) for x in ("b", "a")], SCHEMA)).collect()
    assert {r["lang_pred"] for r in got} == {"a"} and {r["score"] for r in got} == {0.5}


@pytest.mark.parametrize("bound", [5, 20])
def test_the_bound_on_rows_holds_for_each_language(spark, bound):
    rows = spark.createDataFrame([row(i, f"word{chr(97 + i % 26)}", "en") for i in range(3000)] + [row(i, "rare", "de") for i in range(4)], SCHEMA)
    model = langid.fit(rows, max_rows=bound)
    n = dict(zip(model["langs"], (int(t[0]["n"][0]) for t in model["trees"]), strict=True))
    assert 0 < n["en"] <= 3 * bound * 6 and n["de"] == sum(crc32(str(i).encode()) % 3 != 1 for i in range(4)) * 5
