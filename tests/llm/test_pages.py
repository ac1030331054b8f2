"""Operators on pages and vectors, and the pipeline."""

import re

import numpy as np
import pytest

from rastermill.llm import embeddings, template, urls, warc
from rastermill.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def text_of(page, templates=frozenset()):
    root = template.parse(page)
    template.subtree_hashes(root)
    return template.main_text(root, templates)[0]


def test_main_text_of_one_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class=has-sidebar>
    <nav><ul><li><a href=/>Home</a><li>More</ul></nav><!-- ad --><div class="ad box">Buy</div><article><h1>Head &amp; tail&copy</h1><p><b>One
      two.<br><p>Three <i>fo</i>ur &lt;5&gt;</p><ul><li>a<li>b</ul><aside>x</aside><form>f</form><section id="comments"><p>Nice</p></section></article><footer>&copy; me</footer>"""
    assert text_of(page) == "Head & tail©\nOne two.\nThree four <5>\na\nb"
    assert text_of("") == "" and text_of("plain & text") == "plain & text" and text_of("<p>cut &am") == "cut &am" and text_of("<p>a<div>b</div>c") == "a\nb\nc"
    assert text_of("<b>" * 5000 + "deep") == "deep" and text_of("<div>" * 5000 + "deep") == "deep"
    assert text_of("a < b <!-- open") == "a < b"


def test_templates_are_counted_per_host(spark):
    box = "<div><p>We use biscuits.</p></div>"
    rows = [(i, f"http://a.org/{i}", f"<body>{box}<p>Text {i}</p></body>") for i in range(12)] + [(100 + i, f"http://b.org/{i}", f"<body>{box}<p>Other {i}</p></body>") for i in range(3)]
    same = [(200 + i, f"http://a.org/c{i}", "<body><article><p>A copied article.</p></article></body>") for i in range(15)]
    got = {r["page_id"]: r["text"] for r in template.extract_main_text(spark.createDataFrame(rows + same, PAGES)).collect()}
    assert all(got[i] == f"Text {i}" for i in range(12))
    assert all(got[100 + i] == f"We use biscuits.\nOther {i}" for i in range(3))
    assert all(got[200 + i] == "A copied article." for i in range(15))


def test_pages_odd_inputs(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/", "<p>" + "w " * 100_000), (3, "http://h/", "<p>again"), (None, "http://h/", "<p>no id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", host int")
    got = template.extract_main_text(df).collect()
    assert len(got) == 5 and {(r["page_id"], r["n_chars"]) for r in got} >= {(1, 0), (2, 0), (None, 5)}
    assert template.extract_main_text(df.limit(0)).count() == 0
    assert urls.judge_urls(df, URL_RULES).count() == 5 and urls.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert warc.derive(warc.responses_of_pages(df)).count() == 10 and warc.derive(warc.responses_of_pages(df.limit(0))).count() == 0


def test_rules_and_aliases(spark):
    canonical = lambda u: f'<link href="{u}" rel="canonical">'
    rows = [
        (1, "http://WWW.Example.com/en/x", ""), (2, "http://a.example.com/en/x?q", ""), (3, "http://z.net/es/", ""), (4, "http://q.org/1", canonical("http://z.net/fr/9#f")), (5, "http://q.org/2", '<meta http-equiv="refresh" content="0; url=http://q.org/1">'),
        (6, "http://q.org/3", canonical("http://z.net/es/1")), (7, "http://q.org/4", ""), (8, "http://notexample.com", ""), (9, None, canonical("http://z.net/es/1")), (10, "http://k.com/?a#b", canonical("http://z.net/es/1")),
    ]
    moved = spark.createDataFrame([("http://q.org/4", "http://p.org/5"), ("http://p.org/5", "http://z.net/es/1x")], "`from` string, `to` string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(rows, PAGES), URL_RULES, moved).collect()}
    assert got[1] == ("www.example.com", "www.example.com/en/", "allow") and got[2] == ("a.example.com", "example.com/en/", "block") and got[3] == ("z.net", "net/es/", "block")
    assert got[4] == ("q.org", None, "block") and got[5] == ("q.org", None, "block") and got[7] == ("q.org", None, "block")
    assert got[6] == ("q.org", None, "allow")  # an allowed alias (10) goes before a blocked one
    assert got[8] == ("notexample.com", None, "allow") and got[9] == ("", None, "allow") and got[10] == ("k.com", "com/", "allow")


def test_warc_records_are_linked(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x &amp; <b>y</b></p><script>no</script>\n<p>z</p>")], PAGES)
    response = warc.responses_of_pages(pages).first()
    records = warc.derive(warc.responses_of_pages(pages), keep=("page_id",))
    meta, plain = sorted(records.collect(), key=lambda r: r["warc_type"], reverse=True)
    assert meta["refers_to"] == plain["refers_to"] == response["record_id"] and meta["record_id"] != plain["record_id"]
    assert plain["block"] == "x & y\nz" and plain["content_length"] == 7 and "http-Content-Type: text/html" in meta["block"] and meta["source_digest"] in meta["block"]
    for text, r in zip(sorted(x["record"] for x in warc.serialise(records).collect()), records.collect(), strict=True):
        head, body = text.split("\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert len(body.removesuffix("\r\n\r\n").encode()) == int(fields["Content-Length"]) and fields["WARC-Refers-To"] == response["record_id"]


def plain_links(rows, threshold):
    usable = {i: (k, np.array(v, float)) for i, (_, v, k) in enumerate(rows) if v and k is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = {i: set() for i in range(len(rows))}
    for i, (k, u) in usable.items():
        for j, (m, v) in usable.items():
            if i != j and k == m and len(u) == len(v) and u @ v >= threshold * np.sqrt(u @ u) * np.sqrt(v @ v):
                links[i].add(j)
    return links


@pytest.mark.parametrize("piece", [4096, 30])
def test_vectors_equal_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(embeddings, "PIECE", piece)
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(25):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 12)):
            v = centre + rng.normal(size=24) * rng.choice([0, 0.05, 0.12, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([0.5, 1, 3])], int(c % 3) if rng.random() < 0.95 else None))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [float("nan")] + [1.0] * 23, 1), (1004, [None] + [1.0] * 23, 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [float("inf")] * 24, 1)]
    links = plain_links(rows, 0.98)
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ids = [r[0] for r in rows]
    assert {i: got[ids[i]]["n_links"] for i in links} == {i: len(n) for i, n in links.items()}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[ids[i]]["component_id"] == min(ids[j] for j in seen) and got[ids[i]]["kept"] == (ids[i] == min(ids[j] for j in seen))
    assert embeddings.near_duplicate_vectors(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>, label int").limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        now.write.parquet(str(tmp_path / name))
        now = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or (now.columns == docs.columns and 0 < now.count() <= docs.count())
    left, pieces = seen["decontamination"].toPandas(), seen["packing"].toPandas()
    assert set(pieces.doc_id) == set(left.doc_id)
    items = [re.sub(r"\s+", " ", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = [re.sub(r"\s+", " ", t.lower()) for t in left.text]
    assert not any(x in t for t in flat for x in items)
    assert left.text.str.strip().ne("").all() and left.text.is_unique
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)
