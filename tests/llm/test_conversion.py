"""The plain-text conversion of WARC records against the standard library's table of references."""

import html
import time

from rastermill.llm import warc


def test_every_reference_is_decoded(spark):
    names = sorted(html.entities.html5)
    texts = [f"a&{n}z" for n in names] + ["&#8217;&#x27;&#X2014;&#233", "&amp;eacute; &amp;#39;", "a&nbsp;b&#160;c&#xA0;d&#1600;", "&unknown; & &;", "&#0;&#xD800;&#128;"]
    pages = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["p"] for r in pages.select("i", warc.plain_text(pages["t"]).alias("p")).collect()}
    for i, t in enumerate(texts[: len(names)]):
        want = html.unescape(t.replace("&nbsp;", " ").replace("&nbsp", " "))
        assert " ".join(got[i].split()) == " ".join(want.split()), t
    assert [got[len(names) + k] for k in range(5)] == ["\u2019'\u2014\xe9", "&eacute; &#39;", "a b c d\u0640", "&unknown; & &;", "\ufffd\ufffd\u20ac"]


def test_open_scripts_and_styles_are_cut_to_the_end(spark):
    texts = ["<p>x<script>var a = 1;", "x<STYLE type=a>p{}", "x<!-- open", "x<script>a</script >", "x<p><scripted>y", "x<script>a</scripts>b</script>"]
    pages = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["p"] for r in pages.select("i", warc.plain_text(pages["t"]).alias("p")).orderBy("i").collect()] == ["x", "x", "x", "x", "x\ny", "x"]
    block = warc.derive(warc.responses_of_pages(spark.createDataFrame([(1, "http://a/", "caf&eacute;<script>b")], "page_id long, url string, html string"))).where("warc_type = 'conversion'").first()
    assert block["block"] == "caf\xe9" and block["content_length"] == 5


def test_hostile_pages_take_linear_time(spark):
    texts = ["<" * 1_000_000, "<script " * 100_000, "<style" * 150_000, "<script>" + "</script " * 100_000, "<!--" * 250_000, "<p " * 300_000 + ">", "<!-->a<!--->b<!-- x --!>c", "1 < 2 <b>x</b> < 3"]
    pages = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).cache()
    pages.count()
    began = time.time()
    got = [r["p"] for r in pages.select("i", warc.plain_text(pages["t"]).alias("p")).orderBy("i").collect()]
    assert time.time() - began < 12
    assert got == [texts[0], "", texts[2], "", "", "", "a b c", "1 x < 3"]
