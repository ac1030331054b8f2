"""Canonical and refresh links of every form, against the standard library and plain reachability."""

import random
import time
from urllib.parse import urljoin

from rastermill.llm import urls
from rastermill.llm.queries import ORACLES, URL_RULES

BASES = ["http://q.org/a/b/c?x=1#f", "https://Q.org", "http://q.org/", "http://q.org/a/b/"]
TARGETS = ["/en/x", "x?p=1", "//z.net/es/1", "?p=2", "#top", "../up", "../../../far/./y", "./", "..", "http://z.net/es/2", "d/e/../f", "/g/../h?i=../j", "/"]


def test_targets_are_resolved(spark):
    rows = [(b, f"<link rel='canonical' href='{t}'>", urljoin(b, t)) for b in BASES for t in TARGETS]
    got = urls.page_links(spark.createDataFrame(rows, "url string, html string, u string"))
    assert sorted(map(tuple, got.collect())) == sorted((b, u) for b, _, u in rows)


def test_what_is_a_link():
    page = "http://q.org/d/p"
    assert urls.linked('<link rel="x canonical" href="&#47;a&quest;b&eacute;">', page) == ["http://q.org/a?b\xe9"]
    assert urls.linked('<base href="//z.net/k/"><base href=/no><link href=c rel=Canonical><META content="5; URL=\'d\'" http-equiv=REFRESH>', page) == ["http://z.net/k/c", "http://z.net/k/d"]
    assert urls.linked("<!-- <link rel=canonical href=/x> --><script>'<link rel=canonical href=/y>'</script><link rel=icon href=/z><linkrel=canonical href=/w>", page) == []
    assert urls.linked('<link rel=canonical href="http://[broken/"><link rel=canonical href=""><link rel=canonical>', page) == []
    assert urls.linked("<link rel=canonical href=/open><!-- <link rel=canonical href=/x>", page) == ["http://q.org/open"]
    assert urls.linked("<link \"" * 50_000 + "<link rel=canonical href=/x>", page) in ([], ["http://q.org/x"])


def test_hostile_pages_take_linear_time():
    end = "<link rel=canonical href=/x>"
    for page, found in (("<link " + "a" * 1_000_000 + ">" + end, 1), ("<script " * 100_000, 0), ("<" * 1_000_000 + end, None), ("<link '" * 100_001 + end, None), ("<meta http-equiv=refresh content='5;url=" + " " * 300_000 + ";'>" + end, 1), ("<link " + "a " * 500_000 + ">" + end, 1), ("<link a" + " " * 500_000 + "b>" + end, 1)):
        began = time.time()
        got = urls.linked(page, "http://q.org/d/p")
        assert time.time() - began < 2, page[:20]
        assert found is None or got == ["http://q.org/x"] * found


def plain_verdicts(rows, moved):
    """Rules and reachability by hand: links of random graphs, followed from each page."""
    rules = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))

    def at(u):
        host, _, rest = u.split("://", 1)[1].split("#")[0].partition("/")
        return host.lower(), "/" + rest

    def rule(a):
        return next((v for h, p, v in rules if (a[0] == h or a[0].endswith("." + h)) and a[1].split("?")[0].startswith(p)), None)

    near = {}
    for u, to in [(u, urljoin(u, t)) for _, u, t in rows if t] + moved:
        near.setdefault(at(u), set()).add(at(to))
        near.setdefault(at(to), set()).add(at(u))
    out = {}
    for i, u, _ in rows:
        seen, todo = {at(u)}, [at(u)]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        votes = {rule(a) for a in seen} - {None}
        out[i] = rule(at(u)) or ("allow" if "allow" in votes or not votes else "block")
    return out


def test_random_links_equal_plain_reachability(spark):
    import duckdb

    rng = random.Random(11)
    sites = ["q.org", "r.org", "z.net", "b.net", "k.com", "Example.com", "s.org"]
    place = lambda: f"http://{rng.choice(sites)}/{rng.choice(['', 'es/', 'en/', 'fr/', 'd/'])}{rng.randrange(12)}"
    rows = [(i, place(), rng.choice([None, None, place(), f"/d/{rng.randrange(12)}", f"{rng.randrange(12)}", f"//z.net/es/{rng.randrange(12)}", f"?p={rng.randrange(3)}"])) for i in range(160)]
    tag = lambda t: "" if t is None else f'<link rel="canonical" href="{t}">' if len(t) % 2 else f'<meta http-equiv="refresh" content="0; url={t}">'
    pages = spark.createDataFrame([(i, u, f"<head>{tag(t)}</head><p>x") for i, u, t in rows], "page_id long, url string, html string")
    for moved in ([], [(place(), place()) for _ in range(40)]):
        given = spark.createDataFrame(moved, "`from` string, `to` string") if moved else None
        got = urls.judge_urls(pages, URL_RULES, given).collect()
        assert {r["page_id"]: r["verdict"] for r in got} == plain_verdicts(rows, moved)
        if not moved:
            frame = pages.toPandas()
            con = duckdb.connect()
            con.register("pages", frame)
            want = con.execute(ORACLES["op8_url_verdicts"]).fetchall()
            assert sorted(map(tuple, got)) == sorted(want) and {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_relative_links_pass_verdicts_on(spark):
    canonical = lambda u: f'<link rel=canonical href="{u}">'
    rows = [
        (1, "http://q.org/1", canonical("//z.net/es/1")), (2, "http://q.org/2", canonical("/1")), (3, "http://q.org/3?y", canonical("2")), (4, "http://q.org/d/4", '<meta http-equiv=refresh content="0;url=../3?y">'),
        (5, "http://q.org/5", canonical("?p=1")), (6, "http://q.org/5?p=1", canonical("http://z.net/fr/")), (7, "http://q.org/7", ""), (8, None, canonical("/1")),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {**dict.fromkeys(range(1, 7), "block"), 7: "allow", 8: "allow"}


def test_redirects_with_further_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", None, "n", "r")], "page_id long, url string, html string, node string, root string")
    moved = spark.createDataFrame([("http://a.org/x", "http://example.com/en/y", 301, "b")], "`from` string, `to` string, status int, a string")
    assert [tuple(r) for r in urls.judge_urls(pages, URL_RULES, moved).collect()] == [(1, "a.org", "/x", None, "block")]
