"""Templates of a host by counting: against plain counts over random small sites, and in linear time."""

import random
import time
from collections import defaultdict

import pytest

from rastermill.llm import template

PAGES = "page_id long, url string, html string"


def text_of(page, templates=frozenset()):
    root = template.parse(page)
    template.subtree_hashes(root)
    return template.main_text(root, templates)[0]


# A node is (tag, names, children); a child is a node or a text.


def html(node):
    if isinstance(node, str):
        return node
    tag, names, below = node
    return f"<{tag}{f' class={chr(34)}{names}{chr(34)}' if names else ''}>{''.join(map(html, below))}</{tag}>"


def lines(node, gone):
    """Blocks of text in order; every element here but a is a block."""
    out, now = [], []
    for x in node[2]:
        if isinstance(x, str) or x[0] == "a":
            now.append(x if isinstance(x, str) else "".join(x[2]))
            continue
        out, now = out + ["".join(now)] if now else out, []
        if not gone(x):
            out += lines(x, gone)
    return out + ["".join(now)] if now else out


def below(node):
    for x in node[2]:
        if not isinstance(x, str):
            yield x
            yield from below(x)


def random_tree(rng, pool, depth=3):
    tag = rng.choice(["div", "section", "ul"])
    kids = [random_tree(rng, pool, depth - 1) if depth and rng.random() < 0.6 else ("p", "", [rng.choice(pool)]) for _ in range(rng.randrange(1, 4))]
    return tag, rng.choice(["", "", "box", "k1"]), kids


@pytest.mark.parametrize("most", [0, 10**6])
def test_exact_subtrees_equal_plain_counts(spark, monkeypatch, most):
    monkeypatch.setattr(template, "MOST_TEMPLATES", most)
    rng = random.Random(1)
    pool = [f"text {i}" for i in range(6)]
    sites = {i: (rng.choice("ab"), ("body", "", [random_tree(rng, pool) for _ in range(rng.randrange(1, 4))])) for i in range(60)}
    held = defaultdict(set)
    for i, (host, tree) in sites.items():
        for x in below(tree):
            held[host, html(x)].add(i)
    assert {len(v) >= 3 for v in held.values()} == {True, False}
    rows = [(i, f"http://{host}.org/{i}", html(tree)) for i, (host, tree) in sites.items()]
    got = {r["page_id"]: r["text"] for r in template.extract_main_text(spark.createDataFrame(rows, PAGES), min_pages=3, max_share=-1.0, by_name=False).collect()}
    assert got == {i: "\n".join(lines(tree, lambda x, host=host: len(held[host, html(x)]) >= 3)) for i, (host, tree) in sites.items()}


def shape(node):
    texts = any(isinstance(x, str) for x in node[2]) or any(any(isinstance(y, str) for y in x[2]) for x in below(node) if x[0] != "a")
    links = any(x[0] == "a" for x in below(node))
    return node[0], node[1], texts, links, tuple(sorted({shape(x) for x in node[2] if not isinstance(x, str) and x[0] != "a"}))


@pytest.mark.parametrize("most", [0, 10**6])
def test_shapes_equal_plain_counts_on_random_sites(spark, monkeypatch, most):
    """Menus, adverts and footers of changing text around an article: all of them, and only them, by counting alone."""
    monkeypatch.setattr(template, "MOST_TEMPLATES", most)
    rng = random.Random(2)
    n = 0

    def fresh():
        nonlocal n
        n += 1
        return f"word{n}"

    kinds = [
        lambda: ("nav", "", [("ul", "", [("li", "", [("a", "", [fresh()])]) for _ in range(rng.randrange(1, 6))])]), lambda: ("div", "ad", [fresh()]), lambda: ("footer", "", [fresh(), ("a", "", [fresh()])]),
        lambda: ("div", "x y", [("p", "", [fresh()])]), lambda: ("section", "", [("h2", "", [fresh()]), ("ul", "", [("li", "", [fresh()])])]), lambda: ("div", "", [("div", "ad", [fresh()]), ("p", "", [("a", "", [fresh()])])]),
    ]
    sites, held = {}, defaultdict(set)
    for i in range(80):
        host = rng.choice("abc")
        article = ("article", "", [("p", "", [" ".join(fresh() for _ in range(60))]) for _ in range(rng.randrange(1, 4))])
        beside = [rng.choice(kinds)() for _ in range(rng.randrange(0, 4))]
        tree = ("body", "", [*beside[:2], article, *beside[2:]])
        sites[i] = (host, tree, beside)
        for x in beside:
            for y in [x, *below(x)]:
                if y[0] in template.BOXES:
                    held[host, shape(y)].add(i)
    assert {len(v) >= 10 for v in held.values()} == {True, False}
    rows = [(i, f"http://{host}.org/{i}", html(tree)) for i, (host, tree, _) in sites.items()]
    got = {r["page_id"]: (r["text"], r["n_templates"]) for r in template.extract_main_text(spark.createDataFrame(rows, PAGES), min_pages=10, by_name=False).collect()}

    def deleted(node, host):
        if node[0] in template.BOXES and len(held[host, shape(node)]) >= 10:
            return 1
        return sum(deleted(x, host) for x in node[2] if not isinstance(x, str))

    for i, (host, tree, beside) in sites.items():
        gone = lambda x, host=host: x[0] in template.BOXES and len(held[host, shape(x)]) >= 10
        assert got[i] == ("\n".join(lines(tree, gone)), sum(deleted(x, host) for x in beside))


def test_the_text_itself_is_no_template_by_shape(spark):
    """One layout on all pages, without a marked main element: what is the text of each page stays, menus go."""
    rng = random.Random(3)
    prose = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    rows, want = [], {}
    for i in range(30):
        title, paragraphs = prose(5), [prose(40) for _ in range(4)]
        menu = "".join(f"<li><a href=/>{prose(1)}</a>" for _ in range(rng.randrange(3, 9)))
        rows.append((i, f"http://a.org/{i}", f"<body><div class=top><ul>{menu}</ul></div><div class=head><h1>{title}</h1></div><div class=body>{''.join(f'<div class=para><p>{p}</p></div>' for p in paragraphs)}</div><div class=legal>{prose(6)}</div></body>"))
        want[i] = "\n".join([title, *paragraphs])
    got = {r["page_id"]: (r["text"], r["n_listed"]) for r in template.extract_main_text(spark.createDataFrame(rows, PAGES), by_name=False).collect()}
    assert got == {i: (t, 0) for i, t in want.items()}


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a '\">\"", '<a ">"', "<!--", "<script>", '<p><button><b><h1>', "<li><b>", "</b <", "<a b=c>"])
def test_pages_are_read_in_linear_time(unit):
    for tail in ("", "'", ">"):
        began = time.process_time()
        template.parse(unit * 40_000 + tail)
        assert time.process_time() - began < 5


def test_unclosed_tags_and_quotes():
    assert text_of("<p>a<b") == "a<b" and text_of("x <i <!-- y") == "x <i" and text_of('<p>a<a href="x>b</a>c<p>d') == "ab\nc\nd" or text_of('<p>a<a href="x>b</a>c<p>d') == "abc\nd"
    assert text_of('<p title="a>b">c</p>') == "c" and text_of("<p title='a\">b'>c") == "c"


def test_titles_and_compound_names():
    assert text_of("<title>x</title><p>y</p>") == "y" and text_of("<p>y</p><svg><title>z</title></svg>") == "y"
    assert text_of('<article><div class="post-header"><h1>Head</h1></div><p class="share-price">The price.</p><h2 class="section-header">Two</h2><p>x</p></article>') == "Head\nThe price.\nTwo\nx"
    assert text_of('<article><p>x</p><div class="related-posts"><h3>More</h3><a href=/>y</a></div><div class="post-footer">z</div><div class="comment-list"><h2>2</h2><p>nice</p></div><div class="ad">w</div></article>') == "x"
