"""Main text inside wrappers whose names hold a word of chrome."""

import pytest

from rastermill.llm import template


def text_of(page):
    root = template.parse(page)
    template.subtree_hashes(root)
    return template.main_text(root, frozenset())[0]


@pytest.mark.parametrize("wrapper", ['div class="content-sidebar-wrap"', 'div class="site has-sidebar"', 'div id="page-header-wrap"', 'div class="sidebar"', 'div class="site-header nav"'])
def test_wrappers_of_a_main_element_stay(wrapper):
    assert text_of(f"<body><{wrapper}><div class=x><article><p>The text.</p></article></div></div><div class=ad-box>Buy</div>") == "The text."
    assert text_of(f"<body><main><{wrapper}><article><p>The text.</p></article></div></main>") == "The text."


@pytest.mark.parametrize("wrapper", ['form id="aspnetForm"', "form", 'div class="widget"', 'div class="article-related"', "header", "aside"])
def test_wrappers_of_a_whole_page(wrapper):
    tag = wrapper.split()[0]
    assert text_of(f"<body><{wrapper}><div class=menu>Home</div><article><p>The text.</p></article><footer>Terms</footer></{tag}></body>") == "The text."
    if tag in ("form", "div"):
        assert text_of(f"<body><{wrapper}><nav>Home</nav><div class=x><p>The text of the page.</p></div><div class=ad-box>Buy</div></{tag}><footer>Terms</footer></body>") == "The text of the page."
        assert text_of(f"<body><article><{wrapper}><p>The text.</p></{tag}></article></body>") == "The text."
        assert text_of(f"<body><p>The text of the page, which is longer.</p><{wrapper}><p>Other things.</p></{tag}></body>") == "The text of the page, which is longer."


def test_comments_after_the_only_text_stay_out():
    assert text_of('<body><div class="widget"><p>What the page says.</p></div><div class="comments"><p>Well said, and more of it, at length.</p></div></body>') == "What the page says."
    assert text_of('<body><header>Name</header><nav>Home</nav><footer>Terms of use</footer></body>') == ""


def test_comments_of_every_form():
    for comment in ("<!-->", "<!--->", "<!-- x --!>", "<!---->", "<!-- a -- > b -->", "<!--!>-->"):
        assert text_of(f"<body><p>One{comment}</p><p>Two</p>") == "One\nTwo", comment
    assert text_of("<body><p>One<!-- open </p><p>Two</p>") == "One"


def test_main_elements_are_not_judged_by_words():
    assert text_of('<article class="post comments-open"><p>One</p></article><article class="post share"><p>Two</p></article>') == "One\nTwo"
    assert text_of('<div class="nav"><div role="main" class="notice">One</div></div>') == "One"


def test_composite_names_without_a_main_element():
    for name in ("content-sidebar-wrap", "has-sidebar", "page-header-wrap", "comments-open"):
        assert text_of(f'<body><div class="site {name}"><p>The text.</p></div>') == "The text."
    for name in ("site-footer", "ad_box", "box ad", "widget-area"):
        assert text_of(f'<body><p>The text.</p><div class="{name}"><p>Other</p></div>') == "The text."


def test_teasers_and_comments_beside_the_main_element_go():
    assert text_of('<div class="nav-layout sidebar"><article><p>The text.</p><div id=comments><article>Nice</article></div></article><div class="related-posts"><article>Teaser</article></div></div>') == "The text."


def test_templates_count_pages_whatever_the_host_and_differing_main_elements(spark):
    menu, box = "<div><p>All our sections.</p></div>", "<div><p>Sign up <b>now</b>.</p></div>"
    rows = [(i, f"http://a.org/{i}", f"<body>{menu if i < 10 else ''}<article><h2>Notes</h2><p>Text {i}</p>{box if i < 12 else ''}</article></body>") for i in range(600)]
    rows += [(1000 + i, f"http://b.org/{i}", f"<body><article><p>Copied.</p>{box}<div class=ad>Buy {i}</div></article></body>") for i in range(15)]
    rows += [(2000, "http://c.org/", f"<body>{menu}<p>Once</p></body>")] * 15
    got = {r["page_id"]: r["text"] for r in template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Notes\nText {i}" for i in range(600))
    assert all(got[1000 + i] == "Copied.\nSign up now." for i in range(15))
    assert got[2000] == "All our sections.\nOnce"
