from barlake.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, this is a long advert text</div>
<article><h1>Title &amp; more</h1><p><b>First   paragraph
of text.<br><p>Second.</p><div class="cookie-notice">cookies</div><form>Name <input></form><section id="comments"><p>me too</p></section></article>
<aside>more links here</aside><footer>&copy; x</footer>"""


def test_marked_article():
    assert h.main_text(PAGE) == "Title & more\nFirst paragraph of text.\nSecond."


def test_unmarked_page_is_decided_by_the_ratio():
    long = "A real paragraph of the story, with enough words in it to stand out from the links around it."
    links = "".join(f'<li><a href="/{i}"><b>go {i}</b></a></li>' for i in range(12))
    page = f"<body><ul>{links}</ul><div><p>{long}</p><p>{long}</p><p>Short one.</p><p>{long}</p></div><ul>{links}</ul></body>"
    assert h.main_text(page) == "\n".join([long, long, "Short one.", long])


def test_smoothing_and_threshold():
    got = h.smoothed([0, 0, 9, 0], [0, 0, 0, 1])
    assert got[2] > got[1] > got[0] > 0 and got[3] == 0
    assert 2 < h.threshold([1, 1, 2, 8, 9]) < 8
    assert h.threshold([5.0, 5.0]) == 5.0


def test_broken_markup_never_fails():
    for bad in ("<", "<p", "</p></div>", "<p>a<p>b", "<article><p>x", "<div class>y</div>", "<!-- open", "<script>z", "&bogus; &#x110000;"):
        h.main_text(bad)
    assert h.main_text("<p>a<p>b") == "a\nb"
    assert h.main_text("<article><nav>m</nav><p>x") == "x"


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>p{i}</p>" for i in range(20_000)) + "</article>"
    assert h.main_text(page).split("\n") == [f"p{i}" for i in range(20_000)]


def test_frame(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "x", ""), (1, "u", PAGE)], "page_id long, url string, html string") \
        .withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = h.extract(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"] == "" for r in got) == 2
    assert h.extract(df.limit(0)).count() == 0


def test_article_text_under_common_words_stays():
    page = ('<article><h2 id="social-impact">Impact</h2><p class="alert">Mind this.</p><section id="related-work"><p>Others did it.</p></section>'
            '<div class="form-factor">Small.</div><div class="alert">Sign up</div><div class="ad-slot">Buy</div><p hidden>no</p>'
            '<div id="comments">me too</div><section id="search"><p>How to search.</p></section></article>')
    assert h.main_text(page) == "Impact\nMind this.\nOthers did it.\nSmall.\nHow to search."


def test_silent_elements_inside_a_line_do_not_cut_it():
    for x in ("<script>var a;</script>", "<svg><path/></svg>", "<svg/>", "<button>go</button>", '<span hidden>ad</span>'):
        assert h.main_text(f"<article><p>A {x} B</p><p>C{x}D{x}, e</p></article>") == "A B\nC D, e"
        assert h.main_text(f"<p>A {x} B</p>") == "A B"
    assert h.main_text('<p>A <span class="ad">x</span> B</p>') == "A B"
    assert h.main_text("<article><div>A <button><div>x</div></button> B</div></article>") == "A\nB"
    assert h.main_text("<article><p>A <button>x<p>B<p>C</article>") == "A\nB\nC"


LONG = "A real paragraph of the story, with enough words in it to stand out from the links around it."


def test_wrappers_never_hide_an_article():
    article = f"<article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article>"
    want = f"Title\n{LONG}\nShort."
    for wrap in ("<form id='aspnetForm'>", "<div class='has-sidebar'>", "<div class='layout sidebar-right'>", "<div class='social-share-enabled'>",
                 "<div class='comment-open'>", "<div class='widget'>", "<div class='modal'><div class='ad'>", "<section class='form'>", "<table><tr><td>",
                 "<div id='search'>", "<fieldset>", "<center>"):
        assert h.main_text(f"<body><nav><a>x</a></nav>{wrap}{article}") == want, wrap
    for shut in ("<div hidden>", "<div id='comments'>", "<ul class='comment-list'>", "<div style='display: none'>", "<template>"):
        assert h.main_text(f"<body><p>{LONG}</p>{shut}<article><p>hidden one</p></article>") == LONG, shut


def test_lists_and_linked_paragraphs_stay_with_their_container():
    links = "".join(f'<li><a href="/{i}"><b>go {i}</b></a></li>' for i in range(12))
    page = (f"<body><ul>{links}</ul><div><p>{LONG}</p><ul><li>One</li><li>Two</li></ul><p>{LONG}</p>"
            f"<p><a>first</a> <a>second</a> <a>third</a></p></div><div><ul>{links}</ul></div></body>")
    assert h.main_text(page) == "\n".join([LONG, "One", "Two", LONG, "first second third"])


def test_related_lists_and_teasers_go():
    teaser = "<article><h3><a href='/x'>More of it</a></h3><p>Tiny.</p></article>"
    body = "".join(f"<p>{LONG}</p>" for _ in range(4))
    page = f"<main><article><h1>Title</h1>{body}<div class='related-articles'><p>{LONG}</p></div></article>{teaser}{teaser}</main>"
    assert h.main_text(page) == "\n".join(["Title"] + [LONG] * 4)
    assert h.main_text(f"<main><h1>Title</h1><article>{body}</article></main>") == "\n".join(["Title"] + [LONG] * 4)


def test_a_page_inside_a_form_or_a_classed_element():
    for wrap in ("<form>", "<div class='widget'>", "<form><div class='modal'>"):
        assert h.main_text(f"<body><nav>menu</nav>{wrap}<div><p>{LONG}</p><p>Short.</p></div><footer>f</footer>") == f"{LONG}\nShort."


def test_deep_markup_is_linear():
    import time
    for tag in ("div", "section", "li", "p", "ul", "b", "a", "article"):
        start = time.perf_counter()
        h.main_text(f"<{tag}>" * 100_000 + "x")
        h.main_text(f"<{tag}>x" * 50_000 + f"</{tag}>" * 50_000)
        assert time.perf_counter() - start < 5, tag
    start = time.perf_counter()
    h.main_text("<li><ul>" + "<div><li>y</li>" * 30_000)
    assert time.perf_counter() - start < 5
