"""Operator 10: pages with known articles."""
import html
import re

from helpers import SF_SMALL

from sqlforge.llm import html_text as H

P1 = "The first paragraph, of some length, says that a thing was &amp; is&nbsp;so."
P2 = "The second one is long enough, with commas, and is here to be kept."
W1, W2 = "The first paragraph, of some length, says that a thing was & is so.", P2
ARTICLE = f"<h1>Title</h1>\n<p>{P1}</p><p>{P2}"
AROUND = """<html><head><title>T</title><style>p{x}</style><script>var a="</p><p>no, no, no, no, no";</script></head><body>
<header><a href=/>Home</a> Site, name, of, it</header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as you know, on all of our pages, for you.</p></div>%s
<div id="sidebar"><p>About us, and a long text, with many, many, many commas, here.</p></div>
<div class=ad>Buy, buy, buy, buy, buy, buy, now, at, once, and more</div>
<form><p>Your name, your mail, your wish, all in this form, please.</p></form>
<section class="comments"><p>I am a reader, and I think, at length, that this is so.</p></section>
<!-- <p>gone, gone, gone</p> --><footer>&copy; us, all, of, us, and, others</footer></body></html>"""


def test_containers():
    for wrap in ("<article>%s</article>", "<main><div>%s</div></main>", "<div class=post-body>%s</div>", "<div><div id=c>%s</div></div>"):
        got = H.main_text(AROUND % (wrap % ARTICLE)).split("\n")
        assert got == ["Title", W1, W2], wrap


def test_blocks_and_white_space():
    page = "<article><p>a\n  b<br>c&#x41;&eacute;&lt;p&gt;<p>d <b>e</b>f<i> g</i>\t<ul><li>x<li> y </ul><pre>k\n\n l</pre><table><tr><td>1<td>2</table> tail</article>"
    assert H.main_text(page) == "a b cAé<p>\nd ef g\nx\ny\nk l\n1\n2\ntail"


def test_siblings_that_read_like_the_article_are_kept():
    long = "A paragraph of the article, with enough, commas, to score, and to be long. " * 4
    page = f"<body><div>{f'<p>{long}</p>' * 4}</div><p>{long}</p><div>{f'<p>{long}</p>' * 3}</div><div><a href=x>link</a> <a href=y>link</a></div></body>"
    got = H.main_text(page)
    assert got.count("A paragraph") == 32 and "link" not in got


def test_link_density():
    links = "".join(f"<li><a href={k}>Another story, of some length, number {k}</a>" for k in range(12))
    assert H.main_text(f"<div><ul>{links}</ul></div><div><p>{P1}<p>{P2}</div>") == f"{W1}\n{W2}"
    # The article's own list of links is the article's.
    kept = H.main_text(f"<article><p>{P1}<ul>{links}</ul><p>{P2}</article>").split("\n")
    assert len(kept) == 14 and kept[0] == W1 and kept[-1] == W2


def test_awkward_pages():
    assert H.main_text(None) == "" == H.main_text("") == H.main_text("<p> &nbsp; </p>")
    assert H.main_text("plain, text\n here") == "plain, text here"
    assert H.main_text("a < b and 3 <4, &unknown; &amp") == "a < b and 3 <4, &unknown; &"
    assert H.main_text("<article><p>open <b") == "open <b"
    assert H.main_text("</p></div><p class='a>b' title=\"c>d\">x</b></p>") == "x"
    deep = "<div>" * 3000 + "<p>deep, text" + "</div>" * 10
    assert H.main_text(deep) == "deep, text"
    assert H.main_text("<article>" + f"<p>{P2}</p>" * 5000 + "</article>").count("\n") == 4999
    assert H.main_text('<p title="' + "x" * 50_000 + "<p>t") .endswith("t")
    assert H.main_text("<body class=has-sidebar><article class='post no-sidebar'><p>kept, text</article>") == "kept, text"
    assert H.main_text("<div hidden><p>no, no, no, no</div><p style='display: none'>no, no</p><p>yes, it is</p>") == "yes, it is"


def test_table(spark):
    df = spark.createDataFrame([(1, "u", AROUND % f"<article>{ARTICLE}</article>", "x"), (None, None, None, "x"), (3, "v", "", "x"), (3, "v", "", "x")],
                               "page_id long, url string, html string, text string")
    got = H.extract_main_text(df).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got if r.page_id == 1] == [(1, "u", f"Title\n{W1}\n{W2}", 7 + len(W1) + len(W2))]
    assert sorted((str(r.page_id), r.n_chars) for r in got if r.page_id != 1) == [("3", 0), ("3", 0), ("None", 0)]
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_query(spark):
    """The pages' articles are known: headings and paragraphs between the article tags."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = H.op10_page_text(spark, SF_SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r.text == "\n".join(x for x in blocks if x) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_names_on_the_articles_own_wrappers():
    """Layout words around or on the article leave it whole; what they name beside it still goes."""
    for wrap in ("<div class='has-sidebar'>%s</div>", "<div class='content-with-sidebar'>%s</div>", "<div class='elementor-widget-container'>%s</div>",
                 "<div class='widget Blog'>%s</div>", "<div id='page-header-wrap'><div>%s</div></div>", "<div class=skip-wrap><main>%s</main></div>",
                 "<div class='widget Blog'><article>%s</article></div>", "<article class='post has-comments'>%s</article>"):
        assert H.main_text(AROUND % (wrap % (ARTICLE + ARTICLE))).split("\n") == ["Title", W1, W2] * 2, wrap
        assert H.main_text(f"<body>{wrap % ARTICLE}</body>").split("\n") == ["Title", W1, W2], wrap
    parts = "".join(f"<div class=elementor-widget-container><p>{P2}</p></div>" for _ in range(6))
    assert H.main_text(f"<body><div><p>{P1}</p>{parts}</div></body>") == "\n".join([W1] + [W2] * 6)
    assert H.main_text(f"<body><div class=comments-open>{ARTICLE}</div></body>") == f"Title\n{W1}\n{W2}"


def test_long_comments_and_teasers_stay_out():
    more = f"<p>{P2}</p>" * 12
    assert H.main_text(f"<body><div>{ARTICLE}</div><div class=comments>{more}</div></body>").split("\n") == ["Title", W1, W2]
    assert H.main_text(f"<body><article>{ARTICLE}</article><div class=related-posts><article><p>{P1}</article></div></body>").split("\n") == ["Title", W1, W2]
    assert H.main_text(f"<body><div>{ARTICLE}</div><div class=comments><article class=comment>{more}</article></div></body>").split("\n") == ["Title", W1, W2]


def test_inline_elements_that_are_no_article():
    for gone in ("<span class='advert'>BUYNOW</span>", "<span style='display:none'>BUYNOW</span>", "<b hidden>BUYNOW</b>", "<button>BUYNOW</button>",
                 "<label>BUYNOW</label>", "<span class=promo-box><i>BUY</i>NOW</span>", "<i aria-hidden=true>BUYNOW</i>", "<span role=navigation>BUYNOW</span>"):
        for wrap in ("<article><p>%s</p><p>%s</p></article>", "<div><p>%s</p><p>%s</p></div>"):
            assert H.main_text(wrap % (f"{P1} {gone}", f"{gone}{P2}")) == f"{W1}\n{W2}", gone
    code = "<article><pre>x = 1 <span class=comment># one</span></pre><p>a <span class='market-share'>share</span> <em class=side>b</em></p></article>"
    assert H.main_text(code) == "x = 1 # one\na share b"


def test_names_on_text_elements_and_short_parts_stay():
    page = f"<article><p>{P1}</p><p id='market-share'>MARKET share grew.</p><p class='side'>Aside.</p><h2 class=header>More</h2><p>{P2}</p></article>"
    assert H.main_text(page).split("\n") == [W1, "MARKET share grew.", "Aside.", "More", W2]
    refs = "".join(f"<li><a href={k}>Source {k}</a>" for k in range(5))
    assert H.main_text(f"<article><p>{P1}</p><h2>References</h2><ol>{refs}</ol></article>").split("\n")[2:] == [f"Source {k}" for k in range(5)]
    page = f"<body><section><h2>A</h2><p>{P1}</p><p>{P2}</p><p>{P2}</p></section><section><h2>B</h2><p>Brief.</p></section><p>Coda.</p><p>&copy; 2020</p></body>"
    assert H.main_text(page).split("\n") == ["A", W1, W2, W2, "B", "Brief.", "Coda."]
    page = f"<body><div><h1>T</h1><div class=x><p>{P1}</p><p>{P2}</p></div><p>Coda.</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>No.</p></div></body>"
    assert H.main_text(page).split("\n") == ["T", W1, W2, "Coda."]


def test_quotes_and_unclosed_tags():
    assert H.main_text("<p class=it's>It's one</p><p>that's two</p>") == "It's one\nthat's two"
    assert H.main_text("<p title='a>b' data-x=\"c>d\">one</p>") == "one"
    assert H.main_text("<p>one</p><p title=\"open>two</p><p>three</p>") == "one\ntwo\nthree"


def test_time_grows_with_the_length_alone():
    import time
    size = 1_000_000
    pages = ["<a " * (size // 3), "<a \"" * (size // 4), "<a =\"> " * (size // 7), "<c =\">\" " * (size // 8), "</script <script>" * (size // 17),
             "<script>" + "</script " * (size // 9), "<b>" * 50_000 + "<p>x, y</p>" * 50_000, "<p><table>" + "<b>" * 50_000 + "<div>z</div>" * 20_000,
             "<!" * (size // 2), "</" * (size // 2), "<ul><li><a href=x>y</a>" * 20_000, "<div>" * 50_000 + "t"]
    for page in pages:
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 6, page[:30]     # well under 2 s on a free machine
