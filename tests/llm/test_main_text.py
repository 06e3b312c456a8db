import html
import re

from tablewarden.llm.main_text import extract, main_text

PROSE = "It was the first of the days that he had been with them in the house, and she was not there for it. " * 3


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head>
    <body class="has-sidebar"><header><a href=/>Home</a></header><nav><ul><li><a>One</a></li></ul></nav><!-- <p>hidden</p> -->
    <div class="ad">Buy   now, the best of all and it is for you in the shop.</div>
    <article><header><h1>Title &amp; more</h1></header><p><b>{PROSE}<br>next<p>Short.<p class='x'>Second &#233;\n\n part</p>
    <div class="cookie-notice">We use cookies</div><form><p>Name</p><input></form><ul><li><a href=1>Related one</a></li></ul></article>
    <section id="comments"><article><p>{PROSE}</p></article></section><aside><p>{PROSE}</p></aside><footer>&copy; x</footer>"""
    assert main_text(page) == "\n\n".join(["Title & more", f"{' '.join(PROSE.split())} next", "Short.", "Second é part"])


def test_pages_without_an_article_element():
    links = "<ul>" + "".join(f"<li><a href={k}>Link number {k}</a></li>" for k in range(9)) + "</ul>"
    page = f"<div>{links}</div><div><h2>Heading</h2><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><p>SKU 123 | 456 | 789</p><div>{links}</div>"
    prose = " ".join(PROSE.split())
    assert main_text(page).startswith(f"Heading\n\n{prose}\n\nShort one.\n\n{prose}")
    assert "Link number" not in main_text(page)


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == main_text("<script>x") == main_text("<!-- x") == ""
    assert main_text("only text & more") == "only text & more"
    assert main_text("<p>a < b</p><p>a<br>b<br><br>c") == "a < b\n\na b\n\nc"
    assert main_text("<article><p title='a>b'>x</p><p title=\"open>y</p>") .startswith("x")
    assert main_text("<p>" * 20_000 + "deep") == "deep"
    assert main_text("<a \"" * 3000 + "<p>end</p>").endswith("end")


def test_all_of_the_given_articles(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        want = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?p>|</?h1>", article)]
        assert main_text(r.html) == "\n\n".join(x for x in want if x)


def test_frame(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<p>é", None)], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract(pages).collect()), key=repr) == [(1, "u", "", 0), (None, None, "é", 1)]
    assert extract(pages.limit(0)).count() == 0


def test_pages_in_an_unlisted_language():
    links = "<ul>" + "".join(f"<li><a href={k}>Ссылка {k}</a></li>" for k in range(9)) + "</ul>"
    russian = "Однажды весной, в час небывало жаркого заката, в Москве, на Патриарших прудах, появились два гражданина. " * 3
    chinese = "道可道，非常道。名可名，非常名。无名天地之始，有名万物之母。"
    for prose in (russian, chinese, russian[:40]):
        page = f"<div>{links}</div><h2>Глава</h2><p>{prose}</p><p>{prose}</p><table><tr><td>{prose}</td></tr></table><div>{links}</div>"
        prose = " ".join(prose.split())
        assert main_text(page) == "\n\n".join(["Глава", prose, prose, prose])


def test_links_within_an_article():
    long = "A linked sentence that is long enough to be no item of a menu at all, and so it stays"
    page = f"""<article><p>{PROSE}</p><p>See <a href=1>the other report of the year</a>.</p><ul><li>Smith, <a href=2>A title of a paper</a>, 2020</li></ul>
    <p><a href=3>{long}</a></p></article>"""
    want = [" ".join(PROSE.split()), "See the other report of the year.", "Smith, A title of a paper, 2020", long]
    assert main_text(page) == "\n\n".join(want)
