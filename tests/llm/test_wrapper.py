import html as entities
import re

from leadlake.llm import wrapper as wr

from . import tables

PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><div id="hdr"><h2>My site</h2></div>
<div class="menu"><a href=1>Home</a> <a href=2>About</a></div><div id=main><div class="notice">We use cookies</div>
<h1>Title {0} &amp; more</h1><p>First   paragraph {0} is&nbsp;long &#233;<p>Second <i>on</i>e, {0}<!-- x --><script>var a = "</p>";</script>
<form>x<input></form><aside>side {0}</aside><div class="comments"><p>nice {0}!</p></div></div>
<div class=sidebar>zzz {0}</div><footer>f {0}</footer></body></html>"""


def made(pages):
    w = None
    for p in pages:
        t = wr.template(wr.parse(p))
        w = t if w is None else wr.merge(w, t)
    return w


def test_article_of_aligned_pages():
    pages = [PAGE.format(k) for k in range(12)]
    want = "Title 3 & more\nFirst paragraph 3 is long é\nSecond one, 3"
    assert wr.extract(pages[3], made(pages)) == want
    assert wr.extract(pages[3], None) == want


def test_constant_nodes_without_marks_are_template():
    pages = [f"<body><div>Welcome to our shop</div><div><h1>News {k}</h1><p>Text {k} goes on.</p><div>All rights kept</div></div></body>"
             for k in range(10)]
    assert wr.extract(pages[4], made(pages)) == "News 4\nText 4 goes on."


def test_host_of_copies_keeps_its_article():
    pages = ["<body><article><p>The same article on every page.</p></article></body>"] * 20
    assert wr.extract(pages[0], made(pages)) == "The same article on every page."


def test_copies_keep_title_and_lone_blocks(spark):
    page = "<body><div>My shop</div><article><h1>{0}</h1><p>One {0}.</p><p>Two {0}.</p><h2>More {0}</h2><p>Three {0}.</p></article></body>"
    rows = [(k, f"http://a.com/{k}", page.format("again").replace("<body>", f"<body data-at={k}>\n")) for k in range(300)]
    rows += [(k, f"http://a.com/{k}", page.format(k)) for k in range(300, 308)]
    got = {r.page_id: r.text for r in wr.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for k in range(308):
        x = "again" if k < 300 else k
        assert got[k] == f"{x}\nOne {x}.\nTwo {x}.\nMore {x}\nThree {x}."


def test_marked_containers_of_the_whole_article_are_no_side_elements():
    text = "<h1>News {0}</h1><p>Text {0} goes on for long enough.</p><p>More of text {0}.</p><div class=comments><p>nice {0}</p></div>"
    for form in ("<body class='no-sidebar'><div>%s</div></body>", "<body><article class='post comments-open'>%s</article></body>",
                 "<body><div class='content-sidebar-wrap'><div>%s</div></div></body>", "<body><main class='search-results'>%s</main></body>",
                 "<body><form action=x><div class='with-sidebar'><div>%s</div></div></form></body>"):
        pages = [(form % text).format(k) for k in range(10)]
        for w in (made(pages), None):
            assert wr.extract(pages[3], w) == "News 3\nText 3 goes on for long enough.\nMore of text 3.", form


def test_odd_pages():
    for source, want in ((None, ""), ("", ""), ("just &lt;text&gt;", "just <text>"), ("<p>a<p>b", "a\nb"), ("<<<", "<<<"),
                         ("<script>x", ""), ("<p>a<br>b  c</p>", "a b c"), ("<p title='a>b'>x</p>", "x"), ("<div>" * 300 + "deep", "deep")):
        assert wr.extract(source, None) == want


def test_deep_pages_keep_their_text_in_order():
    for n in (90, 150, 5000):
        page = "<article>" + "".join(f"<div>t{k} " for k in range(n)) + "<p>deep</p>" + "".join(f"u{k}</div>" for k in reversed(range(n))) + "</article>"
        text = wr.extract(page, made([page] * 2))
        assert text.split() == [f"t{k}" for k in range(n)] + ["deep"] + [f"u{k}" for k in reversed(range(n))]
        assert wr.extract(page, None) == text
    side = "<div>" * 120 + "<p>" + "kept " * 20_000 + "</p><div class=comments>" + "<div>gone" * 5000 + "</div>" * 5000 + "</div><p>also kept</p>"
    assert wr.extract(side, None) == "kept " * 19_999 + "kept\nalso kept"
    assert wr.extract("<b>" * 20_000 + "bold", None) == "bold"


ARTICLE = ("<h1>Dish {0}</h1><p>About dish {0}, at some length.</p><h2 id='search'>Ingredients</h2><ul><li>salt {0}</li><li>water {0}</li></ul>"
           "<h2 id='sharing-data'>Method</h2><p>Stir {0} times.</p><section id='discussion'><p>Why {0}?</p></section>"
           "<ul><li><a href=x>Source {0}</a></li><li><a href=y>Other {0}</a></li></ul><p>The end of {0}.</p>")
ARTICLE_TEXT = ("Dish {0}\nAbout dish {0}, at some length.\nIngredients\nsalt {0}\nwater {0}\nMethod\nStir {0} times.\nWhy {0}?\n"
                "Source {0}\nOther {0}\nThe end of {0}.")


def test_the_article_keeps_shared_headings_ids_and_link_lists():
    for form in ("<body><nav>n</nav><article>%s</article><footer>f</footer></body>", "<body><div class=top>Our site</div><div class=text>%s</div><div>All rights kept</div></body>"):
        pages = [(form % ARTICLE).format(k) for k in range(12)]
        assert wr.extract(pages[5], made(pages)) == ARTICLE_TEXT.format(5)


def test_an_article_in_two_parts_and_unlisted_names():
    form = ("<body><div class=adbox>Buy {0}</div><div class=part><p>First half of {0} is this text.</p></div><div class=part><p>Second half of {0} is that text.</p></div>"
            "<ol class=commentlist><li>nice {0}</li><li>not nice {0}</li></ol></body>")
    pages = [form.format(k) for k in range(12)]
    assert wr.extract(pages[2], made(pages)) == "First half of 2 is this text.\nSecond half of 2 is that text."


def test_matching_keeps_order_and_is_largest():
    a, b = (made([p])["d"][0]["d"] for p in ("<body><h1>x</h1><p>a</p><ul></ul><div></div></body>", "<body><p>a</p><div></div><ul></ul></body>"))
    pairs = wr.matching(a, b)
    assert len(pairs) == 2 and pairs == sorted(pairs) and all(a[i]["l"] == b[j]["l"] for i, j in pairs)


def test_all_small_pages(spark, sf_small):
    got = {r.page_id: r for r in wr.op3_extract(spark, sf_small).collect()}
    for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        article = re.sub(r"</?(b|a)\b[^>]*>", "", article).replace("<br>", " ")
        blocks = [" ".join(entities.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(x for x in blocks if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_awkward_rows(spark):
    rows = [(1, "http://a.com/x", None), (2, None, "<p>no url</p>"), (3, "nonsense", ""), (4, "http://a.com/y", PAGE.format(1)),
            (4, "http://a.com/y", PAGE.format(1)), (None, "http://b.com", "<p>" + "long " * 200_000), (5, "http://B.com:80/", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    got = wr.extract_pages(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "" and by[2] == "no url" and by[3] == "" and by[5] == "x" and len(by[None]) == 200_000 * 5 - 1
    assert tables.plain(wr.extract_pages(df.limit(0))) == []
