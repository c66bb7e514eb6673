import pytest

from estatelens.llm import html_templates
from estatelens.llm.html_templates import Page

PAGE = """<!doctype html><html><head><title>No</title><script>var a = "<p>no</p>";</script></head><body class="x">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice">We use</div><main><article><header><h1>Big &amp; small</h1><p>by X</p></header>
<p>One <b>bold</b>word,<br>two&nbsp; &#233;&lt;
<p>Open <i>para<ul><li>a<li>b <span>c</span></ul><aside>side</aside><form><p>mail</p></form>
<table><tr><td>1<td>2</table><div id="comments"><p>First!</p></div></article></main><footer>&copy; me</footer>"""


def test_main_text_of_a_page():
    assert Page(PAGE).text(frozenset()) == "Big & small\nOne boldword, two é<\nOpen para\na\nb c\n1\n2"


@pytest.mark.parametrize("source, text", [
    ("", ""), ("just text", "just text"), ("<p>a</p><p>b", "a\nb"), ("<div><p>a &lt; b <", "a < b <"), ("a<b", "a"),
    ("</p></div><p>x</p>", "x"), ("<article>a</article><nav>n</nav><article>b</article>", "a\nb"),
    ("<main>m<div class='ad'>x</div></main>out", "m"), ("<script>never closed", ""),
    ("<p title='a>b'>c</p>", "c"), ("<P>U</P><BR>v", "U\nv"),
])
def test_broken_and_bare_pages(source, text):
    assert Page(source).text(frozenset()) == text


def test_deep_nesting_is_linear():
    assert Page("<div>" * 50_000 + "x" + "</div>" * 50_000).text(frozenset()) == "x"


def test_templates_by_host(spark):
    rows = [(i, f"https://A.example/{i}", f"<article><h1>t{i}</h1><p>text {i}</p><div>Read more here</div></article>")
            for i in range(30)]
    rows += [(100 + i, "http://b.example/", "<article><h1>same</h1><p>a copied article</p></article>") for i in range(30)]
    rows += [(200, None, None), (201, "", ""), (201, "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", html_templates.F.lit(1))
    got = html_templates.extract(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[3] == "t3\ntext 3"  # the repeated block is gone
    assert texts[100] == "same\na copied article"  # copies are no template
    assert texts[200] == texts[201] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_templates.extract(pages.limit(0)).count() == 0


def test_templates_of_small_and_large_hosts(spark):
    body = "<article><div class=x1>{}</div><h1>Head {}</h1><p>A text of its own, number {}</p><td>1</td></article>"
    rows = [(i, f"http://small.example/{i}", body.format("Sold by us", i, i)) for i in range(3)]
    rows += [(1000 + i, f"http://large.example/{i}", body.format("In few" if i < 4 else f"Only {i}", i, i)) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    texts = {r.page_id: r.text for r in html_templates.extract(pages).collect()}
    assert texts[1] == "Head 1\nA text of its own, number 1\n1"
    assert texts[1002] == "Head 2\nA text of its own, number 2\n1"  # four of 100 pages have the block
    assert texts[1050] == "Only 50\nHead 50\nA text of its own, number 50\n1"


def test_templates_of_hosts_with_one_title(spark):
    body = "<h1>Site</h1><div class=x1>Sold by us</div><div><h2>Head {}</h2><p>A text of its own, number {}</p></div>"
    rows = [(i, f"http://a.example/{i}", body.format(i, i)) for i in range(20)]
    copied = "<p>A long article that stands at many places of the site, with another date each time it is printed.</p>"
    rows += [(100 + i, f"http://a.example/copy/{i}", f"<h1>Site</h1>{copied}<p>Date {i}</p>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    texts = {r.page_id: r.text for r in html_templates.extract(pages).collect()}
    assert texts[3] == "Head 3\nA text of its own, number 3"
    assert texts[103] == f"{copied[3:-4]}\nDate 3"  # the copies differ by less than a tenth


ARTICLE = "<h1>Title</h1><p>The text of an article about ships and rivers.</p>"


@pytest.mark.parametrize("source, text", [
    ('<div class="content no-sidebar">{}</div>', "Title\nThe text of an article about ships and rivers."),
    ('<article class="post has-comments">{}</article>', "Title\nThe text of an article about ships and rivers."),
    ('<form id="aspnetForm"><div class="page">{}<form class="x"><p>mail</p></form></div></form>', None),
    ('<form><main>{}</main></form>', "Title\nThe text of an article about ships and rivers."),
    ('<main>{}<section id="related-work"><p>Others wrote</p></section><p class="share-price">It rose</p></main>',
     "Title\nThe text of an article about ships and rivers.\nOthers wrote\nIt rose"),
    ('<div class="sidebar"><article>{}</article></div>', "Title\nThe text of an article about ships and rivers."),
    ('<main>{}<div class="cookie-notice">We use</div><ul class="share-buttons"><li>a</ul><div id="user-comments">1st</div></main>',
     "Title\nThe text of an article about ships and rivers."),
    ('<main>{}<form><p>mail</p></form><div class="related posts">More</div></main>',
     "Title\nThe text of an article about ships and rivers."),
])
def test_class_words_and_forms_spare_the_article(source, text):
    got = Page(source.format(ARTICLE)).text(frozenset())
    assert got == text if text is not None else got.startswith("Title\nThe text of an article about ships and rivers.")


def run(spark, bodies):
    rows = [(i, f"http://a.example/{i}", b) for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return [r.text for r in sorted(html_templates.extract(pages).collect())]


def test_articles_may_cite_the_same_paragraph(spark):
    quote = "<p>We hold these truths to be self-evident.</p>"
    parts = [f"<article><h2>Part {i}</h2><p>Own words of part {i}.</p>{quote}<p>End {i}.</p></article>" for i in range(5)]
    assert run(spark, parts) == [f"Part {i}\nOwn words of part {i}.\n{quote[3:-4]}\nEnd {i}." for i in range(5)]
    # without article and main a paragraph is a template only at one place of the tree
    loose = [f"<h2>Part {i}</h2>" + "<p>Some more.</p>" * i + f"<p>Own words of part {i}.</p>{quote}" for i in range(4)]
    assert all(t.endswith(quote[3:-4]) for t in run(spark, loose))
    placed = [f"<div><p>Printed by the site</p><p>Own words of part {i}, and more of them.</p></div>" for i in range(4)]
    assert run(spark, placed) == [f"Own words of part {i}, and more of them." for i in range(4)]


def test_copies_of_an_article_in_parts_keep_their_text(spark):
    body = "".join(f"<div><p>Part {k} of a long article that other pages print too.</p></div>" for k in range(4))
    texts = run(spark, [f"<article>{body}<p>{i}</p></article>" for i in range(4)])
    assert all(t.count("long article") == 4 for t in texts)


def plain_templates(pages):
    """Template keys per page of one host, by plain sets."""
    seen = {}
    for page in pages:
        found, total = page.subtrees()
        for key, chars in found.items():
            if total - chars >= html_templates.OWN_SHARE * total:
                seen.setdefault(key, set()).add(page.text(frozenset()))
    return frozenset(k for k, texts in seen.items() if len(texts) >= html_templates.MIN_PAGES)


def test_random_sites_against_a_plain_version(spark):
    import random

    rng = random.Random(7)
    blocks = ["<div>Sold here</div>", "<section><p>On all pages</p></section>", "<p>Loose line</p>", "<h2>Head</h2>", "<div class=ad>x</div>"]

    def body():
        inner = "".join(rng.choice([*blocks, f"<p>own {rng.random()}</p>", f"<div>own {rng.random()}</div>"]) for _ in range(rng.randint(1, 8)))
        return inner if rng.random() < 0.5 else f"<article>{inner}</article>{rng.choice(blocks)}"

    bodies = [body() for _ in range(60)]
    pages = [Page(b) for b in bodies]
    templates = plain_templates(pages)
    assert run(spark, bodies) == [p.text(templates) for p in pages]
