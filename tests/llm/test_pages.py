import re

from conftest import SF

from evidentia.llm import pages as op

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"


def text_of(source, template=None):
    return op.main_text(source, template)


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, frame int")


def test_article_alone():
    source = HEAD + """<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- ad <p>no</p> -->
      <div class="ad">Buy</div><main><article><h1>Title &amp; more</h1><p>One <b>bold</b>\n word<br>next &copy;
      <p>Two<aside>side</aside><div class="share-bar">Share</div><form><input>Sign up<button>Go</button></form><ul><li>first<li>second</ul>
      <div class="notice">Cookies</div><table><tr><td>a<td>b</table><pre>x  y</pre><p class="disclaimer">No</p>
      <section id="comments"><article class="comment"><p>Me too</p></article></section></article></main><footer>foot</footer></body></html>"""
    assert text_of(source) == "\n\n".join(["Title & more", "One bold word next ©", "Two", "first", "second", "a", "b", "x y"])


def test_broken_markup():
    for source, want in (("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<article><p>a &am", "a &am"), ("<article><p>a<p cla", "a"), ("a < b and c", "a < b and c"),
                         ("<script>never ends <p>x", ""), ("<div><b>x<div>y</b>z", "x\n\nyz"), ("<p>&#x41;&#66;&nbsp;c&lt;", "AB c<"), ("</p></div>x", "x"),
                         ("<article><p>x</article><p>y", "x"), ("<title>never ends<body><p>x", "x"), ("<p hidden>a</p><p>b", "b"), ("<a href='>'>q</a> w", "q w")):
        assert text_of(source) == want, source


def test_template_tells_text_from_boilerplate(spark):
    """No element or class says what is what: only the pages of a host together do."""
    def page(i, cut=False):
        source = (f"<html><body><table class=t><tr><td><div>Our site</div><div>All rights kept</div></td><td><div class=x><span>Story {i}</span>"
                  + "".join(f"<p>{w} paragraph of page {i} with its own words {i * j}</p>" for j, w in enumerate(("First", "Second"))) + "</div><div>Call us</div></td></tr></table></body></html>")
        return source[: source.index("Call us")] if cut else source

    rows = [(i, f"https://host.example/{i}", page(i, cut=i % 7 == 0)) for i in range(30)]
    got = {r["page_id"]: r for r in op.extract(frame(spark, rows).repartition(4)).collect()}
    for i in range(30):
        want = f"Story {i}\n\nFirst paragraph of page {i} with its own words 0\n\nSecond paragraph of page {i} with its own words {i}"
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


def test_equal_vectors_share_a_class(spark):
    rows = [(i, "http://h/x", f"<html><body><nav>menu</nav><article><p>text {i}</p>{'<p>two</p>' if i % 2 else ''}</article></body></html>") for i in range(10)]
    host = frame(spark, rows).withColumn("host", op.F.lit("h"))
    (found,) = op.templates(host).collect()
    template = op.Template(found["frame"])
    classes = {}
    for t in found["frame"]:
        classes.setdefault(t["vector"], []).append(t)
    root = next(c for c in classes.values() if any(t["token"] == 0 for t in c))
    assert len(root) == 5  # the page, html, body, nav, article
    assert template.main is not None


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = op.extract(pages).collect()
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(got) == len(source)
    for r in got:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r["page_id"]], re.S)[1]
        assert r["n_chars"] == len(r["text"])
        words = lambda s: re.sub(r"[^\w]+", " ", op.html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", s))).split()
        assert words(r["text"]) == words(inside)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "no host", "<p>x"), (2, "http://h", ""), (2, "http://h", ""), (3, "http://H/", "<article>" + "<div>" * 3000 + "deep " * 1000)]
    got = sorted(((r["page_id"], r["text"]) for r in op.extract(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, ""), (1, "x"), (2, ""), (2, ""), (3, ("deep " * 1000).strip())], key=repr)
    assert op.extract(frame(spark, [])).count() == 0


def test_template_decides_where_articles_are_marked(spark):
    """A small teaser is an article, the text stands beside it; a line of the template stands inside an article."""
    def teaser(i):
        return f"<body><div class=top><article>Teaser {i}</article></div><div class=story><p>Long story of page {i} with words of its own {i * 7}<p>and an end {i}</div></body>"

    def line(i):
        return f"<body><div>Our site</div><article><p>Read this on our site<p>Long story of page {i} with words of its own {i * 7}</article></body>"

    rows = [(i, f"http://a/{i}", teaser(i)) for i in range(8)] + [(10 + i, f"http://b/{i}", line(i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in op.extract(frame(spark, rows)).collect()}
    for i in range(8):
        assert got[i] == f"Long story of page {i} with words of its own {i * 7}\n\nand an end {i}"
        assert got[10 + i] == f"Long story of page {i} with words of its own {i * 7}"


def test_repeated_template_text_and_hosts_of_few_pages(spark):
    def twice(i):
        bar = "<div>Home</div><div>About us</div>"
        return f"<body>{bar}<div>Long story of page {i} with words of its own {i * 7}</div>{bar}<div>All rights</div></body>"

    def listed(i):
        rows = "".join(f"<div class=row><b>Says</b><p>thought {i} {k} at some length</div>" for k in range(1 + i % 3))
        return f"<body><div class=story><p>Long story of page {i}{'<p>yes' * (1 + i % 2)}{rows}</div></body>"

    rows = [(i, f"http://few/{i}", twice(i)) for i in range(2)] + [(10 + i, f"http://more/{i}", listed(i)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in op.extract(frame(spark, rows)).collect()}
    for i in range(2):
        assert got[i] == f"Long story of page {i} with words of its own {i * 7}"
    for i in range(9):  # "Says" comes with every row; "yes" as often as it likes
        own = [f"Long story of page {i}", *["yes"] * (1 + i % 2), *(f"thought {i} {k} at some length" for k in range(1 + i % 3))]
        assert got[10 + i] == "\n\n".join(own)
