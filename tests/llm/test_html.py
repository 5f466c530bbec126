from __future__ import annotations

from cinderlog.llm import html


def text(page, template=frozenset()):
    return html.main_text(html.parse(page), set(template))


def test_roles_and_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>menu</a></nav><!-- <p>no</p> -->
      <div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>One  <i>t</i>wo<br>three<p>F&uuml;r &#8364; &lt;x&gt;</p><div class="comments">me too</div><form>f</form><aside>s</aside></article><footer>c</footer>"""
    assert text(page) == "A & B One two three Für € <x>"


def test_without_article_template_subtrees_go():
    pages = [f"<body><div><p>Home</p><p>About</p></div><div><p>story {i} here</p></div><p>bye</p></body>" for i in range(4)]
    seen = {}
    for p in pages:
        for h in html.candidates(html.parse(p)):
            seen[h] = seen.get(h, 0) + 1
    template = {h for h, n in seen.items() if n >= 3}
    assert [text(p, template) for p in pages] == [f"story {i} here" for i in range(4)]


def test_broken_markup():
    assert text("") == ""
    assert text("plain words") == "plain words"
    assert text("<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>") == "a b c d e f"
    assert text("<article><p>open <script>x</article>") == "open"
    assert text("a < b <p") == "a < b <p"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text('<article class="post"><header><h1>T</h1></header><p hidden>no</p><p>y</p></article>') == "T y"


def test_extract(spark):
    story = "".join(f"<p>par {i}</p>" for i in range(3))
    rows = [(i, f"https://h.example/{i}", f"<body><div><span>Site</span></div><section>{story}<p>own {i}</p></section></body>", "x") for i in range(5)]
    rows += [(9, None, None, "x"), (10, "not a url", "", "x"), (9, "https://h.example/9", "<article><p>par 0</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumnRenamed("text", "template")
    found = html.extract(df).collect()
    assert len(found) == len(rows)
    texts = {(r.page_id, r.url): r.text for r in found}
    assert texts[0, "https://h.example/0"] == "own 0"  # the rest is the host's template: no page has an article
    assert texts[9, "https://h.example/9"] == "par 0"  # an article's own words stay
    assert texts[9, None] == texts[10, "not a url"] == ""
    assert all(r.n_chars == len(r.text) for r in found)
    assert html.extract(df.limit(0)).count() == 0


def test_site_blocks_inside_articles_go(spark):
    """Blocks that recur in a host's articles, without a name that tells their role; the articles' own words stay."""
    share = '<div class="teilen"><p>Beitrag teilen</p></div>'
    page = "<body><article>{share}<h2>Zutaten</h2><p>own {i} <b>Tip</b></p>{more}</article></body>"
    rows = [(i, f"https://a.example/{i}", page.format(share=share, i=i, more="<p>quoted by two</p>" if i < 2 else "")) for i in range(6)]
    rows += [(20 + i, f"https://b.example/{i}", page.format(share=share, i="copied", more="")) for i in range(5)]  # one article five times
    rows += [(30, "https://c.example/", page.format(share=share, i=30, more=""))]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(6)] == [f"Zutaten own {i} Tip" + " quoted by two" * (i < 2) for i in range(6)]
    assert {found[20 + i] for i in range(5)} == {"Beitrag teilen Zutaten own copied Tip"}
    assert found[30] == "Beitrag teilen Zutaten own 30 Tip"


def test_the_test_tables(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        plain = re.sub(r"<[^>]*>", "\n", re.sub(r"</?b>", "", article))
        assert r.text == " ".join(unescape(plain).split())


def test_names_and_attributes():
    """Only whole names of roles count, and hidden only as an attribute."""
    page = (
        '<article><p title="the hidden cost of x">one</p><div class="post-header"><h1>two</h1></div><p id="related-work">three</p><p class="social-science">four</p>'
        '<p hidden>no</p><p class="x" hidden="">no</p><div class="share-bar">no</div><div id="cookieNotice">no</div></article>'
    )
    assert html.main_text(html.parse(page), set()) == "one two three four"


def test_a_very_long_page():
    page = "<article>" + "".join(f"<p>line {i}</p>" for i in range(60_000)) + "</article>"
    assert html.main_text(html.parse(page), set()) == " ".join(f"line {i}" for i in range(60_000))


def without_names(page):
    """A page whose tags and names don't tell what is what."""
    import re

    page = re.sub(r"<(/?)(article|nav|footer|aside|header|main|section|form)\b", r"<\1div", page)
    return re.sub(r'\s(class|id|role)=("[^"]*"|[^\s>]+)', "", page)


def test_pages_without_names_equal_brute_force_counts(spark):
    """Templates counted in plain Python; and with articles renamed, no article's text is lost and most are found exactly."""
    import collections

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 4 = 0").collect()
    plain = [without_names(r.html) for r in pages]
    # a block that every third page of a host has in its text, and one that all have around it
    plain = [p.replace("<h1>", "<div><p>Teilen</p></div><h1>", 1) if i % 3 else p for i, p in enumerate(plain)]
    df = spark.createDataFrame([(r.page_id, r.url, p) for r, p in zip(pages, plain, strict=True)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.extract(df.repartition(5)).collect()}
    trees, hosts = [html.parse(p) for p in plain], [html._host(r.url) for r in pages]
    outside, inside, total, differing = collections.Counter(), collections.defaultdict(set), collections.Counter(hosts), collections.defaultdict(set)
    for host, root in zip(hosts, trees, strict=True):
        outside.update((host, x) for x in html.candidates(root))
        blocks, article = html.inner_candidates(root)
        if article:
            differing[host].add(article)
            for x in blocks:
                inside[host, x].add(article)
    equal = lost = 0
    for r, host, root in zip(pages, hosts, trees, strict=True):
        if html._regions(root) == [root]:
            template = {x for x in html.candidates(root) if outside[host, x] >= max(3, 0.01 * total[host])}
        else:
            template = {x for x in html.inner_candidates(root)[0] if len(inside[host, x]) >= max(3, 0.5 * len(differing[host]))}
        assert found[r.page_id] == html.main_text(root, template)
        article = html.main_text(html.parse(r.html), set())
        lost += article not in found[r.page_id]  # paragraphs of near copies may be half of a small host's articles
        equal += article == found[r.page_id]
    assert equal > 0.75 * len(pages) and lost <= 0.01 * len(pages)
    assert sum("Teilen" not in t for t in found.values()) > 0.6 * len(pages)  # counts decide


def test_core():
    words = " ".join(f"word{i}" for i in range(120))
    around = '<div><ul><li><a href="/">home</a></li></ul></div><div>advert text</div>{}<div>small print</div>'
    assert text(around.format(f"<div><h2>T</h2><div>{words}</div><div>{words}</div></div>")) == f"T {words} {words}"
    # one paragraph with most of the words isn't a core by itself
    assert text(around.format(f"<div><h2>T</h2><div>{words}</div><div>more</div></div>")) == f"T {words} more"
    assert text(around.format("<div><h2>T</h2><p>few words</p></div>")) == "home advert text T few words small print"
    links = "".join(f'<li><a href="/{i}">{words}</a></li>' for i in range(3))
    assert text(f"<div><ul>{links}</ul></div><div><p>{words}</p><p>end</p></div>") == f"{words} end"
