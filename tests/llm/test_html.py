import pytest
from pyspark.sql import functions as F

from readloom.llm import htmltext, queries

BODY = "<h1>A title</h1><p>First &amp; long paragraph, with <b>bold</b> words. And more.<br>next<p>Second paragraph, also long enough, here it is.</p><p>ok.</p>"
WANT = "A title First & long paragraph, with bold words. And more. next Second paragraph, also long enough, here it is. ok."
AROUND = ("<nav><a href=x>Menu</a></nav><div class='ad'>Buy, now. Really, buy.</div>", "<div id=\"comments\"><p>A reader, long comment, says this. And that, too.</p></div><footer>Foot, er.</footer>")


@pytest.mark.parametrize("wrap", ["article", "main", "div class=post"])
def test_article(wrap):
    page = f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{AROUND[0]}<{wrap}>{BODY}</{wrap.split()[0]}>{AROUND[1]}</body></html>"
    assert htmltext.main_text(page) == WANT
    assert htmltext.main_text(page.replace("</body></html>", "")) == WANT


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("  \n", ""), ("<script>x</script>", ""), ("<!-- a", ""), ("plain, text", "plain, text"), ("<p>a < b</p>", "a < b"), ("<p>x</p", "x"), ("<P CLASS=x>A<br/>b&#33;</P>", "A b!"),
    ("<form>f</form>", ""), ("<p hidden>no</p><p>yes, it is.</p>", "yes, it is."), ("<ul><li>a one<li>b two</ul>", "a one b two"),
])
def test_small_pages(html, text):
    assert htmltext.main_text(html) == text


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-menu", "layout sidebar", "search"])
@pytest.mark.parametrize("wrap", ["article", "main", "section"])
def test_words_of_wrappers(name, wrap):
    page = f"<body>{AROUND[0]}<div class='{name}'><div id='{name}'><{wrap}>{BODY}</{wrap}></div></div>{AROUND[1]}</body>"
    assert htmltext.main_text(page) == WANT


def test_ids_of_headings_and_sections():
    inside = "<section id=search><h2 id='related-work'>Related</h2><p>About it, a line.</p></section><h2 id=notice>Notice</h2><p>And more, again.</p>"
    page = f"<body>{AROUND[0]}<article>{BODY}{inside}<div class=related>Other, pages.</div><section class='ad-300x90'>Buy, it.</section></article>{AROUND[1]}</body>"
    assert htmltext.main_text(page) == f"{WANT} Related About it, a line. Notice And more, again."


def test_comments_stay_out():
    comments = "<div class=comments-area id=comments><article><p>A reader, who says this and that, at some length, says it.</p></article></div>"
    assert htmltext.main_text(f"<main><article>{BODY}</article>{comments}</main>") == WANT
    assert htmltext.main_text(f"<article>{BODY}</article><div id=comments>{'<p>A long, long comment.</p>' * 50}</div><div class=ad>{'Buy, it. ' * 90}</div>") == WANT
    assert htmltext.main_text("<div class=ad>t" * 30_000) and htmltext.main_text("<div class=ad>" * 30_000 + "<article>t" * 30_000)


LONG = "<p>A long, long line of the text, which goes on and on.</p>"


@pytest.mark.parametrize(("html", "starts", "n"), [
    (f"<div class=post><h1>Title</h1><div class=lead>{LONG}</div><div class=text>{LONG * 9}</div></div>", "Title A long", 10),
    (f"<div><div>{LONG * 8}</div><div>{LONG}</div><div>{LONG}</div></div>", "A long", 10),
    (f"<main><h1>Title</h1><article>{LONG * 17}</article><article>{LONG * 3}</article></main>", "Title A long", 20),
    (f"<main><h1>Title</h1><article>{LONG * 5}</article></main>", "Title A long", 5),
    (f"<div><article>{LONG * 9}<ul><li>b</ul></article><article><h2>c</h2>{LONG}</article></div>", "A long", 10),
])
def test_all_content_is_returned(html, starts, n):
    got = htmltext.main_text(f"<body>{AROUND[0]}{html}{AROUND[1]}</body>")
    assert got.startswith(starts) and got.count("long line") == n and (" b" in got and " c " in got) == ("<li>b" in html)


@pytest.mark.parametrize(("html", "text"), [
    ("super<wbr>cali<img src=x>fragi, <script>no</script>listic.", "supercalifragi, listic."),
    ("one<br>two, three", "one two, three"),
    ("a <span hidden>not this</span>line, goes on", "a line, goes on"),
    (f"<article><header>By line, a date.</header>{LONG}</article>", LONG[3:-4]),
    (f"<main><article>{LONG}<article class='comment'>{LONG * 3}</article></article></main>", LONG[3:-4]),
    (f"<main><article>{LONG}</article><article id='comment-7' class='body'>{LONG * 3}</article></main>", LONG[3:-4]),
    (f"<article class='post has-comments'>{LONG}</article>", LONG[3:-4]),
    ("<nav>Only, a menu.</nav><form>Only, a form, of some length, really.</form>", ""),
])
def test_lines_headers_and_comments(html, text):
    assert htmltext.main_text(f"<body>{html}</body>") == text


def plain_ratios(blocks, threshold=htmltext.THRESHOLD):
    """The content paths of (path, text) blocks, from the definition: by sums over all blocks for each path."""
    marks = lambda ts: sum(t.count(c) for t in ts for c in ".,;:!?")

    def ratio(path):
        up = path.rsplit("/", 1)[0]
        own = [t for p, t in blocks if p == path]
        kin = [t for p, t in blocks if p.rsplit("/", 1)[0] == up]
        length, points = ((f(own) / len(own) + f(kin) / len(kin)) / 2 for f in (lambda ts: sum(map(len, ts)), marks))
        return length * (1 + points) * (1e-6 if path[0] == "!" else 1)

    weight = {p: (1e-6 if p[0] == "!" else 1) for p, _ in blocks}
    mean = sum(weight[p] * len(t) * ratio(p) for p, t in blocks) / sum(weight[p] * len(t) for p, t in blocks)
    return {p for p, _ in blocks if ratio(p) >= max(1, threshold * mean)}


def random_page(rng):
    """A well-formed page without an article: (html, blocks as (path, text))."""
    blocks = []

    def words(n, marks):
        return " ".join(rng.choice(["lo", "ipsum", "dolorem", "sit"]) + (rng.choice(",.;") if rng.random() < marks else "") for _ in range(n))

    def element(tag, path, depth, noise):
        here, noise = f"{path}/{tag}", noise or tag in ("nav", "footer")
        if depth == 0 or rng.random() < 0.3:
            t = words(rng.randint(1, 40 if tag == "p" else 6), 0.2 if tag == "p" else 0.02)
            blocks.append(("!" * noise + here, t))
            return f"<{tag}>{t}</{tag}>"
        return f"<{tag}>" + "".join(element(rng.choice(["div", "p", "ul", "nav", "section"] if depth > 1 else ["p", "li", "h2"]), here, depth - 1, noise) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    while not blocks:
        html = element("body", "", 4, False)
    return html, blocks


def test_ratios_against_the_definition():
    import random

    rng, cut = random.Random(8), 0
    for _ in range(600):
        html, blocks = random_page(rng)
        if "<p><" in html:  # a paragraph in a paragraph closes it: not well-formed
            continue
        got = [(path, " ".join(text.split())) for _, path, _, text in htmltext.text_nodes(html)]
        assert got == blocks
        stats = {}
        for p, t in blocks:
            s = stats.setdefault(p, [0, 0, 0])
            for k, v in enumerate((1, len(t), sum(t.count(c) for c in ",.;"))):
                s[k] += v
        want = plain_ratios(blocks)
        assert htmltext.content_paths(stats) == want
        text = htmltext.main_text(html)
        for p, t in blocks:
            assert t in text or p not in want
        cut += len(want) < len(stats)
    assert cut > 20


def test_the_threshold_decides(sf_dir, monkeypatch):
    """Without it, pages would come out with their menus, adverts and footers."""
    import duckdb

    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{sf_dir}/pages.parquet'").fetchall()]
    with_it = [htmltext.main_text(h) for h in pages]
    monkeypatch.setattr(htmltext, "content_paths", lambda stats: set(stats))
    assert sum(a != htmltext.main_text(h) for a, h in zip(with_it, pages, strict=True)) == len(pages) > 0


def test_pages_against_plain_substitution(sf_dir):
    """The pages of the tables hold one article each: its markup replaced by patterns."""
    import re
    from html import unescape

    import duckdb

    for page_id, html in duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", re.sub(r"<!--.*?-->|<script.*?</script>|</?b>", "", inner, flags=re.S))
        want = " ".join(" ".join(unescape(b).split()) for b in blocks if unescape(b).strip())
        assert htmltext.main_text(html) == want, page_id


def test_deep_and_long_pages_stay_linear():
    assert htmltext.main_text("<div>t" * 30_000 + "</b></x>" * 30_000).count("t") > 29_000
    assert len(htmltext.main_text("<a " * 50_000)) > 0 and htmltext.main_text("<p>w</p>" * 50_000).count("w") == 50_000


def test_query(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op5_html_extraction(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == htmltext.main_text(pages[r.page_id].html)
        assert "track(" not in r.text and "<" not in r.text
    df = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(5))
    assert [r.text for r in htmltext.extract(df).collect()] == ["", "", ""] and htmltext.extract(df.limit(0)).count() == 0
