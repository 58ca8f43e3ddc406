import html
import math
import re

import pytest

from pipeops.llm import style_tree as s

PAGES = "page_id long, url string, html string"


def plain(page):
    """The article of the pages given, by regular expressions."""
    article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S).group(1)
    blocks = (html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m.group() == "<br>" else "", part)) for part in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def test_pages_match_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in s.main_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html)) and got[r.page_id].url == r.url


def texts(spark, rows, **options):
    return {r.page_id: r.text for r in s.main_text(spark.createDataFrame(rows, PAGES), **options).collect()}


def test_low_importance_branches_go(spark):
    shared = '<div><div class="top">Welcome to the site</div><div class="story"><h2>Title {i}</h2>Body of {i}<p>More {i}</div><div class="b1">All rights reserved</div></div>'
    rows = [(i, f"https://h.example/{i}", shared.format(i=i)) for i in range(20)] + [(50, "https://alone.example/", shared.format(i=50))]
    got = texts(spark, rows)
    assert got[3] == "Title 3\nBody of 3\nMore 3"
    assert got[50] == "Welcome to the site\nTitle 50\nBody of 50\nMore 50\nAll rights reserved"  # one page tells nothing


def test_copies_of_an_article_on_one_host_stay(spark):
    rows = [(i, "https://h.example/a", "<nav>x</nav><article><h1>T</h1><p>Same text</article>") for i in range(30)]
    assert set(texts(spark, rows).values()) == {"T\nSame text"}


@pytest.mark.parametrize(
    "given,want",
    [
        ("<article><header><h1>A</h1></header><p>b<aside>no</aside>c</article><header>no</header>", "A\nb\nc"),
        ("<main><p>a &amp; b&nbsp;&#233;&eacute; &unknown; &amp</main>", "a & b éé &unknown; &"),
        ("<body><article>one <b>two<br>three</b>\n\tfour<ul><li>x<li>y</ul></article><section class='comments'>no</section>", "one two three four\nx\ny"),
        ("<article><p>a</p><script>if (1 < 2) '</p>'</script><style>p{}</style><form>no<input></form><p>b<!-- no --></p><div class='ad box'>no</div><div id=cookie-notice>no</div></article>", "a\nb"),
        ("<article><p>open <i>never closed<p>next", "open never closed\nnext"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
        ("<article></article>", ""),
        ("plain text only", "plain text only"),
        ("", ""),
        (None, ""),
        ("<article><p>a<!-- cut", "a"),
        ("<div role=main>in</div><div>out</div>", "in"),
        ("</p></div><p>a</i></p>", "a"),
    ],
)
def test_blocks(spark, given, want):
    assert texts(spark, [(1, "http://x/", given)]) == {1: want}


def test_edge_rows(spark):
    rows = [(1, None, "<article>a</article>"), (None, "http://[bad", None), (1, None, "<article>a</article>"), (2, "http://x/", "<p>w" * 3000), (3, "http://x/", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "url AS host", "html AS text", "page_id AS path", "url AS page")
    got = sorted((str(r.page_id), r.n_chars, r.n_blocks) for r in s.main_text(pages).collect())
    assert got == sorted([("1", 1, 1), ("1", 1, 1), ("None", 0, 0), ("2", 5999, 3000), ("3", 4, 1)])
    assert s.main_text(pages.limit(0)).count() == 0


def test_importance_formula(spark):
    rows = [(i, "http://x/", f"<div class=a>same</div><div class=b>own {i}</div><div class=c>{'<i>x</i>' if i < 2 else 'x'}</div>") for i in range(4)]
    read = s.parsed(spark.createDataFrame(rows, PAGES))
    got = sorted((round(r.presentation, 6), round(r.content, 6), round(r.importance, 6)) for r in s.importances(read).collect())
    half = -2 * 0.5 * math.log(0.5) / math.log(4)
    assert got == sorted([(0, 0, 0), (0, 1, 0.9), (round(half, 6), 0, round((1 - 0.81) * half, 6))])


@pytest.mark.parametrize(
    "given,want",
    [
        ("<html><head><title>t</title><meta charset=utf-8><body><p>law</body></html>", "law"),
        ("<head><title>t</title><p>law", "law"),
        ("<head><title>t</title>law", "law"),
        ("<head><noscript><img src=x><p>no</noscript><title>t</title></head><p>a", "a"),
        ("<body><form id=aspnetForm><input><div>story that is long</div><nav>no</nav></form>", "story that is long"),
        ("<form><article><p>a</article></form>", "a"),
        ("<div>story that is long</div><form>no</form>", "story that is long"),
        ("<main class='has-sidebar'><p>a<div class=sidebar>no</div></main>", "a"),
        ("<div class='layout with-nav'><p>a</div>", "a"),
        ("<div class='sidebar right'><article><p>a</article></div>", "a"),
        ("<article class='post comments-open'>a<section class=comments><article class=comment>no</article></section></article>", "a"),
        ("<div class='content ad-free'>a</div>", "a"),
        ("<article class='promo'>a</article><div id=comments><article class=comment>no</article></div>", "a"),
        ("<p>a</p><aside><article>no</article></aside>", "a"),
    ],
)
def test_wrappers_do_not_empty_a_page(spark, given, want):
    assert texts(spark, [(1, "http://x/", given)]) == {1: want}


def test_copies_count_as_one_page(spark):
    story = "<div class=page><h2>Title {i}</h2><div class=story>Body {i}</div></div><div class=ad>{n}</div>"
    rows = [(n, f"https://copies.example/{n}", story.format(i=0, n=n)) for n in range(20)]
    rows += [(100 + i, "https://mixed.example/", story.format(i=max(i, 15), n=i)) for i in range(20)]
    got = texts(spark, rows)
    assert {got[n] for n in range(20)} == {"Title 0\nBody 0"}
    assert [got[100 + i] for i in range(20)] == [f"Title {max(i, 15)}\nBody {max(i, 15)}" for i in range(20)]
    counted = s.importances(s._once(s.parsed(spark.createDataFrame(rows, PAGES)).selectExpr("*", "page_id AS row_of_page")))
    assert {(r.host, r.pages) for r in counted.collect()} == {("copies.example", 1), ("mixed.example", 5)}


def test_the_tree_decides_in_and_beside_articles(spark):
    page = "<div class=story>Story {i}</div><article><p>Words {i}</p><div class=b>Written by us</div></article><div class=c>All rights reserved</div>"
    got = texts(spark, [(i, "http://many/", page.format(i=i)) for i in range(30)] + [(50, "http://one/", page.format(i=50))])
    assert [got[i] for i in range(30)] == [f"Story {i}\nWords {i}" for i in range(30)]
    assert got[50] == "Words 50\nWritten by us"  # one page tells nothing, names decide


def test_teasers_do_not_hide_a_story(spark):
    page = "<div>A long story that is more than its teasers</div><article>one</article><article>two</article>"
    assert texts(spark, [(1, "http://x/", page)]) == {1: "A long story that is more than its teasers\none\ntwo"}


def test_deep_nesting_takes_linear_memory_and_time():
    import time
    import tracemalloc

    sizes = []
    for n in (12_500, 50_000):
        for tag in ("div class=wrapper", "ul", "span", "section"):
            html = "<body><article><p>Before.</p>" + f"<{tag}>" * n + "the story" + f"</{tag.split()[0]}>" * n + "</article>"
            began = time.time()
            tracemalloc.start()
            page = s.Page(html)
            sizes.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert [b[-1] for b in page.blocks] == ["Before.", "the story"] and time.time() - began < 60
    assert all(big < 6 * small for small, big in zip(sizes[:4], sizes[4:], strict=True)) and max(sizes) < 200 << 20
