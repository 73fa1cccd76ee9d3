import html
import re

import pytest

from krunch.llm import html_blocks, html_crf


@pytest.fixture(scope="module")
def crf():
    return html_crf.model()


def test_held_out_pages(crf):
    right = total = 0
    for some, labels in html_crf.labelled(range(50_001, 50_400)):
        right += sum(a == b for a, b in zip(crf.decode(some), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_path(crf):
    from itertools import product

    some = html_crf.labelled([77])[0][0][:9]
    score = lambda path: (
        crf.begin[path[0]] + crf.end[path[-1]] + sum(sum(crf.weights.get(f, 0) for f in x) for x, s in zip(html_crf.features(some), path, strict=True) if s) + sum(crf.change[a, b] for a, b in zip(path, path[1:]))
    )
    assert tuple(map(int, crf.decode(some))) == max(product((0, 1), repeat=len(some)), key=score)


PAGES = [
    ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title</h1><p>One&nbsp;two &amp; three.</p><p><b>Bold <i>text</i><br>goes on<p>Next</article><footer>&copy; us</footer>", "Title\n\nOne two & three.\n\nBold text goes on\n\nNext"),
    ('<body><header>Site</header><main><article class="post"><h1>T</h1><script>if (a</p>b) {}</script><p>Body text here.</p><div class="ad">Buy now</div><p>More text.</p></article></main><aside>Side</aside><div class="comments"><p>Nice one!</p></div>', "T\n\nBody text here.\n\nMore text."),
    ("<article><h1>Cut off</h1><p>A paragraph that ends in the mid", "Cut off\n\nA paragraph that ends in the mid"),
]


#: Nothing but divs: the text must tell.
PLAIN = (
    "<html><body><div><div><p>The first paragraph tells at some length what happened on that day in the old town. It has a second sentence too.</p>"
    "<p>Another paragraph goes on with the story, and it says who was there. Nobody else had seen it, they said.</p></div></div></body></html>"
)


def test_page_without_names(crf):
    assert html_crf.main_text(PLAIN, crf).count("\n\n") == 1
    menu = '<div><div><a href="/a">Home</a></div><div><a href="/b">News</a></div><div><a href="/c">About us</a></div></div>'
    assert html_crf.main_text(PLAIN.replace("<body>", "<body>" + menu), crf) == html_crf.main_text(PLAIN, crf)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text", "<p>x" * 50_000, "<div class='a b'><span>" * 50_000, "<b>" * 100_000 + "x", "<ul><li>" * 50_000 + "y" + "</ul>" * 50_000, "".join(f"<div class=n{'abcdefghij'[k % 10] * (k % 50)}>" for k in range(50_000)) + "z"])
def test_deep_pages_take_linear_time(crf, page):
    import time

    start = time.process_time()
    assert isinstance(html_crf.main_text(page, crf), str)
    assert time.process_time() - start < 20


@pytest.mark.parametrize("case", range(len(PAGES)))
def test_pages(crf, case):
    page, want = PAGES[case]
    assert html_crf.main_text(page, crf) == want


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p>", "</p></p>", "<!-- no end", "<script>never", "a < b > c", "<a b='c>d'>x", "<table><tr><td>1<td>2<tr><td>3", "&am &#x41; &bogus;", "<title>t</title><textarea><p>x", "\x00<p>\x01", "<div " + "a" * 10000])
def test_odd_pages(crf, page):
    assert isinstance(html_crf.main_text(page, crf), str)


def test_blocks():
    found = html_blocks.blocks('<div class="Box main"><p>a <b>b</b>\n c<p>d<ul><li>e<li>f</ul></div>tail<style>p{}</style>')
    assert [b.text for b in found] == ["a b c", "d", "e", "f", "tail"]
    assert found[0].path == ("div.box.main", "p") and found[2].path == ("div.box.main", "ul", "li") and found[4].path == ()
    assert html_blocks.blocks("<p><a href=x>link</a> text")[0].linked == 4


def test_frame(spark, tables, crf):
    rows = [(1, "u", PAGES[0][0]), (2, None, None), (None, "v", ""), (1, "u", PAGES[0][0])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_crf.extract(frame.selectExpr("*", "1 AS text")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == sorted([(0, 0), (1, len(PAGES[0][1])), (1, len(PAGES[0][1])), (2, 0)])
    assert html_crf.extract(frame.limit(0)).count() == 0


def test_made_pages(tables):
    """The synthetic pages' articles, cut out by their own tags."""
    for r in html_crf.extract(tables("pages")).join(tables("pages").select("page_id", "html"), "page_id").collect():
        found = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        body = re.sub(r"<[^>]*(>|\Z)", lambda m: "\0" if re.match(r"</?(p|h1|article)\b", m[0]) else " ", found[1]) if found else ""
        assert r.text == "\n\n".join(x for x in (" ".join(html.unescape(y).split()) for y in body.split("\0")) if x)


@pytest.mark.parametrize("end,feature", [("© Example", "sign:copyright"), ("a | b", "sign:bar"), ("It ends here.", "ends:1"), ("One. Two. Three. Four", "stops:3"), ("Every Word Here Is Capital " * 400, "capitals:2")])
def test_long_blocks_are_read_to_their_end(end, feature):
    """What only shows behind the first thousands of characters counts as it does in a short block."""
    long = html_blocks.blocks("<p>" + "word " * 1500 + end)
    assert feature in html_crf.features(long)[0]
    assert feature not in html_crf.features(html_blocks.blocks("<p>" + "word " * 1500 + "word"))[0]
