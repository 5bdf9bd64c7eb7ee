import html as markup
import re

import numpy as np
from pyspark.sql import types as T

from psmweave.llm import extract
from psmweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "own") for i, u, h in rows], SCHEMA)


def _texts(spark, rows, **kw):
    return [r.text for r in sorted(extract.main_text(_pages(spark, rows), **kw).collect(), key=lambda r: r.page_id)]


def test_query_gives_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op3_html_main_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        inside = re.sub("</?(p|br|h1)>", " ", inside).replace("<b>", "").replace("</b>", "")
        assert r.text == " ".join(markup.unescape(inside).split()) and r.n_chars == len(r.text)


def test_marked_blocks_go_and_inline_markup_joins():
    page = """<!doctype html><html><head><title>T</title><script>var t="</p>"</script><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a>Home</a><li>More</ul></nav><div class="ad-box">buy</div>
    <article><header><h1>Head &amp; more &#x41;&eacute;</h1></header><p>one<b>two</b> <i>three</i>
    four<br>five&nbsp;six<aside>not this</aside><p class="share">nor this<p>seven<ul><li>a<li>b</ul>
    <form><input value=x>mail <button>go</button></form><div id="comments"><p>I think</div><!-- hidden -->
    <div hidden>unseen</div><table><tr><td>c1<td>c2</table></article><div class="cookie-notice">we use</div><footer>&copy; x"""
    kept = " ".join(t for s, t in extract.blocks(page) if s == extract.ARTICLE)
    assert kept == "Head & more Aé onetwo three four five six seven a b c1 c2"
    assert all(s == extract.DROPPED for s, t in extract.blocks(page) if s != extract.ARTICLE)


def test_broken_markup():
    assert extract.blocks("<p>a<p>b</div></p>c") == [(0, "a"), (0, "b"), (0, "c")]
    assert extract.blocks("a < b & c <3 <![if x]>d<![foo y]> <") == [(0, "a < b & c <3 d <")]
    assert extract.blocks("x<script>never closed") == [(0, "x")]
    assert extract.blocks("<article>x</article") == [(1, "x")]
    assert extract.blocks("") == extract.blocks("<!-- open") == []


def test_repeated_runs_by_brute_force():
    r = np.random.default_rng(2)
    for run in (1, 2, 3, 5, 6):
        streams = [r.integers(0, 4, int(n)) for n in r.integers(0, 30, 12)]  # 0 ends a block
        want = {}
        for i, s in enumerate(streams):
            for p in range(len(s) - run + 1):
                if extract.END not in (words := s[p : p + run].tolist()):
                    want.setdefault(tuple(words), []).append((i, p))
        got = [sorted(zip(o.tolist(), p.tolist())) for _, o, p in extract.repeated_runs(streams, run)]
        assert sorted(got) == sorted(want.values())


def test_pages_without_a_container_lose_repeated_runs(spark):
    boiler = "Join our club today and get ten percent off everything in store"
    rows = [(i, "http://a.example/x", f"<body><div>Log in</div><div>{boiler}</div><div>Story {i} tells of number {i * 7} and no other one {i}</div>") for i in range(8)]
    rows += [(20, "http://b.example/x", f"<body><div>{boiler}</div><div>Only page</div>")]
    got = _texts(spark, rows)
    assert got[:8] == [f"Story {i} tells of number {i * 7} and no other one {i}" for i in range(8)]
    assert got[8] == f"{boiler} Only page"


def test_chunks_of_a_large_host_count_together(spark, monkeypatch):
    monkeypatch.setattr(extract, "CHUNK_WORDS", 40)
    boiler = "Join our club today and get ten percent off everything"
    rows = [(i, "http://a.example/x", f"<div>{boiler}</div><div>Story{i} has{i} own{i} words{i}</div>") for i in range(40)]
    assert _texts(spark, rows) == [f"Story{i} has{i} own{i} words{i}" for i in range(40)]


def test_copies_are_no_boilerplate(spark):
    story = "The same story told at the same length on many pages of one host"
    rows = [(i, "http://a.example/x", f"<div>{story}</div>") for i in range(6)]
    rows += [(10 + i, "http://a.example/y", f"<article>{story} {i}</article>") for i in range(6)]
    assert _texts(spark, rows) == [story] * 6 + [f"{story} {i}" for i in range(6)]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://h/", ""), (3, "no url", "<p>text</p>"), (3, "no url", "<p>text</p>"), (None, None, "<p>a</p>"), (4, "http://h/", "w " * 50_000)]
    df = extract.main_text(_pages(spark, rows))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in df.collect()) == [(0, 1), (1, 0), (2, 0), (3, 4), (3, 4), (4, 99_999)]
    assert extract.main_text(_pages(spark, [])).count() == 0


def test_equal_surroundings_of_different_articles_are_boilerplate(spark):
    boiler = "<div>Join our club today and get ten percent off</div>"
    rows = [(i, "http://a.example/x", f"{boiler}<article>own text {i}</article>") for i in range(6)]
    rows += [(10 + i, "http://b.example/x", f"{boiler}<article>the same text</article>") for i in range(6)]
    assert _texts(spark, rows) == [f"own text {i}" for i in range(6)] + ["Join our club today and get ten percent off the same text"] * 6


def test_a_notice_on_few_pages_of_a_large_host_goes_and_a_phrase_stays(spark):
    notice = "<div>Our shop is closed on all public holidays of this year</div>"
    own = lambda i: f"Page{i} on the other hand of course has{i} own{i} words{i}"
    rows = [(i, "http://a.example/x", f"{notice if i < 3 else ''}<div>{own(i)}</div>") for i in range(80)]
    assert _texts(spark, rows) == [own(i) for i in range(80)]


def test_comments_and_teasers_in_articles_go_and_inline_words_stay(spark):
    pages = [
        (1, "http://h/1", '<article>Main</article><article class="comment">I think so</article>'),
        (2, "http://h/2", '<main><p>Main</p><article class="comment-reply">I think so</article><p>end</p></main>'),
        (3, "http://h/3", '<article>Main</article><article class="related teaser">Read this too</article>'),
        (4, "http://h/4", '<article><p>Body <span class="search">term</span> <a class="social">link</a> end</p><div class="share">Share</div></article>'),
        (5, "http://h/5", '<article><p>Body</p><ins class="adsbygoogle ads">Buy</ins></article>'),
    ]
    assert _texts(spark, pages) == ["Main", "Main end", "Main", "Body term link end", "Body"]
