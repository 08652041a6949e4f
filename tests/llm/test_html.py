"""Main text on small pages, and template removal on a host."""

from __future__ import annotations

from techfolio.llm import html_main as H

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>Menu</nav><div class=cookie-notice>We use cookies</div>
<article class="post"><header class="article-header"><h1>Title &amp; more</h1></header><p>One <b>two</b>
 three&nbsp;four<p>Five<br>six<ul><li>a<li>b</ul><div class="ad">Buy</div><blockquote>Q <i>x</i></blockquote><form><input>sub</form>
<table><tr><td>c1<td>c2</table><pre>x  y</pre><script>var a="</p>"</script><section id="comments"><p>nice</p></section><footer>tags</footer></article>
<aside>side</aside><footer>f</footer>"""


def test_blocks_of_a_page():
    assert H.blocks(H.parse(PAGE)) == ["Title & more", "One two three four", "Five six", "a", "b", "Q x", "c1", "c2", "x y"]
    assert H.blocks(H.parse("<p>a</p><div>b<!-- c -->d<p>e")) == ["a", "bd", "e"]
    assert H.blocks(H.parse("")) == [] and H.blocks(H.parse("a < b && c <")) == ["a < b && c <"]
    assert H.blocks(H.parse("<div>" * 5000 + "deep")) == ["deep"]


def test_templates_of_a_host_go_and_repeated_sentences_stay(spark):
    def page(k, extra=""):
        return f"<body><div><div><span>Best shop</span> since 1999</div><article><h1>T{k}</h1><p>Always the same line.</p><p>own text {k}</p><div>Follow us on all channels</div>{extra}</article></div></body>"

    rows = [(k, f"https://a.example/{k}", page(k)) for k in range(30)]
    rows += [(100 + k, f"https://b.example/{k}", "<article><p>copy</p><div>of one page</div></article>") for k in range(30)]
    rows += [(200, None, None), (201, "http://[broken", ""), (None, "https://a.example/x", page(99)), (202, "https://c.example/", "<div>Follow us on all channels</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS mark", "'t' AS text", "2 AS gone")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert got[3] == "T3\nAlways the same line.\nown text 3" and got[None] == "T99\nAlways the same line.\nown text 99"
    # copies of one page are no template, and one page of another host is none either
    assert got[100] == "copy\nof one page" and got[202] == "Follow us on all channels"
    assert got[200] == "" and got[201] == ""
    assert H.extract(pages.limit(0)).count() == 0
