from __future__ import annotations

from flowlake.llm import html_text as H

SCHEMA = "page_id long, url string, html string"
PLAIN = (
    "<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- ad --><div class='ad-7'>buy now</div>"
    "<article><h1>Title &amp;amp; more</h1><p>First\n  part <b>bold</b> &lt;x&gt;<br>next<p>Second&nbsp;one</p><div class=comments><p>nice!</p></div></article>"
    "<footer>&copy; all</footer></body></html>"
)
WANT = "Title &amp; more\n\nFirst part bold <x> next\n\nSecond one"


def text_of(html):
    page = H.Page(html)
    return page.extract(page.best()[0])


def test_article_only():
    assert text_of(PLAIN) == WANT


def test_divs_by_class_and_broken_markup():
    page = "<body><div id=sidebar><p>side words side words</p></div><div class='post-12'><p>Main text that is long enough<p>and goes on</div><form><p>name?</p></form>"
    assert text_of(page) == "Main text that is long enough\n\nand goes on"
    assert H.Page(page).best()[0].endswith("div.post-#")
    assert text_of("just text, no tags") == "just text, no tags"
    assert text_of("<p>open <a href='x>y'>link</a") is not None


def pages():
    other = "<html><body><div class='story'><p>Real story text of some length, told slowly.</p></div><div class='more'><p>{}</p></div></body></html>"
    rows = [(i, "http://a.example/x", other.format("tiny")) for i in range(5)]
    rows += [(9, "http://a.example/y", other.format("now a very long extra block that scores higher than the story on this page alone " * 3))]
    return rows + [(20, "https://b.example/", PLAIN), (21, None, None), (22, "no host", ""), (23, "http://a.example/z", "<html><body><article><p>Another layout.</p></article></body></html>")]


def test_hosts_agree_on_a_path(spark):
    got = {r["page_id"]: r for r in H.main_text(spark.createDataFrame(pages(), SCHEMA).selectExpr("*", "1 as host", "2 as path", "3 as text")).collect()}
    assert got[9]["text"] == got[0]["text"] == "Real story text of some length, told slowly."
    assert got[20]["text"] == WANT and got[20]["n_chars"] == len(WANT)
    assert got[21]["text"] == got[22]["text"] == "" and got[23]["text"] == "Another layout."
    assert len(got) == len(pages())


def test_votes_against_plain_counts(spark):
    want = {}
    for _, url, html in pages():
        host = "" if url is None or "://" not in url else url.split("/")[2]
        path = H.Page(html or "").best()[0]
        if path:
            want[host, path] = want.get((host, path), 0) + 1
    got = {(r["host"], r["path"]): r["votes"] for r in H.votes(spark.createDataFrame(pages(), SCHEMA)).collect()}
    assert got == want


def test_long_page_repeated_rows_and_empty_table(spark):
    long = "<html><body><article>" + "<p>word and more</p>" * 30_000 + "</article></body></html>"
    rows = [(1, "http://c.example", long), (1, "http://c.example", long)]
    got = H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["n_chars"] for r in got] == [len("word and more") * 30_000 + 2 * 29_999] * 2
    assert H.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
