import re
from html.parser import HTMLParser

from residuum.llm.html_extract import extract, render


def test_layout():
    html = """<html><head><title>x</title><script>var a="</p>";</script></head><body><h1>A &amp; B</h1><p>one<br>two <b>bold</b>
x<p>three<div hidden>no</div><div style="display: none">no</div><ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li>y</ol>
<table><tr><th>Name<th>Qty<tr><td>apple<td>1<tr><td>fig<td>22</table>after<pre>
 a  b
   c</pre><details><summary>S</summary>hid</details>1 < 2 <!-- no --> end</body></html>"""
    expected = """A & B

one
two bold x

three

- a
- b
  - c
- d

3. x
4. y

Name   Qty
apple  1
fig    22

after

 a  b
   c

S
1 < 2 end"""
    assert render(html) == expected


def test_broken_pages():
    assert render(None) == render("") == render("<script>never closed") == ""
    assert render("a</b></div>c") == "ac"
    assert render("<p>a</p></p>b").split() == ["a", "b"]
    assert render("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert render("<table>loose<tr><td>a<td colspan=2>b<tr><td>日本<td>c<td>d</table>") == "loose\na     b\n日本  c  d"
    assert render("<a href='x>y'>t</a> <input value=no> &lt;b&gt; &nope; &#65;") == "t <b> &nope; A"


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("head", "script", "style", "title") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_all_visible_text_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        plain = _Plain()
        plain.feed(r.html)
        plain.close()
        bare = re.sub(r"(?m)^\s*(- |\d+\. )", "", got[r.page_id])
        assert re.sub(r"\s+", "", bare).replace("---", "") == re.sub(r"\s+", "", "".join(plain.out)).replace("---", "")


def test_edges(spark):
    rows = [(None, "<p>a"), (1, None), (1, None), (2, "")]
    frame = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text", "2 AS url")
    assert sorted((r.page_id or 0, r.text) for r in extract(frame).collect()) == [(0, "a"), (1, ""), (1, ""), (2, "")]
    assert extract(frame.limit(0)).count() == 0
