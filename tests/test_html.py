"""HTML in and out: nested lists, code with blank lines, tables, pictures."""

import base64

from foliant.operators import html


def body(spark, text):
    made = html.render(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["html"]
    return made.split("<body>\n")[1].rsplit("\n</body>")[0]


def test_lists_nest(spark):
    text = "- a\n  - b\n      1. deep\n  goes on\n- c\n1. same list\n\n1. new\n2. list"
    assert body(spark, text) == "<ul><li>a<ul><li>b<ol><li>deep\ngoes on</li></ol></li></ul></li><li>c</li><li>same list</li></ul>\n<ol><li>new</li><li>list</li></ol>"


def test_an_indented_first_item_and_jumps(spark):
    assert body(spark, "      - a\n- b\n          - c") == "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"


def test_code_keeps_blank_lines(spark):
    text = "before\n```\na < b\n\n\n- no list\n```\nafter\n\n```\nopen"
    assert body(spark, text) == "<p>before</p>\n<pre><code>a &lt; b\n\n\n- no list\n</code></pre>\n<p>after</p>\n<pre><code>open</code></pre>".replace("\n</code></pre>\n<p>after", "</code></pre>\n<p>after")


def test_blocks_of_lines(spark):
    text = "# T *x*\npara one\nmore\n> q\n> r\n---\n| a |\n|---|\n\n| only |\n| 2 |"
    assert body(spark, text) == "<h1>T <em>x</em></h1>\n<p>para one\nmore</p>\n<blockquote>q\nr</blockquote>\n<hr>\n<table><tr><th>a</th></tr></table>\n<table><tr><td>only</td></tr><tr><td>2</td></tr></table>"


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n")], "doc_id long, text string")
    assert [r["html"].count("<title>") for r in html.render(docs).collect()] == [1, 1, 1]


def test_images_by_pieces(spark):
    pages = [(1, '<img src="a.png">x<img alt="a.png" src="a.png"><img src="no.png">'), (2, '<img src="a.png">'), (3, "none"), (4, None), (5, "")]
    images = [(1, "a.png", None, bytearray(b"one")), (1, "a.png", None, bytearray(b"zzz")), (2, "a.png", "image/gif", bytearray(b"two")), (1, "b.png", None, None), (9, "a.png", None, bytearray(b"x"))]
    got = dict(html.embed_images(spark.createDataFrame(pages, "doc_id long, html string"), spark.createDataFrame(images, "doc_id long, path string, mime string, content binary")).collect())
    one, two = ("data:image/%s;base64,%s" % (m, base64.b64encode(b).decode()) for m, b in (("png", b"one"), ("gif", b"two")))
    assert got[1] == f'<img src="{one}">x<img alt="{one}" src="{one}"><img src="no.png">' and got[2] == f'<img src="{two}">' and got[3] == "none" and got[5] == ""


def markdown(spark, source):
    return [r["text"] for r in html.to_markdown(spark.createDataFrame([(1, source)], "page_id long, html string")).orderBy("idx").collect()]


def test_html_to_markdown(spark):
    source = (
        '<head><title>no</title></head><h2>A &amp; <em>B</em></h2><p>one <a href="/u">two</a> <b>three</b><br>four</p><ul><li>x<ol><li><p>n1</p><p>under</p></li><li>n2</li></ol></li><li>y</li></ul>'
        '<table><tr><th>a</th><th>b|c</th></tr><tr><td><p>1</p></td><td><code>2</code></td></tr></table><blockquote><p>said</p></blockquote><hr>after<pre>\nx  y\n\n  z\n</pre><img alt="i" src="f/p.JPEG"><img src="q">'
    )
    assert markdown(spark, source) == [
        "## A & *B*", "one [two](/u) **three**\nfour", "- x", "    1. n1", "        under", "    2. n2", "- y", "| a | b\\|c |\n| --- | --- |\n| 1 | `2` |", "> said", "---", "after", "```\nx  y\n\n  z\n```",
        "![i](images/fig_001.jpg)![](images/fig_002.png)",
    ]


def test_odd_html(spark):
    assert markdown(spark, None) == [] and markdown(spark, "") == [] and markdown(spark, "</ul></ul>a<ul></li><li>b") == ["a", "- b"]


def test_items_are_numbered_without_sorts_by_list_or_item(spark):
    deep = "".join(f"<ol><li>d{k}</li><li>e{k}" for k in range(8)) + "".join(f"<p>more{k}</p></li><li>f{k}</li></ol>" for k in range(8)) + "<li>out</li>"
    page = "<ul><li>a<ol><li>b</li><li><p>c</p><p>d</p></li></ol>e</li><li>f</li></ul><ol><li>g</li></ol>" + deep
    made = html.to_markdown(spark.createDataFrame([(1, page)], "page_id long, html string"))
    got = [r["text"] for r in made.orderBy("idx").collect()]
    assert got[:8] == ["- a", "    1. b", "    2. c", "        d", "    e", "- f", "1. g", "1. d0"]
    spaces = lambda k: "    " * min(k, html.LEVELS - 1)
    assert got[8:22] == ["2. e0"] + [f"{spaces(k)}{n}. {c}{k}" for k in range(1, 7) for n, c in ((1, "d"), (2, "e"))] + [f"{spaces(7)}1. d7"]
    assert made._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 2  # by place and by block
