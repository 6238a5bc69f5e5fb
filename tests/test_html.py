"""HTML to text: what HTML itself says of nesting, raw text and references."""

import html.entities

import pytest

from tessera.sources.html import load, parse

CASES = [
    ("<nav>a<nav>b</nav>tail</nav><p>Caf&eacute; &#8217; &mdash; &#x2019;", "Café ’ — ’"),
    ("<footer>x<header>y</header>z</footer>after", "after"),
    ("before<nav>never closed<p>more", "before"),
    ("<div><nav>closed with its parent</div>after", "after"),
    ("one</nav></footer>two", "one\ntwo"),
    ("<script>if (a<b) document.write('</p><nav>')</script>x<style>p > b{}</style>y", "x\ny"),
    ("<textarea>a<b>c &lt;</textarea>d", "a<b>c <\nd"),
    ("<p title='a > b' data-x=\"</nav>\" hidden>t</p>", "t"),
    ("4 < 5 and x<y&y>z", "4 < 5 and x\nz"),
    ("&copy 2, &notit; &amp;lt; &unknown; &#0; &#150;", "© 2, ¬it; &lt; &unknown; � –"),
    ("a<!-- <p>no</p> -->b<!doctype x>c<!---->d<!-- open", "a\nb\nc\nd"),
    ("<template>t<p>u</template>v", "v"),
    ("<nav/>x<br/>y", "x\ny"),
    ("<title>t</title>no body", "t\nno body"),
    ("<title>t</title><body>a<p>b</body>c<body>d", "a\nb"),
    ("<header><body>x</body>", ""),
    ("  a  \x0b b \n\n\t c&nbsp;", "a\nb\nc"),
    ("cut <b", "cut"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_text(page, text):
    assert parse(page)[2] == text


def test_every_named_reference():
    for name, value in html.entities.html5.items():
        if value.strip() and not value.isspace():
            assert parse(f"x&{name}")[2] == "\n".join(f"x{value}".splitlines()), name


def test_titles_and_headings():
    assert parse("<title> A &amp; B </title><h1>c</h1>")[:2] == ("A & B", "c")
    assert parse("<h1>a <b> b</b><script>s</script> c</h1><h1>second</h1>")[:2] == (None, "abc")
    assert parse("<title/>x")[0] == "" and parse("<TITLE>x<b>y</TITLE>")[0] == "x<b>y"


def test_long_pages_take_time_as_their_length():
    deep = parse("<div>" * 50_000 + "x" + "</div>" * 50_000 + "y")
    assert deep[2] == "x\ny"
    assert parse("<" * 100_000)[2] == "<" * 100_000 and parse('<a b="' * 20_000)[2] == ""


def test_load_titles_and_pages_without_text(spark):
    rows = [("u1", "<title>T</title><body>a</body>"), ("u2", "<title> </title><h1>H</h1>"), ("u3", "<h1></h1>b"), ("u4", "c"), ("u5", "<nav>n</nav>"), ("u6", None)]
    got = load(spark.createDataFrame(rows, "url string, html string"), "t").collect()
    assert [(r["source"], r["title"], r["text"]) for r in got] == [("u1", "T", "a"), ("u2", "H", "H"), ("u3", "", "b"), ("u4", "u4", "c")]


def test_pages_go_to_python_as_rows_a_few_at_a_time(spark):
    own = load(spark.createDataFrame([("u", "<p>t</p>")], "url string, html string"), "legislation")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan  # batches of Arrow grow to 64 MB of pages
    assert [r["text"] for r in own.collect()] == ["t"]
