import pytest

from corpusflow.operators.html import parse_html


def parsed(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return [(r.title, r.text, r.links) for r in parse_html(df).orderBy("page_id").collect()]


CASES = [
    ("<title>A &amp; B</title><p>one<p>two", ("A & B", "one two", [])),
    ("<p>a<script>var t='</p><a href=x>';</script>b</p>", (None, "a b", [])),
    ("<SCRIPT>x</SCRIPT ><style>p{}</style>y", (None, "y", [])),
    ("a<!-- <a href='no'>no</a> -->b<!-- open <p>", (None, "a b", [])),
    ("x<script>never closed <p>y", (None, "x", [])),
    ("un<b>bro</b>ken and<br>broken", (None, "unbroken and broken", [])),
    ("<abbr>a</abbr>b<article>c</article>d", (None, "ab c d", [])),
    ('<a title="1 > 0 href=\'n\'" HREF="/x?a=1&amp;b=2">t</a><a name=q>u</a><a href=y>v</a><a href=\'y\'>w</a>', (None, "tuvw", ["/x?a=1&b=2", "y", "y"])),
    ("<area href=z><a data-href=q>n</a>", (None, "n", [])),
    ("&amp;lt; &#233;&#xE9;&#x1F600; &nosuch; & &#0; &#xD800; &#99999999;", (None, "&lt; éé\U0001f600 &nosuch; & � � &#99999999;", [])),
    ("3 < 4 and <a href='open", (None, "3 < 4 and <a href='open", [])),
    ("<!DOCTYPE html><?xml x?><textarea><b>raw</b></textarea>", (None, "<b>raw</b>", [])),
    ("<title>one</title><title>two</title> \n\t z", ("one", "z", [])),
    ("", (None, "", [])),
    (None, (None, None, [])),
]


def test_each_case(spark):
    assert parsed(spark, [c for c, _ in CASES]) == [e for _, e in CASES]


def test_long_page_and_many_attributes(spark):
    """Two megabytes of text, a tag of a thousand attributes, a hundred thousand tags."""
    page = "<p " + " ".join(f'k{k}="v>{k}"' for k in range(1000)) + ">" + "word " * 400_000 + "<i>x</i> " * 50_000
    ((_, text, links),) = parsed(spark, [page])
    assert text == ("word " * 400_000 + "x " * 50_000).strip() and links == []


@pytest.mark.parametrize("rows", [[], [(1, "t", "<title>q</title>", "old")]])
def test_empty_table_and_clashing_names(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, title string, html string, links string")
    assert [r.title for r in parse_html(df).collect()] == ["q"] * len(rows)
