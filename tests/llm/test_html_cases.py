"""Pages that a careless parser or a narrow model would cut: comments, quotes, tables, code, and very long broken ones."""

import time

import pytest

from arboria.llm import html_extract

FIRST, LAST = "First paragraph of the article, with several words in it.", "Last paragraph, which is long enough to be seen as text."


def page(inside):
    menu = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
    return f"<html><body>{menu}<article><h1>A title of words</h1><p>{FIRST}</p>{inside}<p>{LAST}</p></article><footer>© 2020</footer></body></html>"


@pytest.mark.parametrize(("inside", "texts"), [
    ("<!--><p>Inside one, a paragraph.</p> <!-- x --!><p>Inside two.</p><!---><p>Inside three.</p><!-- a > b -- c -->", ["Inside one, a paragraph.", "Inside two.", "Inside three."]),
    ('<p title="a<b>c">Inside a quote.</p>', ["Inside a quote."]),
    ("<p data-x='1>2' data-y=\"3>4\">Greater.</p>", ["Greater."]),
    ('<p class="x>A quote is missing</p><p class="y">here.</p>', ["A quote is missing", "here."]),
    ("<table><tr><td>Cell one here</td><td>Cell two here</td></tr></table>", ["Cell one here", "Cell two here"]),
    ("<p><a href='/x'>See the whole list</a></p>", ["See the whole list"]),
    ("<pre>code line one\ncode two</pre>", ["code line one code two"]),
    ('<p class="lead k-body">An odd class.</p>', ["An odd class."]),
    ("<p>a < b and c > d</p>", ["a < b and c > d"]),
])
def test_nothing_of_an_article_is_lost(inside, texts):
    weights, pair = html_extract.trained()
    assert html_extract.texts_of([page(inside)], weights, pair)[0].split("\n") == ["A title of words", FIRST, *texts, LAST]


def test_a_comment_that_is_never_closed_takes_the_rest():
    weights, pair = html_extract.trained()
    assert html_extract.texts_of([page("<!-- gone")], weights, pair)[0].split("\n") == ["A title of words", FIRST]


@pytest.mark.parametrize("part", ["<a ", '<p class="', "<!-- ", "<a b='", "</x ", "<a href=x>", "<p =", "=\"'<b "])
@pytest.mark.parametrize("end", ["", ">", "'>", '">'])
def test_two_megabytes_of_a_broken_tag_take_no_time(part, end):
    began = time.time()
    html_extract.Page(part * (2_000_000 // len(part)) + end)
    assert time.time() - began < 5


@pytest.mark.parametrize("points", [["A point that is made here."], ["One short point.", "And another one, longer than the first."], ["Milk", "Two eggs"]])
@pytest.mark.parametrize("before", ["", '<div class="ad">Buy this now.</div>'])
def test_lists_of_an_article_stay_and_menus_go(points, before):
    weights, pair = html_extract.trained()
    items = "".join(f"<li>{x}</li>" for x in points)
    source = page("x").replace("x<p>" + LAST + "</p>", f"{before}<ul>{items}</ul>")
    assert html_extract.texts_of([source], weights, pair)[0].split("\n") == ["A title of words", FIRST, *points]
