import pytest

from tidemark.sources import readers
from tidemark.sources.selectors import Rows, parse

PAGE = """<table id="played"><tr class="head"><td>Artist</td><td>Title</td></tr>
<tr class="played row" data-kind="song-new"><td>A<br>B</td><td><b>T</b> &amp; U</td><td>x</td></tr>
<tr class="played" data-kind='ad'><td>C</td><td>V</td></tr></table><div class="played"><p><td>D</td></p></div>"""


def found(row, artist="td:first-child", title="td:nth-child(2)"):
    parser = Rows(row, artist=artist, title=title)
    parser.feed(PAGE)
    return [tuple(" ".join(" ".join(r.get(c, ())).split()) for c in ("artist", "title")) for r in parser.rows]


def test_selectors():
    both = [("A B", "T & U"), ("C", "V")]
    for row in ("tr.played", "#played .played", "table > tr.played", "tr[data-kind]", "TR.played", 'tr[data-kind^="song"], tr[data-kind=ad]'):
        assert found(row) == both, row
    assert found("tr.row.played") == found('tr[data-kind$="-new"]') == found("tr[data-kind*=ng]") == found("tr[class~=row]") == found("tr[data-kind|=song]") == both[:1]
    assert found("div > td") == [] and found("table tr:first-child") == [("Artist", "Title")]
    assert found("div.played", "td", "p > td") == [("D", "D")] and found("div.played", "td", "tr > td") == [("D", "")]
    assert found("#played", "td", "b") == [("Artist", "T")]  # the first that fits, however many do
    assert found("*[data-kind=ad]", "td", "tr.played > td + td".replace(" + td", ":nth-child(2)")) == [("C", "V")]


@pytest.mark.parametrize("bad", ["", " ", "a >", "> a", "a,,b", "a,", "a:hover", "a > > b", "[x", "a+b"])
def test_unreadable(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_scrape_by_selectors(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    got = readers.scrape_tracks(df, "id", "html", "table#played > tr.played", "td:first-child", "td:nth-child(2)").collect()
    assert [(r.id, r.at, r.artist, r.title) for r in got] == [(1, 0, "A B", "T & U"), (1, 1, "C", "V")]
    with pytest.raises(ValueError):
        readers.scrape_tracks(df, "id", "html", "tr", "a:hover", "b")
