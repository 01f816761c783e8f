"""Operator 8: planted layouts, and the consensus counted again in Python."""

from collections import Counter, defaultdict
from urllib.parse import urlsplit

import time
from html.parser import HTMLParser

import pytest

from lodestrata.llm.html import best, main_text, on_path, op8_main_text, take_apart, text_of

DDL = "page_id long, url string, html string"


def page(body, n=0):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/a'>Home page link</a></li></ul></nav><div id='x{n}' class='post-{n} main'>{body}</div><footer>All rights reserved</footer></body></html>"


TEXT = "<p>This is the story of the day, told in many words.</p><p>And a second part of it &amp; more.</p>"
LONG = "<div class='comments'><p>" + "loud comment " * 60 + "</p></div>"


def test_votes_overrule_a_page(spark):
    rows = [(i, f"https://h.example/{i}", page(TEXT, i)) for i in range(5)]
    odd = "<html><body><div class='post-9 main'><p>Short story.</p></div>" + LONG + "</body></html>"
    rows += [(10, "https://h.example/10", odd), (11, "https://other.example/", odd), (12, "https://h.example/12", "<html><body><section><p>Only this section here.</p></section></body></html>")]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, DDL)).collect()}
    assert got[0].text == "This is the story of the day, told in many words.\nAnd a second part of it & more."
    assert got[10].text == "Short story." and got[10].how == "consensus" and "#" in got[10].path
    assert got[11].text.startswith("loud comment")
    assert got[12].how == "own" and got[12].text == "Only this section here."


def test_against_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    votes = defaultdict(Counter)
    scores = defaultdict(Counter)
    for r in rows:
        c = best(take_apart(r.html)[0])
        host = (urlsplit(r.url).hostname or "").lower()
        if c.score > 0:
            votes[host][c.path] += 1
            scores[host][c.path] += c.score
    win = {h: min(v, key=lambda p: (-v[p], -scores[h][p], p)) for h, v in votes.items()}
    got = op8_main_text(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.path == win[r.host] if r.how == "consensus" else r.path != win.get(r.host)
        assert r.text and "track(" not in r.text and "margin:0" not in r.text


def test_parser_closes_what_html_lets_open():
    found, texts, numbers = take_apart("<body><div><p>one<p>two<ul><li>a<li>b</ul></div></p></b><script>if (a<b) x('</div>')</script><!-- <div> --><p>three")
    assert [c.path for c in found] == ["body", "body>div", "body>div>ul"]
    assert "".join(texts).split() == ["one", "two", "a", "b", "three"]


class Texts(HTMLParser):
    """All text outside scripts and styles, and the tags that come, by the library's parser."""

    def __init__(self):
        super().__init__()
        self.skip, self.words, self.opened = 0, [], Counter()

    def handle_starttag(self, tag, attrs):
        self.opened[tag] += 1
        self.skip += tag in ("script", "style", "noscript", "template", "svg", "iframe", "textarea")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript", "template", "svg", "iframe", "textarea") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_texts_and_containers_against_the_library(spark, sf):
    from lodestrata.llm.html import CONTAINERS

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        p = Texts()
        p.feed(r.html)
        found, texts, numbers = take_apart(r.html)
        assert text_of(texts).split() == p.words
        assert len(found) == sum(n for t, n in p.opened.items() if t in CONTAINERS)
        assert all(c in on_path(found, numbers, c.path) for c in found)


@pytest.mark.parametrize("piece", ["<div>", '<a x="y ', "<a ", "<b><i>", "</b>", "<!", "<script", "<p class='", '<div class="x">t', "<span><p>", "<ul><li>", '<a x="', "<", "<a x='\"> "])
def test_time_is_in_proportion(piece):
    def took(n):
        began = time.process_time()
        take_apart(piece * (n // len(piece)))
        return time.process_time() - began

    took(10_000)
    assert took(300_000) < 30 * took(50_000) + 1.5


def test_many_hosts_go_by_salt(spark):
    rows = [(i, f"https://h{i % 3}.example/{i}", page(TEXT, i)) for i in range(30)] + [(90, None, page(TEXT))]
    df = spark.createDataFrame(rows, DDL)
    assert sorted(main_text(df).collect(), key=str) == sorted(main_text(df, held=0).collect(), key=str)


def test_defined_results(spark):
    deep = "<div>" * 3000 + "words in the deep" + "</div>" * 3000
    rows = [(None, "https://h/", page(TEXT), 1), (1, None, page(TEXT), 2), (2, "no host", page(TEXT), 3), (3, "https://h/", None, 4), (4, "https://h/", "", 5), (5, "https://h/", "plain text only", None), (6, "https://h/", page("<p>word </p>" * 50_000), 7), (7, "https://d/", deep, 8), (8, "https://h/", page(TEXT), 9), (8, "https://h/", page(TEXT), 9), (9, "https://e/", "<<<>><div", 10), (10, "https://f/", "<div>" * 60_000 + "deep words", 11), (11, "https://g/", "<a " * 100_000 + "x", 12)]
    df = spark.createDataFrame(rows, DDL + ", host long").selectExpr("*", "host AS path", "host AS winner", "host AS text")
    got = main_text(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert len(got) == len(rows)
    assert by[3][0].how == by[4][0].how == "none" and by[3][0].text is None
    assert by[1][0].how == "own" and by[2][0].host is None and by[1][0].text == by[8][0].text
    assert by[5][0].text == "plain text only" and by[7][0].text == "words in the deep" and len(by[8]) == 2
    assert by[6][0].text.count("word") == 50_000
    assert by[10][0].text == "deep words" and by[11][0].how == "own" and len(by[11][0].text) > 200_000
    assert main_text(spark.createDataFrame([], DDL)).count() == 0
