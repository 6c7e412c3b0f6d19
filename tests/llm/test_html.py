"""Long and broken pages, and what decides on the given ones."""

from __future__ import annotations

import time

import pyarrow.parquet as pq
import pytest

from lodestar.llm import html_text

PATTERNS = {
    "open quote in a script tag": '<script a="', "open quote in a link": '<a href="x y ', "nested": "<div>x", "end tags without a start": "<div>x</section>", "inline tags": "<div><b>x<p>",
    "quoted end": '<a x=">" ', "comments": "<!-- ", "raw elements": "<script></scrip", "entities": "&am", "signs": "<", "names": "<i class = class = ", "mixed quotes": "<a b='>\">",
    "items": "<li>x<ul>", "cells": "</p><td>x", "class words": '<p class="a b">t',
}


@pytest.mark.parametrize("name", PATTERNS)
def test_time_grows_with_length(name):
    part, taken = PATTERNS[name], []
    for size in (250_000, 1_000_000):
        page = part * (size // len(part))
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            html_text.main_text(page)
            best = min(best, time.perf_counter() - began)
        taken.append(best)
    assert taken[1] < 20 and taken[1] < 8 * max(taken[0], 0.02), taken


def test_broken_tags():
    read = html_text.main_text
    assert read("<p>One two, three.</p><a href=\"x>four five</a> <p>Six, seven.") == "One two, three. four five Six, seven."
    assert read("<p>before, it was. <b") == "before, it was. <b"
    assert read("a < b, and c <3 d.") == "a < b, and c <3 d."
    assert read("<p>Some text here.<script>var x = '</p>'") == "Some text here."
    assert read("<p>Some text, here.<!-- open") == "Some text, here."


def test_ratios_and_threshold_decide_on_given_pages(monkeypatch):
    """With every path kept all pages change; with all ratios alike, some: on most of them the tags say the same as the ratios."""
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    texts = [html_text.main_text(x) for x in pages]
    changed = lambda: sum(html_text.main_text(x) != t for x, t in zip(pages, texts, strict=True))
    with monkeypatch.context() as m:
        m.setattr(html_text, "path_ratio", lambda *sums: 1.0)
        assert changed() >= 5
    monkeypatch.setattr(html_text, "THRESHOLD", -1.0)
    assert changed() == len(pages)


def test_no_language_is_left_out(spark):
    from lodestar.llm import language

    rows = spark.createDataFrame([(i, f"l{i % 30}", f"text of {i % 30}") for i in range(90)], "doc_id long, lang string, text string")
    assert language.train(rows).languages == sorted(f"l{i}" for i in range(30))
    with pytest.raises(ValueError, match="more than 29 languages"):
        language.train(rows, languages=29)
