"""Main text: hostile markup in linear time, attributes, and the best run against brute force."""

import random
import time

import pytest

from iotlens.llm import extract
from iotlens.llm.extract import Weights, items, main_text

MEGABYTE = {
    "raw element without an end of its tag": "<script " * 130_000,
    "closers without a partner": "<nav>" + "<div>" * 100_000 + "</x>" * 100_000,
    "less-than signs": "<" * 500_000,
    "declarations": "<!" * 500_000,
    "open quotes": "<a ='" * 200_000,
    "quotes over tags": '<a x="<b>' * 120_000,
    "comments": "<!--" * 250_000,
    "paragraphs": "<p>" * 300_000,
    "attributes": "<div " + "class " * 170_000 + ">x",
    "space in a tag": "<div class" + " " * 1_000_000 + ">x",
    "unclosed raw elements": "<style>" * 150_000,
    "nested content": "<article>" * 100_000,
}


@pytest.mark.parametrize("name", MEGABYTE)
def test_a_hostile_megabyte_takes_no_time(name):
    begin = time.time()
    main_text(MEGABYTE[name], Weights())
    assert time.time() - begin < 5  # about 1 s or less on an idle core


def test_attributes_follow_the_rules_of_html():
    text = "<article><p>one two <a title=it's href=x>three</a> four <b data-class=menu class=big>five</b></p></article>"
    assert main_text(text, Weights()) == "one two three four five"
    assert main_text('<article><p title="a > b">left <i title=\'"\'>right</i></p></article>', Weights()) == "left right"
    assert main_text("<article><p>kept words here</p><div class = 'x menu'>gone</div></article>", Weights()) == "kept words here"


def test_unfinished_markup_never_becomes_text():
    for tail in ("<div class=\"foo", "<a href=", "</p", "<!-- note", "<script>var x", "<!doc"):
        assert main_text("<article><p>whole words stay</p>" + tail, Weights()) == "whole words stay", tail
    assert main_text("<article><p>1 < 2 and 3 <4</p></article>", Weights()) == "1 < 2 and 3 <4"
    assert main_text('<article><p>words come before <a title="open>link</a> and after</p></article>', Weights()) == "words come before link and after"


def test_null_empty_and_repeated_pages(spark):
    pages = [(None,), ("",), ("<p>some plain words</p>",), ("<p>some plain words</p>",), ("   ",)]
    df = spark.createDataFrame(pages, "html string")
    got = [r[0] for r in df.select(extract.extract(Weights(), df["html"])).collect()]
    assert got == ["", "", "some plain words", "some plain words", ""]


def test_the_best_run_is_the_best_of_all_runs():
    rng = random.Random(5)
    for _ in range(150):
        names = ["p", "div", "li", "nav", "article", "h2", "em", "td"]
        page = "".join(
            rng.choice((f"<{rng.choice(names)}>", f"</{rng.choice(names)}>", f"w{rng.random()} w{rng.random()}")) for _ in range(40))
        weights = Weights(
            {n: rng.uniform(-1, 2) for n in names}, {t: rng.uniform(-2, -0.1) for n in names for t in (n, "/" + n)}, rng.uniform(-1, 1))
        seen = list(items(page))
        worth = []
        for kind, name, text, out, inside in seen:
            value = 0.0
            if not (out and inside):
                if kind == "text":
                    value = len(text.split()) * (-abs(weights.of_word(name)) if out else weights.of_word(name))
                elif kind == "tag":
                    value = weights.of_tag(name)
            worth.append(value)
        runs = [(sum(worth[i:j]), i, j) for i in range(len(seen)) for j in range(i + 1, len(seen) + 1)]
        best = max(r[0] for r in runs)
        wanted = {
            "".join("".join(x[2].split()) for x in seen[i:j] if x[0] == "text" and not x[3]) for s, i, j in runs if s > best - 1e-9}
        got = "".join(main_text(page, weights).split())
        assert got in (wanted if best > 1e-9 else {""}), page


def test_fit_counts_words_by_element_and_place(spark):
    pages = [("<nav><li>home</li><li>news</li></nav><article><p>" + "word " * 30 + "</p></article><footer><span>legal</span></footer>",)] * 20
    pages += [("<div>no content element</div>",)] * 5
    found = extract.fit(spark.createDataFrame(pages, "html string"))
    assert found.words["p"] > 0 > found.words["li"] and found.words["span"] < 0
    assert "div" not in found.words and all(v < 0 for v in found.tags.values())
    assert extract.fit(spark.createDataFrame([], "html string")) == Weights()
