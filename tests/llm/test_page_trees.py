"""Page trees: deep ones, and distances in them against whole paths."""

import math
import random

from pulseframe.llm import mincut

NAMES = "div p li ul table tr td nav article h2 a hr br header footer section".split()


def way_down(element):
    path = []
    while element.parent is not None:
        path.append(id(element))
        element = element.parent
    return path[::-1]


def test_closeness_equals_that_of_whole_paths():
    draw = random.Random(5)
    for _ in range(300):
        tags = [f"<{'/' * draw.randint(0, 1)}{draw.choice(NAMES)}>{'some words ' * draw.randint(0, 2)}" for _ in range(draw.randint(0, 90))]
        blocks = mincut.blocks_of("".join(tags))
        for one, other in zip(blocks, blocks[draw.randint(0, 9):]):
            a, b = way_down(one.place), way_down(other.place)
            shared = 0
            while shared < min(len(a), len(b)) and a[shared] == b[shared]:
                shared += 1
            assert one.place.depth == len(a)
            want = math.exp(-0.35 * max(0, len(a) + len(b) - 2 * shared - 2))
            got = mincut.closeness(one.place, other.place)
            assert got == want if want * mincut.SMOOTH > mincut.FAINT else got * mincut.SMOOTH <= mincut.FAINT


def test_forty_thousand_unclosed_tags(spark):
    deep = "<div>words" * 40_000
    blocks = mincut.blocks_of(deep)
    assert len(blocks) == 40_000 and [b.place.depth for b in blocks] == list(range(1, 40_001))
    assert all(b.place.parent is a.place for a, b in zip(blocks, blocks[1:]))  # one element a tag, shared by all below it
    pages = spark.createDataFrame([(1, deep), (2, "<div>" * 40_000 + "</p>words" * 40_000), (3, "<p>" * 40_000), (4, None)], "page_id long, html string")
    found = {r.page_id: r.text for r in mincut.extract(pages).collect()}
    assert found[3] == found[4] == "" and len(found) == 4


def test_closing_tags_without_an_opening_one_change_nothing():
    page = "<article><p>A first sentence, with commas, and a full stop at the end.</p><p>A second one, which is as long as the first was.</p></article>"
    assert mincut.main_text("</div></section>" + page.replace("</p>", "</p></li></div></td>")) == mincut.main_text(page) != ""
