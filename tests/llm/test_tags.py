"""Tags with quoted values of any length."""

import random
import re
import time

from pulseframe.llm import mincut

QUOTED = re.compile(r"<(/?)([a-z]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE = re.compile(r"<(/?)([a-z]+)([^>]*)>")


def test_long_values_are_not_markup():
    for size in (8_000, 9_000, 300_000):
        for quote in "\"'":
            page = f"<div data-x={quote}{'a' * size}<p>leak one two</p>{quote}><p>kept words</p></div>"
            assert [b.text for b in mincut.blocks_of(page)] == ["kept words"]


def test_tag_ends_as_by_the_unbounded_pattern():
    rng = random.Random(3)
    for _ in range(20_000):
        page = "".join(rng.choice("<a >\"'") if rng.random() < 0.8 else "<a " for _ in range(rng.randrange(1, 40)))
        final, stray = page.rfind(">"), set()
        for at in (m.start() for m in re.finditer("<a ", page)):
            want = QUOTED.match(page, at) or LOOSE.match(page, at)
            if at < final:
                assert mincut.tag_end(page, at + 2, final, stray) == want.end() - 1, page
            else:
                assert want is None


def test_broken_quotes_stay_linear():
    began = time.monotonic()
    for page in ('<a x=">"' * 100_000 + '"', "<a " * 300_000, "<a '\">" * 100_000, '<a x=">' * 100_001):
        mincut.blocks_of(page)
    assert time.monotonic() - began < 20
