import random
import re
import time

import pytest

from logtide.llm import html_extraction
from logtide.llm.html_extraction import TOKEN, TagEnds, blocks_of

SIZE = 1_000_000


@pytest.mark.parametrize("unit", ["<a ", "<!a", '<a b="', "<a b='", "<a", "</a ", "<?x", '<a "\'', "<", "a", "<a/", "<!-", "&", '"<p>'])
@pytest.mark.parametrize("rest", ["", ">", '">', "'>", "' >"])
def test_broken_markup_takes_linear_time(unit, rest):
    page = unit * (SIZE // len(unit)) + rest
    began = time.process_time()
    blocks_of(page)
    assert time.process_time() - began < 20  # a few seconds; hours if every < searched the rest


def test_names_without_an_end():
    began = time.process_time()
    assert [b.text for b in blocks_of("<p>one</p><" + "a" * SIZE)][0] == "one"
    assert time.process_time() - began < 5


def test_tag_ends_agree_with_the_pattern():
    rng = random.Random(2)
    for _ in range(4000):
        page = "".join(rng.choice("<>\"'a /=!b\n") for _ in range(rng.randint(1, 25)))
        ends = TagEnds(page)
        for at in (m.start() for m in re.finditer("<", page)):
            whole = TOKEN.match(page, at).end() > at + 1
            assert not (whole and ends.none_at(at)), (page, at)
            if re.match("</?[a-z]", page[at:]):
                assert whole != ends.none_at(at), (page, at)


def test_text_after_a_broken_tag_is_kept(monkeypatch):
    pages = ['<p>one <a href="x>two</p><p>three</p>', "<div>a < b and <i c</div>", "x <b y='>z</b> w"]
    with_table = [[b.text for b in blocks_of(p)] for p in pages]
    monkeypatch.setattr(html_extraction.TagEnds, "none_at", lambda self, at: False)
    assert [[b.text for b in blocks_of(p)] for p in pages] == with_table
