"""Windows with runs of words that no item holds."""

import random

import pytest
from test_search_pack_toxic import brute_passages

from folioloom.llm import decontaminate


@pytest.mark.parametrize(("size", "cut"), [(500, 30), (500, 45), (800, 72)])
def test_tail_of_unknown_words(size, cut):
    rng = random.Random(size + cut)
    items = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(size))) for k in range(10)]
    index = decontaminate.Index(items)
    docs = []
    for k, text in items:
        unknown = [f"u{rng.randrange(10**6)}" for _ in range(cut + 100)]
        docs.append((k, " ".join(unknown[:50] + text.split()[: size - cut] + unknown[50:])))
    expected = {}
    for doc, item in zip(docs, items, strict=True):
        expected |= brute_passages([doc], [item])
    assert len(expected) == len(items)
    found = index.search([t.encode() for _, t in docs])
    got = {(d, hit[0]): hit[1] for (d, _), hits in zip(docs, found, strict=True) for hit in hits}
    assert got == pytest.approx(expected)
