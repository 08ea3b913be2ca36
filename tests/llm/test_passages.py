"""Passages of 51 to 60 words that stand in two texts, over many seeds."""

import random

import numpy as np

from twinlens.llm import chunks


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(n))


def removed(first, second):
    """Bytes of the longest run of chunks of the second text that the first one has."""
    pieces = lambda raw: [(int(a), int(b), raw[a:b]) for _, a, b in zip(*chunks.cuts([raw]), strict=True)]
    known = {p for _, _, p in pieces(first)}
    parts = [{"start": a, "end": b} for a, b, p in pieces(second) if p in known]
    return chunks.without(second.decode(), parts, chunks.LEAST_BYTES)[1]


def test_no_passage_is_missed():
    shares = []
    for seed in range(2000):
        r = random.Random(seed)
        passage = prose(r, r.randint(51, 60))
        texts = [" ".join([prose(r, 40), passage, prose(r, 40)]).encode() for _ in range(2)]
        shares.append(removed(*texts) / len(passage.encode()))
    print(f"missed {np.mean(np.array(shares) == 0):.4f}, bytes removed {np.mean(shares):.3f}")
    assert min(shares) > 0 and np.mean(shares) > 0.6 and max(shares) < 1.05


def test_cuts_do_not_depend_on_the_texts_beside():
    r = random.Random(1)
    texts = [t.encode() for t in (prose(r, 300), "a b " * 3000, "x " * 999, "", "one two", "語の文" * 500, prose(r, 12))]
    together = list(zip(*(x.tolist() for x in chunks.cuts(texts)), strict=True))
    for k, t in enumerate(texts):
        assert [(a, b) for d, a, b in together if d == k] == [(int(a), int(b)) for _, a, b in zip(*chunks.cuts([t]), strict=True)]
    assert len(chunks.cuts([texts[2]])[0]) < 120  # 999 equal words
