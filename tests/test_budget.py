"""Budgets from one look at a text's tokens against the search that counts a prompt at each step."""

import random

import pytest

from glyphward.operators import models

WORDS = "the of über naïve 한국어 간다 x1 ... ; tokenization, aa aaa aaaa \n\t 12345 don't Ünïcödé 😀 <b>".split(" ")


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def texts(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        yield tuple("".join(rnd.choice(WORDS) + rnd.choice([" ", "", "  "]) for _ in range(rnd.choice([0, 3, 60, 300]))) for _ in range(2))


def test_real_tokens():
    """The same budgets as the search, with fewer prompts counted."""
    encode = tokenizer()
    counted = [0, 0]
    for text, candidate in texts(1, 300):
        def counter(which):
            def count(a, b):
                counted[which] += 1
                return len(encode.encode(f"Text: {a}\nCandidate: {b}\nLabel:").ids)

            return count

        ends = lambda t: [e for _, e in encode.encode(t).offsets]
        assert models.estimated_budget(text, candidate, counter(0), ends, 96, 16) == models.searched_budget(text, candidate, counter(1), 96, 16)
    assert counted[0] < 0.6 * counted[1], counted


def test_words_are_exact():
    import re

    ends = lambda t: [m.end() for m in re.finditer(r"\S+", t)]
    for text, candidate in texts(2, 300):
        count = lambda a, b: 20 + len(a.split()) + len(b.split())
        assert models.estimated_budget(text, candidate, count, ends, 96, 16) == models.searched_budget(text, candidate, count, 96, 16)
