"""Spans depend on which words are equal, not on the words: texts of one pattern share the work."""

import random

import pytest

from graphloom.operators import spans as SP


def _triples(rng, words):
    return [tuple(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(3)) for _ in range(40)]


def test_renamed_words_cost_nothing_and_score_the_same():
    plain = _triples(random.Random(5), ["a", "b", "c", "d", "e"])
    other = {w: f"w{k}" for k, w in enumerate("abcde")}
    renamed = [tuple(" ".join(other[w] for w in x.split()) for x in t) for t in plain]
    want = [SP.pair_scores(r, c) for r in plain for c in plain]
    known = SP._spans.cache_info().misses, SP._span_scores.cache_info().misses
    assert [SP.pair_scores(r, c) for r in renamed for c in renamed] == want
    assert (SP._spans.cache_info().misses, SP._span_scores.cache_info().misses) == known


def test_split_words_stay_words():
    assert SP._words("i cannot wanna go") == ("i", "can", "not", "wan", "na", "go")
    assert SP.pair_scores(("cannot", "r", "x"), ("can not", "r", "x")) == pytest.approx((1.0, 1.0, 1.0, 1.0))
