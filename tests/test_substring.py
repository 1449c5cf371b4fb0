"""Longest common substrings against a table of all pairs of places."""

import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from retrospect.functions.substring import longest_common

TEXT = st.text("abé ", max_size=24)


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT)
def test_first_of_the_longest(a, b):
    every = [(-n, i, j) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]]
    size, i, j = min(every, default=(0, 0, 0))
    assert longest_common(a, b) == (-size, i, j)
    match = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    assert longest_common(a, b) == (match.size, match.a, match.b)


def test_long_texts():
    hint, unit = "ab" * 500 + "needle" + "ab" * 500, "ba" * 500_000 + "needle" + "ba" * 500_000
    start = time.perf_counter()
    assert longest_common(hint, unit) == (1000, 0, 1) and longest_common(unit, hint) == (1000, 1, 0)
    assert time.perf_counter() - start < 60
    assert longest_common("", "x") == (0, 0, 0)
