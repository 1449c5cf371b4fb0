"""The longest common substring of two texts in linear time."""

from __future__ import annotations


def _automaton(text: str) -> tuple[list[dict[str, int]], list[int], list[int], list[int]]:
    """Suffix automaton: moves, suffix link, longest length and first end of each state's substrings; state 0 is the empty one."""
    moves: list[dict[str, int]] = [{}]
    link, length, first_end, last = [-1], [0], [-1], 0
    for i, letter in enumerate(text):
        state, new = last, len(moves)
        moves.append({})
        link.append(0)
        length.append(i + 1)
        first_end.append(i)
        while state >= 0 and letter not in moves[state]:
            moves[state][letter] = new
            state = link[state]
        if state >= 0:
            to = moves[state][letter]
            if length[state] + 1 == length[to]:
                link[new] = to
            else:  # only the shorter substrings of `to` end here too: they get a state of their own
                split = len(moves)
                moves.append(dict(moves[to]))
                link.append(link[to])
                length.append(length[state] + 1)
                first_end.append(first_end[to])
                link[to] = link[new] = split
                while state >= 0 and moves[state].get(letter) == to:
                    moves[state][letter] = split
                    state = link[state]
        last = new
    return moves, link, length, first_end


def longest_common(a: str, b: str) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest common substring; of several the first in a, then in b; (0, 0, 0) without one.

    The automaton is built over the shorter text, the other one is read once.
    """
    if len(b) < len(a):
        return _scan(b, a, held_first=False)
    return _scan(a, b, held_first=True)


def _scan(held: str, read: str, held_first: bool) -> tuple[int, int, int]:
    moves, link, length, first_end = _automaton(held)
    best, state, size = (0, 0, 0), 0, 0
    for i, letter in enumerate(read):
        while state and letter not in moves[state]:
            state = link[state]
            size = length[state]
        state = moves[state].get(letter, 0)
        size = size + 1 if state else 0
        if size and size >= -best[0]:
            at_held, at_read = first_end[state] - size + 1, i - size + 1
            best = min(best, (-size, at_held, at_read) if held_first else (-size, at_read, at_held))
    return -best[0], best[1], best[2]
