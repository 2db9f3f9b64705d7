"""Suffix order by linear grouping.

Suffixes are grouped by Lyndon prefix. Groups are taken in descending order; each
suffix of a group points to the nearest earlier suffix of a smaller group
(previous-smaller pointer), and those pointed at move, by how often they are
pointed at, into groups of their own just above their old one. Once all groups are
done, a single scan emits the order: each suffix emitted places the one before it
and, along the pointers, those it decides. Nothing is renamed and nothing sorted
recursively.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby


def suffix_order(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order.

    The last symbol must be smaller than all others and occur once.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    by_symbol = sorted(range(n), key=text.__getitem__)
    group = [0] * n  # of a suffix: the first rank of its group
    last = [0] * n  # of a group: its last rank
    first = [0] * n  # of a last rank: its group
    members: dict[int, list[int]] = {}
    rank = 0
    for _, equal in groupby(by_symbol, key=text.__getitem__):
        suffixes = list(equal)
        end = rank + len(suffixes) - 1
        for s in suffixes:
            group[s] = rank
        members[rank], last[rank], first[end] = suffixes, end, rank
        rank = end + 1
    before = [-1] * n  # previous-smaller pointers
    end = n - 1
    while end >= 0:
        g = first[end]
        pointed: dict[int, int] = {}
        own = members.pop(g)
        if len(own) > 1:
            own = sorted(s for s in own if group[s] == g)
        for s in own:
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            _move_up(pointed, group, last, first, members)
        end = g - 1
    return _emit(n, group, before)


def _move_up(pointed: dict[int, int], group: list[int], last: list[int], first: list[int], members: dict) -> None:
    """Move the suffixes pointed at above their groups, the most often pointed at on top."""
    moves: dict[tuple[int, int], list[int]] = {}
    for p, times in pointed.items():
        moves.setdefault((times, group[p]), []).append(p)
    for times, g in sorted(moves, reverse=True) if len(moves) > 1 else moves:
        suffixes = moves[times, g]
        top = last[g]
        new = top - len(suffixes) + 1
        if new == g:
            continue  # the whole group moves: it stays one group
        for s in suffixes:
            group[s] = new
        members[new], last[new], first[top] = suffixes, top, new
        last[g] = new - 1
        first[new - 1] = g


def _emit(n: int, group: list[int], before: list[int]) -> list[int]:
    order = [-1] * n
    order[0] = n - 1
    free = list(range(n))  # next rank to give out, by group
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return order
