"""Cutting stock by column generation: how items of given lengths fill sequences of one width.

A pattern says how many items of each length one sequence takes. The linear program
over patterns starts from pairs that fill a sequence; its duals price items, a knapsack
over all fills finds patterns that pay, and these enter the basis until few do. The
patterns' counts are rounded down; the few items left over fill sequences exactly where
up to four of them can, and the rest form a stream that is cut where a sequence ends.

Everything depends on the histogram of lengths only, that is on at most ``width``
numbers, whatever the number of items.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np

PIVOTS = 4000  # at most; each leaves a whole, if less good, set of patterns
SLACK = 3e-3  # the program ends when so small a part of the sequences is left for the stream
POOL = 64  # patterns a pricing gives
STREAMED = 2.0  # cost of a sequence of the stream, in which documents are cut; one of a pattern costs 1
TRIED = 64  # lengths tried as the first of three that fill a sequence exactly


def unpadded(fill: np.ndarray | int, width: int):
    """Is a sequence of so many tokens kept at its own length? Powers of two and full ones are."""
    fill = np.asarray(fill)
    return ((fill & (fill - 1)) == 0) | (fill == width)


def knapsack(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, last): the largest value of items of each exact total length, and an item that reaches it."""
    best = np.full(width + 1, -np.inf)
    last = np.zeros(width + 1, np.int64)
    best[0] = 0.0
    for fill in range(1, width + 1):
        reached = values[1 : fill + 1] + best[fill - 1 :: -1]
        at = int(reached.argmax())
        best[fill], last[fill] = reached[at], at + 1
    return best, last


def _items(last: np.ndarray, fill: int) -> list[int]:
    found = []
    while fill:
        found.append(int(last[fill]))
        fill -= found[-1]
    return found


def _start(counts: np.ndarray, lengths: np.ndarray, row: dict[int, int], width: int):
    """A basis of pairs that fill a sequence, and of the stream for what they leave."""
    m = len(lengths)
    patterns: list[dict[int, int] | None] = [None] * m  # None: the length's items go to the stream
    inverse = np.eye(m)
    times = counts[lengths].astype(float)
    price = STREAMED * lengths / width
    for n in map(int, lengths):
        k = row.get(width - n)
        if 2 * n < width and k is not None:
            few, many = sorted((row[n], k), key=lambda i: times[i])
            patterns[few] = {n: 1, width - n: 1}
            inverse[many, few] = -1.0
            times[many] -= times[few]
            price[few] = 1.0 - price[many]
    return patterns, inverse, times, price


def column_generation(counts: np.ndarray, width: int) -> list[tuple[dict[int, int], float]]:
    """(pattern, times) of the linear program; ``counts[i]`` items of length i, for i below the width.

    All patterns fill a sequence without padding. Items may go to the stream instead,
    which is cut freely but costs more; so there is always a solution.
    """
    lengths = np.flatnonzero(counts)
    m = len(lengths)
    if not m:
        return []
    row = {int(n): k for k, n in enumerate(lengths)}
    patterns, inverse, times, price = _start(counts, lengths, row, width)
    fills = [f for f in range(1, width + 1) if unpadded(f, width)]
    tokens = float(counts @ np.arange(len(counts)))
    paid = float(price @ counts[lengths])
    pivots = 0
    while pivots < PIVOTS and paid - tokens / width > SLACK * tokens / width:
        values = np.full(width + 1, -np.inf)
        values[lengths] = price
        best, last = knapsack(values, width)
        asked = {tuple(sorted(_items(last, f))) for f in fills if best[f] > 1 + 1e-7}
        full = values + best[::-1] - 1  # gain of the best full sequence with an item of each length
        for n in np.argsort(-full)[:POOL]:
            if full[n] > 1e-7:
                asked.add(tuple(sorted([int(n), *_items(last, width - int(n))])))
        if not asked:
            break
        takes = np.zeros((len(asked), m))
        pool = sorted(asked)
        for k, items in enumerate(pool):
            for n in items:
                takes[k, row[n]] += 1
        moved = False
        while pivots < PIVOTS:
            gains = takes @ price - 1
            best_gain, chosen = 1e-9, None
            for k in np.flatnonzero(gains > 1e-7):
                rows = np.flatnonzero(takes[k])
                step = inverse[:, rows] @ takes[k, rows]
                up = np.flatnonzero(step > 1e-7)
                if len(up):
                    ratio = times[up] / step[up]
                    at = int(ratio.argmin())
                    if gains[k] * ratio[at] >= best_gain or chosen is None:
                        best_gain, chosen = max(best_gain, gains[k] * ratio[at]), (k, step, int(up[at]), float(ratio[at]))
            if chosen is None:
                break
            k, step, out, much = chosen
            times -= much * step
            np.maximum(times, 0.0, out=times)
            times[out] = much
            leaving = inverse[out] / step[out]
            touched = np.flatnonzero(np.abs(step) > 1e-12)
            inverse[touched] -= np.outer(step[touched], leaving)
            inverse[out] = leaving
            price = price - gains[k] * leaving
            paid -= gains[k] * much
            patterns[out] = {n: pool[k].count(n) for n in set(pool[k])}
            pivots += 1
            moved = True
        if not moved:
            break
    return [(p, float(t)) for p, t in zip(patterns, times, strict=True) if p is not None and t > 1e-9]


def _exact(left: np.ndarray, rest: int, most: int) -> list[int] | None:
    """At most so many items of what is left that sum up to ``rest``, or None."""
    if not rest:
        return []
    if rest < len(left) and left[rest] > 0:
        return [rest]
    if most < 2:
        return None
    there = np.flatnonzero(left[: min(rest, len(left))] > 0)[::-1]
    if most == 2:
        other = rest - there
        good = (other < len(left)) & (other > 0)
        good[good] = left[other[good]] > (other[good] == there[good])
        if not good.any():
            return None
        n = int(there[int(good.argmax())])
        return [n, rest - n]
    for n in there[:TRIED]:
        left[n] -= 1
        found = _exact(left, rest - int(n), most - 1)
        left[n] += 1
        if found is not None:
            return [int(n), *found]
    return None


@dataclass
class Plan:
    """Where the items of each length go, by their rank among the items of that length.

    ``segments[n]`` holds (first rank, items a sequence, first sequence, offset there)
    in order of rank; what ranks behind ``streamed[n]`` = (first rank, place) follows one
    another in a stream of ``stream_tokens`` from that place on, whose first sequence is
    ``stream_sequence``. ``sequences`` is the number of all.
    """

    width: int
    segments: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    streamed: dict[int, tuple[int, int]] = field(default_factory=dict)
    stream_sequence: int = 0
    stream_tokens: int = 0
    sequences: int = 0

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the item, length, sequence, offset) of the pieces of an item; several only in the stream."""
        first, place = self.streamed.get(length, (None, 0))
        if first is None or rank < first:
            segments = self.segments[length]
            start, takes, sequence, offset = segments[bisect_right(segments, rank, key=lambda s: s[0]) - 1]
            copy, slot = divmod(rank - start, takes)
            return [(0, length, sequence + copy, offset + slot * length)]
        at = place + (rank - first) * length
        end, found = at + length, []
        while at < end:
            sequence, begin, stop = stream_sequence(at, self.stream_tokens, self.width)
            stop = min(stop, end)
            found.append((at - end + length, stop - at, self.stream_sequence + sequence, at - begin))
            at = stop
        return found


def stream_sequence(at: int, total: int, width: int) -> tuple[int, int, int]:
    """(number, begin, end) of the sequence a place of the stream is in: full ones, then one a power of two of the rest."""
    number, whole = at // width, total // width
    if number < whole:
        return number, number * width, (number + 1) * width
    begin, rest = whole * width, total % width
    while True:
        size = 1 << (rest.bit_length() - 1)
        if at < begin + size:
            return number, begin, begin + size
        begin, rest, number = begin + size, rest - size, number + 1


def packing_plan(counts: np.ndarray, width: int) -> Plan:
    """The plan of ``counts[n]`` items of each length n, 0 < n < width."""
    plan = Plan(width)
    left = counts.astype(np.int64).copy()
    dealt = np.zeros(len(left), np.int64)

    def place(pattern: dict[int, int], times: int) -> None:
        offset = 0
        for n in sorted(pattern, reverse=True):
            plan.segments.setdefault(n, []).append((int(dealt[n]), pattern[n], plan.sequences, offset))
            dealt[n] += pattern[n] * times
            left[n] -= pattern[n] * times
            offset += pattern[n] * n
        plan.sequences += times

    for pattern, times in column_generation(counts, width):
        whole = min([int(times + 1e-6), *(int(left[n]) // a for n, a in pattern.items())])
        if whole:
            place(pattern, whole)
    for n in range(len(left) - 1, 0, -1):
        while left[n] > 0:
            left[n] -= 1
            found = next((f for most in (1, 2, 3) if (f := _exact(left, width - n, most)) is not None), None)
            left[n] += 1
            if found is None:
                break
            pattern = {n: 1}
            for k in found:
                pattern[k] = pattern.get(k, 0) + 1
            if any(left[k] < a for k, a in pattern.items()):
                break
            place(pattern, 1)
    plan.stream_sequence = plan.sequences
    for n in np.flatnonzero(left > 0)[::-1]:
        plan.streamed[int(n)] = (int(dealt[n]), plan.stream_tokens)
        plan.stream_tokens += int(n) * int(left[n])
    plan.sequences += plan.stream_tokens // width + (plan.stream_tokens % width).bit_count()
    return plan
