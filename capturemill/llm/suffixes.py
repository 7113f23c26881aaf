"""Suffix arrays by linear grouping: suffixes with equal Lyndon prefixes first, their order after that.

The first pass takes the groups in descending order.  Each suffix of a group points to the nearest earlier
suffix of a smaller group; suffixes that are pointed to l times move behind their group, those with the
highest l farthest.  In the end a group holds the suffixes of one Lyndon prefix.  The second pass walks the array
from its front: the suffix before the current one, and those its pointers lead to, take the next free places
of their groups.  Nothing is renamed and nothing recurs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of a sequence of integers in lexicographic order, a prefix before what it begins."""
    n = len(symbols) + 1
    # place of each suffix in the array of groups; the empty suffix is smallest
    array = [n - 1, *sorted(range(n - 1), key=symbols.__getitem__)]
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, suffix in enumerate(array):
        if at < 2 or symbols[suffix] != symbols[array[at - 1]]:
            start = at
        place[suffix], group[suffix] = at, start
        size[start] += 1
    smaller = [-1] * n
    end = n
    while end > 0:
        start = group[array[end - 1]]
        pointed: dict[int, int] = {}
        for suffix in sorted(array[start:end]):
            before = suffix - 1
            while before >= 0 and group[before] >= start:
                before = smaller[before]
            smaller[suffix] = before
            if before >= 0:
                pointed[before] = pointed.get(before, 0) + 1
        if pointed:
            if len(pointed) == 1:
                _move(list(pointed), array, place, group, size)
            else:
                levels: dict[int, list[int]] = defaultdict(list)
                for suffix, times in pointed.items():
                    levels[times].append(suffix)
                for times in sorted(levels, reverse=True):
                    _move(levels[times], array, place, group, size)
        end = start
    free = list(range(n))
    order = [-1] * n
    order[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    for at in range(n):
        suffix = order[at] - 1
        while suffix >= 0 and not done[suffix]:
            done[suffix] = 1
            own = group[suffix]
            order[free[own]] = suffix
            free[own] += 1
            suffix = smaller[suffix]
    return order[1:]


def _move(suffixes: list[int], array: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Give the suffixes a new group of their own right behind each group they are in."""
    left: dict[int, int] = {}
    for suffix in suffixes:
        own = group[suffix]
        rest = left[own] = left.get(own, size[own]) - 1
        last = own + rest
        other = array[last]
        at = place[suffix]
        array[at], array[last] = other, suffix
        place[other], place[suffix] = at, last
    for own, rest in left.items():
        if rest:
            size[own + rest] = size[own] - rest
            size[own] = rest
    for suffix in suffixes:
        own = group[suffix]
        group[suffix] = own + left[own]
