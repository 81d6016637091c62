"""Suffix arrays by grouping suffixes with equal Lyndon prefixes.

The first phase puts suffixes that share their Lyndon prefix into one group and the
groups in order, without sorting and without renaming into a shorter string. It starts
from the groups of equal first symbols and takes the groups from the greatest to the
least. When a group is taken, its common prefix w is final. For a suffix of the group,
the nearest earlier one of a lesser group is the previous smaller suffix; this suffix
goes on with w behind its own prefix, once or several times, and with that is greater
than those of its group that don't: it moves to a new group right above its old one,
the more copies of w, the higher. The second phase lists the suffixes in order: when a
suffix is listed, those whose next smaller suffix it is follow one another along the
previous-smaller pointers, and each takes the next free place of its group.
"""

from __future__ import annotations


def lyndon_groups(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, previous smaller suffix of each or -1, places of the groups' first suffixes by group)."""
    n = len(text)
    symbols = sorted(set(text))
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    done = [False] * len(symbols)
    previous = [-1] * n
    lowest = 0

    def put_above(old: int) -> int:
        new, over = len(size), above[old]
        members.append([])
        size.append(0)
        done.append(False)
        below.append(old)
        above.append(over)
        above[old] = new
        below[over] = new
        return new

    now = len(symbols) - 1
    while now >= 0:
        copies: dict[int, int] = {}  # of w behind each previous smaller suffix
        for i in members[now]:
            if group[i] != now:
                continue  # it has moved on
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            if p >= 0 and group[p] == now:
                p = previous[p]
                if p >= 0:
                    copies[p] += 1
            elif p >= 0:
                copies[p] = 1
            previous[i] = p
        done[now] = True
        members[now] = []
        if len(copies) == 1:
            (p,) = copies
            if size[group[p]] > 1:
                size[group[p]] -= 1
                new = put_above(group[p])
                members[new], size[new], group[p] = [p], 1, new
        elif copies:
            by_copies: dict[int, list[int]] = {}
            for p, k in copies.items():
                by_copies.setdefault(k, []).append(p)
            for k in sorted(by_copies, reverse=True):
                moving: dict[int, list[int]] = {}
                for p in by_copies[k]:
                    moving.setdefault(group[p], []).append(p)
                for old, some in moving.items():
                    if len(some) < size[old]:  # else the group stays together
                        size[old] -= len(some)
                        new = put_above(old)
                        members[new], size[new] = some, len(some)
                        for p in some:
                            group[p] = new
        now = below[now]

    start, at, g = [0] * len(size), 0, lowest
    while g >= 0 and n:
        start[g] = at
        at += size[g]
        g = above[g]
    return group, previous, start


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order."""
    group, previous, place = lyndon_groups(text)
    order = [-1] * len(text)
    i = j = len(text)  # the empty suffix comes first and is not listed
    stop = -1
    j = i - 1
    while j != stop:
        g = group[j]
        order[place[g]] = j
        place[g] += 1
        j = previous[j]
    for k in range(len(text)):
        i = order[k]
        stop, j = previous[i], i - 1
        while j != stop:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            j = previous[j]
    return order
