"""Suffix arrays by linear grouping, for many short strings side by side.

The construction has two phases (Baier's grouping algorithm). First, suffixes are
sorted into groups by their Lyndon prefix: groups are taken in descending order, and
every suffix of a group hands its group's prefix on to its previous smaller suffix
(the nearest position to its left in a lower group), which moves up into a new group
right behind its old one. Then the order is emitted from the least suffix on: the
suffix left of each emitted one, and its chain of previous smaller pointers, take the
next free place of their groups. Nothing is renamed or sorted recursively.

Each step of a string depends on the one before, so NumPy runs step s of all strings of
a batch at once.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings ``symbols[bounds[i]:bounds[i + 1]]``.

    Symbols are positive integers. Returns, in the layout of ``symbols``, positions in
    ``symbols`` in the order of the suffixes of their string.
    """
    lengths = np.diff(bounds)
    n_strings, total = len(lengths), int(bounds[-1])
    if not total:
        return np.zeros(0, np.int64)
    # Each string gets a guard cell in front, the end of every pointer chain, and a least symbol behind.
    base = bounds[:-1] + 2 * np.arange(n_strings)
    owner = np.repeat(np.arange(n_strings), lengths)
    cell = np.arange(total) + 2 * owner + 1
    size = total + 2 * n_strings
    value = np.zeros(size, np.int32)
    value[cell] = symbols
    value[base] = -1
    order, group, previous = _group(value, base, base + lengths + 1)
    out = _emit(order, group, previous, base, base + lengths + 1)
    return out[cell + 1].astype(np.int64) - 2 * owner - 1


def _group(value: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Phase one. Cells first[i] .. last[i] belong to string i: guard, symbols, least symbol."""
    size = len(value)
    string = np.repeat(np.arange(len(first), dtype=np.int32), last - first + 1)
    order = np.lexsort((value, string)).astype(np.int32)
    head = np.ones(size, bool)
    head[1:] = (value[order[1:]] != value[order[:-1]]) | (string[order[1:]] != string[order[:-1]])
    starts = np.flatnonzero(head)
    place = np.empty(size, np.int32)
    place[order] = np.arange(size, dtype=np.int32)
    group = np.empty(size, np.int32)
    group[order] = np.repeat(starts, np.diff(np.append(starts, size)))
    count = np.zeros(size, np.int32)
    count[starts] = np.diff(np.append(starts, size))
    previous = np.arange(-1, size - 1, dtype=np.int32)
    moved = np.zeros(size, bool)
    at = last.copy()  # the last cell of the highest group that is not yet done
    live = np.flatnonzero(at > first + 1)
    while len(live):
        end = at[live]
        start = group[order[end]]
        sizes = end - start + 1
        if len(live) == sizes.sum():
            members, level = order[end], start
        else:
            run = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            members, level = order[run], np.repeat(start, sizes)
        pointer = previous[members]
        todo = np.flatnonzero(group[pointer] >= level)
        while len(todo):
            step = previous[pointer[todo]]
            pointer[todo] = step
            todo = todo[group[step] >= level[todo]]
        previous[members] = pointer
        raised = pointer[value[pointer] >= 0]
        if len(raised):
            if len(raised) > len(live):
                raised, times = np.unique(raised, return_counts=True)
            else:
                raised, times = _counted(raised)
            old = group[raised]
            by = np.lexsort((times, old))
            raised, times, old = raised[by], times[by], old[by]
            new_old = np.ones(len(old), bool)
            new_old[1:] = old[1:] != old[:-1]
            opens = np.flatnonzero(new_old)
            amount = np.diff(np.append(opens, len(old)))
            nth = np.cumsum(new_old) - 1
            tail = (count[old[opens]] + old[opens] - amount)[nth]
            target = tail + np.arange(len(old)) - opens[nth]
            new_group = new_old.copy()
            new_group[1:] |= times[1:] != times[:-1]
            heads = np.flatnonzero(new_group)
            # The raised ones take the last places of their group; who stood there takes theirs.
            source = place[raised]
            moved[raised] = True
            there = order[target]
            out = there[~moved[there]]
            free = source[source < tail]
            moved[raised] = False
            order[free] = out
            place[out] = free
            order[target] = raised
            place[raised] = target
            count[old[opens]] -= amount
            count[target[heads]] = np.diff(np.append(heads, len(old)))
            group[raised] = target[heads][np.cumsum(new_group) - 1]
        at[live] = start - 1
        live = live[start - 1 > first[live] + 1]
    return order, group, previous


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    head = np.ones(len(values), bool)
    head[1:] = values[1:] != values[:-1]
    heads = np.flatnonzero(head)
    return values[heads], np.diff(np.append(heads, len(values)))


def _emit(order: np.ndarray, group: np.ndarray, previous: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Phase two; the guard keeps the first cell of each string, the least suffix the second."""
    out = order.copy()
    free = np.arange(len(order), dtype=np.int32)
    placed = np.zeros(len(order), bool)
    placed[first] = True
    placed[last] = True
    out[first + 1] = last
    at = first + 1
    live = np.arange(len(first))
    while len(live):
        now = out[at[live]] - 1
        now = now[~placed[now]]
        while len(now):
            spot = free[group[now]]
            out[spot] = now
            free[group[now]] += 1
            placed[now] = True
            now = previous[now]
            now = now[~placed[now]]
        at[live] += 1
        live = live[at[live] <= last[live]]
    return out
