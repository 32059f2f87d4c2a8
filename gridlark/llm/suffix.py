"""Suffix arrays by linear grouping, for many independent texts at once.

The construction has two phases. Phase 1 groups suffixes by their first symbol and goes through the groups from the
highest down: each suffix of a group points to the last suffix before it in a lower group (its previous smaller
one); the suffixes pointed to leave their groups for new ones right above, ordered by how many pointers they got.
At the end a group holds the suffixes with one Lyndon prefix. Phase 2 emits the order inside the groups from the
lowest suffix up: the suffix before the one just emitted, and along its pointers all that aren't placed yet, take
the next places of their groups. Nothing is renamed and nothing recurses.

All texts of a call take each step together, so that a step is a few numpy operations over thousands of texts. A
pointer over processed suffixes is followed at most once by a suffix that isn't linked to its neighbour in the
group, so the steps of all suffixes together are in proportion to the text.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. , one after another."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)


def suffix_arrays(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The suffix arrays of the texts text[start[i]:start[i + 1]], one after another, as places in ``text``.

    Every text has to end with a symbol that is less than all its others.
    """
    n, lanes = len(text), len(start) - 1
    if not n:
        return np.zeros(0, np.int64)
    begin = np.repeat(start[:-1], np.diff(start))
    # groups are named by the first place of their block in sa
    lane = np.repeat(np.arange(lanes), np.diff(start))
    key = lane.astype(np.int64) * (int(text.max()) + 1) + text
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(first, sizes)
    size = np.zeros(n, np.int64)
    size[first] = sizes
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    prev = np.full(n, -1, np.int64)
    marked = np.zeros(n, bool)
    end = start[1:].copy()
    live = np.flatnonzero(end > start[:-1])
    while len(live):
        g = group[sa[end[live] - 1]]
        own = _ranges(g, end[live] - g)
        s = sa[own]
        name = np.repeat(g, end[live] - g)
        # by place in the text, so that the group's members before one stand before it
        s = np.sort(s)
        # walk left over processed suffixes by their pointers
        j, low = s - 1, begin[s]
        open_ = np.flatnonzero(j >= low)
        open_ = open_[group[j[open_]] > name[open_]]
        while len(open_):
            j[open_] = prev[j[open_]]
            open_ = open_[j[open_] >= low[open_]]
            open_ = open_[group[j[open_]] > name[open_]]
        # what ends at the group's own next member has its pointer, and so on along a run of such members
        at = np.maximum(j, 0)
        head = (j < low) | (group[at] < name)
        j = j[np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))]
        found = j >= low
        j[~found] = -1
        prev[s] = j
        p = np.sort(j[found])
        if len(p):
            new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            count = np.diff(np.append(new, len(p)))
            p = p[new]
            order = np.lexsort((count, group[p]))
            p, count = p[order], count[order]
            old = group[p]
            block = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            many = np.diff(np.append(block, len(p)))
            tops = old[block]
            tail = tops + size[tops] - many
            slots = _ranges(tail, many)
            # what stands in the tail without leaving changes places with what leaves from further down
            marked[p] = True
            there = sa[slots]
            stay = there[~marked[there]]
            holes = isa[p]
            holes = np.sort(holes[holes < np.repeat(tail, many)])
            sa[holes] = stay
            isa[stay] = holes
            sa[slots] = p
            isa[p] = slots
            marked[p] = False
            cut = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (count[1:] != count[:-1])]))
            length = np.diff(np.append(cut, len(p)))
            size[tops] -= many
            size[slots[cut]] = length
            group[p] = np.repeat(slots[cut], length)
        end[live] = g
        live = live[g > start[live]]
    # phase 2: the next free place of each group
    free = np.arange(n)
    placed = np.zeros(n, bool)
    out = np.full(n, -1, np.int64)
    last = start[1:] - 1
    last = last[start[1:] > start[:-1]]
    out[group[last]] = last
    placed[last] = True
    free[group[last]] += 1
    live = np.flatnonzero(start[1:] > start[:-1])
    read = start[live].copy()
    low, high = start[live], start[live + 1]
    j = out[read] - 1
    while len(live):
        can = j >= low
        at = np.where(can, j, 0)
        can &= ~placed[at]
        put = at[can]
        if len(put):
            g = group[put]
            out[free[g]] = put
            free[g] += 1
            placed[put] = True
            j[can] = prev[put]
        done = ~can
        read[done] += 1
        over = read >= high
        if over.any():
            keep = ~over
            live, read, low, high, j, done = live[keep], read[keep], low[keep], high[keep], j[keep], done[keep]
        j[done] = out[read[done]] - 1
    return out
