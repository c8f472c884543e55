"""Suffix arrays by induced sorting, bucket by bucket, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end counts as smallest."""
    n = len(text)
    rising, differs = np.zeros(n, bool), np.zeros(n, bool)
    rising[:-1] = text[:-1] < text[1:]
    differs[:-1] = text[:-1] != text[1:]
    differs[-1] = True
    decided = np.where(differs, np.arange(n), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return rising[decided]


def _deal(places: np.ndarray, text: np.ndarray, wanted: np.ndarray, out: list[list[np.ndarray]]) -> None:
    """Put the predecessors that ``wanted`` admits into their letters' lists, in the order given."""
    before = places[places > 0] - 1
    before = before[wanted[before]]
    if not len(before):
        return
    letters = text[before]
    before = before[np.argsort(letters, kind="stable")]
    counts = np.bincount(letters, minlength=256)
    at = 0
    for letter in np.flatnonzero(counts).tolist():
        out[letter].append(before[at:at + counts[letter]])
        at += counts[letter]


def _run(found: list[np.ndarray], letter: int, text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """All suffixes of one bucket and type: those found from other buckets, then their runs of one letter."""
    wave = np.concatenate(found) if found else np.zeros(0, np.int64)
    parts = [wave]
    while len(wave):
        before = wave[wave > 0] - 1
        wave = before[(text[before] == letter) & wanted[before]]
        parts.append(wave)
    return np.concatenate(parts)


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order of all suffixes from that of the leftmost-smaller ones (``seeds``, in order).

    Buckets are filled in one pass up and one pass down; each is complete when its turn
    comes, so its predecessors are dealt out together.
    """
    larger, letters = ~smaller, np.flatnonzero(np.bincount(text, minlength=256)).tolist()
    of_seed = text[seeds]
    by_letter = np.argsort(of_seed, kind="stable")
    edges = np.searchsorted(of_seed[by_letter], np.arange(257))
    seeded = [seeds[by_letter[edges[c]:edges[c + 1]]] for c in range(256)]
    rising: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(np.array([len(text)]), text, larger, rising)
    upper: dict[int, np.ndarray] = {}
    for c in letters:
        upper[c] = _run(rising[c], c, text, larger)
        rising[c] = []
        both = np.concatenate((upper[c], seeded[c]))
        before = both[both > 0] - 1
        _deal(before[text[before] != c] + 1, text, larger, rising)
    falling: list[list[np.ndarray]] = [[] for _ in range(256)]
    parts: list[np.ndarray] = []
    for c in reversed(letters):
        lower = _run(falling[c], c, text, smaller)
        falling[c] = []
        parts += [lower, upper[c][::-1]]
        both = np.concatenate((lower, upper[c][::-1]))
        before = both[both > 0] - 1
        _deal(before[text[before] != c] + 1, text, smaller, falling)
    return np.concatenate(parts)[::-1]


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of numbers: tied groups are sorted by what follows, twice as far each time."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    fresh = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    sizes = np.bincount(rank, minlength=n)
    open_ = order[sizes[rank[order]] > 1]
    step = 1
    while len(open_):
        beyond = open_ + step
        follow = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        own = rank[open_]
        by = np.lexsort((follow, own))
        open_, own, follow = open_[by], own[by], follow[by]
        group = np.concatenate(([True], own[1:] != own[:-1]))
        part = group | np.concatenate(([True], follow[1:] != follow[:-1]))
        index = np.arange(len(open_))
        new = own + np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        rank[open_] = new
        sizes = np.bincount(np.cumsum(part) - 1)
        open_ = open_[sizes[np.cumsum(part) - 1] > 1]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a byte array in order."""
    if len(text) < 2:
        return np.arange(len(text))
    smaller = _types(text)
    leftmost = np.zeros(len(text), bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    places = np.flatnonzero(leftmost)
    if len(places) > 1:
        # Sort the pieces between leftmost-smaller places, name them, sort the names' suffixes.
        rough = _induce(text, smaller, places)
        rough = rough[leftmost[rough]]
        index = np.full(len(text), -1, np.int64)
        index[places] = np.arange(len(places))
        stops = np.concatenate((places[1:] + 1, [len(text)]))
        a, b = index[rough[:-1]], index[rough[1:]]
        same = _equal(text, places[a], places[b], stops[a] - places[a], stops[b] - places[b])
        same &= (a != len(places) - 1) & (b != len(places) - 1)
        names = np.empty(len(places), np.int64)
        names[index[rough]] = np.concatenate(([0], np.cumsum(~same)))
        places = places[_sort_names(names)]
    return _induce(text, smaller, places)


def _equal(text: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether pairs of pieces have the same bytes."""
    same = sizes == others
    live = np.flatnonzero(same)
    depth = 0
    while len(live):
        equal = text[left[live] + depth] == text[right[live] + depth]
        same[live[~equal]] = False
        depth += 1
        live = live[equal]
        live = live[sizes[live] > depth]
    return same


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in text order: the suffix before it in the array, and the length of their common prefix.

    Only irreducible places (where the letters before the two differ) are compared byte
    by byte; from there the length falls by one per place.
    """
    n = len(text)
    previous = np.full(n, -1, np.int64)
    previous[order[1:]] = order[:-1]
    shifted = np.where(previous > 0, text[np.maximum(previous, 1) - 1].astype(np.int16), -1)
    letter = np.concatenate(([-2], text[:-1].astype(np.int16)))
    irreducible = (letter != shifted) | (previous < 0)
    starts = np.flatnonzero(irreducible)
    lengths = np.zeros(len(starts), np.int64)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live = np.flatnonzero(previous[starts] >= 0)
    while len(live):
        a, b = starts[live] + lengths[live], previous[starts[live]] + lengths[live]
        room = n - np.maximum(a, b)
        same = words[np.minimum(a, n)] == words[np.minimum(b, n)]
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        run = np.minimum(run, room)
        lengths[live] += run
        live = live[run == 8]
    source = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    at = np.cumsum(irreducible) - 1
    return previous, np.maximum(lengths[at] - (np.arange(n) - source), 0)
