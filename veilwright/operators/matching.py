"""Which findings of a text meet which truth spans, without trying every pair.

A finding meets a truth span when their places touch, or when the value of one holds that of the other.
Places: findings are put in order of their starts, and the running maximum of their ends is searched.
Values: equal values are one; a value that holds another holds its rarest run of ``GRAM`` characters, so
only values that share such a run are compared. Work grows with the spans and with what is found.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

#: Characters of the runs by which values are looked up; shorter values are looked up as they are.
GRAM = 3
#: Up to so many pairs of a text are tried one by one; looking them up would cost more.
FEW_PAIRS = 64

Span = tuple[str, int, int]


def grams(value: str, size: int = GRAM) -> set[str]:
    return {value[i : i + size] for i in range(len(value) - size + 1)}


def holders(inner: list[str], outer: list[str]) -> list[tuple[int, int]]:
    """``(i, j)`` of all different values with ``inner[i]`` in ``outer[j]``."""
    known = [grams(v) for v in outer]
    often = Counter(g for own in known for g in own)
    by_gram, short = defaultdict(list), defaultdict(list)
    for i, value in enumerate(inner):
        own = grams(value)
        if not own:
            short[value].append(i)
        elif all(g in often for g in own):
            by_gram[min(own, key=lambda g: (often[g], g))].append(i)
    out = []
    for j, value in enumerate(outer):
        out += [(i, j) for g in known[j] & by_gram.keys() for i in by_gram[g] if inner[i] in value]
        if short:
            runs = {"", *grams(value, 1), *grams(value, 2)}
            out += [(i, j) for run in runs & short.keys() for i in short[run]]
    return out


class Meeting:
    """Truth spans and findings ``(value, start, end)`` of one text."""

    def __init__(self, truth: list[Span], found: list[Span]):
        self.truth, self.found = truth, found
        self.starts = np.array([f[1] for f in found], np.int64)
        self.order = np.argsort(self.starts, kind="stable")
        self.sorted_starts = self.starts[self.order]
        self.ends = np.array([f[2] for f in found], np.int64)[self.order]
        self.reach = np.maximum.accumulate(self.ends) if found else self.ends
        self.in_order = bool((self.order == np.arange(len(found))).all())
        # Findings by value, and for each truth value the values of findings that one holds or is held by.
        self.by_value: dict[str, list[int]] = defaultdict(list)
        for i, f in enumerate(found):
            self.by_value[f[0]].append(i)
        values, wanted = list(self.by_value), list(dict.fromkeys(t[0] for t in truth))
        self.kin: dict[str, set[str]] = defaultdict(set)
        for i, j in holders(values, wanted):
            self.kin[wanted[j]].add(values[i])
        for i, j in holders(wanted, values):
            self.kin[wanted[i]].add(values[j])

    def touching(self, start: int, end: int) -> np.ndarray:
        """Findings whose place touches ``[start, end]``, in the order of the array."""
        high = int(np.searchsorted(self.sorted_starts, end, "right"))
        low = min(int(np.searchsorted(self.reach, start, "left")), high)
        return np.sort(self.order[low:high][self.ends[low:high] >= start])

    def first(self, t: Span) -> int | None:
        """The first finding that meets a truth span."""
        best = min((self.by_value[v][0] for v in self.kin.get(t[0], ())), default=None)
        if self.in_order:
            at = int(np.searchsorted(self.reach, t[1], "left"))
            place = at if at < len(self.found) and self.sorted_starts[at] <= t[2] else None
        else:
            near = self.touching(t[1], t[2])
            place = int(near[0]) if len(near) else None
        return min((x for x in (best, place) if x is not None), default=None)

    def all(self, t: Span) -> list[int]:
        """All findings that meet a truth span, in order."""
        alike = [i for v in self.kin.get(t[0], ()) for i in self.by_value[v]]
        return sorted({*alike, *self.touching(t[1], t[2]).tolist()})

    def unmet(self) -> list[int]:
        """Findings that meet no truth span."""
        known = {v for kin in self.kin.values() for v in kin}
        starts = np.array([t[1] for t in self.truth], np.int64)
        order = np.argsort(starts, kind="stable")
        starts = starts[order]
        reach = np.maximum.accumulate(np.array([t[2] for t in self.truth], np.int64)[order]) if self.truth else starts
        out = []
        for i, (value, start, end) in enumerate(self.found):
            at = int(np.searchsorted(reach, start, "left"))
            if value not in known and not (at < len(starts) and starts[at] <= end):
                out.append(i)
        return out


class Pairs:
    """What ``Meeting`` tells, for few spans: every pair is tried."""

    def __init__(self, truth: list[Span], found: list[Span]):
        self.truth, self.found = truth, found

    def all(self, t: Span) -> list[int]:
        value, start, end = t
        return [i for i, f in enumerate(self.found) if (f[1] <= end and f[2] >= start) or f[0] in value or value in f[0]]

    def first(self, t: Span) -> int | None:
        return next(iter(self.all(t)), None)

    def unmet(self) -> list[int]:
        known = {i for t in self.truth for i in self.all(t)}
        return [i for i in range(len(self.found)) if i not in known]


def meeting(truth: list[Span], found: list[Span]) -> Meeting | Pairs:
    return (Pairs if len(truth) * len(found) <= FEW_PAIRS else Meeting)(truth, found)
