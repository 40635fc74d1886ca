"""A counting quotient filter over 64-bit fingerprints, held in numpy arrays.

A fingerprint is cut into a quotient (its high ``q`` bits: the home slot) and a remainder (the other
bits, stored). Remainders of one quotient form a run; runs follow each other in the order of their
quotients, shifted to the right where the home slot is taken. Two bitmaps find them again: ``occupied``
has a bit for each quotient in use, ``runend`` for the last slot of each run. A remainder seen more
than once is followed by a slot that holds its count; ``counter`` marks those. As quotient and
remainder together are the whole fingerprint, filters of any sizes list their content exactly, in
sorted order, and merge without loss.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


class CountingQuotientFilter:
    def __init__(self, q: int, occupied, runend, counter, slots):
        self.q, self.occupied, self.runend, self.counter, self.slots = q, occupied, runend, counter, slots

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> "CountingQuotientFilter":
        values, counts = np.unique(np.asarray(fingerprints, dtype=_U), return_counts=True)
        return cls.counted(values, counts)

    @classmethod
    def counted(cls, values: np.ndarray, counts: np.ndarray) -> "CountingQuotientFilter":
        """From sorted, distinct fingerprints and their counts."""
        n = len(values)
        q = max(4, int(np.ceil(np.log2(max(1, 2 * n)))))
        if n == 0:
            none = np.zeros(1 << q, dtype=bool)
            return cls(q, none, none.copy(), none.copy(), np.zeros(1 << q, dtype=_U))
        r = 64 - q
        quotient = (values >> _U(r)).astype(np.int64)
        remainder = values & _U((1 << r) - 1)
        width = np.where(counts > 1, 2, 1)
        first = np.cumsum(width) - width  # slot if all stood gapless
        run_start = np.r_[True, quotient[1:] != quotient[:-1]]
        # Home slots shift right by what is before them: a running maximum gives all places at once.
        shift = np.maximum.accumulate(np.where(run_start, quotient - first, np.iinfo(np.int64).min))
        at = first + shift
        total = max(1 << q, int(at[-1] + width[-1]))
        slots = np.zeros(total, dtype=_U)
        occupied, runend, counter = (np.zeros(total, dtype=bool) for _ in range(3))
        slots[at] = remainder
        many = counts > 1
        slots[at[many] + 1] = counts[many].astype(_U)
        counter[at[many] + 1] = True
        occupied[quotient[run_start]] = True
        last = np.r_[np.flatnonzero(run_start)[1:] - 1, n - 1]
        runend[at[last] + width[last] - 1] = True
        return cls(q, occupied, runend, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, sorted, and their counts."""
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        if not len(quotients):
            return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
        starts = np.maximum(quotients, np.r_[-1, ends[:-1]] + 1)
        lengths = ends - starts + 1
        places = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        of = np.repeat(quotients, lengths)
        counting = self.counter[places]
        heads = places[~counting]
        values = (of[~counting].astype(_U) << _U(64 - self.q)) | self.slots[heads]
        counts = np.ones(len(heads), dtype=np.int64)
        counted = np.flatnonzero(np.r_[counting[1:], False][~counting])
        counts[counted] = self.slots[heads[counted] + 1].astype(np.int64)
        return values, counts

    @staticmethod
    def merged(filters: "list[CountingQuotientFilter]") -> "CountingQuotientFilter":
        """One filter with the sum of all counts; remainders of each are met in sorted order."""
        parts = [f.items() for f in filters]
        values = np.concatenate([v for v, _ in parts]) if parts else np.zeros(0, dtype=_U)
        counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, dtype=np.int64)
        order = np.argsort(values, kind="stable")  # a merge of sorted runs
        values, counts = values[order], counts[order]
        if not len(values):
            return CountingQuotientFilter.counted(values, counts)
        head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        return CountingQuotientFilter.counted(values[head], np.add.reduceat(counts, head))

    def to_bytes(self) -> bytes:
        """Bitmaps packed, used slots only, remainders in as few bytes as they need."""
        used = np.flatnonzero(self._used())
        bytes_each = (64 - self.q + 7) // 8
        body = self.slots[used].astype("<u8").view(np.uint8).reshape(-1, 8)
        return b"".join(
            [
                np.array([self.q, len(self.slots), len(used)], dtype="<i8").tobytes(),
                *(np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.counter)),
                np.ascontiguousarray(body[:, :bytes_each]).tobytes(),
            ]
        )

    @classmethod
    def from_bytes(cls, data: bytes) -> "CountingQuotientFilter":
        q, total, used = (int(x) for x in np.frombuffer(data[:24], dtype="<i8"))
        step, at, bits = (total + 7) // 8, 24, []
        for _ in range(3):
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=total).astype(bool))
            at += step
        made = cls(q, *bits, np.zeros(total, dtype=_U))
        bytes_each = (64 - q + 7) // 8
        wide = np.zeros((used, 8), dtype=np.uint8)
        wide[:, :bytes_each] = np.frombuffer(data, np.uint8, used * bytes_each, at).reshape(used, bytes_each)
        made.slots[made._used()] = wide.view("<u8").reshape(-1)
        return made

    def _used(self) -> np.ndarray:
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        edge = np.zeros(len(self.slots) + 1, dtype=np.int64)
        starts = np.maximum(quotients, np.r_[-1, ends[:-1]] + 1) if len(ends) else quotients
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends + 1, -1)
        return np.cumsum(edge[:-1]) > 0
