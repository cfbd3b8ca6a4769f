"""One frame of the centroid tracker, shared by the batch and the streaming job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import inf, isfinite, sqrt

import numpy as np

# Fixed defaults.
MAX_DISTANCE = 50.0
MAX_DISAPPEARED = 10
# Up to this many distances of a frame are taken one by one.
FEW_PAIRS = 256


@dataclass
class Tracks:
    """The live objects of one video, oldest first, and the next free id."""

    next_id: int = 0
    ids: list[int] = field(default_factory=list)
    xs: list[float] = field(default_factory=list)
    ys: list[float] = field(default_factory=list)
    missed: list[int] = field(default_factory=list)

    def _claims(self, xs: Sequence[float], ys: Sequence[float], max_distance: float) -> list[tuple[float, int, int]]:
        """``(gap, object, centre)`` for every object with its nearest centre within reach, best first.

        Few objects are compared in plain loops, which cost less than array calls; many, and centres
        that are no numbers, as arrays.  Both take the same sums and roots.
        """
        if len(xs) * len(self.ids) <= FEW_PAIRS and isfinite(sum(xs) + sum(ys)):
            claims, centres = [], list(zip(xs, ys))
            for row, (x, y) in enumerate(zip(self.xs, self.ys)):
                least, at = inf, -1
                for column, (px, py) in enumerate(centres):
                    across, down = x - px, y - py
                    gap = sqrt(across * across + down * down)
                    if gap < least:
                        least, at = gap, column
                if least <= max_distance and at >= 0:
                    claims.append((least, row, at))
            claims.sort()
            return claims
        across = np.asarray(self.xs)[:, None] - np.asarray(xs)[None, :]
        down = np.asarray(self.ys)[:, None] - np.asarray(ys)[None, :]
        gaps = np.sqrt(across * across + down * down)
        nearest, shortest = gaps.argmin(axis=1), gaps.min(axis=1)
        order = np.argsort(shortest, kind="stable")
        order = order[shortest[order] <= max_distance]
        return list(zip(shortest[order].tolist(), order.tolist(), nearest[order].tolist()))

    def advance(
        self, xs: Sequence[float], ys: Sequence[float], max_distance: float, max_disappeared: int
    ) -> list[int]:
        """Take in the centres of one frame; return the id given to each of them.

        An object claims only its nearest centre.  Claims are settled by distance,
        equal ones in object order; a lost claim is not retried.
        """
        ids, missed = self.ids, self.missed
        given = [-1] * len(xs)
        for row in range(len(ids)):
            missed[row] += 1
        if given and ids:
            for _, row, column in self._claims(xs, ys, max_distance):
                if given[column] < 0:
                    given[column] = ids[row]
                    self.xs[row], self.ys[row] = float(xs[column]), float(ys[column])
                    missed[row] = 0
        if missed and max(missed) > max_disappeared:
            alive = [row for row, count in enumerate(missed) if count <= max_disappeared]
            for name in ("ids", "xs", "ys", "missed"):
                values = getattr(self, name)
                setattr(self, name, [values[row] for row in alive])
        for column, owner in enumerate(given):
            if owner < 0:
                given[column] = self.next_id
                self.ids.append(self.next_id)
                self.xs.append(float(xs[column]))
                self.ys.append(float(ys[column]))
                self.missed.append(0)
                self.next_id += 1
        return given
