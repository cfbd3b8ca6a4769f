"""Many lanes of frames through the centroid tracker at once, one frame of each in a step."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Gaps of a step that are held as arrays at once, where lanes can be gone through in turn.
STEP_GAPS = 2_000_000


@dataclass
class Objects:
    """Live objects in order, oldest first."""

    ids: np.ndarray
    xs: np.ndarray
    ys: np.ndarray
    missed: np.ndarray

    def packed(self) -> bytes:
        """Places and ages, without the ids."""
        return np.stack([self.xs.view(np.int64), self.ys.view(np.int64), self.missed]).tobytes()


def unpacked(state: bytes) -> np.ndarray:
    """Three rows of numbers: the bits of x and of y, and the frames missed."""
    return np.frombuffer(state, dtype=np.int64).reshape(3, -1)


def same_objects(left: np.ndarray, right: np.ndarray, in_order: bool) -> np.ndarray | None:
    """For every object of ``right`` its place in ``left``, or none if they are not the same objects."""
    if left.shape != right.shape:
        return None
    if np.array_equal(left, right):
        return np.arange(left.shape[1])
    if in_order:
        return None
    mine, other = np.lexsort(left), np.lexsort(right)
    if not np.array_equal(left[:, mine], right[:, other]):
        return None
    place = np.empty(left.shape[1], dtype=np.int64)
    place[other] = mine
    return place


@dataclass
class Lane:
    """What a lane begins and ends with; its first objects are numbered from 0, the born ones behind them."""

    first: bytes
    last: Objects
    born: int
    tied: bool

    def packed(self) -> bytes:
        """The numbers of first, last and born objects and the tie, and what ``ends_of_lane`` reads of the objects."""
        sizes = np.array([len(self.first) // 24, len(self.last.ids), self.born, self.tied], dtype=np.int64)
        return sizes.tobytes() + self.first + self.last.packed() + self.last.ids.tobytes()


def ends_of_lane(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """First and last objects, the ids of the last, the number of born ones and whether order counted."""
    n, m, born, tied = np.frombuffer(packed, dtype=np.int64, count=4).tolist()
    values = np.frombuffer(packed, dtype=np.int64, offset=32)
    return values[: 3 * n].reshape(3, -1), values[3 * n : 3 * (n + m)].reshape(3, -1), values[3 * (n + m) :], born, bool(tied)


def _groups(widest: np.ndarray, lengths: np.ndarray, max_disappeared: int) -> list[np.ndarray]:
    """Lanes that are gone through together, the longest of a group first, so that its gaps are bounded."""
    groups, rest = [], np.argsort(widest, kind="stable")[::-1]
    while len(rest):
        width = max(1, int(widest[rest[0]]))
        some = max(1, STEP_GAPS // (width * width * (max_disappeared + 1)))
        chosen, rest = rest[:some], rest[some:]
        groups.append(chosen[np.argsort(-lengths[chosen], kind="stable")])
    return groups


def advance_lanes(
    lane_begins: np.ndarray, warm: np.ndarray, begins: np.ndarray, counts: np.ndarray, xs: np.ndarray, ys: np.ndarray,
    max_distance: float, max_disappeared: int, states: dict[int, bytes] | None = None,
) -> tuple[np.ndarray, list[Lane]]:
    """The same as ``Tracks.advance`` for every frame of every lane: the ids of all centres, and the lanes' ends.

    The frames of lane ``i`` are ``lane_begins[i]`` up to ``lane_begins[i + 1]``, the first ``warm[i]`` of them
    before its own; the centres of frame ``f`` are ``begins[f]`` up to ``begins[f] + counts[f]``.  A lane starts
    from ``states[i]``, or from nothing.  ``tied`` tells that the order of its first objects settled a claim.
    """
    given = np.full(len(xs), -1, dtype=np.int64)
    lanes: list[Lane | None] = [None] * len(warm)
    lengths = np.diff(lane_begins)
    widest = np.array([counts[b:e].max(initial=0) for b, e in zip(lane_begins[:-1], lane_begins[1:])], dtype=np.int64)
    for group in _groups(widest, lengths, max_disappeared):
        _advance_group(group, lane_begins, lengths, warm, begins, counts, xs, ys, max_distance, max_disappeared, states or {}, given, lanes)
    return given, lanes


def _advance_group(
    group, lane_begins, lengths, warm, begins, counts, xs, ys, max_distance, max_disappeared, states, given, lanes
) -> None:
    size, slots = len(group), 16
    for lane in group.tolist():
        slots = max(slots, len(states.get(lane, b"")) // 24)
    # Arrays are by slot and lane.  An empty slot has missed too much, the id -1 and no place, so its gaps
    # are no numbers and claim nothing.
    ids = np.full((slots, size), -1, dtype=np.int64)
    ox, oy = np.full((slots, size), np.nan), np.full((slots, size), np.nan)
    never = np.iinfo(np.int64).max // 2
    missed = np.full((slots, size), never, dtype=np.int64)
    next_id, carried = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    tied, first = np.zeros(size, dtype=bool), [b""] * size
    mine, firsts, before = lengths[group], lane_begins[group], warm[group]

    def places(lane: int) -> np.ndarray:
        """The slots of a lane's objects, oldest first."""
        live = np.flatnonzero(ids[:, lane] >= 0)
        return live[np.argsort(ids[live, lane])]

    def objects(lane: int) -> Objects:
        live = places(lane)
        return Objects(ids[live, lane], ox[live, lane], oy[live, lane], missed[live, lane])

    for lane, name in enumerate(group.tolist()):
        if name in states:
            values = unpacked(states[name])
            n = values.shape[1]
            ids[:n, lane], next_id[lane] = np.arange(n), n
            ox[:n, lane], oy[:n, lane], missed[:n, lane] = values[0].view(float), values[1].view(float), values[2]
    lane_numbers, numbers = np.arange(size), np.arange(1024)

    def centre_numbers(n: int) -> np.ndarray:
        nonlocal numbers
        if n > len(numbers):
            numbers = np.arange(2 * n)
        return numbers[:n]

    reach = max_distance * max_distance * (1 + 1e-9)
    finite = bool(np.isfinite(xs).all() and np.isfinite(ys).all())
    active, begun, ended = size, set(before.tolist()), set(mine.tolist())
    for step in range(int(mine.max(initial=0))):
        while mine[active - 1] <= step:
            active -= 1
        for lane in np.flatnonzero(before[:active] == step).tolist() if step in begun else ():
            first[lane], live = objects(lane).packed(), places(lane)
            ids[live, lane] = np.arange(len(live))
            next_id[lane] = carried[lane] = len(live)
        frame = firsts[:active] + step
        n = counts[frame]
        total = int(n.sum())
        missed[:, :active] += 1
        if total:
            # the centres of the step, lane after lane
            heads = np.cumsum(n) - n
            lane_of, at = np.repeat(lane_numbers[:active], n), np.repeat(begins[frame] - heads, n) + centre_numbers(total)
            px, py = xs[at], ys[at]
            gaps = ox.take(lane_of, axis=1)
            gaps -= px
            gaps *= gaps
            down = oy.take(lane_of, axis=1)
            down -= py
            down *= down
            gaps += down
            slot, centre = np.divmod(np.flatnonzero(gaps.ravel() <= reach), total)
            gap = np.sqrt(gaps[slot, centre])
            near = gap <= max_distance
            if not finite:
                # as for the nearest of some gaps of which one is no number
                near &= ~np.logical_or.reduceat(np.isnan(gaps), heads[n > 0], axis=1)[slot, (np.cumsum(n > 0) - 1)[lane_of[centre]]]
            if not near.all():
                slot, centre, gap = slot[near], centre[near], gap[near]
            found = np.full(total, -1, dtype=np.int64)
            if len(slot):
                # the pairs of an object stand together: its nearest centre, the first of equal ones
                object_of = slot * active + lane_of[centre]
                opens = np.flatnonzero(np.r_[True, object_of[1:] != object_of[:-1]])
                least = np.repeat(np.minimum.reduceat(gap, opens), np.diff(np.r_[opens, len(gap)]))
                nearest = np.flatnonzero(gap == least)
                nearest = nearest[np.r_[True, object_of[nearest[1:]] != object_of[nearest[:-1]]]]
                slot, centre, gap = slot[nearest], centre[nearest], gap[nearest]
                best = np.full(total, np.inf)
                np.minimum.at(best, centre, gap)
                wins = gap == best[centre]
                slot, centre = slot[wins], centre[wins]
                lane = lane_of[centre]
                owner = ids[slot, lane]
                oldest = np.full(total, np.iinfo(np.int64).max)
                np.minimum.at(oldest, centre, owner)
                wins = owner == oldest[centre]
                if not wins.all():
                    old = owner < carried[lane]
                    tied[lane[old][np.bincount(centre[old], minlength=total)[centre[old]] > 1]] = True
                    slot, lane, centre, owner = (values[wins] for values in (slot, lane, centre, owner))
                ox[slot, lane], oy[slot, lane], missed[slot, lane] = px[centre], py[centre], 0
                found[centre] = owner
        free = missed[:, :active] > max_disappeared
        ids[:, :active][free], ox[:, :active][free] = -1, np.nan
        if total:
            # the free slots of a lane take its new objects in the order of the centres
            born = np.flatnonzero(found < 0)
            lane = lane_of[born]
            births, frees = np.bincount(lane, minlength=active), free.sum(axis=0)
            short = int((births - frees).max())
            if short > 0:
                more = ((0, max(short, len(ids) // 4)), (0, 0))
                ids, missed = np.pad(ids, more, constant_values=-1), np.pad(missed, more, constant_values=never)
                ox, oy = (np.pad(values, more, constant_values=np.nan) for values in (ox, oy))
                free = missed[:, :active] > max_disappeared
                frees = free.sum(axis=0)
            rank = centre_numbers(len(lane)) - (np.cumsum(births) - births)[lane]
            slot = np.nonzero(free.T)[1][(np.cumsum(frees) - frees)[lane] + rank]
            new = next_id[lane] + rank
            found[born] = new
            ids[slot, lane], missed[slot, lane] = new, 0
            ox[slot, lane], oy[slot, lane] = px[born], py[born]
            next_id[:active] += births
            known = carried[lane_of]
            given[at] = np.where(found < known, -1 - found, found - known)
        for lane in np.flatnonzero(mine[:active] == step + 1).tolist() if step + 1 in ended else ():
            lanes[group[lane]] = Lane(first[lane], objects(lane), int(next_id[lane] - carried[lane]), bool(tied[lane]))
