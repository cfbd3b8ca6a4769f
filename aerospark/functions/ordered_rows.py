"""Rows of one group put in order by a task that cannot hold them all."""

from __future__ import annotations

import os
import random
import tempfile
from collections.abc import Iterator

import numpy as np

# Rows that are held at once; a group of more goes through the task's own disk.
HELD_ROWS = 131_072
# Least number of rows that is read back of a run at once.
LEAST_READ = 1024


def _scratch():
    """A file in one of Spark's local folders that has no name, so it goes with the task."""
    named = [path for path in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(path)]
    return tempfile.TemporaryFile(dir=random.choice(named) if named else None)


def _sorted(parts: list[np.ndarray], keys: tuple[str, ...]) -> np.ndarray:
    rows = parts[0] if len(parts) == 1 else np.concatenate(parts)
    return rows[np.lexsort([rows[key] for key in reversed(keys)])]


def in_order(batches: Iterator[np.ndarray], keys: tuple[str, ...], held_rows: int | None = None) -> Iterator[np.ndarray]:
    """Records in order of ``keys``, in blocks; those that agree in the first key come in one block.

    While no more than ``held_rows`` come they are one block.  More are written as sorted runs, which
    are read back side by side, so that about as many are held at once.
    """
    held_rows = held_rows or HELD_ROWS
    parts, held, runs, file = [], 0, [], None
    try:
        for batch in batches:
            if held and held + len(batch) > held_rows:
                file = file or _scratch()
                begin = file.tell()
                file.write(_sorted(parts, keys).tobytes())
                runs.append((begin, file.tell()))
                parts, held = [], 0
            parts.append(batch)
            held += len(batch)
        last = _sorted(parts, keys) if held else None
        parts.clear()
        if not runs:
            if last is not None:
                yield last
            return
        yield from _merged(file, runs, last, keys, max(LEAST_READ, held_rows // (len(runs) + 1)))
    finally:
        if file is not None:
            file.close()


def _merged(file, runs: list[tuple[int, int]], last: np.ndarray, keys: tuple[str, ...], read: int) -> Iterator[np.ndarray]:
    """The blocks of the runs in ``file`` and of the one still held."""
    kind, size = last.dtype, last.dtype.itemsize
    # of each run: what was read and not yet given, and where the rest lies
    rest = [*[np.zeros(0, dtype=kind) for _ in runs], last]
    places, ends = [begin for begin, _ in runs], [end for _, end in runs]
    least = read // 2
    while True:
        for run, (place, end) in enumerate(zip(places, ends)):
            if place < end and len(rest[run]) <= least:
                file.seek(place)
                more = np.frombuffer(file.read(min(read * size, end - place)), dtype=kind)
                rest[run] = np.concatenate([rest[run], more])
                places[run] += len(more) * size
        unread = [run for run in range(len(runs)) if places[run] < ends[run]]
        if not unread:
            yield _sorted(rest, keys)
            return
        # everything before the first key up to which all runs were read
        cut = min(rest[run][keys[0]][-1] for run in unread)
        given = [int(np.searchsorted(values[keys[0]], cut)) for values in rest]
        if any(given):
            yield _sorted([values[:n] for values, n in zip(rest, given) if n], keys)
            rest = [values[n:] for values, n in zip(rest, given)]
            least = read // 2
        else:
            # one key fills what was read of a run
            least = max(len(rest[run]) for run in unread)
