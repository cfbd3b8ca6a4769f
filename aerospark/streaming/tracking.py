"""The centroid tracker over a stream of frames."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerospark.functions.ordered_rows import in_order
from aerospark.functions.track_step import MAX_DISAPPEARED, MAX_DISTANCE, Tracks
from aerospark.operators.tracking import marked_rows

STATE = (
    "next_id long, last_frame long, ids array<long>, xs array<double>, ys array<double>, "
    "missed array<int>, held_frame long, held_seqs array<long>, held_xs array<double>, held_ys array<double>"
)
OUTPUT = "video_id long, frame_index long, det_seq long, track_id long, rejected boolean"


#: A row of a video as a task holds it.
ROW = np.dtype([("frame_index", "i8"), ("det_seq", "i8"), ("present", "?"), ("cx", "f8"), ("cy", "f8")])
#: Rows that are packed together: 10,000 packets come to Python at once.
PACKET_ROWS = 256
#: Rows that a task gathers before it packs them.
GATHERED_ROWS = 131_072
PACKETS = "video_id long, n int, packet binary"


def _packet(rows: np.ndarray) -> bytes:
    """Rows in order as compressed bytes, those of the same place and field side by side."""
    rows["frame_index"][1:] = np.diff(rows["frame_index"])
    return pa.compress(rows.view(np.uint8).reshape(len(rows), -1).T.tobytes(), codec="zstd", asbytes=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The work of one task: its rows in packets of one video.

    Spark gathers the rows of a video and micro-batch in native memory before Python gets the first of
    them; in packets they take about a third.
    """
    schema = pa.schema([("video_id", pa.int64()), ("n", pa.int32()), ("packet", pa.binary())])

    def packets(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        videos, known, rows = (np.concatenate(values) for values in zip(*parts))
        order = np.lexsort((rows["det_seq"], rows["frame_index"], videos, known))
        videos, known, rows = videos[order], known[order], rows[order]
        opens = np.flatnonzero(np.r_[True, (videos[1:] != videos[:-1]) | (known[1:] != known[:-1])])
        bounds = [(at, min(at + PACKET_ROWS, end)) for begin, end in zip(opens, np.r_[opens[1:], len(rows)])
                  for at in range(begin, end, PACKET_ROWS)]
        heads = [low for low, _ in bounds]
        return pa.RecordBatch.from_arrays([
            pa.array(videos[heads], mask=~known[heads]), pa.array([high - low for low, high in bounds], pa.int32()),
            pa.array([_packet(rows[low:high]) for low, high in bounds], pa.binary()),
        ], schema=schema)

    parts, held = [], 0
    for batch in batches:
        if not len(batch):
            continue
        if batch.column("frame_index").null_count:
            raise ValueError("a row without a frame_index has no place in its video")
        rows = np.empty(len(batch), dtype=ROW)
        for name in ROW.names:
            rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
        video = batch.column("video_id")
        parts.append((video.fill_null(0).to_numpy(), video.is_valid().to_numpy(zero_copy_only=False), rows))
        held += len(rows)
        if held >= GATHERED_ROWS:
            yield packets(parts)
            parts, held = [], 0
    if held:
        yield packets(parts)


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The rows of batches, which come as they are or in packets."""
    for batch in batches:
        if "packet" not in batch:
            rows = np.empty(len(batch), dtype=ROW)
            for name in ROW.names:
                rows[name] = batch[name].astype(ROW[name])
            yield rows
            continue
        sizes = batch["n"].to_numpy()
        for begin in range(0, len(sizes), PACKET_ROWS):
            some = sizes[begin : begin + PACKET_ROWS].tolist()
            rows, end = np.empty(sum(some), dtype=ROW), 0
            for n, packet in zip(some, batch["packet"].iloc[begin : begin + PACKET_ROWS]):
                planes = pa.decompress(packet, decompressed_size=n * ROW.itemsize, codec="zstd", asbytes=True)
                own, end = rows[end : end + n], end + n
                own.view(np.uint8).reshape(n, -1)[:] = np.frombuffer(planes, dtype=np.uint8).reshape(-1, n).T
                own["frame_index"] = np.cumsum(own["frame_index"])
            yield rows


def _held(frame: int, seqs: list, xs: list, ys: list) -> np.ndarray:
    """The rows of a held frame; one without detections is a single absent row."""
    if not len(seqs):
        return np.array([(frame, -1, False, np.nan, np.nan)], dtype=ROW)
    return np.array([(frame, seq, True, x, y) for seq, x, y in zip(seqs, xs, ys)], dtype=ROW)


def _advance(max_distance: float, max_disappeared: int, hold_last: bool):
    """The work on one video's rows of a micro-batch, from its kept state.

    The rows are put in order through the task's disk, and gone through in blocks of whole frames.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks, last, given = Tracks(), -1, _records(batches)
        if state.exists:
            next_id, last, ids, xs, ys, missed, frame, *held = state.get
            tracks = Tracks(next_id, list(ids), list(xs), list(ys), list(missed))
            if frame >= 0:
                given = chain(given, [_held(frame, *held)])
        before, open_frame, keep = last, -1, ([], [], [])
        blocks = in_order(given, ("frame_index", "det_seq"))
        block = next(blocks, None)
        while block is not None:
            following = next(blocks, None)
            frames, present = block["frame_index"], block["present"]
            begins = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]])
            bounds = np.r_[0, np.cumsum(present)][np.r_[begins, len(frames)]].tolist()
            seen = block[present]
            xs, ys, owners = seen["cx"].tolist(), seen["cy"].tolist(), []
            if hold_last and following is None and frames[-1] > before:
                open_frame, low = int(frames[-1]), bounds[-2]
                keep = (seen["det_seq"][low:].tolist(), xs[low:], ys[low:])
                seen, bounds, begins = seen[:low], bounds[:-1], begins[:-1]
            for frame, low, high in zip(frames[begins].tolist(), bounds[:-1], bounds[1:]):
                if frame <= before:
                    owners += [-1] * (high - low)
                    continue
                owners += tracks.advance(xs[low:high], ys[low:high], max_distance, max_disappeared)
                last = frame
            late = seen["frame_index"] <= before
            yield pd.DataFrame({
                "video_id": np.full(len(seen), key[0]), "frame_index": seen["frame_index"], "det_seq": seen["det_seq"],
                "track_id": pd.array(owners, dtype="Int64"), "rejected": late,
            }).assign(track_id=lambda d: d["track_id"].where(~d["rejected"]))
            block = following
        state.update((tracks.next_id, last, tracks.ids, tracks.xs, tracks.ys, tracks.missed, open_frame, *keep))

    return run


def stream_tracks(
    rows: DataFrame, max_distance: float = MAX_DISTANCE, max_disappeared: int = MAX_DISAPPEARED,
    hold_last: bool = False,
) -> DataFrame:
    """Tracks for a stream of ``video_id, frame_index, det_seq, cx, cy``.

    A frame without detections comes as one row with a null ``det_seq``.  A frame that
    comes after a later one is marked rejected.  All rows of a frame arrive in one
    micro-batch, unless ``hold_last``: then the last frame of a batch waits in the state
    for more rows until a later frame of its video comes, which may be an empty one that
    marks the end.  State holds the live objects of a video only, and a task holds
    ``HELD_ROWS`` rows or a frame; those of a larger delivery go through its disk.  Spark
    still gathers the packets of a video and micro-batch in native memory, which the
    source's cap on files per batch bounds.
    """
    kinds = {"video_id": "long", "frame_index": "long", "det_seq": "long", "present": "boolean", "cx": "double", "cy": "double"}
    marked = marked_rows(rows).select(*[F.col(name).cast(kind) for name, kind in kinds.items()])
    return marked.mapInArrow(_pack, PACKETS).groupBy("video_id").applyInPandasWithState(
        _advance(max_distance, max_disappeared, hold_last), outputStructType=OUTPUT, stateStructType=STATE,
        outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout,
    )
