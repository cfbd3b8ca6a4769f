"""WARC archives: writing them, and reading them back by boundary-chain verification.

Archives are written by Spark's text writer, a record a row.  They are read by its text
reader, cut at blank lines, so large files are split and any store is reached.

A task does not know where the first record of its split begins, and payloads may hold
what looks like a record.  So each task emits every place that looks like a record's
begin, with the place where the next one would follow.  Within a split these pointers
are jumped until they leave it; across splits, jumping on from the start of the file
finds the one place at which each split is really entered.  A second pass reads each
split from there on, so a look-alike inside a payload is never a record.  Payloads
that go on in later splits are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerospark.llm.base import cut
from aerospark.scale import broadcast_if_small

BREAK = "\r\n\r\n"
#: Payloads from this size on are written once; equal ones refer to the first.
LEAST_REVISIT = 100
#: What every record carries as its date, so that archives depend on the pages alone.
DATE = "2024-01-01T00:00:00Z"
#: Splits whose entries may be broadcast.
BROADCAST_SPLITS = 50_000

_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?=\r\n|$)", re.IGNORECASE)

_SCANNED = "file string, block bigint, total bigint, at array<bigint>, leaves array<bigint>"
_READ = "file string, block bigint, kind int, offset bigint, need bigint, header binary, payload binary"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archives(
    pages: DataFrame, path: str, *, page_id: str = "page_id", payload: str = "html", uri: str | None = "url",
    least: int = LEAST_REVISIT, date: str = DATE,
) -> None:
    """A record for every row of ``pages``; the files are in folder ``path``.

    A null payload is empty.  Of rows with equal payloads of ``least`` bytes or more, that of
    the smallest id is a response and the others are revisits of it; all others are responses.
    Rows that share the smallest id are all responses, as are rows with a null id whose payload
    no row with an id has.  Line ends in the address become blanks.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("id"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"),
        F.octet_length(body).cast("bigint").alias("size"),
        (F.coalesce(F.col(uri).cast("string"), F.lit("")) if uri else F.lit("")).alias("uri"),
    )
    repeated = (
        rows.filter(F.col("size") >= least).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    )
    joined = rows.join(broadcast_if_small(cut(repeated)), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"), _field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", name(F.col("id"))), _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.regexp_replace("uri", "[\r\n]", " ")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(
            _field("WARC-Refers-To", name(F.col("first"))), _field("WARC-Payload-Length", F.col("size").cast("string")),
        )).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(again, F.lit("0")).otherwise(F.col("size").cast("string")), F.lit(BREAK),
        F.when(again, F.lit("")).otherwise(F.col("body")),
    )
    joined.select(record.alias("value")).write.option("lineSep", BREAK).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, value, size``: the archives cut at blank lines, in order within each split."""
    return spark.read.option("lineSep", BREAK).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_size").alias("size"),
    )


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, dict]]:
    """Split, bytes and the other columns of every piece, in order."""
    for part in batches:
        names = part.schema.names
        for row in zip(*(part.column(k).to_pylist() for k in range(part.num_columns))):
            own = dict(zip(names, row))
            yield (own.pop("file"), own.pop("block")), own.pop("value"), own


def jumped(at: np.ndarray, after: np.ndarray, end: int) -> np.ndarray:
    """Where the chain from each place leaves a split of ``end`` bytes; -1 if it breaks inside.

    ``at`` is in order.  Pointers are doubled until none stays inside.
    """
    to = after.copy()
    for _ in range(max(1, len(at)).bit_length() + 1):
        inside = (to >= 0) & (to < end)
        if not inside.any():
            break
        place = np.minimum(np.searchsorted(at, to), max(0, len(at) - 1))
        hit = inside & (at[place] == to)
        to = np.where(hit, to[place], np.where(inside, -1, to))
    return to


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: its bytes, places that look like records, and where their chains leave it."""
    split, total, at, after = None, 0, [], []

    def done() -> pa.RecordBatch:
        places = np.array(at, np.int64)
        leaves = jumped(places, np.array(after, np.int64), total)
        return pa.RecordBatch.from_pylist(
            [{"file": split[0], "block": split[1], "total": total, "at": at, "leaves": leaves.tolist()}],
            schema=pa.schema([
                ("file", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("at", pa.list_(pa.int64())),
                ("leaves", pa.list_(pa.int64())),
            ]),
        )

    for here, value, _ in _lines(batches):
        if here != split:
            if split is not None:
                yield done()
            split, total, at, after = here, 0, [], []
        for magic in _MAGIC.finditer(value):
            length = _LENGTH.search(value, magic.start())
            if length:
                at.append(total + magic.start())
                after.append(total + len(value) + 4 + int(length[1]) + 4)
        total += len(value) + 4
    if split is not None:
        yield done()


def entries(scanned: DataFrame) -> DataFrame:
    """``file, block, base, entry, covered``: where each split begins in its file and its first record does,
    and whether a record reaches beyond what comes before that.

    Pointers between splits are doubled in every round: places reached so far jump by them,
    and they are joined with themselves, so the rounds grow with the logarithm of the splits
    of a file.  ``entry`` is null where no record of the chain begins in a split.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = cut(scanned.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))))
    places = based.select(
        "file", "block", "base", F.explode(F.arrays_zip("at", "leaves")).alias("own")
    ).select(
        "file", (F.col("base") + F.col("own.at")).alias("at"),
        F.when(F.col("own.leaves") >= 0, F.col("base") + F.col("own.leaves")).alias("to"),
    )
    targets = places.select("file", F.col("to").alias("at")).filter(F.col("at").isNotNull()).distinct()
    # only places that a chain from another split reaches can be where a split is entered
    jumps = cut(places.join(targets, ["file", "at"], "left_semi").filter(F.col("to").isNotNull()))
    reached = cut(places.filter(F.col("at") == 0).select("file", "at", "to").distinct())
    known = reached.select("file", "at")
    front, n = reached.select("file", F.col("to").alias("at")).filter(F.col("at").isNotNull()), -1
    known = cut(known.unionByName(front).distinct())
    while (now := known.count()) != n:
        n = now
        step = known.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        known = cut(known.unionByName(step).distinct())
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("end"))
        jumps = cut(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("end").alias("to")))
    # the split in which each place lies: the last one that begins at or before it
    marks = based.select("file", F.col("base").alias("place"), "block").unionByName(
        known.select("file", F.col("at").alias("place"), F.lit(None).cast("bigint").alias("block"))
    )
    along = Window.partitionBy("file").orderBy("place", F.col("block").isNull())
    found = (
        marks.withColumn("own", F.last("block", ignorenulls=True).over(along)).filter(F.col("block").isNull())
        .groupBy("file", F.col("own").alias("block")).agg(F.min("place").alias("entry"), F.max("place").alias("last"))
    )
    ends = known.groupBy("file").agg(F.max("at").alias("end"))
    joined = based.select("file", "block", "base", "total").join(found, ["file", "block"], "left").join(ends, "file", "left")
    entry = F.when(F.col("entry") < F.col("base") + F.col("total"), F.col("entry"))
    return joined.select(
        "file", "block", "base", entry.alias("entry"),
        (entry.isNotNull() | F.coalesce(F.col("end") >= F.col("base") + F.col("total"), F.lit(False))).alias("covered"),
    )


class _Split:
    """One split of a file while its pieces are read from the entry on."""

    def __init__(self, key: tuple[str, int], base: int, entry: int | None, covered: bool, size: int):
        self.key, self.at, self.size, self.covered = key, base, size, covered
        self.next = entry  # where the next record begins; None: nowhere in this split
        self.entered, self.lead, self.parts = False, [], []
        self.header: bytes | None = None
        self.start = self.begin = self.stop = 0

    def take(self, value: bytes) -> tuple | None:
        """Read one piece; a record that it completes."""
        at, end = self.at, self.at + len(value) + len(BREAK)
        self.at = end
        if self.header is not None:
            self.parts.append((value + BREAK.encode())[: self.stop - at])
        elif self.next is not None and at <= self.next < at + len(value):
            if not self.entered:
                self.lead.append(value[: self.next - at])
            length = _LENGTH.search(value, self.next - at)
            self.entered, self.header, self.start = True, value[self.next - at:], self.next
            self.parts, self.begin, self.next = [], end, None
            self.stop = end + int(length[1]) if length else self.size + 1
        elif not self.entered and self.covered:
            self.lead.append(value + BREAK.encode())
        if self.header is None or end < self.stop:
            return None
        done = self._row(0)
        self.next, self.header = self.stop + len(BREAK), None
        return done

    def _row(self, kind: int) -> tuple | None:
        if kind != 1 and self.stop > self.size:
            return None  # cut short by the end of the file
        payload = b"".join(self.lead if kind == 1 else self.parts)
        return (*self.key, kind, self.start, self.stop - self.begin, self.header, payload)

    def close(self) -> Iterator[tuple]:
        if self.lead:
            yield (*self.key, 1, 0, 0, None, b"".join(self.lead))
        if self.header is not None and (row := self._row(2)):
            yield row


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (kind 0), begun ones (2), and what a split holds of one begun before it (1)."""
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("offset", pa.int64()),
        ("need", pa.int64()), ("header", pa.binary()), ("payload", pa.binary()),
    ])
    split, out, held = None, [], 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for key, value, own in _lines(batches):
        if split is None or key != split.key:
            if split is not None:
                out += split.close()
            if own["base"] is None:
                raise RuntimeError("the archives were split differently than in the first pass; read them again")
            split = _Split(key, own["base"], own["entry"], own["covered"], own["size"])
        if row := split.take(value):
            out.append(row)
            held += len(row[-1])
        if held > 8 << 20:
            yield batch_of(out)
            out, held = [], 0
    if split is not None:
        out += split.close()
    if out:
        yield batch_of(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, record_type, record_id, target_uri, refers_to, declared_digest, declared_bytes, payload``
    of every record that the boundary chain of its file reaches.

    A file must begin with a record; otherwise none of its records is read.  A record that
    the end of its file cuts short is left out.  ``declared_bytes`` is the payload length that
    a revisit carries for what it refers to.  An empty folder of archives gives no rows.
    """
    splits = cut(entries(cut(_pieces(spark, path).mapInArrow(_scan, _SCANNED))))
    pieces = _pieces(spark, path)
    if splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        placed = pieces.join(F.broadcast(splits), ["file", "block"], "left")
    else:
        order = F.monotonically_increasing_id()
        placed = pieces.withColumn("order", order).join(splits, ["file", "block"], "left").repartition(
            "file", "block"
        ).sortWithinPartitions("file", "block", "order").drop("order")
    found = cut(placed.select("file", "block", "value", "base", "entry", "covered", "size").mapInArrow(_records, _READ))
    # parts of records that go on in later splits: a few for each split
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.filter("kind > 0").withColumn(
        "of", F.when(F.col("kind") == 2, F.col("offset")).otherwise(
            F.last(F.when(F.col("kind") == 2, F.col("offset")), ignorenulls=True).over(order))
    ).filter(F.col("of").isNotNull())
    joined = parts.groupBy("file", F.col("of").alias("offset")).agg(
        F.max("need").alias("need"), F.max("header").alias("header"),
        F.array_sort(F.collect_list(F.struct("block", F.col("kind").alias("rank"), "payload"))).alias("parts"),
    )
    whole = F.aggregate(
        F.transform("parts", lambda p: p["payload"]), F.lit(b""), lambda a, b: F.concat(a, b)
    )
    joined = joined.withColumn("payload", whole).filter(F.octet_length("payload") >= F.col("need")).withColumn(
        "payload", F.expr("substring(payload, 1, CAST(need AS INT))")
    )
    columns = ["file", "offset", "header", "payload"]
    records = found.filter("kind = 0").select(*columns).unionByName(joined.select(*columns))
    text = F.concat(F.lit("\r\n"), F.decode("header", "ISO-8859-1"), F.lit("\r\n"))

    def field(name: str, pattern: str = "([^\r\n]*)") -> Column:
        value = F.regexp_extract(text, f"(?i)\r\n{name}:[ \t]*{pattern}", 1)
        return F.when(value != "", value)

    return records.select(
        "file", "offset", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"),
        field("WARC-Target-URI").alias("target_uri"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest").alias("declared_digest"),
        field("WARC-Payload-Length", "([0-9]+)").cast("bigint").alias("declared_bytes"), "payload",
    )
