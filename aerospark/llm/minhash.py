"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Two permutations of a universe of ``2 ** BITS`` positions give all coordinates of a
signature: the first places the shingles, the second is shifted by one position
for each further coordinate.  The values that a shingle adds to all coordinates lie
side by side, so a signature is the minimum over a few contiguous rows.

Documents with equal shingle sets form a class and go on as one.  Classes that share
a band are candidates: in a small bucket all of its pairs, thinned out by their
signatures.  Large buckets are joined to families, in which blocks of full sets are
compared by a product of incidence matrices and only links that span a block pair go
on.  Every link is confirmed on full sets.  Components of the links follow.

For a pair at the threshold the chance to share no band is below 1e-6 at 0.85 (24
bands of 5) and at 0.8 (30 bands of 4).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.llm.base import BASE, SPACED, batch, cut, lists, mix, released, shingles, slices, words_of
from aerospark.operators.components import connected_components
from aerospark.scale import broadcast_if_small

BITS = 20
COORDINATES = 120
#: Buckets of at most so many classes give all of their pairs.
PAIRED = 24
#: Rows of a block of a family.
BLOCK = 256
#: A pair whose signatures agree in less than this much below the threshold is no candidate:
#: over five standard deviations of an estimate from ``COORDINATES``.
MARGIN = 0.18

_SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary, bands array<bigint>"


@lru_cache(maxsize=1)
def _second(seed: int = 5) -> np.ndarray:
    """Row p: the shifted permutation's values at position p, one for each coordinate."""
    order = np.random.default_rng(seed).permutation(1 << BITS).astype(np.uint32)
    wrapped = np.concatenate([order, order[:COORDINATES]])
    return np.lib.stride_tricks.sliding_window_view(wrapped, COORDINATES)


def signature(codes: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set of 64-bit shingle codes."""
    place = (codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
    rows = _second()
    out = np.full(COORDINATES, 1 << BITS, np.uint32)
    for at in range(0, len(place), 2048):
        np.minimum(out, rows[place[at: at + 2048]].min(axis=0), out=out)
    return out


def band_count(threshold: float) -> int:
    return 24 if threshold >= 0.85 else 30


def _bands(signatures: np.ndarray, bands: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, -1).astype(np.uint64)
    code = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
    for k in range(parts.shape[2]):
        code = mix(code * np.uint64(BASE) + parts[:, :, k])
    return code.view(np.int64)


def sketches(docs: DataFrame, *, doc_id: str, text: str, length: int, threshold: float) -> DataFrame:
    """Size, identity, short signature and band keys of the shingle set of every document."""
    bands = band_count(threshold)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
        ("signature", pa.binary()), ("bands", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for a, b, data, offsets in slices(part.column(1)):
                sizes, first, second, short, keys = [], [], [], [], []
                for codes in shingles(words_of(data, offsets, SPACED), b - a, length):
                    sizes.append(len(codes))
                    own_a, own_b = _identity(codes)
                    first.append(own_a)
                    second.append(own_b)
                    if len(codes):
                        own = signature(codes)
                        short.append((own & 255).astype(np.uint8).tobytes())
                        keys.append(_bands(own[None, :], bands)[0])
                    else:
                        short.append(b"")
                        keys.append(np.empty(0, np.int64))
                yield batch(
                    schema, part.column(0).slice(a, b - a), sizes, first, second, short, lists(keys, pa.int64())
                )

    return docs.select(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(released(run), _SKETCH)


def _identity(codes: np.ndarray) -> tuple[int, int]:
    """Two sums over spread codes, which stand for a set."""
    return int(codes.sum().view(np.int64)), int(mix(codes ^ np.uint64(BASE)).sum().view(np.int64))


def _class() -> Column:
    """The name of a class of equal sets, from its size and its identity alone."""
    return F.xxhash64("n_shingles", "set_a", "set_b").alias("class")


def shingle_sets(docs: DataFrame, *, length: int) -> DataFrame:
    """``class, codes`` from a column of texts: the class of every document and its full set."""
    schema = pa.schema([
        ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("codes", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for a, b, data, offsets in slices(part.column(0)):
                sets = list(shingles(words_of(data, offsets, SPACED), b - a, length))
                first, second = zip(*map(_identity, sets))
                yield batch(
                    schema, [len(s) for s in sets], first, second, lists([s.view(np.int64) for s in sets], pa.int64())
                )

    found = docs.mapInArrow(released(run), "n_shingles bigint, set_a bigint, set_b bigint, codes array<bigint>")
    return found.select(_class(), "codes")


def _similar(shared: Column, left: Column, right: Column, percent: int) -> Column:
    return 100 * shared >= percent * (left + right - shared)


def _small_pairs(members: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: pairs of small buckets whose signatures agree enough."""
    buckets = members.groupBy("key").agg(F.sort_array(F.collect_set("class")).alias("ids"))
    pairs = (
        buckets.select(F.posexplode("ids").alias("at", "a"), "ids")
        .select("a", F.explode(F.slice("ids", F.col("at") + 2, PAIRED)).alias("b")).distinct()
    )
    short = keyed.select("class", "signature")

    @F.arrow_udf("double")
    def agreement(left: pa.Array, right: pa.Array) -> pa.Array:
        sides = [np.frombuffer(b"".join(side.to_pylist()), np.uint8).reshape(len(side), -1) for side in (left, right)]
        return pa.array((sides[0] == sides[1]).mean(axis=1))

    both = pairs.join(short.toDF("a", "sig_a"), "a").join(short.toDF("b", "sig_b"), "b")
    return both.filter(agreement("sig_a", "sig_b") >= threshold - MARGIN).select("a", "b")


def links_of_blocks(left: list[np.ndarray], right: list[np.ndarray], percent: int, width: int = 4096) -> np.ndarray:
    """Boolean matrix: which sets of ``left`` and ``right`` are similar enough."""
    sizes = [np.array([len(s) for s in side], np.float32) for side in (left, right)]
    codes = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes).astype(np.int64))
    values, place, count = np.unique(codes, return_inverse=True, return_counts=True)
    common = count > 1  # a code of one set alone is in no intersection
    rank = np.cumsum(common) - 1
    keep = common[place]
    place, owner = rank[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(common.sum()), width):
        a, b = np.searchsorted(place, [at, at + width])
        grid = np.zeros((len(left) + len(right), width), np.float32)
        grid[owner[a:b], place[a:b] - at] = 1
        shared += grid[: len(left)] @ grid[len(left):].T
    return 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)


def spanning(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep the components of a symmetric boolean matrix: each row to the least id it reaches."""
    root = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    seen = np.zeros(len(ids), bool)
    out = []
    for k in order:
        if seen[k]:
            continue
        seen[k] = True
        front = [k]
        while front:
            near = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[near] = True
            root[near] = k
            front = near.tolist()
    for k in range(len(ids)):
        if root[k] != k:
            out.append((int(ids[root[k]]), int(ids[k])))
    return out


def _family_links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that span the similar pairs of every family (``class, family``).

    A family is cut into blocks by hash; each pair of blocks is one group of at most
    about two blocks of rows.  A member goes to as many groups as its family has blocks.
    """
    sized = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = families.join(sized, "family").withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "class", "family", "mine",
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
    )
    rows = spread.join(sets, "class").select("family", "i", "j", "mine", "class", "codes")

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("class")
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        ids, column = group["class"].to_numpy(), group["codes"].combine_chunks()
        ends = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        codes = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        if i == j:
            linked = links_of_blocks(codes, codes, percent)
        else:
            mine = group["mine"].to_numpy()
            here, there = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            linked = np.zeros((len(ids), len(ids)), bool)
            if len(here) and len(there):
                across = links_of_blocks([codes[k] for k in here], [codes[k] for k in there], percent)
                linked[np.ix_(here, there)] = across
                linked |= linked.T
        found = np.array(spanning(linked, ids), np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

    return rows.groupBy("family", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    A document's set are its distinct ``length``-word shingles (A-Z lowered, words cut
    at ASCII white space), or its whole word sequence if it has fewer words.  Documents
    with a Jaccard similarity of at least ``threshold`` (whole percents) are linked;
    ``component_id`` is the least id of the documents reachable by links, ``kept`` tells
    whether it is the document's own.  A document without words or with a null text has
    an empty set and is linked with nothing.  A null id is linked with nothing, has a
    null component and is kept.  Rows with an equal id are one document if their texts
    have equal sets, else linked through their id.  Every row of ``docs`` gives one row.
    """
    percent = round(threshold * 100)
    sketched = cut(
        sketches(docs, doc_id=doc_id, text=text, length=length, threshold=threshold).select("*", _class())
    )
    usable = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # one row a class of equal sets; ids may repeat, so a class is not named by one
    classes = cut(
        usable.groupBy("class")
        .agg(F.min("doc_id").alias("least"), F.min_by("signature", "doc_id").alias("signature"),
             F.min_by("bands", "doc_id").alias("bands"))
    )
    rows = classes.select(F.explode("bands").alias("key"), "class")
    sized = cut(
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("first")).filter("n > 1")
    )
    members = cut(rows.join(sized, "key"))
    pairs = cut(_small_pairs(members.filter(F.col("n") <= PAIRED), classes, percent / 100))
    large = members.filter(F.col("n") > PAIRED)
    inside = large.select(F.col("class").alias("node")).distinct()
    families = cut(
        connected_components(inside, large.select(F.col("first").alias("a"), F.col("class").alias("b")), cut)
        .select(F.col("node").alias("class"), F.col("component").alias("family"))
    )
    compared = (
        pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))
        .unionByName(families.select("class")).distinct()
    )
    needed = cut(classes.select("class", "least").join(compared, "class", "left_semi"))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("least"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wanted = texts.join(broadcast_if_small(needed.select("least").distinct()), "least", "left_semi").select("text")
    # another row of a needed id may belong to a class that is not needed, or bring its class twice
    found_sets = shingle_sets(wanted, length=length).join(broadcast_if_small(needed.select("class")), "class", "left_semi")
    sets = cut(found_sets.dropDuplicates(["class"]))
    shared = F.size(F.array_intersect("codes_a", "codes_b"))
    confirmed = (
        pairs.join(sets.toDF("a", "codes_a"), "a").join(sets.toDF("b", "codes_b"), "b")
        .filter(_similar(shared, F.size("codes_a"), F.size("codes_b"), percent)).select("a", "b")
    )
    links = confirmed.unionByName(_family_links(families, sets, percent))
    # rows of one id with different sets hang together through the id
    of_id = usable.select("doc_id", "class").distinct()
    several = of_id.groupBy("doc_id").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = links.unionByName(of_id.join(several, "doc_id").select("a", F.col("class").alias("b")))
    grouped = cut(
        connected_components(classes.select(F.col("class").alias("node")), links, cut)
        .select(F.col("node").alias("class"), "component").join(classes.select("class", "least"), "class")
    )
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    found = grouped.join(named, "component").select("class", "component_id")
    # equal sets can be a third of all rows: joined to one row of each class
    out = sketched.select("doc_id", "n_shingles", "class").join(found, "class", "left")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(known, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one_of_each(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """``docs`` without the near-duplicates of a document of a smaller id; all columns stay."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, length=length, threshold=threshold)
    gone = cut(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct())
    small = broadcast_if_small(gone)
    return docs.join(small, docs[doc_id] == small["_gone"], "left_anti")
