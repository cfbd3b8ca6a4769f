"""Language-model scoring with a hashed, class-factored maximum-entropy model.

The probability of a word is that of its band given the context, times that of its
group in the band given the context, times its share of the group:

* A band holds words of about equal frequency; all bands have about equal mass.
* A group is an alphabetical range of a band.
* Band and group are softmax outputs over hashed features of the context: the word
  before, the word before that (a skip), the class of either, the classes of both, and
  the class of the word before with that of the third word back (a skip).  Every word of
  a context counts as itself; its class says what its own row has not learned yet.

Texts are cut to blocks of bounded size, in which a word is a number into the block's
own list of words.  The lists meet the counts of the whole corpus in a join on the
word, so no task ever holds all words, and no document is joined word by word.  A word
is known by a 64-bit hash of its bytes.

The rows of weights grow with the root of the counted vocabulary.  Training goes over all training tokens once, in
rounds: each task runs gradient steps over its blocks from the shared weights, and
the changes are averaged by how often a row of weights was used.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.llm.base import LOWER, SPACED, cut, mix, released, slices, words_of
from aerospark.scale import work_path

#: Text of a block, in bytes; a longer document is a block of its own.
BLOCK_BYTES = 24 << 20
BANDS = GROUPS = 16
#: Least rows of weights of each kind of features, and rows for each root of a distinct word.
ROWS = 1 << 13
ROWS_A_ROOT = 8
KINDS = 6
ROUNDS = 3
BATCH = 8192
RATE = 0.35
#: Bytes of a word that place it in alphabetical order.
HEAD = 6
#: Rows of weights that travel together when changes are averaged.
CHUNK = 1024
_DISPERSE = 8
#: Tokens whose contexts are worked out at a time.
SEGMENT = 1 << 18

_BLOCK = (
    "block bigint, doc_id array<bigint>, train array<boolean>, ends array<bigint>, tokens binary, "
    "codes array<bigint>, heads array<bigint>, counts array<bigint>"
)
#: The code of the end of a text; no word has it but by chance.
_END = np.uint64(0x5851F42D4C957F2D)


class Classes(NamedTuple):
    """How words fall into bands and groups, and the size of each group."""

    least: np.ndarray  # of each band but the last: the least frequency bin
    cuts: np.ndarray  # of each band: the heads at which its groups begin, after the first
    mass: np.ndarray  # tokens of each group
    types: np.ndarray  # distinct words of each group
    tokens: int
    vocabulary: int


class Weights(NamedTuple):
    """Rows of features by outputs, for bands and for groups, and the outputs' own weights."""

    band: np.ndarray
    group: np.ndarray
    band_bias: np.ndarray
    group_bias: np.ndarray


class _Words(NamedTuple):
    """The tokens of some texts: places in a list of distinct words, and that list."""

    token: np.ndarray
    size: np.ndarray  # tokens of each text
    code: np.ndarray
    head: np.ndarray


def heads_of(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first bytes of words as numbers that order like them."""
    out = np.zeros(len(start), np.int64)
    for k in range(HEAD):
        byte = LOWER[data[np.minimum(start + k, len(data) - 1)]].astype(np.int64)
        out = (out << 8) | np.where(start + k < stop, byte, 0)
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> _Words:
    """Lowers A-Z, cuts at ASCII white space only, and ends every text with the end token."""
    found, rows = words_of(data, offsets, SPACED), len(offsets) - 1
    size = np.bincount(found.row, minlength=rows)
    ends = np.cumsum(size)
    code, first, token = np.unique(np.insert(found.code, ends, _END), return_index=True, return_inverse=True)
    start, stop = np.insert(found.start, ends, 0)[first], np.insert(found.stop, ends, 0)[first]
    return _Words(token.astype(np.uint32), size + 1, code, heads_of(data, start, stop) if len(data) else np.zeros(len(code), np.int64))


def packed(tokens: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, the lowest first, compressed: the higher planes are nearly empty."""
    planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    """The ``n`` numbers that ``packed`` took."""
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(docs: DataFrame, train: Column, doc_id: str, text: str) -> DataFrame:
    """Blocks of documents: their tokens as numbers into the block's words, and training counts of those."""
    schema = pa.schema([
        ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())),
        ("ends", pa.list_(pa.int64())), ("tokens", pa.binary()),
        *[(name, pa.list_(pa.int64())) for name in ("codes", "heads", "counts")],
    ])

    def done(block: int, ids: list, marks: list, parts: list[_Words]) -> pa.RecordBatch:
        code, first, place = np.unique(np.concatenate([p.code for p in parts]), return_index=True, return_inverse=True)
        begins = np.cumsum([0] + [len(p.code) for p in parts])
        place = place.astype(np.uint32)
        tokens = np.concatenate([place[a: b][p.token] for p, a, b in zip(parts, begins[:-1], begins[1:])])
        size = np.concatenate([p.size for p in parts])
        # frequent words get small numbers, which take less room
        order = np.argsort(-np.bincount(tokens, minlength=len(code)), kind="stable")
        rank = np.empty(len(code), np.uint32)
        rank[order] = np.arange(len(code), dtype=np.uint32)
        tokens, code, first = rank[tokens], code[order], first[order]
        count = np.bincount(tokens[np.repeat(np.array(marks, bool), size)], minlength=len(code))
        head = np.concatenate([p.head for p in parts])[first]
        return pa.RecordBatch.from_arrays([
            pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.bool_())),
            pa.array([np.cumsum(size)], pa.list_(pa.int64())), pa.array([packed(tokens)], pa.binary()),
            *[pa.array([values], pa.list_(pa.int64())) for values in (code.view(np.int64), head, count)],
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, marks, parts, held = TaskContext.get().partitionId() << 24, [], [], [], 0
        for part in batches:
            for a, b, data, offsets in slices(part.column(1)):
                if ids and held + len(data) > BLOCK_BYTES:
                    yield done(block, ids, marks, parts)
                    block, ids, marks, parts, held = block + 1, [], [], [], 0
                parts.append(_words(data, offsets))
                ids += part.column(0).slice(a, b - a).to_pylist()
                marks += part.column(2).slice(a, b - a).to_pylist()
                held += len(data)
        if ids:
            yield done(block, ids, marks, parts)

    return docs.select(
        F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit("")), F.coalesce(train, F.lit(False))
    ).mapInArrow(released(run), _BLOCK)


def _bin(count: Column) -> Column:
    return F.floor(8 * F.log2(count)).cast("int")


def _classes(vocabulary: DataFrame) -> tuple[Classes, DataFrame]:
    """Bands and groups from ``codes, head, count``; the vocabulary with ``leaf``, the number of its group.

    A word that no training text holds (count 0) falls in the rarest band.
    """
    seen = vocabulary.filter(F.col("count") > 0)
    bins = seen.groupBy(_bin(F.col("count")).alias("bin")).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v"))
    table = sorted((r["bin"], r["n"], r["v"]) for r in bins.collect())  # 8 bins for each doubling of a count
    tokens, types = sum(r[1] for r in table), sum(r[2] for r in table)
    least, below = [], 0
    for bin_, n, _ in reversed(table):
        below += n
        if len(least) < BANDS - 1 and below * BANDS >= (len(least) + 1) * tokens:
            least.append(bin_)
            while len(least) < BANDS - 1 and below * BANDS >= (len(least) + 1) * tokens:
                least.append(bin_)
    least += [0] * (BANDS - 1 - len(least))
    band = sum(((_bin(F.col("count")) < at).cast("int") for at in least), F.lit(0))
    placed = vocabulary.withColumn("band", F.when(F.col("count") > 0, band).otherwise(BANDS - 1))
    shares = [k / GROUPS for k in range(1, GROUPS)]
    cuts = np.zeros((BANDS, GROUPS - 1), np.int64)
    found = placed.filter(F.col("count") > 0).groupBy("band").agg(F.percentile_approx("head", shares, 5000).alias("cuts"))
    for row in found.collect():  # a row for each band
        cuts[row["band"]] = row["cuts"]
    table = F.array(*[F.array(*[F.lit(int(c)) for c in own]) for own in cuts])
    group = F.size(F.filter(table[F.col("band")], lambda c: c <= F.col("head")))
    placed = placed.withColumn("leaf", (F.col("band") * GROUPS + group).cast("int")).drop("band", "head")
    mass, kinds = np.zeros(BANDS * GROUPS), np.zeros(BANDS * GROUPS)
    for row in placed.groupBy("leaf").agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v")).collect():
        mass[row["leaf"]], kinds[row["leaf"]] = row["n"], row["v"]
    return Classes(np.array(least), cuts, mass, kinds, int(tokens), int(types)), placed


def rows_for(vocabulary: int) -> int:
    """A power of two."""
    return max(ROWS, 1 << int(np.ceil(np.log2(max(1.0, ROWS_A_ROOT * vocabulary ** 0.5)))))


def start_weights(classes: Classes) -> Weights:
    mass = classes.mass.reshape(BANDS, GROUPS) + 1.0
    size = KINDS * rows_for(classes.vocabulary)
    return Weights(
        np.zeros((size, BANDS), np.float32), np.zeros((size, GROUPS), np.float32),
        np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32),
        np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32),
    )


def context_rows(code: np.ndarray, leaf: np.ndarray, begins: np.ndarray, size: int | None = None) -> np.ndarray:
    """``KINDS`` by tokens: the hashed features of every token's context; a text begins with blanks.

    ``size`` is the number of rows of a kind.
    """
    n, size = len(code), size or ROWS
    place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    shifted = []
    for values, k in ((code, 1), (code, 2), (leaf, 1), (leaf, 2), (leaf, 3)):
        own = np.zeros(n, np.uint64)
        own[k:] = values[: n - k].astype(np.uint64) + np.uint64(1)
        own[place < k] = 0
        shifted.append(own)
    first, skip, near, second, third = shifted
    each = (first, skip, second * np.uint64(1024) + near, third * np.uint64(1024) + near, near, second)
    top = np.uint64(64 - (size.bit_length() - 1))
    return np.stack([
        (mix(value * np.uint64(KINDS) + np.uint64(k)) >> top).astype(np.int32) + k * size for k, value in enumerate(each)
    ])


def _with_band(rows: np.ndarray, band: np.ndarray, size: int) -> np.ndarray:
    """The rows of the group weights: the feature together with the band."""
    return (rows & ~(size - 1)) | ((rows * 31 + band * 1297) & (size - 1))


def _scores(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    score = table.take(rows[0], axis=0)
    for own in rows[1:]:
        score += table.take(own, axis=0)
    return score


def _softmax(score: np.ndarray) -> np.ndarray:
    """Worked out with an output a line, since there are few outputs and many tokens."""
    score = np.ascontiguousarray(score.T)
    score -= score.max(axis=0)
    np.exp(score, out=score)
    score /= score.sum(axis=0)
    return score.T


def probabilities(rows: np.ndarray, band: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Softmax over bands, and over the groups of the given band, of each token."""
    over_bands = _scores(weights.band, rows) + weights.band_bias
    over_groups = _scores(weights.group, _with_band(rows, band, len(weights.group) // KINDS)) + weights.group_bias[band]
    return _softmax(over_bands), _softmax(over_groups)


def descend(
    rows: np.ndarray, leaf: np.ndarray, weights: Weights, spent: list[np.ndarray], used: np.ndarray | None = None
) -> None:
    """One gradient step over a batch; ``spent`` holds what each row of weights has moved so far."""
    band, group, size = leaf // GROUPS, leaf % GROUPS, len(weights.band) // KINDS
    every, rank = np.arange(len(leaf)), np.zeros(size, np.int64)
    for k, (table, wrong, own, place) in enumerate(zip(
        (weights.band, weights.group), probabilities(rows, band, weights), (band, group), (rows, _with_band(rows, band, size)),
    )):
        wrong[every, own] -= 1
        outputs = np.ascontiguousarray(wrong.T, float)
        for kind, own_rows in enumerate(place):
            at = own_rows.astype(np.int64) - kind * size
            n = np.bincount(at, minlength=size)
            hit = np.flatnonzero(n)
            rank[hit] = np.arange(len(hit))
            at = rank[at]
            slope = np.empty((len(outputs), len(hit)), np.float32)
            for o, sums in zip(outputs, slope):
                sums[:] = np.bincount(at, o, len(hit))
            row = hit + kind * size
            spent[k][row] += (slope * slope).mean(axis=0)
            slope *= RATE / np.sqrt(spent[k][row] + 1)
            table[row] -= slope.T
            if used is not None:
                used[k, row] += n[hit]


class Block(NamedTuple):
    """Texts as the model sees them, and what the counts alone say of each."""

    doc_id: list
    train: np.ndarray
    ends: np.ndarray
    token: np.ndarray  # places in the block's words
    leaf: np.ndarray  # of each word
    context: np.ndarray  # what each word is in the contexts of later ones


def _coded(batches: Iterator[pa.RecordBatch], classes: Classes) -> Iterator[pa.RecordBatch]:
    """Blocks with a class and a context code for every word, and the sums that need no weights."""
    for part in batches:
        column = {name: part.column(k) for k, name in enumerate(part.schema.names)}
        for at in range(part.num_rows):
            ends = column["ends"][at].values.to_numpy()
            known, token = column["known"][at].values, unpacked(column["tokens"][at].as_buffer(), int(ends[-1]))
            place, packed = known.field("place").to_numpy(), known.field("packed").to_numpy()
            count, leaf, context = (np.zeros(len(place), np.int64) for _ in range(3))
            count[place], leaf[place], context[place] = packed >> 8, packed & 255, known.field("context").to_numpy()
            base = np.log10((count + 0.5) / (classes.tokens + 0.5 * (classes.vocabulary + 1)))
            inside = np.log((count + 0.5) / (classes.mass + 0.5 * (classes.types + 1))[leaf])
            begins = np.append(0, ends[:-1])
            sums = [np.add.reduceat(v[token], begins) for v in ((count > 0).astype(np.int64), base, inside)]
            yield pa.RecordBatch.from_arrays([
                column["round"].slice(at, 1), column["doc_id"].slice(at, 1), column["train"].slice(at, 1),
                column["ends"].slice(at, 1), column["tokens"].slice(at, 1),
                pa.array([leaf.astype(np.uint8).tobytes()], pa.binary()), pa.array([context.astype("<u4").tobytes()], pa.binary()),
                pa.array([sums[0]], pa.list_(pa.int64())), *[pa.array([v], pa.list_(pa.float64())) for v in sums[1:]],
            ], names=["round", "doc_id", "train", "ends", "tokens", "leaf", "context", "n_known", "base", "inside"])


_CODED = (
    "round int, doc_id array<bigint>, train array<boolean>, ends array<bigint>, tokens binary, leaf binary, "
    "context binary, n_known array<bigint>, base array<double>, inside array<double>"
)


def _read(part: pa.RecordBatch, at: int) -> Block:
    column = {name: part.column(k) for k, name in enumerate(part.schema.names)}
    ends = column["ends"][at].values.to_numpy()
    return Block(
        column["doc_id"][at].as_py(), np.array(column["train"][at].as_py(), bool), ends,
        unpacked(column["tokens"][at].as_buffer(), int(ends[-1])),
        np.frombuffer(column["leaf"][at].as_buffer(), np.uint8), np.frombuffer(column["context"][at].as_buffer(), "<u4"),
    )


def _segments(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts, first and last + 1, of about ``SEGMENT`` tokens or one text."""
    at = 0
    while at < len(ends):
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + SEGMENT, side="right")))
        yield at, to
        at = to


def _changes(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    """Gradient steps over the training texts of a task's blocks; what they changed, by chunk of rows."""
    band, group = weights.band.copy(), weights.group.copy()
    own = weights._replace(band=band, group=group)
    size = len(band)
    spent = [np.zeros(size, np.float32) for _ in range(2)]
    used = np.zeros((2, size), np.float32)
    for part in batches:
        for at in range(part.num_rows):
            block = _read(part, at)
            length = np.diff(block.ends, prepend=0)
            token, ends = block.token[np.repeat(block.train, length)], np.cumsum(length[block.train])
            for first, last in _segments(ends):
                lo, hi = ends[first - 1] if first else 0, ends[last - 1]
                begins = np.append(lo, ends[first: last - 1]) - lo
                leaf = block.leaf[token[lo:hi]].astype(np.int64)
                rows = context_rows(block.context[token[lo:hi]], leaf, begins, size // KINDS)
                for a in range(0, hi - lo, BATCH):
                    b = min(a + BATCH, hi - lo)
                    descend(rows[:, a:b], leaf[a:b], own, spent, used)
    task = TaskContext.get().partitionId() % _DISPERSE
    for k, (new, old) in enumerate(((band, weights.band), (group, weights.group))):
        for a in range(0, size, CHUNK):
            part_used = used[k, a: a + CHUNK]
            if part_used.any():
                change = (new[a: a + CHUNK] - old[a: a + CHUNK]) * part_used[:, None]
                yield _chunk(k * size + a, task, part_used, change)


_CHANGE = "chunk bigint, task int, used binary, change binary"


def _chunk(at: int, task: int, used: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([at], pa.int64()), pa.array([task], pa.int32()),
        pa.array([used.astype(np.float32).tobytes()], pa.binary()), pa.array([change.astype(np.float32).tobytes()], pa.binary()),
    ], names=["chunk", "task", "used", "change"])


def _added(changes: DataFrame, keys: list[str]) -> DataFrame:
    def add(group: pa.Table) -> pa.Table:
        used = sum(np.frombuffer(v.as_py(), np.float32).astype(float) for v in group["used"])
        change = sum(np.frombuffer(v.as_py(), np.float32).astype(float) for v in group["change"])
        return pa.Table.from_batches([_chunk(group["chunk"][0].as_py(), group["task"][0].as_py(), used, change)])

    return changes.groupBy(*keys).applyInArrow(add, _CHANGE)


def _trained(blocks: DataFrame, classes: Classes) -> Weights:
    spark, weights = blocks.sparkSession, start_weights(classes)
    size = len(weights.band)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)  # 2 * KINDS * rows * 16 numbers
        own = blocks.filter(F.col("round") == k).select(
            "doc_id", "train", "ends", "tokens", "leaf", "context"
        ).mapInArrow(lambda batches, shared=shared: _changes(batches, shared.value), _CHANGE)
        # tasks are added in groups first, so no group grows with the number of tasks alone
        added = _added(_added(own, ["chunk", "task"]), ["chunk"])
        band, group = weights.band.copy(), weights.group.copy()
        for row in added.collect():  # as large as the weights
            table, at = (band, row["chunk"]) if row["chunk"] < size else (group, row["chunk"] - size)
            used = np.frombuffer(row["used"], np.float32)
            change = np.frombuffer(row["change"], np.float32).reshape(CHUNK, -1)
            table[at: at + CHUNK] += change / np.maximum(used, 1)[:, None]
        weights = weights._replace(band=band, group=group)
        shared.unpersist()
    return weights


def model_scores(block: Block, weights: Weights) -> np.ndarray:
    """The natural logarithm of the probability of the bands and groups of each text."""
    out = np.zeros(len(block.ends))
    for first, last in _segments(block.ends):
        lo, hi = block.ends[first - 1] if first else 0, block.ends[last - 1]
        begins = np.append(lo, block.ends[first: last - 1]) - lo
        token = block.token[lo:hi]
        leaf, model = block.leaf[token].astype(np.int64), np.zeros(hi - lo)
        rows = context_rows(block.context[token], leaf, begins, len(weights.band) // KINDS)
        for a in range(0, hi - lo, BATCH):
            b = min(a + BATCH, hi - lo)
            every, own = np.arange(b - a), leaf[a:b]
            of_band, of_group = probabilities(rows[:, a:b], own // GROUPS, weights)
            model[a:b] = np.log(np.maximum(of_band[every, own // GROUPS], 1e-30).astype(float))
            model[a:b] += np.log(np.maximum(of_group[every, own % GROUPS], 1e-30).astype(float))
        out[first:last] = np.add.reduceat(model, begins)  # every text has its end
    return out


def score_texts(
    docs: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Learns from the rows where ``train`` (a condition over ``docs``) holds, and scores all of
    them.  Words are cut at ASCII white space with A-Z lowered; every text ends in an end
    token, so an empty or null text has one token.  ``base_score`` is the log10 probability
    under smoothed counts, ``score`` that under the model, whose probabilities of all words and
    of one unknown word in each group of the rarest band add up to one.  Without training
    texts every count is zero.  Repeated rows and null ids are texts like others.
    """
    spark = docs.sparkSession
    raw = cut(_blocks(docs, train, doc_id, text))
    words = raw.select(
        "block", F.posexplode(F.arrays_zip("codes", "heads", "counts")).alias("place", "own")
    ).select("block", "place", "own.*")
    vocabulary = cut(words.groupBy("codes").agg(F.sum("counts").alias("count"), F.max("heads").alias("head")))
    classes, placed = _classes(vocabulary)
    # one number for the count and the group of a word
    packed = F.shiftleft(F.col("count"), 8) + F.col("leaf")
    context = F.shiftrightunsigned("codes", 32).cast("bigint").bitwiseAND(0x7FFFFFFF).cast("int").alias("context")
    known = (
        words.select("block", "place", "codes").join(placed.select("codes", packed.alias("packed")), "codes")
        .groupBy("block").agg(F.collect_list(F.struct("place", "packed", context)).alias("known"))
    )
    # a row a block on either side
    joined = raw.select("block", "doc_id", "train", "ends", "tokens").join(known, "block").withColumn(
        "round", F.pmod(F.xxhash64("block"), F.lit(ROUNDS)).cast("int")
    ).drop("block")
    path = work_path(spark, "blocks")
    coded = joined.mapInArrow(lambda batches: _coded(batches, classes), _CODED)
    coded.write.option("compression", "zstd").partitionBy("round").parquet(path)
    blocks = spark.read.schema(_CODED).parquet(path)
    weights = _trained(blocks, classes)
    shared = spark.sparkContext.broadcast(weights)
    made = (
        "doc_id bigint, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    names = [field.split()[0] for field in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_weights = shared.value
        for part in batches:
            sums = {name: part.column(part.schema.names.index(name)) for name in ("n_known", "base", "inside")}
            for at in range(part.num_rows):
                block = _read(part, at)
                n_known, base, inside = (sums[name][at].values.to_numpy() for name in ("n_known", "base", "inside"))
                model = (model_scores(block, own_weights) + inside) / np.log(10)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.doc_id, pa.int64()), pa.array(block.train), pa.array(np.diff(block.ends, prepend=0)),
                    pa.array(n_known), pa.array(np.full(len(base), classes.tokens, np.int64)), pa.array(base), pa.array(model),
                ], names=names)

    return blocks.drop("round").mapInArrow(run, made)
