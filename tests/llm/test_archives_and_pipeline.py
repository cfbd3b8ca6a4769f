"""Archives by exact round trips, and the pipeline against its stages by brute force."""

import collections
import random

import corpus_pipeline
import pytest

from aerospark.llm import warc
from aerospark.llm.queries import QUERIES
from aerospark.scale import work_path

BITS = ["\r\n", "\r", "\n", "\r\n\r\n", "WARC/1.0\r\n", "WARC/1.0\r\nContent-Length: 7\r\n\r\n", "Content-Length: 3\r\n", "a", "é", "xyz "]


def payloads():
    rnd = random.Random(4)
    rows = [(k, "".join(rnd.choice(BITS) for _ in range(rnd.choice([0, 1, 2, 5, 30])))) for k in range(40)]
    fake = "q" * 500 + "\r\n\r\n" + "WARC/1.0\r\nContent-Length: 100\r\n\r\n" * 9
    rows += [(300, None), (301, "x" * 150), (302, "x" * 150), (303, "y" * 99), (304, "y" * 99), (305, "\r\n" * 60), (306, fake), (299, "x" * 150)]
    return rows


def check(got, rows):
    first = {}
    for key, text in sorted(rows):
        first.setdefault(text or "", key)
    by = {r["record_id"]: r for r in got}
    assert len(got) == len(rows)
    for key, text in rows:
        text, r = text or "", by[f"<urn:page:{key}>"]
        if len(text.encode()) >= 100 and first[text] != key:
            assert (r["record_type"], r["refers_to"]) == ("revisit", f"<urn:page:{first[text]}>")
            assert r["declared_bytes"] == len(text.encode()) and not r["payload"]
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, text.encode())


@pytest.fixture
def split_size(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def put(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if size != before else "4m")

    yield put
    put(before)


@pytest.mark.parametrize("size, broadcast", [("16m", 50_000), ("401b", 50_000), ("1003b", 1)])
def test_round_trip_over_splits(spark, split_size, monkeypatch, size, broadcast):
    rows = payloads()
    path = work_path(spark, "archives")
    table = spark.createDataFrame([(k, h, "http://a\r\nb", 1) for k, h in rows], "page_id bigint, html string, url string, file int")
    warc.write_archives(table.coalesce(2), path)
    monkeypatch.setattr(warc, "BROADCAST_SPLITS", broadcast)
    split_size(size)
    found = warc.read_archives(spark, path).collect()
    check(found, rows)
    assert {r["target_uri"] for r in found} == {"http://a  b"}


def test_odd_pages(spark):
    rows = [(None, "n" * 120), (None, None), (1, "n" * 120), (2, "m" * 120), (2, "m" * 120), (3, "")]
    path = work_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, html string"), path, uri=None)
    got = collections.Counter((r["record_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    page = "<urn:page:{}>".format
    assert got == {
        (page("null"), "revisit", page(1)): 1, (page("null"), "response", None): 1, (page(1), "response", None): 1,
        (page(2), "response", None): 2, (page(3), "response", None): 1,
    }
    empty = work_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, html string"), empty, uri=None)
    assert warc.read_archives(spark, empty).count() == 0


def test_truncated_and_foreign_files(spark):
    record = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    short = record.replace("Length: 5", "Length: 50")
    for content, n in ((record * 2 + short, 2), (record + "junk\r\n\r\n" + record, 1), ("no" + record, 0)):
        folder = work_path(spark, "foreign")
        table = spark.createDataFrame([(content[:-4],)], "value string").coalesce(1)
        table.write.option("lineSep", "\r\n\r\n").text(folder)
        found = warc.read_archives(spark, folder).collect()
        assert [bytes(r["payload"]) for r in found] == [b"ab\r\nc"] * n


def test_pointers_leave_a_split():
    import numpy as np

    at, after = np.array([0, 10, 14, 30, 50]), np.array([30, 50, 33, 70, 90])
    assert warc.jumped(at, after, 80).tolist() == [-1, 90, -1, -1, 90]
    assert warc.jumped(at, after, 60).tolist() == [70, 90, -1, 70, 90]
    assert warc.jumped(at[:0], after[:0], 60).tolist() == []


def test_archive_query(spark, small):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    got = QUERIES["op3_warc"](spark, small).collect()
    import hashlib

    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got} == {
        (k, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for k, h in rows}
    assert len(got) == len(rows)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    import test_texts as texts

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, small))
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "line_dedup":
            rows = [(r["source"], r["text"]) for r in before.values()]
            assert [after[k]["text"] for k in before] == texts.dropped(rows, 0.02, 5)
        else:
            assert all(before[k] == r for k, r in after.items())
        if name == "minhash_near_dedup":
            sets = [(k, texts.shingle_set(r["text"], 5)) for k, r in sorted(before.items())]
            found = texts.components(sets, 80)
            assert set(after) == {k for k, c in found.items() if k == c}
        if name == "benchmark_decontamination":
            clean = {k for k, r in before.items() if not (
                (hit := texts.contamination(r["text"], bench))[1] and 20 * hit[1] >= hit[0])}
            assert set(after) == clean
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in packed} == set(before)
    whole = corpus_pipeline.run(spark, small).collect()
    assert sorted(r[:5] for r in whole) == sorted(r[:5] for r in packed)


def test_pipeline_of_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, small))
        assert docs.count() == 0
