import gzip
import hashlib
import io

import pytest

from tests.oracle import check
from touchline.llm import queries, warc
from touchline.llm.common import scratch


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, name):
    check(queries.op3_warc, queries.WARC_SQL, spark, f"/root/testdata/{name}")


@pytest.mark.parametrize("split", [700, 5_000, 1 << 22])
def test_every_split_gives_each_record_once(spark, small, split):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    folder = scratch(spark, "warc")
    got = warc.read(spark, warc.write(pages, folder), folder, split_bytes=split).toPandas()
    texts = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert sorted(got["page_id"]) == sorted(texts)
    for r in got.itertuples():
        assert r.payload_digest == hashlib.sha1(texts[r.page_id]).hexdigest() and (r.payload == texts[r.page_id] if r.record_type == "response" else r.payload is None)


def test_false_magic_is_passed_over():
    real = [warc.record(i, "http://x/", "page " * 400, None, "d") for i in range(3)]
    trap = gzip.compress(b"not an archive record", mtime=0)
    raw = real[0] + trap + b"\x1f\x8b\x08 broken" + real[1] + warc.MAGIC + real[2]
    found = [at for at, _ in warc.members(io.BytesIO(raw), 0, len(raw), len(raw))]
    assert found == [0, len(real[0] + trap) + 10, len(raw) - len(real[2])]
    cuts = list(range(0, len(raw), 37)) + [len(raw)]
    assert [at for a, b in zip(cuts, cuts[1:]) for at, _ in warc.members(io.BytesIO(raw), a, b, len(raw))] == found


def test_a_cut_off_archive_loses_its_last_record_alone():
    real = [warc.record(i, None, "x" * 3000, None, "d") for i in range(2)]
    raw = (real[0] + real[1])[:-5]
    assert [at for at, _ in warc.members(io.BytesIO(raw), 0, len(raw), len(raw))] == [0]


def test_odd_rows(spark):
    same = "s" * 1000
    rows = [(1, "http://a/\r\nX: y", same), (2, None, same), (5, "u", same), (5, "u", same), (3, "u", "s" * 999), (4, "u", "s" * 999), (6, "u", None), (7, "u", ""), (None, "u", same), (8, "u", "ü" * 500), (9, "u", "ü" * 500), (10, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(spark, df.selectExpr("*", "1 as digest", "2 as holder")).collect()), key=str)
    assert got == sorted([(False, 1, "revisit", 5, 1000), (False, 2, "revisit", 5, 1000), (False, 5, "response", None, 1000), (False, 5, "response", None, 1000), (False, 3, "response", None, 999), (False, 4, "response", None, 999), (False, 6, "response", None, 0), (False, 7, "response", None, 0), (True, 0, "revisit", 5, 1000), (False, 8, "revisit", 9, 1000), (False, 9, "response", None, 1000), (False, 10, "response", None, 3_000_000)], key=str)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_files_hold_plain_members_of_the_size_in_the_manifest(spark):
    folder = scratch(spark, "warc")
    df = spark.createDataFrame([(i, "u", f"page {i} " * 200) for i in range(20)], "page_id long, url string, html string")
    for path, size in warc.write(df, folder).select("path", "size").collect():
        with open(path, "rb") as file:
            raw = file.read()
        assert len(raw) == size and gzip.decompress(raw).startswith(b"WARC/1.1")


def test_a_file_shorter_than_its_manifest_says_is_an_error():
    raw = warc.record(1, "u", "x" * 3000, None, "d")
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(raw), 0, len(raw) + 10, len(raw) + 10))
