import base64
import hashlib
import struct

import pytest
import zstandard

from surveyloom.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def round_trip(spark, rows, path):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    warc.write_archives(pages, str(path))
    return warc.read_archives(spark, str(path)).collect()


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_payloads_come_back(spark, tmp_path):
    rows = [(i, f"http://e.org/{i}", f"<p>page {i} " + "é🙂\r\n\r\n" * (i % 5)) for i in range(300)]
    found = {r["page_id"]: r for r in round_trip(spark, rows, tmp_path / "a")}
    assert len(found) == 300
    for i, url, html in rows:
        r = found[i]
        assert bytes(r["payload"]).decode() == html and r["url"] == url and r["record_type"] == "response"
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == digest(html) and r["refers_to"] is None


def test_copies_refer_to_the_largest_id(spark, tmp_path):
    rows = [(1, "u", "same"), (9, "u", "same"), (4, "u", "same"), (2, "u", None), (3, "u", ""), (7, "u", "own")]
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in round_trip(spark, rows, tmp_path / "a")}
    assert found == {
        1: ("revisit", 9), 9: ("response", None), 4: ("revisit", 9), 2: ("revisit", 3), 3: ("response", None), 7: ("response", None),
    }


def test_nulls_repeats_and_odd_addresses(spark, tmp_path):
    rows = [(None, None, "x"), (5, "a\r\nWARC-Type: fake", "x"), (5, "b", "x"), (None, "c", "alone"), (6, "ü ?", "y" * 300_000)]
    found = round_trip(spark, rows, tmp_path / "a")
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or 0) for r in found) == [
        (-1, "response", 0), (-1, "revisit", 5), (5, "response", 0), (5, "response", 0), (6, "response", 0),
    ]
    assert {r["url"] for r in found} == {None, "a%0D%0AWARC-Type: fake", "b", "c", "ü ?"}


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, [], tmp_path / "a") == []
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_columns_are_ignored(spark):
    pages = spark.createDataFrame([(1, "u", "h")], SCHEMA).selectExpr("*", "1 as payload", "2 as digest", "3 as top")
    assert warc.archive_round_trip(pages).first()["payload_bytes"] == 1


def test_files_follow_the_format(spark, tmp_path):
    rows = [(i, "u", f"<html>{i} some text that repeats in every page</html>") for i in range(200)]
    round_trip(spark, rows, tmp_path / "a")
    for file in (tmp_path / "a").glob("part-*"):
        data = file.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        assert dictionary.dict_id() != 0
        # every record is a frame of its own
        starts, at = [], 8 + size
        while at < len(data):
            at += len(warc.EMPTY_FRAME) if data[at:].startswith(warc.EMPTY_FRAME) else 0
            if at >= len(data):
                break
            reader = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            record = reader.decompress(data[at:])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            starts.append(at)
            at = len(data) - len(reader.unused_data)
        assert starts


def test_dictionary_helps(spark, tmp_path):
    rows = [(i, "u", f"<html><head><title>{i}</title></head><body class='main'>text {i * 7919}</body></html>") for i in range(500)]
    pages = spark.createDataFrame(rows, SCHEMA)
    trained = warc.train_dictionary(pages)
    records = [warc.record(i, u, h.encode(), False, None) for i, u, h in rows]
    with_it = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    assert sum(len(with_it.compress(r)) for r in records) < 0.7 * sum(len(zstandard.compress(r)) for r in records)


def test_damage_is_noticed():
    import io

    good = warc.record(1, "u", b"payload", False, None)
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(good * 2))] == [1, 1]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-1])))


@pytest.mark.parametrize("most", ["0", "1", "7"])
def test_archives_of_bounded_size_each_with_its_dictionary(spark, tmp_path, most):
    rows = [(i, f"u{i}", f"page {i} " + hashlib.sha256(str(i).encode()).hexdigest() * (1 + i % 40)) for i in range(400)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
    try:
        warc.write_archives(pages, str(tmp_path / "a"), archive_bytes=4000)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    files = list((tmp_path / "a").glob("part-*"))
    sizes = [f.stat().st_size for f in files]
    assert any("-c001" in f.name for f in files) and max(sizes) < 4000 + warc.DICTIONARY_BYTES + 4000
    found = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert found == {i: html for i, _, html in rows}
