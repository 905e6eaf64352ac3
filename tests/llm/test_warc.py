"""WARC archives: exact round trips, what is a revisit, the format's frames, and what goes wrong."""

import hashlib
import io
import struct
from pathlib import Path

import pytest
import zstandard
from compare import assert_same

from barloom.llm import warc

FOLDER = "/root/testdata/sf0.001"
LONG, OTHER = "<p>é" + "x" * 120, "<p>y\r\n\r\nz</p>" * 20
PAGES = [(5, "http://a/5", LONG), (3, "http://a/3 b\r\nX: y", LONG), (9, None, LONG), (None, "n", LONG), (1, "u", "short"), (2, "u", "short"), (4, "", None), (6, "u", ""), (7, "u", OTHER), (7, "u", OTHER), (8, "u", OTHER), (None, "m", "q" * 200), (None, "m", "q" * 200)]


def wanted(rows, least=100):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        again = len(raw) >= least and first is not None and (i is None or i > first)
        out.append((i, "revisit" if again else "response", len(raw), hashlib.sha256(raw).hexdigest(), first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [0, 100])
@pytest.mark.parametrize("train_bytes, archive_bytes", [(1 << 20, 1 << 30), (300, 900)])
def test_round_trip(spark, tmp_path, broadcast_rows, train_bytes, archive_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS first")
    path = f"file://{tmp_path}/out"
    warc.write_archives(warc.records(pages, broadcast_rows=broadcast_rows), path, train_bytes=train_bytes, archive_bytes=archive_bytes)
    rows = warc.read_archives(spark, path, payload=True).collect()
    assert sorted(((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in rows), key=str) == wanted(PAGES)
    texts = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in PAGES}
    assert all(r.payload == (texts[r.payload_digest] if r.record_type == "response" else None) for r in rows)
    assert {r.url for r in rows if r.page_id == 3} == {"http://a/3%20b%0D%0AX:%20y"} and {r.url for r in rows if r.page_id == 9} == {None}
    assert not (tmp_path / "out/_temporary").exists() or not list((tmp_path / "out/_temporary").iterdir())


def test_a_hot_payload_is_spread_by_salt(spark):
    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('u', id) AS url", f"CASE WHEN id % 3 = 0 THEN '{LONG}' ELSE concat('{LONG}', id) END AS html")
    found = warc.records(pages, broadcast_rows=0)
    assert found.filter("record_type = 'revisit'").count() == 6666
    assert found.filter("record_type = 'revisit' AND refers_to = 0 AND refers_url = 'u0' AND payload IS NULL").count() == 6666


def test_frames_of_the_format():
    records = [warc.record(i, f"http://x/{i}", "response", p, len(p), hashlib.sha256(p).hexdigest()) for i, p in enumerate([b"<p>%d" % i + b"words " * i for i in range(300)])]
    raw = b"".join(warc.archive(iter(records), 20_000))
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    held = zstandard.decompress(raw[8 : 8 + size])
    assert held[:4] == b"\x37\xa4\x30\xec"  # a trained dictionary
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)).decompressobj()
    assert first.decompress(raw[8 + size :]) == records[0] and first.eof
    for piece in (1, 7, 1 << 16):
        assert list(warc.frames(io.BytesIO(raw), piece)) == records
    assert len(raw) < 0.6 * sum(len(zstandard.compress(r)) for r in records)


def test_few_records_have_no_dictionary():
    few = [warc.record(1, None, "response", b"a", 1, hashlib.sha256(b"a").hexdigest())]
    raw = b"".join(warc.archive(iter(few)))
    assert raw[:4] == b"\x28\xb5\x2f\xfd" and list(warc.frames(io.BytesIO(raw))) == few
    assert list(warc.archive(iter([]))) == [] and list(warc.frames(io.BytesIO(b""))) == []


def test_damage_is_seen():
    raw = warc.record(1, "u", "response", b"abc", 3, hashlib.sha256(b"abd").hexdigest())
    with pytest.raises(ValueError, match="another digest"):
        warc.parsed(raw)
    good = warc.record(1, "u", "response", b"abc", 3, hashlib.sha256(b"abc").hexdigest())
    with pytest.raises(ValueError, match="whole"):
        warc.parsed(good[:-3])
    packed = b"".join(warc.archive(iter([good] * 3)))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.frames(io.BytesIO(packed[:-3])))


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """A writer whose job is given up clears its folder, and readers see committed archives only."""
    writer = warc.WarcWriter({"path": str(tmp_path)}, False)
    lost = tmp_path / "_temporary" / writer.job / "attempt"
    lost.mkdir(parents=True)
    (lost / "x.warc.zst").write_bytes(b"half")
    assert [p.path for p in warc.WarcReader({"path": str(tmp_path)}).partitions()] == [""]
    writer.abort([None])
    assert not lost.exists()


def test_overwrite_append_and_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.records(none), path)
    assert warc.read_archives(spark, path).count() == 0
    one = spark.createDataFrame([(1, "u", LONG)], none.schema)
    for mode, rows in (("append", 1), ("append", 2), ("overwrite", 1)):
        warc.write_archives(warc.records(one), path, mode)
        assert warc.read_archives(spark, path).count() == rows


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
def test_query_matches_sql(spark):
    assert len(assert_same(spark, warc.op13_warc_archive, warc.OP13_SQL, FOLDER)) > 20
