"""WARC files read back by splits, records of any bytes."""

import gzip

from tidewater.llm import warc


def _response(n, block):
    return warc.Record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:{n}>", "WARC-Target-URI": f"http://h.test/{n}", "WARC-Date": warc.DATE}, block)


def test_files_of_all_kinds_give_their_records(spark, tmp_path):
    inner = _response("inner", b"x").bytes() * 2
    blocks = [b"", b"plain", bytes(range(256)) * 400, b"\r\n\r\n", b"a" + inner + b"b", b"\r\n\r\nWARC/1.0\r\n", b"last \xff\xfe"]
    made = [_response(i, b) for i, b in enumerate(blocks)]
    info = warc.Record({"WARC-Type": "warcinfo"}, b"about").bytes()
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "plain.warc").write_bytes(info + b"".join(r.bytes() for r in made))
    (folder / "byrecord.warc.gz").write_bytes(b"".join(gzip.compress(r.bytes()) for r in made))
    (folder / "whole.warc.gz").write_bytes(gzip.compress(b"".join(r.bytes() for r in made)))
    (folder / "old.warc").write_bytes(made[1].bytes().replace(b"WARC/1.1", b"WARC/1.0") * 3)
    (folder / "cut.warc").write_bytes(made[2].bytes()[:-5000])
    (folder / "none.warc").write_bytes(b"")
    (folder / "other.warc").write_bytes(b"no such thing")
    got = sorted((r.record_id, bytes(r.block)) for r in warc.read_responses(spark, str(folder)).collect())
    want = [(f"<urn:{i}>", b) for i, b in enumerate(blocks)] * 3 + [("<urn:1>", b"plain")] * 3 + [("<urn:2>", blocks[2][: -5000 + 4])]
    assert got == sorted(want)


def test_a_file_larger_than_a_split(spark, tmp_path):
    path = tmp_path / "big.warc"
    path.write_bytes(b"".join(_response(i, bytes([i % 251]) * (i % 97) * 31).bytes() for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        found = warc.read_responses(spark, str(path))
        assert found.rdd.getNumPartitions() > 4
        assert sorted((r.record_id, bytes(r.block)) for r in found.collect()) == sorted((f"<urn:{i}>", bytes([i % 251]) * (i % 97) * 31) for i in range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
