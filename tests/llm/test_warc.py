"""Archives: exact round trips, members by offset, sidecar index."""

import base64
import glob
import gzip
import hashlib
import json
import zlib

import pytest

from heliograph.llm import queries, warc
from heliograph.session import scratch_path

HTML = ["<p>one</p>", "", None, "<p>é\r\n\r\nWARC/1.1\r\n</p>", "x" * 300_000, "<p>one</p>", "<p>one</p>", "\x00\r\n"]


def frame(spark):
    rows = [(10 - i, f"http://h/{i}\r\nX: y é", h, "q") for i, h in enumerate(HTML)]
    rows += [(None, None, "<p>one</p>", "q"), (None, "u", "only here", "q"), (3, "again", None, "q"), (4, "again", "<p>one</p>", "q")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, path string"), rows


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least=0):
    out = []
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        first = min((r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None), default=None)
        revisit = first is not None and page_id != first and len(payload) >= least
        out.append((page_id, len(payload), digest(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_round_trip(spark, least):
    df, rows = frame(spark)
    got = warc.archive_round_trip(df.repartition(3), least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows, least)
    texts = {r.payload_digest: bytes(r.payload) for r in got if r.payload is not None}
    assert texts == {digest(h): (h or "").encode() for _, _, h, _ in rows}


def test_members_and_sidecar(spark):
    df, rows = frame(spark)
    folder = scratch_path(spark, "warc-test")
    index = warc.normalise_archives(warc.write_archives(df.coalesce(1), folder), folder).orderBy("offset").collect()
    [path] = {r.path for r in index}
    raw = open(path, "rb").read()
    assert len(glob.glob(f"{folder}/monolith-*")) == 1
    at = 0
    for r in index:
        assert r.offset == at
        data = zlib.decompress(raw[r.offset : r.offset + r.length], wbits=31)
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and r.record_id.encode() in data
        at += r.length
    assert at == len(raw) and len(index) == len(rows) == len({r.record_id for r in index})
    sidecar = [json.loads(x) for x in open(f"{path}.idx")]
    assert [(x["offset"], x["length"], x["record_id"]) for x in sidecar] == [(r.offset, r.length, r.record_id) for r in index]
    [mono] = glob.glob(f"{folder}/monolith-*")
    assert gzip.open(mono).read() == gzip.open(path).read()


def test_several_members_and_cut_files(tmp_path):
    heads = [warc.record_head(i, "u", b"body" * i, None, False, "0") + b"body" * i + b"\r\n\r\n" for i in range(5)]
    whole = tmp_path / "a.gz"
    whole.write_bytes(gzip.compress(b"\r\n" + heads[0] + heads[1]) + gzip.compress(b"".join(heads[2:])))
    with open(whole, "rb") as f:
        stream, n = warc._Stream(f), 0
        while (head := stream.head()) is not None:
            content = b"".join(stream.body(int(warc.header_fields(head)["content-length"])))
            assert content.endswith(b"body" * n)
            n += 1
    assert n == 5
    whole.write_bytes(gzip.compress(heads[4])[:-30])
    with pytest.raises((ValueError, zlib.error)), open(whole, "rb") as f:
        stream = warc._Stream(f)
        while (head := stream.head()) is not None:
            list(stream.body(int(warc.header_fields(head)["content-length"])))


def test_files_are_closed_by_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    df, rows = frame(spark)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(df.coalesce(1), folder)
    assert manifest.count() > 1
    assert warc.read_archives(warc.normalise_archives(manifest, folder)).count() == len(rows)


def test_empty_table(spark):
    df, _ = frame(spark)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    got = queries.op7_warc_normaliser(spark, sf).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
