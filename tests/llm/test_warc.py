"""What other readers rely on: names that resolve, addresses as they were, digests of every record."""

import gzip
import hashlib

from quadrille.llm import warc


def records(path):
    """(fields, block) of every record, split by its own lengths, without this library's reader."""
    out = []
    for f in sorted(path.glob("*.gz")):
        data, at = gzip.decompress(f.read_bytes()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = data[at:end].decode().split("\r\n")
            assert head[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in head[1:])
            n = int(fields["Content-Length"])
            out.append((fields, data[end + 4 : end + 4 + n]))
            at = end + 4 + n
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
    return out


def test_names_resolve_and_addresses_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 200)
    same, long = b"s" * 150, "日x".encode() * 400
    rows = [(1, "http://e/a%20b?c=%25", same), (2, "u", same), (3, "u\r\nX: y%0A", same), (5, "u", long), (5, "v", long), (6, "u", long), (None, "u", same), (7, None, None), (8, "x WARC/1.1", b""), (9, "u", b"short"), (10, "u", b"short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html binary").repartition(3)
    path = tmp_path / "archive"
    warc.write(df, str(path))
    found = records(path)
    names = [f["WARC-Record-ID"] for f, _ in found]
    assert len(names) == len(set(names))
    starts = [f for f, _ in found if f["WARC-Type"] != "continuation"]
    assert len(starts) == len(rows)
    revisits = {f["WARC-Record-ID"]: f for f in starts if f["WARC-Type"] == "revisit"}
    assert len(revisits) == 3
    by = {f["WARC-Record-ID"]: f for f in starts}
    for f in revisits.values():
        if "WARC-Refers-To" in f:
            assert by[f["WARC-Refers-To"]]["WARC-Type"] == "response" and by[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
        else:
            assert f["X-Refers-To-Page"] == "5"
    assert all(f["WARC-Segment-Origin-ID"] in by for f, _ in found if f["WARC-Type"] == "continuation")
    assert "http://e/a%20b?c=%25" in {f.get("WARC-Target-URI") for f in starts}
    got = warc.read(spark, str(path)).collect()
    assert sorted((str(x.page_id), x.url or "") for x in got) == sorted((str(p), u or "") for p, u, _ in rows)
    digests = {hashlib.sha256(h or b"").hexdigest() for _, _, h in rows}
    assert {x.payload_digest for x in got} == digests
