from __future__ import annotations

import gzip
import hashlib
import io
import re
from pathlib import Path

import pytest

from stratalith.llm import warc

BIG = "<html>" + "x" * 200 + "</html>"
TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nüü😀" + "y" * 100


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def result(df):
    return sorted(((r.page_id, r.response.payload_bytes, r.response.payload_digest.removeprefix("sha256:"), r.response.kind, r.refers_to) for r in df.collect()), key=repr)


def plain(rows):
    first = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        f = first.get(html) if len(data) >= 100 else None
        revisit = f is not None and (i is None or i > f)
        out.append((i, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(((a, *rest) for a, _, *rest in out), key=repr)


ROWS = [
    (5, "http://a/1", BIG), (3, "http://a/2", BIG), (9, None, BIG), (4, "http://b c\r\nX: y", TRICKY), (6, "u", TRICKY), (7, "u", "small"), (8, "u", "small"), (10, "u", None), (11, "u", ""),
    (None, "u", BIG), (12, "u", "z" * 99), (13, "u", "z" * 99), (-4, "n", TRICKY), (3, "http://a/2", BIG), (14, "u", "line\n" * 50_000),
]


@pytest.mark.parametrize("gz", [True, False])
def test_round_trip(spark, tmp_path, gz):
    folder = str(tmp_path / "w")
    warc.write_archives(pages(spark, ROWS).repartition(3), folder)
    if not gz:
        for path in (tmp_path / "w").glob("*.gz"):
            path.with_suffix("").write_bytes(gzip.decompress(path.read_bytes()))
            path.unlink()
    rows = warc.assemble(warc.read_records(spark, folder)).collect()
    assert len(rows) == len(ROWS)
    bodies = {bytes(r.response.payload) for r in rows if r.response.kind == "response"}
    assert bodies == {(h or "").encode() for _, _, h in ROWS}
    for r in rows:
        assert r.request and r.metadata and r.request.url == r.response.url
        if r.response.kind == "revisit":
            assert r.response.payload is None and r.response.refers_to in {x.response.id for x in rows if x.response.kind == "response"}
    assert len({r.response.id for r in rows}) == len(rows)


def test_contract(spark, tmp_path):
    assert result(warc.captures(pages(spark, ROWS), str(tmp_path / "a"), payload=False)) == plain(ROWS)
    nulls = [(None, "u", BIG), (None, "v", BIG)]
    assert result(warc.captures(pages(spark, nulls), str(tmp_path / "b"))) == plain(nulls)


def test_repeated_rows(spark, tmp_path):
    """Each row has records of its own, equal ones too; a revisit refers to one of the responses of the smallest page."""
    rows = [(2, "u", BIG)] * 3 + [(1, "v", BIG)] * 2 + [(1, "w", BIG), (7, "u", "small"), (7, "u", "small")]
    got = warc.captures(pages(spark, rows).repartition(4), str(tmp_path / "a")).collect()
    assert sorted((r.page_id, r.response.kind, r.refers_to) for r in got if r.page_id == 2) == [(2, "revisit", 1)] * 3
    assert [r.response.kind for r in got if r.page_id != 2] == ["response"] * 5
    assert len({r.response.id for r in got}) == len({r.request.id for r in got}) == len({r.metadata.id for r in got}) == len(rows)
    assert {r.response.refers_to for r in got if r.page_id == 2} <= {r.response.id for r in got if r.page_id == 1}


def test_archive_larger_than_its_chunks(spark, tmp_path):
    """One archive through many Arrow batches, members of its own for each record, lines of any bytes and no line feed at its end."""
    blocks = [bytes(range(256)) * 40, b"\r\n\r\n" * 500, b"", b"\n" * 30_000, "\u0085\u2028é".encode() * 999, b"\xff\xfe no line end"]
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200\r\n\r\n%b"
    raw = [record % (k, 16 + len(b), b) for k, b in enumerate(blocks)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r + (b"\r\n\r\n" if k < 5 else b"")) for k, r in enumerate(raw)))
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(record.replace(b"<%d>", b"<y%d>") % (0, 16 + 3, b"end")))
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert {r.record_id: bytes(r.payload) for r in rows} == {**{f"<{k}>": b for k, b in enumerate(blocks)}, "<y0>": b"end"}


def test_clashing_columns_and_empty(spark, tmp_path):
    df = pages(spark, ROWS).selectExpr("*", "'x' AS digest", "'x' AS rid", "'x' AS first", "'x' AS n_bytes")
    assert result(warc.captures(df, str(tmp_path / "a"), payload=False)) == plain(ROWS)
    assert warc.captures(pages(spark, []), str(tmp_path / "b")).count() == 0


def test_files_are_warc(spark, tmp_path):
    folder = tmp_path / "w"
    warc.write_archives(pages(spark, ROWS), str(folder))
    kinds = []
    for f in folder.glob("*.gz"):
        for headers, block in warc.parse_records(io.BytesIO(gzip.decompress(f.read_bytes()))):
            kinds.append(headers["warc-type"])
            assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", headers["warc-record-id"])
            assert int(headers["content-length"]) == len(block)
    assert len(kinds) == 3 * len(ROWS)


def test_foreign_records_and_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nContent-Length: 20\r\n\r\nHTTP/1.1 200\r\n\r\nbody\r\n\r\n"
    extra = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "in" / "x.warc").write_bytes(extra + record + record)
    rows = warc.assemble(warc.read_records(spark, str(tmp_path / "in"))).collect()
    assert len(rows) == 1 and rows[0].request is None and bytes(rows[0].response.payload) == b"body"
    for bad in (record[:-20], b"nonsense\r\n", record[:30]):
        with pytest.raises(ValueError):
            list(warc.parse_records(io.BytesIO(bad)))
    assert Path(tmp_path / "in").exists()


def test_altered_payload_shows(spark, tmp_path):
    """The digest is that of the payload as read, for its revisits too, whatever the headers say."""
    folder = tmp_path / "w"
    warc.write_archives(pages(spark, [(1, "u", BIG), (2, "v", BIG), (3, "w", "sound")]).coalesce(1), str(folder))
    altered = BIG.replace("x", "y")
    for path in folder.glob("*.gz"):
        data = gzip.decompress(path.read_bytes()).replace(BIG.encode(), altered.encode())
        (folder / f".{path.name}.crc").unlink(missing_ok=True)
        path.write_bytes(gzip.compress(data))
    rows = warc.assemble(warc.read_records(spark, str(folder), False)).collect()
    got = {r.response.url: (r.response.payload_digest, r.response.digest_agrees) for r in rows}
    wrong, right = (f"sha256:{hashlib.sha256(x.encode()).hexdigest()}" for x in (altered, "sound"))
    assert got == {"u": (wrong, False), "v": (wrong, False), "w": (right, True)}
