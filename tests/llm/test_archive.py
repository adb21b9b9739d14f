import gzip
import hashlib
from pathlib import Path

from tremor.llm.archive import archived, parse, read, reconstruct, write

LONG = "<p>" + "é" * 60 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
ROWS = [(1, "http://a", LONG), (2, "http://b", LONG), (3, None, LONG), (4, "http://d\r\nX: y", "short"), (5, "e", "short"), (6, "f", None), (7, "g", ""),
        (8, "h", "x" * 99), (9, "i", "x" * 99), (10, "j", "y" * 100), (11, "k", "y" * 100), (None, "n", LONG), (12, "l", LONG), (12, "l", LONG)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_contract(spark):
    got = sorted((tuple(r) for r in archived(table(spark)).collect()), key=str)
    want = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        head = min(p for p, _, h in ROWS if (h or "") == (html or "") and p is not None)
        again = len(raw) >= 100 and page is not None and page > head
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", head if again else None))
    assert got == sorted(want, key=str)


def test_files_and_round_trip(spark, tmp_path):
    path = str(tmp_path / "warc")
    write(table(spark), path)
    found = [r for f in Path(path).glob("part-*.gz") for r in parse(gzip.decompress(f.read_bytes()))]
    assert len(found) == len(ROWS)
    assert sum(len(p) for _, p in found if p == LONG.encode()) == 2 * len(LONG.encode())  # page 1, and the page without an id
    back = reconstruct(read(spark, path, payloads=True)).collect()
    assert sorted((str(r.page_id), bytes(r.payload).decode()) for r in back) == sorted((str(p), h or "") for p, _, h in ROWS)
    assert {r.header.encode() for r in back} == {h for h, _ in found}


def test_empty(spark):
    assert archived(table(spark, [])).collect() == []


def test_broken_payload_is_an_error(spark, tmp_path):
    path = tmp_path / "warc"
    write(table(spark, ROWS[:1]), str(path))
    part = next(path.glob("part-*.gz"))
    part.write_bytes(gzip.compress(gzip.decompress(part.read_bytes()).replace(b"<p>", b"<q>")))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    try:
        read(spark, str(path)).collect()
    except Exception as e:
        assert "does not match its digest" in str(e)
    else:
        raise AssertionError
