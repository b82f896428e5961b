import base64
import hashlib
import io
import zlib

from tessera.llm.queries import QUERIES
from tessera.llm.warc import WarcConfig, archive_round_trip, page_record, read_archives, read_records, record, write_archives


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(pages, least=0):
    """(bytes, digest, type, refers_to) of every (page_id, html)."""
    best = {}
    for p, h in pages:
        if p is not None:
            best[h or ""] = max(best.get(h or "", p), p)
    count = {}
    for _, h in pages:
        count[h or ""] = count.get(h or "", 0) + 1
    out = []
    for p, h in pages:
        data = (h or "").encode()
        first = best.get(h or "")
        revisit = len(data) >= least and count[h or ""] > 1 and first is not None and p != first
        out.append((p, len(data), sha(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = QUERIES["op4_warc"](spark, sf).collect()
    assert all(r.problem is None for r in rows)
    assert sorted((tuple(r)[:5] for r in rows), key=str) == brute(pages)


def test_edge_cases(frame, spark):
    big = "<p>ü</p>" * 60_000
    rows = [(1, "u", "a"), (2, None, "a"), (3, "http://x/\r\nEvil: 1", "a"), (4, "u", None), (5, "u", ""),
            (6, "u", big), (7, "u", big), (None, "u", "a"), (8, "u", "solo"), (8, "u", "solo"), (None, None, "x")]
    pages = frame([(*r, "k") for r in rows], "page_id long, url string, html string, record_type string")
    for least in (0, 2):
        cfg = WarcConfig(least_bytes=least, archive_bytes=2000, read_bytes=100)
        got = archive_round_trip(spark, pages, cfg).collect()
        assert all(r.problem is None for r in got)
        assert sorted((tuple(r)[:5] for r in got), key=str) == brute([(p, h) for p, _, h in rows], least)
    assert archive_round_trip(spark, pages.limit(0)).collect() == []


def test_payloads_survive_the_archive(frame, spark, scratch):
    rows = [(i, f"http://h/{i}", f"<p>page {i} é</p>\r\n\r\n" * (i + 1)) for i in range(30)]
    manifest = write_archives(spark, frame(rows, "page_id long, url string, html string"), f"file://{scratch}/w",
                              WarcConfig(archive_bytes=1500))
    assert manifest.count() > 2 and sum(r.records for r in manifest.collect()) == 30
    got = {r.record_id: bytes(r.payload).decode() for r in read_archives(manifest).collect()}
    assert got == {f"<urn:page:{i}>": h for i, _, h in rows}


def test_reader_reports_damage():
    cfg = WarcConfig()
    good = page_record(1, "http://a/", b"hello", None, False, cfg)
    assert [r.problem for r in read_records(io.BytesIO(good + good), 7)] == [None, None]
    offsets = [r.offset for r in read_records(io.BytesIO(good + good), 7)]
    assert offsets == [0, len(good)]
    plain = zlib.decompress(good, 31)

    def pack(raw):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(raw) + z.flush()
    cases = {
        "block digest differs": plain.replace(b"hello", b"jello"),
        "content length does not frame the block": plain.replace(b"hello", b"hello!"),
        "no record header": b"nothing here",
    }
    for problem, raw in cases.items():
        found = list(read_records(io.BytesIO(pack(raw) + good)))
        assert [r.problem for r in found] == [problem, None]
    cut = list(read_records(io.BytesIO(good + good[:30])))
    assert [r.problem for r in cut] == [None, "archive ends inside a member"]
    assert list(read_records(io.BytesIO(good + b"junk")))[1].problem.startswith("member does not inflate")
    wrong = record("response", [("WARC-Payload-Digest", "sha1:" + sha(b"other")),
                                ("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\n\r\nhello")
    assert next(read_records(io.BytesIO(wrong))).problem == "payload digest differs"
