from __future__ import annotations

import gzip
import hashlib

from tidewatch.llm import queries, warc


def record(number: int, body: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    digest = hashlib.sha256(block).hexdigest().encode()
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:tidewatch:page:%d>\r\nWARC-Block-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n" % (number, digest, len(block)) + block + b"\r\n\r\n"


RECORDS = [record(i, b"<p>%d</p>" % i * 50 + b"\r\n\r\nWARC/1.1 in a page\r\n\r\n") for i in range(6)]


def ids(data: bytes) -> list:
    return [None if got is None else int(got["fields"][b"warc-record-id"][:-1].rsplit(b":", 1)[1]) for _, _, _, got in warc.salvage(data)]


def covered(data: bytes) -> bool:
    at = 0
    for start, end, inner, _ in warc.salvage(data):
        if start > at:
            return False
        at = max(at, end)
    return at == len(data)


def test_sound_archives():
    for data in (b"".join(RECORDS), b"".join(map(gzip.compress, RECORDS)), gzip.compress(b"".join(RECORDS)), gzip.compress(RECORDS[0]) + b"".join(RECORDS[1:])):
        assert ids(data) == list(range(6)) and covered(data)


def test_damage_is_quarantined_and_later_records_recovered():
    for parts in (RECORDS, [gzip.compress(r) for r in RECORDS]):
        for hurt in range(6):
            data = bytearray(b"".join(parts))
            data[sum(map(len, parts[:hurt])) + len(parts[hurt]) // 2] ^= 0xFF
            assert ids(bytes(data)) == [None if i == hurt else i for i in range(6)] and covered(bytes(data))


def test_sound_records_of_a_damaged_member_count():
    many = [record(i, hashlib.sha256(b"%d" % i).hexdigest().encode() * 20) for i in range(200)]
    whole = gzip.compress(b"".join(many))
    for at, least in ((len(whole) - 6, 200), (len(whole) // 2, 90)):
        data = bytearray(whole)
        data[at] ^= 0xFF
        found = [i for i in ids(bytes(data)) if i is not None]
        assert len(found) >= least and found == sorted(found) and covered(bytes(data))
        assert ids(bytes(data) + RECORDS[0])[-1] == 0


def test_wrong_length_and_cut_ends():
    wrong = RECORDS[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert [i for i in ids(RECORDS[0] + wrong + RECORDS[2]) if i is not None] == [0, 2]
    whole = b"".join(RECORDS)
    assert ids(whole[:-200]) == [0, 1, 2, 3, 4, None]
    assert ids(b"junk" + whole) == [None, 0, 1, 2, 3, 4, 5] and ids(b"") == [] and ids(b"\x1f\x8b\x08") == [None]
    member = gzip.compress(whole)
    assert ids(member[: len(member) // 2] + RECORDS[0])[-1] == 0


def expected(pages: list[dict]) -> list[tuple]:
    first = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        first.setdefault((p["html"] or "").encode(), p["page_id"])
    out = []
    for p in sorted(pages, key=lambda p: p["page_id"]):
        body = (p["html"] or "").encode()
        again = len(body) >= 100 and first[body] != p["page_id"]
        out.append((p["page_id"], len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return out


def rows(df) -> list[tuple]:
    return sorted(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect())


def test_round_trip(spark, small):
    assert rows(queries.op3_warc(spark, small)) == expected([r.asDict() for r in spark.read.parquet(f"{small}/pages.parquet").collect()])


def test_round_trip_edges(spark):
    big, kind = "é\r\n\r\nWARC/1.1\r\n" * 40_000, "page_id long, url string, html string, digest string, id string"
    pages = [(1, "http://a b/\n", "x" * 100), (2, None, "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (9, "u", "\x00\udcff".encode("utf-8", "ignore").decode())]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], kind)
    assert rows(warc.round_trip(df)) == expected([dict(zip(("page_id", "url", "html"), p, strict=True)) for p in pages])
    assert rows(warc.round_trip(df.where("false"))) == []
    odd = spark.createDataFrame([(None, "u", "y" * 200, "", ""), (2, "u", "y" * 200, "", ""), (2, "u", "y" * 200, "", "")], kind)
    assert sorted((str(r["page_id"]), r["record_type"]) for r in warc.round_trip(odd).collect()) == [("2", "response"), ("2", "response"), ("None", "response")]


def test_repeated_ids_of_different_payloads(spark):
    """A revisit has its own payload's size and digest, whatever else shares the id that it refers to."""
    pages = [(2, "u", "a" * 150), (2, "u", "b" * 300), (6, "u", "a" * 150), (7, "u", "b" * 300), (7, "u", "b" * 300)]
    got = rows(warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")))
    digest = {n: hashlib.sha256(c.encode() * n).hexdigest() for n, c in ((150, "a"), (300, "b"))}
    assert got == sorted([(2, 150, digest[150], "response", None), (2, 300, digest[300], "response", None), (6, 150, digest[150], "revisit", 2), (7, 300, digest[300], "revisit", 2), (7, 300, digest[300], "revisit", 2)], key=lambda r: r[:4])


def test_files_are_bounded_by_bytes(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", hashlib.sha256(b"%d" % i).hexdigest() * 20) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write(df, f"file://{tmp_path}/w", chunk=1_000, chunks=3)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) < 3 * (1_000 + 700)
    assert sorted(r["page_id"] for r in warc.salvaged(warc.read(spark, f"file://{tmp_path}/w"))[0].collect()) == list(range(60))


def test_round_trip_of_a_very_long_url(spark, tmp_path):
    long = "data:text/html," + "a" * 200_000
    df = spark.createDataFrame([(1, long, "x"), (2, "u", "y")], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/w")
    got = {warc_id: uri for ok, warc_id, uri in warc.read(spark, f"file://{tmp_path}/w").select("ok", "id", "uri").collect() if ok}
    assert got == {"<urn:tidewatch:page:1>": long, "<urn:tidewatch:page:2>": "u"}


def test_damage_of_a_written_archive_costs_the_record_that_it_hits(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", hashlib.sha256(b"%d" % i).hexdigest() * 5) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    warc.write(df, f"file://{tmp_path}/w")
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert sorted(i for data in files for i in ids(data)) == list(range(50)) and all(covered(data) for data in files)
    assert sum(gzip.decompress(data).count(b"WARC/1.1\r\n") for data in files) == 50
    lost = []
    for data in files:
        for at in range(11, len(data), 211):
            hurt = bytearray(data)
            hurt[at] ^= 0xFF
            lost.append(len(set(ids(data)) - set(ids(bytes(hurt)))))
            assert covered(bytes(hurt))
    assert max(lost) == 1


def test_gaps_are_logged(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(RECORDS[0] + b"damage" + RECORDS[1])
    got = sorted((r["start"], r["end"], r["ok"]) for r in warc.read(spark, f"file://{tmp_path}").collect())
    pages, log = warc.salvaged(warc.read(spark, f"file://{tmp_path}"))
    n = len(RECORDS[0])
    assert [(r["start"], r["end"]) for r in log.collect()] == [(n, n + 6)] and sorted(r["page_id"] for r in pages.collect()) == [0, 1]
    assert got == [(0, n, True), (n, n + 6, False), (n + 6, n + 6 + len(RECORDS[1]), True)]
