import gzip
import hashlib

from veridex.llm import warc


def archive(*records):
    return b"".join(warc.member(r) for r in records)


def rec(k, text="x" * 50, **more):
    return warc.record(k, f"http://a.example/{k}", text.encode(), **more)


def ids(data):
    return [h["warc-record-id"] for _, h, _ in warc.salvage(data)[0]]


def test_whole_archives_have_no_gaps():
    data = archive(rec(1), rec(2, "é"), rec(3, ""))
    records, gaps = warc.salvage(data)
    assert [h["warc-record-id"] for _, h, _ in records] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"] and gaps == []
    assert warc.payload_of(*records[1][1:]) == "é".encode()
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and warc.salvage(b"") == ([], [])


def test_salvage_after_a_damaged_member():
    parts = [warc.member(rec(k, f"text {k} " * 30)) for k in range(5)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"".join([*parts[:2], bytes(broken), *parts[3:]])
    records, gaps = warc.salvage(data)
    assert [h["warc-record-id"][-2] for _, h, _ in records] == ["0", "1", "3", "4"]
    start = len(parts[0]) + len(parts[1])
    assert [(b, e) for b, e, _ in gaps] == [(start, start + len(parts[2]))] and gaps[0][2]


def test_cut_archive_and_junk():
    whole = archive(rec(1), rec(2))
    data = b"junk" + whole[:-10]
    records, gaps = warc.salvage(data)
    assert ids(data) == ["<urn:page:1>"]
    assert gaps[0][:2] == (0, 4) and gaps[1][1] == len(data)


def test_plain_records_and_version_lines():
    good, bad = rec(1), rec(2).replace(b"Content-Length: ", b"Content-Length: 9", 2)
    data = bad + good
    records, gaps = warc.salvage(data)
    assert [h["warc-record-id"] for _, h, _ in records] == ["<urn:page:1>"] and gaps[0][:2] == (0, len(bad))


def test_wrong_digest_is_quarantined():
    bad = rec(1, "hello there").replace(b"hello there", b"hello thera")
    records, gaps = warc.salvage(bad + rec(2))
    assert [h["warc-record-id"] for _, h, _ in records] == ["<urn:page:2>"] and "digest" in gaps[0][2]


def test_a_version_line_inside_a_payload_is_no_record():
    inner = rec(9)
    assert ids(archive(warc.record(1, None, inner), rec(2))) == ["<urn:page:1>", "<urn:page:2>"]


PAGES = [
    (1, "http://a/", "s" * 1000), (2, "http://a/ b", "s" * 1000), (3, None, "s" * 999), (4, "u", "s" * 999), (5, "u", None), (6, "u", ""), (None, "u", "s" * 1000),
    (7, "u", "é" * 500), (8, "u", "é" * 500), (8, "u", "é" * 500), (9, "u", "x" * 300000), (10, "u", "WARC/1.1\r\n\r\n"),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, refers_to string, archive int")
    rows = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.round_trip(df).collect())
    last = {"s" * 1000: 2, "é" * 500: 8}
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        older = page_id is not None and html in last and page_id < last[html]
        want.append((page_id or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if older else "response", last[html] if older else 0))
    assert rows == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_gaps_are_logged(spark):
    whole = archive(rec(1), rec(2))
    df = spark.createDataFrame([("a", bytearray(b"??" + whole)), ("b", None)], "archive string, data binary")
    rows = warc.read_archives(df).collect()
    assert sorted(r.record_type for r in rows) == ["gap", "response", "response"]
    gap = next(r for r in rows if r.record_type == "gap")
    assert (gap.place, gap.payload_bytes, gap.payload_digest) == (0, 2, "no version line")


def test_valid_records_beside_a_broken_one_in_a_member_are_kept():
    parts = [rec(k, f"text {k} " * 20) for k in range(4)]
    parts[1] = parts[1].replace(b"text 1", b"tixt 1", 1)
    data = warc.member(b"".join(parts)) + archive(rec(7))
    records, gaps = warc.salvage(data)
    assert [h["warc-record-id"][-2] for _, h, _ in records] == ["0", "2", "3", "7"]
    assert len(gaps) == 1 and "digest" in gaps[0][2] and gaps[0][:2] == (0, len(data) - len(archive(rec(7))))


def test_a_cut_member_keeps_what_is_whole():
    both = warc.member(rec(1, "a" * 500) + rec(2, "".join(chr(33 + k * k % 90) for k in range(3000))))
    for cut in (both[:-20], both[:-20] + archive(rec(3))):
        records, gaps = warc.salvage(cut)
        assert [h["warc-record-id"][-2] for _, h, _ in records] == ["1", "3"][: 1 + (len(cut) > len(both))] and len(gaps) == 1


def test_rows_that_share_a_page_id_but_not_a_payload(spark):
    pages = [(1, "u", "a" * 1000), (9, "u", "a" * 1000), (1, "u", "b" * 1500), (1, "u", "small"), (1, "u", "c" * 2000), (2, "u", "c" * 2000)]
    rows = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in rows) == [
        (1, 5, "response", 0), (1, 1000, "revisit", 9), (1, 1500, "response", 0), (1, 2000, "revisit", 2), (2, 2000, "response", 0), (9, 1000, "response", 0),
    ]
    assert {r.payload_digest for r in rows} == {hashlib.sha1(h.encode()).hexdigest() for _, _, h in pages}


def test_a_gap_ends_the_round_trip(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(warc, "write_archives", lambda pages, _: spark.createDataFrame([("a", bytearray(b"??" + archive(rec(1))))], "archive string, data binary"))
    with pytest.raises(Exception, match="gap in an archive"):
        warc.round_trip(spark.range(1)).collect()


def test_a_text_beyond_the_step_of_decompression(spark):
    import random

    text = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz \n", k=5_000_000))
    r = warc.round_trip(spark.createDataFrame([(1, None, text)], "page_id long, url string, html string")).first()
    assert (r.payload_bytes, r.payload_digest) == (len(text), hashlib.sha1(text.encode()).hexdigest())


def test_no_damaged_header_passes():
    """Whatever byte of a member is damaged, a record that is returned is one that was written."""
    one, two, three = rec(1, "first " * 30), rec(2, "second " * 30), rec(3)
    for parts in ([one], [one, two]):
        whole = warc.member(b"".join(parts))
        written = [warc.parse_record(r, 0)[:2] for r in (*parts, three)]
        for k in range(10, len(whole)):
            broken = bytearray(whole)
            broken[k] ^= 0xFF
            records, gaps = warc.salvage(bytes(broken) + archive(three))
            assert gaps and records[-1][1:] == written[-1] and all((h, b) in written for _, h, b in records), k
