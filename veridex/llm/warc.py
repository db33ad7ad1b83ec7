"""WARC archives: a writer with payload deduplication and a salvage reader.

Archives are rows of a table (name, data), each a run of gzip members with one record each. The reader checks
gzip checksums, record lengths, end marks and payload digests. After a failed check it looks for the next valid
member or version line, goes on from there and logs the bytes it passed over as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.common import small, stage

#: Payloads from this size on are stored once.
REVISIT_FROM = 1000
#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
#: An extension header, the last one: the CRC-32 of the headers above it and the block, which payload digests don't cover.
_CHECK = b"\r\nRecord-CRC32: "
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_STARTS = re.compile(rb"\x1f\x8b\x08|" + _VERSION.pattern)
#: Compressed bytes that are decompressed at first and at most at once; around a fault in ever smaller steps.
_INFLATE_STEPS = 8 << 10, 1 << 20


class BrokenRecord(ValueError):
    pass


# --- writing ---------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, not compressed. A revisit holds the HTTP head only; its Content-Length tells the payload's size."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {digest}", f"Content-Length: {len(block)}"]
    head = "\r\n".join(lines).encode()
    return head + _CHECK + b"%08x" % zlib.crc32(block, zlib.crc32(head)) + _END + block + _END


def member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _payload_keys() -> dict:
    """_d and _n of a page's payload: SHA-1 in 20 bytes and length."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    return {"_d": F.unhex(F.sha1(payload)), "_n": F.octet_length(payload)}


def plan_revisits(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, _d, _n and refers_to of the payloads that a page with a larger id holds as well.

    A payload is known by digest and length, so of two rows with one page_id each goes its own way. Grouped extremes
    are formed before the shuffle, so a payload that very many pages share is no hot key.
    """
    seen = pages.select("page_id", *(c.alias(k) for k, c in _payload_keys().items())).where((F.col("_n") >= revisit_from) & F.col("page_id").isNotNull())
    last = seen.groupBy("_d", "_n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_first")).where("_first < refers_to").drop("_first")
    return seen.join(last, ["_d", "_n"]).where("page_id < refers_to").select("page_id", "_d", "_n", "refers_to").distinct()


def write_archives(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """archive (name) and data of the archives that hold a record for every row.

    A null html counts as empty; a null page_id is kept as a response. Rows with equal page_id and payload are
    all responses or revisits alike; a row with the same page_id and another payload is judged by its own payload.
    Of equal payloads at least one response is always written. Other columns are not read.
    """
    revisits = small(stage(plan_revisits(pages, revisit_from), "revisits"))
    rows = pages.select("page_id", "url", "html").withColumns(_payload_keys()).join(revisits, ["page_id", "_d", "_n"], "left")

    def run(batches):
        part, done, out, size = TaskContext.get().partitionId(), 0, [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{done:06d}.warc.gz"]), pa.array([b"".join(out)], pa.binary())], ["archive", "data"])
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns):
                out.append(member(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py())))
                size += len(out[-1])
                if size >= ARCHIVE_BYTES:
                    yield pack()
                    done, out, size = done + 1, [], 0
        if out:
            yield pack()

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, data binary")


# --- reading ---------------------------------------------------------------------------


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at a place. Raises BrokenRecord if a check fails."""
    if not _VERSION.match(data, at):
        raise BrokenRecord("no version line")
    stop = data.find(_END, at)
    if stop < 0:
        raise BrokenRecord("headers have no end")
    headers = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BrokenRecord("header without a colon")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise BrokenRecord("no content length")
    begin = stop + 4
    end = begin + int(length)
    if data[end : end + 4] != _END:
        raise BrokenRecord("wrong length or cut")
    block = data[begin:end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha1:"):
        if digest[5:] != base64.b32encode(hashlib.sha1(payload_of(headers, block)).digest()).decode():
            raise BrokenRecord("payload digest differs")
    check = data.rfind(_CHECK, at, stop)
    if check >= 0 and data[check + len(_CHECK) : stop] != b"%08x" % zlib.crc32(block, zlib.crc32(data[at:check])):
        raise BrokenRecord("record checksum differs")
    return headers, block, end + 4


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    return block.partition(_END)[2] if headers.get("content-type", "").startswith("application/http") else block


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What a gzip member at a place holds, as far as it can be decompressed, its end if it is whole, else the reason."""
    z, out, k, step, faulty = zlib.decompressobj(31), [], at, _INFLATE_STEPS[0], False
    while k < len(data) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(data[k : k + step]))
            k += step
            step = step if faulty else min(2 * step, _INFLATE_STEPS[1])
        except zlib.error as error:
            if step == 1:
                return b"".join(out), None, f"gzip: {error}"
            z, step, faulty = before, max(1, step // 16), True  # once more in smaller steps, for the bytes before the fault
    return (b"".join(out), min(k, len(data)) - len(z.unused_data), "") if z.eof else (b"".join(out), None, "gzip: cut")


def _records(plain: bytes) -> tuple[list[tuple[dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """The valid records of decompressed bytes, and the gaps between them; after a failed check the next version line is tried."""
    found, gaps, k = [], [], 0
    while k < len(plain):
        try:
            headers, block, end = parse_record(plain, k)
        except BrokenRecord as error:
            begin, reason, end = k, str(error), len(plain)
            for m in _VERSION.finditer(plain, k + 1):
                try:
                    parse_record(plain, m.start())
                except BrokenRecord:
                    continue
                end = m.start()
                break
            gaps.append((begin, end, reason))
        else:
            found.append((headers, block))
        k = end
    return found, gaps


def _at(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int | None, list[str]]:
    """All valid records of the gzip member, or the plain record, at a place, its end if it is whole, and the failed checks."""
    if data[at : at + 2] != b"\x1f\x8b":
        try:
            headers, block, end = parse_record(data, at)
        except BrokenRecord as error:
            return [], None, [str(error)]
        return [(headers, block)], end, []
    plain, end, reason = _inflate(data, at)
    found, gaps = _records(plain)
    if end is None and reason != "gzip: cut":
        found = [(headers, block) for headers, block in found if "record-crc32" in headers]  # others may have damaged headers
    return found, end, [*[reason] * (end is None), *(f"bytes {b} to {e} of the member: {why}" for b, e, why in gaps)]


def salvage(data: bytes) -> tuple[list[tuple[int, dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """Every valid record (place, headers, block) and every quarantined gap (begin, end, reason).

    A record in a member has the member's place. Of a member with a fault the valid records are kept, also those
    before a cut; the gap is then the whole member and its reason says which decompressed bytes were passed over. Where the
    member's own checksum or codes are wrong, only records with a checksum of their own count, as all written here have.
    """
    records, gaps, at = [], [], 0
    while at < len(data):
        found, end, faults = _at(data, at)
        records += [(at, headers, block) for headers, block in found]
        if end is None:
            end = len(data)
            for m in _STARTS.finditer(data, at + 1):
                more, whole, _ = _at(data, m.start())
                if more or whole is not None:
                    end = m.start()
                    break
        if faults:
            gaps.append((at, end, "; ".join(faults)))
        at = end
    return records, gaps


def read_archives(archives: DataFrame) -> DataFrame:
    """Per record: archive, place, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A quarantined gap is a row of record_type 'gap' with its first byte in place, its size in payload_bytes and
    the failed check in payload_digest. Null data give nothing.
    """
    names = ["archive", "place", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    number = lambda text: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", text)) else None

    def run(batches):
        for batch in batches:
            for archive, value in zip(*batch.columns):
                rows = []
                records, gaps = salvage(value.as_py() or b"")
                for place, headers, block in records:
                    kind = headers.get("warc-type", "")
                    if kind == "warcinfo":
                        continue
                    payload = payload_of(headers, block) if kind == "response" else None
                    size = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", block)
                    n = len(payload) if payload is not None else int(size[1]) if size else None
                    digest = headers.get("warc-payload-digest", "")
                    bare = hashlib.sha1(payload).hexdigest() if payload is not None else base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
                    rows.append((archive.as_py(), place, number(headers.get("warc-record-id", "")), headers.get("warc-target-uri"), kind, number(headers.get("warc-refers-to", "")), n, bare, payload))
                rows += [(archive.as_py(), b, None, None, "gap", None, e - b, why, None) for b, e, why in gaps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "archive string, place long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return archives.select("archive", "data").mapInArrow(run, schema)


def round_trip(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Pages to archives in a table and back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per page, repeated rows and null ids included; an empty table gives none. Texts of any length are one
    record. The archives were written here, so a quarantined gap in them is an error and ends the query.
    """
    archives = stage(write_archives(pages, revisit_from), "warc")
    whole = F.when(F.col("record_type") == "gap", F.raise_error(F.concat(F.lit("gap in an archive: "), "payload_digest"))).otherwise(F.col("record_type"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", whole.alias("record_type"), "refers_to")
