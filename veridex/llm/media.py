"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM to resampled PCM.

Companded samples expand through 256-entry tables made from the standard's rule. ADPCM blocks are decoded side by
side, also those of different files: one numpy step takes the same nibble of every block. Stored media are WAVE files,
one per row; their resampled PCM is stored beside them, as a WAVE file of its own or packed without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from veridex.llm.common import stage

RATE, PCM, ALAW, MULAW, ADPCM = 8000, 1, 6, 7, 17
BLOCK = 64
#: The rate of the PCM that the query stores and describes in pcm_feature; no sample of the 8 kHz original is left out.
STORED_RATE = 16000
#: The rate that the shorter column `feature` describes, resampled from the stored PCM.
PCM_RATE = 4000
#: Samples that one step of resampling or describing works on, and bytes of files that are decoded at once.
SLICE = 1 << 20
#: Level of the stored table's compression: at 3, the default, it takes about a tenth more room.
ZSTD_LEVEL = 6
_LAWS = (MULAW, ALAW, ADPCM)

# Fixed values of the IMA ADPCM standard: index changes by nibble.
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


# The 89 step sizes of the standard.
_STEP = np.array(
    (
        "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 "
        "1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767"
    ).split(),
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte: inverted bits are sign, 3 of exponent, 4 of mantissa, with a bias of 132."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law byte: every other bit is inverted; the lowest segment is linear."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = a >> 4 & 7, (a & 15) << 4
    size = np.where(exponent, (mantissa + 0x108) << np.maximum(exponent - 1, 0), mantissa + 8)
    return np.where(a & 0x80, size, -size).astype(np.int16)


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def expand(samples: bytes, law: int) -> np.ndarray:
    return _TABLES[law][np.frombuffer(samples, np.uint8)]


def decode_adpcm(data: bytes, block: int = 256) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks (2 bytes first sample, 1 byte index, 1 unused, nibbles low first), a short last one included."""
    return decode_many([data], block)[0]


def decode_many(files: list[bytes], block: int = 256) -> list[np.ndarray]:
    """PCM of several files with blocks of one size; all blocks are decoded at once. Of a short last block the first sample needs 4 bytes."""
    sizes = [-(-len(data) // block) for data in files]
    rows = np.frombuffer(b"".join(data + b"\0" * (n * block - len(data)) for data, n in zip(files, sizes)), np.uint8).reshape(-1, block)
    width = 1 + 2 * (block - 4)
    out = np.empty((width, len(rows)), np.int16)  # a row per place in the block, so that each step writes one run of memory
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2], 88).astype(np.int32)
    out[0] = value
    for k in range(width - 1):
        nibble = (rows[:, 4 + k // 2] >> (4 * (k & 1))).astype(np.int32) & 15
        step = _STEP[index]
        change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + _INDEX[nibble], 0, 88)
        out[k + 1] = value
    found, at = [], 0
    for data, n in zip(files, sizes):
        last = len(data) - (n - 1) * block if n else 0
        short = 0 if last < 4 else 1 + 2 * (last - 4)
        found.append(out[:, at : at + n].T.ravel()[: max(0, n - 1) * width + short])
        at += n
    return found


def encode_adpcm(pcm: np.ndarray, block: int = 256) -> bytes:
    """The matching encoder, also across blocks; the last block is filled with its last sample."""
    width = 1 + 2 * (block - 4)
    n = max(1, -(-len(pcm) // width))
    full = np.concatenate([pcm, np.full(n * width - len(pcm), pcm[-1] if len(pcm) else 0, np.int16)]).reshape(n, width).astype(np.int32)
    rows = np.zeros((n, block), np.uint8)
    value, index = full[:, 0].copy(), np.zeros(n, np.int32)
    rows[:, :2] = full[:, 0].astype("<i2")[:, None].view(np.uint8)
    for k in range(width - 1):
        step, gap = _STEP[index], full[:, k + 1] - value
        left, nibble, change = np.abs(gap), np.zeros(n, np.int32), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = left >= part
            nibble += bit * take
            left -= part * take
            change = change + part * take
        value = np.clip(value + np.where(gap < 0, -change, change), -32768, 32767)
        nibble += 8 * (gap < 0)
        index = np.clip(index + _INDEX[nibble], 0, 88)
        rows[:, 4 + k // 2] |= (nibble << (4 * (k & 1))).astype(np.uint8)
    return rows.tobytes()


def _middle(pcm: np.ndarray) -> np.ndarray:
    """The interpolated value after every sample; the last one is held. Works in slices."""
    out = np.empty(len(pcm), np.int16)
    for k in range(0, len(pcm), SLICE):
        part = pcm[k : k + SLICE + 1].astype(np.int32)
        after = part[1:] if len(part) > SLICE else np.append(part[1:], part[-1:])
        out[k : k + SLICE] = (part[:SLICE] + after) >> 1
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers: output k lies at k * rate / to; the last sample is held. Works in slices."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    if rate % to == 0:
        return np.ascontiguousarray(pcm[:: rate // to][: len(pcm) * to // rate], np.int16)
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2], out[1::2] = pcm, _middle(pcm)
        return out
    out = np.empty(len(pcm) * to // rate, np.int16)
    for first in range(0, len(out), SLICE):
        at = np.arange(first, min(first + SLICE, len(out)), dtype=np.int64) * rate
        left, part = at // to, at % to
        after = pcm[np.minimum(left + 1, len(pcm) - 1)]
        out[first : first + SLICE] = (pcm[left] * (to - part) + after * part) // to
    return out


# --- packed PCM ------------------------------------------------------------------------

_PACKED = struct.Struct("<IQBB")


def _codes(law: int) -> np.ndarray:
    """By 16-bit value: the byte that a law has for it, or -1."""
    out = np.full(1 << 16, -1, np.int16)
    out[_TABLES[law].view(np.uint16)] = np.arange(256)
    return out


_CODES = {law: _codes(law) for law in _TABLES}


def pack(pcm: np.ndarray, rate: int) -> bytes:
    """PCM of any kind without loss, as a predictive coder stores it; zero gaps and companded values take less room.

    Every other sample is stored in 16 bits, or as a law's bytes if all of them are values of that law; of the samples
    between, the gaps to their neighbours' middle are stored, if there are any.
    """
    even = np.ascontiguousarray(pcm[::2], np.int16)
    gaps = pcm[1::2] - _middle(even)[: len(pcm) // 2]  # wraps, as its reverse does
    form, body = PCM, even.astype("<i2").tobytes()
    for law, codes in _CODES.items():
        found = codes[even.view(np.uint16)]
        if (found >= 0).all():
            form, body = law, found.astype(np.uint8).tobytes()
            break
    return _PACKED.pack(rate, len(pcm), form, bool(gaps.any())) + body + (gaps.astype("<i2").tobytes() if gaps.any() else b"")


def unpack(data: bytes) -> tuple[np.ndarray, int]:
    """(PCM, rate) that pack stored. Raises ValueError if the bytes aren't whole."""
    rate, n, form, gaps = _PACKED.unpack_from(data)
    half, width = n - n // 2, 2 if form == PCM else 1
    if len(data) != _PACKED.size + half * width + 2 * (n // 2) * gaps:
        raise ValueError("packed PCM isn't whole")
    even = np.frombuffer(data, "<i2" if form == PCM else np.uint8, half, _PACKED.size)
    out = np.empty(n, np.int16)
    out[::2] = even if form == PCM else _TABLES[form][even]
    out[1::2] = _middle(out[::2])[: n // 2]
    if gaps:
        out[1::2] += np.frombuffer(data, "<i2", n // 2, _PACKED.size + half * width)
    return out, rate


# --- WAVE ------------------------------------------------------------------------------


def wave(data: bytes, law: int, rate: int = RATE, block: int = 256) -> bytes:
    """A mono WAVE file; the data are padded to an even length as the format asks."""
    if law == ADPCM:
        samples, per = len(data) // block * (2 * (block - 4) + 1), 2 * (block - 4) + 1
        head = struct.pack("<HHIIHHHH", law, 1, rate, rate * block // per, block, 4, 2, per)
    else:
        width = 2 if law == PCM else 1
        samples = len(data) // width
        head = struct.pack("<HHIIHHH", law, 1, rate, rate * width, width, 8 * width, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """(law, rate, block, data). Raises ValueError if the file isn't whole."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] != len(media) - 8:
        raise ValueError("not a whole WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        found[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    law, _, rate, _, block = struct.unpack_from("<HHIIH", found[b"fmt "])
    return law, rate, block, found[b"data"]


def samples(media: bytes, to: int | None = None) -> np.ndarray:
    """PCM of a mono WAVE file of any of the four kinds, resampled if asked."""
    pcm, rate = _decoded([media])[0]
    return resample(pcm, rate, to) if to else pcm


def _decoded(files: list[bytes | None]) -> list[tuple[np.ndarray, int] | None]:
    """(PCM, rate) of every file, ADPCM files of one block size together; None for what is null or broken, alone or not at all."""
    out: list = [None] * len(files)
    adpcm: dict[int, list[tuple[int, bytes, int]]] = {}
    for k, media in enumerate(files):
        try:
            law, rate, block, data = read_wave(media or b"")
        except (ValueError, KeyError, struct.error):
            if len(files) == 1:
                raise
            continue
        if law == ADPCM and block > 4:
            adpcm.setdefault(block, []).append((k, data, rate))
        elif law in _TABLES:
            out[k] = expand(data, law), rate
        elif law == PCM:
            out[k] = np.frombuffer(data, "<i2", len(data) // 2), rate
    for block, rows in adpcm.items():
        for (k, _, rate), pcm in zip(rows, decode_many([data for _, data, _ in rows], block)):
            out[k] = pcm, rate
    return out


def _parts(column: pa.Array):
    """Ranges [i, j) of binary or text rows of about SLICE bytes, or one longer row."""
    size = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy()
    ends, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, "right")))
        yield i, j
        i = j


def to_pcm(media: DataFrame, column: str = "media", rate: int = 16000, output: str = "pcm_media", packed: bool = False) -> DataFrame:
    """Adds the resampled PCM as a column to a table with stored media, as WAVE files or packed; null and broken media give null.

    Files may have any length. A column that is named like the output is replaced; all others stay.
    """
    others = [k for k, c in enumerate(media.columns) if c != output]
    at = media.columns.index(column)

    def form(pcm):
        return pack(pcm, rate) if packed else wave(pcm.astype("<i2").tobytes(), PCM, rate)

    def run(batches):
        for batch in batches:
            for i, j in _parts(batch.column(at)):
                part = batch.slice(i, j - i)
                files = [v.as_py() for v in part.column(at)]
                try:
                    found = _decoded(files)
                except (ValueError, KeyError, struct.error):
                    found = [None]
                out = [x and form(resample(x[0], x[1], rate)) for x in found]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in others), pa.array(out, pa.binary())], [*(batch.schema.names[k] for k in others), output])

    return media.mapInArrow(run, StructType([*(media.schema.fields[k] for k in others), StructField(output, BinaryType())]))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, zero-filled to a positive multiple of 64, as samples of a WAVE file.

    The bytes are mu-law samples, A-law samples or ADPCM blocks of 64 bytes, as their checksum says, so equal texts
    are stored alike; any bytes are valid in all three.
    """

    def run(batches):
        for batch in batches:
            for i, j in _parts(batch.column(1)):
                part = batch.slice(i, j - i)
                sizes, out = [], []
                for text in part.column(1):
                    data = (text.as_py() or "").encode()
                    sizes.append(len(data))
                    data += b"\0" * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))
                    out.append(wave(data, _LAWS[zlib.crc32(data) % len(_LAWS)], block=BLOCK))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe(pcm: np.ndarray) -> str:
    """Integers only, so that equal samples have equal features: samples, peak, mean square, zero crossings, crc32. Works in slices."""
    peak = square = crossings = crc = 0
    for k in range(0, len(pcm), SLICE):
        part = pcm[k : k + SLICE].astype(np.int64)
        peak, square = max(peak, int(np.abs(part).max())), square + int(np.dot(part, part))
        signs = pcm[max(0, k - 1) : k + SLICE] < 0
        crossings += int(np.count_nonzero(signs[1:] != signs[:-1]))
        crc = zlib.crc32(part.astype("<i2").tobytes(), crc)
    return f"n={len(pcm)};peak={peak};ms={square // max(1, len(pcm))};zc={crossings};crc={crc:08x}"


def digest(stored: DataFrame) -> DataFrame:
    """Per stored row (doc_id, n_bytes, media, packed pcm_media) what its bytes hold: doc_id, n_bytes, payload and media sizes and hashes, feature of the stored PCM at PCM_RATE and pcm_feature of all of it."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_feature"]

    def run(batches):
        for batch in batches:
            rows = []
            for value, other in zip(batch.column(2), batch.column(3)):
                media = value.as_py()
                payload = read_wave(media)[3]
                pcm, rate = unpack(other.as_py())
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), describe(resample(pcm, rate, PCM_RATE)), describe(pcm)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, zip(*rows))], names)

    return stored.select("doc_id", "n_bytes", "media", "pcm_media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_feature string")


def texts_as_audio(docs: DataFrame, rate: int = STORED_RATE) -> DataFrame:
    """Stores every text as telephony audio and its resampled PCM in a table, reads both back and describes them.

    Null and empty texts become one block of zeros; repeated rows give repeated rows, equal texts equal values; texts
    may have any length; an empty table gives no rows; other columns are not read.
    """
    return digest(stage(to_pcm(store_texts(docs), rate=rate, packed=True), "media", compression="zstd", options={"parquet.compression.codec.zstd.level": str(ZSTD_LEVEL)}))
