import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.conftest import EDGES
from veridex.llm import media


def mulaw_by_rule(code):
    code = ~code & 0xFF
    size = (((code & 15) * 8 + 132) * 2 ** (code // 16 % 8)) - 132
    return -size if code >= 128 else size


def test_tables():
    table = media.mulaw_table()
    assert [int(x) for x in table] == [mulaw_by_rule(c) for c in range(256)]
    assert table[0] == -32124 and table[0x80] == 32124 and table[0xFF] == 0
    a = media.alaw_table()
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256 and len(set(a.tolist())) == 256


def adpcm_by_hand(data, block):
    """One block after the other, one nibble after the other."""
    out = []
    for b in range(0, len(data), block):
        if len(data) - b < 4:
            break
        value = int.from_bytes(data[b : b + 2], "little", signed=True)
        index = min(data[b + 2], 88)
        out.append(value)
        for byte in data[b + 4 : b + block]:
            for nibble in (byte & 15, byte >> 4):
                step = int(media._STEP[index])
                change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                index = max(0, min(88, index + int(media._INDEX[nibble])))
                out.append(value)
    return out


def test_adpcm_matches_the_sequential_decoder():
    data = np.random.default_rng(1).integers(0, 256, 64 * 9 + 5, dtype=np.uint8).tobytes()
    assert media.decode_adpcm(data, 64).tolist() == adpcm_by_hand(data, 64)
    assert len(media.decode_adpcm(b"", 64)) == 0
    for cut in range(64 * 2, 64 * 3):
        assert media.decode_adpcm(data[:cut], 64).tolist() == adpcm_by_hand(data[:cut], 64)
    files = [data[:k] for k in (0, 3, 64, 100, 300, 581)]
    assert [x.tolist() for x in media.decode_many(files, 64)] == [adpcm_by_hand(f, 64) for f in files]


def test_adpcm_round_trip_is_close():
    tone = (8000 * np.sin(np.arange(4000) / 20)).astype(np.int16)
    back = media.decode_adpcm(media.encode_adpcm(tone))
    assert np.abs(back[: len(tone)].astype(int) - tone).mean() < 120 and set(back[len(tone) :].tolist()) != {0}
    assert len(media.encode_adpcm(np.zeros(0, np.int16))) == 256


@pytest.mark.parametrize("law", [media.PCM, media.ALAW, media.MULAW, media.ADPCM])
def test_wave_round_trip(law):
    data = bytes(range(256)) * 2
    assert media.read_wave(media.wave(data, law)) == (law, 8000, 256 if law == media.ADPCM else 2 if law == media.PCM else 1, data)


def test_broken_waves():
    with pytest.raises(ValueError):
        media.read_wave(media.wave(b"abcd", media.MULAW)[:-1])
    with pytest.raises(ValueError):
        media.read_wave(b"")


def test_resampling():
    up = media.resample(np.array([0, 100, -100], np.int16), 8000, 16000)
    assert up.tolist() == [0, 50, 100, 0, -100, -100]
    assert media.resample(np.arange(6, dtype=np.int16), 16000, 8000).tolist() == [0, 2, 4] and len(media.resample(np.zeros(0, np.int16), 8000, 16000)) == 0


def expected(text):
    data = (text or "").encode()
    payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def feature(text):
    """The feature by plain rules: decode, take every other sample, describe."""
    data = (text or "").encode()
    payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
    law = (media.MULAW, media.ALAW, media.ADPCM)[zlib.crc32(payload) % 3]
    pcm = adpcm_by_hand(payload, 64) if law == media.ADPCM else [int((media.mulaw_table() if law == media.MULAW else media.alaw_table())[c]) for c in payload]
    pcm = pcm[: len(pcm) // 2 * 2 : 2]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
    crc = zlib.crc32(np.array(pcm, "<i2").tobytes())
    stored = media.wave(payload, law, block=64)
    return f"n={len(pcm)};peak={max(map(abs, pcm))};ms={sum(x * x for x in pcm) // len(pcm)};zc={crossings};crc={crc:08x}", len(stored), hashlib.sha256(stored).hexdigest()


def test_texts_as_audio(spark, sf, edges, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = media.texts_as_audio(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])
    few = [r for r in rows if len(texts[r.doc_id] or "") < 3000][:60]
    assert len(few) == 60 and all((r.feature, r.media_bytes, r.media_sha256) == feature(texts[r.doc_id]) for r in few)
    found = media.texts_as_audio(edges).collect()
    assert all((r.feature, r.media_bytes, r.media_sha256) == feature(dict(EDGES)[r.doc_id]) for r in found)
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == sorted((i or 0, *expected(t)) for i, t in EDGES)
    assert len({(r.feature, r.media_sha256) for r in found if r.doc_id in (4, 5)}) == 1
    assert media.texts_as_audio(nothing).count() == 0


def test_stored_pcm(spark):
    adpcm = media.wave(media.encode_adpcm(np.arange(600, dtype=np.int16)), media.ADPCM)
    df = spark.createDataFrame([(1, media.wave(b"\x80\xff" * 50, media.MULAW)), (2, None), (3, b"junk"), (4, adpcm)], "k int, media binary")
    out = {r.k: r.pcm_media for r in media.to_pcm(df).collect()}
    assert out[2] is None and out[3] is None
    assert media.read_wave(bytes(out[1]))[:2] == (media.PCM, 16000) and len(media.samples(bytes(out[1]))) == 200
    assert len(media.samples(bytes(out[4]))) == 2 * 2 * 505


def test_every_decoder_is_on_the_querys_path(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    stored = media.to_pcm(media.store_texts(docs), rate=media.PCM_RATE).collect()
    assert {media.read_wave(bytes(r.media))[0] for r in stored} == {media.MULAW, media.ALAW, media.ADPCM}
    assert {media.read_wave(bytes(r.pcm_media))[:2] for r in stored} == {(media.PCM, 4000)}


def test_work_in_slices(spark, monkeypatch):
    pcm = np.random.default_rng(5).integers(-32768, 32767, 5000).astype(np.int16)
    whole = media.resample(pcm, 8000, 16000), media.resample(pcm, 8000, 6000), media.describe(pcm)
    monkeypatch.setattr(media, "SLICE", 77)
    assert (whole[0] == media.resample(pcm, 8000, 16000)).all() and (whole[1] == media.resample(pcm, 8000, 6000)).all() and whole[2] == media.describe(pcm)


def test_a_text_beyond_four_megabytes(spark):
    text = "hello world " * 400_000
    r = media.texts_as_audio(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).where("doc_id = 1").first()
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(text)


def test_an_output_name_that_is_taken(spark):
    df = spark.createDataFrame([(bytearray(b"old"), media.wave(b"\x80" * 10, media.ALAW), 5)], "pcm_media binary, media binary, k int")
    out = media.to_pcm(df)
    assert out.columns == ["media", "k", "pcm_media"] and media.read_wave(bytes(out.first().pcm_media))[1] == 16000


def by_rule(text, rate=8000):
    """PCM at 8 or 16 kHz of a stored text by plain rules."""
    payload = (text or "").encode()
    payload += b"\0" * (max(64, -(-len(payload) // 64) * 64) - len(payload))
    law = (media.MULAW, media.ALAW, media.ADPCM)[zlib.crc32(payload) % 3]
    pcm = adpcm_by_hand(payload, 64) if law == media.ADPCM else [int((media.mulaw_table() if law == media.MULAW else media.alaw_table())[c]) for c in payload]
    return pcm if rate == 8000 else [x for a, b in zip(pcm, pcm[1:] + pcm[-1:]) for x in (a, (a + b) // 2)]


def test_no_sample_is_left_out(spark, edges):
    """The stored PCM holds the original's samples and those between, and pcm_feature describes them all."""
    for r in media.texts_as_audio(edges).collect():
        pcm = by_rule(dict(EDGES)[r.doc_id], 16000)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        assert r.pcm_feature == f"n={len(pcm)};peak={max(map(abs, pcm))};ms={sum(x * x for x in pcm) // len(pcm)};zc={crossings};crc={zlib.crc32(np.array(pcm, '<i2').tobytes()):08x}"
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    for r in media.to_pcm(media.store_texts(docs), rate=media.STORED_RATE, packed=True).collect():
        pcm, rate = media.unpack(bytes(r.pcm_media))
        assert rate == 16000 and pcm[::2].tolist() == by_rule(f"text {r.doc_id}") and pcm.tolist() == by_rule(f"text {r.doc_id}", 16000)


def test_packed_pcm_is_lossless(monkeypatch):
    rng = np.random.default_rng(9)
    noise = rng.integers(-32768, 32768, 1001).astype(np.int16)
    tables = [media.expand(rng.integers(0, 256, 500, dtype=np.uint8).tobytes(), law) for law in (media.MULAW, media.ALAW)]
    cases = [noise, noise[:1000], noise[:1], noise[:2], noise[:0], np.array([-32768, 32767] * 40, np.int16), *tables, *(media.resample(x, 8000, to) for x in (noise, *tables) for to in (16000, 24000, 6000, 4000))]
    for size in (media.SLICE, 7):
        monkeypatch.setattr(media, "SLICE", size)
        for pcm in cases:
            back, rate = media.unpack(media.pack(pcm, 8000))
            assert rate == 8000 and back.dtype == np.int16 and back.tolist() == pcm.tolist()
    assert len(media.pack(media.resample(tables[0], 8000, 16000), 16000)) < 520
    with pytest.raises(ValueError):
        media.unpack(media.pack(noise, 8000)[:-1])


def test_resampling_by_whole_factors_follows_the_general_rule(monkeypatch):
    pcm = np.random.default_rng(3).integers(-32768, 32768, 501).astype(np.int16)
    for rate, to in ((8000, 16000), (16000, 4000), (8000, 4000), (16000, 8000)):
        want = [(int(pcm[k * rate // to]) * (to - k * rate % to) + int(pcm[min(k * rate // to + 1, 500)]) * (k * rate % to)) // to for k in range(501 * to // rate)]
        assert media.resample(pcm, rate, to).tolist() == want
