import hashlib
import random
import struct

import pytest
import public_tokenizers
import sentencepiece

from tests.llm.conftest import EDGES, docs_of
from veridex.llm.sentencepiece_codec import CharacterMap, Codec, decode, digest, encode_with_offsets

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b ", "\n", "\na", "a\n b", "a \nb", "▁x ▁", "a▁ b", "日本 語", "\t\ttab", "🎉 é ß", "<s> </s> <unk>", "x" * 300, "a\n\n\nb", "\u0000z"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(library, text):
    ids = library.encode(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")


def test_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digest(docs, PATH).collect()}
    assert found == {r.doc_id: expected(library, r.text or "") for r in docs.collect()}


def test_odd_and_random_texts(spark, library):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab  ▁\né,.1Z") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = {r.doc_id: r for r in encode_with_offsets(docs_of(spark, texts), PATH).collect()}
    for k, text in enumerate(texts):
        r, data = rows[k], text.encode()
        assert r.ids == library.encode(text)
        # spans follow each other from the first byte to the last, and ordinary pieces show their own text
        at = 0
        for one, begin, end in zip(r.ids, r.begins, r.ends):
            assert begin == at and end >= begin
            at = end
            if not library.is_byte(one):
                assert data[begin:end].decode().replace(" ", "▁") == library.id_to_piece(one) or begin == 0
        assert at == len(data) or not r.ids


def test_edges_and_decoding(spark, edges, nothing, library):
    encoded = encode_with_offsets(edges, PATH)
    back = sorted((r.doc_id or 0, r.text) for r in decode(encoded, PATH).collect())
    assert back == sorted((i or 0, library.decode(library.encode(t or "")) if t else "") for i, t in EDGES)
    assert digest(nothing, PATH).count() == 0 and digest(edges, PATH).count() == len(EDGES)


def compiled(pairs: dict[bytes, bytes]) -> bytes:
    """A character map built by brute force: a double array in which every node gets a free block of 256 units."""
    texts, places = b"", {}
    for value in pairs.values():
        places[value] = len(texts)
        texts += value + b"\0"
    nodes = {b""} | {k[: i + 1] for k in pairs for i in range(len(k))}
    block = {n: 256 * (i + 1) for i, n in enumerate(sorted(nodes))}
    units = [0] * (256 * (len(nodes) + 1))
    at = {b"": 0}
    for n in sorted(nodes, key=len):
        here = at[n]
        label = n[-1] if n else 0
        offset = here ^ block[n]
        units[here] = label | ((offset << 10) if offset < 1 << 21 else 0) | (0x100 if n in pairs else 0)
        if n in pairs:
            units[block[n]] = 0x80000000 | places[pairs[n]]
        for child in nodes:
            if len(child) == len(n) + 1 and child[:-1] == n:
                at[child] = block[n] ^ child[-1]
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + texts


def test_longest_prefix_normalisation():
    pairs = {"ﬁ".encode(): b"fi", "a".encode(): b"A", "ab".encode(): b"<ab>", "abcd".encode(): b"!", "é".encode(): b"e"}
    m = CharacterMap(compiled(pairs))
    assert m.longest(b"abcx", 0) == (b"<ab>", 2) and m.longest(b"abcd", 0) == (b"!", 4) and m.longest(b"xa", 1) == (b"A", 1)
    assert m.longest(b"x", 0) == (b"", 0) and CharacterMap(b"").longest(b"a", 0) == (b"", 0)
    assert m.swaps(b"xabcab") == [(1, 2, b"<ab>"), (4, 2, b"<ab>")] and CharacterMap(b"").swaps(b"abc") == []
    c = object.__new__(Codec)
    c.map, c.dummy, c.squeeze, c.escape, c.suffix = m, True, True, True, False
    normal, source = c.normalise("  ﬁ  é abcd ")
    assert normal.decode() == "▁fi▁e▁!"
    text = "  ﬁ  é abcd ".encode()
    assert source[3] == 2 and source[4] == 2 and text[source[-2] :][:4] == b"abcd" and len(source) == len(normal) + 1


@pytest.fixture(scope="module")
def mapped(tmp_path_factory):
    """The model with the library's own character map, with and without squeezing of white space."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    rules = pb.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    out = []
    for squeeze in (False, True):
        proto = pb.ModelProto()
        with open(PATH, "rb") as f:
            proto.ParseFromString(f.read())
        proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
        proto.normalizer_spec.remove_extra_whitespaces = squeeze
        path = tmp_path_factory.mktemp("model") / "mapped.model"
        path.write_bytes(proto.SerializeToString())
        out.append(str(path))
    return out


def test_whole_results_on_a_model_with_a_map(spark, sf, mapped):
    rng = random.Random(6)
    odd = ["ﬁne ﬂow", "①②③ ½", "ｆｕｌｌ　ｗｉｄｔｈ", "e\u0301te\u0301", "한국어 각", "㌔ meter", "a\u00a0b\u2003c", "ϓ ﷺ", "\u200bzero", "  ﬁ  ", "\t\n ﬁ"]
    texts = ODD + odd + ["".join(rng.choice("ab  ﬁ①é\u0301ｗ　\n½.1") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for path in mapped:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        assert len(Codec(path).map.units) > 1000
        found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digest(docs_of(spark, texts), path).collect()}
        assert found == {k: expected(library, t) for k, t in enumerate(texts)}
        for r in encode_with_offsets(docs_of(spark, odd), path).collect():
            data, spans = odd[r.doc_id].encode(), list(zip(r.begins, r.ends))
            assert all(0 <= b <= e <= len(data) for b, e in spans) and all(x[1] <= y[1] and x[0] <= y[0] for x, y in zip(spans, spans[1:]))
    c = Codec(mapped[0])
    (_, spans), = c.encode(["a ﬁ b"])
    assert spans[-1].tolist() == [5, 7] and spans[0].tolist()[0] == 0


def test_a_text_beyond_four_megabytes(spark, library):
    text = "lorem ipsum dolor sit amet " * 170_000
    r = digest(docs_of(spark, [text]), PATH).first()
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, text)
