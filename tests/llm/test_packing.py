import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES, docs_of
from veridex.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["a  b", " a", "a ", "\n\n", "x\ty", "a b", "a  b", "<|endoftext|> x", "hello <|endoftext|> bye", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "it's we'll 12ab!?", "日本語 テスト", "́e‍ x", "a \n b", "ΑΒΓ ωμέγα", "привет мир", "\x1c\x1d", "a\x85b", "🎉🎉 ok"]


@lru_cache(maxsize=None)
def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, texts):
    """Exact ids in disjoint pieces, gapless sequences, nothing over the length."""
    by_doc = Counter()
    for r in rows:
        ids = ids_of(texts[r.doc_id])
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_doc[r.doc_id] += r.length
    assert by_doc == {k: len(ids_of(t)) for k, t in texts.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.sequence_tokens == at for r in parts)
        assert all(r.padded_tokens == (at if at & (at - 1) == 0 else 2048) for r in parts)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, PATH).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()})
    used = {r.sequence_id: r.sequence_tokens for r in rows}
    assert sum(used.values()) >= 0.98 * 2048 * len(used)


def test_odd_texts_have_the_librarys_ids(spark):
    check(packing.pack_documents(docs_of(spark, ODD), PATH).collect(), dict(enumerate(ODD)))


def test_random_texts_have_the_librarys_ids(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab Ċé'sl1,.\n\tß€") for _ in range(rng.randrange(60))) for _ in range(300)]
    check(packing.pack_documents(docs_of(spark, texts), PATH).collect(), dict(enumerate(texts)))


def test_edges(edges, nothing):
    rows = packing.pack_documents(edges, PATH).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(i for i, _ in EDGES)
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_kept_ids(spark):
    r = packing.cut_documents(docs_of(spark, ["a b c"]), PATH, keep_ids=True).first()
    assert r.ids == ids_of("a b c").tolist()


@pytest.mark.parametrize("seed", range(20))
def test_patterns_hold_the_histogram(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
    patterns = packing.shortest_pack_first(histogram, 64)
    held = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 64 and count > 0
        for length in pattern:
            held[length] += count
    assert held == histogram


def one_by_one(lengths, seq_len):
    """Fill of every sequence, each document in turn going to the shortest pack that is open."""
    packs = []
    for length in sorted(lengths, reverse=True):
        k = min(range(len(packs)), key=packs.__getitem__, default=None)
        if k is None or packs[k] + length > seq_len:
            packs.append(length)
        else:
            packs[k] += length
    return sorted(packs)


@pytest.mark.parametrize("seed", range(20))
def test_patterns_are_those_of_one_document_at_a_time(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 200])
    histogram = {rng.randrange(1, size + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 40))}
    found = sorted(sum(p) for p, n in packing.shortest_pack_first(histogram, size) for _ in range(n))
    assert found == one_by_one([k for k, n in histogram.items() for _ in range(n)], size)


def test_the_shortest_pack_is_the_one_with_the_most_room():
    assert sorted(p for p, n in packing.shortest_pack_first({6: 1, 5: 1, 3: 1}, 10)) == [(5, 3), (6,)]
    assert packing.shortest_pack_first({}, 10) == []


def test_a_text_beyond_one_step(spark):
    text = "lorem ipsum dolor " * 300_000
    rows = packing.pack_documents(docs_of(spark, [text, "x"]), PATH).collect()
    check(rows, {0: text, 1: "x"})
