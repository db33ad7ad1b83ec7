"""Packing by shortest-pack-first over the length histogram.

Documents become token ids (byte-level BPE, then an end id) and are cut at multiples of the sequence length.
Only the remainders need packing: their length histogram, which has at most seq_len bins however large the
corpus is, goes to the driver; patterns of lengths are built there and joined back by rank within a length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm.common import stage, utf8

SEQ_LEN = 2048
END_ID = 1
#: Remainders in one ranking group.
GROUP_ROWS = 200_000

#: The pre-tokeniser's rule for texts without adjacent white space; its look-ahead matters only between two of them.
_PLAIN_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of characters that may be white space, or whose class may differ between library versions.
_ODD = np.zeros(256, bool)
_ODD[[0xC2, *range(0xD0, 0x100)]] = True
_workers: dict = {}


def _byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Encoder:
    """Ids of whole texts, equal to the tokenizers library's.

    The vocabulary is a table of merge ranks, so where a text's white space is single and its characters are
    plain, a second implementation gives the same ids several times faster; every other text goes to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        #: A text that holds an added token is cut at it by the library.
        self.added = re.compile("|".join(added)) if added else None
        self.fast = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        """The fast encoder, or None if the file isn't a byte-level vocabulary with ids in the order of its merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            return None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(model["vocab"][m] != 256 + k for k, m in enumerate(merges)):
            return None
        as_byte = _byte_characters()
        ranks = {bytes(as_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("plain", pat_str=_PLAIN_RULE, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        data, offsets = utf8(column)
        white = _WHITE[data]
        odd = _ODD[data]
        odd[1:] |= white[1:] & white[:-1]
        careful = set(np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1).tolist())
        out = []
        for k, text in enumerate(column.to_pylist()):
            if not text:
                ids = []
            elif self.fast is None or k in careful or self.added and self.added.search(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.fast(text)
            out.append(np.array(ids, "<u4"))
        return out


def _encoder(path: str) -> _Encoder:
    if path not in _workers:
        _workers[path] = _Encoder(path)
    return _workers[path]


def cut_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    A null text counts as empty and yields the end id alone. A null doc_id is kept as it is. Rows with equal
    doc_id are separate documents. Columns other than doc_id and text are not read, so they cannot clash.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids

    def run(batches):
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    ids = np.append(ids, end)
                    for start in range(0, len(ids), seq_len):
                        piece = ids[start : start + seq_len]
                        row = (doc_id, start, len(piece), zlib.crc32(piece), len(ids))
                        rows.append((*row, piece.astype(np.int32)) if keep_ids else row)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of sequences) that hold every length as often as the histogram says.

    Lengths go longest first, each time to the shortest open pattern, that is the one with the most room; a new one
    is opened where even that doesn't hold it. The smaller count moves and the rest of either side stays. The work
    depends on the bins, not on the rows.
    """
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                # a new pattern has the most room until it is full, so as many of this length as fit share it
                each = min(seq_len // length, left)
                put(seq_len - each * length, (length,) * each, left // each)
                left -= left // each * each
                continue
            room = rooms[-1]
            pattern, count = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop()
            moved = min(count, left)
            if count > moved:
                put(room, pattern, count - moved)
            put(room - length, (*pattern, length), moved)
            left -= moved
    return [x for room in rooms for x in open_at[room]]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks of the slots in turn, with each slot's first sequence, offset in it and sequence fill."""
    raw: dict[int, list[tuple[int, int, int, int]]] = {}
    base, ranks = 0, {}
    for pattern, count in patterns:
        offset, fill = 0, sum(pattern)
        for length in pattern:
            rank = ranks.get(length, 0)
            raw.setdefault(length, []).append((rank, base, offset, fill))
            ranks[length] = rank + count
            offset += length
        base += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in raw.items()}


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Adds sequence_id, offset, sequence_tokens and padded_tokens to pieces.

    Rank within a length: rows are dealt to groups by a hash; per group and length a count, summed over the
    groups before it, plus the row's place in its own group. So a length that a third of all rows share is
    ranked in many tasks. A sequence is padded to seq_len, except if its tokens are a power of two.
    Ties (equal pieces of equal documents) get distinct places in an arbitrary but single order.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    groups = max(1, -(-total // GROUP_ROWS))
    keyed = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    counts = keyed.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most seq_len rows
    slots = spark.sparkContext.broadcast(_slots(shortest_pack_first(histogram, seq_len)))
    own = Window.partitionBy("_g", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        keyed.withColumn("_own", F.row_number().over(own) - 1)
        .join(counts, ["length", "_g"])
        .withColumn("_rank", F.col("_before") + F.col("_own"))
        .drop("_g", "_before", "_own")
    )
    kept = [f for f in ranked.schema.fields if f.name != "_rank"]

    def place(batches):
        table = slots.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            out = np.zeros((3, len(length)), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                first, base, offset, fill = table[int(one)]
                k = np.searchsorted(first, rank[at], "right") - 1
                out[0, at] = base[k] + rank[at] - first[k]
                out[1, at], out[2, at] = offset[k], fill[k]
            padded = np.where(out[2] & (out[2] - 1), seq_len, out[2])
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (*out, padded))], [f.name for f in kept] + ["sequence_id", "offset", "sequence_tokens", "padded_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long, sequence_tokens long, padded_tokens long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Whole documents to packed pieces; an empty table gives an empty result."""
    pieces = stage(cut_documents(docs, tokenizer_path, seq_len), "pieces")
    return pack(pieces, seq_len)

