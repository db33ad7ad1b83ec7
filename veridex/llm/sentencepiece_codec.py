"""SentencePiece encoding that keeps source offsets, and decoding.

The text is normalised by longest prefixes through the model's compiled character map (a double-array trie and
a block of replacement strings). For every normalised byte the place of its source is recorded, so that each
piece, whose length in normalised bytes is known, is projected to a span of original UTF-8 bytes. The normalised
text is cut into pieces by the library, under the model without its own normaliser, so every id comes from
what the map made of the text; tests hold ids and decoded texts against the library's whole encoder.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Distinct words whose pieces a Python worker remembers; the memory is emptied when full.
REMEMBERED = 300_000

#: Normalised texts in which a cut at each space and line feed could separate what the model may join.
_UNSAFE = re.compile(f"{SPACE}{SPACE}|\\A[^{SPACE}]|{SPACE}\\Z")
_workers: dict = {}


class CharacterMap:
    """The compiled character map: 4 bytes with the trie's size, the trie's 32-bit units, then zero-ended replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4) if size else ()
        self.texts = compiled[4 + size :]
        #: Whether a mapped string begins with a byte.
        self.begins = np.zeros(256, bool)
        if self.units:
            base = (self.units[0] >> 10) << ((self.units[0] & 0x200) >> 6)
            self.begins[:] = [(at := base ^ b) < len(self.units) and self.units[at] & 0x800000FF == b for b in range(256)]

    def swaps(self, data: bytes) -> list[tuple[int, int, bytes]]:
        """(place, bytes taken, replacement) of the longest mapped prefixes, from left to right."""
        found, end = [], 0
        for at in np.flatnonzero(self.begins[np.frombuffer(data, np.uint8)]).tolist():
            if at >= end:
                piece, taken = self.longest(data, at)
                if taken:
                    found.append((at, taken, piece))
                    end = at + taken
        return found

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest mapped prefix at a place and the bytes it takes; (b"", 0) without one."""
        units, best = self.units, (b"", 0)
        if not units:
            return best
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= offset(unit)
            if unit & 0x100:
                start = units[node] & 0x7FFFFFFF
                best = (self.texts[start : self.texts.index(b"\0", start)], k + 1 - at)
        return best


class Codec:
    """Encodes, projects and decodes with one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        own = [p.piece for p in proto.pieces if p.type == p.USER_DEFINED]
        if own:
            raise ValueError("models with user-defined symbols, which pass the map, aren't supported")
        plain = [p.piece for p in proto.pieces if p.type == p.NORMAL]
        bare = pb.ModelProto()
        bare.CopyFrom(proto)
        bare.normalizer_spec.precompiled_charsmap = b""
        bare.normalizer_spec.add_dummy_prefix = bare.normalizer_spec.remove_extra_whitespaces = bare.normalizer_spec.escape_whitespaces = False
        #: The model for texts that are normalised already.
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        #: Bytes of each id's surface in the normalised text.
        self.length = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int32)
        # a text can be cut before each space and around each line feed if no piece reaches over such a place
        self.cuts = (
            self.escape and not self.suffix and proto.trainer_spec.byte_fallback and proto.trainer_spec.model_type == proto.trainer_spec.BPE
            and not any("\n" in p or SPACE in p.lstrip(SPACE) for p in plain)
        )
        #: By word its ids, as bytes of 32-bit numbers.
        self.known: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(len(proto.pieces))]

    # --- normalisation ---------------------------------------------------------------

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, the original byte that it comes from."""
        data = text.encode()
        swaps = self.map.swaps(data)
        if swaps or self.squeeze:
            return self._rewritten(data, {at: (piece, taken) for at, taken, piece in swaps})
        # the map changes nothing here: only spaces are escaped
        space = SPACE.encode() if self.escape else b" "
        raw = np.frombuffer(data, np.uint8)
        source = np.repeat(np.arange(len(raw) + 1, dtype=np.int32), np.append(np.where(raw == 32, len(space), 1), 1))
        body = data.replace(b" ", space)
        if self.dummy and data:
            if self.suffix:
                return body + space, np.concatenate([source[:-1], np.full(len(space), len(raw), np.int32), source[-1:]])
            return space + body, np.concatenate([np.zeros(len(space), np.int32), source])
        return body, source

    def _rewritten(self, data: bytes, swaps: dict[int, tuple[bytes, int]]) -> tuple[bytes, np.ndarray]:
        """normalise where strings are replaced or white space is squeezed, character by character."""
        space = SPACE.encode() if self.escape else b" "
        out, source, at, was_space = bytearray(), [], 0, self.squeeze
        started = False
        while at < len(data):
            piece, taken = swaps.get(at, (b"", 0))
            if not taken:
                taken = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                piece = data[at : at + taken]
            if self.squeeze and was_space:
                piece = piece.lstrip(b" ")
            if piece:
                if not started:
                    started = True
                    if self.dummy and not self.suffix:
                        out += space
                        source += [at] * len(space)
                for byte in piece:
                    new = space if byte == 32 else bytes([byte])
                    out += new
                    source += [at] * len(new)
                was_space = self.squeeze and piece.endswith(b" ")
            at += taken
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = source[-len(space)]
                del source[-len(space) :]
        if self.dummy and self.suffix and started:
            out += space
            source += [at] * len(space)
        return bytes(out), np.array([*source, at], np.int64)

    # --- encoding --------------------------------------------------------------------

    def _learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(parts)
        for i in range(0, len(new), 5000):
            some = new[i : i + 5000]
            # a part that doesn't begin with a space follows a line feed
            found = self.bare.encode([p if p[:1] == SPACE else "\n" + p for p in some], num_threads=1)
            ends = list(accumulate(map(len, found)))
            flat = np.fromiter(chain.from_iterable(found), np.int32, ends[-1]).tobytes()
            self.known.update((p, flat[4 * (e - len(ids)) : 4 * e]) for p, ids, e in zip(some, found, ends))

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """Of every text its ids, and (begin, end) in original bytes of every piece."""
        normals = [self.normalise(text) for text in texts]
        cut: list[list[str] | None] = []
        parts: set[str] = set()
        for normal, _ in normals:
            whole = normal.decode()
            if not self.cuts or not whole or _UNSAFE.search(whole):
                cut.append(None)
            else:
                pieces = whole.replace(SPACE, "\n" + SPACE).split("\n")[1:]
                parts.update(pieces)
                cut.append(pieces)
        self._learn(parts)
        out, known = [], self.known
        for (normal, source), pieces in zip(normals, cut):
            if pieces is None:
                found = self.bare.encode(normal.decode()) if normal else []
                ends = self._ends(normal, found)
            else:
                ids = np.frombuffer(b"".join([known[p] for p in pieces]), np.int32)
                found, ends = ids.tolist(), np.cumsum(self.length[ids])
            bounds = source[np.concatenate([[0], ends])]
            out.append((found, np.stack([bounds[:-1], bounds[1:]], axis=1)))
        return out

    def _ends(self, normal: bytes, ids: list[int]) -> np.ndarray:
        """The end of every piece in the normalised bytes; where an unknown character has no piece, the next known place."""
        ends = np.cumsum(self.length[np.array(ids, np.int64)]) if ids else np.zeros(0, np.int64)
        return self._unknown_ends(normal, ids) if len(ids) and ends[-1] != len(normal) else ends

    def _unknown_ends(self, normal: bytes, ids: list[int]) -> np.ndarray:
        """Ends in the normalised bytes where an unknown id stands for the bytes up to where the next known piece fits."""
        unknown, at, ends = self.sp.unk_id(), 0, []
        for k, one in enumerate(ids):
            if one != unknown:
                at += int(self.length[one])
            elif k + 1 == len(ids):
                at = len(normal)
            else:
                following = self.sp.id_to_piece(ids[k + 1]).encode()
                at = max(at + 1, normal.find(following, at + 1))
            ends.append(min(at, len(normal)))
        return np.array(ends)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def codec(path: str) -> Codec:
    if path not in _workers:
        _workers[path] = Codec(path)
    return _workers[path]


def encode_with_offsets(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, begins and ends: every piece with its span of original UTF-8 bytes.

    A null text counts as empty and has no pieces. Repeated rows give repeated rows, an empty table none; texts have
    no greatest length. Other columns are not read.
    """

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = c.encode(texts)
                spans = [pa.array([s[:, k] for _, s in found], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ids for ids, _ in found], pa.list_(pa.int32())), *spans], ["doc_id", "ids", "begins", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text, no ids an empty one. Other columns are not read."""

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            texts = [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the counts and hashes of its ids, of the decoded text and of the projected spans.

    doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 (of little-endian 32-bit begins and ends, piece by
    piece). The pieces themselves stay in the worker, so that memory holds a few documents at a time.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = c.encode(texts)
                back, decimal = c.sp.decode([ids for ids, _ in found]), c.decimal
                rows = [(len(ids), sha(",".join([decimal[i] for i in ids])), sha(text), zlib.crc32(spans.astype("<u4").tobytes())) for (ids, spans), text in zip(found, back)]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
