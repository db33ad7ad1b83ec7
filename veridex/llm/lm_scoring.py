"""Language-model scoring by cross-entropy difference.

Two bigram models over one vocabulary, every word of the whole corpus and one unknown word that never occurs:
the background model counts all documents, the target model the documents marked as target. Both are smoothed
alike. Per token the target's loss minus the background's is taken; its mean scores the document, lower being
closer to the target.

Counts of words and bigrams are exact and grow with the corpus; both are known by 64-bit hashes, and no table of
words is held anywhere. Documents are laid out in chunks with a dictionary of their own. Each chunk asks, once per
distinct word and bigram, the bucket that it hashes to; the bucket adds up all chunks' counts and answers each chunk
with the sums. A bigram that fills a third of the corpus is one entry per chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.common import mix, small, stage, steps, utf8, words

#: Stands for the word before a document's first one.
START = np.uint64(0xD1B54A32D192ED03)
CHUNK_TOKENS = 1_400_000
BUCKET_ENTRIES = 1_000_000
#: Weight of the unigram model, in counts.
UNIGRAM_COUNTS = 50.0


def _pack(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed, behind their count."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return np.int64(len(x)).tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    n, size = int(np.frombuffer(blob[:8], np.int64)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _types(chunks: DataFrame) -> int:
    """The number of different words in all chunks."""

    def run(batches):
        for batch in batches:
            for types in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(types.as_py(), np.uint64).view(np.int64))], ["h"])

    return chunks.select("types").mapInArrow(run, "h long").distinct().count()


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk, doc_ids, targets, lengths, types, words: about CHUNK_TOKENS words of whole documents a row, or one longer document.

    types are the distinct word hashes, frequent ones first; words are places in them.
    """

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            targets, lengths, h = (np.concatenate([x[k] for x in held]) for k in range(1, 4))
            types, at, n = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(types), np.uint32)
            place[order] = np.arange(len(types), dtype=np.uint32)
            w = place[at]
            doc_ids = pa.concat_arrays([x[0] for x in held])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (doc_ids, pa.array(targets), pa.array(lengths))]
            blobs = [pa.array([_pack(x)], pa.binary()) for x in (types[order], w)]
            return pa.RecordBatch.from_arrays([*lists, *blobs], ["doc_ids", "targets", "lengths", "types", "words"])

        for batch in batches:
            data, offsets = utf8(batch.column(2))
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in steps(offsets):
                h, _, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append((batch.column(0)[i:j], target[i:j], np.diff(first).astype(np.int64), h))
                size += len(h) + j - i
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    schema = "doc_ids array<long>, targets array<boolean>, lengths array<long>, types binary, words binary"
    return docs.select("doc_id", "is_target", "text").mapInArrow(run, schema).withColumn("chunk", F.monotonically_increasing_id())


class Chunk:
    """A chunk's words and distinct bigrams, always in the same order.

    w is the place of every word in types, pair of every word the bigram that it ends; history and word are the
    bigrams' places in types, history len(types) being the document's start; keys are all types, then all bigrams.
    """

    def __init__(self, types: bytes, words_blob: bytes, lengths: np.ndarray):
        types = _unpack(types, np.uint64)
        self.types = len(types)
        self.w = _unpack(words_blob, np.uint32).astype(np.int64)
        before = np.empty_like(self.w)
        before[1:] = self.w[:-1]
        before[np.concatenate([[0], np.cumsum(lengths)])[:-1][lengths > 0]] = self.types
        pairs, self.pair = np.unique(before * (self.types + 1) + self.w, return_inverse=True)
        self.history, self.word = np.divmod(pairs, self.types + 1)
        firsts = mix(np.append(types, START) + START)
        self.keys = mix(np.concatenate([types, mix(firsts[self.history] ^ types[self.word])]))
        #: Places in keys in ascending order of the keys, and so of their buckets.
        self.order = np.argsort(self.keys, kind="stable")


def _asked(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, keys, n, t: each chunk's words and distinct bigrams by bucket, as ascending steps, with their counts."""

    def run(batches):
        for batch in batches:
            for chunk, targets, lengths, types, blob in zip(*batch.columns):
                size = np.asarray(lengths.values)
                own = Chunk(types.as_py(), blob.as_py(), size)
                target = np.repeat(np.asarray(targets.values.to_numpy(zero_copy_only=False), float), size)
                ends = ((own.w, own.types), (own.pair, len(own.history)))
                n = np.concatenate([np.bincount(at, minlength=k) for at, k in ends])[own.order]
                t = np.concatenate([np.bincount(at, target, k) for at, k in ends])[own.order]
                keys = own.keys[own.order]
                cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[b], cuts[b + 1])
                    of = (np.diff(keys[part], prepend=np.uint64(0)), n[part].astype(np.uint32), t[part].astype(np.uint32))
                    blobs = [pa.array([_pack(x)], pa.binary()) for x in of]
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)]), pa.array([chunk.as_py()]), *blobs], ["bucket", "chunk", "keys", "n", "t"])

    return chunks.select("chunk", "targets", "lengths", "types", "words").mapInArrow(run, "bucket long, chunk long, keys binary, n binary, t binary")


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """chunk, bucket, n, t: the sums over all chunks, in the order that each chunk asked."""
    keys = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in group["keys"]]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = {"chunk": group["chunk"], "bucket": group["bucket"]}
    for c in ("n", "t"):
        sums = np.bincount(at, np.concatenate([_unpack(x, np.uint32) for x in group[c]]), len(distinct)).astype(np.uint64)
        out[c] = [_pack(x) for x in np.split(sums[at], cuts)]
    return pd.DataFrame(out)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and xent_diff of every row of docs (doc_id, text, is_target), a null is_target being false.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A null, empty or wordless text has no tokens and
    a null score. Repeated rows count and are scored each. Without target documents their model is the uniform one.
    """
    docs = docs.select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    chunks = stage(_chunks(docs), "chunks")
    vocabulary = _types(chunks) + 1
    # documents with words begin with START
    opened = F.filter(F.arrays_zip("targets", "lengths"), lambda x: x["lengths"] > 0)
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["lengths"])
    columns = {"n": opened, "t": F.filter(opened, lambda x: x["targets"])}
    counts = chunks.agg(*[F.sum(f(a)).alias(f"{c}_{what}") for c, a in columns.items() for what, f in (("docs", F.size), ("tokens", size))]).first()
    documents, tokens = ({c: float(counts[f"{c}_{what}"] or 0) for c in columns} for what in ("docs", "tokens"))
    buckets = max(16, int(tokens["n"]) // BUCKET_ENTRIES)
    answers = _asked(chunks, buckets).groupBy("bucket").applyInPandas(lambda group: _answer(group), "chunk long, bucket long, n binary, t binary")

    def total(_, own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0]
        lengths = np.asarray(row["lengths"], np.int64)
        chunk = Chunk(row["types"], row["words"], lengths)
        back = back.sort_values("bucket")
        loss = {}
        for c in ("n", "t"):
            seen = np.empty(len(chunk.keys))
            seen[chunk.order] = np.concatenate([np.zeros(0, np.uint64), *[_unpack(x, np.uint64) for x in back[c]]])
            one, two = seen[: chunk.types], seen[chunk.types :]
            p = (one + 1) / (tokens[c] + vocabulary)
            loss[c] = -np.log((two + UNIGRAM_COUNTS * p[chunk.word]) / (np.append(one, documents[c])[chunk.history] + UNIGRAM_COUNTS))
        sums = np.concatenate([[0.0], np.cumsum((loss["t"] - loss["n"])[chunk.pair])])
        ends = np.cumsum(lengths)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (sums[ends] - sums[ends - lengths]) / lengths
        return pd.DataFrame({"doc_id": pd.array(row["doc_ids"], "Int64"), "n_tokens": lengths, "xent_diff": pd.array(np.where(lengths > 0, mean, 0), "Float64").copy()}).assign(xent_diff=lambda d: d["xent_diff"].mask(d["n_tokens"] == 0))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(total, "doc_id long, n_tokens long, xent_diff double")


def score_against_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores docs against the labelled documents of good quality that aren't toxic."""
    good = labels.where("quality = 1 and toxic = 0").select("doc_id", F.lit(True).alias("is_target")).distinct()
    return score(docs.select("doc_id", "text").join(small(stage(good, "good")), "doc_id", "left"))
