"""Quality classifier with site evidence by hierarchical empirical Bayes.

A logistic classifier of words and text shape, fitted on a bounded sample of labelled rows, gives each document
the log-odds of being bad. Sites form a tree: global, host, path. Every document of every site counts. A host's
rate of bad documents is shrunk toward the global one, a path's toward its host's, each with a strength found
by the method of moments, so sparse sites follow their parents. The path's posterior then shifts the document's
log-odds by how far the site's rate lies from the one that the classifier was trained under. A document's own
evidence is left out of its host and path, so that it counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridex.llm.common import is_small, mix, release, small, stage, steps, utf8, words

#: Labelled documents to fit on, chosen by a hash of doc_id, and their bytes of text at most.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 64 << 20
BUCKETS = 1 << 18
HEADS = ("low_quality", "toxic")
_ODDS = ("_low", "_toxic")
#: Tasks that a site's rows are dealt to where there are too many sites to broadcast.
SALT = 32
REJECT_FROM = 0.5

# ASCII classes of the shape features.
_CLASS = np.zeros((4, 256), bool)
_CLASS[0, list(b"0123456789")] = True
_CLASS[1, list(b"|#$%&*<>{}[]~^\\=@_")] = True
_CLASS[2, list(b"!?.,;:'\"()-/")] = True
_CLASS[3, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
SHAPES = 8
#: Punctuation parts words here; the shape features count it.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 32
#: Standard errors by which a word's share must differ between the classes to be a feature.
SIGNIFICANT = 4.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, bucket, shape): each document's distinct word buckets (CSR) and its row of shape features."""
    h, length, first = words(_PLAIN[data], offsets)
    docs = len(offsets) - 1
    count = np.diff(first)
    doc = np.repeat(np.arange(docs, dtype=np.int64), count)
    keys = np.unique((doc * BUCKETS) | (mix(h) >> np.uint64(46)).astype(np.int64))
    starts = np.searchsorted(keys, np.arange(docs + 1, dtype=np.int64) * BUCKETS)
    size, n = np.maximum(np.diff(offsets), 1), np.maximum(count, 1)
    shape = np.empty((docs, SHAPES))
    for k, members in enumerate(_CLASS):
        at = np.searchsorted(np.flatnonzero(members[data]), offsets)
        shape[:, k] = np.diff(at) / size
    total = np.concatenate([[0], np.cumsum(length)])
    shape[:, 4] = (total[first[1:]] - total[first[:-1]]) / n
    shape[:, 5] = np.diff(starts) / n
    shape[:, 6] = np.log1p(count)
    shape[:, 7] = 1.0
    return starts, (keys & (BUCKETS - 1)).astype(np.int32), shape


@dataclass
class Model:
    """Per head a weight for each bucket and shape feature; shapes are standardised."""

    word: np.ndarray
    shape: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def log_odds(self, first: np.ndarray, bucket: np.ndarray, shape: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, len(HEADS))), np.cumsum(self.word[bucket], axis=0, dtype=np.float64)])
        return sums[first[1:]] - sums[first[:-1]] + ((shape - self.mean) / self.scale) @ self.shape


def fit(first: np.ndarray, bucket: np.ndarray, shape: np.ndarray, labels: np.ndarray, rounds: int = 400, l2: float = 1e-5) -> Model | None:
    """Logistic regression with adaptive steps on shape and on the presence of significant words; None without rows.

    Most words differ between the classes by chance only, and there are more of them than rows. So a head's words
    are those whose share of bad and of good documents differs by SIGNIFICANT standard errors and in 5 documents.
    """
    n = len(labels)
    if not n:
        return None
    mean, scale = shape.mean(0), shape.std(0) + 1e-9
    mean[-1], scale[-1] = 0.0, 1.0
    x = (shape - mean) / scale
    doc = np.repeat(np.arange(n), np.diff(first))
    full, dense = np.zeros((BUCKETS, len(HEADS)), np.float32), np.zeros((SHAPES, len(HEADS)))
    seen = np.bincount(bucket, minlength=BUCKETS)
    for k in range(len(HEADS)):
        y = labels[:, k].astype(float)
        bad, rate = y.sum(), (y.sum() + 0.5) / (n + 1)
        hits = np.bincount(bucket, y[doc], BUCKETS)
        share = (seen + 1) / (n + 2)
        error = np.sqrt(share * (1 - share) * (1 / max(bad, 1) + 1 / max(n - bad, 1)))
        gap = hits / max(bad, 1) - (seen - hits) / max(n - bad, 1)
        used = np.flatnonzero((np.abs(gap) >= SIGNIFICANT * error) & (seen >= 5))
        place = np.full(BUCKETS, -1)
        place[used] = np.arange(len(used))
        at = place[bucket]
        keep = at >= 0
        at, own = at[keep], doc[keep]
        w, v = np.zeros(len(used)), np.zeros(SHAPES)
        v[-1] = np.log(rate / (1 - rate))
        gw, gv = np.full(len(used), 1e-7), np.full(SHAPES, 1e-7)
        for _ in range(rounds):
            z = np.bincount(own, w[at], n) + x @ v
            r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            dw, dv = np.bincount(at, r[own], len(used)) + l2 * w, x.T @ r
            gw += dw * dw
            gv += dv * dv
            w -= 0.3 * dw / np.sqrt(gw)
            v -= 0.3 * dv / np.sqrt(gv)
        full[used, k], dense[:, k] = w, v
    return Model(full, dense, mean, scale)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fits on at most sample_rows labelled documents with sample_bytes of text; rows with a null id or label are not used.

    Of documents with one doc_id one is taken. What reaches the driver is at most twice the sample's text.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max(F.lit(1) - F.col("quality")).cast("int").alias("_low"), F.max("toxic").cast("int").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    chosen = stage(chosen, "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows narrow rows

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                first, bucket, shape = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(bucket))
                shapes = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * SHAPES, pa.int32()), pa.array(shape.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(offsets[i : j + 1])), lists, shapes, batch.column(2)[i:j], batch.column(3)[i:j]], ["doc_id", "size", "b", "s", "low", "toxic"])

    featured = rows.mapInArrow(run, "doc_id long, size long, b array<int>, s array<double>, low int, toxic int")
    one = stage(featured.groupBy("doc_id").agg(F.max(F.struct("size", "b", "s", "low", "toxic")).alias("x")).select("doc_id", "x.*"), "features")
    # at most sample_rows rows, so one task can add up their sizes
    within = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    kept = one.join(F.broadcast(one.select("doc_id", within.alias("_sum")).where(F.col("_sum") <= sample_bytes).select("doc_id")), "doc_id")
    found = kept.select("doc_id", "b", "s", "low", "toxic").toArrow()
    release(chosen, one)
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    found = found.take(pa.array(order)).combine_chunks()
    if not found.num_rows:
        return None
    b, s = (found[c].combine_chunks() for c in ("b", "s"))
    first = np.concatenate([[0], np.cumsum(np.diff(b.offsets.to_numpy()))])
    labelled = np.stack([found["low"].to_numpy(), found["toxic"].to_numpy()], axis=1)
    return fit(first, b.flatten().to_numpy(), s.flatten().to_numpy().reshape(-1, SHAPES), labelled)


def score(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of every document with _low and _toxic, the classifier's log-odds; null without a model.

    The result is written, so that texts are read once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets
    frame = docs.select(*keep, *([] if text in keep else [text]))
    at = frame.columns.index(text)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("_low", T.DoubleType()), T.StructField("_toxic", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            odds = np.full((batch.num_rows, 2), np.nan)
            if m is not None:
                for i, j in steps(offsets):
                    odds[i:j] = m.log_odds(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(odds[:, k], from_pandas=True) for k in (0, 1))], [*schema.names])

    out = stage(frame.mapInArrow(run, schema), "scored")
    shared.destroy()
    return out


def _logit(x: Column) -> Column:
    return F.log(x / (1 - x))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def site_evidence(scored: DataFrame) -> tuple[DataFrame, dict[str, float], dict[str, float], dict[str, float]]:
    """(_host, _path and for each the documents and the sum of each head's probabilities), and by head the global rate and the strengths of hosts and paths.

    scored: _host, _path, _low, _toxic. Counts are pre-aggregated before the shuffle, so a host with a third of
    all rows is no hot key. Strength by moments: m(1 - m) / v - 1 for rates with mean m and variance v beyond
    what sampling explains, between 1 and 1e6.
    """
    heads = _ODDS
    paths = scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(_sigmoid(F.col(h)), F.lit(0.0))).alias(f"{h}_sum") for h in heads))
    paths = stage(paths, "paths")
    hosts = stage(paths.groupBy("_host").agg(F.sum("n").alias("_n"), *(F.sum(f"{h}_sum").alias(f"_h{h}") for h in heads)), "hosts")

    def strength(frame: DataFrame, n: str, cols: list[str], parents: list) -> dict[str, float]:
        aggs = []
        for h, c, p in zip(heads, cols, parents):
            gap = F.col(c) / F.col(n) - p
            aggs += [F.sum(F.col(n) * gap * gap).alias(f"v{h}"), F.sum(F.col(n) * p * (1 - p)).alias(f"m{h}")]
        r = frame.agg(F.sum(n).alias("n"), F.count("*").alias("k"), *aggs).first()
        out = {}
        for h in heads:
            # the expected sum of n (rate - parent)^2 is (k + (n - k) / (strength + 1)) times the mean of p (1 - p)
            if not r["n"] or not r[f"m{h}"]:
                out[h] = 1e6
                continue
            excess = r[f"v{h}"] - r["k"] * r[f"m{h}"] / r["n"]
            out[h] = float(np.clip((r["n"] - r["k"]) * r[f"m{h}"] / r["n"] / excess - 1, 1, 1e6)) if excess > 0 else 1e6
        return out

    whole = hosts.agg(F.sum("_n").alias("n"), *(F.sum(f"_h{h}").alias(h) for h in heads)).first()
    total = whole["n"] or 0
    rate = {h: ((whole[h] or 0.0) + 0.5) / (total + 1) for h in heads}
    k_host = strength(hosts, "_n", [f"_h{h}" for h in heads], [F.lit(rate[h]) for h in heads])
    one = hosts.withColumnRenamed("_host", "_h")
    joined = paths.join(small(one), paths["_host"].eqNullSafe(one["_h"])).drop("_h")
    k_path = strength(joined, "n", [f"{h}_sum" for h in heads], [(F.col(f"_h{h}") + k_host[h] * rate[h]) / (F.col("_n") + k_host[h]) for h in heads])
    sites = stage(joined, "sites")
    release(paths, hosts)
    return sites, rate, k_host, k_path


def _judged(docs: DataFrame, labels: DataFrame, host: str, path: str, sample_rows: int, reject_from: float, keep: list[str]) -> DataFrame:
    """The kept columns as _c0, _c1 and so on, with _p_low, _host_low, _path_low, the same of toxic, and _rejected."""
    model = train(docs, labels, sample_rows)
    inner = [f"_c{k}" for k in range(len(keep))]
    text = inner[keep.index("text")] if "text" in keep else "text"  # texts go to the scorer once
    named = docs.select(*[F.col(f"`{c}`").alias(i) for i, c in zip(inner, keep)], F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path"), *([F.col("text")] if text == "text" else []))
    scored = score(named, model, [*inner, "_host", "_path"], text)
    sites, rate, k_host, k_path = site_evidence(scored)
    sites = sites.withColumnsRenamed({"_host": "_h", "_path": "_p"})
    same = scored["_host"].eqNullSafe(sites["_h"]) & scored["_path"].eqNullSafe(sites["_p"])
    if is_small(sites):
        joined = scored.join(F.broadcast(sites), same)
    else:  # rows of a hot site go to several tasks
        dealt = scored.withColumn("_s", F.pmod(F.xxhash64("_low", "_toxic"), F.lit(SALT)))
        sites = sites.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        joined = dealt.join(sites, dealt["_host"].eqNullSafe(sites["_h"]) & dealt["_path"].eqNullSafe(sites["_p"]) & (dealt["_s"] == sites["_t"]))
    outputs = {}
    for h in _ODDS:
        own = F.coalesce(_sigmoid(F.col(h)), F.lit(0.0))
        # sums without the document itself; rounding can't take them below zero
        of_host = (F.greatest(F.col(f"_h{h}") - own, F.lit(0.0)) + k_host[h] * rate[h]) / (F.col("_n") - 1 + k_host[h])
        of_path = (F.greatest(F.col(f"{h}_sum") - own, F.lit(0.0)) + k_path[h] * of_host) / (F.col("n") - 1 + k_path[h])
        outputs |= {f"_host{h}": of_host, f"_path{h}": of_path, f"_p{h}": _sigmoid(F.col(h) + _logit(of_path) - _logit(F.lit(rate[h])))}
    out = joined.select(*inner, *[c.alias(n) for n, c in outputs.items()])
    return out.withColumn("_rejected", F.coalesce((F.col("_p_low") >= reject_from) | (F.col("_p_toxic") >= reject_from), F.lit(False)))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample_rows: int = SAMPLE_ROWS, reject_from: float = REJECT_FROM, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id) with p_low, p_toxic, host_low, path_low, host_toxic, path_toxic and rejected.

    host_ and path_ are the posterior rates of the site's other documents. Nulls: a null text counts as empty, null
    hosts and paths are sites of their own. Without labelled documents the probabilities are null and nothing is
    rejected. Repeated rows are judged one by one and alike; texts have no greatest length; an empty table gives no
    rows. A kept column that is named like an output gives way to it; names of other columns can't clash.
    """
    outputs = ["p_low", "p_toxic", "host_low", "path_low", "host_toxic", "path_toxic", "rejected"]
    keep = [c for c in keep or ["doc_id"] if c.lower() not in outputs]
    out = _judged(docs, labels, host, path, sample_rows, reject_from, keep)
    return out.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(keep)], *[F.col(f"_{c}").alias(c) for c in outputs])


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample_rows: int = SAMPLE_ROWS, reject_from: float = REJECT_FROM) -> DataFrame:
    """docs, with all their columns whatever their names, without those that are rejected. Nulls and repeats as in judge."""
    out = _judged(docs, labels, host, path, sample_rows, reject_from, docs.columns)
    return out.where("not _rejected").select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
