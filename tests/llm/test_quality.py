import re

import numpy as np
import pytest

from tests.llm.conftest import EDGES
from veridex.llm import quality
from veridex.llm.common import mix
from veridex.llm.common import words as hashes


def texts(n, seed=0):
    """(doc_id, text, source, lang, quality, toxic)."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        words = list(rng.choice(vocabulary, rng.integers(20, 80)))
        low, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            words[3] = "scum"
        text = " | ".join(words) if low else " ".join(words)
        out.append((i, text, f"h{i % 10}", "en", int(not low), int(toxic)))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    rows = texts(900)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows if r[0] < 500], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(frames):
    rows, docs, labels = frames
    wrong = {r.doc_id: r.rejected for r in quality.judge(docs, labels).collect()}
    truth = {r[0]: not r[4] or bool(r[5]) for r in rows}
    held_out = [i for i in truth if i >= 500]
    assert np.mean([wrong[i] == truth[i] for i in held_out]) >= 0.98


def test_real_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    half = labels.where("doc_id % 2 = 0")
    found = {r.doc_id: r.rejected for r in quality.judge(docs, half).collect()}
    odd = [i for i in known if i % 2]
    bad = [i for i in odd if known[i][0] == 0 or known[i][1] == 1]
    clean = [i for i in odd if i not in set(bad)]
    assert np.mean([found[i] for i in clean]) <= 0.03 and np.mean([found[i] for i in bad]) >= 0.8


def test_features_match_a_plain_count():
    data = "Ab ab | c\n1!é".encode()
    first, bucket, shape = quality.features(np.frombuffer(data + b"", np.uint8), np.array([0, len(data)]))
    assert first.tolist() == [0, 4] and len(set(bucket.tolist())) == 4
    assert shape[0, 0] == pytest.approx(1 / len(data)) and shape[0, 1] == pytest.approx(1 / len(data)) and shape[0, 5] == pytest.approx(4 / 5)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def posteriors(rows):
    """Brute force over (key, host, path, low odds, toxic odds): by key the host's and the path's rates without the row itself, and its probability, for each head."""
    out = {key: [] for key, *_ in rows}

    def strength(groups):
        n, k = sum(g[0] for g in groups), len(groups)
        spread, noise = (sum(g[0] * x for g, x in zip(groups, xs)) for xs in ([(s / c - p) ** 2 for c, s, p in groups], [p * (1 - p) for _, _, p in groups]))
        excess = spread - k * noise / n
        return min(max((n - k) * noise / n / excess - 1, 1), 1e6) if excess > 0 else 1e6

    for head in (3, 4):
        p = [sigmoid(r[head]) for r in rows]
        rate = (sum(p) + 0.5) / (len(rows) + 1)
        hosts, paths = {}, {}
        for r, x in zip(rows, p):
            for table, key in ((hosts, r[1]), (paths, r[1:3])):
                n, s = table.get(key, (0, 0.0))
                table[key] = (n + 1, s + x)
        kh = strength([(n, s, rate) for n, s in hosts.values()])
        kp = strength([(n, s, (hosts[key[0]][1] + kh * rate) / (hosts[key[0]][0] + kh)) for key, (n, s) in paths.items()])
        for r, x in zip(rows, p):
            (nh, sh), (n, s) = hosts[r[1]], paths[r[1:3]]
            host = (sh - x + kh * rate) / (nh - 1 + kh)
            path = (s - x + kp * host) / (n - 1 + kp)
            out[r[0]] += [host, path, sigmoid(r[head] + np.log(path / (1 - path)) - np.log(rate / (1 - rate)))]
    return out


def judged(rows):
    return {r[0]: [r.host_low, r.path_low, r.p_low, r.host_toxic, r.path_toxic, r.p_toxic] for r in rows}


def same(found, want):
    assert found.keys() == want.keys()
    for key in want:
        assert found[key] == pytest.approx(want[key], rel=1e-6, abs=1e-9), key


def scored_rows(spark, monkeypatch, rows, small=True):
    frame = spark.createDataFrame(rows, "_c0 long, _host string, _path string, _low double, _toxic double")
    monkeypatch.setattr(quality, "train", lambda *_: None)
    monkeypatch.setattr(quality, "score", lambda *_: frame)
    if not small:
        monkeypatch.setattr(quality, "is_small", lambda *_: False)
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    return quality.judge(docs, docs).collect()


@pytest.mark.parametrize("small", [True, False])
def test_sites_against_brute_force(spark, monkeypatch, small):
    rng = np.random.default_rng(8)
    rows = [(i, *rng.choice(["a", "b", None, ""], 1).tolist(), *rng.choice(["p", "q", None], 1).tolist(), float(rng.normal(0, 3)), float(rng.normal(-4, 2))) for i in range(400)]
    rows += [(400, "lone", "p", 4.0, -9.0), (401, "twice", "p", 4.0, 2.0), (402, "twice", "p", 4.0, 2.0)]
    same(judged(scored_rows(spark, monkeypatch, rows, small)), posteriors(rows))


def test_shrinkage(spark, monkeypatch):
    rows = [("big", "p", 4.0, -9.0)] * 500 + [("big", "q", -4.0, -9.0)] * 500 + [("tiny", "p", 4.0, -9.0)] + [(f"h{i}", "p", -4.0, -9.0) for i in range(200)]
    found = {r.doc_id: r for r in scored_rows(spark, monkeypatch, [(i, *r) for i, r in enumerate(rows)])}
    rate = np.mean([sigmoid(r[2]) for r in rows])
    # a lone document doesn't speak for its own host; five hundred say much about their path
    assert found[1000].host_low == pytest.approx(rate, abs=1e-3) and found[1000].p_low == pytest.approx(sigmoid(4.0), abs=0.01)
    assert found[0].path_low > 0.9 and found[500].path_low < 0.1 and rate - 1e-3 <= found[0].host_low <= 0.52


def plain_odds(model, text):
    """The classifier's log-odds of one text, feature by feature."""
    data = (text or "").encode()
    parted = bytes(32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c for c in data)
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", parted) if w]
    one = lambda w: int(mix(hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0])[0] >> np.uint64(46))
    buckets = {one(w) for w in set(words)}
    count = lambda chars: sum(data.count(c) for c in chars) / max(len(data), 1)
    shape = [
        count(b"0123456789"), count(b"|#$%&*<>{}[]~^\\=@_"), count(b"!?.,;:'\"()-/"), count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        sum(map(len, words)) / max(len(words), 1), len(buckets) / max(len(words), 1), np.log1p(len(words)), 1.0,
    ]
    return sum((model.word[b].astype(float) for b in sorted(buckets)), np.zeros(2)) + ((np.array(shape) - model.mean) / model.scale) @ model.shape


def test_whole_table_against_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    rows = [(r.doc_id, r.source, r.lang, *map(float, plain_odds(model, r.text))) for r in docs.collect()]
    found = quality.judge(docs, labels).collect()
    same(judged(found), posteriors(rows))
    assert all(r.rejected == (r.p_low >= 0.5 or r.p_toxic >= 0.5) for r in found)


def test_the_sample_is_bounded_in_rows_and_bytes(frames):
    _, docs, labels = frames
    assert quality.train(docs, labels, sample_rows=0) is None and quality.train(docs, labels, sample_bytes=0) is None
    assert quality.train(docs, labels, sample_rows=50) is not None


def test_columns_named_like_outputs(spark, frames):
    rows, _, labels = frames
    docs = spark.createDataFrame([(*r[:4], 7.0, "mine", 3) for r in rows[:300]], "doc_id long, text string, source string, lang string, p_low double, rejected string, _host int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 300 and {(r.p_low, r.rejected, r["_host"]) for r in kept.collect()} == {(7.0, "mine", 3)}
    out = quality.judge(docs, labels, keep=docs.columns)
    assert out.columns.count("p_low") == 1 and out.where("p_low = 7").count() == 0 and out.count() == 300


def test_repeats_nulls_and_a_text_beyond_one_step(spark, frames):
    labels = frames[2]
    long = "w1 w2 w3 | " * 450_000
    rows = [(1, long, "h", "en"), (1, long, "h", "en"), (None, None, None, None), (2, "", None, "en"), (1, "other text", "h", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = quality.judge(docs, labels).collect()
    assert len(found) == 5 and len({r.p_low for r in found if r.doc_id == 1}) == 2


def test_without_labels_nothing_is_rejected(spark, edges, frames):
    none = frames[2].limit(0)
    judged = quality.judge(edges, none, host="label", path="ids").collect()
    assert len(judged) == len(EDGES) and not any(r.rejected for r in judged) and all(r.p_low is None for r in judged)
    assert quality.judge(edges.limit(0), frames[2], host="label", path="ids").count() == 0
    kept = quality.keep_good(edges, none, host="label", path="ids")
    assert kept.columns == edges.columns and kept.count() == len(EDGES)
