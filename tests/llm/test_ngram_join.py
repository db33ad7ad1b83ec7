import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import EDGES, docs_of
from veridex.llm import ngram_join
from veridex.llm.common import shingles, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows):
    """(doc_id, set size, component) of every row, all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d or 0, len(s), (least.get(root(i)) if s else d) or 0) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def found(df):
    return sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.similar_groups(df).collect())


def near_copies(seed, base=60, copies=50, edits=4):
    rng = random.Random(seed)
    text = [f"w{rng.randrange(30)}" for _ in range(base)]
    out = []
    for _ in range(copies):
        t = list(text)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(base)] = f"x{rng.randrange(5)}"
        out.append(" ".join(t))
    return out


def test_against_brute_force(spark):
    texts = near_copies(1) + near_copies(2, 25, 40, 3) + near_copies(3, 200, 30, 9) + ["a b", "A B", "a  b\n", "a b c d e f", "a b c d e", "", "solo words here"]
    # a passage that many documents share, around other words
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [f"{' '.join(f'u{rng.randrange(9999)}' for _ in range(n))} {passage}" for n in range(3, 40)]
    assert found(docs_of(spark, texts)) == brute(list(enumerate(texts)))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(edges, nothing):
    assert found(edges) == brute(EDGES)
    assert ngram_join.similar_groups(nothing).count() == 0


def test_one_of_each(spark):
    texts = near_copies(5, 60, 10, 0) + ["another text that is not like the others at all", ""]
    kept = ngram_join.one_of_each(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 11]


def test_one_row_of_each_group_whatever_the_ids(spark):
    a, b = "one two three four five six seven", "quite another text that has its own words"
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (5, a.upper(), 3), (1, a, 4), (1, a, 5), (None, b, 6), (None, b, 7), (None, "a third text of a null id alone", 8), (9, "", 9), (9, None, 10)]
    docs = spark.createDataFrame([(d, t, k, 1, 2.0, "x") for d, t, k in rows], "doc_id long, text string, th int, id int, comp double, none string")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(1, a), (5, b), (0, "a third text of a null id alone"), (9, ""), (9, "")])
    nulls = ngram_join.one_of_each(docs.where("doc_id is null"))
    assert sorted(r.text for r in nulls.collect()) == sorted([b, "a third text of a null id alone"])
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_a_text_beyond_one_step(spark):
    long = " ".join(f"w{k}" for k in range(900_000))
    rows = [(0, long), (1, long + " end"), (2, "short text of a few words only")]
    assert found(docs_of(spark, [t for _, t in rows])) == [(0, 899_996, 0), (1, 899_997, 0), (2, 3, 2)]


def test_classes_follow_the_counts_of_all_tasks(spark):
    docs = docs_of(spark, ["the same five words here"] * 3000 + [f"u{k} v{k} w{k} x{k} y{k}" for k in range(50)]).repartition(7)
    classes = ngram_join.shingle_classes(docs)
    one = shingles(np.frombuffer(b"the same five words here", np.uint8), np.array([0, 24]))[0]
    assert classes.shape == (ngram_join.SKETCH,) and classes[int(one[0]) & (ngram_join.SKETCH - 1)] >= 9 and np.count_nonzero(classes) == 1


@pytest.mark.parametrize("seed", range(8))
def test_prefix_guarantee(seed):
    """Linked sets share at least the lesser m within their prefixes, under any order."""
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n = int(rng.integers(1, 120))
        a = rng.permutation(10000)[:n]
        b = np.concatenate([a[: n - int(rng.integers(0, max(1, n // 5)))], rng.permutation(np.arange(10000, 20000))[: int(rng.integers(0, n // 4 + 1))]])
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        order = rng.permutation(20000)
        prefix, m = [], []
        for s in (a, b):
            s = s[np.argsort(order[s])]
            m.append(ngram_join.choose(rng.random(len(s)) * 5))
            prefix.append(s[: len(s) - int(ngram_join.needed(len(s))) + m[-1]])
        assert len(np.intersect1d(*prefix)) >= min(m) and m[0] >= ngram_join.least_asked(len(b) * 4 // 5)


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if x in got} and set(got) >= {x for a, b in links if a != b for x in (a, b)}


def test_words_and_shingles_match_plain_python():
    texts = ["", "  ", "Ab c", "a b c d e f", "ÀB àb", "x" * 37 + " y\tz\x0bq\x0cr s", "a b c d e", "same same same same same same"]
    data = b"".join(t.encode() for t in texts)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, length, first = words(np.frombuffer(data, np.uint8), offsets)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in plain] and length.tolist() == [len(w.encode()) for p in plain for w in p]
    assert len(set(h.tolist())) == len({w for p in plain for w in p})
    s, at = shingles(np.frombuffer(data, np.uint8), offsets)
    assert [len(set(s[at[k] : at[k + 1]].tolist())) for k in range(len(texts))] == [len(shingle_set(t)) for t in texts]
    every = Counter(x for t in texts for x in shingle_set(t))
    assert len(set(s.tolist())) == len(every)


def brute_links(texts):
    """Of every row, how many different sets its set links to."""
    every = {frozenset(shingle_set(t)) for t in texts} - {frozenset()}
    linked = lambda a, b: a != b and 100 * len(a & b) >= 80 * len(a | b)
    return [sum(linked(frozenset(shingle_set(t)), s) for s in every) for t in texts]


def test_every_link_of_a_component_counts(spark):
    texts = near_copies(1, 200, 40, 3) + near_copies(7, 60, 30, 2) + ["a b c d e f", "alone with its own words here", ""]
    got = {r.doc_id: r.links for r in ngram_join.similar_groups(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_links(texts) and max(got.values()) >= 20


def test_links_over_blocks(spark, monkeypatch):
    """A component of many bands and blocks: texts that grow by a few words."""
    monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", 900)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 6)
    words = [f"g{k}" for k in range(160)]
    texts = [" ".join(words[:n]) for n in range(10, 160, 2)] + near_copies(3, 150, 25, 3)
    got = {r.doc_id: r.links for r in ngram_join.similar_groups(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_links(texts)


@pytest.mark.parametrize("seed", range(4))
def test_overlaps(seed):
    rng = np.random.default_rng(seed)
    incidence = [rng.random((n, 300)) < rng.random(300) ** 4 * 0.5 for n in (70, 90)]
    (x_row, x), (y_row, y) = (np.nonzero(m) for m in incidence)
    a, b = (m.astype(int) for m in incidence)
    assert (ngram_join._overlaps(x, x_row, 70, y, y_row, 90, 300) == a @ b.T).all()
