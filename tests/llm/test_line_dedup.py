import random
import re

from tests.llm.conftest import EDGES, docs_of
from veridex.llm import line_dedup


def brute(rows, least):
    """All repeated runs, found by comparing every window of every length: doc_id -> text."""
    count = lambda line: len(re.findall(r"[^\x20\x09-\x0D]+", line))
    seen, gone = {}, set()
    rows = sorted(rows)
    for d, text in rows:
        lines = text.split("\n")
        for i in range(len(lines)):
            for e in range(i + 1, len(lines) + 1):
                seen.setdefault(tuple(lines[i:e]), (d, i))
    for d, text in rows:
        lines = text.split("\n")
        for i in range(len(lines)):
            total = 0
            for e in range(i + 1, len(lines) + 1):
                total += count(lines[e - 1])
                if total >= least and seen[tuple(lines[i:e])] < (d, i):
                    gone |= {(d, k) for k in range(i, e)}
    return {d: "\n".join(line for k, line in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}


def test_against_brute_force(spark):
    rng = random.Random(8)
    lines = ["a", "b b", "c c c", "", "d d d d", "e"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    docs = docs_of(spark, texts)
    for least in (1, 4, 9, 20):
        found = {r.doc_id: r.text for r in line_dedup.without_repeated_runs(docs, least).collect()}
        assert found == brute(list(enumerate(texts)), least), least


def test_long_common_run_and_what_stays(spark):
    run = [f"line {k} of a shared passage" for k in range(40)]
    texts = ["\n".join(["start one", *run, "end one"]), "\n".join(["start two", *run, "short tail"]), "\n".join(run[5:12] + ["own"]), "unique words only"]
    docs = docs_of(spark, texts)
    left = {r.doc_id: r.text for r in line_dedup.without_repeated_runs(docs, 50).collect()}
    assert left == {0: texts[0], 1: "start two\nshort tail", 2: texts[2], 3: texts[3]}  # seven lines of six words are too few
    assert {r.doc_id: (r.n_lines, r.n_deleted) for r in line_dedup.digest(docs, 50).collect()} == {0: (42, 0), 1: (42, 40), 2: (8, 0), 3: (1, 0)}


def test_edges(spark, edges, nothing):
    out = line_dedup.without_repeated_runs(edges, 3)
    assert out.columns == edges.columns and [f.dataType for f in out.schema] == [f.dataType for f in edges.schema]
    rows = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    # equal rows of one id are one document; its text repeats an earlier one's
    assert [t for d, t in rows if d == 4] == ["one two three"] and [t for d, t in rows if d == 5] == ["", ""] and len(rows) == len(EDGES)
    assert {(r.ids, r.n, r.length, r.media, r["_low"], r.n_lines, r.n_deleted) for r in out.collect()} == {("x", 1, 2, "m", 0.5, 6, 7)}
    counts = line_dedup.digest(edges, 3).collect()
    assert [r.n_lines for r in sorted(counts, key=lambda r: r.doc_id or 0) if r.doc_id in (1, 2)] == [0, 1] and len(counts) == len(EDGES)
    assert line_dedup.without_repeated_runs(nothing).count() == line_dedup.digest(nothing).count() == 0


def test_a_text_beyond_four_megabytes(spark):
    lines = [f"line {k} " + "word " * 10 for k in range(80_000)]
    texts = ["\n".join(lines), "\n".join(["own start", *lines[1000:1100], "own end"])]
    left = {r.doc_id: r.text for r in line_dedup.without_repeated_runs(docs_of(spark, texts), 50).collect()}
    assert len(texts[0]) > 4 << 20 and left == {0: texts[0], 1: "own start\nown end"}


def test_suffix_ranks_order_and_shrink(spark):
    lines = spark.createDataFrame([(d, d, i, s) for d, text in enumerate(["abcx", "abcy", "bz"]) for i, s in enumerate(text) if s in "abc"], "did long, th long, ln int, s string")
    symbols = lines.selectExpr("did", "th", "ln", "cast(ascii(s) as long) as rank")
    levels = line_dedup.suffix_ranks(symbols, 4)
    two = {(r.did, r.ln): r.rank for r in levels[1].collect()}
    assert set(two) == {(0, 0), (0, 1), (1, 0), (1, 1)} and two[0, 0] == two[1, 0] < two[0, 1] == two[1, 1]
    assert levels[2].count() == 0


def test_texts_meet_their_deleted_lines_alike_at_every_size(spark):
    """A broadcast for small tables alone made disk jump with size."""
    out = line_dedup.digest(docs_of(spark, ["a b c\nd e f", "a b c\nd e f\ng"]), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r.doc_id: r.n_deleted for r in out.collect()} == {0: 0, 1: 2}
