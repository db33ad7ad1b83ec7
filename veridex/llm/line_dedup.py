"""Line-run deduplication with a suffix array over line ids, by DataFrame operations only.

Every line is a symbol. Suffixes of the documents' line sequences are ranked by prefix doubling: ranks of pairs
(rank at i, rank at i + k) order the suffixes by their first 2k lines. A suffix whose first k lines occur once is
settled and leaves the array, so it shrinks from round to round. Suffixes that share the first n lines are an
interval of the array with a longest common prefix of at least n; two ranks, at i and at i + n - k, name it.

A run of consecutive lines with at least min_words words is repeated if an equal run begins earlier in the order
(doc_id, line number). Its lines are deleted. Any repeated run is the union of its shortest windows of min_words
words that begin, or that end, at one of its lines, so looking up those windows finds every maximal run whole.
The first occurrence of every line always stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm.common import release, stage

#: Words from which a repeated run of lines counts.
MIN_WORDS = 50
_ROW = ["did", "th"]
_NULL_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with did and th, which name a document: rows equal in id and text are one."""
    return docs.withColumns({"_did": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), "_th": F.xxhash64("text")})


def _lines(docs: DataFrame) -> DataFrame:
    parts = _keyed(docs.select("doc_id", "text")).where("text is not null").select(F.col("_did").alias("did"), F.col("_th").alias("th"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return parts.select("did", "th", "ln", F.xxhash64("line").alias("h"), F.hash("line", F.length("line")).alias("h2"), F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))


def _ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct keys with a rank that follows their order: sorted ranges, numbered within and across partitions."""
    return stage(keys.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def suffix_ranks(symbols: DataFrame, longest: int) -> list[DataFrame]:
    """Level j: did, th, ln, rank of every suffix whose first 2**j lines occur more than once.

    symbols: did, th, ln, rank of the lines that occur more than once. Goes up to the level that runs of `longest` lines need.
    """
    levels, k = [symbols], 1
    while 2 * k <= longest:
        here = levels[-1]
        after = here.select(*_ROW, (F.col("ln") - k).alias("ln"), F.col("rank").alias("r2"))
        pairs = stage(here.withColumnRenamed("rank", "r1").join(after, [*_ROW, "ln"]), "pairs")
        names = _ranked(pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["r1", "r2"])
        levels.append(stage(pairs.join(names, ["r1", "r2"]).select(*_ROW, "ln", "rank"), "suffixes"))
        release(pairs, names)
        k *= 2
        if levels[-1].isEmpty():
            break
    return levels


def _windows(symbols: DataFrame, min_words: int) -> DataFrame:
    """did, th, ln (first line), last: the shortest windows of min_words words from, and up to, every line, of repeated lines alone."""
    order = Window.partitionBy(*_ROW).orderBy("ln")
    runs = symbols.withColumn("seg", F.col("ln") - F.row_number().over(order))
    own = Window.partitionBy(*_ROW, "seg").orderBy("ln")
    runs = runs.withColumn("c", F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.select(*_ROW, "seg", "ln", (F.col("c") - F.col("w")).alias("s"), "c")
    total = Window.partitionBy(*_ROW, "seg")
    runs = runs.withColumn("all", F.max("c").over(total)).where(F.col("all") >= min_words)
    keys = [*_ROW, "seg"]
    # from line ln: the first line whose cumulated words reach s + min_words, found by one descending pass
    marks = runs.select(*keys, F.col("c").alias("x"), F.lit(0).alias("ask"), F.col("ln").alias("mark"), F.col("ln"))
    asks = runs.select(*keys, (F.col("s") + min_words).alias("x"), F.lit(1).alias("ask"), F.lit(None).cast("int").alias("mark"), F.col("ln"))
    down = Window.partitionBy(*keys).orderBy(F.desc("x"), "ask", F.desc("ln")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = marks.unionByName(asks).withColumn("last", F.last("mark", ignorenulls=True).over(down)).where("ask = 1 and last is not null").select(*_ROW, "ln", "last")
    # up to line ln: the last line with at least min_words words from it on
    marks = runs.select(*keys, F.col("s").alias("x"), F.lit(0).alias("ask"), F.col("ln").alias("mark"), F.col("ln"))
    asks = runs.select(*keys, (F.col("c") - min_words).alias("x"), F.lit(1).alias("ask"), F.lit(None).cast("int").alias("mark"), F.col("ln"))
    up = Window.partitionBy(*keys).orderBy("x", "ask", "ln").rowsBetween(Window.unboundedPreceding, 0)
    back = marks.unionByName(asks).withColumn("first", F.last("mark", ignorenulls=True).over(up)).where("ask = 1 and first is not null").select(*_ROW, F.col("first").alias("ln"), F.col("ln").alias("last"))
    return ahead.unionByName(back).distinct()


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """did, th, ln: the lines to delete."""
    lines = stage(_lines(docs), "lines")
    repeated = _ranked(lines.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["h", "h2"])
    symbols = stage(lines.join(repeated, ["h", "h2"]).select(*_ROW, "ln", "rank", "w").dropDuplicates([*_ROW, "ln"]), "symbols")
    release(lines, repeated)
    windows = stage(_windows(symbols, min_words).withColumn("n", F.col("last") - F.col("ln") + 1), "windows")
    longest = windows.agg(F.max("n")).first()[0] or 0
    levels = suffix_ranks(symbols.drop("w"), longest)
    ranks = levels[0].withColumn("k", F.lit(1))
    for j, level in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(level.withColumn("k", F.lit(1 << j)))
    # the largest power of two up to n
    sized = windows.withColumn("k", F.expr("shiftleft(1, cast(floor(log2(n + 0.5)) as int))"))
    sized = sized.join(ranks.withColumnRenamed("rank", "r1"), [*_ROW, "ln", "k"])
    ends = ranks.select(*_ROW, "k", F.col("ln").alias("mid"), F.col("rank").alias("r2"))
    named = stage(sized.withColumn("mid", F.col("last") - F.col("k") + 1).join(ends, [*_ROW, "k", "mid"]).select(*_ROW, "ln", "last", "n", "r1", "r2"), "intervals")
    first = stage(named.groupBy("n", "r1", "r2").agg(F.count("*").alias("m"), F.min(F.struct(*_ROW, "ln")).alias("first")).where("m > 1").drop("m"), "firsts")
    later = named.join(first, ["n", "r1", "r2"]).where(F.struct(*_ROW, "ln") > F.col("first"))
    out = stage(later.select(*_ROW, F.explode(F.sequence("ln", "last")).alias("ln")).distinct(), "gone")
    release(symbols, windows, *levels[1:], named, first)
    return out


def _cleaned(docs: DataFrame, min_words: int) -> DataFrame:
    """The columns of docs as _c0, _c1 and so on, the new text as _new, and the counts _lines and _deleted."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(names)], F.col("doc_id"), F.col("text"))
    lines = deleted_lines(docs, min_words).select(F.col("did").alias("_did"), F.col("th").alias("_th"), "ln")
    gone = lines.groupBy("_did", "_th").agg(F.collect_set("ln").alias("_gone"))  # at most the lines of one document
    # half of all documents may lose lines, so the texts are shuffled at every size: disk grows in proportion, no broadcast grows
    # lines are split once per document, before the expressions that use them many times
    joined = _keyed(inner).join(gone.hint("merge"), ["_did", "_th"], "left").withColumn("_split", F.split("text", "\n"))
    split = F.col("_split")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone")), lambda i: F.get(split, i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    return joined.select(*[f"_c{k}" for k in range(len(names))], count.alias("_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_deleted"), text.alias("_new"))


def without_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated line runs deleted from text, and with all their columns whatever their names.

    Null text stays null; an empty text is one empty line and stays. Where every line goes, the text is empty and the
    row stays. Rows equal in doc_id and text count as one document and change alike; a null doc_id comes first in the
    order. n_chars, if there is one, follows the new text. Texts and lines may have any length.
    """
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_new").cast(docs.schema["n_chars"].dataType)
    return _cleaned(docs, min_words).select(*[new.get(c, F.col(f"_c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, n_chars and text_sha256 of the text that is left; a null text has no lines and counts as empty."""
    out = _cleaned(docs.select("doc_id", "text"), min_words)
    sha = F.sha2(F.encode(F.coalesce("_new", F.lit("")), "utf-8"), 256)
    return out.select(F.col("_c0").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_deleted").alias("n_deleted"), F.coalesce(F.length("_new"), F.lit(0)).cast("long").alias("n_chars"), sha.alias("text_sha256"))


ORACLE = r"""
    with l as (
        select doc_id, unnest(generate_series(0, len(s) - 1)) as i, s
        from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)
    ), n as (
        select doc_id, i, s[i + 1] as line, len(regexp_extract_all(s[i + 1], '[^\x20\x09-\x0D]+')) as w from l
    ), c as (
        select doc_id, i, line, sum(w) over (partition by doc_id order by i) as c, w from n
    ), ahead as (
        select a.doc_id, a.i as s, min(b.i) as e from c a join c b on a.doc_id = b.doc_id and b.i >= a.i and b.c - a.c + a.w >= 50 group by all
    ), back as (
        select b.doc_id, max(a.i) as s, b.i as e from c a join c b on a.doc_id = b.doc_id and b.i >= a.i and b.c - a.c + a.w >= 50 group by all
    ), win as (
        select distinct doc_id, s, e from (from ahead union all from back)
    ), named as (
        select w.doc_id, s, e, array_to_string(d.t[s + 1:e + 1], chr(10)) as body
        from win w join (select doc_id, string_split(text, chr(10)) as t from documents) d using (doc_id)
    ), firsts as (
        select body, e - s as n, min((doc_id, s)) as f from named group by all
    ), gone as (
        select distinct doc_id, unnest(generate_series(s, e)) as i
        from named join firsts on named.body = firsts.body and e - s = n and (doc_id, s) > f
    ), kept as (
        select n.doc_id, count(*) as n_lines, count(g.i) as n_deleted,
               coalesce(string_agg(n.line, chr(10) order by n.i) filter (where g.i is null), '') as t
        from n left join gone g on n.doc_id = g.doc_id and n.i = g.i group by n.doc_id
    )
    select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted,
           cast(length(coalesce(t, '')) as bigint) as n_chars, sha256(coalesce(t, '')) as text_sha256
    from documents d left join kept using (doc_id)"""
