"""Line dedup: later copies of repeated runs of lines go. Built-in expressions only.

A document is a sequence of line ids (128-bit hashes), and all documents' suffixes of lines are sorted by distributed
prefix doubling: a rank stands for the first ``have`` lines of a suffix in sorted order, and the ranks at a line and
``have`` lines on give the rank for twice as many. Suffixes of one rank are an interval of the suffix array with a common
prefix of ``have`` lines at least; suffixes that are alone have no copy and take no further part, so rounds get smaller,
and they end when all are alone. From ``min_run`` lines on, each interval's first place (document, line) is the one that
stays; the other places are later copies of a run of ``have`` lines. Runs that overlap or meet make the maximal repeated
runs of a document, which go.

Documents of one text are one sequence, of the least of them: in a copy of a whole text every run has an earlier place, so all
of it goes if it has ``min_run`` lines, and no suffix of it takes part. Texts are told by two 64-bit hashes.

``longest`` ends the rounds once runs of so many lines are ranked. It changes no result, as longer repeated runs are made
of overlapping ones of ``min_run`` lines, and saves the shuffles of the further rounds.

Runs under ``min_run`` lines stay, so by default a single line that repeats is kept, however long, and a text of one line
loses nothing. ``long_words`` removes later copies of single lines of so many words too; it is off unless given.

Order is by doc_id (null first), then line. Rows with equal doc_id are equals: they don't delete each other's lines.
Null text has no lines and stays null; the empty text is one empty line. Other columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shards import checkpointed

MIN_RUN = 2


def _ranked(runs: DataFrame, keys: list[str]) -> DataFrame:
    """doc, of, line, rank and later (another place of the rank comes first) of runs whose keys have another place too.
    Ranks are in the order of keys: classes are dealt by ranges, sorted, and numbered in that order.

    The join's key differs from the group's, so that both sides are dealt anew and a hot class can be split."""
    groups = runs.groupBy(*keys).agg(F.min(F.struct("doc", "line")).alias("first"), F.max(F.struct("doc", "line")).alias("last")).where("first < last")
    sorted_ = groups.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*(F.col(k).alias(f"_{k}") for k in keys), "first", F.monotonically_increasing_id().alias("_at"))
    left, right = runs.withColumn("_k", F.xxhash64(*keys)), sorted_.withColumn("_k", F.xxhash64(*(f"_{k}" for k in keys)))
    on = [left["_k"] == right["_k"], *(left[k] == right[f"_{k}"] for k in keys)]
    return left.join(right.hint("merge"), on).select("doc", "of", "line", F.col("_at").alias("rank"), (F.struct("doc", "line") != F.col("first")).alias("later"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _later_runs(each: DataFrame, min_run: int, longest: int | None) -> list[DataFrame]:
    """doc, of, line and end of later copies, by rounds of doubling. each: doc, of (the text), line, k1 and k2
    (hashes of the line)."""
    ranks, have, found = _ranked(each, ["k1", "k2"]), 1, []
    while True:
        if have >= min_run:
            last = longest is not None and have >= longest
            if not last:
                ranks = checkpointed(ranks)
                if ranks.isEmpty():
                    return found
            found.append(ranks.where("later").select("doc", "of", "line", (F.col("line") + have).alias("end")))
            if last:
                return found
        step = min(have, min_run - have) if have < min_run else have
        of_text = Window.partitionBy("doc", "of").orderBy("line")
        both = ranks.repartition("doc", "of").select("*", F.lead("line", step).over(of_text).alias("line2"), F.lead("rank", step).over(of_text).alias("rank2"))
        ranks, have = _ranked(both.where(F.col("line2") == F.col("line") + step), ["rank", "rank2"]), have + step


def _texts(docs: DataFrame, key: str, col: str, min_run: int, long_words: int | None) -> DataFrame:
    """of and of2 (hashes of the text), first (the least doc that has it), ids (of its lines), long (places of its lines of
    long_words or more) of each distinct text. Copies are put together within partitions first, so that a hot text is a row each."""
    text = F.col(f"`{col}`")
    ids = F.transform(_lines(text), lambda x: F.struct(F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(1), x).alias("k2")))
    none = F.array().cast("array<int>")
    if long_words is None:
        long = none
    else:
        places = F.transform(_lines(text), lambda x, i: F.when((F.length(x) >= 2 * long_words - 1) & (F.regexp_count(x, F.lit(r"\S+")) >= long_words), i))
        long = F.filter(places, lambda i: i.isNotNull())
    rows = docs.where(text.isNotNull()).select(F.struct(F.col(f"`{key}`").cast("long").alias("doc")).alias("d"), F.xxhash64(text).alias("of"), F.xxhash64(F.lit(1), text).alias("of2"), ids.alias("ids"), long.alias("long"))
    return rows.groupBy("of", "of2").agg(F.min("d").alias("first"), F.first("ids").alias("ids"), F.first("long").alias("long"))


def _text_runs(docs: DataFrame, key: str, col: str, min_run: int, long_words: int | None, longest: int | None) -> DataFrame:
    """of and of2 (hashes of a text), first (struct of the least doc that has it), runs and copied: the runs of lines that go, in
    order, each as start (from 0) and end (past the last): runs in the first document of a text, copied in its later ones."""
    if min_run < 1 or (long_words is not None and long_words < 1):
        raise ValueError("min_run, long_words")
    texts = checkpointed(_texts(docs, key, col, min_run, long_words))
    each = texts.select("first.doc", "of", "of2", "long", F.posexplode("ids").alias("line", "x")).select("doc", F.struct("of", "of2").alias("of"), "line", "x.k1", "x.k2", "long")
    found = _later_runs(each.select("doc", "of", "line", "k1", "k2"), min_run, longest)
    if long_words is not None:
        one = _ranked(each.where(F.array_contains("long", F.col("line"))).select("doc", "of", "line", "k1", "k2"), ["k1", "k2"])
        found.append(one.where("later").select("doc", "of", "line", (F.col("line") + 1).alias("end")))
    whole = F.struct(F.lit(0).alias("start"), F.size("ids").alias("end"))
    copied = F.when(F.size("ids") >= min_run, F.array(whole)).otherwise(F.transform("long", lambda i: F.struct(i.alias("start"), (i + 1).alias("end"))))
    if not found:
        return texts.select("of", "of2", "first", F.filter(F.array(whole), lambda x: F.lit(False)).alias("runs"), copied.alias("copied"))
    ends = reduce(DataFrame.unionByName, found).groupBy("doc", "of", "line").agg(F.max("end").alias("end"))
    of_text = Window.partitionBy("doc", "of").orderBy("line")
    before = F.max("end").over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.repartition("doc", "of").withColumn("new", F.coalesce(F.col("line") > before, F.lit(True)))
    parts = starts.withColumn("part", F.count_if("new").over(of_text.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy("doc", "of", "part").agg(F.min("line").alias("start"), F.max("end").alias("end"))
    by_text = runs.groupBy("doc", "of").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs")).select(F.col("of.of").alias("_a"), F.col("of.of2").alias("_b"), "runs")
    none = F.filter(F.array(whole), lambda x: F.lit(False))
    both = texts.join(by_text, (F.col("of") == F.col("_a")) & (F.col("of2") == F.col("_b")), "left")
    return both.select("of", "of2", "first", F.coalesce("runs", none).alias("runs"), copied.alias("copied"))


def _of_rows(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (_doc, _of, _of2: a struct of the key, hashes of the text) with runs: those that go, null where none do.

    Rows of a hot text meet its one row. The join has a key of its own, so that both sides are dealt anew and such rows can be
    split."""
    gone = texts.where((F.size("runs") > 0) | (F.size("copied") > 0)).select(F.col("of").alias("_a"), F.col("of2").alias("_b"), "first", "runs", "copied", F.xxhash64("of", "of2").alias("_k"))
    left = rows.withColumn("_l", F.xxhash64("_of", "_of2"))
    both = left.join(gone.hint("merge"), (F.col("_l") == F.col("_k")) & (F.col("_of") == F.col("_a")) & (F.col("_of2") == F.col("_b")), "left")
    return both.withColumn("runs", F.when(F.col("_doc").eqNullSafe(F.col("first")), F.col("runs")).otherwise(F.col("copied"))).drop("_a", "_b", "_k", "_l", "first", "copied")


def _named(key: str, col: str) -> list[Column]:
    text = F.col(f"`{col}`")
    return [F.struct(F.col(f"`{key}`").cast("long").alias("doc")).alias("_doc"), F.xxhash64(text).alias("_of"), F.xxhash64(F.lit(1), text).alias("_of2")]


def repeated_runs(docs: DataFrame, key: str = "doc_id", col: str = "text", min_run: int = MIN_RUN, long_words: int | None = None, longest: int | None = None) -> DataFrame:
    """doc, of (which text: hash), runs: the maximal runs of lines that are later copies, each as start (from 0) and end
    (past the last), in order."""
    rows = docs.where(F.col(f"`{col}`").isNotNull()).select(*_named(key, col)).distinct()
    found = _of_rows(rows, _text_runs(docs, key, col, min_run, long_words, longest))
    return found.where(F.size("runs") > 0).select("_doc.doc", F.col("_of").alias("of"), "runs")


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside the runs: what lies before each, and after the last."""
    def between(i: Column) -> Column:
        start = F.coalesce(F.get(runs, i - 1)["end"], F.lit(0))
        return F.slice(lines, start + 1, F.coalesce(F.get(runs, i)["start"], F.size(lines)) - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), between))


def line_dedup(docs: DataFrame, key: str = "doc_id", col: str = "text", min_run: int = MIN_RUN, long_words: int | None = None, longest: int | None = None) -> DataFrame:
    """docs with col rewritten and n_lines and n_removed added (columns of these names are replaced)."""
    texts = _text_runs(docs, key, col, min_run, long_words, longest)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), *_named(key, col))
    text = F.col(f"c{keep.index(col)}")
    joined = _of_rows(base, texts)
    kept = F.array_join(_kept(_lines(text), F.col("runs")), "\n")
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    made = {col: F.when(F.col("runs").isNotNull() & text.isNotNull(), kept).otherwise(text), "n_lines": F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long"), "n_removed": F.when(F.col("runs").isNull() | text.isNull(), 0).otherwise(removed).cast("long")}
    names = {c: F.col(f"c{i}") for i, c in enumerate(keep)} | made
    return joined.select(*(x.alias(c) for c, x in names.items()))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    d = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY ls[i + 1], ls[i + 2] ORDER BY doc_id, i) AS rn FROM l WHERE i + 1 < len(ls)),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM w, (VALUES (0), (1)) v(k) WHERE rn > 1),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN ls[l.i + 1] END, chr(10) ORDER BY l.i) AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""
