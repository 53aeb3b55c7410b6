"""Repeated runs of lines, found by prefix doubling over line ids.

A line's id is the position of its first occurrence in the corpus, positions ordered by document id
(null last) and line number. Doubling names the run of ``2 ** k`` lines at a position by the pair of
names of its halves; the name of an interval of equal suffixes is again its first position, so equal
names mean a common prefix of at least ``2 ** k`` lines and no hash stands between the levels. A run
of any other length is named by two overlapping halves, like a range-minimum table. Suffixes whose
run occurs once leave the doubling at that level.

Deleted is every line covered by a run of whole lines that holds at least ``min_chars`` characters
(line ends count one each) and occurs at an earlier position. Such runs are unions of the shortest
qualifying runs that start or end at one of their lines, so only those are looked up, and the levels
stop at the longest of them.

Only line hashes, lengths and keys are shuffled while runs are searched; the text moves once, when
the kept lines are put together.

Defined results: a null text has no lines and stays null; an empty text is one empty line. Rows of
equal document id and line number tie: neither is later than the other. Null ids come last. Rows
repeated in full share their result. Other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import row_keys, saved

MIN_CHARS = 200
_NULL_ID = "9223372036854775808"  # sorts after every long


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc, text = F.col(id_col), F.col(text_col)
    ka, kb = row_keys(doc, text)
    base = F.coalesce(doc.cast("decimal(20,0)"), F.lit(_NULL_ID).cast("decimal(20,0)")) * F.lit("2147483648").cast("decimal(10,0)")
    return (
        docs.select(ka.alias("ka"), kb.alias("kb"), base.cast("decimal(32,0)").alias("base"), F.posexplode(F.split(text, "\n")).alias("line", "s"))
        .select(
            "ka", "kb", "line",
            (F.col("base") + F.col("line").cast("decimal(10,0)")).cast("decimal(32,0)").alias("pos"),
            (F.length("s") + 1).cast("long").alias("n"),
            F.xxhash64("s").alias("a"), F.xxhash64(F.lit(1), "s").alias("b"),
        )
    )


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` occur at two positions or more, with the first of them as ``name``.

    The groups are written first: joined as a table, they are broadcast if small, and else the rows
    of a hot key are split over tasks.
    """
    groups = rows.groupBy(*keys).agg(F.min("pos").alias("name"), F.max("pos").alias("last"))
    return rows.join(saved(groups.where("name < last").drop("last")), keys)


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(ka, kb, lines): the sorted line numbers to delete in the rows named by ``row_keys``."""
    repeated = _named(saved(_lines(docs, id_col, text_col)), ["a", "b"]).drop("a", "b")
    row = Window.partitionBy("ka", "kb")
    runs = (
        repeated.repartition("ka", "kb")
        .dropDuplicates(["ka", "kb", "line"])
        .withColumn("seg", F.col("line") - F.row_number().over(row.orderBy("line")))
    )
    seg = Window.partitionBy("ka", "kb", "seg")
    runs = runs.withColumn("end", F.sum("n").over(seg.orderBy("line"))).withColumn("start", F.col("end") - F.col("n"))
    ahead = seg.orderBy("start").rangeBetween(0, min_chars - 1)
    behind = seg.orderBy("end").rangeBetween(1 - min_chars, 0)
    runs = saved(
        runs.select(
            "ka", "kb", "seg", "line", "pos", "name",
            F.when(F.max("end").over(ahead) - F.col("start") >= min_chars, F.count("*").over(ahead)).alias("right"),
            F.when(F.col("end") - F.min("start").over(behind) >= min_chars, F.count("*").over(behind)).alias("left"),
        )
    )
    windows = (
        runs.select("ka", "kb", F.explode(F.array(
            F.struct(F.col("line").alias("at"), F.col("right").alias("size")),
            F.struct((F.col("line") - F.col("left") + 1).cast("int").alias("at"), F.col("left").alias("size")),
        )).alias("w"))
        .select("ka", "kb", "w.at", "w.size")
        .where("size is not null")
        .distinct()
        .withColumn("k", F.floor(F.log2("size") + 1e-9).cast("int"))
        .withColumn("second", (F.col("at") + F.col("size") - F.pow(F.lit(2), F.col("k"))).cast("int"))
    )
    longest = runs.agg(F.max(F.greatest("right", "left"))).first()[0] or 0
    level = runs.select("ka", "kb", "seg", "line", "pos", "name")
    levels = level.withColumn("k", F.lit(0))
    for k in range(1, int(longest).bit_length()):
        step = 2 ** (k - 1)
        half = seg.orderBy("line").rangeBetween(step, step)
        pairs = (
            level.withColumn("y", F.first("name").over(half))
            .where("y is not null")
            .withColumnRenamed("name", "x")
        )
        level = saved(_named(pairs, ["x", "y"]).drop("x", "y"))
        levels = levels.unionByName(level.withColumn("k", F.lit(k)))
    first = levels.select("ka", "kb", "k", F.col("line").alias("at"), "pos", F.col("name").alias("x"))
    second = levels.select("ka", "kb", "k", F.col("line").alias("second"), F.col("name").alias("y"))
    found = windows.join(first, ["ka", "kb", "k", "at"]).join(second, ["ka", "kb", "k", "second"])
    named = _named(found, ["size", "x", "y"])
    return (
        named.where("pos > name")
        .select("ka", "kb", F.explode(F.sequence(F.col("at"), (F.col("at") + F.col("size") - 1).cast("int"))).alias("line"))
        .groupBy("ka", "kb")
        .agg(F.array_sort(F.collect_set("line")).alias("lines"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from ``text_col``.

    Adds ``n_lines`` and ``n_removed`` (columns of these names are replaced). A row whose lines all
    go keeps an empty text.
    """
    ka, kb = row_keys(F.col(id_col), F.col(text_col))
    gone = later_copies(docs, id_col, text_col, min_chars).select(
        F.col("ka").alias("__ka"), F.col("kb").alias("__kb"), F.col("lines").alias("__gone")
    )
    keyed = docs.drop("n_lines", "n_removed").withColumns({"__ka": ka, "__kb": kb})
    split, cut = F.split(F.col(text_col), "\n"), F.col("__gone")
    # The kept stretches between deleted lines, as (first line, number of lines).
    stretches = F.zip_with(
        F.concat(F.array(F.lit(-1)), cut),
        F.concat(cut, F.array(F.size(split))),
        lambda low, high: F.struct((low + 2).alias("at"), (high - low - 1).alias("size")),
    )
    kept = F.flatten(F.transform(F.filter(stretches, lambda r: r["size"] > 0), lambda r: F.slice(split, r["at"], r["size"])))
    return (
        keyed.join(gone, ["__ka", "__kb"], "left")
        .withColumns({
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("long"),
            "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
            text_col: F.when(cut.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
        })
        .drop("__ka", "__kb", "__gone")
    )


LINE_DEDUP_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, ls[i] AS line, length(ls[i]) + 1 AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
p AS (SELECT x.doc_id, x.i, x.n, y.doc_id AS e, x.i - y.i AS g
      FROM l x JOIN l y ON x.line = y.line AND (y.doc_id < x.doc_id OR (y.doc_id = x.doc_id AND y.i < x.i))),
q AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, e, g ORDER BY i) AS h FROM p),
r AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM q GROUP BY doc_id, e, g, h HAVING sum(n) >= {MIN_CHARS}),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM r),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') AS text
         FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT t.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN t.text IS NOT NULL THEN k.text END AS text
FROM documents t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
