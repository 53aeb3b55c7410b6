"""Language identification by Bayesian evidence fusion.

Each row has a text and may have a declared language, an address suffix and a host. The posterior of
a language combines

- the likelihood of the whole text under a smoothed letter-trigram model of the language, tempered,
  as neighbouring trigrams repeat each other's evidence,
- the chance that rows of the language declare this code, and end in this suffix, and
- a prior of the host, smoothed towards its domain and that towards the whole corpus.

Languages are the labels that at least ``MIN_LABELLED`` rows carry (the ``MAX_LANGUAGES`` most frequent, if
there are more). The text models are fitted on whole texts of a bounded sample of labelled rows
(``TRAIN_ROWS`` of each language, by hash order), counted where they are read. All other tables are expected counts over all rows, from grouped sums of the text posteriors: one pass
over the texts leaves four likelihoods and three short keys per row, and everything after works on
those. A row's own share is taken out of its host's counts. Hot hosts are summed before any shuffle,
and small count tables are joined by measured size.

A row is rejected when nothing speaks for a language: no letters at all, a text that fits unrelated
letters better than each language, or a posterior below ``MIN_POSTERIOR``. A row that declares a language
without a model is not judged: with letters it is kept under its own label.

Defined results: null and empty texts give no text evidence; null, empty or unknown declarations,
suffixes and hosts are categories of their own. Without any evidence the corpus prior decides and
the row is rejected. Without labelled rows every language is equally likely. Repeated rows count as
often as they occur. Of equally likely languages the first by name is taken. Other columns pass through
in ``keep_identified``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import saved

MIN_LABELLED = 20  # rows that a language needs to be modelled
MAX_LANGUAGES = 64
TRAIN_ROWS = 500  # labelled rows of each language that the text model is fitted on
BUCKETS = 1 << 15  # hashed trigrams
TEMPER = 0.1  # weight of a trigram's log-likelihood ratio
SMOOTH = 0.5
HOST_WEIGHT = 5.0  # rows' worth of the domain in a host's prior
DOMAIN_WEIGHT = 20.0  # and of the corpus in a domain's
MIN_POSTERIOR = 0.5

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-case letters of a whole text, words set off by spaces."""
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not letters:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(f" {letters} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    return (((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def languages(rows: DataFrame, label: str, least: int = MIN_LABELLED) -> dict[str, int]:
    """Languages to be modelled with their number of labelled rows, by name."""
    counts = rows.groupBy(F.lower(label).alias("l")).agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.trim("l") != ""))
    found = counts.orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).collect()
    return {r["l"]: r["n"] for r in sorted(found, key=lambda r: r["l"])}


def fit(rows: DataFrame, text: str, label: str, known: dict[str, int], train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """(trigram, language) log-likelihoods from at most ``train_rows`` labelled rows of each language; the
    last column is that of unrelated letters."""
    names = list(known)
    counts = np.zeros((BUCKETS, len(names)))
    if names:
        hashed = rows.select(F.lower(label).alias("l"), F.col(text).alias("t")).where(F.col("l").isin(names) & F.col("t").isNotNull())
        hashed = hashed.withColumn("h", F.xxhash64("t", "l"))
        # A cut of the hash leaves about twice as many rows of each language before they are ranked.
        share = F.create_map(*[F.lit(x) for name, n in known.items() for x in (name, min(1.0, 2.0 * train_rows / n))])
        cut = hashed.where(F.pmod("h", F.lit(1 << 30)) <= share[F.col("l")] * (1 << 30))
        ranked = cut.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= train_rows)
        sample = ranked.select("l", "t").repartition(max(1, len(names) * train_rows // 100))

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found, times = np.unique(trigrams(t.as_py()), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"l": [name] * len(found), "gram": pa.array(found, pa.int64()), "n": pa.array(times, pa.int64())})

        grams = sample.mapInArrow(batches, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
        for row in grams.collect():  # BUCKETS per language at most
            counts[row["gram"], names.index(row["l"])] = row["n"]
    total = counts.sum(axis=0)
    logs = np.log(counts + SMOOTH) - np.log(total + SMOOTH * BUCKETS)
    noise = np.full((BUCKETS, 1), -np.log(30.0**3))  # letters drawn alike
    return np.hstack([logs, noise])


def likelihoods(rows: DataFrame, text: str, model: np.ndarray) -> DataFrame:
    """``rows`` with ``lls``, the tempered log-likelihoods, ``noise`` of unrelated letters and
    ``n_grams``, in place of the text."""
    others = [c for c in rows.columns if c != text]
    held = model.astype(np.float64)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lls, noise, sizes = [], [], []
            for t in batch.column(batch.num_columns - 1):
                grams = trigrams(t.as_py())
                found, times = np.unique(grams, return_counts=True) if len(grams) < 4096 else ((c := np.bincount(grams, minlength=BUCKETS)).nonzero()[0], c[c > 0])
                score = TEMPER * (times @ held[found])
                lls.append(score[:-1])
                noise.append(float(score[-1]))
                sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lls, pa.list_(pa.float64())), pa.array(noise, pa.float64()), pa.array(sizes, pa.int64())], names=[*others, "lls", "noise", "n_grams"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    return rows.select(*others, text).mapInArrow(batches, f"{schema}, lls array<double>, noise double, n_grams long")


def _normal(scores: Column) -> Column:
    """Probabilities from log scores."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda r: r / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _counts(rows: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """Expected number of rows per language for each value of ``key``."""
    sums = [F.sum(F.col("p")[i]).alias(f"_{i}") for i in range(n)]
    return rows.groupBy(key).agg(*sums).select(F.col(key).alias(f"_{key}"), F.array(*[F.col(f"_{i}") for i in range(n)]).alias(name))


def fuse(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows (declared, suffix, domain, host, lls, noise, n_grams and others) with ``lang``,
    ``posterior``, ``text_lang``, ``kept``."""
    n = len(names)
    if not n:  # nothing to tell apart
        letters = F.col("n_grams") > 0
        out = scored.select("*", F.col("declared").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), (letters & F.coalesce(F.trim("declared") != "", F.lit(False))).alias("kept"))
        return out.drop("lls", "noise")
    rows = saved(scored.withColumn("p", _normal(F.col("lls"))))
    everywhere = rows.agg(*[F.sum(F.col("p")[i]) for i in range(n)]).first()
    total = np.array([x or 0.0 for x in everywhere]) + 1.0
    prior = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    sums = F.array(*[F.lit(float(x)) for x in total])
    for key, name in (("declared", "nd"), ("suffix", "ns"), ("domain", "nm"), ("host", "nh")):
        table = _counts(rows, key, name, n)
        rows = rows.join(table, F.col(key).eqNullSafe(F.col(f"_{key}"))).drop(f"_{key}")

    def smoothed(counts: str, towards: Column, weight: float) -> Column:
        own = F.zip_with(counts, "p", lambda c, p: F.greatest(c - p, F.lit(0.0)))  # without the row itself
        size = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(own, towards, lambda c, t: (c + weight * t) / (size + weight))

    rows = rows.withColumn("domain_prior", smoothed("nm", prior, DOMAIN_WEIGHT))
    rows = rows.withColumn("host_prior", smoothed("nh", F.col("domain_prior"), HOST_WEIGHT))
    chance = lambda counts: F.zip_with(counts, sums, lambda c, s: F.log((c + 1) / (s + 10)))
    for name in ("nd", "ns"):
        rows = rows.withColumn(name, chance(F.zip_with(name, "p", lambda c, p: F.greatest(c - p, F.lit(0.0)))))
    evidence = F.array(*[F.col("lls")[i] + F.log(F.col("host_prior")[i]) + F.col("nd")[i] + F.col("ns")[i] for i in range(n)])
    # Written, so that conditions on the result are not unfolded into the fusion again and again.
    rows = saved(rows.withColumn("posteriors", _normal(evidence)).drop("nd", "ns", "nm", "nh", "p", "domain_prior", "host_prior"))
    listed = F.array(*[F.lit(x) for x in names])
    best = lambda c: F.element_at(listed, F.array_position(c, F.array_max(c)).cast("int"))
    speaks = (F.col("n_grams") > 0) & (F.array_max("lls") > F.col("noise"))
    other = F.coalesce((F.trim("declared") != "") & ~F.col("declared").isin(list(names)), F.lit(False))  # a language without a model
    return rows.select(
        "*", F.when(other, F.col("declared")).otherwise(best(F.col("posteriors"))).alias("lang"), F.array_max("posteriors").alias("posterior"),
        F.when(F.col("n_grams") > 0, best(F.col("lls"))).alias("text_lang"),
        F.when(other, F.col("n_grams") > 0).otherwise(speaks & (F.array_max("posteriors") >= MIN_POSTERIOR)).alias("kept"),
    ).drop("lls", "noise")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents: the given language is the declaration, the source the host."""
    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id", none.cast("long").alias("page_id"), F.lower("lang").alias("declared"), none.alias("suffix"),
        F.lit("documents").alias("domain"), F.col("source").alias("host"), F.col("text").alias("body"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages: declared by the markup, suffix and host from the address, domain its last two parts."""
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?(?:</\1\s*>|$)", " "), r"(?s)<!--.*?(?:-->|$)|<[/!a-zA-Z][^>]*>|&#?\w+;", " ")
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", declared.alias("declared"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), host.alias("host"), body.alias("body"),
    )


def identify(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_id, declared, text_lang, lang, posterior, kept) of every document, and of every
    page where they are given (one of the two ids is null)."""
    known = languages(docs, "lang")
    model = fit(docs, "text", "lang", known)
    rows = document_evidence(docs)
    if pages is not None:
        rows = rows.unionByName(page_evidence(pages))
    found = fuse(likelihoods(rows, "body", model), list(known))
    return found.select("doc_id", "page_id", "declared", "text_lang", "lang", F.round("posterior", 6).alias("posterior"), "kept")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, ``lang`` replaced by the language found.

    Only the rows that change are looked up, so the texts move only if those are many.
    """
    keys = {"__ka": F.xxhash64("doc_id", "text", "lang", "source"), "__kb": F.xxhash64("source", "lang", "text", "doc_id")}
    keyed = docs.withColumns(keys)
    known = languages(docs, "lang")
    model = fit(docs, "text", "lang", known)
    rows = keyed.select(
        F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.lit("documents").alias("domain"),
        F.col("source").alias("host"), F.col("lang").alias("given"), "__ka", "__kb", F.col("text").alias("body"),
    )
    found = fuse(likelihoods(rows, "body", model), list(known)).where(~F.col("kept") | ~F.col("lang").eqNullSafe(F.lower("given")))
    changed = saved(found.groupBy("__ka", "__kb").agg(F.max(F.when(F.col("kept"), F.col("lang"))).alias("__lang"), F.lit(True).alias("__new")))
    out = keyed.join(changed, ["__ka", "__kb"], "left").where(F.col("__new").isNull() | F.col("__lang").isNotNull())
    return out.withColumn("lang", F.coalesce("__lang", "lang")).drop("__ka", "__kb", "__lang", "__new")
