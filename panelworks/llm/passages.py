"""Passages of ``WORDS`` words or more that documents share, wherever they stand.

Words are set off by ASCII white space and ASCII letters are lower-cased; lines play no part. Equal texts
are one text with a number of copies, and a copied text is one whole passage. Different texts are compared
in two steps, both at content-defined places: of every so many places in a row, the one of the least
five-word hash is an anchor, and a fixed number of words from it on is a stretch. Anchors depend on the
words alone, so a shared run of ``stretch + reach - 1`` words holds a stretch that is the same in all texts.

1. Short, sparse stretches (``STRETCH`` words, one in about 18): those of two texts or more leave few places.
2. Near these places, stretches of ``LONG`` words, denser; those of two texts or more are shared for certain
   (by 128-bit hashes). Both steps miss no run of ``WORDS`` shared words.

Overlapping or touching stretches of step 2 are a passage. So every shared run of ``WORDS`` words has a
passage of at least ``LONG`` words within it, which leaves out fewer than ``WORDS - LONG + 1`` words at either
end; no passage holds less than ``LONG`` shared words.

Passages that share a stretch are linked through the first that holds it, so a stretch of n texts costs n
links. All but the first passage (by document id, then word) of a component are marked as removed.

Defined results: null and empty texts have none. Rows equal in id and text are copies like any others. A
passage repeated only within one text is none. Null ids are ordered last. Other columns are ignored. Texts
are read whole at any length. Texts are named by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import row_keys, saved
from panelworks.llm.components import components
from panelworks.llm.paragraphs import band_keys, placed_blocks

WORDS = 50
STRETCH = 16
LONG = 40
GRAM = 5
# Fixed odd multipliers of two word-sequence hashes.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in (text or "").encode("utf-8", "replace").lower().split()], dtype=np.uint64)


def runs(words: np.ndarray, size: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out, span = words.copy(), 1  # runs of span words, doubled towards size
    with np.errstate(over="ignore"):
        power = base
        parts = np.zeros(n, dtype=np.uint64)
        done = 0
        left = size
        while left:
            if left & 1:
                parts = parts * power + out[done : done + n]
                done += span
            left >>= 1
            if left:
                out = out[:-span] * power + out[span:]
                power, span = power * power, 2 * span
        parts ^= parts >> np.uint64(29)
        parts *= _MIX
        return parts ^ (parts >> np.uint64(32))


def anchors(words: np.ndarray, stretch: int, reach: int, grams: np.ndarray | None = None) -> np.ndarray:
    """Places at which a stretch begins: of every ``reach`` in a row the last of the least hash. ``grams``
    may give the five-word hashes."""
    n = len(words) - stretch + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    back = (runs(words, min(GRAM, stretch)) if grams is None else grams)[:n][::-1]
    if n <= reach:
        return np.array([n - 1 - int(back.argmin())])
    found = []
    for low in range(0, n - reach + 1, 1 << 16):  # bounded views of long texts
        views = np.lib.stride_tricks.sliding_window_view(back[low : low + (1 << 16) + reach - 1], reach)
        found.append(np.unique(np.arange(len(views)) + views.argmin(axis=1)) + low)
    return np.unique(n - 1 - np.concatenate(found))


def _hashed(rows: DataFrame, places, wide: bool) -> DataFrame:
    """(t, h1), or (t, at, h1, h2) if ``wide``, of the runs that ``places(words, hits)`` gives with their
    size; rows are (t, text) or (t, text, hits). If ``wide``, a row with ``at`` -1 has a text's number of
    words as ``h1``."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                hits = part.column(2).to_pylist() if wide else [None] * part.num_rows
                row, at, h1, h2 = [], [], [], []
                for i, (text, hit) in enumerate(zip(part.column(1), hits)):
                    words = word_hashes(text.as_py())
                    where, size = places(words, hit)
                    row.append(np.full(len(where), i))
                    at.append(where)
                    h1.append(runs(words, size, _BASES[0])[where])
                    if wide:
                        h2.append(runs(words, size, _BASES[1])[where])
                        row.append(np.array([i]))
                        at.append(np.array([-1]))
                        h1.append(np.array([len(words)], dtype=np.uint64))
                        h2.append(np.zeros(1, dtype=np.uint64))
                signed = lambda parts: pa.array(np.concatenate(parts).view(np.int64))
                columns = {"t": part.column(0).take(pa.array(np.concatenate(row).astype(np.int64)))}
                if wide:
                    columns["at"] = pa.array(np.concatenate(at).astype(np.int32))
                columns["h1"] = signed(h1)
                if wide:
                    columns["h2"] = signed(h2)
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(batches, "t long, at int, h1 long, h2 long" if wide else "t long, h1 long")


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the five-word shingles, as ``scan`` gives them (of at least five words)."""
    return np.unique(runs(np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64), GRAM))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts for both searches: rows of ``paragraphs.paragraphs`` (``class`` not null), with
    keys of ``shingles``, and rows (t, h1) of the sparse stretches."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, long_digest = xxhash.xxh64_intdigest, xxhash.xxh3_128_digest
        for batch in source:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                row, line, count, kind, keys, texts, hashes = [], [], [], [], [], [], []
                for i, text in enumerate(part.column(4)):
                    lines = [s.split() for s in (text.as_py() or "").encode("utf-8", "replace").lower().split(b"\n")]
                    words = [w for s in lines for w in s]
                    seq = np.array([digest(w) for w in words], dtype=np.uint64)
                    grams = runs(seq, GRAM)
                    for first, n, low, high in placed_blocks(lines):
                        row.append(i)
                        line.append(first)
                        count.append(n)
                        kind.append(long_digest(b" ".join(words[low:high])))
                        keys.append(band_keys(np.unique(grams[low : high - GRAM + 1])))
                    where = anchors(seq, STRETCH, WORDS - STRETCH + 1, grams)
                    texts.append(np.full(len(where), i))
                    hashes.append(runs(seq, STRETCH)[where])
                found, at = pa.array(row, pa.int64()), pa.array(np.concatenate(texts).astype(np.int64))
                none = lambda n, t: pa.nulls(n, t)
                n, m = len(found), len(at)
                both = lambda a, b: pa.concat_arrays([a, b])
                columns = [both(part.column(c).take(found), none(m, part.column(c).type)) for c in range(3)]
                columns += [both(pa.array(x, t), none(m, t)) for x, t in ((line, pa.int32()), (count, pa.int32()), (kind, pa.binary()), (keys, pa.list_(pa.int64())))]
                columns += [both(none(n, pa.int64()), part.column(3).take(at)), both(none(n, pa.int64()), pa.array(np.concatenate(hashes).view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ka", "kb", "line", "lines", "class", "keys", "t", "h1"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    ka, kb = row_keys(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), ka.alias("ka"), kb.alias("kb"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(batches, f"doc_id {kind}, ka long, kb long, line int, lines int, class binary, keys array<long>, t long, h1 long")


def _shared(found: DataFrame, *key: str) -> DataFrame:
    """The keys that more than one text holds."""
    return found.groupBy(*key).agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low != high").select(*key)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, stretch: int = STRETCH, long: int = LONG, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, first_word, n_words, component_id, component_size, removed) of every passage that another
    document holds as well; component_id is "document:word" of the component's first. ``found`` may give the
    sparse stretches (t, h1) as written before."""
    text = F.col(text_col)
    texts = docs.select(F.xxhash64(text).alias("t"), text.alias("text")).where("text is not null")

    def sparse(seq: np.ndarray, hit: None) -> tuple[np.ndarray, int]:
        return anchors(seq, stretch, words - stretch + 1), stretch

    def near(seq: np.ndarray, hit: list[int]) -> tuple[np.ndarray, int]:
        every = anchors(seq, long, words - long + 1)
        if not hit:  # a copied text that shares nothing with another
            return every[:0], long
        at = sparse(seq, None)[0]
        at = at[np.isin(runs(seq, stretch)[at].view(np.int64), np.array(hit, dtype=np.int64))]
        # A run of ``words`` words that holds both a stretch at a and a long one at p.
        low, high = np.searchsorted(at, every - (words - long)), np.searchsorted(at, every + (words - stretch), side="right")
        return every[high > low], long

    found = saved(_hashed(texts, sparse, wide=False)) if found is None else found
    hits = found.join(saved(_shared(found, "h1")), "h1").groupBy("t").agg(F.collect_set("h1").alias("hits"))

    # One row of each text that has hits or copies: that of the least row hash.
    rows = saved(docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), row_keys(F.col(id_col), text)[1].alias("kb")))
    classes = rows.groupBy("t").agg(F.count("*").alias("copies"), F.min("kb").alias("kb"))
    wanted = saved(classes.join(hits, "t", "left").where("copies > 1 or hits is not null"))
    one = docs.select(F.xxhash64(text).alias("t"), row_keys(F.col(id_col), text)[1].alias("kb"), text.alias("text"))
    hashed = saved(_hashed(one.join(wanted, ["t", "kb"]).select("t", "text", "hits"), near, wide=True))
    held = hashed.where("at >= 0")  # equal rows may give theirs twice
    runs_ = saved(held.join(saved(_shared(held, "h1", "h2")), ["h1", "h2"]))

    # Overlapping or touching stretches are one passage; a copied text is one as a whole.
    lengths = hashed.where("at < 0").select("t", F.col("h1").cast("int").alias("stop")).distinct()
    whole = lengths.where(F.col("stop") >= words).join(wanted.where("copies > 1").select("t"), "t").select("t", F.lit(0).alias("low"), "stop")
    listed = runs_.join(whole.select("t"), "t", "left_anti").groupBy("t").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    apart = lambda i: F.get(F.col("ats"), i + 1) - F.get(F.col("ats"), i) > long
    opens = F.filter("ats", lambda a, i: (i == 0) | apart(i - 1))
    closes = F.filter("ats", lambda a, i: (i == F.size("ats") - 1) | apart(i))
    pieces = listed.select("t", "ats", F.posexplode(F.arrays_zip(opens.alias("low"), closes.alias("high"))).alias("piece", "z"))
    spans = pieces.select("t", F.col("z.low").alias("low"), (F.col("z.high") + long).alias("stop"), F.filter("ats", lambda a: a.between(F.col("z.low"), F.col("z.high"))).alias("ats"))
    none = F.array().cast("array<int>")
    spans = saved(spans.unionByName(whole.withColumn("ats", none)).withColumn("pid", F.monotonically_increasing_id()))

    # A stretch links its passages to the one of the least id.
    placed = runs_.join(spans.select("t", "pid", F.explode("ats").alias("at")), ["t", "at"]).select("h1", "h2", "pid")
    placed = saved(placed.unionByName(runs_.join(spans.where(F.size("ats") == 0).select("t", "pid"), "t").select("h1", "h2", "pid")))
    least = placed.groupBy("h1", "h2").agg(F.min("pid").alias("a"))
    links = placed.join(least, ["h1", "h2"]).select("a", F.col("pid").alias("b")).where("a != b").distinct()
    known = spans.drop("ats").join(components(links).withColumnRenamed("node", "pid"), "pid", "left").withColumn("root", F.coalesce("root", "pid"))

    out = saved(rows.select("doc_id", "t").join(known, "t").select("doc_id", F.col("low").alias("first_word"), (F.col("stop") - F.col("low")).alias("n_words"), "root", "pid"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "first_word")
    heads = out.groupBy("root").agg(F.count("*").alias("component_size"), F.min(place).alias("head"))
    head = F.concat_ws(":", F.coalesce(F.col("head.doc_id").cast("string"), F.lit("null")), F.col("head.first_word"))
    joined = out.join(heads, "root").select("doc_id", "first_word", "n_words", head.alias("component_id"), "component_size", (place == F.col("head")).alias("leads"), "root")
    # Equal rows share the first place: one of them stays.
    twins = joined.where("leads").groupBy("doc_id", "first_word", "n_words", "component_id", "component_size", "root").agg(F.count("*").alias("n"))
    first = twins.select("doc_id", "first_word", "n_words", "component_id", "component_size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    kept = first.select("doc_id", "first_word", "n_words", "component_id", "component_size", (F.col("k") > 1).alias("removed"))
    return joined.where(~F.col("leads")).select("doc_id", "first_word", "n_words", "component_id", "component_size", F.lit(True).alias("removed")).unionByName(kept)
