"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

**Trie.** A conversation's turns are numbered from their range order, so a long conversation may lie in
many tasks. The prefix of d turns is named by the exclusive or of 128-bit hashes of its numbered turns,
running within stretches of ``STRETCH`` turns that are then offset by the stretches before. Conversations
of one prefix are one node, named by the smallest of them and its depth: so the ancestor of a node at any
depth is found by looking up its conversation at that depth.

**Rollup.** Totals over subtrees come from a centroid decomposition. The centroid of a component is its
deepest node whose subtree holds at least half of the component's nodes. Taking it out splits the component
into the part above it and one part below each of its children, all of at most half its size. The total of
the centroid and the parts below it, one aggregate of the component, is added to every node on the way from
the centroid to the component's top. Splitting goes on until every node was a centroid; then the sums a node
received are its subtree's totals. Each node receives at most one sum a level, and there are at most
log2(nodes) levels, however deep or wide the trie is.

Components of more than ``PART`` nodes are split by joins and aggregations over the cluster: subtree sizes
by doubling of parent pointers, and ways to the top and sides of the centroid by looking up ancestors.
Smaller ones are split to the end inside tasks, many at once, each whole in one task.

The turn hashes that name nodes are not checked against texts (two different prefixes of one depth share
128 bits by chance only).

Defined results: a null role or text is empty. Null turns come first, rows of equal turn are ordered by role
and text, equal rows are turns of their own. Rows with a null id take no part. A conversation without turns
after rebuilding is a member of the root. An empty table gives no rows. Other columns are ignored, whatever
their names. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import CRC32_STEPS_SQL, crc32_sql, saved

GROUP = 5  # conversations that share the opening turns of one of them
HEADS = 9  # an opening is of less than so many turns
STRETCH = 1024  # turns numbered together
PART = 4096  # nodes of a component that a task splits to the end
ID_BLOCK = 8192  # range of ids listed together
VALUES = ("n_leaves", "saved_tokens")


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, ha, hb, n_bytes): turns numbered from 1 within their conversation.

    Rows are sorted by range; a number is the place among the conversation's rows of the same range plus
    their count in the ranges before.
    """
    empty = F.lit("")
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn")]
    spread = turns.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    marks = spread.select(
        "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
        F.xxhash64("role", "text").alias("ta"), F.xxhash64(F.lit("turn"), "text", "role").alias("tb"), F.octet_length("text").cast("long").alias("n_bytes"),
    )
    marks = saved(marks)
    parts = marks.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    offsets = parts.select("conv_id", "part", (before - F.col("start")).alias("shift"))
    pos = F.col("at") + F.col("shift") + 1
    return marks.join(offsets, ["conv_id", "part"]).select("conv_id", pos.alias("pos"), "ta", "tb", "n_bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the turns (conv_id, depth, ha, hb, n_bytes) of the rebuilt conversations."""
    turns = saved(numbered(rows))
    heads = (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", heads, (F.col("conv_id") - F.col("conv_id") % GROUP).alias("origin"))
    convs = saved(convs)
    opening = turns.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("origin"), "pos", "ta", "tb", "n_bytes")
    first = convs.join(opening, "origin").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "ta", "tb", "n_bytes")
    lengths = convs.select(F.col("conv_id").alias("origin"), F.col("n").alias("origin_n"))
    taken = convs.join(lengths, "origin", "left").select("conv_id", "h", F.least("h", F.coalesce("origin_n", F.lit(0))).alias("taken"))
    own = turns.join(taken, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "ta", "tb", "n_bytes")
    hashed = first.unionByName(own).select("conv_id", "depth", F.xxhash64("depth", "ta", "tb").alias("ha"), F.xxhash64("tb", "ta", "depth").alias("hb"), "n_bytes")
    return convs.select("conv_id"), hashed


def prefixes(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``turns`` with (ka, kb), the name of the prefix that each ends."""
    cut = turns.withColumn("stretch", F.floor((F.col("depth") - 1) / stretch))
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    run = cut.withColumns({"ka": F.bit_xor("ha").over(within), "kb": F.bit_xor("hb").over(within)})
    whole = cut.groupBy("conv_id", "stretch").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    shift = whole.select("conv_id", "stretch", *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("xa", "xb")]).where("stretch > 0")
    joined = run.join(shift, ["conv_id", "stretch"], "left")
    moved = {k: F.col(k).bitwiseXOR(F.coalesce(x, F.lit(0))) for k, x in (("ka", "xa"), ("kb", "xb"))}
    return joined.withColumns(moved).select("conv_id", "depth", "ha", "hb", "ka", "kb", "n_bytes")


def trie(rows: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations (conv_id, length), steps (conv_id, depth, node_conv) that name the node of each
    prefix, the root's included, and nodes (conv_id, depth, parent_conv_id, n_convs, last_bytes)."""
    convs, turns = rebuilt(rows)
    named = saved(prefixes(turns, stretch))
    key = ["depth", "ka", "kb"]
    nodes = named.groupBy(*key).agg(F.min("conv_id").alias("node_conv"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("last_bytes"))
    steps = named.select("conv_id", *key).join(nodes.select(*key, "node_conv"), key).select("conv_id", "depth", "node_conv")
    least, count = convs.agg(F.min("conv_id"), F.count("*")).first()
    root = {"depth": F.lit(0).cast("long"), "node_conv": F.lit(least).cast("long")}
    steps = saved(steps.unionByName(convs.withColumns(root)))
    flat = nodes.select(F.col("node_conv").alias("conv_id"), "depth", "n_convs", "last_bytes")
    if count:
        one = convs.sparkSession.range(1).select(root["node_conv"].alias("conv_id"), root["depth"].alias("depth"), F.lit(count).alias("n_convs"), F.lit(0).cast("long").alias("last_bytes"))
        flat = flat.unionByName(one)
    above = steps.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node_conv").alias("parent_conv_id"))
    lengths = steps.groupBy("conv_id").agg(F.max("depth").alias("length"))
    return lengths, steps, saved(flat.join(above, ["conv_id", "depth"], "left"))


def _looked_up(rows: DataFrame, steps: DataFrame, at: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the conversation that names their ancestor at depth ``at``."""
    found = steps.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), F.col("node_conv").alias(name))
    return rows.join(found, (F.col("conv_id") == F.col("_c")) & (at == F.col("_d")), "left").drop("_c", "_d")


def _sizes(nodes: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, depth, size): nodes of the subtrees within components, by doubling the reach of parent
    pointers (up_conv, up_depth; null above the top) and of the sums."""
    held = saved(nodes.select("conv_id", "depth", "up_conv", "up_depth").withColumn("size", F.lit(1).cast("long")))
    reach = 1
    while reach <= deepest:
        below = held.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("size").alias("more"))
        hop = held.select(F.col("conv_id").alias("up_conv"), F.col("depth").alias("up_depth"), F.col("up_conv").alias("next_conv"), F.col("up_depth").alias("next_depth"))
        moved = held.join(below, ["conv_id", "depth"], "left").join(hop, ["up_conv", "up_depth"], "left")
        held = saved(moved.select("conv_id", "depth", F.col("next_conv").alias("up_conv"), F.col("next_depth").alias("up_depth"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        reach *= 2
    return held.select("conv_id", "depth", "size")


def _split(nodes: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split each component (top_conv, top_depth) at its centroid: the remaining nodes with their new
    components, and the sums (conv_id, depth, values) for the ways from the centroids to the tops."""
    top = ["top_conv", "top_depth"]
    deepest = nodes.agg(F.max(F.col("depth") - F.col("top_depth"))).first()[0]
    sized = nodes.join(_sizes(nodes, deepest), ["conv_id", "depth"])
    totals = nodes.groupBy(*top).agg(F.count("*").alias("total"))
    heavy = sized.join(totals, top).where("2 * size >= total")
    centre = F.max_by(F.struct("conv_id", "depth"), F.struct("depth", "size", -F.col("conv_id")))
    centres = saved(heavy.groupBy(*top).agg(centre.alias("m")).select(*top, F.col("m.conv_id").alias("mid_conv"), F.col("m.depth").alias("mid_depth")))
    sided = _looked_up(nodes.join(centres, top), steps, F.col("mid_depth"), "at_mid")
    below = F.coalesce((F.col("depth") >= F.col("mid_depth")) & (F.col("at_mid") == F.col("mid_conv")), F.lit(False))
    sided = saved(_looked_up(sided.withColumn("below", below), steps, F.col("mid_depth") + 1, "at_child"))
    sums = sided.where("below").groupBy(*top, "mid_conv", "mid_depth").agg(*[F.sum(v).alias(v) for v in VALUES])
    way = sums.select("mid_conv", F.explode(F.sequence("top_depth", "mid_depth")).alias("depth"), *VALUES).withColumnRenamed("mid_conv", "conv_id")
    gained = _looked_up(way, steps, F.col("depth"), "node_conv").select(F.col("node_conv").alias("conv_id"), "depth", *VALUES)
    rest = sided.where(~F.col("below") | (F.col("depth") > F.col("mid_depth")))
    cut = F.col("below") & (F.col("depth") == F.col("mid_depth") + 1)  # its parent was taken out
    rest = rest.select(
        "conv_id", "depth", *[F.when(~cut, F.col(c)).alias(c) for c in ("up_conv", "up_depth")], *VALUES,
        F.when(F.col("below"), F.col("at_child")).otherwise(F.col("top_conv")).alias("top_conv"),
        F.when(F.col("below"), F.col("mid_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
    )
    return rest, gained


def decompose(part: np.ndarray, up: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of many small trees at once by centroid decomposition. ``part`` names the tree of
    each node, ``up`` is its parent's row (-1 at a top), ``values`` has a row per node."""
    n = len(part)
    out = np.zeros_like(values)
    live = np.ones(n, dtype=bool)
    up, comp = up.copy(), part.copy()
    levels = [np.flatnonzero(depth == d) for d in range(depth.max(initial=-1), -1, -1)]
    fresh = part.max(initial=-1) + 1
    while live.any():
        size = live.astype(np.int64)
        for rows in levels:
            rows = rows[live[rows] & (up[rows] >= 0)]
            np.add.at(size, up[rows], size[rows])
        total = np.zeros(fresh, dtype=np.int64)
        np.add.at(total, comp[live], 1)
        heavy = np.flatnonzero(live & (2 * size >= total[comp]))
        heavy = heavy[np.lexsort((-size[heavy], -depth[heavy], comp[heavy]))]
        centres = heavy[np.unique(comp[heavy], return_index=True)[1]]
        # Which nodes lie below a centroid, and below which of its children: from the top down.
        centre = np.zeros(n, dtype=bool)
        centre[centres] = True
        root = np.where(centre, np.arange(n), -1)
        for rows in levels[::-1]:
            rows = rows[live[rows] & (up[rows] >= 0)]
            rows = rows[~centre[rows] & (root[up[rows]] >= 0)]
            root[rows] = np.where(centre[up[rows]], rows, root[up[rows]])
        inside = np.flatnonzero(live & (root >= 0))
        sums = np.zeros((fresh, values.shape[1]), dtype=values.dtype)
        np.add.at(sums, comp[inside], values[inside])
        way, gift = centres, sums[comp[centres]]
        while len(way):  # to the tops
            out[way] += gift
            on = up[way] >= 0
            way, gift = up[way][on], gift[on]
        names = np.full(n, -1)
        tops = inside[(root[inside] == inside) & ~centre[inside]]
        names[tops] = fresh + np.arange(len(tops))
        up[tops] = -1
        live[centres] = False
        moved = inside[live[inside]]
        comp[moved] = names[root[moved]]
        fresh += len(tops)
    return out


def _local(nodes: DataFrame) -> DataFrame:
    """Totals (conv_id, depth, values) of components of bounded size, each whole in one task."""
    names = ["top_conv", "top_depth", "conv_id", "depth", "up_conv", "up_depth", *VALUES]

    def totals(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.reset_index(drop=True)
        part = rows.groupby(["top_conv", "top_depth"], sort=False).ngroup().to_numpy()
        place = pd.Series(np.arange(len(rows)), index=pd.MultiIndex.from_frame(rows[["conv_id", "depth"]]))
        has = rows["up_conv"].notna().to_numpy()
        up = np.full(len(rows), -1)
        up[has] = place.loc[pd.MultiIndex.from_arrays([rows["up_conv"][has].astype("int64"), rows["up_depth"][has].astype("int64")])].to_numpy()
        found = decompose(part, up, (rows["depth"] - rows["top_depth"]).to_numpy(), rows[list(VALUES)].to_numpy(dtype=np.int64))
        return pd.concat([rows[["conv_id", "depth"]], pd.DataFrame(found, columns=list(VALUES))], axis=1)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in source:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            # The last component may go on in the next batch.
            c, d = held.column("top_conv").to_numpy(), held.column("top_depth").to_numpy()
            whole = np.flatnonzero((c != c[-1]) | (d != d[-1]))
            ready = int(whole[-1]) + 1 if len(whole) else 0
            if ready:
                yield from frames(held.slice(0, ready))
                held = held.slice(ready)
        if held is not None and held.num_rows:
            yield from frames(held)

    def frames(table: pa.Table) -> list[pa.RecordBatch]:
        frame = table.to_pandas(integer_object_nulls=True)
        return pa.Table.from_pandas(totals(frame), preserve_index=False).to_batches()

    dealt = nodes.select(*names).repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth")
    return dealt.mapInArrow(batches, "conv_id long, depth long, " + ", ".join(f"{v} long" for v in VALUES))


def rolled_up(nodes: DataFrame, steps: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, depth, values): the sums of nodes' own ``VALUES`` over their subtrees. ``nodes`` has
    (conv_id, depth, parent_conv_id, values)."""
    first = nodes.agg(F.min(F.struct("depth", "conv_id"))).first()[0]
    if first is None:
        return nodes.select("conv_id", "depth", *VALUES)
    up_depth = F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1)
    held = nodes.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("up_conv"), up_depth.alias("up_depth"), *VALUES,
        F.lit(first["conv_id"]).cast("long").alias("top_conv"), F.lit(0).cast("long").alias("top_depth"),
    )
    sums = None
    top = ["top_conv", "top_depth"]
    while True:
        held = saved(held)
        large = held.groupBy(*top).agg(F.count("*").alias("n")).where(F.col("n") > part).select(*top)
        large = saved(large)
        small = _local(held.join(large, top, "left_anti"))
        sums = small if sums is None else sums.unionByName(small)
        if large.isEmpty():
            break
        held, gained = _split(saved(held.join(large, top)), steps)
        sums = sums.unionByName(gained)
    return sums.groupBy("conv_id", "depth").agg(*[F.sum(v).alias(v) for v in VALUES])


def _ends(lengths: DataFrame, steps: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes at which conversations end. The ids of a node are listed
    by ranges of ids, and the lists read in order by one hash."""
    at = steps.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"])
    listed = at.groupBy(F.col("node_conv"), "depth", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, node, out = None, None, []

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=["conv_id", "depth", "ends_sha256"])
            out.clear()
            return made

        for batch in source:
            if out:
                yield emit()
            for conv, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, depth) != node:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (conv, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
        if node is not None:
            out.append((*node, digest.hexdigest()))
            yield emit()

    key = ["node_conv", "depth"]
    ordered = listed.repartition(*key).sortWithinPartitions(*key, "block").select(*key, "ids")
    return ordered.mapInArrow(batches, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame, part: int = PART, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every
    node of the trie of the rebuilt conversations that ``rows`` (conv_id, turn, role, text) hold."""
    lengths, steps, nodes = trie(rows, stretch)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = saved(own.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("last_bytes")}))
    totals = rolled_up(own.select("conv_id", "depth", "parent_conv_id", *VALUES), steps, part)
    out = own.drop(*VALUES).join(totals, ["conv_id", "depth"]).join(_ends(lengths, steps), ["conv_id", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *VALUES, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


TRIE_SQL = f"""
WITH {CRC32_STEPS_SQL},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id::VARCHAR AS c, max(pos) AS n FROM turns GROUP BY conv_id),
convs AS (SELECT conv_id, n, conv_id - conv_id % {GROUP} AS origin, {crc32_sql('c')} % {HEADS} AS h FROM ids, crc_steps),
made AS (
  SELECT c.conv_id, t.pos AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.origin AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(o.n, 0)), role, text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN convs o ON o.conv_id = c.origin),
chained AS (
  SELECT conv_id, depth, strlen(text) AS last_bytes,
    sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k
  FROM made
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, k) AS node, count(*) OVER (PARTITION BY depth, k) AS n_convs FROM chained),
nodes AS (
  SELECT n.conv_id, n.depth, p.node AS parent_conv_id, n.n_convs, n.last_bytes
  FROM named n LEFT JOIN named p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 WHERE n.conv_id = n.node),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (conv_id, depth)),
totals AS (
  SELECT a.node AS conv_id, a.depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.last_bytes)::BIGINT AS saved_tokens
  FROM own o JOIN named a ON a.conv_id = o.conv_id AND a.depth <= o.depth GROUP BY 1, 2),
ends AS (
  SELECT node AS conv_id, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS length FROM named) WHERE depth = length GROUP BY 1, 2)
SELECT o.conv_id, o.depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM own o JOIN totals USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)"""
