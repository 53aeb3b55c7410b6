"""Repair of conversation structure by target alignment.

A repaired conversation is an optional system turn and then user and assistant turns in alternation
(role initials ``(s?(ua)+)?``). For each number of turns there is one such string of initials, its target.
The turns of a conversation are aligned to the target of every feasible length by the Wagner-Fischer
recurrence: a turn is kept, given the other role or deleted, and turns without text are inserted. The audit
is the edits' initials in order (D, I, K, R); of all cheapest edits over all lengths, that of the ASCII-least
audit is taken, by backtracing every length that reaches the least cost.

Targets of different lengths share their ends, so one table of costs, indexed by the turns and by the
target letters still to come, serves all lengths. It is filled in a band around the diagonal only (Ukkonen):
a plain left-to-right repair gives an incumbent cost, and an alignment that is further from the diagonal
than that cost buys in deletions or insertions cannot be as cheap. Lengths outside the band are not feasible.

Turns are sorted by range over the cluster, so a conversation may be spread over tasks. A task reads its
turns as a stream and cuts conversations into blocks of at most ``BLOCK`` turns. A conversation of one
block that lies within a task is finished there. A block of any other is aligned from each state in which
it can begin (nothing written, or after a system, user or assistant turn) to each in which it can end; the
chain of a conversation's blocks, a few small rows each, is then joined backwards from the last. A block's
audits between two states are of equal cost and cover the same turns, so none is a prefix of another and
the least one of the chain is made of least parts. The repaired turns are hashed as a stream in block order.
So no step holds the texts of a conversation; its audit and the choice of its parts, a few bytes a turn,
are one row by nature.

Defined results: a null role or text counts as one space, and a null id or turn as one space in the damage
hash. Rows of equal turn are ordered by role and text, null turns come first. A null id is a conversation
of its own. Equal rows are turns of their own, the later ones duplicates. An empty table gives no rows.
Other columns are ignored, whatever their names. Texts are read whole at any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import CRC32_STEPS_SQL, crc32_sql, saved

BLOCK = 128  # turns aligned together
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3  # costs; CUT is added for a truncated turn that stays
_FAR = 1 << 40
_OTHER = {"u": "a", "a": "u"}
_ROLE = {"u": "user", "a": "assistant"}
_SPACE = r" \t\n\u000B\f\r"  # SQL string escapes of the ASCII white space

# A turn as the alignment sees it: its role's initial, whether it must go, and whether it is truncated.
Turn = tuple[str, bool, bool]


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the hash of id and turn orders."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("hit")).where("hit != 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def _costs(turns: list[Turn], last: str, bound: int) -> list[list[int]]:
    """``cost[i][r]``: aligning the turns from i on to the last r letters of an alternation that ends in
    ``last``, within the band that ``bound`` allows."""
    n = len(turns)
    more, less = bound // INSERT + 1, bound // DELETE + 1
    width = n + more + 2
    below = [_FAR] * (width + 1)
    for r in range(min(more, width) + 1):
        below[r] = INSERT * r
    out = [below]
    for i in range(n - 1, -1, -1):
        initial, gone, cut = turns[i]
        keep = CUT if cut else 0
        here = [_FAR] * (width + 1)
        low = max(0, n - i - less)
        left = _FAR
        for r in range(low, n - i + more + 1):
            best = below[r] + DELETE
            if r:
                if left + INSERT < best:
                    best = left + INSERT
                if not gone:
                    letter = last if r & 1 else _OTHER[last]
                    stay = below[r - 1] + keep + (0 if initial == letter else REROLE)
                    if stay < best:
                        best = stay
            here[r] = left = best
        out.append(here)
        below = here
    return out[::-1]


def _audit(turns: list[Turn], cost: list[list[int]], last: str, i: int, r: int) -> str:
    """The ASCII-least audit of the cheapest edits from (i, r) on."""
    n, out = len(turns), []
    while i < n or r:
        here = cost[i][r]
        if i < n and here == cost[i + 1][r] + DELETE:
            out.append("D")
            i += 1
        elif r and here == cost[i][r - 1] + INSERT:
            out.append("I")
            r -= 1
        else:
            out.append("K" if turns[i][0] == (last if r & 1 else _OTHER[last]) else "R")
            i, r = i + 1, r - 1
    return "".join(out)


def incumbent(turns: list[Turn], first: str) -> int:
    """Cost of a plain repair from left to right, the first letter given, any last letter and at least
    two letters allowed for."""
    want, cost = first, 0
    for initial, gone, cut in turns:
        if gone:
            cost += DELETE
            continue
        if initial != want:
            cost += REROLE
        cost += CUT if cut else 0
        want = _OTHER[want]
    return cost + 2 * INSERT


def transfers(turns: list[Turn], entries: str = "NSUA", exits: str = "NSUA") -> dict[str, tuple[int, str]]:
    """Least cost and audit of the turns from each state to each: N nothing written, S, U and A after a
    system, user or assistant turn. Keys are entry and exit."""
    n = len(turns)
    out: dict[str, tuple[int, str]] = {}

    def offer(way: str, cost: int, audit: Callable[[], str]) -> None:
        if way not in out or cost < out[way][0]:
            out[way] = cost, audit()
        elif cost == out[way][0]:
            out[way] = min(out[way], (cost, audit()))

    for state in "NS":  # no letter written
        if state in entries and state in exits:
            offer(2 * state, DELETE * n, lambda: "D" * n)
    systems = [m for m, (initial, gone, _) in enumerate(turns) if initial == "s" and not gone] if "N" in entries else []
    if "S" in exits:
        for m in systems:
            offer("NS", DELETE * (n - 1) + CUT * turns[m][2], lambda m=m: "D" * m + "K" + "D" * (n - m - 1))
    bound = max(incumbent(turns, x) for x in "ua")
    for end in exits:
        if end not in "UA":
            continue
        last = end.lower()
        cost = _costs(turns, last, bound)
        for entry in entries:
            first = "a" if entry == "U" else "u"
            # Lengths of an alternation from ``first`` to ``last``; none at all only where the state stays.
            lengths = range(1 if first == last else 0 if entry == end else 2, len(cost[0]), 2)
            best = min((cost[0][r] for r in lengths), default=_FAR)
            for r in lengths:
                if cost[0][r] == best < _FAR:
                    offer(entry + end, best, lambda r=r: _audit(turns, cost, last, 0, r))
            if entry == "N":
                lengths = range(1 if last == "u" else 2, len(cost[0]), 2)
                starts = [(DELETE * m + CUT * turns[m][2] + cost[m + 1][r], m, r) for m in systems if DELETE * m <= bound for r in lengths]
                best = min((s[0] for s in starts), default=_FAR)
                for _, m, r in (s for s in starts if s[0] == best < _FAR):
                    offer(entry + end, best, lambda m=m, r=r: "D" * m + "K" + _audit(turns, cost, last, m + 1, r))
    return out


def align(turns: list[Turn]) -> tuple[int, str]:
    """Least cost and ASCII-least audit of a whole conversation."""
    return min(transfers(turns, "N", "NA").values())


def repaired(rows: list[tuple[str, str]], audit: str, state: str) -> tuple[list[str], str]:
    """The ``role:text`` lines that the audit makes of rows (role, text), and the state after them."""
    out, at = [], 0
    for edit in audit:
        if edit != "I":
            role, text = rows[at]
            at += 1
            if edit == "D":
                continue
        if edit == "K":
            state = role[0].upper()
            out.append(f"{role}:{text}")
            continue
        state = "A" if state == "U" else "U"
        out.append(f"{_ROLE[state.lower()]}:{'' if edit == 'I' else text}")
    return out, state


@dataclass
class _Block:
    """Turns of one conversation in a row, and what is counted of them."""

    conv: object
    turns: list[Turn] = field(default_factory=list)
    rows: list[tuple[str, str]] = field(default_factory=list)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])  # blank, duplicate, truncated, illegal
    low: int | None = None
    high: int | None = None
    distinct: int = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        stem = text.rstrip(" \t\n\x0b\f\r")
        cut = not again and stem != "" and stem[-1] not in ".!?"
        if self.turns and self.turns[-1][0] + role[:1] not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.counts[0] += not stem
        self.counts[1] += bool(stem) and again
        self.counts[2] += cut
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += self.high != turn
            self.high = turn
        self.turns.append((role[:1], again or not stem, cut))
        self.rows.append((role, text))


_STATS = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, distinct_turns long"


def _blocks(rows: DataFrame, kind: str, block: int) -> DataFrame:
    """Finished conversations and blocks of the others, from rows sorted within partitions."""
    schema = f"conv_id {kind}, seq long, {_STATS}, cost long, audit string, sha string, ways map<string, struct<cost: long, audit: string>>, rows array<struct<role: string, text: string>>"

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        form = None
        made = 0

        def close(held: _Block, whole: bool) -> None:
            nonlocal made
            stats = (*held.counts, held.turns[0][0], held.turns[-1][0], held.low, held.high, held.distinct)
            if whole:
                cost, audit = align(held.turns)
                sha = hashlib.sha256("\n".join(repaired(held.rows, audit, "N")[0]).encode("utf-8", "replace")).hexdigest()
                out.append((held.conv, None, *stats, cost, audit, sha, None, None))
            else:
                ways = [(k, {"cost": c, "audit": a}) for k, (c, a) in transfers(held.turns).items()]
                out.append((held.conv, part + made, *stats, None, None, None, ways, [{"role": r, "text": t} for r, t in held.rows]))
                made += 1

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in form]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, form)], schema=form)

        held: _Block | None = None
        inner = False  # a conversation that began in this task, not with its first row
        before = None
        for batch in source:
            if form is None:
                struct = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
                types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 4 + [pa.string()] * 2 + [pa.map_(pa.string(), struct), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
                names = "seq blank duplicate truncated illegal first last low high distinct_turns cost audit sha ways rows".split()
                form = pa.schema([("conv_id", batch.schema.field(0).type), *zip(names, types)])
            conv, turn, role, text, later = (c.to_pylist() for c in batch.columns)
            for row in zip(conv, turn, role, text, later):
                if held is None or row[0] != held.conv:
                    if held is not None:
                        close(held, inner)
                        inner = True
                    held = _Block(row[0])
                elif len(held.turns) == block:
                    close(held, False)
                    inner = False  # its other blocks are joined as well
                    held = _Block(row[0])
                held.add(row[1], row[2], row[3], row[4] or row[:4] == before)
                before = row[:4]
                if len(out) >= 2000:
                    yield emit()
        if held is not None:
            close(held, False)  # it may go on in the next partition
        if form is not None:
            yield emit()

    return rows.mapInArrow(batches, schema)


def _chain(parts: pd.DataFrame) -> pd.DataFrame:
    """The chosen entry state and audit of each block of one conversation, with the conversation's counts."""
    parts = parts.sort_values("seq").reset_index(drop=True)
    # Per entry state: cost to the end, and the chain of audits as (audit, exit, rest).
    best: dict[str, tuple] = {"N": (0, None), "A": (0, None)}
    for ways in reversed(parts["ways"].tolist()):
        now: dict[str, tuple] = {}
        for way, step in (ways.items() if isinstance(ways, dict) else ways):
            rest = best.get(way[1])
            if rest is not None:
                found = (step["cost"] + rest[0], (step["audit"], way[1], rest[1]))
                held = now.get(way[0])
                if held is None or found[0] < held[0] or found[0] == held[0] and _before(found[1], held[1]):
                    now[way[0]] = found
        best = now
    total, link = best["N"]
    entries, audits, state = [], [], "N"
    while link is not None:
        entries.append(state)
        audits.append(link[0])
        state, link = link[1], link[2]
    edges = (parts["last"].shift().fillna("") + parts["first"])[1:]
    known = parts[parts["distinct_turns"] > 0]
    shared = int((known["low"] == known["high"].shift()).sum())
    gaps = int(known["high"].max() - known["low"].min() + 1 - (known["distinct_turns"].sum() - shared)) if len(known) else 0
    return pd.DataFrame({
        "conv_id": parts["conv_id"], "seq": parts["seq"], "entry": entries, "part": audits, "first": [True] + [False] * (len(parts) - 1), "gaps": gaps,
        "blank": int(parts["blank"].sum()), "duplicate": int(parts["duplicate"].sum()), "truncated": int(parts["truncated"].sum()),
        "illegal": int(parts["illegal"].sum() + (~edges.isin(["su", "ua", "au"])).sum()), "cost": total, "audit": ["".join(audits)] + [None] * (len(parts) - 1),
    })


def _before(x: tuple, y: tuple) -> bool:
    """Whether the concatenated audits of chain x come before those of y."""
    a = b = ""
    while True:
        while not a and x is not None:
            a, _, x = x
        while not b and y is not None:
            b, _, y = y
        if not a or not b:
            return not a and bool(b)
        size = min(len(a), len(b))
        if a[:size] != b[:size]:
            return a[:size] < b[:size]
        a, b = a[size:], b[size:]


def _hashed(pieces: DataFrame, kind: str) -> DataFrame:
    """(conv_id, sha) of the repaired turns, blocks read in order."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shas, digest, form = [], [], None, None
        for batch in source:
            form = form or batch.schema.field(0).type
            for conv, entry, audit, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or conv != ids[-1]:
                    if digest is not None:
                        shas.append(digest.hexdigest())
                    ids.append(conv)
                    digest, empty = hashlib.sha256(), True
                for line in repaired([(r["role"], r["text"]) for r in rows], audit, entry)[0]:
                    digest.update((line if empty else "\n" + line).encode("utf-8", "replace"))
                    empty = False
        if digest is not None:
            shas.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, form), pa.array(shas, pa.string())], names=["conv_id", "sha"])

    return pieces.mapInArrow(batches, f"conv_id {kind}, sha string")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the
    conversations (conv_id, turn, role, text) that ``rows`` hold; none for ids without rows."""
    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    role_text = (F.xxhash64("role", "text"), F.xxhash64(F.lit("turn"), "text", "role"))
    keyed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", role_text[0].alias("ha"), role_text[1].alias("hb"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # null turns first
    firsts = keyed.groupBy("conv_id", "ha", "hb").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first != final")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("ha").alias("a"), F.col("hb").alias("b"), "first")
    seen = keyed.join(firsts, _same("conv_id", "c") & (F.col("ha") == F.col("a")) & (F.col("hb") == F.col("b")), "left")
    seen = seen.select("conv_id", "turn", "role", "text", F.coalesce(place > F.col("first"), F.lit(False)).alias("later"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn")]
    spread = seen.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    found = saved(_blocks(spread, kind, block))

    counts = ["blank", "duplicate", "truncated", "illegal"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct_turns"), F.lit(0)).alias("gaps")
    whole = found.where("seq is null").select("conv_id", gaps, *counts, "cost", "audit", F.col("sha").alias("repaired_sha256"))
    parts = found.where("seq is not null")
    chain = f"conv_id {kind}, seq long, entry string, part string, first boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    chosen = saved(parts.select("conv_id", "seq", *counts, "first", "last", "low", "high", "distinct_turns", "ways").groupBy("conv_id").applyInPandas(_chain, chain))
    pieces = parts.select("conv_id", "seq", "rows").join(chosen.select("seq", "entry", "part"), "seq")
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "entry", "part", "rows")
    shas = _hashed(pieces, kind).select(F.col("conv_id").alias("c"), F.col("sha").alias("repaired_sha256"))
    joined = chosen.where("first").select("conv_id", "gaps", *counts, "cost", "audit").join(shas, _same("conv_id", "c")).drop("c")
    return whole.unionByName(joined)


def damaged_and_repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``repair`` after ``damage``, with a row for every id of ``rows``; an id that loses all its turns
    has zeros, an empty audit and the hash of nothing."""
    hurt = saved(damage(rows))
    found = repair(hurt, block)
    names = [c for c in found.columns if c != "conv_id"]
    found = found.withColumnRenamed("conv_id", "c")
    out = rows.select("conv_id").distinct().join(found, _same("conv_id", "c"), "left")
    blank = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return out.select("conv_id", *[F.coalesce(c, blank.get(c, F.lit(0))).alias(c) for c in names])


def _sql() -> str:
    """The same rows by four running states a conversation in place of tables of target letters."""

    def step(state: str, cost: str, edit: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'x': {state}.x || '{edit}'}}"

    def use(state: str, letter: str) -> str:
        return f"CASE WHEN NOT gone THEN CASE WHEN initial = '{letter}' THEN {step(state, 'cut', 'K')} ELSE {step(state, '3 + cut', 'R')} END END"

    def least(*states: str) -> str:
        return f"list_min(list_filter([{', '.join(states)}], lambda v: v.c IS NOT NULL))"

    u = least("u", step("n", "3", "I"), step("s", "3", "I"), step("a", "3", "I"))
    a = least("a", step("u2", "3", "I"))
    kept_s = f"CASE WHEN initial = 's' AND NOT gone THEN {step('n', 'cut', 'K')} END"
    return f"""
WITH RECURSIVE {CRC32_STEPS_SQL},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
hit AS (SELECT keyed.*, {crc32_sql('k')} % 20 AS hit FROM keyed, crc_steps),
hurt AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE hit <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM hurt),
placed AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open_end
  FROM ordered),
turns AS (
  SELECT conv_id, pos, turn, role, text, initial, blank, again AND NOT blank AS duplicate, open_end AND NOT again AND NOT blank AS truncated,
    blank OR again AS gone, CASE WHEN open_end AND NOT again AND NOT blank THEN 3 ELSE 0 END AS cut,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal, max(pos) AS size
  FROM turns GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'x': ''}} AS n, NULL::STRUCT(c BIGINT, x VARCHAR) AS s, NULL::STRUCT(c BIGINT, x VARCHAR) AS u, NULL::STRUCT(c BIGINT, x VARCHAR) AS a FROM counts
  UNION ALL
  SELECT conv_id, i + 1, {step('n', '4', 'D')}, {least(step('s', '4', 'D'), kept_s)},
    {least(step('u2', '4', 'D'), use('n', 'u'), use('s', 'u'), use('a2', 'u'))}, {least(step('a2', '4', 'D'), use('u2', 'a'))}
  FROM (SELECT *, {a} AS a2 FROM (
    SELECT w.*, t.initial, t.gone, t.cut, {u} AS u2 FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.i + 1) x) y),
ends AS (
  SELECT conv_id, gaps, blank, duplicate, truncated, illegal, {least('n', 'a2')} AS best
  FROM (SELECT *, {a} AS a2 FROM (
    SELECT c.*, w.n, w.s, w.u, w.a, {u} AS u2 FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.size) x) y),
edits AS (
  SELECT conv_id, k, best.x[k] AS edit, length(replace(best.x, 'D', '')) % 2 AS odd,
    length(replace(best.x[1:k], 'I', '')) AS pos, length(replace(best.x[1:k], 'D', '')) AS place
  FROM (SELECT *, unnest(range(1, length(best.x) + 1)) AS k FROM ends) e),
made AS (
  SELECT e.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.pos = e.pos AND e.edit <> 'I' WHERE edit <> 'D' GROUP BY e.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.x, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM o.conv_id"""


TURN_SQL = _sql()
