"""Structure repair against the full recurrence over all target lengths."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from panelworks.llm import turn_align

SCHEMA = "conv_id long, turn long, role string, text string, audit string, seq string, cost long, low string"


def brute(turns):
    """(cost, audit) over every target of up to 2n + 3 letters, by the plain recurrence on (cost, audit)."""

    def to(target):
        @cache
        def best(i, j):
            if i == len(turns) and j == len(target):
                return 0, ""
            ways = []
            if i < len(turns):
                initial, gone, cut = turns[i]
                c, a = best(i + 1, j)
                ways.append((c + 4, "D" + a))
                if j < len(target) and not gone:
                    c, a = best(i + 1, j + 1)
                    if initial == target[j]:
                        ways.append((c + 3 * cut, "K" + a))
                    elif target[j] != "s":
                        ways.append((c + 3 + 3 * cut, "R" + a))
            if j < len(target) and target[j] != "s":
                c, a = best(i, j + 1)
                ways.append((c + 3, "I" + a))
            return min(ways, default=(1 << 30, ""))

        return best(0, 0)

    pairs = range(1, len(turns) + 2)
    return min([to("")] + [to("ua" * k) for k in pairs] + [to("s" + "ua" * k) for k in pairs])


def expected(rows):
    """Contract rows of the conversations (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        hurt = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if hit:
                text = "" if hit == 1 else text.translate({ord(x): None for x in ".!?"}) if hit == 2 else text
                hurt += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, n = [], set(), [0, 0, 0]
        for _, role, text in hurt:
            stem = text.strip(" \t\n\v\f\r")
            again = (role, text) in seen
            seen.add((role, text))
            kind = 0 if not stem else 1 if again else 2 if stem[-1] not in ".!?" else None
            if kind is not None:
                n[kind] += 1
            turns.append((role[:1], kind in (0, 1), kind == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        known = [t for t, *_ in hurt if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit = brute(tuple(turns))
        lines, at = [], 0
        for edit in audit:
            if edit == "K":
                lines.append((hurt[at][1], hurt[at][2]))
            elif edit != "D":
                role = "assistant" if lines and lines[-1][0].startswith("u") else "user"
                lines.append((role, "" if edit == "I" else hurt[at][2]))
            at += edit != "I"
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *n, illegal, cost, audit, sha)
    return out


def _turns(rng, n):
    return [(rng.choice("uuaasx "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_alignment_equals_the_full_recurrence():
    rng = random.Random(1)
    for k in range(1500):
        turns = _turns(rng, k % 10)
        assert turn_align.align(turns) == brute(tuple(turns)), turns
    turns = _turns(rng, 60)
    assert turn_align.align(turns) == brute(tuple(turns))


def test_blocks_join_to_the_whole():
    import pandas as pd

    rng = random.Random(2)
    for k in range(300):
        turns = _turns(rng, 2 + k % 30)
        size = rng.randint(1, 5)
        blocks = [turns[i : i + size] for i in range(0, len(turns), size)]
        ways = [{w: {"cost": c, "audit": a} for w, (c, a) in turn_align.transfers(b).items()} for b in blocks]
        parts = pd.DataFrame({"conv_id": 1, "seq": range(len(blocks)), "ways": ways, "first": "u", "last": "a", "low": 0, "high": 0, "distinct_turns": 1} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
        chosen = turn_align._chain(parts)
        assert (chosen["cost"][0], chosen["audit"][0]) == turn_align.align(turns)


def _rows():
    rng = random.Random(3)
    texts = ["Yes.", "No", "Really?", "", " \t\n", "Same again.", None, "long " * 30_000, "ends. \n", "Ünï!", "!?."]
    rows = []
    for conv in range(40):
        roles = ["system"] * (conv % 3 == 0) + ["user", "assistant"] * (conv % 7)
        rows += [(conv, t, r, rng.choice(texts)) for t, r in enumerate(roles)]
    rows += [(50, t % 9, rng.choice(["user", "assistant", "tool", "", None, "Ursula", "unit"]), rng.choice(texts[:6])) for t in range(60)]  # equal turns
    rows += [(51, t, rng.choice(["user", "assistant"]), f"turn {rng.randrange(30)}{rng.choice('. ')}") for t in range(90)]
    rows += [(52, None, "user", "no turn?"), (52, None, None, None), (None, 3, "user", "no id."), (None, None, None, None), (53, 5, "user", "twin."), (53, 5, "user", "twin.")]
    gone = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "Dropped.")]


@pytest.mark.parametrize("block", [4, turn_align.BLOCK])
def test_rows(spark, block):
    rows = _rows()
    df = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in turn_align.damaged_and_repaired(df, block).collect()}
    assert got == expected(rows)


def test_no_rows(spark):
    assert turn_align.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in turn_align.damaged_and_repaired(df).collect()}
    assert got == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
