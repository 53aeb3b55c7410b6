"""Passages that documents share against brute force over all runs of words."""

import random
from collections import defaultdict

import numpy as np
import pytest

from panelworks.llm import passages

SCHEMA = "doc_id long, text string, first_word string, n_words string, t string, component_id string"


def shared_runs(rows, size):
    """{doc: places of the runs of ``size`` words that another text holds}, the ids of the documents whose
    whole text has a copy, and the words of the texts."""
    seen, texts = defaultdict(set), {t: t.encode().lower().split() for _, t in rows if t}
    for t, w in texts.items():
        for p in range(len(w) - size + 1):
            seen[tuple(w[p : p + size])].add(t)
    count = defaultdict(int)
    for _, t in rows:
        count[t] += 1
    copied = {i for i, t in rows if t and count[t] > 1 and len(texts[t]) >= 50}
    places = {t: [p for p in range(len(w) - size + 1) if len(seen[tuple(w[p : p + size])]) > 1] for t, w in texts.items()}
    return {i: places.get(t, []) for i, t in rows}, copied, texts


def check(rows, got):
    certain, copied, texts = shared_runs(rows, passages.WORDS)
    possible, _, _ = shared_runs(rows, passages.LONG)
    covered = defaultdict(set)
    for r in got:
        covered[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    slack = passages.WORDS - passages.LONG
    for i, t in rows:
        if i in copied:
            assert covered[i] == set(range(len(texts[t])))
            continue
        shared = {w for p in possible[i] for w in range(p, p + passages.LONG)}
        assert covered[i] <= shared  # nothing but shared words
        needed = {w for p in certain[i] for w in range(p + slack, p + passages.WORDS - slack)}
        assert needed <= covered[i]  # every shared run, but for the ends


def _docs(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [[word() for _ in range(n)] for n in (60, 55, 51, 50, 39, 200)]
    rows = []
    for i in range(80):
        parts = [[word() for _ in range(rng.randrange(0, 120))]]
        for k in rng.sample(range(6), rng.choice([0, 1, 2])):
            parts += [shared[k], [word() for _ in range(rng.randrange(0, 90))]]
        flat = [w for p in parts for w in p]
        wrap = rng.choice([7, 12, 10_000])  # passages inside long lines and across short ones
        rows.append((i, "\n".join(" ".join(flat[j : j + wrap]) for j in range(0, len(flat), wrap))))
    rows += [(100, " ".join(shared[0]).upper()), (101, "\t".join(shared[5][50:150])), (102, None), (103, ""), (104, "x " * 400), (105, " ".join(shared[3] * 3))]
    return rows + [(200 + i, rows[i][1]) for i in range(0, 30, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, seed):
    rows = _docs(seed)
    got = passages.repeated_passages(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(4)).collect()
    check(rows, got)
    groups = defaultdict(list)
    for r in got:
        groups[r.component_id].append((r.doc_id, r.first_word, r.removed))
    for name, g in groups.items():
        first = min(g)
        assert name == f"{first[0]}:{first[1]}" and [x for x in g if not x[2]] == [first]
        assert len(g) > 1 and {r.component_size for r in got if r.component_id == name} == {len(g)}


def test_ids_rows_and_tables_of_every_kind(spark):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(None, text), (5, text), (5, text), (8, "start " + text), (6, "no"), (6, "no"), (7, " ".join(f"v{i % 55}" for i in range(165)))]
    got = {(r.doc_id, r.component_id, r.component_size, r.removed) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, "5:0", 4, False), (5, "5:0", 4, True), (8, "5:0", 4, True), (None, "5:0", 4, True)}
    assert passages.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_passages_of_the_corpus_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = passages.repeated_passages(docs).collect()
    assert len(got) > 100
    check([tuple(r) for r in docs.collect()], got)


def test_run_hashes_are_those_of_the_words():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for size in (1, 2, 5, 25, 50):
        twice = np.concatenate([words[:100], words[50:200]])
        a, b = passages.runs(words, size), passages.runs(twice, size)
        assert len(a) == 301 - size and a[60] == b[110] == passages.runs(words[60 : 60 + size], size)[0]
        assert len(set(a.tolist())) == len(a)
    assert len(passages.runs(words[:3], 5)) == 0


def test_one_scan_serves_both_searches(spark):
    from panelworks.llm import catalog, paragraphs

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = catalog.op4_paragraph_dedup(spark, sf).collect()
    lines, shared = paragraphs.repeated_paragraphs(docs), passages.repeated_passages(docs)
    pick = lambda rows, names: sorted((tuple(r[n] for n in names) for r in rows), key=str)
    for kind, alone in (("paragraph", lines), ("passage", shared)):
        names = alone.columns
        assert pick([r for r in got if r.kind == kind], names) == pick(alone.collect(), names)
    assert {r.kind for r in got} == {"paragraph", "passage"}
    assert passages.scan(spark.createDataFrame([(None, None), (1, ""), (1, " ")], "doc_id long, text string")).count() == 0
