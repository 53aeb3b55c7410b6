"""Corpus operators against brute force and on odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import connect, difference
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from panelworks.llm import bpe, cap_filters, hnsw, html_extract, lang_id, license_scan, line_dedup, mixing, near_copies, paragraphs, simhash
from panelworks.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, size long, copies string, ka string, fp string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def _rows():
    texts = [
        "the cat sat on the mat", "the cat sat on the mat", None, "", "   \n\t ", "a\n\nb\n\n", LONG, PASSAGE, f"own start\n{PASSAGE}\nown end",
        "Licensed under the Apache License, Version 2.0.", "x", "Ünïcödé  straße ＡＢＣ <|endoftext|> d'été 123", PASSAGE + "\n" + PASSAGE,
        "cc by\nCC-BY  gnu GENERAL public license", "the cat sat on the mat",
    ]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), 1, 2, "c", "k", "f") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, PASSAGE, "xx", "s1", 1, 1, 2, "c", "k", "f"), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if re.match(r"op\d+_", n)])
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) and difference(got, connect(SF).execute(entry.oracle_sql()[name]).df()) is None


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _fingerprint(text):
    w = _words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_simhash(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(_rows())
    assert Counter(r.fp % 2**64 for r in got) == Counter(_fingerprint(t) for _, t, *_ in _rows())
    fps = sorted({r.fp % 2**64 for r in got})
    links = [(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = dict(zip(fps, _roots(len(fps), links)))
    for r in got:
        ids = [s.doc_id for s in got if root[s.fp % 2**64] == root[r.fp % 2**64] and s.doc_id is not None]
        assert r.component_id == min(ids)
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprints_link_through_chains(spark):
    base = [0, 1, 3, 7, 15, 31, 1 << 40, (1 << 40) | 3 << 50, (1 << 40) | 7 << 50, -1]
    fps = spark.createDataFrame([(v,) for v in base], "fp long")
    kept = {r.fp for r in simhash.survivors(fps).collect()}
    got = {frozenset((r.a, r.b)) for r in simhash.links(fps).collect()}
    want = [(a, b) for a in base for b in base if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert {v for p in want for v in p} <= kept and -1 not in {v for p in got for v in p}
    index = {v: i for i, v in enumerate(base)}
    assert _roots(10, [(index[a], index[b]) for a, b in want]) == _roots(10, [tuple(index[v] for v in p) for p in got])


def test_pipeline_drops_near_copies(spark):
    base = [f"near{i}" for i in range(200)]
    edited = lambda *places: " ".join("edit" if i in places else w for i, w in enumerate(base))
    texts = [" ".join(base), edited(50, 120), edited(20, 70, 120, 170), edited(*range(10, 200, 20)), " ".join(base).upper(), "a b", "a c", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "no id here", "en", "s", 10), (None, "nor does this one", "en", "s", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert (_fingerprint(texts[0]) ^ _fingerprint(texts[2])).bit_count() > 2  # beyond the links of op1
    kept = corpus_pipeline.dedup_near_copies(spark, docs, SF).collect()
    # Two and four edits leave 186 and 176 of 196 shingles (0.90 and 0.81), ten leave 0.6.
    assert Counter(r.doc_id for r in kept) == Counter({0: 1, 3: 1, 5: 1, 6: 1, 7: 1, None: 2})


def test_near_copies_come_from_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = []
    for n in (8, 9, 12, 20, 33, 60, 150, 400) * 4:
        words = [f"w{v}" for v in rng.integers(0, 10**6, n)]
        texts.append(words)
        for more in (n // 5 - 1, n // 4, n // 3):  # tails that leave about 0.8 of the shingles, or less
            texts.append(words + [f"t{v}" for v in rng.integers(0, 10**6, max(more, 1))])
        texts.append(["first", *words[1:]])
    group = [f"g{i}" for i in range(120)]
    texts += [[*group[:i], "edit", *group[i + 1 :]] for i in range(5, 115)] + [["one"], ["one", "two"], []]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)} for w in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    prints = [simhash.wide_fingerprint(paragraphs.shingles([x.encode() for x in w])) for w in texts]
    bits = [sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(prints[i], prints[j])) for i, j in links]
    assert 10 < max(bits) <= simhash.WIDE_BITS and len(links) > 5000

    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    by_root = lambda: Counter(frozenset(ids) for ids in near_copies.near_copies(docs).groupBy("root").agg(F.collect_list("doc_id")).toPandas().iloc[:, 1])
    root = _roots(len(texts), links)
    assert by_root() == Counter({frozenset(i for i in range(len(texts)) if root[i] == r): 1 for r in set(root)})
    monkeypatch.setattr(simhash, "WIDE_BITS", -1)  # no fingerprints within the bound: no links
    assert set(by_root()) == {frozenset([i]) for i in range(len(texts))}


def test_nearly_similar_groups_are_not_verified_by_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(150)]

    def edited(n, name):
        words = list(base)
        for i in range(n):
            words[int(rng.integers(150 * i // n, 150 * (i + 1) // n))] = f"{name}{i}"
        return words

    # Five edits leave 0.83 of a text's shingles or more, so they link texts to the base, few to each other.
    texts = [base, *[edited(5, f"e{i}x") for i in range(150)], *[edited(2, f"f{i}x") for i in range(10)]]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    apart = [edited(10, f"g{i}x") for i in range(150)]  # 0.6 to 0.8 of their shingles are left: similar to none
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([*texts, *apart])], "doc_id long, text string")
    asked = []
    similar = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, sets: asked.append(pairs.count()) or similar(pairs, sets))
    groups = near_copies.near_copies(docs).groupBy("root").agg(F.collect_list("doc_id").alias("ids")).collect()
    root = _roots(len(texts), links)
    want = {frozenset(i for i in range(len(texts)) if root[i] == r) for r in set(root)} | {frozenset([len(texts) + i]) for i in range(len(apart))}
    assert {frozenset(g.ids) for g in groups} == want
    assert sum(asked) < 4 * len(texts)


def test_pairs_of_many_cells_are_given_out_once(spark):
    rng = np.random.default_rng(9)
    bits = rng.integers(0, 2, 512)
    near = [np.where(rng.random(512) < 0.06, 1 - bits, bits) for _ in range(12)]
    rows = [(i, i, 100, 100, np.packbits(b.astype(np.uint8), bitorder="little").view("<i8").tolist()) for i, b in enumerate(near)]
    prints = spark.createDataFrame(rows, "cid long, root long, n long, shared long, words array<long>")
    pairs = [(r.a, r.b) for r in simhash._torn_pairs(simhash._cells(prints, "cid", "root", "n", "shared")).collect()]
    assert Counter(pairs) == Counter((i, j) for j in range(12) for i in range(j))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 300), (None, 3), (250, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}


def _vectors(n=300):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((n, 16))
    v[50:80] = v[0] + 0.05 * rng.standard_normal((30, 16))
    v[80:90] = v[1]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1e300] * 16, [1.0, 2.0]]
    return rows + [(n + i, x) for i, x in enumerate(odd)] + [(None, [1.0] * 16)]


def test_embedding_dedup(spark):
    rows = _vectors()
    got = {r.vec_id: r for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = [(i, np.array(v) / max(v)) for i, v in rows[:300]] + [(306, np.ones(16))]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    root = _roots(len(ids), list(zip(*np.nonzero(near))))
    assert len(got) == len(rows)
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum(), ids[root[k]], root[k] == k)
    assert all(got[i].n_links == 0 and got[i].kept for i in (300, 301, 302, 303, 304, 305, 307, None))
    assert cap_filters.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n", [20_000, 1_000_000, 30_000_000])
def test_near_vectors_share_a_filter_at_any_size(n):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((2, 800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    code, passed = cap_filters.Code(64, cap_filters.code_words(n, 64)), cap_filters.passed_filters(n)
    common = []
    for at in range(0, 800, 20):
        a, b = (cap_filters.decode(v[at : at + 20], code, passed) for v in (x, y))
        common += [len(np.intersect1d(*r)) for r in zip(a, b)]
    assert sum(c == 0 for c in common) <= 1 and np.mean(common) > 25


def test_nearest(spark):
    rows = _vectors(600)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id is null or vec_id < 606")
    got = hnsw.nearest(table, table["vec_id"] % 20 == 0, k=20).toPandas()
    x = np.array([v for _, v in rows[:600]])
    hits = 0
    for q, found in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(600), -score))[:20]
        found = found.sort_values("rank")
        assert list(found["rank"]) == list(range(1, 21)) and np.allclose(found["score"], score[found["vec_id"]])
        hits += len(set(best) & set(found["vec_id"]))
    assert got["query_id"].nunique() == 30 and hits / 600 >= 0.9
    assert hnsw.nearest(table.limit(0), table["vec_id"] % 20 == 0).count() == 0


def test_paragraphs(spark, odd, none):
    near = PASSAGE.split()
    near[30] = "changed"
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50, " ".join(near) + " tail"), (51, "alone " * 3)], "doc_id long, text string"))
    got = paragraphs.repeated_paragraphs(docs).collect()
    assert Counter((r.doc_id, r.line) for r in got) == Counter({(7, 0): 2, (8, 1): 1, (12, 0): 1, (12, 1): 1, (None, 0): 1, (50, 0): 1})
    assert {r.component_id for r in got} == {"7:0"} and {(r.doc_id, r.line) for r in got if not r.removed} == {(7, 0)}
    assert paragraphs.repeated_paragraphs(none).count() == 0


def test_wrapped_paragraphs(spark):
    wrap = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    table = "\n".join(f"row {i} value" for i in range(30))
    texts = [wrap(PASSAGE, 10), wrap(PASSAGE, 10), f"Title here\n\n{wrap(PASSAGE, 7)}\n\nThe end", table, f"{PASSAGE}x\n{table}", "Title here\n\nThe end"]
    got = paragraphs.repeated_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line, r.n_lines, r.component_id, r.removed) for r in got} == {
        (0, 0, 6, "0:0", False), (1, 0, 6, "0:0", True), (2, 2, 9, "0:0", True), (4, 0, 1, "0:0", True), (3, 0, 30, "3:0", False), (4, 1, 30, "3:0", True),
    }
    assert len(got) == 6


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lang_id.identify(docs, spark.read.parquet(f"{SF}/pages.parquet")).toPandas()
    both = found[found.doc_id.notna()].merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (both.lang_x == both.lang_y).mean() > 0.97 and both.kept.mean() > 0.98
    half = docs.where("doc_id % 2 = 0")
    known = lang_id.languages(half, "lang", 5)
    assert list(known) == ["de", "en", "es", "fr"]
    held_out = lang_id.likelihoods(docs.where("doc_id % 2 = 1").select("lang", "text"), "text", lang_id.fit(half, "text", "lang", known)).toPandas()
    assert np.mean([list(known)[int(np.argmax(x))] == y for x, y in zip(held_out.lls, held_out.lang)]) > 0.95
    kept = lang_id.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert lang_id.keep_identified(none).count() == 0 and lang_id.identify(none).count() == 0


def test_languages_come_from_the_labels(spark):
    rng = np.random.default_rng(0)
    words = {"it": "che della perché gli questo sono anche città nella più".split(), "nl": "het niet een voor zijn maar ook naar wordt door zij".split(), "eo": "kaj estas la mi vi ĉiuj".split()}
    made = [(10_000 + i, " ".join(rng.choice(words[lang], 60)), lang, "s", 1) for lang, n in (("it", 100), ("nl", 100), ("eo", 4)) for i in range(n)]
    made = [(10_000 + i, *r[1:]) for i, r in enumerate(made)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    every = docs.union(spark.createDataFrame([*made, (20_000, None, "it", "s", 0), (20_001, "...", "eo", "s", 3)], docs.schema))
    kept = {r.doc_id: r.lang for r in lang_id.keep_identified(every).collect()}
    assert {i: kept.get(i) for i, *_ in made} == {i: lang for i, _, lang, *_ in made}  # four are too few for a model
    assert 20_000 not in kept and 20_001 not in kept
    before = {r.doc_id: r.lang for r in lang_id.keep_identified(docs).collect()}
    assert np.mean([kept.get(i) == lang for i, lang in before.items()]) > 0.98
    unlabelled = docs.limit(5).withColumn("lang", F.lit(None).cast("string"))
    assert lang_id.keep_identified(unlabelled).count() == 0


def test_bpe(spark, odd, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.word_bpe_path())
    got = {r.doc_id: r for r in bpe.digests(bpe.encode(odd.where("doc_id is not null"))).collect()}
    for i, t, *_ in _rows():
        if i is not None:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            decoded = lib.decode(ids, skip_special_tokens=False)
            want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    assert bpe.encode(none).count() == 0


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd_pages = [(900, "u", None), (901, None, ""), (902, "u", "just text &amp; more"), (903, "u", "<p>" * 3000 + "deep" + "<div class='ad' <b")]
    found = html_extract.extract(pages.select("page_id", "url", "html").union(spark.createDataFrame(odd_pages, "page_id long, url string, html string"))).toPandas().set_index("page_id")
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [html_extract.html.unescape(re.sub("<[^>]*>", " ", b)) for b in re.split("</?(?:p|h1)>", inner)]
        assert found.text[r.page_id] == "\n".join(" ".join(b.split()) for b in blocks if b.strip())
    assert found.text[900] == found.text[901] == "" and (found.n_chars == found.text.str.len()).all()
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("held_out", range(len(html_extract.LAYOUTS)))
def test_html_unseen_layouts(held_out, monkeypatch):
    layouts = html_extract.LAYOUTS
    monkeypatch.setattr(html_extract, "LAYOUTS", layouts[:held_out] + layouts[held_out + 1 :])
    model = html_extract.train([])
    monkeypatch.setattr(html_extract, "LAYOUTS", (layouts[held_out],))
    monkeypatch.setattr(html_extract, "_MAIN_NAMES", [])
    monkeypatch.setattr(html_extract, "_OTHER_NAMES", [])
    right = [(p >= 0.5) == (s == html_extract.MAIN) for nodes, states in html_extract.layout_pages(5, seed=3) for n, p, s in zip(nodes, model.marginals(nodes), states) if n.tag == "#text"]
    assert np.mean(right) > 0.6


def test_marginals_equal_enumeration():
    nodes = html_extract.parse("<div class=menu><a>one</a><p>Some more text here.</p></div><p>Last.</p>")
    model = html_extract.train([])
    own = [model.evidence(nodes, i) for i in range(len(nodes))]
    total, main = 0.0, np.zeros(len(nodes))
    for code in range(3 ** len(nodes)):
        y = [code // 3**i % 3 for i in range(len(nodes))]
        p = np.prod([own[i][y[i]] for i in range(len(nodes))]) * np.prod([model.trans[y[n.parent]][y[i]] for i, n in enumerate(nodes) if i])
        total += p
        main += p * (np.array(y) == html_extract.MAIN)
    assert np.allclose(model.marginals(nodes), main / total)


def test_licenses(spark, odd, none):
    got = {r.doc_id: r for r in license_scan.license_scan(odd.where("doc_id is not null")).collect()}
    assert (got[9].base_labels, got[9].labels, got[9].score) == ("apache", "apache,apache-2.0", 1.0)
    assert (got[13].n_base, got[13].first_word, got[13].last_word, got[13].base_labels) == (3, 0, 4, "cc-by,gpl")
    assert (got[2].n_words, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0) and got[6].n_words == 60_000
    assert license_scan.license_scan(none).count() == 0


def test_license_blocks_do_not_depend_on_lines(spark):
    notices = dict(license_scan.TEMPLATES)
    wrap = lambda text, n: "\n * ".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    filler = "word " * 40
    texts = [f"{filler}\n{wrap(notices[n], 6)}\n{filler}" for n in ("bsd", "mit-notice", "isc", "gpl-notice")]
    texts += [f"all {filler} rights {filler} reserved", f"{filler} All rights reserved {filler}", f"reserved all {filler} all\nrights\nreserved"]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("mit-notice", 1.0), 2: ("isc", 1.0), 3: ("gpl,gpl-notice", 1.0), 4: ("", 0.0), 5: ("all-rights-reserved", 1.0), 6: ("all-rights-reserved", 1.0)}


def test_lines(spark, odd, none):
    out = line_dedup.line_dedup(odd)
    assert [c for c in out.columns if c != "n_removed"] == [c for c in odd.columns if c != "n_lines"] + ["n_lines"]
    got = {(r.doc_id, r.n_removed): r.text for r in out.collect()}
    assert got[7, 0] == PASSAGE and got[8, 1] == "own start\nown end" and got[12, 2] == "" and got[None, 1] == "" and got[2, 0] is None
    assert got[5, 0] == "a\n\nb\n\n" and got[6, 0] == LONG
    assert line_dedup.line_dedup(none).count() == 0
    # Runs of short lines count together; a run is kept where it stands first.
    run = "\n".join(f"short line {i}" for i in range(20))
    small = spark.createDataFrame([(1, run + "\nx"), (2, "y\n" + run), (3, "short line 3\nz")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(small).collect()} == {1: run + "\nx", 2: "y", 3: "short line 3\nz"}


def test_mixing(spark, odd, none):
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == len(_rows()) and all(r.taken == r.copies * r["size"] and r.copies <= 2 for r in plan)
    assert mixing.mix(odd).count() == sum(r.copies for r in plan) and mixing.mix(odd).columns == odd.columns
    rates = {r.source: r for r in mixing.source_rates(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 100)], "source string, size long")).collect()}
    assert rates["a"].target == 20 and rates["c"].target == 20 and rates[None].target == 200 and rates["b"].target == 1440
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_pipeline(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.saved(stage(spark, docs, SF))
        assert docs.columns == before.columns, name
        assert name == "mix_sources" or 0 < docs.count() <= before.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
    for rows in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.saved(stage(spark, rows, SF))
