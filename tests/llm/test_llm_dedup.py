"""Substring deduplication and the Jaccard join against brute force; block and star helpers."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from userprism.llm import components, jaccard, substrings, textops

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_texts(seed=3):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 5) + rng.choice("xyz") for _ in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("pqrs") * 6
        rows.append((5000 + k, " ".join(w)))
    for k in range(60):
        rows.append((7000 + k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(1, 90)))))
    rows += [(8000 + k, rows[k * 3][1]) for k in range(40)]
    return rows + [
        (6000, None), (6001, ""), (6002, "A b"), (6003, "a B"), (6004, "a"), (6005, "a b c"), (6006, "a b c"), (6007, "x y a b c"),
        (6008, "q " * 50), (6008, "q " * 50), (6009, "é " * 20), (6010, "long " + "w" * 300_000 + " tail end here"),
    ]


@pytest.fixture(scope="module")
def texts():
    return near_texts()


def brute_repeats(rows, width):
    found = [(d, words(t)) for d, t in rows]
    seen = collections.Counter(tuple(w[i : i + width]) for _, w in found for i in range(len(w) - width + 1))
    out = []
    for d, w in found:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 23, 20_000])
def test_repeats_match_brute_force(spark, texts, block_bytes):
    rows = texts + [(9000, "start " + texts[0][1][: len(texts[0][1]) // 2] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in substrings.digests(docs, block_bytes=block_bytes).collect())
    want = sorted((d, n, k, hashlib.sha256(kept.encode()).hexdigest()) for d, n, k, kept in brute_repeats(rows, 35))
    assert got == want


def test_cut_texts_keep_other_columns_and_spacing(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "x", f"a\n\nb {passage}  c\td"), (2, "y", f"{passage}"), (3, "z", " keep  me "), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert out[1].text == "a\n\nb c\td" and out[1].lang == "x"
    assert out[2].text == "" and out[3].text == " keep  me " and out[None].text == ""


def test_factors_are_long_and_cover_the_repeats(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    factors = substrings.factors(docs, block_bytes=20_000).collect()
    assert all(f.n_words >= 35 for f in factors)
    covered = collections.defaultdict(set)
    for f in factors:
        covered[f.doc_id] |= set(range(f.start, f.start + f.n_words))
    once = collections.Counter(d for d, _ in texts)
    for d, _, n, _ in brute_repeats(texts, 35):
        if once[d] == 1:
            assert len(covered[d]) == n


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert substrings.digests(docs).count() == 0
    assert substrings.without_repeats(docs).count() == 0
    assert jaccard.link(docs).count() == 0


def brute_components(rows, percent, width):
    sets = collections.defaultdict(set)
    for d, t in rows:
        w = words((t or "").translate(LOWER))
        if d is not None and w:
            sets[d] |= {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}
        elif d is not None:
            sets[d] |= set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("percent, width, block_bytes, block_rows", [(90, 3, 1 << 23, 256), (90, 3, 20_000, 8), (80, 5, 20_000, 8)])
def test_components_match_brute_force(spark, texts, percent, width, block_bytes, block_rows):
    docs = spark.createDataFrame([(*r, "x") for r in texts] + [(None, "a b c", "x")], "doc_id long, text string, column string")
    got = jaccard.link(docs, percent, width, block_bytes=block_bytes, block_rows=block_rows).collect()
    want = brute_components(texts, percent, width)
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (1, None))


def test_representatives_keep_one_of_each_component(spark, texts):
    docs = spark.createDataFrame(texts + [(None, "a b c")], "doc_id long, text string")
    want = {c for _, c in brute_components(texts, 80, 5).values()}
    got = [r.doc_id for r in jaccard.representatives(docs).collect()]
    assert sorted(d for d in got if d is not None) == sorted(want) and got.count(None) == 1


def test_chains_and_stars_become_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want


def test_words_do_not_depend_on_neighbours():
    rows = ["a bc", "", None, "bc  a", "  ", "ü\tü", "a\x0bbc"]
    found = textops.words(pa.array(rows))
    assert found.counts.tolist() == [2, 0, 0, 2, 0, 2, 2]
    h = found.hash
    assert h[0] == h[3] == h[6] and h[1] == h[2] == h[7] and h[4] == h[5] and len(np.unique(h)) == 3
    parts = textops.words(pa.array(rows * 3), lower=True)
    old, textops.BATCH_BYTES = textops.BATCH_BYTES, 4
    try:
        small = textops.words(pa.array(rows * 3), lower=True)
    finally:
        textops.BATCH_BYTES = old
    for a, b in zip((parts.start, parts.end, parts.hash, parts.first), (small.start, small.end, small.hash, small.first)):
        assert a.tolist() == b.tolist()


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 35])
def test_runs_tell_sequences_apart(width):
    rng = np.random.Generator(np.random.PCG64(1))
    h = textops.mix(rng.integers(0, 3, 400).astype(np.uint64) + np.uint64(1))
    runs = textops.runs(h, width)
    keys = [tuple(h[i : i + width]) for i in range(len(h) - width + 1)]
    assert len(runs) == len(keys) and len(set(runs.tolist())) == len(set(keys))
    assert len({(a, b) for a, b in zip(runs.tolist(), keys)}) == len(set(keys))
    assert len(textops.runs(h[: width - 1], width)) == 0


def test_null_texts_stay_null(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x " * 40, "c"), (4, "x " * 40, "d")]
    found = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, note string"))
    assert found.columns == ["doc_id", "text", "note"]
    assert sorted(map(tuple, found.collect())) == [(1, None, "a"), (2, "", "b"), (3, "", "c"), (4, "", "d")]


def test_different_texts_of_one_id_all_stay(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "q r s t u v w"), (2, "a b c d e f g"), (3, "h i j k l m"), (None, "z"), (None, "z")]
    found = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(1, "a b c d e f g"), (1, "q r s t u v w"), (3, "h i j k l m"), (None, "z"), (None, "z")], key=repr
    )


def test_equal_rows_are_dealt_apart(spark):
    from userprism.llm import blocks

    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 7L, id) AS doc_id", "if(id % 3 = 0, 'same text', 'text ' || id) AS text")
    sizes = [r["count"] for r in blocks.dealt(rows, 8).groupBy(blocks.BLOCK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700
