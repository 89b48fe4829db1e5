"""Phrases, the Merkle manifest and source mixing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from userprism.llm import manifest, mixing, phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, f double, word string"


def table(spark, rows):
    """(doc_id, text, lang, source) rows with columns whose names clash with the operators' own."""
    full = [(i, t, g, s, None if t is None else len(t), 1.5, "x") for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, and one source and pair on most rows."""
    dice = random.Random(5)
    vocabulary = ["der", "Haus", "ha", "x,y", "new", "york", "été", "a.b", "c d", "\t", "z\nq"]
    rows = [(None, "new york city. new york", None, None), (1, None, "en", "b"), (1, None, "en", "b"), (2, "", "", "a")]
    rows += [(3, "New York new york " * 700, "en", "b"), (4, "ha " * 300, "und", "é")]
    for i in range(5, 90):
        lang = dice.choice(["en", "en", "de", None])
        rows.append((i, " ".join(dice.choices(vocabulary, k=dice.randint(0, 60))), lang, dice.choice("bbba") if i % 9 else None))
    return rows + rows[-3:] * 4


def plain_phrases(rows, least, top):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    count[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                gone |= {p[i : i + n] for i in range(len(p) - n + 1) if 100 * a >= 100 * f[p[i : i + n]]}
        found = []
        for p, a in candidates.items():
            if p not in gone:
                cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("routing", [
    {}, {"group_bytes": 500, "group_words": 5, "sample": 1}, {"group_bytes": 1500, "group_words": 200, "sample": 0.5},
])
def test_phrases_equal_a_plain_count(spark, routing):
    rows = odd_rows()
    found = phrases.collocations(table(spark, rows), least=4, top=60, **routing)
    assert sorted(map(tuple, found.collect())) == plain_phrases(rows, 4, 60)


def test_phrases_small_slices(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 700)
    rows = odd_rows()
    found = phrases.collocations(table(spark, rows), least=3, top=2000)
    assert sorted(map(tuple, found.collect())) == plain_phrases(rows, 3, 2000)


def test_phrases_without_candidates(spark):
    assert phrases.collocations(table(spark, [(1, None, None, None), (2, "one two", "en", "a")])).count() == 0
    assert phrases.collocations(table(spark, []).limit(0)).count() == 0


def test_quicksort_counts_equal_prefixes():
    import numpy as np
    dice = np.random.default_rng(3)
    words = dice.integers(1, 5, (5, 3000)).astype(np.uint64)
    words[3:, dice.random(3000) < 0.3] = 0
    weight = dice.integers(1, 4, 3000)
    expected = Counter()
    for column, w in zip(words.T.tolist(), weight.tolist()):
        for d in range(1, 6):
            if column[d - 1]:
                expected[tuple(column[:d])] += w
    found = {}
    for depth, pointer, n in phrases.quicksort_counts(words, weight, 20):
        for d, p, c in zip(depth.tolist(), pointer.tolist(), n.tolist()):
            key = tuple(words[:d, p].tolist())
            assert key not in found
            found[key] = c
    assert found == {k: c for k, c in expected.items() if c >= 20}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(i, source, lang, n, text):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)]
    return digest("".join(fields))


def plain_tree(nodes, fanout):
    """Root and each leaf's (place, others) per level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, where):
            run = nodes[at // fanout * fanout :][:fanout]
            path.append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        where = [at // fanout for at in where]
    return nodes[0], paths


def plain_manifest(rows, fanout=2):
    groups = defaultdict(list)
    for i, text, lang, source in rows:
        n = None if text is None else len(text)
        groups[lang].append((i is not None, i, plain_leaf(i, source, lang, n, text), source, n, text))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([r[2] for r in sorted(groups[g], key=lambda r: (r[0], r[1] or 0, r[2]))], fanout) for g in order}
    root, upper = plain_tree([trees[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, upper):
        subroot, paths = trees[g]
        for (_, i, leaf, source, n, text), path in zip(sorted(groups[g], key=lambda r: (r[0], r[1] or 0, r[2])), paths):
            path = path + up
            node = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None:
                node = plain_leaf(i, source, g, n + 1, text)
            for at, others in path:
                node = digest("".join(others[:at] + [node] + others[at:]))
            proof = digest("".join("".join(others) for _, others in path))
            out.append((i, leaf, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels, fanout", [(12, 2), (0, 2), (1, 2), (2, 2), (1, 3), (2, 5)])
def test_manifest_equals_a_plain_tree(spark, levels, fanout):
    rows = odd_rows()
    found = manifest.verify(table(spark, rows), levels, fanout)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_manifest(rows, fanout)


@pytest.mark.parametrize("count", [1, 2, 3, 9, 33])
def test_manifest_of_few_rows(spark, count):
    rows = [(i, f"t{i}", "en" if count < 9 else None, "s") for i in range(count)]
    found = manifest.verify(table(spark, rows), levels=2)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_manifest(rows)


def test_manifest_without_rows(spark):
    assert manifest.verify(table(spark, []).limit(0)).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > repeats * sizes[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def plain_mix(rows):
    """Words taken by document, with the same keys."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    sizes = Counter()
    for n, (_, _, _, s) in zip(size, rows):
        sizes[s] += n
    targets, drawn = plain_targets(sizes), defaultdict(list)
    for n, (i, text, _, s) in zip(size, rows):
        text = text or ""
        plain = re.sub(r"[\x00-\x1F!-@\[-`{-\x7F]", "", text)
        weight = max(len(plain) / len(text) if text else 0, 0.05)
        name = "|".join(["mix-1", "-" if i is None else str(i), digest(text)])
        uniform = (int(digest(name)[:13], 16) + 0.5) / 2**52
        drawn[s].append((-math.log(uniform) / weight, i is not None, i or 0, n, i))
    out = []
    for s, of in drawn.items():
        epochs = math.floor(targets[s] / sizes[s]) if sizes[s] else 0
        rest, before = targets[s] - epochs * sizes[s], 0
        for *_, n, i in sorted(of):
            out.append((i, n, sizes[s], targets[s], (epochs + (before + n / 2 <= rest)) * n))
            before += n
    return sorted(out, key=repr)


def same_mix(found, expected):
    found = sorted(map(tuple, found.collect()), key=repr)
    assert [(r[0], r[1], r[2], r[4]) for r in found] == [(r[0], r[1], r[2], r[4]) for r in expected]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(found, expected))


def test_mix_equals_a_plain_draw(spark):
    rows = odd_rows()
    same_mix(mixing.mix(table(spark, rows)), plain_mix(rows))
    again = table(spark, rows).repartition(7)
    same_mix(mixing.mix(again), plain_mix(rows))


def test_mix_shares_what_full_sources_leave(spark):
    dice = random.Random(2)
    rows = [(i, "w " * dice.randint(0, 30), None, f"s{min(i % 23, dice.randint(0, 9))}") for i in range(900)]
    found = mixing.mix(table(spark, rows)).collect()
    same_mix(mixing.mix(table(spark, rows)), plain_mix(rows))
    taken, target, size = Counter(), {}, Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
    for (source_size, goal), words in taken.items():
        assert goal <= 2 * source_size and abs(words - goal) <= 30
    assert math.isclose(sum(g for _, g in taken), 1.5 * sum(r.size for r in found))


def test_mix_prefers_documents_of_higher_weight(spark):
    rows = [(i, "w " * 10, None, "a" if i % 2 else "b") for i in range(2000)]
    from pyspark.sql import functions as F
    quality = F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0)
    found = mixing.mix(table(spark, rows), weights=(1,), quality=quality).collect()
    high = sum(r.taken for r in found if r.doc_id % 4 < 2)
    assert high > 1.15 * sum(r.taken for r in found if r.doc_id % 4 >= 2)


def test_mix_without_words(spark):
    assert mixing.mix(table(spark, []).limit(0)).count() == 0
    found = mixing.mix(table(spark, [(1, None, None, None), (2, "", "en", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in found] == [(0, 0.0, 0)] * 2
