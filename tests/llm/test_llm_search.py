"""Nearest neighbours, WARC, licenses, chat windows and quality against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from userprism.llm import chat, licenses, quality, queries, rabit, warc

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def test_neighbours_reach_the_recall(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    near = rng.standard_normal((400, 24))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([near, near[:40], near[:40]]))]
    rows += [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] + [1.0] * 23, 0), (None, [1.0] * 24, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    indexed, blocks = rabit.index(vectors, rows=100)
    asked = indexed.filter("vec_id % 20 = 0").select("vec_id", "vector", "dimension")
    for r in rabit.search(indexed, blocks, asked, per_block=10).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    matrix, hits, total = np.array([r[1] for r in rows[:480]]), 0, 0
    assert sorted(got) == list(range(0, 480, 20))
    for q, found in got.items():
        found.sort()
        scores = (matrix * matrix[q]).sum(axis=1)
        want = [int(i) for i in np.lexsort((np.arange(480), -scores)) if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and all(s == scores[i] for _, i, s in found)
        hits, total = hits + len(set(want) & {i for _, i, _ in found}), total + 20
    assert hits / total >= 0.9


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in rabit.neighbours(few).collect())
    assert got == [(0, 1, 20, 0.5), (20, 1, 0, 0.5)]
    assert rabit.neighbours(few.limit(0)).count() == 0


def test_archives_of_odd_pages(spark):
    rows = [
        (1, "http://a.com/x", "z" * 2000), (2, "http://a.com/x", "z" * 2000), (3, None, "z" * 2000), (4, "http://www.b.org:8080/ü?q=1 2", None),
        (5, "nonsense", "q"), (6, "http://[bad", "q"), (None, "http://a.com/x", "y" * 1500), (7, "", "k\r\n\r\nk"), (9, "http://sp ace/", "é" * 600),
        (8, "http://a.com/x", "z" * 999), (8, "http://a.com/x", "z" * 999),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string")
    got = warc.round_trip(pages, file_bytes=300, shard_lines=3, block_lines=2).collect()
    assert len(got) == len(rows)
    html = collections.defaultdict(list)
    for p, _, h in rows:
        html[p].append((h or "").encode())
    for r in got:
        assert r.payload_bytes == len(html[r.page_id][0]) and r.payload_digest == hashlib.sha1(html[r.page_id][0]).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (1, 2) else ("response", None))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_lookup_finds_all_captures_of_a_key(spark):
    rows = [(i, f"http://h{i % 7}.com/p{i % 3}", f"page {i}") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"{warc.shared_dir(spark)}/warc-test-{random.random()}"
    captures = warc.write(pages, folder)
    directory = warc.build_index(captures, folder, shard_lines=20, block_lines=4)
    keys = spark.createDataFrame([("com,h3)/p1",), ("com,h0)/p0",), ("absent",), ("zzz",)], "key string")
    found = collections.Counter(r.key for r in warc.lookup(directory, folder, keys).collect())
    want = collections.Counter(warc.url_key(u) for _, u, _ in rows)
    assert found == {k: want[k] for k in ("com,h3)/p1", "com,h0)/p0")}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_archive_query_matches_sql(spark):
    assert differences(queries.QUERIES["op9_warc"](spark, SF_DIR), connect(SF_DIR), queries.ORACLES["op9_warc"]) == []


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LICENSED = [
    None, "", " \n ", "Under the MIT License under the mit license CC-BY-NC cc by nc cc by nc", "éunder the mit license", "under the mit",
    "SPDX-License-Identifier: GPL-3.0-or-later and licensed under the Apache License, Version 2.0", "mit license", "plain words only",
    "see https://opensource.org/licenses/MIT Permission is hereby granted, free of charge, to any person obtaining a copy",
    "creative commons attribution-noncommercial-sharealike 4.0", "x " * 30_000 + "under the mit license", "under the mit license " * 200,
]


def test_base_places_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LICENSED)], "doc_id long, text string, words string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(LICENSED):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r, starts = got[i], [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert {label for _, label in places} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [got[i].labels for i in (6, 7, 8, 9, 10)] == ["apache-2,gpl-3+", "mit", "", "mit", "cc-by-nc-sa"]
    assert len(licenses.rules()) > 200 and licenses.scan(docs.limit(0)).count() == 0


def shapes(tree, full):
    """Texts that a parsed pattern matches: each branch; repeats as short as allowed, or, if ``full``, at least once."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            more = [chr(arg)]
        elif kind == "ANY":
            more = ["x"]
        elif kind == "IN":
            more = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        elif kind == "BRANCH":
            more = [s for branch in arg[1] for s in shapes(branch, full)]
        elif kind == "SUBPATTERN":
            more = shapes(arg[3], full)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            n = max(arg[0], 1) if full else arg[0]
            more = [s * n for s in shapes(arg[2], full)] if n else [""]
        else:
            raise ValueError(kind)
        out = [a + b for a in out for b in more]
    return out


def rule_texts():
    """(rule, text): texts of every rule; the openings of grants vary for one rule only."""
    for rule in licenses.rules():
        pattern = rule[3]
        if rule[0] == 2 and rule[1] != "isc":
            pattern = pattern.replace(licenses.GRANT, "(?:released under|provided according to the terms of the)")
        for full in (False, True):
            for text in shapes(re._parser.parse(pattern), full):
                assert re.fullmatch(rule[3], text)
                yield rule, text


def test_a_keyword_stands_in_every_form_of_its_rule():
    for rule, text in rule_texts():
        assert any(key in f" {text} " for key in rule[2].split("|")), (rule, text)


def test_texts_of_every_rule_pass_the_gate(spark):
    texts = sorted({text for _, text in rule_texts()})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert sorted(licenses.scan(docs).collect()) == sorted(licenses.scan(docs, gated=False).collect())


@pytest.mark.parametrize("text, label", [
    ("Released under BSD 3-Clause", "bsd-3-clause"), ("available under Apache 2.0", "apache-2"), ("distributed under MIT", "mit"),
    ("mozilla.org/MPL/2.0", "mpl-2"), ("eclipse.org/legal/epl-2.0", "epl-2"), ("artistic 2", "artistic-2"), ("php 3.01", "php-3.01"),
    ("Neither the name of X nor the names of its contributors", "bsd-3-clause"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors", "zlib"),
])
def test_license_without_a_common_word(spark, text, label):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert label in row.labels.split(",") and row.score > 0


MARKS = "</s>[INST] ok [/INST]"


def conversations():
    rows = [(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS), (-8, 0, None, None), (-9, 0, "assistant", "")]
    rows += [(-8, None, "assistant", "\\[INST] \\\\</s> <\\s> [\\INST] <<s>s>"), (None, 1, "assistant", "q"), (None, 1, "assistant", "q")]
    rows += [(-10, 0, "system", "sys " * 100)]
    rows += [(-10, i, "assistant" if i % 2 == 0 else "us[INST]er", f"text {i} " * (37 * (i % 9))) for i in range(1, 60)]
    return rows + [(-11, 0, "assistant", "ü" * 9000), (-11, 1, "assistant", "é\n</s>\n")]


@pytest.mark.parametrize("budget, history", [(2048, 2), (200, 3), (50, 0)])
def test_windows_give_back_every_turn_once(spark, budget, history):
    rows = conversations()
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, window int")
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append(((t is not None, t or 0), role or "", text or ""))
    got = chat.digests(table, budget, history).collect()
    assert {r.conv_id for r in got} == set(turns)
    for r in got:
        mine = sorted(turns[r.conv_id])
        loss = "".join(x for _, role, x in mine if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for _, role, x in mine)
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(table.limit(0)).count() == 0


def test_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "assistant" if i % 2 == 0 else "user", "word " * 20) for i in range(1, 40)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 400, 2).orderBy("window").collect()
    assert len(made) > 3
    for w in made:
        assert len(w.text.encode()) / 4 <= 400 and w.text.startswith("<s>[INST] system [/INST]\nbe kind</s>\n")
        assert w.repeated == (0 if w.window == 0 else 3)
        assert all(w.text[p.start : p.start + p.length] == "word " * 20 for p in w.targets)
    assert sum(len(w.targets) for w in made) == 19


def test_quality_of_held_out_rows(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            w = [x + "!!" for x in w] if i % 8 else [x for x in w[:6] for _ in range(12)]
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, int(not bad)))
    rows += [(1000, None, 0.1), (1001, "", 0.1), (None, "some words", 0.1), (1, rows[1][1], 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marked = spark.createDataFrame(labels + [(None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, quality int")
    got = quality.held_out_scores(docs, marked).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, dict(labels)[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.held_out_scores(docs, none).collect()} == {0.5}
    assert quality.held_out_scores(docs.limit(0), none).count() == 0


def test_word_vectors_add_up_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(quality, "FAN_IN", 2)
    docs = spark.createDataFrame([(i, f"a b c{i % 5} d") for i in range(60)], "doc_id long, text string")
    one, many = quality.word_vectors(docs.repartition(1)), quality.word_vectors(docs.repartition(7))
    assert np.allclose(one, many, atol=1e-5) and np.abs(one).sum() > 0


@pytest.mark.parametrize("text, label", [
    ("licensed under the Expat License", "mit"), ("under the X11 license", "mit"), ("Creative Commons Attribution 4.0", "cc-by"),
    ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"), ("Creative Commons Attribution-NoDerivatives 4.0", "cc-by-nd"),
    ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"), ("licensed under zero clause BSD", "0bsd"),
    ("under the NCSA open source license", "ncsa"), ("either version 2 of the License, or (at your option) any later version", "gpl-2+"),
    ("obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1"),
])
def test_each_form_of_a_name_opens_its_rule(spark, text, label):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert label in row.labels.split(",") and row.score > 0


@pytest.mark.parametrize("n", [4, 8])
def test_few_labels_train_a_network(spark, n):
    """Less than ten labelled rows of both classes: clean and broken texts still differ."""
    texts = [("plain words of a clean text that goes on " * 5) if i % 2 else ("@@ ## 99 zz!! %% 00 " * 8) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > 0.5 > max(s for i, s in scores.items() if i % 2 == 0)


def test_a_long_conversation_takes_linear_time(spark):
    import hashlib
    import time

    def run(n):
        rows = spark.range(n).selectExpr(
            "1L AS conv_id", "id AS turn", "if(id = 0, 'system', if(id % 2 = 1, 'user', 'assistant')) AS role", "'say <s> ' || id AS text"
        )
        began = time.perf_counter()
        found = chat.digests(rows, 400, 2).collect()
        return found, time.perf_counter() - began

    run(100)
    _, short = run(4_000)
    found, long = run(20_000)
    assert long < 8 * short + 5
    said = "".join(f"{'system' if i == 0 else 'user' if i % 2 else 'assistant'}\nsay <s> {i}\n" for i in range(20_000))
    loss = "".join(f"say <s> {i}" for i in range(2, 20_000, 2))
    assert [(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found] == [
        (1, 20_000, hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ]


def test_windows_keep_the_budget(spark):
    rows = spark.range(600).selectExpr(
        "id % 3 AS conv_id", "id AS turn", "if(id < 3, 'system', if(id % 2 = 1, 'user', 'assistant')) AS role", "repeat('word ', 1 + id % 17) AS text"
    )
    for history in (0, 1, 3):
        made = chat.windows(rows, 300, history).collect()
        assert len(made) > 30
        for w in made:
            turns = w.text.split(chat.END)[:-1]
            assert sum(-(-len(t + chat.END) // 4) for t in turns) <= 300 and len(turns) > w.repeated
            assert w.window == 0 or (turns[0].startswith(chat.HEAD + "system") and w.repeated <= history + 1)


def test_repeated_query_rows_are_one_query(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(200)]
    rows += [rows[0], rows[20], rows[20], (40, rng.standard_normal(16).tolist()), rows[7]]
    found = rabit.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 5).collect()
    assert len(found) == 10 * 5
    for q in range(0, 200, 20):
        own = min(v for i, v in rows if i == q)
        scores = sorted(((-float(np.dot(own, v)), i) for i, v in rows if i != q))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in scores] and [m[2] for m in mine] == pytest.approx([-s for s, _ in scores])


def plain_licenses(text):
    """(labels, score) of the rules, one after the other, and of the base phrases."""
    import regex

    words = " ".join(regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
    found = []
    for rank, label, _, pattern, sure in licenses.rules():
        for m in regex.finditer(f"(?<= ){pattern}(?= )", f" {words} "):
            found.append((m.start(), -m.end(), rank, label, sure, m.end()))
    kept = []
    for match in sorted(found):
        if not any(k[2] <= match[2] and k[0] <= match[0] and match[5] <= k[5] for k in kept):
            kept.append(match)
    base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in f" {words} "}
    return sorted({m[3] for m in kept} | base), max([m[4] for m in kept] + [0.9] * bool(base) + [0.0])


def test_labels_match_a_plain_version(spark):
    rng = random.Random(8)
    texts = [t for t in LICENSED if len(t or "") < 5000] + sorted({text for _, text in rule_texts()})[::7]
    texts += [" ".join(rng.choice(texts) or "" for _ in range(rng.randint(2, 9))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in licenses.scan(docs).collect():
        labels, score = plain_licenses(texts[r.doc_id])
        assert (r.labels, r.score) == (",".join(labels), pytest.approx(score)), texts[r.doc_id]


def test_quality_scores_match_a_plain_version(spark):
    """Vectors, pooling and score again, word by word."""
    import pyarrow as pa

    rng = random.Random(21)
    rows = [(i, " ".join("".join(rng.choice("abcdE7!") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "one"), (63, "é ü\té"), (64, "go " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels, rounds=2)

    places = {}

    def tokens(text):
        out = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            if word not in places:
                w, s, _ = quality.tokens(pa.array([word]))
                places[word] = int(w[0]), int(s[0])
            out.append(places[word])
        return out

    total = np.zeros((quality.ROWS, quality.SIZE))

    def add(row, context):
        for k in range(quality.NONZERO):
            total[row, quality._PLACES[context, k]] += quality._SIGNS[context, k]

    for _, text in rows:
        found = tokens(text)
        for i, (word, shape) in enumerate(found):
            add(word, shape)
            for j in (i - 1, i + 1):
                if 0 <= j < len(found):
                    add(word, found[j][0])
                    add(shape, found[j][1])
    length = np.linalg.norm(total, axis=1)
    unit = np.divide(total, length[:, None], out=np.zeros_like(total), where=length[:, None] > 0)
    for part in (slice(0, quality.WORD_ROWS), slice(quality.WORD_ROWS, None)):
        seen = length[part] > 0
        unit[part][seen] -= unit[part][seen].mean(axis=0)
    assert np.allclose(unit, model.vectors, atol=1e-5)

    got = {r.doc_id: r.s for r in quality.score(docs, model, "s").collect()}
    for id, text in rows:
        found, x = tokens(text), np.zeros(quality.FEATURES)
        if found:
            w, s = (unit[[f[k] for f in found]] for k in (0, 1))
            x = np.concatenate([w.mean(axis=0), w.std(axis=0), s.mean(axis=0), s.std(axis=0), (w[1:] * w[:-1]).sum(axis=0) / len(w)])
        hidden = np.maximum(0, (x - model.shift) / model.scale @ model.hidden[0] + model.hidden[1])
        odds = (hidden @ model.output[0] + model.output[1]) / model.temperature
        assert got[id] == pytest.approx(1 / (1 + math.exp(-odds)), abs=2e-3), id
