"""Fingerprints, packing and byte BPE against brute force and the public libraries."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from userprism.llm import bytebpe, fingerprints, packing, textops

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghéß'!,.漢 AZ09") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 300))) for _ in range(n)]
    return texts + [None, "", " ", "\n\t \n", "a", "It's  a\n\ntest 😀\x00\x1c", "w" * 50_000, texts[3], texts[3], "<|endoftext|> x<|startoftext|>"]


def documents(spark, texts, extra=True):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + ([(None, "no id", "y")] if extra else [])
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("bucket_bytes", [1 << 23, 2000])
def test_edits_follow_the_order_of_ids(spark, bucket_bytes):
    texts = some_texts()
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(documents(spark, texts, False), bucket_bytes=bucket_bytes).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, after, r = text or "", texts[(i + 1) % len(texts)] or "", got[i]
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        for other, near, j in ((edit, r.near_edited, r.jaccard_edited), (after, r.near_next, r.jaccard_next)):
            a, b = shingles(text), shingles(other)
            small = min(len(a), len(b))
            want = 1.0 if not a and not b else len(a & b) / small if small else 0.0
            assert abs(near - want) < 0.35 and 0 <= j <= near <= 1
            if max(len(a), len(b)) <= 64:  # short texts are kept whole
                assert near == pytest.approx(want)
    assert got[3].fingerprint == got[len(texts) - 2].fingerprint


def test_fingerprints_of_odd_tables(spark):
    rows = [(None, "a b c"), (5, "x"), (5, "x"), (5, "y"), (9, None)]
    got = fingerprints.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 5, 1), (False, 5, 1), (False, 5, 1), (False, 9, 0), (True, 0, 5)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.compare_with_edits(empty).count() == 0
    kept = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 5


def test_sketches_merge_and_estimate_containment():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(20_000))
    part = " ".join(long.split()[4000:7000])
    both = pa.array([long, part, long + " " + part, "other " + " ".join(rng.choice(vocabulary) for _ in range(3000))])
    a, b, ab, c = fingerprints.sketches(both)
    assert fingerprints.containment(a, b) == 1.0 and fingerprints.containment(a, c) < 0.02
    assert fingerprints.containment(fingerprints.merge(a, b), ab) > 0.99
    again = fingerprints.from_text(fingerprints.to_text(a))
    assert again[0] == a[0] and again[1].tolist() == a[1].tolist()


def test_packing_is_gapless_and_whole(spark):
    texts = some_texts(5) + ["word " * 9000]
    docs = documents(spark, texts)
    got = packing.pack(docs, WORDS, 512).toPandas()
    encode = packing.tokenizer(WORDS).run
    for i, text in enumerate(texts):
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert list(mine.start) == list(range(0, len(ids), 512)) and mine.length.sum() == len(ids)
        assert (mine.length[:-1] == 512).all()
        assert [zlib.crc32(ids[a : a + 512].tobytes()) for a in mine.start] == list(mine.ids_crc32)
    assert got.doc_id.isna().sum() == 1
    order = got.sort_values(["sequence_id", "offset"])
    sums = order.groupby("sequence_id").length.cumsum()
    assert (order.offset == sums - order.length).all() and sums.max() <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) + 1
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_fullest_fills_as_well_as_any_choice():
    rng = random.Random(3)
    for _ in range(40):
        counts = collections.Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 12)))
        room = rng.randint(0, 60)
        chosen = packing.fullest(counts, room)
        sums = {0}
        for length, n in counts.items():
            for _ in range(n):
                sums |= {s + length for s in sums}
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in chosen.items())


def test_word_tokens_equal_the_library():
    rng = random.Random(4)
    run = packing.WordTokenizer(WORDS, keep=5)
    for _ in range(400):
        text = "".join(rng.choice("abcet hinoruAZ'’!\n \t09é漢😀ßΣİ\x1c\x85́ \x00.,|") for _ in range(rng.randint(0, 60)))
        assert run.encode(text) == np.array(run.run.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_new_words_of_letters_are_encoded_in_one_call(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcetéßÄZ") for _ in range(rng.randint(1, 12))) + rng.choice(["", ",", "...", "$"]) for _ in range(300)]
    run, asked = packing.WordTokenizer(WORDS), []
    library = run.run

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(run, "run", Counting())
    want = np.array(library.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()
    assert run.encode(" ".join(words)) == want
    assert len(asked) <= 5  # the letters in one text, and the signs
    # A vocabulary whose tokens do not tell where a word ends.
    run._ends[:] = False
    run._new, run._old = {}, {}
    assert run.encode(" ".join(words)) == want


@pytest.fixture(scope="module")
def library():
    ranks = bytebpe.encoder(RANKS, P.PATTERN).vocabulary.ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_tokens_equal_the_library(spark, library):
    texts = some_texts(6)
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in bytebpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bytebpe.decode(bytebpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts)) and back[None] == "no id"
    assert bytebpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_edits_and_appends_stay_exact(library):
    rng = random.Random(7)
    encoder = bytebpe.encoder(RANKS, P.PATTERN)
    for _ in range(120):
        text = "".join(rng.choice("abcet hinoruAZ'! \n\t09é漢") for _ in range(rng.randint(0, 50)))
        kept = bytebpe.EditableText(encoder, text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + 5))
            new = "".join(rng.choice("ab !'s\n") for _ in range(rng.randint(0, 5)))
            if rng.random() < 0.3:
                kept.append(new)
                text += new
            else:
                kept.replace(a, b, new)
                text = text[:a] + new + text[b:]
            assert kept.text == text and kept.tokens() == library.encode_ordinary(text)


def test_every_prefix_of_a_table_is_an_encoding(library):
    vocabulary = bytebpe.encoder(RANKS, P.PATTERN).vocabulary
    for word in (" internationalization", "thntthhedstre", "!!!!!!!!???", "ééçêaux"):
        data = word.encode()
        table = vocabulary.prefix_table(data)
        for n in range(1, len(data) + 1):
            assert vocabulary.read(table[: n + 1]) == [vocabulary.ranks[p] for p in vocabulary.merge(data[:n])]


def test_a_repeated_passage_keeps_its_smallest_hashes():
    passage = " ".join(f"w{i}" for i in range(80))
    (limit, hashes), = fingerprints.sketches(pa.array([" ".join([passage] * 100)]))
    every, _ = textops.distinct_sorted(*textops.shingles(textops.words(pa.array([" ".join([passage] * 2)]), lower=True), 5))
    assert len(every) == 80 and list(hashes) == list(every[:64]) and limit == every[63]
