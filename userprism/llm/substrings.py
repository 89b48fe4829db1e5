"""Substring deduplication by windows looked up in indexed reference blocks.

The corpus itself is the reference, cut into blocks. Each block is indexed by the windows of
``WINDOW`` words it holds, and every window of a document is looked up in the indexes of all
blocks. It is labelled with the lowest-numbered other block that holds it, and a factor is a run
of neighbouring windows with one label. This is no relative Lempel-Ziv parse: no place in the
reference is kept, a factor ends where the label changes even if its block goes on, and its
windows may stand in different documents of the block. Factors have ``WINDOW`` words at least,
shorter ones are literals and stay. A word inside any window found is a repeat, so the results
do not depend on where factors end.

Windows are compared by 64-bit hashes plus the independent bits that choose their bucket.

Defined results: a null or empty text has no words and stays as it is. All copies of a passage
are repeats, also within one document; identical rows are copies of each other. Extra columns
pass through.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import blocks as B
from . import textops

WINDOW = 35
NULL = "__null"
FACTORS = "doc_id long, start long, n_words long, reference_block int"


def _windows(table, n_blocks, width):
    """Entries of a block's windows; its words, and the word at which each window starts."""
    found = textops.words(table.column("text"))
    counts = found.counts
    sizes = np.maximum(counts - width + 1, 0)
    before = np.cumsum(sizes) - sizes
    place = np.repeat(found.first[:-1] - before, sizes) + np.arange(sizes.sum())
    if not len(place):
        return B.Entries(np.zeros(0, np.uint64), np.zeros(0, np.int32)), (found, place)
    hashes = textops.runs(found.hash, width)[place]
    other = textops.runs(textops.mix(found.hash + np.uint64(0x632BE59BD9B4E019)), width)[place]
    return B.Entries(hashes, B.buckets_of(other, n_blocks)), (found, place)


def _parse(found, place, known, reference, width):
    """Runs of windows with one label as (first word, end word, reference block), by word number in the block."""
    hit = np.flatnonzero(known)
    at, source = place[hit], reference[hit]
    text = np.searchsorted(found.first, at, side="right")
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return at[first], at[last] + width, source[first]


def _covered(start, end, n):
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) > 0


def _run(docs, finish, schema, width, block_bytes):
    n = B.number(docs, block_bytes=block_bytes)

    def close(table, entries, more, known, detail):
        found, place = more
        factors = _parse(found, place, known[entries.of], detail[entries.of], width)
        return finish(table, found, factors)

    return B.resolve(
        B.dealt(docs, n), lambda table: _windows(table, n, width), close, schema
    )


def factors(docs, width=WINDOW, block_bytes=B.BLOCK_BYTES):
    """Repeated spans: one row per factor, in words of its document from 0."""

    def finish(table, found, factors):
        start, end, source = factors
        text = np.searchsorted(found.first, start, side="right") - 1
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(text)).combine_chunks().cast(pa.int64()),
            "start": pa.array(start - found.first[text], pa.int64()), "n_words": pa.array(end - start, pa.int64()),
            "reference_block": pa.array(source, pa.int32()),
        })

    return _run(docs.select("doc_id", "text"), finish, FACTORS, width, block_bytes)


def digests(docs, width=WINDOW, block_bytes=B.BLOCK_BYTES):
    """Per document the number of words, of repeats, and a digest of the words that stay."""

    def finish(table, found, factors):
        gone = _covered(factors[0], factors[1], len(found.hash))
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[found.first[1:]] - total[found.first[:-1]]
        marks = []
        for i, text in enumerate(table.column("text")):
            words = text.as_py().encode().split()
            if removed[i]:
                words = compress(words, ~gone[found.first[i] : found.first[i + 1]])
            marks.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array(found.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(marks, pa.string()),
        })

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return _run(rows, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", width, block_bytes)


def without_repeats(docs, width=WINDOW, block_bytes=B.BLOCK_BYTES):
    """``docs`` with the repeats cut out of ``text``; spacing between words that stay is kept."""

    def finish(table, found, factors):
        gone = _covered(factors[0], factors[1], len(found.hash))
        texts, null = [], table.column(NULL).to_pylist()
        _, offsets = textops.text_bytes(table.column("text"))
        for i, text in enumerate(table.column("text")):
            a, b = found.first[i], found.first[i + 1]
            mine = gone[a:b]
            if mine.any():
                data, start = text.as_py().encode(), np.append(found.start[a:b] - offsets[i], len(text.as_py().encode()))
                edges = np.flatnonzero(np.diff(np.concatenate([[True], mine, [True]]).astype(np.int8)))
                data = b"".join(data[start[x] : start[y]] for x, y in zip(edges[::2], edges[1::2]))
                text = data.decode()
            else:
                text = text.as_py()
            texts.append(None if null[i] else text)
        at = table.schema.get_field_index("text")
        return table.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([B.BLOCK, NULL])

    return _run(docs.withColumn(NULL, F.col("text").isNull()), finish, docs.schema, width, block_bytes)
