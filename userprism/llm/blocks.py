"""Which hashes of a block of documents occur elsewhere, without pairs and without hot keys.

Documents are dealt into blocks of bounded size by a hash of the row. Each block lists its
distinct 64-bit hashes once, cut into buckets by independent bits, so a hash on a third of all
documents still is one entry per block. A bucket merges the entries of all blocks and answers
every block with one bit per entry, in the entry's order; the block makes the same entries
again when it reads the answer, so neither hashes nor positions travel back.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import caches, textops

BLOCK_BYTES = 8 * 1024 * 1024
BLOCK = "__block"

INDEX = "__block int, bucket int, entries binary, times binary"
ANSWERS = "__block int, bucket int, known binary, detail binary"


def number(docs, text="text", block_bytes=BLOCK_BYTES):
    """Blocks for the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-size // block_bytes))


def dealt(docs, blocks, text="text"):
    """``docs`` with the number of each row's block; a null text is empty.

    The row's number takes part, so equal rows are dealt apart. ``docs`` must come from a table as
    it was read, where a task run again numbers its rows alike.
    """
    key = F.xxhash64(F.monotonically_increasing_id())
    return docs.withColumns({text: F.coalesce(F.col(text), F.lit("")), BLOCK: F.pmod(key, F.lit(blocks)).cast("int")})


def buckets_of(hashes, blocks):
    """Bucket by bits that the 64-bit entry does not hold when hashes come in independent pairs."""
    return ((hashes >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)


class Entries:
    """Distinct (bucket, hash) of a block, sorted, and the entry of each input hash."""

    def __init__(self, hashes, buckets):
        order = np.lexsort((hashes, buckets))
        h, b = hashes[order], buckets[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
        at = np.cumsum(new) - 1
        self.of = np.empty(len(h), np.int64)
        self.of[order] = at
        self.hash, self.bucket = h[new], b[new]
        self.times = np.bincount(at, minlength=len(self.hash))

    def index(self, block):
        """The block's rows of the index, one per bucket; times are counted up to 255."""
        numbers, first = np.unique(self.bucket, return_index=True)
        last = np.append(first[1:], len(self.hash))
        times = np.minimum(self.times, 255).astype(np.uint8)
        return pa.table({
            BLOCK: pa.array(np.full(len(numbers), block, np.int32)),
            "bucket": pa.array(numbers.astype(np.int32)),
            "entries": pa.array([self.hash[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
            "times": pa.array([times[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
        })

    def read(self, answers):
        """(known elsewhere, detail) of each entry from the block's answers."""
        known, detail = np.zeros(len(self.hash), bool), np.zeros(len(self.hash), np.int32)
        first = np.searchsorted(self.bucket, np.arange(int(self.bucket[-1]) + 2)) if len(self.bucket) else []
        for bucket, bits, more in zip(*(answers.column(c).to_pylist() for c in ("bucket", "known", "detail"))):
            a, b = first[bucket], first[bucket + 1]
            mine = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            known[a:b] = mine
            detail[a:b][mine] = np.frombuffer(more, np.int32)
        return known, detail


def _merge(table, count):
    """Answers of one bucket. ``detail`` of a known entry: how often all blocks hold it, or the
    lowest other block that does (the own one if it only repeats there)."""
    blocks = table.column(BLOCK).to_numpy()
    parts = [np.frombuffer(e, np.uint64) for e in table.column("entries").to_pylist()]
    ends = np.cumsum([len(p) for p in parts])
    owner = np.repeat(blocks, [len(p) for p in parts])
    hashes = np.concatenate(parts)
    times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint8)
    order = np.lexsort((owner, hashes))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    size = np.diff(np.append(first, len(h)))
    total = np.add.reduceat(times[order].astype(np.int64), first)
    known = np.empty(len(h), bool)
    known[order] = total[group] > 1
    detail = np.empty(len(h), np.int32)
    if count:
        detail[order] = np.minimum(total, 2**31 - 1)[group]
    else:
        second = o[np.minimum(first + 1, len(o) - 1)]
        lowest = o[first][group]
        other = np.where((lowest == o) & (size[group] > 1), second[group], lowest)
        detail[order] = other
    out_known, out_detail = [], []
    for a, b in zip(ends - [len(p) for p in parts], ends):
        out_known.append(np.packbits(known[a:b]).tobytes())
        out_detail.append(detail[a:b][known[a:b]].tobytes())
    return pa.table({
        BLOCK: pa.array(blocks), "bucket": table.column("bucket").combine_chunks(),
        "known": pa.array(out_known, pa.binary()), "detail": pa.array(out_detail, pa.binary()),
    })


def answers(index, count=False):
    """The index of all blocks merged bucket by bucket."""
    return index.groupBy("bucket").applyInArrow(caches.tidy_table(lambda table: _merge(table, count)), ANSWERS)


def resolve(rows, entries_of, finish, schema, count=False):
    """Run ``finish(table, entries, more, known, detail)`` on each block of ``rows`` (see ``dealt``).

    ``entries_of(table)`` makes a block's ``Entries`` and what ``finish`` needs besides. ``rows``
    enters both passes with the same columns, so Spark shuffles it once and reuses that shuffle.
    """

    @caches.tidy_table
    def index(table):
        return entries_of(table)[0].index(table.column(BLOCK)[0].as_py())

    @caches.tidy_tables
    def close(table, answer):
        entries, more = entries_of(table)
        known, detail = entries.read(answer)
        return finish(table, entries, more, known, detail)

    answer = answers(rows.groupBy(BLOCK).applyInArrow(index, INDEX), count)
    return rows.groupBy(BLOCK).cogroup(answer.groupBy(BLOCK)).applyInArrow(close, schema)
