"""Threshold-scaled document fingerprints.

Of a text's shingle hashes every one below a fixed fraction of the hash range is retained, so
sketches of different texts are samples of the same hashes and merge by union. A text with few
hashes below the threshold also keeps its smallest ones, up to ``at_least``; each sketch
therefore carries ``limit``, up to which it holds every hash, and two sketches are compared up
to the smaller limit.

Defined results: a null or empty text has no hashes; two empty sketches are alike (1.0), an
empty and a non-empty one are not (0.0). A text shorter than a shingle is one shingle. Rows
with a null id sort before all others, rows with equal ids by text; repeated rows stay. Extra
columns of the input are not read.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops

ALL = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Settings:
    width: int = 5
    fraction: float = 1 / 16
    at_least: int = 64

    @property
    def threshold(self):
        return np.uint64(int(self.fraction * 2**64) - 1)


def sketches(column, settings=Settings()):
    """One (limit, sorted hashes) per text of an Arrow column."""
    hashes, owner = textops.shingles(textops.words(column, lower=True), settings.width)
    below = hashes <= settings.threshold
    few = np.bincount(textops.distinct_sorted(hashes[below], owner[below])[1], minlength=len(column)) < settings.at_least
    kept = below | few[owner]
    hashes, owner = textops.distinct_sorted(hashes[kept], owner[kept])
    first = np.searchsorted(owner, np.arange(len(column) + 1))
    rank = np.arange(len(hashes)) - first[owner]
    total = np.diff(first)
    keep = (hashes <= settings.threshold) | (few[owner] & (rank < settings.at_least))
    out = []
    for i in range(len(column)):
        mine = hashes[first[i] : first[i + 1]][keep[first[i] : first[i + 1]]]
        if not few[i]:
            limit = settings.threshold
        elif total[i] <= settings.at_least:
            limit = ALL
        else:
            limit = max(mine[-1], settings.threshold)
        out.append((limit, mine))
    return out


def merge(a, b):
    """Sketch of two texts together."""
    limit = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return limit, both[both <= limit]


def common(a, b):
    """Numbers of hashes up to the smaller limit: of a, of b, of both."""
    limit = min(a[0], b[0])
    x = a[1][: np.searchsorted(a[1], limit, side="right")]
    y = b[1][: np.searchsorted(b[1], limit, side="right")]
    if not len(x) or not len(y):
        return len(x), len(y), 0
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return len(x), len(y), int((large[at] == small).sum())


def containment(a, b):
    """Estimated share of the smaller shingle set that the larger one holds."""
    n, m, both = common(a, b)
    if not len(a[1]) and not len(b[1]):
        return 1.0
    return both / min(n, m) if min(n, m) else 0.0


def jaccard(a, b):
    n, m, both = common(a, b)
    if not len(a[1]) and not len(b[1]):
        return 1.0
    return both / (n + m - both) if n + m else 0.0


def to_text(sketch):
    """The limit and the hashes as 16 hex digits each."""
    return np.concatenate([[sketch[0]], sketch[1]]).astype(">u8").tobytes().hex()


def from_text(text):
    values = np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)
    return values[0], values[1:]


def fingerprint(docs, id="doc_id", text="text", settings=Settings()):
    """One row (id, fingerprint) per row of ``docs``."""
    kind = docs.schema[id].dataType

    def make(batches):
        for batch in batches:
            for part in textops.slices(batch, "text"):
                marks = [to_text(s) for s in sketches(part.column("text"), settings)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(marks, pa.string())], names=[id, "fingerprint"])

    schema = T.StructType([T.StructField(id, kind), T.StructField("fingerprint", T.StringType())])
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(make, schema)


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, jaccard_edited double, jaccard_next double"
)
_FIRST = -(2**63)


def edited_text(text, following):
    """The last half of ``text`` replaced by as much of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs, bucket_bytes=8 * 1024 * 1024):
    """``docs`` (doc_id, text) dealt into ranges of ids, each with a copy of the row after it.

    Adds ``bucket`` and ``tail``: within a bucket, ordered by (key, text), the row after a row
    is its successor in the order of ids; tails only serve as successors. The texts are
    shuffled once. Range limits are quantiles of the ids, as many as the bytes ask for.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not size.n:
        return rows.withColumns({"bucket": F.lit(0), "tail": F.lit(False)})
    n = max(1, min(size.n, -(-size.b // bucket_bytes)))
    steps = [i / n for i in range(n)]
    # Quantiles are values of the column, and so ids of rows; their number follows the bytes.
    limits = np.unique(np.array(rows.stat.approxQuantile("key", steps, 1 / (4 * n)) if n > 1 else [], np.int64))
    smallest = rows.agg(F.min("key")).first()[0]
    limits = np.concatenate([[smallest], limits[limits > smallest]]).astype(np.int64)

    def deal(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            own = np.searchsorted(limits, keys, side="right") - 1
            again = np.flatnonzero(limits[own] == keys)
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rows, rows.take(pa.array(again))]).combine_chunks()
            bucket = np.concatenate([own, (own[again] - 1) % len(limits)]).astype(np.int32)
            tail = np.arange(len(bucket)) >= len(own)
            rows = rows.append_column("bucket", pa.array(bucket)).append_column("tail", pa.array(tail))
            yield from rows.to_batches()

    return rows.mapInArrow(deal, "key long, doc_id long, text string, bucket int, tail boolean")


def compare_with_edits(docs, settings=Settings(), bucket_bytes=8 * 1024 * 1024):
    """Fingerprints of all texts and of their edits with the next text; see ``EDIT_SCHEMA``."""

    def rows(table, marks):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        buckets, tails = table.column("bucket").to_numpy(), table.column("tail").to_numpy(zero_copy_only=False)
        live = [i for i in range(len(ids) - 1) if not tails[i] and buckets[i] == buckets[i + 1]]
        edits = [edited_text(texts[i], texts[i + 1]) for i in live]
        edit_marks = sketches(pa.array(edits, pa.string()), settings) if live else []
        out = [[] for _ in range(9)]
        for i, edit, mark in zip(live, edits, edit_marks):
            for to, value in zip(out, (
                ids[i], len(texts[i]), hashlib.sha256(edit.encode()).hexdigest(), to_text(marks[i]), to_text(mark),
                containment(marks[i], mark), containment(marks[i], marks[i + 1]),
                jaccard(marks[i], mark), jaccard(marks[i], marks[i + 1]),
            )):
                to.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4])],
            names=[f.split()[0] for f in EDIT_SCHEMA.split(", ")],
        )

    def run(batches):
        last, last_mark = None, None
        for batch in batches:
            for part in textops.slices(batch, "text"):
                part = pa.Table.from_batches([part])
                marks = sketches(part.column("text"), settings)
                if last is not None:
                    part, marks = pa.concat_tables([last, part]), [last_mark, *marks]
                yield rows(part, marks)
                last, last_mark = part.slice(part.num_rows - 1), marks[-1]

    dealt = neighbours(docs, bucket_bytes)
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", "key", "text")
    return ordered.mapInArrow(run, EDIT_SCHEMA)
