"""Best-fit packing of tokenized documents by minimum bin slack.

Documents become token runs of at most ``capacity``; only longer ones are cut, into full
pieces and a shorter last one. Which bin holds which lengths depends on the histogram of
lengths alone, which has ``capacity`` entries at most whatever the number of documents. So
the plan is made on the driver from that histogram: the largest length left opens a bin, a
bitset subset-sum over the lengths left finds the fullest way to close it, and the pattern is
taken as often as the counts allow. Pieces find their bin by their rank among equal lengths.

Defined results: a null or empty text is the end token alone. Rows with a null id and repeated
rows are packed like others. No rows: no bins. Extra columns are not read. Which of two pieces
of equal length comes first is not fixed.
"""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.scale import stage
from . import caches

CAPACITY = 4096
END = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


class WordTokenizer:
    """Token bytes (little-endian 32 bits) of whole texts, word by word.

    The tokenizer drops white space and never joins over it, so a text's tokens are its
    words' tokens in a row. Tokens of recent words of up to ``LONGEST`` characters are kept,
    twice ``keep`` words at most.
    """

    LONGEST = 48

    # str.split also cuts at these control characters, the tokenizer does not.
    ODD = re.compile("[\x1c-\x1f]")
    # Letters that lower-case one by one, then signs: the tokenizer cuts between the two.
    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:|%$#&*]*)")

    def __init__(self, path, keep=350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.run, self.keep = Tokenizer.from_file(path), keep
        self._new, self._old = {}, {}
        suffix = getattr(self.run.model, "end_of_word_suffix", None)
        vocabulary = self.run.get_vocab()
        self._ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def _each(self, words):
        """Token bytes of each word, encoded by itself."""
        return [np.array(found.ids, "<u4").tobytes() for found in self.run.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words):
        """Token bytes of each of some words of letters alone, encoded as one text.

        The text is cut after each token that ends a word. The last token of a word is one, so as many
        of them as words means one a word; else each word is encoded by itself.
        """
        (found,) = self.run.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = np.flatnonzero(self._ends[ids]) + 1
        if len(cuts) != len(words):
            return self._each(words)
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, words):
        """Take up the tokens of words that are not at hand; those of long words are returned."""
        if len(self._new) >= self.keep:
            self._new, self._old = {}, self._new
        new, old = self._new, self._old
        letters, signs, parts, long = set(), set(), [], [w for w in words if len(w) > self.LONGEST]
        long = dict(zip(long, self._each(long))) if long else {}
        match = self.PLAIN.fullmatch
        for w in words:
            if w in long:
                continue
            if w in old:
                new[w] = old[w]
                continue
            plain = match(w)
            core, tail = (plain[1].lower(), plain[2]) if plain else (w, "")
            if core != w or tail:
                parts.append((w, core, tail))
            for part, missing in ((core, letters if plain else signs), (tail, signs)):
                if part not in new:
                    if part in old:
                        new[part] = old[part]
                    else:
                        missing.add(part)
        for missing, encode in ((list(letters), self._together), (list(signs), self._each)):
            if missing:
                new.update(zip(missing, encode(missing)))
        for w, core, tail in parts:
            new[w] = new[core] + new[tail]
        return long

    def encode(self, text):
        words = text.split(" ") if self.ODD.search(text) else text.split()
        found = list(map(self._new.get, words))
        if None in found:
            gaps = [i for i, data in enumerate(found) if data is None]
            long = self._learn({words[i] for i in gaps})
            new = self._new  # a filled-up cache may just have become the old one
            for i in gaps:
                w = words[i]
                found[i] = new[w] if w in new else long[w]
        return b"".join(found)


def tokenizer(path):
    """The tokenizer of this process for a vocabulary file."""
    return caches.hold(("words", path), lambda: WordTokenizer(path))


def pieces(docs, path, capacity=CAPACITY):
    """Token runs of all documents, each with its rank among equal lengths of its task."""
    end = np.array([END], "<u4").tobytes()

    @caches.tidy
    def cut(batches):
        run, part, seen = tokenizer(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = run.encode(text.as_py() or "") + end
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    length = len(piece) // 4
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    rows.append((id, n, at // 4, length, zlib.crc32(piece), part, rank))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in PIECES.split(", ")]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


def fullest(counts, room):
    """Lengths, in descending order with their numbers, whose sum fills ``room`` best.

    ``counts`` maps each length to how many are left. ``reach`` has a bit for every sum that
    lengths looked at so far can make; it is kept after each step to read the choice back.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not (before >> at) & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(histogram, capacity=CAPACITY):
    """Bins as [(pattern {length: number}, how many bins)], all lengths of the histogram used."""
    left, bins = {n: c for n, c in histogram.items() if c}, []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
        pattern = fullest(rest, capacity - largest)
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(left[n] // c for n, c in pattern.items())
        for n, c in pattern.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        bins.append((pattern, times))
    return bins


def slots(bins):
    """The plan as arrays, sorted by (length, first rank): who sits where in which bins."""
    rows, used, sequence = [], {}, 0
    for pattern, times in bins:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, copies, sequence, offset))
            used[length] = first + copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs, path, capacity=CAPACITY):
    """One row per piece with its ``sequence_id`` and ``offset`` there.

    The pieces (no tokens, no text) are written once; ranks of a length add up over the tasks
    that wrote them, so no length is gathered anywhere.
    """
    cut = stage(pieces(docs, path, capacity))
    counts = cut.groupBy("length", "part").agg((F.max("rank") + 1).alias("n"))
    # One row per task and length here.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    seats = slots(plan(histogram, capacity))
    wide = 1 << 45
    keys = seats[:, 0] * wide + seats[:, 1]

    def sit(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seat = seats[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            nth = rank - seat[:, 1]
            sequence = seat[:, 3] + nth // np.maximum(seat[:, 2], 1)
            offset = seat[:, 4] + nth % np.maximum(seat[:, 2], 1) * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        sit, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
