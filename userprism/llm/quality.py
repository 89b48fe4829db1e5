"""Quality classifier on random-indexing word vectors.

A word and the shape of a word (letters, capitals, digits and signs in runs: "It's" is "Aa'a")
have a fixed sparse random index vector each, and the vector learnt for a row of the hashed
vocabulary is the sum of the index vectors of its neighbours over the whole corpus. A document
is the mean and the spread of its words' vectors, for words and for shapes, and the mean product
of the vectors of neighbours. A network of two
layers, trained with numpy on a bounded sample of labelled rows, gives log-odds; their
temperature is fitted on rows kept out of its training.

Bounds: the vocabulary has ``WORD_ROWS + SHAPE_ROWS`` rows of ``SIZE`` numbers, the training
sample ``sample`` rows. All documents enter the word vectors and are scored.

Defined results: null and empty texts have zero features and get the score the network gives
those. Without labels of both classes every score is the share of label 1 (0.5 with none).
Labels of a repeated doc_id are averaged; null ids and null labels do not train. Repeated rows
are scored each.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..operators.scale import stage
from . import caches, textops

SIZE, NONZERO = 32, 2
WORD_ROWS, SHAPE_ROWS = 1 << 15, 1 << 12
ROWS = WORD_ROWS + SHAPE_ROWS
CHUNK = 1024
FAN_IN = 32
SLICE_BYTES = 1024 * 1024

_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[ord("a") : ord("z") + 1] = ord("a")
_SHAPES[128:] = ord("a")
_SHAPES[ord("A") : ord("Z") + 1] = ord("A")
_SHAPES[ord("0") : ord("9") + 1] = ord("0")
_SHAPES[9:14] = 32

_random = np.random.Generator(np.random.PCG64(11))
_PLACES = _random.integers(0, SIZE, (ROWS, NONZERO))
_SIGNS = _random.choice([-1.0, 1.0], (ROWS, NONZERO))


def tokens(column):
    """(word rows, shape rows, first word of each text) of an Arrow column."""
    caches.release()
    data, offsets = textops.text_bytes(column)
    table = textops.separator_table()
    found = textops.words_of(textops.lower_ascii(data), offsets, table)
    shape = _SHAPES[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True  # a text starts its own run
    before = np.concatenate([[0], np.cumsum(keep)])
    shapes = textops.words_of(shape[keep], before[offsets], table)
    words = (found.hash % np.uint64(WORD_ROWS)).astype(np.int64)
    return words, (shapes.hash % np.uint64(SHAPE_ROWS)).astype(np.int64) + WORD_ROWS, found.first


def _add(total, rows, contexts):
    for k in range(NONZERO):
        at = rows * SIZE + _PLACES[contexts, k]
        total += np.bincount(at, weights=_SIGNS[contexts, k], minlength=len(total))


def neighbours_of(column, total):
    """Add the neighbours' index vectors of every word and shape of a column to ``total``."""
    words, shapes, first = tokens(column)
    if not len(words):
        return
    _add(total, words, shapes)
    inner = np.ones(len(words), bool)
    inner[first[:-1][first[:-1] < len(words)]] = False  # no neighbour before the first word
    right = np.flatnonzero(inner)
    for a, b in ((right, right - 1), (right - 1, right)):
        _add(total, words[a], words[b])
        _add(total, shapes[a], shapes[b])


def word_vectors(docs, text="text"):
    """The learnt matrix of the vocabulary, from all texts.

    Each task adds up its own matrix; matrices are summed in chunks of rows, ``FAN_IN`` tasks
    at a time, until one is left, so no task ever holds more than ``FAN_IN`` chunks. Only the
    final matrix, of fixed size, comes to the driver.
    """

    @caches.tidy
    def add(batches):
        total = np.zeros(ROWS * SIZE)
        for batch in batches:
            for part in textops.slices(batch, "text", SLICE_BYTES):
                neighbours_of(part.column("text"), total)
        if total.any():
            parts = total.astype(np.float32).reshape(-1, CHUNK * SIZE)
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)),
                 pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "part", "sums"],
            )

    def fold(table):
        total = sum(np.frombuffer(s, np.float32).astype(np.float64) for s in table.column("sums").to_pylist())
        return pa.table({
            "chunk": table.column("chunk").slice(0, 1).combine_chunks(), "part": table.column("group").slice(0, 1).combine_chunks(),
            "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary()),
        })

    kinds = "chunk int, part int, sums binary"
    sums = stage(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(add, kinds))
    while (sums.agg(F.countDistinct("part")).first()[0] or 0) > 1:
        grouped = sums.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("int"))
        sums = stage(grouped.groupBy("chunk", "group").applyInArrow(fold, kinds))
    total = np.zeros((ROWS // CHUNK, CHUNK * SIZE))
    for row in sums.collect():  # ROWS / CHUNK rows
        total[row.chunk] = np.frombuffer(row.sums, np.float32)
    return centred(total.reshape(ROWS, SIZE))


def centred(matrix):
    """Rows of length 1 around their mean; rows that no text has stay zero."""
    length = np.sqrt((matrix * matrix).sum(axis=1))
    seen = length > 0
    unit = np.zeros_like(matrix)
    unit[seen] = matrix[seen] / length[seen, None]
    for part in (slice(0, WORD_ROWS), slice(WORD_ROWS, ROWS)):
        if seen[part].any():
            unit[part] -= unit[part][seen[part]].mean(axis=0) * seen[part][:, None]
    return unit.astype(np.float32)


FEATURES = 5 * SIZE


def features(column, vectors):
    """Mean and spread of the vectors of each text's words and shapes, and how far the vectors
    of words next to each other agree."""
    words, shapes, first = tokens(column)
    counts = np.diff(first)
    out = np.zeros((len(counts), FEATURES), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        begin, n = first[some], counts[some][:, None]
        for at, rows in ((0, words), (2 * SIZE, shapes)):
            mine = vectors[rows]
            mean = np.add.reduceat(mine, begin, axis=0) / n
            square = np.add.reduceat(mine * mine, begin, axis=0) / n
            out[some, at : at + SIZE] = mean
            out[some, at + SIZE : at + 2 * SIZE] = np.sqrt(np.maximum(0, square - mean * mean))
        mine = vectors[words]
        mine[1:] *= mine[:-1].copy()
        mine[begin] = 0
        out[some, 4 * SIZE :] = np.add.reduceat(mine, begin, axis=0) / n
    return out


@dataclass
class Model:
    """Scaling, two layers, and the temperature of their log-odds."""

    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    hidden: tuple
    output: tuple
    temperature: float
    constant: float = None

    def log_odds(self, x):
        h = np.maximum(0, ((x - self.shift) / self.scale) @ self.hidden[0] + self.hidden[1])
        return h @ self.output[0] + self.output[1]

    def scores(self, x):
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x.astype(np.float64)) / self.temperature, -35, 35)))


def _train(x, y, units, rounds, seed, decay=1e-4, rate=3e-3):
    """Adam on the logistic loss of a two-layer network."""
    random = np.random.Generator(np.random.PCG64(seed))
    w = [random.standard_normal((x.shape[1], units)) / np.sqrt(x.shape[1] / 2), np.zeros(units),
         random.standard_normal(units) / np.sqrt(units), np.zeros(())]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for _ in range(rounds):
        order = random.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            a, b = x[rows], y[rows]
            h = np.maximum(0, a @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -35, 35))) - b) / len(rows)
            dh = np.outer(d, w[2]) * (h > 0)
            grads = [a.T @ dh + decay * w[0], dh.sum(axis=0), h.T @ d + decay * w[2], d.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return (w[0], w[1]), (w[2], w[3])


def _temperature(odds, y):
    """The temperature that gives the labels the highest likelihood."""
    tried = np.exp(np.linspace(np.log(0.25), np.log(16), 121))
    losses = [np.mean(np.logaddexp(0, np.where(y > 0.5, -1, 1) * odds / t)) for t in tried]
    return float(tried[int(np.argmin(losses))])


def fit(docs, labels, sample=20_000, units=32, rounds=30, seed=5):
    """A model from all texts of ``docs`` and at most ``sample`` rows of ``labels`` (doc_id, quality).

    The sample takes the labelled ids with the smallest hashes. Every fifth row of it, in that
    order, fits the temperature, the others the network. Where one of these parts lacks a class,
    all rows fit the network and the temperature is 1.
    """
    vectors = word_vectors(docs)
    chosen = stage(
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)
    )

    @caches.tidy
    def pool(batches):
        for batch in batches:
            for part in textops.slices(batch, "text", SLICE_BYTES):
                x = features(part.column("text"), vectors)
                yield pa.RecordBatch.from_arrays(
                    [part.column("order"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["order", "y", "x"],
                )

    # At most ``sample`` rows are broadcast.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("order", "y", "text").mapInArrow(pool, "order long, y int, x binary").dropDuplicates(["order"]).collect()
    rows.sort(key=lambda r: r.order)
    y = np.array([r.y for r in rows], float)
    nothing = np.zeros(FEATURES)
    if not len(rows) or y.min() == y.max():
        constant = float(y.mean()) if len(rows) else 0.5
        return Model(vectors, nothing, nothing + 1, None, None, 1.0, constant)
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64)
    aside = np.arange(len(x)) % 5 == 4
    both = len(set(y[aside])) == 2 == len(set(y[~aside]))
    if not both:
        aside[:] = False
    shift, scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-6
    hidden, output = _train((x[~aside] - shift) / scale, y[~aside], units, rounds, seed)
    model = Model(vectors, shift, scale, hidden, output, 1.0)
    if both:
        model.temperature = _temperature(model.log_odds(x[aside]), y[aside])
    return model


def score(docs, model, column="score"):
    """``docs`` with the probability of label 1; texts are read once and not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.5).alias(column)).schema

    @caches.tidy
    def run(batches):
        model = shared.value
        for batch in batches:
            for part in textops.slices(batch, "text", SLICE_BYTES):
                found = model.scores(features(part.column("text"), model.vectors))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], schema=part.schema.append(pa.field(column, pa.float64())))

    return docs.mapInArrow(run, schema)


def remainder(id="doc_id"):
    return F.crc32(F.col(id).cast("string")) % 3


def held_out_scores(docs, labels, **settings):
    """(doc_id, held_out, score, predicted); rows whose id's crc32 leaves 1 by 3 never train."""
    held = F.coalesce(remainder() == 1, F.lit(False))
    model = fit(docs, labels.filter(~held), **settings)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
