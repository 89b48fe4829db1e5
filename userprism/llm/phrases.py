"""Collocations: frequent phrases of two to five words, scored by their weakest cut.

A suffix is a word and up to four that follow it in its piece. Suffixes are pre-aggregated in
each task and routed by a hash of their leading two words to groups of bounded size; the
suffixes of a pair that would fill a group alone are routed by three leading words, those of
such a triple by four, and so on. A group sorts pointers to its suffixes by multikey three-way
quicksort: every partition that is equal in its first d words is a phrase and its weight that
phrase's count, and a partition below the least count is given up at once. Counts of prefixes
shorter than their route are partial and add up over groups.

Three fixed-size bitmaps steer the work and never change a result: words and pairs of words that
may be frequent (a suffix ends before one that is not, as no phrase goes on there), and prefixes
that need a longer route, found in a sample. Pairs are counted first, by 32 bits of their hashes
within a group. Words are compared by 64-bit hashes of (language, word).

Defined results: a null text is empty, a null language ``und``. Repeated rows count each time.
No phrase that is frequent enough: no rows. Extra columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.scale import lookup_join, stage
from . import textops

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
DEPTH = 5
# Text whose words are hashed at once, whose suffixes are pre-aggregated, and that a group holds.
HASH_BYTES = 1024 * 1024
SLICE_BYTES = 4 * 1024 * 1024
GROUP_BYTES = 4 * 1024 * 1024
# Words of a group of that size: a prefix expected more often gets a longer route.
GROUP_WORDS = 700_000
SAMPLE = 1 / 256
BITS = 1 << 23
PAIR_BITS = 1 << 26

ROUTED = "key long, words binary, places binary, weights binary, routes binary"

_LEFT, _RIGHT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _language_codes(column):
    """A 64-bit number for each row's language."""
    coded = textops.as_array(column.fill_null("und")).dictionary_encode()
    numbers = [
        int.from_bytes(hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        for v in coded.dictionary.to_pylist()
    ]
    return np.array(numbers or [0], np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


class Pieces:
    """Words of some rows: number of (language, word), its bytes, and whether the next word follows it."""

    def __init__(self, batch):
        data, offsets = textops.text_bytes(batch.column("text"))
        self.data = textops.lower_ascii(data)
        found = textops.words_of(self.data, offsets, textops.separator_table(BREAKS + BLANKS))
        self.start, self.end = found.start, found.end
        self.rows = np.repeat(np.arange(batch.num_rows), found.counts)
        id = textops.mix(found.hash ^ _language_codes(batch.column("lang"))[self.rows])
        self.id = np.where(id == 0, np.uint64(1), id)
        breaks = np.cumsum(textops.separator_table(BREAKS)[self.data], dtype=np.int32)
        piece = breaks[self.start] if len(self.start) else np.zeros(0, np.int32)
        self.follows = np.zeros(len(self.rows), bool)
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (self.rows[1:] == self.rows[:-1])

    def texts(self, at):
        """Bytes of the words at these places, as one Arrow column."""
        sizes = self.end[at] - self.start[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], sizes)
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.data[take])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), buffers).cast(pa.large_string())


def _numbers(batch):
    """(word numbers, whether the next word follows) of a slice, hashed in smaller parts."""
    parts = [Pieces(part) for part in textops.slices(batch, limit=HASH_BYTES)]
    return np.concatenate([p.id for p in parts]), np.concatenate([p.follows for p in parts])


def _bits(found, position, size=BITS):
    """A bitmap of ``size`` bits of the numbers in a column of ``found``: bounded whatever they are."""
    place = found.select((F.pmod(position, F.lit(size)) + 1).alias("p"))
    rows = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    ).collect()  # at most size / 32768 rows of 4 KB
    out = np.zeros(size // 8, np.uint8)
    for row in rows:
        at = (row.b - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def _has(bits, numbers):
    at = (numbers % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def word_counts(docs):
    """(lang, word, id, f): every word of each language, how often it stands in the texts."""

    def count(batches):
        for batch in batches:
            for part in textops.slices(batch, limit=HASH_BYTES):
                found = Pieces(part)
                _, at, n = np.unique(found.id, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("lang").fill_null("und").take(pa.array(found.rows[at])),
                        found.texts(at).cast(pa.string()),
                        pa.array(found.id[at].view(np.int64)),
                        pa.array(n),
                    ],
                    names=["lang", "word", "id", "f"],
                )

    rows = docs.select("text", "lang").mapInArrow(count, "lang string, word string, id long, f long")
    return rows.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def _pair(first, second):
    return textops.mix(first * _LEFT + second * _RIGHT + np.uint64(1))


def _place(key, low):
    """Bitmap position of a pair known by its group and 32 bits of its hash."""
    return textops.mix(key.astype(np.uint64) << np.uint64(32) | low)


def _halves(pairs, groups):
    return (pairs >> np.uint64(32)) % np.uint64(groups), pairs & np.uint64(0xFFFFFFFF)


def frequent_pairs(docs, frequent, least, groups):
    """Bitmap of the pairs of neighbouring words that may occur ``least`` times."""

    def count(batches):
        for batch in batches:
            for part in textops.slices(batch, limit=SLICE_BYTES):
                id, follows = _numbers(part)
                at = np.flatnonzero(follows & _has(frequent, id))
                at = at[_has(frequent, id[at + 1])]
                pairs, n = np.unique(_pair(id[at], id[at + 1]), return_counts=True)
                key, low = _halves(pairs, groups)
                order = np.argsort(key, kind="stable")
                key, low, n = key[order].astype(np.int64), low[order].astype(np.uint32), n[order].astype(np.uint32)
                keys, begin = np.unique(key, return_index=True)
                spans = list(zip(begin, np.append(begin[1:], len(key))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (low, n))],
                    names=["key", "pairs", "times"],
                )

    def add(table):
        low, n = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32).astype(np.uint64) for c in ("pairs", "times")
        )
        order = np.argsort(low)
        low, n = low[order], n[order]
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        often = low[first][np.add.reduceat(n, first) >= least]
        key = np.full(len(often), table.column("key")[0].as_py())
        return pa.table({"p": pa.array(_place(key, often).view(np.int64))})

    rows = docs.mapInArrow(count, "key long, pairs binary, times binary")
    return _bits(rows.groupBy("key").applyInArrow(add, "p long"), F.col("p"), PAIR_BITS)


def suffixes(id, follows, filters):
    """Columns of word numbers of each suffix (0: ended) and hashes of its prefixes of 2 to 5 words."""
    frequent, pairs, groups = filters
    goes_on, n = follows & _has(frequent, id), len(id)
    at = np.flatnonzero(goes_on)
    at = at[_has(frequent, id[at + 1])]
    at = at[_has(pairs, _place(*_halves(_pair(id[at], id[at + 1]), groups)))]
    goes_on[:] = False
    goes_on[at] = True
    # The word ``depth`` further on, while every pair before it goes on.
    ahead = np.concatenate([id, np.zeros(DEPTH, np.uint64)])
    linked = np.concatenate([goes_on, np.zeros(DEPTH, bool)])
    columns = [id[at]]
    still = np.ones(len(at), bool)
    for depth in range(1, DEPTH):
        still = still & linked[at + depth - 1]
        columns.append(np.where(still, ahead[at + depth], np.uint64(0)))
    prefixes = [_pair(columns[0], columns[1])]
    for depth in range(2, DEPTH):
        prefixes.append(textops.mix(prefixes[-1] * _LEFT + columns[depth] * _RIGHT + np.uint64(depth)))
    return columns, prefixes


def long_routes(docs, filters, group_words, sample):
    """Bitmap of prefixes of 2 to 4 words that would fill a group alone, judged by a sample."""

    def count(batches):
        for batch in batches:
            for part in textops.slices(batch, limit=SLICE_BYTES):
                columns, prefixes = suffixes(*_numbers(part), filters)
                every = np.concatenate([p[columns[d + 1] != 0] for d, p in enumerate(prefixes[:3])])
                values, n = np.unique(every, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["p", "n"])

    some = docs.sample(sample, seed=11) if sample < 1 else docs
    counts = some.mapInArrow(count, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    return _bits(counts.filter(F.col("n") >= group_words * sample), F.col("p"))


def _route(batches, filters, heavy, groups):
    """The distinct suffixes of each slice by group, with their counts and route lengths."""
    for batch in batches:
        for part in textops.slices(batch, limit=SLICE_BYTES):
            columns, prefixes = suffixes(*_numbers(part), filters)
            size = sum((c != 0).astype(np.int64) for c in columns)
            route, route_hash, longer = np.full(len(size), 2), prefixes[0], np.ones(len(size), bool)
            for depth in (2, 3, 4):
                longer &= (size >= depth) & _has(heavy, prefixes[depth - 2])
                route += longer
                route_hash = np.where(longer & (size > depth), prefixes[depth - 1], route_hash)
            key = (textops.mix(route_hash) % np.uint64(groups)).astype(np.int64)
            # Equal beginnings stand together: such columns shuffle small.
            order = np.lexsort((prefixes[3], prefixes[1], prefixes[0], key))
            whole = prefixes[3][order]
            new = np.ones(len(whole), bool)
            new[1:] = whole[1:] != whole[:-1]
            first = np.flatnonzero(new)
            weight = np.diff(np.append(first, len(whole))).astype(np.uint32)
            at, key = order[first], key[order[first]]
            words, route = np.stack([c[at] for c in columns]), route[at].astype(np.uint8)
            keys, begin = np.unique(key, return_index=True)
            rows = [_pack(words[:, a:b], weight[a:b], route[a:b]) for a, b in zip(begin, np.append(begin[1:], len(key)))]
            packed = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), *(pa.array(c, pa.binary()) for c in packed)], names=[f.split()[0] for f in ROUTED.split(", ")]
            )


def _pack(words, weight, route):
    """A group's share of a slice: distinct word numbers, places among them, weights, route lengths."""
    values, places = np.unique(words, return_inverse=True)
    narrow = np.uint16 if len(values) <= 1 << 16 else np.uint32
    return values.tobytes(), places.astype(narrow).tobytes(), weight.tobytes(), route.tobytes()


def _unpack(table):
    """Columns, weights and route lengths of all rows of a group."""
    parts = []
    for values, places, weight, route in zip(*(table.column(c).to_pylist() for c in ("words", "places", "weights", "routes"))):
        narrow = np.uint16 if len(places) == 2 * DEPTH * len(route) else np.uint32
        words = np.frombuffer(values, np.uint64)[np.frombuffer(places, narrow).reshape(DEPTH, -1)]
        parts.append((words, np.frombuffer(weight, np.uint32), np.frombuffer(route, np.uint8)))
    words, weight, route = zip(*parts)
    return np.concatenate(words, axis=1), np.concatenate(weight).astype(np.int64), np.concatenate(route)


def quicksort_counts(words, weight, least):
    """Phrases of a group's suffixes by multikey three-way quicksort of pointers to them.

    ``words`` has a row per depth (0: the suffix has ended). All partitions are split in the same
    round, each about the word of its own depth at its own pivot; the part that equals the pivot
    goes one word deeper. Parts of less weight than ``least`` are abandoned. Yields (depth,
    pointers, counts): a suffix that begins with each phrase found, and how often it occurs.
    """
    pointer = np.arange(words.shape[1])
    size = np.array([len(pointer)])
    depth = np.zeros(1, np.int64)
    while len(pointer):
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size)
        value = words[depth[part], pointer]
        low, mid, high = value[start], value[start + size // 2], value[start + size - 1]
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))
        side = (value > pivot[part]) * 1 + (value >= pivot[part])  # 0 below, 1 equal, 2 above
        child = part * 3 + side
        counts = np.bincount(child, minlength=3 * len(size))
        total = np.bincount(child, weights=weight[pointer], minlength=3 * len(size)).astype(np.int64)
        child_depth = np.repeat(depth, 3)
        equal = np.zeros(3 * len(size), bool)
        equal[1::3] = pivot != 0
        ended = np.zeros(3 * len(size), bool)
        ended[1::3] = pivot == 0
        keep = (total >= least) & (counts > 0) & ~ended
        child_depth[equal] += 1
        # A pointer's new place: those of its child before it, after all earlier kept children.
        stays = keep[child]
        pointer, child = pointer[stays], child[stays]
        order = np.argsort(child, kind="stable")
        pointer, size, depth = pointer[order], counts[keep], child_depth[keep]
        found = equal[keep]
        if found.any():
            yield depth[found], pointer[(np.cumsum(size) - size)[found]], total[keep][found]
        goes = depth < len(words)
        if not goes.all():
            pointer = pointer[np.repeat(goes, size)]
            size, depth = size[goes], depth[goes]


def _packed(words, depth, pointer):
    """The first ``depth`` words of suffixes as bytes that compare like the words."""
    raw = np.ascontiguousarray(words[:, pointer].T).astype(">u8").tobytes()
    width = 8 * len(words)
    return [raw[i * width : i * width + 8 * d] for i, d in enumerate(depth.tolist())]


def _mine(table, least):
    words, weight, route = _unpack(table)
    phrases, counts = [], []
    for length in np.unique(route):
        mine = route == length
        some, load = np.ascontiguousarray(words[:, mine]), weight[mine]
        for depth, pointer, n in quicksort_counts(some, load, least):
            whole = depth >= length
            phrases += _packed(some, depth[whole], pointer[whole])
            counts.append(n[whole])
        if length > 2:  # prefixes shorter than the route: only this group's share of their counts
            for depth, pointer, n in quicksort_counts(some[: length - 1], load, 1):
                pair = depth >= 2
                phrases += _packed(some, depth[pair], pointer[pair])
                counts.append(n[pair])
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return pa.table({"phrase": pa.array(phrases, pa.binary()), "n": pa.array(n, pa.int64())})


def phrase_counts(docs, words, least=100, group_bytes=GROUP_BYTES, group_words=GROUP_WORDS, sample=SAMPLE):
    """(phrase, a): phrases of 2 to 5 words with at least ``least`` occurrences, as word numbers."""
    docs = docs.select("text", "lang")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    frequent = _bits(words.filter(F.col("f") >= least), F.col("id"))
    filters = (frequent, frequent_pairs(docs, frequent, least, groups), groups)
    # 10 MB, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast((filters, long_routes(docs, filters, group_words, sample)))
    routed = docs.mapInArrow(lambda batches: _route(batches, *shared.value, groups), ROUTED)
    mined = routed.groupBy("key").applyInArrow(lambda table: _mine(table, least), "phrase binary, n long")
    return mined.groupBy("phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def collocations(docs, least=100, top=2000, **routing):
    """Each language's first ``top`` phrases by score, with the counts behind the score.

    A phrase goes when one more word on either side leaves its count as it is: any longer phrase
    that holds it as often has such a phrase in between.
    """
    words = stage(word_counts(docs))
    found = stage(phrase_counts(docs, words, least, **routing))
    key = F.unhex(F.lpad(F.hex(F.col("id")), 16, "0"))
    single = words.filter(F.col("f") >= least).select(key.alias("phrase"), F.col("f").alias("a"))
    counted = stage(found.unionByName(single))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    length = F.octet_length("phrase") / 8
    # One more word than the phrase, cut at either end.
    longer = found.filter(length > 2).select(
        F.explode(F.array(F.expr("substring(phrase, 9)"), F.expr("substring(phrase, 1, octet_length(phrase) - 8)"))).alias("phrase"),
        F.col("a").alias("__longer"),
    ).groupBy("phrase").agg(F.max("__longer").alias("__longer"))
    kept = found.join(longer, "phrase", "left").filter(F.coalesce(F.col("__longer") < F.col("a"), F.lit(True)))
    first = words.filter(F.col("f") >= least).select(key.alias("__first"), "lang")
    kept = kept.select("phrase", "a", F.expr("substring(phrase, 1, 8)").alias("__first"))
    placed = lookup_join(lookup_join(kept, first, "__first", "inner", staged=True), totals, "lang", "inner").drop("__first")
    cuts = placed.withColumn("k", F.explode(F.sequence(F.lit(1), length.cast("int") - 1))).selectExpr(
        "*", "substring(phrase, 1, 8 * k) AS __left", "substring(phrase, 8 * k + 1) AS __right"
    )
    counted_left = counted.selectExpr("phrase AS __left", "a AS l")
    counted_right = counted.selectExpr("phrase AS __right", "a AS r")
    cuts = lookup_join(cuts, counted_left, "__left", "inner", staged=True).drop("__left")
    cuts = lookup_join(cuts, counted_right, "__right", "inner", staged=True).drop("__right")
    wide = "CAST({} AS DECIMAL(19, 0))"
    product = f"(1000 * ({wide.format('a')} * {wide.format('n')})) div ({wide.format('l')} * {wide.format('r')})"
    scored = cuts.withColumn("score", F.expr(product))
    best = F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("best")
    scored = scored.groupBy("phrase", "lang", "a", "n").agg(best).select("phrase", "lang", "a", "n", "best.*")
    order = [F.col("score").desc(), F.col("a").desc()]
    # Ties at the end stay until their words are known.
    near = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top)
    near = stage(near)
    spelt = near.select("phrase", F.posexplode(F.expr(
        "transform(sequence(0, CAST(octet_length(phrase) / 8 AS INT) - 1), i -> substring(phrase, 8 * i + 1, 8))"
    )).alias("i", "__word"))
    spelling = words.filter(F.col("f") >= least).select(key.alias("__word"), "word")
    spelt = lookup_join(spelt, spelling, "__word", "inner", staged=True).groupBy("phrase").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(i, word))), x -> x.word), ' ')").alias("text")
    )
    ranked = near.join(spelt, "phrase").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "text"))
    )
    return ranked.filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score"
    )
