"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Only rows of the matrix that can reach the threshold take part, which sizes alone decide:

1. A set of n shingles links with another only if they share ``least(n)`` of their
   ``prefix(n)`` smallest hashes. The prefixes of all blocks of documents are merged (see
   ``blocks``), and a document with fewer prefix hashes that occur elsewhere is out.
2. Equal sets become one row. Of the others' shared prefix hashes each row keeps, rarest
   first, as many columns as a linked row cannot avoid; rows that meet in a column are of one
   family.
3. A family's rows are compared with its smallest id first. Those linked with it are of one
   component already and are not compared with each other. All other pairs of fitting size
   classes meet in blocks of at most ``BLOCK_ROWS`` rows and ``BLOCK_SETS`` bytes, whose sparse
   product accumulates the overlap counts. Pairs whose overlap stays below the bound of their
   sizes are discarded there, and of the links of a block only a spanning forest leaves it.

Every link between different texts is on a path of found links, so components are whole.
Defined results: a document without words has no shingles and links with nothing, nor does one
with a null id (its component is null); rows with the same id are one node. Extra columns are
not read.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.scale import lookup_join, stage
from . import blocks as B
from . import textops
from .components import components

WIDTH = 3
BLOCK_ROWS = 1024
BLOCK_SETS = 4 * 1024 * 1024
MOST = 1 << 32  # blocks of a cell

MARKED = "doc_id long, n long, set_key binary, columns binary, shingles binary"


class Bounds:
    """Size-derived bounds for a Jaccard threshold of ``percent`` / 100.

    A longer prefix, by ``spare`` / 100 of the set, lets a document show more shared hashes
    before it is looked at any further; results do not depend on it.
    """

    def __init__(self, percent=90, spare=10):
        self.percent, self.spare_percent = percent, spare

    def overlap(self, n, m):
        """Smallest overlap with which sets of n and m link: 100 * o >= percent * (n + m - o)."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def own(self, n):
        """Smallest overlap of a set of n with any other."""
        return -(-self.percent * n // 100)

    def spare(self, n):
        """How many shared hashes beyond the first the prefix must show; grows with n."""
        return np.maximum(1, self.spare_percent * n // 100)

    def prefix(self, n):
        return np.minimum(n, n - self.own(n) + self.spare(n))

    def least(self, n):
        """Shared prefix hashes that a linked set of any size brings: sizes differ by the threshold."""
        return self.spare(self.own(n))


def _sets(table, n_blocks, bounds, width):
    """Entries of the prefixes of a block; (sets by document, prefix owner)."""
    found = textops.words(table.column("text"), lower=True)
    hashes, owner = textops.distinct_sorted(*textops.shingles(found, width))
    first = np.searchsorted(owner, np.arange(table.num_rows + 1))
    n = np.diff(first)
    rank = np.arange(len(hashes)) - first[owner]
    inside = rank < bounds.prefix(n)[owner]
    h, o = hashes[inside], owner[inside]
    # The bucket's bits come from the hash itself: shingle hashes are compared whole in the end.
    entries = B.Entries(h, B.buckets_of(textops.mix(h), n_blocks))
    return entries, (hashes, first, n, o)


def _keys(hashes, first):
    return [hashlib.md5(hashes[a:b].tobytes()).digest() for a, b in zip(first, first[1:])]


def marked(docs, bounds, width, block_bytes):
    """All documents with their set size; those that can link also with their set and columns."""
    n_blocks = B.number(docs, block_bytes=block_bytes)

    def finish(table, entries, more, known, detail):
        hashes, first, n, owner = more
        shared = known[entries.of]
        count = np.bincount(owner[shared], minlength=len(n))
        stays = (count >= bounds.least(n)) & (n > 0)
        # Rarest first, then by hash. Hashes that occur nowhere else come before all.
        at = np.flatnonzero(shared & stays[owner])
        value, mine = entries.hash[entries.of[at]], owner[at]
        order = np.lexsort((value, detail[entries.of[at]], mine))
        value, mine = value[order], mine[order]
        begin = np.searchsorted(mine, np.arange(len(n) + 1))
        take = count - bounds.least(n) + 1
        keys = _keys(hashes, first)
        out = [(
            keys[i], value[begin[i] : begin[i] + take[i]].tobytes(), hashes[first[i] : first[i + 1]].tobytes()
        ) if stays[i] else (None, None, None) for i in range(len(n))]
        columns = zip(*out) if out else ((), (), ())
        return pa.table([
            table.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)
        ], names=[f.split()[0] for f in MARKED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return B.resolve(
        B.dealt(rows, n_blocks), lambda t: _sets(t, n_blocks, bounds, width), finish, MARKED, count=True
    )


def _overlaps(sets, left, right):
    """(row of ``left``, overlaps with all rows of ``right``), one after the other.

    Columns that one row alone has are left out. Where few columns are left for many meetings
    they are multiplied as dense strips, else row by row over the sorted columns of ``right``.
    """
    rows = np.union1d(left, right)
    keys = np.concatenate([sets[r] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, times = np.unique(keys, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    row, column = row[keep], shared[column[keep]]
    width = int(shared[-1]) + 1 if len(shared) else 0
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    at_left, at_right = np.searchsorted(rows, left), np.searchsorted(rows, right)
    df = np.bincount(column, minlength=width).astype(float)
    if len(left) * len(right) * width < 100 * (df * df).sum():
        total = np.zeros((len(left), len(right)), np.float32)
        for low in range(0, width, 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            strip = np.zeros((len(rows), 4096), np.float32)
            strip[row[a:b], column[a:b] - low] = 1
            total += strip[at_left] @ strip[at_right].T
        yield from zip(left, total)
        return
    place = np.full(len(rows), -1)
    place[at_right] = np.arange(len(right))
    inside = place[row] >= 0
    owner, key = place[row[inside]], column[inside]
    by_row = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[by_row], np.arange(len(rows) + 1))
    for i, r in zip(left, at_left):
        mine = column[by_row[ends[r] : ends[r + 1]]]
        a, b = np.searchsorted(key, mine, side="left"), np.searchsorted(key, mine, side="right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield i, np.bincount(owner[at], minlength=len(right))


def _links(sets, n, left, right, bounds):
    """Pairs (i, j) of rows of ``left`` and ``right`` whose overlap reaches the bound of their sizes."""
    for i, overlap in _overlaps(sets, left, right):
        for k in np.flatnonzero((overlap >= bounds.overlap(n[i], n[right])) & (overlap > 0)):
            yield i, right[k]


def _forest(pairs):
    """The pairs that join two trees, of pairs in any number."""
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            yield i, j


def _product(table, bounds):
    """Links of one pair of blocks of a family, as a forest of edges (a, b)."""
    ids = table.column("doc_id").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    n = np.array([len(s) for s in sets])
    side = table.column("side").to_numpy()  # 0: left, 1: right, 2: both (a block with itself)
    if (side == 2).any():
        left = right = np.flatnonzero(side == 2)
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    edges = list(_forest((i, j) for i, j in _links(sets, n, left, right, bounds) if i != j)) if len(left) and len(right) else []
    return pa.table({"a": pa.array([ids[i] for i, _ in edges], pa.int64()), "b": pa.array([ids[j] for _, j in edges], pa.int64())})


def _family_links(rows, bounds, block_rows):
    """Links inside families. ``rows``: family, doc_id, shingles, large; a family is its smallest id.

    A family that fits into one block is one product; only large ones are dealt into blocks.
    """
    whole = rows.filter("NOT large").select("family", "doc_id", "shingles", F.lit(2).alias("side"))
    small = whole.groupBy("family").applyInArrow(lambda t: _product(t, bounds), "a long, b long")
    return small.unionByName(_large_links(rows.filter("large").drop("large"), bounds, block_rows))


def _large_links(rows, bounds, block_rows):
    head = rows.filter("doc_id = family").select("family", F.col("shingles").alias("head"))

    def with_head(batches):
        for batch in batches:
            linked = []
            for mine, head in zip(batch.column("shingles").to_pylist(), batch.column("head").to_pylist()):
                x, y = np.frombuffer(mine, np.uint64), np.frombuffer(head, np.uint64)
                low, high = min(len(x), len(y)), max(len(x), len(y))
                linked.append(
                    100 * low >= bounds.percent * high
                    and len(np.intersect1d(x, y, assume_unique=True)) >= bounds.overlap(len(x), len(y))
                )
            kept = [batch.column(c) for c in ("family", "doc_id", "shingles")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(linked, pa.bool_())], names=["family", "doc_id", "shingles", "linked"])

    compared = stage(
        lookup_join(rows, head, "family", "inner").select("family", "doc_id", "shingles", "head")
        .mapInArrow(with_head, "family long, doc_id long, shingles binary, linked boolean")
    )
    stars = compared.filter("linked").select(F.col("doc_id").alias("a"), F.col("family").alias("b"))
    # Linked sizes differ by the threshold at most, so by one step of these classes.
    step = math.log(100 / bounds.percent) * (1 + 1e-9)
    n = F.octet_length("shingles") / 8
    placed = compared.withColumn("class", F.floor(F.log(n) / step))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_SETS))
    cells = placed.groupBy("family", "class", "linked").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("rows"))
    # A few entries for each class of a family; families of linked rows alone need no more.
    maps = cells.groupBy("family").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("class", "linked").alias("cell"), "blocks"))).alias("cells"),
        F.count_if(~F.col("linked")).alias("free"),
    ).filter("free > 0").drop("free")

    def labels(cell_class, linked):
        """Numbers of all blocks of a cell."""
        count = F.try_element_at("cells", F.struct(cell_class.alias("class"), linked.alias("linked")))
        base = (cell_class * 2 + linked.cast("long")) * MOST
        return F.when(count.isNull(), F.array().cast("array<bigint>")).otherwise(F.sequence(base, base + count - 1))

    own = (F.col("class") * 2 + F.col("linked").cast("long")) * MOST + F.pmod(
        F.xxhash64("doc_id"), F.element_at("cells", F.struct("class", "linked"))
    )
    free = F.concat(*[labels(F.col("class") + d, F.lit(False)) for d in (-1, 0, 1)])
    covered = F.concat(*[labels(F.col("class") + d, F.lit(True)) for d in (-1, 0, 1)])
    partners = F.when(F.col("linked"), free).otherwise(F.concat(free, covered))
    dealt = lookup_join(placed, maps, "family", "inner").withColumn("own", own).withColumn("other", F.explode(partners))
    met = dealt.select(
        "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "doc_id", "shingles",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    found = met.groupBy("family", "x", "y").applyInArrow(lambda t: _product(t, bounds), "a long, b long")
    return stars.unionByName(found)


def link(docs, percent=90, width=WIDTH, block_bytes=B.BLOCK_BYTES, block_rows=BLOCK_ROWS):
    """One row (doc_id, n_shingles, component_id) per document."""
    bounds = Bounds(percent)
    all_docs = stage(marked(docs, bounds, width, block_bytes))
    able = all_docs.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # Equal sets become one row, the one with the smallest id; copies combine before the shuffle.
    least = able.groupBy("set_key").agg(F.min(F.struct("doc_id", "columns", "shingles")).alias("row"))
    rows = stage(least.select("set_key", "row.*", (F.octet_length("row.shingles") / 8).cast("long").alias("n")))
    kinds = rows.select("set_key", F.col("doc_id").alias("kind"))
    copies = lookup_join(able.select("set_key", "doc_id"), kinds, "set_key", "inner", staged=True).filter(
        "doc_id <> kind"
    ).select(F.col("doc_id").alias("a"), F.col("kind").alias("b"))

    def unpack(batches):
        for batch in batches:
            values = [np.frombuffer(c, np.int64) for c in batch.column("columns").to_pylist()]
            ids = np.repeat(batch.column("doc_id").to_numpy(), [len(v) for v in values])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*values, np.zeros(0, np.int64)])), pa.array(ids, pa.int64())], names=["column", "doc_id"]
            )

    cells = rows.select("doc_id", "columns").mapInArrow(unpack, "column long, doc_id long")
    heads = cells.groupBy("column").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).filter("head < last")
    met = lookup_join(cells, heads, "column", "inner").filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    families = components(met).withColumnRenamed("component", "family")
    sized = rows.select(F.col("doc_id").alias("node"), "n").join(families, "node")
    large = (F.count(F.lit(1)) > block_rows) | (F.sum("n") * 8 > BLOCK_SETS)
    families = lookup_join(families, sized.groupBy("family").agg(large.alias("large")), "family", "inner")
    members = rows.join(families, rows.doc_id == families.node).select("family", "doc_id", "shingles", "large")
    edges = _family_links(members, bounds, block_rows).unionByName(copies)
    found = components(edges)
    return (
        all_docs.select("doc_id", F.col("n").alias("n_shingles"))
        .join(found, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def representatives(docs, percent=80, width=5, **settings):
    """The rows of ``docs`` that stay: of each component those with the smallest doc_id.

    Rows with a null id stay. Rows with the same id are one node: of equal texts among them one row
    stays, the smallest; different texts of the id that stays all stay, as none stands for another.
    """
    # Components hold their smallest id themselves.
    found = link(docs, percent, width, **settings).filter("doc_id = component_id")
    found = stage(found.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("many")))
    once = docs.join(found.filter("NOT many").select("doc_id"), "doc_id", "left_semi")
    # Rows that share an id are few as a rule; only they are compared by text.
    shared = lookup_join(docs, found.filter("many").select("doc_id"), "doc_id", "left_semi", staged=True)
    shared = shared.withColumn("__text", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", "__text"])
    return once.unionByName(shared.drop("__text")).unionByName(docs.filter("doc_id IS NULL"))
