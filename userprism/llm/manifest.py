"""Merkle manifest of a dataset: a proof for every row, by butterfly exchange.

Rows are ranked within their group and cut into aligned partitions of ``fanout ** levels`` leaves.
A partition builds its own subtree. Then, in round r, the partitions whose numbers differ only in
digit r swap the roots they hold: each asks one partition of every sibling subtree, and hashes the
common ancestor itself, as all others of that subtree do. After as many rounds as the tree has
levels left, every partition knows the root and its own upper proof; nothing is handed down. The
roots of the groups then form one more tree in the same way.

A level of a proof is ``struct<at int, others string>``: the node's place in its run, and the
digests of the run's other nodes in order.

Defined results: ``-`` stands for a null in a leaf; rows come by doc_id, null first, and equal
ids by leaf; equal rows are a leaf each. Null is a group of its own and the first. A table without
rows gives no rows. Extra columns are not read.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.scale import lookup_join, prefix_sums, stage

FANOUT = 2
# Levels that a partition of leaves builds alone: 4096 leaves.
LEVELS = 12

PROOF = "array<struct<at: int, others: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(columns):
    """Values one after the other, each ``-`` or its byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ])


def leaf_digest(**replaced):
    """Digest of a row's fields; ``replaced`` names columns to read otherwise."""
    return F.sha2(encoded([replaced.get(f, F.col(f)) for f in FIELDS]), 256)


def _digest(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def subtree(leaves, top, fanout=FANOUT):
    """Root over ``leaves`` after ``top`` levels, and each leaf's proof up to there.

    Only in a tree of one partition may the climb end early: there ``top`` is None.
    """
    nodes, proofs, level = list(leaves), [[] for _ in leaves], 0
    while len(nodes) > 1 if top is None else level < top:
        width = fanout**level
        for i, proof in enumerate(proofs):
            at = i // width
            first = at - at % fanout
            run = nodes[first : first + fanout]
            proof.append({"at": at - first, "others": "".join(run[: at - first] + run[at - first + 1 :])})
        nodes = [_digest(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        level += 1
    return nodes[0], proofs


def _build(table, levels, fanout):
    """A partition's leaves with their proofs inside it and its root."""
    table = table.sort_by("position")
    alone = table.column("total")[0].as_py() <= fanout**levels
    root, proofs = subtree(table.column("digest").to_pylist(), None if alone else levels, fanout)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))
    return pa.table({
        "group": table.column("group"), "block": table.column("block"), "id": table.column("id"),
        "digest": table.column("digest"), "proof": pa.array(proofs, kind),
        "block_root": pa.array([root] * table.num_rows, pa.string()),
    })


def _swap(held, stride, fanout):
    """One round: each partition meets one partner of every sibling subtree of ``stride`` partitions.

    ``held`` has (group, block, blocks, root, proof). A partner stands at the same place of its
    subtree; in the last, shorter subtree, places are taken in turn.
    """
    # Groups with more rounds to go; the others are done.
    asks = held.filter(F.col("blocks") > stride)
    start = (F.col("block") - F.col("block") % (stride * fanout)).alias("start")
    asks = asks.select("group", "block", "blocks", "proof", "root", start).withColumn(
        "digit", F.explode(F.array(*[F.lit(d) for d in range(fanout)]))
    ).withColumn("other", F.col("start") + F.col("digit") * stride).filter(F.col("other") < F.col("blocks"))
    partner = F.col("other") + F.col("block") % stride % F.least(F.lit(stride), F.col("blocks") - F.col("other"))
    asks = asks.withColumn("partner", F.struct("group", partner.cast("long").alias("block")))
    roots = held.select(F.struct("group", "block").alias("partner"), F.col("root").alias("theirs"))
    met = lookup_join(asks, roots, "partner", "inner", staged=True).groupBy("group", "block").agg(
        F.first("blocks").alias("blocks"), F.first("proof").alias("proof"), F.first("start").alias("start"),
        F.sort_array(F.collect_list(F.struct("digit", "theirs"))).alias("run"),  # fanout rows at most
    )
    at = ((F.col("block") - F.col("start")) / stride).cast("int")
    others = F.array_join(F.transform(F.filter("run", lambda x: x.digit != at), lambda x: x.theirs), "")
    whole = F.array_join(F.transform("run", lambda x: x.theirs), "")
    level = F.array(F.struct(at.alias("at"), others.alias("others")))
    raised = met.select(
        "group", "block", "blocks", F.sha2(whole, 256).alias("root"), F.concat("proof", level).alias("proof")
    )
    return raised.unionByName(held.filter(F.col("blocks") <= stride))


def prove(nodes, levels=LEVELS, fanout=FANOUT):
    """(group, id, digest, proof, root) of ``nodes`` with (group, place, id, digest).

    ``group`` is a text that is not null, ``place`` orders a group and is unique there.
    """
    ranked = prefix_sums(nodes.withColumn("one", F.lit(1)), ["group"], "place", "one")
    size = fanout**levels
    ranked = ranked.select(
        "group", "id", "digest", F.col("before").cast("long").alias("position"),
        F.col("group_total").cast("long").alias("total"),
        F.floor(F.col("before") / size).cast("long").alias("block"),
    )
    built = stage(ranked.groupBy("group", "block").applyInArrow(
        lambda table: _build(table, levels, fanout),
        f"group string, block long, id {dict(nodes.dtypes)['id']}, digest string, proof {PROOF}, block_root string",
    ))
    blocks = built.groupBy("group", "block").agg(F.first("block_root").alias("root"))
    counts = blocks.groupBy("group").agg((F.max("block") + 1).alias("blocks"))
    held = stage(blocks.join(counts, "group").select("group", "block", "blocks", "root", F.expr(f"CAST(array() AS {PROOF})").alias("proof")))
    most = held.agg(F.max("blocks")).first()[0] or 0
    stride = 1
    while stride < most:
        held = stage(_swap(held, stride, fanout))
        stride *= fanout
    upper = held.select("group", "block", F.col("proof").alias("upper"), "root")
    proven = built.join(upper, ["group", "block"])
    return proven.select("group", "id", "digest", F.concat("proof", "upper").alias("proof"), "root")


def folded(leaf, proof):
    """Root that follows from a leaf and the other nodes of its proof."""
    def climb(node, level):
        before = level.at * 64
        whole = F.concat(level.others.substr(F.lit(1), before), node, level.others.substr(before + 1, F.length(level.others)))
        return F.sha2(whole, 256)

    return F.aggregate(proof, leaf, climb)


def proof_digest(proof):
    return F.sha2(F.array_join(F.transform(proof, lambda level: level.others), ""), 256)


def manifest(docs, levels=LEVELS, fanout=FANOUT):
    """(id, digest, group, subroot, root, proof): every row's whole proof, by language.

    ``id`` holds doc_id and, for the rows to tamper with, the tampered leaf.
    """
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf_digest(n_chars=F.col("n_chars") + 1)
    rows = docs.select(*FIELDS).select(
        # Null sorts first, and a group key is never null.
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("group"),
        F.struct("doc_id", F.when(tampers, changed).alias("tampered")).alias("id"),
        leaf_digest().alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("place", F.struct("id.doc_id", "digest", "row"))
    lower = stage(prove(rows.drop("row"), levels, fanout))
    tops = lower.groupBy("group").agg(F.first("root").alias("digest"))
    tops = tops.select(F.lit("").alias("group"), F.col("group").alias("place"), F.col("group").alias("id"), "digest")
    upper = prove(tops, levels, fanout).select(
        F.col("id").alias("group"), F.col("proof").alias("upper"), F.col("root").alias("top")
    )
    return lookup_join(lower, upper, "group", "inner").select(
        "group", "id", "digest", F.col("root").alias("subroot"), F.col("top").alias("root"),
        F.concat("proof", "upper").alias("proof"),
    )


def verify(docs, levels=LEVELS, fanout=FANOUT):
    """One row per document: its digests, and whether a tampered leaf still leads to the root."""
    proven = manifest(docs, levels, fanout)
    again = folded(F.coalesce("id.tampered", "digest"), F.col("proof"))
    return proven.select(
        "id.doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        proof_digest(F.col("proof")).alias("proof_sha256"), again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
