"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the mix by weight, at most ``repeats`` times its size; what a
full source leaves over is shared by the others. A target is met by complete epochs of the source
first and then by a weighted sample without replacement: every document draws an exponential key,
divided by its quality weight, documents are sorted by key within their source, and their sizes
are summed until the rest of the target is reached. The document that crosses it is taken when
that ends nearer to the target. Keys are hashes of the document, so reruns agree.

Sources and documents are ranked by running totals over range partitions, so neither a source of
any size nor any number of sources is gathered.

Defined results: a null or empty text has size 0 and takes nothing. Null is the last source.
Documents without an id draw keys like others. Equal rows have equal keys and come in any order;
which of them is taken then makes no difference. No rows give no rows. Extra columns are not read.
"""

from pyspark.sql import functions as F

from ..operators.scale import lookup_join, prefix_sums, stage

WORD = r"[^\x20\x09-\x0D]+"
# Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = "mix-1"


def text_quality(text):
    """Share of a text's characters that are no digits, signs or controls; 0.05 at least."""
    plain = F.length(F.regexp_replace(text, r"[\x00-\x1F!-@\[-`{-\x7F]", ""))
    return F.greatest(F.coalesce(F.try_divide(plain, F.length(text)), F.lit(0.0)), F.lit(0.05))


def water_level(sources, share=SHARE, repeats=REPEATS):
    """(group, source_size, target) of sources with (group, size, weight).

    Sources are sorted by the level at which they are full. If the first i are full, the others
    share what is left at one level; the true level is the highest of these.
    """
    sources = sources.withColumns({
        "cap": F.col("size") * repeats,
        "place": F.struct((F.col("size") * repeats / F.col("weight")).alias("full"), "group"),
    })
    caps = prefix_sums(sources, [], "place", "cap").withColumnsRenamed({"before": "cap_before", "group_total": "all"})
    level = stage(prefix_sums(caps, [], "place", "weight"))
    total = F.col("all") / repeats * share
    left = total - F.col("cap_before")
    level = level.withColumn("level", left / (F.col("group_total") - F.col("before")))
    highest = level.agg(F.max("level").alias("highest"))
    share_of = F.least(F.col("cap").cast("double"), F.col("weight") * highest.scalar())
    return level.select("group", F.col("size").alias("source_size"), share_of.alias("target"))


def source_weights(sizes, weights=WEIGHTS):
    """(group, size, weight): weights in turn over the sources in order."""
    ranked = prefix_sums(sizes.withColumn("one", F.lit(1)), [], "group", "one")
    turn = F.array(*[F.lit(w) for w in weights])
    return ranked.select("group", "size", F.get(turn, (F.col("before") % len(weights)).cast("int")).alias("weight"))


def keyed(docs, quality=None, seed=SEED):
    """(doc_id, group, size, key, row) of all documents: an exponential draw over the quality weight.

    ``quality`` is a column of positive weights; without one, ``text_quality`` of the text.
    """
    text = F.coalesce("text", F.lit(""))
    drawn = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2(text, 256))
    # 52 bits, and a half more, so that the draw is never 0 or 1.
    uniform = (F.conv(F.substring(F.sha2(drawn, 256), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    weight = text_quality(text) if quality is None else quality
    return docs.select(
        "doc_id",
        # Null last: code points order the sources, and a group key is never null.
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("group"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (-F.log(uniform) / weight).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def mix(docs, weights=WEIGHTS, share=SHARE, repeats=REPEATS, quality=None, seed=SEED):
    """One row per document: its size, its source's size and target, and the words the mix takes."""
    rows = stage(keyed(docs, quality, seed))
    sizes = rows.groupBy("group").agg(F.sum("size").alias("size"))
    targets = stage(water_level(source_weights(sizes, weights), share, repeats))
    ranked = prefix_sums(rows.withColumn("place", F.struct("key", "doc_id", "row")), ["group"], "place", "size")
    placed = lookup_join(ranked, targets, "group", "inner", staged=True)
    epochs = F.floor(F.try_divide("target", "source_size"))
    rest = F.col("target") - epochs * F.col("source_size")
    # Taken as long as its middle lies within the rest of the target.
    taken = F.when(F.col("before") + F.col("size") / 2 <= rest, 1).otherwise(0)
    return placed.select(
        "doc_id", "size", "source_size", "target",
        F.coalesce((epochs + taken) * F.col("size"), F.lit(0)).cast("long").alias("taken"),
    )
