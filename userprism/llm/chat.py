"""Chat formatting into budgeted windows, in SQL functions only.

A conversation's turns are cut into spans that start and end with a turn. Prefix sums of the
turns' tokens choose them: a span takes turns while their sum stays in the room that the budget
leaves beside the system turn and the history. Every window repeats the system turn, and, from
the second on, up to ``history`` turns before its span as far as they fit in a quarter of the
budget. Repeated turns carry no loss, so each assistant text is a target once. A turn that
alone exceeds the room is a span of its own; no text is ever cut.

Template: ``<s>[INST] role [/INST]\\n`` text ``</s>\\n``. Control strings inside a role or a
text get a backslash behind their first character, backslashes are doubled; both are undone
when a window is read.

Turns get their place and the tokens before them from running totals over range partitions, so a
conversation's texts are never gathered: choosing its spans takes one row with three numbers a
turn, and each window is a group of its own, of as many turns as the budget holds. Only
``digests`` meets a conversation whole, as its result asks for.

Defined results: null roles and texts are empty; turns are ordered by number (null first), then
role and a digest of the text; repeated rows are turns of their own. Rows with a null conv_id form
one conversation. No rows: no windows. Extra columns are not read.
"""

from pyspark.sql import functions as F

from ..operators.scale import prefix_sums, stage

BUDGET, HISTORY = 2048, 2

# Characters between the control string's first character and its rest.
CONTROL = r"([<\[])(/?s>|/?INST\])"
HEAD, MIDDLE, END = "<s>[INST] ", " [/INST]\n", "</s>\n"


def escaped(text):
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescaped(text):
    marks = F.regexp_replace(text, r"([<\[])\\(/?s>|/?INST\])", "$1$2")
    return F.replace(marks, F.lit("\\\\"), F.lit("\\"))


def tokens(text):
    """Estimated tokens of a formatted turn: one in four bytes."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


# A running total holds the number of turns above this and their tokens below.
_ONE = 1 << 40


def placed_turns(conversations):
    """Turns with their conversation's key, place and tokens before them."""
    rows = conversations.select(
        # A key that is never null.
        F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id")).alias("conv"),
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"head": F.concat(F.lit(HEAD), escaped(F.col("role")), F.lit(MIDDLE)), "body": escaped(F.col("text"))})
    rows = rows.withColumns({
        "size": tokens(F.concat("head", "body", F.lit(END))),
        "place": F.struct("turn", "role", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("row")),
    }).withColumn("amount", F.col("size") + _ONE)
    summed = prefix_sums(rows.drop("text", "turn"), ["conv"], "place", "amount")
    return summed.select(
        "conv", "role", "head", "body", "size",
        F.floor(F.col("before") / _ONE).cast("int").alias("i"), (F.col("before") % _ONE).alias("before"),
    )


def spans(turns, budget=BUDGET, history=HISTORY):
    """(conv, window, i, again): which turn stands in which window, and whether it is repeated there."""
    numbers = turns.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("i", "before", "size"))).alias("turns"),
        F.max(F.when((F.col("i") == 0) & (F.col("role") == "system"), F.col("size"))).alias("system"),
    ).withColumn("room", F.lit(budget - budget // 4) - F.coalesce("system", F.lit(0)))

    def step(done, t):
        recent = F.concat(done["recent"], F.array(t["size"]))
        recent = F.slice(recent, F.greatest(F.size(recent) - history + 1, F.lit(1)), F.lit(history))
        opens = (t["before"] + t["size"] - done["base"] > F.col("room")) & (t["i"] > done["first"])
        start = F.array(F.struct(t["i"].alias("first"), done["recent"].alias("recent")))
        return F.struct(
            F.when(opens, F.concat(done["starts"], start)).otherwise(done["starts"]).alias("starts"),
            F.when(opens, t["before"]).otherwise(done["base"]).alias("base"),
            F.when(opens, t["i"]).otherwise(done["first"]).alias("first"), recent.alias("recent"),
        )

    none = F.array().cast("array<bigint>")
    starts = F.aggregate(
        "turns",
        F.struct(
            F.array(F.struct(F.lit(0).alias("first"), none.alias("recent"))).alias("starts"),
            # The first span holds the system turn itself, whose tokens are set aside already.
            F.coalesce("system", F.lit(0).cast("long")).alias("base"), F.lit(0).alias("first"), none.alias("recent"),
        ),
        step, lambda done: done["starts"],
    )
    chosen = numbers.select("conv", "system", F.size("turns").alias("n"), starts.alias("starts")).select(
        "conv", "system", F.posexplode("starts").alias("window", "start"),
        F.concat(F.slice(F.col("starts.first"), 2, F.size("starts")), F.array("n")).alias("ends"),
    )
    first, kept = F.col("start.first"), F.when(F.col("system").isNotNull(), 1).otherwise(0)
    # The most turns before the span whose tokens fit; never the system turn.
    reach = F.greatest(F.lit(0), F.least(F.lit(history), first - kept))
    total = F.aggregate(
        F.slice("start.recent", F.size("start.recent") - F.col("k") + 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    fits = chosen.select("conv", "window", "ends", first.alias("first"), kept.alias("kept"), F.explode(F.sequence(F.lit(0), reach)).alias("k"), "start")
    fits = fits.filter((F.col("k") == 0) | (total <= budget // 4)).groupBy("conv", "window").agg(
        F.max("k").alias("again"), F.first("first").alias("first"), F.first("kept").alias("kept"),
        F.first(F.get("ends", F.col("window"))).alias("last"),
    )
    front = (F.col("first") > 0) & (F.col("kept") == 1)
    shown = F.concat(
        F.when(front, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
        F.sequence(F.col("first") - F.col("again"), F.col("last") - 1),
    )
    return fits.select("conv", "window", "first", F.explode(shown).alias("i")).select(
        "conv", "window", "i", (F.col("i") < F.col("first")).alias("again")
    )


def windows(conversations, budget=BUDGET, history=HISTORY):
    """One row per window: conv_id, window, text, ``repeated`` (turns it repeats), ``targets``.

    ``targets`` are the places under the loss mask, as (start, length) in characters of text.
    """
    turns = stage(placed_turns(conversations))
    shown = spans(turns, budget, history).join(turns.drop("before", "size"), ["conv", "i"])
    laid = shown.groupBy("conv", "window").agg(
        F.sort_array(F.collect_list(F.struct("i", "role", "head", "body"))).alias("shown"),
        F.count_if("again").cast("int").alias("repeated"),
    ).select(F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"), "window", "repeated", "shown")
    places = F.aggregate(
        "shown",
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda done, t: F.struct(
            (done["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).cast("int").alias("at"), (done["n"] + 1).alias("n"),
            F.when(
                (t["role"] == "assistant") & (done["n"] >= F.col("repeated")),
                F.concat(done["out"], F.array(F.struct(
                    (done["at"] + F.length(t["head"])).cast("int").alias("start"), F.length(t["body"]).cast("int").alias("length")
                ))),
            ).otherwise(done["out"]).alias("out"),
        ),
        lambda done: done["out"],
    )
    text = F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return laid.select("conv_id", "window", text.alias("text"), "repeated", places.alias("targets"))


def read_turns(text):
    """The (role, text) turns of a formatted window."""
    parts = F.split(text, END)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda part: F.struct(
        unescaped(F.substr(F.substring_index(part, MIDDLE, 1), F.lit(len(HEAD) + 1))).alias("role"),
        unescaped(F.substr(part, F.length(F.substring_index(part, MIDDLE, 1)) + len(MIDDLE) + 1)).alias("text"),
    ))


def digests(conversations, budget=BUDGET, history=HISTORY):
    """What the windows of each conversation hold, read back from them."""
    made = windows(conversations, budget, history)
    turns = read_turns(F.col("text"))
    new = F.slice("turns", F.col("repeated") + 1, F.size("turns") - F.col("repeated"))
    read = made.withColumn("turns", turns).select(
        "conv_id", "window", F.size(new).alias("n"), F.length("text").alias("chars"),
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(
            F.transform("targets", lambda p: unescaped(F.substr(F.col("text"), p["start"] + 1, p["length"]))), ""
        ).alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("all"),
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
    )
    said, loss = F.array_join(F.col("all.said"), ""), F.array_join(F.col("all.loss"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
