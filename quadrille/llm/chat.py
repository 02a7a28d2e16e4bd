"""Chat formatting of reply trees, in DataFrame operations alone.

Messages form trees: each has a parent in its conversation or is a root. Iterative self-joins enumerate the paths from
root to leaf: a table of jumps (message to its ancestor 2**k replies up) is joined with itself, and each leaf's path
with that table, so the number of joins grows with the logarithm of the depth, and rows with the length of the paths.
A path's score is the mean score of its messages; paths of a conversation are ranked by it (ties: least leaf), and
each chosen path is formatted as one conversation.

Template: `<|turn|>role<|says|>text<|end|>` per message, nothing between. Inside roles and texts a backslash is put
before every backslash, and after the first character of every control string (the template's own and those of other
chat templates), so no text can hold one; taking one backslash away before each character behind it restores the
text. The loss mask is the list of (start, length) in code points of the escaped assistant texts.

Defined cases: null texts and roles are empty; a message whose parent isn't there is a root; a message that is its
own ancestor (a cycle) or answers, at any distance, such a message has no path; messages that share an id in a
conversation stand at one place (under the least of their parents), one after another if they differ, else once; a NaN
score is 0; null conversation ids form one conversation; an empty table gives no rows. A text of any length is one string
that JVM functions alone handle. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import discard, numbered, written

#: Parts in which the paths of one conversation are ranked before the best of them meet.
SALTS = 64
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Beginnings of control strings; each is broken after its first character.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, out)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, node, up) for every message `node` on the path of a leaf, `up` replies above it, of paths that end in a root.

    messages: (conv, node, parent), parent null for roots, one row a node. Jump tables are doubled until only messages on
    or below a cycle still have an ancestor that far up: their number no longer falls. Leaves among them have no root.
    """
    base = written(messages.select("conv", "node", "parent"), "tree")
    known = base.select(F.col("conv").alias("c"), F.col("node").alias("p"))
    edges = base.join(known, _same("conv", "c") & (F.col("parent") == F.col("p")))
    tables = [written(edges.select("conv", "node", F.col("parent").alias("above")), "jumps")]
    left = tables[0].count()
    while left:
        up = tables[-1].select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("above").alias("top"))
        tables.append(written(tables[-1].join(up, _same("conv", "c") & (F.col("above") == F.col("n"))).select("conv", "node", F.col("top").alias("above")), "jumps"))
        if (now := tables[-1].count()) == left:
            break
        left = now
    rootless = tables[-1].select(F.col("conv").alias("c"), F.col("node").alias("n"))  # empty without cycles
    inner = tables[0].select(F.col("conv").alias("c"), F.col("above").alias("n")).distinct()
    leaves = base.select("conv", "node").join(inner, _same("conv", "c") & (F.col("node") == F.col("n")), "left_anti")
    leaves = leaves.join(rootless, _same("conv", "c") & (F.col("node") == F.col("n")), "left_anti")
    have = written(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    for k, jumps in enumerate(tables):
        j = jumps.select(F.col("conv").alias("c"), F.col("node").alias("n"), "above")
        more = have.join(j, _same("conv", "c") & (F.col("node") == F.col("n"))).select("conv", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        have, before = written(have.union(more), "paths"), have
        discard(before)
        discard(jumps)
    discard(base)
    return have


def chains(turns: DataFrame) -> DataFrame:
    """Messages (conv, node, parent, role, text, score) of conversations given as (conv, turn, role, text): each row answers the one before (ties: by role and text)."""
    rows = numbered(turns.select("conv", "turn", "role", "text"), ["conv"], ["turn", "role", "text"], "node")
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Each path, or the `best` paths of each conversation: conv, leaf, rank, score, formatted, loss (array of struct<start, length>).

    messages: (conv, node, parent, role, text, score), any of them null but node.
    """
    score = F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = written(messages.select("conv", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), score.alias("score")).distinct(), "messages")
    on_path = paths(rows.groupBy("conv", "node").agg(F.min("parent").alias("parent")))
    said = rows.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text", "score")
    full = on_path.join(said, _same("conv", "c") & (F.col("node") == F.col("n")))
    scored = written(full.groupBy(F.col("conv").alias("cc"), F.col("leaf").alias("ll")).agg(F.avg("score").alias("mean")), "scored")
    if best is not None:
        # the best of each of SALTS parts of a conversation first, so that none is ranked in one task
        for by in (["cc", F.pmod(F.xxhash64("ll"), F.lit(SALTS))], ["cc"]):
            scored = scored.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean"), "ll"))).where(F.col("r") <= best).drop("r")
    ranked = numbered(scored.withColumn("worse", F.lit(0.0) - F.col("mean")), ["cc"], ["worse", "ll"], "rank").drop("worse")
    if best is not None:
        full = full.join(ranked.select("cc", "ll"), _same("conv", "cc") & (F.col("leaf") == F.col("ll")), "left_semi")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    cut = full.select("conv", "leaf", "up", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    along = Window.partitionBy("conv", "leaf").orderBy(F.desc("up"), "role", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lengths = F.char_length("head") + F.char_length("body") + len(END)
    placed = cut.withColumn("place", F.row_number().over(along)).withColumn("end", F.sum(lengths).over(along))
    whole = placed.groupBy("conv", "leaf").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END)).alias("t")))), lambda x: x["t"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct((F.col("end") - len(END) - F.char_length("body")).alias("start"), F.char_length("body").alias("length"))))).alias("loss"),
    )
    return whole.join(ranked, _same("conv", "cc") & (F.col("leaf") == F.col("ll"))).select("conv", "leaf", "rank", F.col("mean").alias("score"), "formatted", "loss")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(unescape(F.substring_index(x, SAYS, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x, SAYS, -1), END, 1)).alias("text")))


def under_mask(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the output: conv, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = read_back(F.col("formatted"))
    read = formatted.select("conv", "leaf", "formatted", turns.alias("turns"), under_mask(F.col("formatted"), F.col("loss")).alias("masked"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv", "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
