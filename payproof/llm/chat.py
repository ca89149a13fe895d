"""Chat formatting into windows of a token budget, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns. Each span becomes a window of its own: the system
turn, a limited number of tokens of the turns before it, and the span. Only assistant turns of the span are under the loss
mask, so every assistant text is a target once, however often it is repeated as history. No turn is cut or dropped: a turn
that does not fit the budget stands in a window of its own, marked over_budget.

The prefix sums are taken in blocks of turns and then over the blocks, so that one very long conversation is not one task.

A null text or role counts as an empty one. Turns are ordered by turn, then role, then text, nulls first; repeated rows
are turns of their own; a null conv_id is a conversation. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payproof.llm.tables import written

BUDGET = 1024
HISTORY = 192
BLOCK_TURNS = 256
TURN_TOKENS = 4
#: Block of turns without a number: before that of any other.
NULL_BLOCK = -(1 << 60)

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: What counts as a token before a tokenizer is chosen: runs of up to six letters, of up to three digits, single marks.
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"


def escaped(text: Column) -> Column:
    """Control strings of this and other templates get a backslash after their bracket; those that have some, one more."""
    return F.regexp_replace(text, r"([<\[])(\\*+)(\||/?s>|/?INST\])", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*+)(\||/?s>|/?INST\])", r"$1$2$3")


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escaped(role), F.lit(MESSAGE))
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.col("role").cast("string"),
        F.col("text").cast("string"),
    ).select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.concat(head, escaped(text), F.lit(END)).alias("piece"),
        F.length(head).alias("head"),
        F.length(escaped(text)).alias("body"),
        (F.regexp_count(text, F.lit(TOKEN)) + TURN_TOKENS).cast("long").alias("cost"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(NULL_BLOCK)).alias("block"),
    )


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its place, the tokens up to its end, its span and the system turn of its conversation."""
    first = F.min(F.struct("turn", "role", "text", "piece", "cost"))
    is_system = F.col("first.role") == "system"
    system = (
        turns.groupBy("conv_id")
        .agg(first.alias("first"))
        .select(
            F.col("conv_id").alias("s_conv"),
            F.when(is_system, F.col("first.piece")).alias("system"),
            F.when(is_system, F.col("first.cost")).otherwise(0).alias("system_cost"),
        )
    )
    stride = F.greatest(F.lit(64), F.floor((F.lit(budget - history) - F.col("system_cost")) / 2))
    of_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    so_far = of_block.rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        turns.join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")))
        .withColumn("stride", stride)
        .withColumn("long", (F.col("cost") > F.col("stride")).cast("long"))
        .withColumn("pos_in", F.row_number().over(of_block))
        .withColumn("end_in", F.sum("cost").over(so_far))
        .withColumn("long_in", F.sum("long").over(so_far))
    )
    before = Window.partitionBy("b_conv").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        inside.groupBy(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"))
        .agg(F.count("*").alias("n"), F.sum("cost").alias("t"), F.sum("long").alias("l"))
        .select(
            "b_conv", "b_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "t", "l"))
        )
    )
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block"))
    end = F.col("t_before") + F.col("end_in")
    return inside.join(blocks, same).select(
        "conv_id",
        "role",
        "piece",
        "head",
        "body",
        "cost",
        "system",
        "system_cost",
        (F.col("n_before") + F.col("pos_in")).alias("pos"),
        end.alias("end"),
        (end - F.col("cost")).alias("begin"),
        # A turn longer than the stride is a span by itself; the others lie between such turns, one span to a stride.
        F.struct(
            (F.col("l_before") + F.col("long_in")).alias("after"),
            (1 - F.col("long")).alias("rest"),
            F.when(F.col("long") == 1, 0).otherwise(F.floor((end - 1) / F.col("stride"))).alias("bucket"),
        ).alias("span"),
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each window: text, spans under the loss mask (code points), how many turns only repeat others."""
    # Written once: spans, new turns and history are taken from it, and would each place all turns again.
    placed = written(_placed(_turns(conversations), budget, history))
    spans = placed.groupBy("conv_id", "span").agg(
        F.min("pos").alias("first"),
        F.min("begin").alias("at"),
        F.first("system").alias("system"),
        F.first("system_cost").alias("system_cost"),
    )
    later = spans.where("first > 1")

    def member(kind: int, role: str, piece: str, cost: str, *, pos: str = "pos", head: str = "head", body: str = "body"):
        fields = {"pos": pos, "role": role, "piece": piece, "cost": cost, "head": head, "body": body}
        return F.struct(F.lit(kind).alias("kind"), *(F.expr(e).alias(k) for k, e in fields.items())).alias("m")

    new = placed.select("conv_id", "span", member(2, "role", "piece", "cost"))
    heads = later.where("system is not null").select(
        "conv_id",
        "span",
        member(0, "'system'", "system", "system_cost", pos="1L", head="0", body="0"),
    )
    # A turn is history of the spans that begin within so many tokens of its own beginning: at most two cells of that width.
    old = (
        placed.where((F.col("cost") <= history) & ~((F.col("pos") == 1) & F.col("system").isNotNull()))
        .select(F.col("conv_id").alias("h_conv"), "pos", "role", "piece", "cost", "head", "body", "begin", "end")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("end") / history), F.floor(F.col("begin") / history) + 1)))
    )
    near = (
        F.col("conv_id").eqNullSafe(F.col("h_conv"))
        & (F.floor(F.col("at") / history) == F.col("cell"))
        & (F.col("at") >= F.col("end"))
        & (F.col("at") <= F.col("begin") + history)
    )
    past = later.select("conv_id", "span", "at").join(old, near).select("conv_id", "span", member(1, "role", "piece", "cost"))
    members = new.unionAll(heads).unionAll(past)
    begin = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("all")),
        lambda acc, p: F.struct(
            (acc["n"] + F.length(p["piece"])).alias("n"), F.concat(acc["all"], F.array(acc["n"])).alias("all")
        ),
    )["all"]
    target = F.filter(
        F.transform(
            "parts",
            lambda p, i: F.struct(
                (F.col("begins")[i] + p["head"]).alias("start"),
                p["body"].alias("length"),
                ((p["kind"] == 2) & (p["role"] == "assistant")).alias("target"),
            ),
        ),
        lambda s: s["target"],
    )
    return (
        members.groupBy("conv_id", "span")
        .agg(F.sort_array(F.collect_list("m")).alias("parts"))
        .withColumn("begins", begin)
        .select(
            "conv_id",
            F.array_min(F.transform(F.filter("parts", lambda p: p["kind"] == 2), lambda p: p["pos"])).alias("first_turn"),
            F.size("parts").alias("n_turns"),
            F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("n_context"),
            F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["cost"]).alias("n_tokens"),
            F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"),
            F.transform(target, lambda s: F.struct(s["start"], s["length"])).alias("loss"),
        )
        .withColumn("over_budget", F.col("n_tokens") > budget)
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the targets of each conversation, taken from the formatted text and its mask alone."""
    pieces = F.split("text", r"<\|end\|>")
    own = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"<\|message\|>")
        role = F.substring(halves[0], len(START) + 1, 1 << 30)
        return F.concat(unescaped(role), F.lit("\n"), unescaped(halves[1]), F.lit("\n"))

    targets = F.transform("loss", lambda s: unescaped(F.substring("text", s["start"] + 1, s["length"])))
    windows_read = formatted.select(
        "conv_id",
        F.struct(
            "first_turn",
            F.size(own).cast("long").alias("n"),
            F.array_join(F.transform(own, turn), "").alias("turns"),
            F.array_join(targets, "").alias("targets"),
            F.length("text").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = F.sort_array(F.collect_list("w"))
    return (
        windows_read.groupBy("conv_id")
        .agg(whole.alias("w"))
        .select(
            "conv_id",
            F.aggregate("w.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_turns"),
            F.array_join("w.turns", "").alias("turns"),
            F.array_join("w.targets", "").alias("targets"),
            F.aggregate("w.chars", F.lit(0).cast("long"), lambda a, n: a + n).alias("formatted_chars"),
        )
    )
