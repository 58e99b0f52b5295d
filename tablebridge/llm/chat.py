"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of the turns' tokens choose turn-aligned spans that fit the budget beside the retained system turn and a limited
repeated history. Repeated turns are never trained on: each assistant turn is under the loss mask in exactly one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 96
HISTORY_TURNS = 2
TARGET = "assistant"
SYSTEM = "system"


def escaped(text: Column) -> Column:
    r"""No `<` is left in the result: `\` becomes `\b` and `<` becomes `\l`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role_escaped(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def _role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def tokens(text: Column) -> Column:
    """A token count without a vocabulary: words, digits and other visible characters."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]")).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """Formatted windows of conversations (conv_id, turn, role, text).

    One row per window: conv_id, window, text, n_tokens, segments: array of (pos, start, length, fresh, loss), the place of
    each turn's escaped text in the window's text in code points; pos is the turn's place in its conversation, fresh marks turns that are new
    here and loss those under the mask. A window holds the system turn if the conversation begins with one, up to
    history_turns repeated turns of at most `history` tokens together, and new turns while all fit the budget, at least
    one: a turn is never cut. Turns are ordered by turn, role and text, nulls first; null roles and texts are empty; repeated
    rows are turns of their own. A conversation is one row until it is cut into windows. Other columns are ignored.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    own = F.struct("turn", role.alias("role"), text.alias("text"), (tokens(text) + 4).alias("n"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("turns"))
    rendered = F.transform(
        "turns",
        lambda t, i: F.struct(i.alias("pos"), t["n"].alias("n"), t["role"].alias("role"), F.concat(F.lit("<turn "), _role_escaped(t["role"]), F.lit(">\n")).alias("head"), escaped(t["text"]).alias("body")),
    )
    convs = convs.select("conv_id", rendered.alias("t"))
    leads = F.get("t", F.lit(0))["role"] == SYSTEM
    convs = convs.withColumn("lead", F.when(leads, F.get("t", F.lit(0))["n"]).otherwise(F.lit(0).cast("long")))

    def pack(acc: Column, turn: Column) -> Column:
        """Starts of the windows so far, the prefix sum at the last start, the prefix sum so far."""
        total = acc["total"] + turn["n"]
        room = F.when(F.size(acc["starts"]) == 1, F.lit(budget).cast("long")).otherwise(F.greatest(F.lit(budget - history) - F.col("lead"), F.lit(1)))
        cut = (F.size(acc["starts"]) == 0) | ((total - acc["base"] > room) & (acc["base"] < acc["total"]))
        starts = F.when(cut, F.concat(acc["starts"], F.array(turn["pos"]))).otherwise(acc["starts"])
        return F.struct(starts.alias("starts"), F.when(cut, acc["total"]).otherwise(acc["base"]).alias("base"), total.alias("total"))

    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("total"))
    convs = convs.withColumn("starts", F.aggregate("t", zero, pack, lambda acc: acc["starts"]))
    sizes = F.transform("t", lambda t: t["n"])
    convs = convs.withColumn("sizes", sizes)

    floor = F.when(F.col("lead") > 0, 1).otherwise(0)

    def back(start: Column) -> Column:
        """How many turns before start are repeated."""
        best = F.lit(0)
        for k in range(1, history_turns + 1):
            fits = (start - k >= floor) & (F.aggregate(F.slice("sizes", F.greatest(start - k, F.lit(0)) + 1, k), F.lit(0).cast("long"), lambda a, x: a + x) <= history)
            best = F.when(fits, k).otherwise(best)
        return best

    def window(start: Column, w: Column) -> Column:
        end = F.coalesce(F.get("starts", w + 1), F.size("t"))
        h = back(start)
        none = F.slice("t", 1, 0)
        system = F.when((F.col("lead") > 0) & (start > 0), F.slice("t", 1, 1)).otherwise(none)
        return F.struct(w.alias("window"), start.alias("start"), F.concat(system, F.slice("t", start - h + 1, h), F.slice("t", start + 1, end - start)).alias("parts"))

    rows = convs.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.window", "w.start", "w.parts")

    def place(acc: Column, p: Column) -> Column:
        fresh = p["pos"] >= F.col("start")
        at = acc["at"] + F.length(p["head"])
        segment = F.struct(p["pos"].alias("pos"), at.alias("start"), F.length(p["body"]).alias("length"), fresh.alias("fresh"), (fresh & (p["role"] == TARGET)).alias("loss"))
        return F.struct(F.concat(acc["segments"], F.array(segment)).alias("segments"), (at + F.length(p["body"]) + len("</turn>\n")).alias("at"))

    empty = F.struct(F.array().cast("array<struct<pos:int,start:int,length:int,fresh:boolean,loss:boolean>>").alias("segments"), F.lit(0).alias("at"))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("</turn>\n"))), "")
    return rows.select("conv_id", "window", whole.alias("text"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_tokens"), F.aggregate("parts", empty, place, lambda acc: acc["segments"]).alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, turns: array of (pos, role, text, target) parsed from the windows' text; target is the unescaped text under the mask, else null."""
    blocks = F.slice(F.split("text", "<turn "), F.lit(2), F.greatest(F.size("segments"), F.lit(1)))
    turn = lambda b, i: F.struct(
        F.get("segments", i)["pos"].alias("pos"),
        _role_unescaped(F.substring_index(b, ">\n", 1)).alias("role"),
        unescaped(F.substring_index(F.substring(b, F.length(F.substring_index(b, ">\n", 1)) + 3, F.length(b)), "</turn>", 1)).alias("text"),
        F.when(F.get("segments", i)["loss"], unescaped(F.substring("text", F.get("segments", i)["start"] + 1, F.get("segments", i)["length"]))).alias("target"),
        F.get("segments", i)["fresh"].alias("fresh"),
    )
    parsed = formatted.select("conv_id", "window", F.length("text").cast("long").alias("chars"), F.filter(F.transform(blocks, turn), lambda t: t["fresh"]).alias("turns"))
    both = F.array_sort(F.flatten(F.collect_list("turns")))
    return parsed.groupBy("conv_id").agg(both.alias("turns"), F.sum("chars").alias("formatted_chars"))
