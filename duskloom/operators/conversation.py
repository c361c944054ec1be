"""Conversations as tables of turns: surfaces, lanes, deltas, turn counters, labels."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.checkpoint import saved

PREVIEW = 131_072
LABEL = 48


def surface_of(role: Column, wire: str = "messages") -> Column:
    """The surface a role's text is: two ways on the messages wire, four on the chat and responses wires."""
    if wire == "messages":
        return F.when(role == "assistant", "assistant_text").when(role == "system", "system_prompt").otherwise("user_message")
    return F.when(role == "assistant", "assistant_text").when(role.isin("system", "developer"), "system_prompt").when(role.isin("tool", "function"), "tool_result").otherwise("user_message")


def provenance(kind: Column, role: Column, text: Column) -> Column:
    """The lane of a surface: harness_meta, harness_frame, tool_io, assistant, userctx or user_input. It never gates detection."""
    start = F.ltrim(text)
    head = F.lower(F.substring(start, 18, 600))
    own = F.lit(False)
    for mark in ("claudemd", "claude.md", "memory.md", "# memory", "codebase and user instructions", "user's private global instructions"):  # fixed values
        own = own | head.contains(mark)
    frame = kind.isin("system", "instructions")
    reminder = start.startswith("<system-reminder>")
    return (
        F.when(frame & start.startswith("x-anthropic"), "harness_meta").when(frame, "harness_frame").when(kind.isin("tool_use", "tool_result"), "tool_io")
        .when(role == "system", "harness_frame").when(role == "assistant", "assistant").when(reminder & own, "userctx").when(reminder, "harness_frame")
        .when(start.startswith("<command-message>") | start.startswith("<command-name>"), "harness_frame").otherwise("user_input")
    )


def block_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def preview(text: Column, limit: int = PREVIEW, marker: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def labels(turns: DataFrame, key: str, turn: str, text: str, lane: str) -> DataFrame:
    """key, label: the first user text with white space collapsed, 48 characters of it at most; without one 'conversation <key>'."""
    own = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    first = turns.groupBy(key).agg(F.min(F.when((F.col(lane) == "user_input") & (own != ""), F.struct(F.col(turn).alias("n"), own.alias("t")))).alias("f"))
    cut = F.when(F.length("f.t") > LABEL, F.concat(F.substring("f.t", 1, LABEL), F.lit("…"))).otherwise(F.col("f.t"))
    return first.select(key, F.coalesce(cut, F.concat(F.lit("conversation "), F.col(key).cast("string"))).alias("label"))


def human_turns(turns: DataFrame, key: str, order: list[str], inputs: str) -> DataFrame:
    """turns with human_turn: it rises where there are more user inputs than on the turn before."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.col(inputs) > F.coalesce(F.lag(inputs).over(w), F.lit(0))
    marked = turns.withColumn("_new", new.cast("int"))
    return marked.withColumn("human_turn", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def turn_deltas(surfaces: DataFrame, key: str, turn: str, value: str) -> DataFrame:
    """key, turn, n_added, flag: how many distinct hashes of a turn the turn before doesn't have. flag: first, or prev_unavailable where a gap
    lies before, else null. surfaces: a row for each hash; one shuffle by key and turn for both sides."""
    turns = surfaces.groupBy(key, turn).agg(F.collect_set(value).alias("now"))
    w = Window.partitionBy(key).orderBy(turn)
    seen = turns.withColumns({"before": F.lag("now").over(w), "last": F.lag(turn).over(w), "k": F.row_number().over(w)})
    gap = F.col("last").isNotNull() & (F.col("last") + 1 != F.col(turn))
    flag = F.when(F.col("k") == 1, "first").when(gap, "prev_unavailable")
    added = F.when(flag.isNull(), F.size(F.array_except("now", "before"))).otherwise(F.size("now"))
    return seen.select(key, turn, added.cast("long").alias("n_added"), flag.alias("flag"))


#: How many hashes of a turn an earlier one may lack in the first round of predecessors, and by what that grows from round to round.
SLACK, GROWTH = 1, 8


def predecessors(surfaces: DataFrame, key: str, turn: str, value: str) -> DataFrame:
    """key, turn, previous, overlap: the earlier turn of the conversation that shares the most hashes, the latest of equals.

    A turn that lacks at most slack of another's n hashes has one of that one's slack + 1 rarest. So a round looks up these alone,
    counts the overlap of the turns they lead to exactly, and settles every turn whose best one shares n - slack or more; what is left goes on with a larger slack.
    A transcript that grows finds its last turn in the first round, by two hashes a turn, however many hashes all turns share.
    """
    own = surfaces.select(key, turn, value).distinct()
    often = own.groupBy(key, value).agg(F.count("*").alias("often"))
    by = Window.partitionBy(key, turn)
    ranked = saved(own.join(often, [key, value]).withColumns({"rank": F.row_number().over(by.orderBy("often", value)), "n": F.count("*").over(by)}))
    sets = saved(own.groupBy(key, turn).agg(F.collect_set(value).alias("set")))
    theirs = ranked.filter("often > 1").select(key, F.col(turn).alias("previous"), value)
    their_sets = sets.select(key, F.col(turn).alias("previous"), F.col("set").alias("their"))
    left, found, slack = ranked, None, SLACK
    while True:
        asked = left.filter((F.col("rank") <= slack + 1) & (F.col("often") > 1)).select(key, turn, value, "n")
        met = asked.join(theirs, [key, value]).filter(F.col("previous") < F.col(turn)).select(key, turn, "n", "previous").distinct()
        counted = met.join(sets, [key, turn]).join(their_sets, [key, "previous"]).select(key, turn, "n", "previous", F.size(F.array_intersect("set", "their")).cast("long").alias("overlap"))
        best = counted.groupBy(key, turn).agg(F.max(F.struct("overlap", "previous")).alias("b"), F.first("n").alias("n"))
        sure = saved(best.filter(F.col("b.overlap") >= F.col("n") - slack).select(key, turn, "b.previous", "b.overlap"))
        found = sure if found is None else found.union(sure)
        left = saved(left.filter(F.col("n") > slack + 1).join(sure.select(key, turn), [key, turn], "left_anti"))
        if left.isEmpty():
            return found
        slack *= GROWTH


def bounded_id(value: Column) -> Column:
    """An id of at most 128 bytes without control characters; another becomes a hash, an empty one 'unknown'."""
    odd = (F.octet_length(value) > 128) | value.rlike("[\\x00-\\x1F\\x7F]")
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", "unknown").when(odd, F.concat(F.lit("h-"), T.short_hash(value, digits=16))).otherwise(F.trim(value))


def prefix_chain(blocks: Column) -> Column:
    """A hash for every prefix of an array of block hashes, the shortest first: each made of the one before and a block, so that work grows with the length."""
    step = lambda s, x: F.struct(F.substring(F.sha2(F.concat(s["last"], F.lit("|"), x), 256), 1, 32).alias("last"), F.array_append(s["all"], s["last"]).alias("all"))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))
    return F.aggregate(blocks, start, step, lambda s: F.slice(F.array_append(s["all"], s["last"]), F.lit(2), F.size(blocks)))


def content_conversations(requests: DataFrame, key: str, order: str, blocks: str, known: DataFrame | None = None) -> DataFrame:
    """key, conversation: the conversation of each request without an id of its own, by what it repeats.

    requests: blocks, an array of hashes, the whole transcript; order says who comes first, ties go by key. known (conversation, blocks): where conversations
    stood before. In order, a request joins the conversation that stands at the longest prefix of its blocks, of equals the one with the smallest id, and moves
    it to its own end; with none it starts 'auto-<first block>', or with a digest of all blocks behind where that name is in use, wherever the one of that name
    stood. Requests with no or null blocks get none (null).

    A conversation stands only where some request or known one ends. So requests are dealt by their shortest prefix that is such an end, and the deals don't
    touch each other but for the first name, which goes to the first request of a head. A deal is read in order as a stream by one task, which holds a
    hash and a name for each conversation of it: order decides inside a deal, so one doesn't come apart.
    """
    rows = requests.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(blocks).alias("blocks"), F.lit(None).cast("string").alias("name"))
    if known is not None:
        rows = rows.union(known.select(F.lit(None).cast(requests.schema[key].dataType), F.lit(None).cast(requests.schema[order].dataType), "blocks", F.col("conversation").cast("string")))
    used = F.col("blocks").isNotNull() & (F.size("blocks") > 0) & ~F.exists("blocks", lambda b: b.isNull())
    full = saved(rows.filter(used).withColumn("chain", prefix_chain(F.col("blocks"))).withColumns({"here": F.element_at("chain", -1), "head": F.col("blocks")[0], "digest": F.substring(F.sha2(F.array_join("blocks", "|"), 256), 1, 8), "uid": F.expr("uuid()")}).drop("blocks"))
    ends = full.select(F.col("here").alias("end")).distinct()
    met = full.select("uid", F.posexplode("chain").alias("n", "end")).join(ends, "end").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "end"))).alias("m"))
    base = F.concat(F.lit("auto-"), "head")
    first = full.groupBy("head").agg(F.min(F.when(F.col("name").isNull(), F.struct("at", "key", "uid"))).alias("f"), F.max((F.col("name") == base).cast("int")).alias("taken"))
    dealt = full.join(met, "uid").join(first, "head")
    ready = dealt.select("key", "at", "name", "here", base.alias("base"), "digest", ((F.col("f.uid") == F.col("uid")) & (F.coalesce("taken", F.lit(0)) == 0)).alias("first"), F.transform("m", lambda x: x["end"]).alias("ends"), F.col("m")[0]["end"].alias("deal"))
    sorted_deals = ready.repartition("deal").sortWithinPartitions("deal", F.col("name").isNull(), "name", "at", "key")
    found = sorted_deals.mapInPandas(_joined, f"key {requests.schema[key].dataType.simpleString()}, conversation string")
    return requests.select(F.col(key).alias("key")).distinct().join(found, "key", "left").select(F.col("key").alias(key), "conversation")


def _joined(batches):
    """Rows of deals in order, each with the conversation it joins or starts; at: where conversations stand, by the end of their last request."""
    deal, at, where = None, {}, {}
    for batch in batches:
        keys, names = [], []
        for row in batch.itertuples(index=False):
            if row.deal != deal:
                deal, at, where = row.deal, {}, {}
            if row.name is not None:
                bisect.insort(at.setdefault(row.here, []), row.name)
                where[row.name] = row.here
                continue
            place = next((e for e in reversed(row.ends) if at.get(e)), None)
            if place is None:
                name = row.base if row.first else f"{row.base}-{row.digest}"
                place = where.get(name)
            else:
                name = at[place][0]
            if place != row.here:
                if place is not None:
                    at[place].remove(name)
                bisect.insort(at.setdefault(row.here, []), name)
                where[name] = row.here
            keys.append(row.key)
            names.append(name)
        yield pd.DataFrame({"key": pd.Series(keys, dtype=batch["key"].dtype), "conversation": pd.Series(names, dtype=object)})
