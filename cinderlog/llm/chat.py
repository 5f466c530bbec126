"""Quotation linking in conversations, with DataFrame functions alone.

Lines that begin with > are quotes, as deep as they have >. Neighbouring lines of a depth
are a passage. Passages, their sentences and their lines are normalised (case, white space,
line breaks as well) and hashed, at every depth. A quoted line points to the latest earlier
message of its conversation that has its whole passage, else one of the sentences it
belongs to or the line itself: so re-wrapped quotes link as well as trimmed ones. A message
has its own words at depth 0 and what it quotes one level less deep than a reply to it
does. Lines of depth 1 point to own words. Deeper ones point to a message that has them a
level less deep, else to one whose own words they are. A message replies to the one to
which most of its quoted lines of the least depth that points anywhere do, the latest of
equals. A message without such a quote follows the one before it. A message that quotes another than the one before it starts a branch; in reply
order a branch's messages stand together, after those that went on where it left.

The latest earlier message is found by a window over (conversation, line), split in
stretches of turns whose last message is carried over, so no conversation or line is
gathered in one task and no pairs are made.

Cases: null text is an empty message; null roles stay; rows with a null conv_id or turn
are returned without links, as branches of their own; rows that repeat (conv_id, turn) are
one message each with its own text and share links found for that turn; quotes of lines
that no earlier message has are counted, dropped from the text and not linked; an empty
table gives an empty result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm._text import cut

#: Turns in a stretch of a conversation that one window sorts.
STRETCH = 512
#: Sorts a branch's own messages before the branches that leave it.
FIRST = -(2**62)
_QUOTE = r"^[ \t]*(?:>[ \t]?)+"


def lines_of(text: Column) -> Column:
    """array<struct<depth, line>> of a text: how many > begin a line, and what follows them."""
    return F.transform(
        F.split(text, "\r?\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 0), "[^>]", "")).alias("depth"), F.regexp_replace(x, _QUOTE, "").alias("line")),
    )


def normal(line: Column) -> Column:
    """A line's form for comparison: lower case, one space for white space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def passages(lines: Column) -> Column:
    """array<struct<depth, text>>: neighbouring lines of a depth joined."""
    empty = F.array().cast("array<struct<depth:int,text:string>>")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = F.coalesce(last["depth"] == x["depth"], F.lit(False))
        grown = F.struct(x["depth"].alias("depth"), F.when(same, F.concat(last["text"], F.lit("\n"), x["line"])).otherwise(x["line"]).alias("text"))
        return F.concat(F.when(same, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done), F.array(grown))

    return F.aggregate(lines, empty, add)


def keys_of(lines: Column) -> Column:
    """array<struct<depth, key, rank, n>> of a text's lines: digests of passages (rank 2), their sentences (1) and lines (0).

    n: quoted lines that the key stands for; a sentence's is its share of its passage's lines, a passage's all.
    Ranks are of what a key means to a reply; equal keys of any rank match.
    """
    digest = lambda x: F.unhex(F.sha2(x, 256))
    entry = lambda depth, text, passage, rank, n: F.struct(depth.alias("depth"), digest(text).alias("key"), passage.alias("passage"), F.lit(rank).alias("rank"), n.cast("double").alias("n"))

    def of_passage(p: Column, i: Column) -> Column:
        full = lambda xs: F.filter(F.transform(xs, normal), lambda x: x != "")
        parts, sentences = full(F.split(p["text"], "\n")), full(F.split(normal(p["text"]), r"(?<=[.!?])\s+"))
        whole = F.filter(F.array(normal(p["text"])), lambda x: x != "")
        return F.concat(
            F.transform(whole, lambda x: entry(p["depth"], x, i, 2, F.size(parts))),
            F.transform(sentences, lambda x: entry(p["depth"], x, i, 1, F.size(parts) / F.size(sentences))),
            F.transform(parts, lambda x: entry(p["depth"], x, i, 0, F.lit(1))),
        )

    return F.flatten(F.transform(passages(lines), of_passage))


def _latest_before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `before`: the largest turn under the row's own among rows of the keys with has_it.

    Stretches of STRETCH turns are sorted apart; what came before a stretch is carried over.
    """
    rows = rows.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    source = F.when(F.col("has_it"), F.col("turn"))
    within = Window.partitionBy(*keys, "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    lasts = rows.groupBy(*keys, "stretch").agg(F.max(source).alias("last"))
    upto = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "stretch", F.max("last").over(upto).alias("carried"))
    rows = rows.withColumn("inner_before", F.max(source).over(within)).join(carried, [*keys, "stretch"])
    return rows.withColumn("before", F.coalesce("inner_before", "carried")).drop("inner_before", "carried", "stretch")


def link(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own words), n_quoted_lines, n_linked_lines, max_depth, parent_turn, by_quote, branch_turn, reply_path."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), lines_of(F.coalesce("text", F.lit(""))).alias("lines")
    ).withColumn("lines", F.when((F.size("lines") == 1) & (F.col("lines")[0]["line"] == "") & (F.col("lines")[0]["depth"] == 0), F.slice("lines", 1, 0)).otherwise(F.col("lines")))
    quoted = F.filter("lines", lambda x: x["depth"] > 0)
    own = F.filter("lines", lambda x: x["depth"] == 0)
    messages = cut(
        rows.select(
            "conv_id", "turn", "role",
            F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit(" \t\r\n")).alias("text"),
            F.size(quoted).cast("long").alias("n_quoted_lines"),
            F.coalesce(F.array_max(F.transform("lines", lambda x: x["depth"])), F.lit(0)).alias("max_depth"),
            "lines",
        )
    )
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    # conversations without a quote need no keys
    keyed = known.join(known.where("max_depth > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    keyed = cut(keyed.select("conv_id", "turn", "max_depth", keys_of(F.col("lines")).alias("keys"), keys_of(own).alias("own")))
    said = keyed.select("conv_id", "turn", F.explode(F.concat("keys", "own")).alias("x")).select("conv_id", "turn", F.col("x.depth").alias("depth"), F.col("x.key").alias("line")).distinct()
    quotes = keyed.where("max_depth > 0").select("conv_id", "turn", F.explode(F.filter("keys", lambda x: x["depth"] > 0)).alias("x")).select("conv_id", "turn", "x.*").withColumnRenamed("key", "line")
    quotes = quotes.groupBy("conv_id", "turn", "depth", "passage", "rank", "line").agg(F.sum("n").alias("k"))
    # a quote is looked for a level less deep, and deeper ones among own words too
    asked = quotes.withColumn("at", F.explode(F.array_distinct(F.array(F.col("depth") - 1, F.lit(0))))).withColumn("has_it", F.lit(False))
    # lines that nobody quotes need no window
    wanted = asked.select("conv_id", "line", "at").distinct()
    spoken = said.withColumnRenamed("depth", "at").join(wanted, ["conv_id", "line", "at"], "left_semi").withColumn("has_it", F.lit(True))
    hits = _latest_before(spoken.unionByName(asked, allowMissingColumns=True), ["conv_id", "line", "at"]).where("NOT has_it AND before IS NOT NULL")
    # the passage's own key goes before its sentences', these before its lines', and a level less deep before own words
    best = hits.groupBy("conv_id", "turn", "depth", "passage", "rank", "line").agg(F.max_by(F.struct("before", "k"), "at").alias("x")).select("conv_id", "turn", "depth", "passage", "rank", "x.before", "x.k")
    ranked = best.groupBy("conv_id", "turn", "depth", "passage", "rank", "before").agg(F.sum("k").alias("k"))
    sums = ranked.groupBy("conv_id", "turn", "depth", "passage", "rank").agg(F.sum("k").alias("linked"), F.collect_list(F.struct("before", "k")).alias("to"))
    # a trimmed or re-wrapped passage: the key that links more of its lines
    chosen = sums.groupBy("conv_id", "turn", "depth", "passage").agg(F.max_by(F.struct("linked", "to"), F.struct((F.col("rank") == 2).alias("whole"), "linked", -F.col("rank"))).alias("x"))
    votes = chosen.select("conv_id", "turn", "depth", "x.linked", F.explode("x.to").alias("v")).groupBy("conv_id", "turn", "depth", F.col("v.before").alias("before")).agg(F.sum("v.k").alias("k"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max_by("before", F.struct(-F.col("depth"), "k", "before")).alias("quoted_turn"), F.ceil(F.round(F.sum("k"), 6)).cast("long").alias("n_linked_lines"))
    turns = known.select("conv_id", "turn").distinct().withColumn("has_it", F.lit(True))
    follows = _latest_before(turns, ["conv_id"]).select("conv_id", "turn", "before")
    linked = follows.join(parents, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("quoted_turn", "before").alias("parent_turn"), F.coalesce("n_linked_lines", F.lit(0).cast("long")).alias("n_linked_lines"), F.col("quoted_turn").isNotNull().alias("by_quote"),
        (F.coalesce(F.col("quoted_turn") != F.col("before"), F.lit(False)) | F.col("before").isNull()).alias("has_it"),
    )
    started = _latest_before(linked, ["conv_id"]).withColumn("branch_turn", F.when(F.col("has_it"), F.col("turn")).otherwise(F.col("before")))
    ordered = _paths(cut(started.drop("before")))
    return messages.join(ordered, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quoted_lines", F.coalesce("n_linked_lines", F.lit(0).cast("long")).alias("n_linked_lines"), "max_depth", "parent_turn",
        F.coalesce("by_quote", F.lit(False)).alias("by_quote"), F.coalesce("branch_turn", "turn").alias("branch_turn"), F.coalesce("reply_path", F.array(F.lit(FIRST), F.col("turn"))).alias("reply_path"),
    )


def _paths(linked: DataFrame) -> DataFrame:
    """Adds reply_path, which sorts a conversation's messages as a walk through its replies.

    A branch's path is its parent's, then minus the turn it left (later ones come first, as
    what follows on comes before what came back later), then its own first turn. Paths grow
    by pointer doubling, a step for each doubling of the deepest nesting of branches.
    """
    branch_of = linked.select("conv_id", F.col("turn").alias("left_turn"), F.col("branch_turn").alias("to"))
    starts = linked.where("has_it AND parent_turn IS NOT NULL").select("conv_id", F.col("turn").alias("branch_turn"), F.col("parent_turn").alias("left_turn"))
    empty = F.array().cast("array<bigint>")
    state = cut(
        linked.where("has_it").select("conv_id", "branch_turn").join(starts.join(branch_of, ["conv_id", "left_turn"]), ["conv_id", "branch_turn"], "left")
        .select("conv_id", "branch_turn", "to", F.when(F.col("to").isNull(), empty).otherwise(F.array(-F.col("left_turn"), F.col("branch_turn"))).alias("path"))
    )
    while not state.where("to IS NOT NULL").isEmpty():
        up = state.select("conv_id", F.col("branch_turn").alias("to"), F.col("to").alias("further"), F.col("path").alias("above"))
        state = cut(state.join(up, ["conv_id", "to"], "left").select("conv_id", "branch_turn", F.col("further").alias("to"), F.concat(F.coalesce("above", empty), "path").alias("path")))
    return linked.join(state.select("conv_id", "branch_turn", "path"), ["conv_id", "branch_turn"], "left").withColumn("reply_path", F.concat(F.coalesce("path", empty), F.array(F.lit(FIRST), F.col("turn")))).drop("path", "has_it")


def conversations_in_order(linked: DataFrame) -> DataFrame:
    """Messages in reply order, without quotes: by conversation and path. Sorting is by range, not in one task."""
    return linked.orderBy("conv_id", "reply_path")
