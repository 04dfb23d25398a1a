"""Quotation linking: whom a message answers, and its text without the quotes.

Method: the lines of a message are parsed for their quote level (the leading ``>`` signs). Quoted
lines of one level next to each other are a passage; an attribution line right over a deeper quote goes with
it, at every level. Passages are normalised (lower case, white space as one blank) and hashed. A quoted passage is
joined to the earliest message of its conversation that holds it among its own passages: the whole own text, a
paragraph, or a line. A passage that no message holds as a whole is looked up paragraph by paragraph, which finds
text in other line breaks, and a paragraph that none holds line by line. A
message answers the original of most of the characters it quotes at its lowest linked level, the latest
one of equals. Threads follow the answers to their first message by pointer jumping; in the order of
conversation, thread and turn every answer comes after what it answers. All of it is DataFrame
functions.

Own passages are reduced to their earliest message before the join, so that the join gives one row for
each quoted passage or line, however often a conversation repeats itself.

Defined cases: null text is empty text. A message without conversation or turn is linked to none
and is its own thread. Repeated turns are all kept; what any of them says counts for the turn. A
quote that no earlier message holds links to none. A text without quotes is returned as it is.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelstate.llm.common import SPACE, saved, whole

MARK = r"^[ \t]*((?:>[ \t]*)+)"
ATTRIBUTION = r"(?i)^[ \t]*(?:on [^\n]* wrote|[^\n]* wrote|-+ *original message *-+)[ \t]*:?[ \t]*$"
#: Stands for lines of other levels while passages are cut; a blank in texts that hold it.
OTHER = "\x01"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: x != "")


def parsed(messages: DataFrame, text: str) -> DataFrame:
    """``messages`` with ``_lines``: quote level and body of each line, -1 for attributions."""
    plain = F.translate(whole(text), OTHER, " ")
    levels = F.transform(F.split(plain, "\n"), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, MARK, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(line, MARK, "").alias("body")))
    step = messages.withColumn("_raw", levels)
    following = F.col("_raw")
    marked = F.transform("_raw", lambda x, i: F.struct(
        F.when(x["body"].rlike(ATTRIBUTION)
               & (F.coalesce(F.get(following, i + 1)["level"], F.lit(0)) > x["level"]), F.lit(-1))
        .otherwise(x["level"]).alias("level"),
        x["body"].alias("body")))
    return step.withColumn("_lines", marked).drop("_raw")


def _passages(level: Column) -> Column:
    """Texts of the runs of lines of a level."""
    held = F.array_join(F.transform("_lines", lambda x: F.when(x["level"] == level, x["body"])
                                    .otherwise(F.lit(OTHER))), "\n")
    return F.filter(F.split(held, f"\n?{OTHER}\n?"), lambda t: F.trim(F.regexp_replace(t, SPACE, " ")) != "")


def without_quotes(text: str) -> Column:
    """The message's own lines; a text that quotes nothing is left alone."""
    own = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0),
                                   lambda x: x["body"]), "\n")
    own = F.regexp_replace(F.regexp_replace(own, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""),
                           "\n{3,}", "\n\n")
    return F.when(F.exists("_lines", lambda x: x["level"] > 0), own).otherwise(whole(text))


def originals(lines: DataFrame) -> DataFrame:
    """``_conv, _at, _said``: the earliest turn of a conversation with an own passage of that hash."""
    zero = F.lit(0)
    runs = _passages(zero)
    paragraphs = F.flatten(F.transform(runs, lambda t: F.split(t, r"\n[\x20\x09-\x0D]*\n")))
    each = F.flatten(F.transform(runs, lambda t: F.split(t, "\n")))
    held = F.concat(F.array(F.array_join(runs, "\n")), runs, paragraphs, each)
    held = F.array_distinct(_filled(F.transform(held, normalised)))
    said = lines.where(F.col("_conv").isNotNull() & F.col("_turn").isNotNull()).select(
        "_conv", "_turn", F.explode(held).alias("passage"))
    return said.groupBy(F.col("_conv").alias("_of"), F.xxhash64("passage").alias("_said")).agg(
        F.min("_turn").alias("_at"))


def quoted(lines: DataFrame) -> DataFrame:
    """A row for each quoted passage (``paragraph`` 0), each of its paragraphs (``part`` 0) and each line of these."""
    levels = F.array_distinct(F.filter(F.transform("_lines", lambda x: x["level"]), lambda x: x > 0))
    found = lines.where(F.exists("_lines", lambda x: x["level"] > 0)).select(
        "_conv", "_turn", "_lines", F.explode(levels).alias("level"))
    found = found.select("_conv", "_turn", "level",
                         F.posexplode(_passages(F.col("level"))).alias("no", "passage"))

    def piece(paragraph: Column, part: Column, text: Column) -> Column:
        return F.struct(paragraph.cast("int").alias("paragraph"), part.cast("int").alias("part"),
                        normalised(text).alias("text"))

    zero = F.lit(0)
    below = F.transform(F.split("passage", r"\n[\x20\x09-\x0D]*\n"), lambda text, at: F.concat(
        F.array(piece(at + 1, zero, text)),
        F.transform(F.split(text, "\n"), lambda line, no: piece(at + 1, no + 1, line))))
    pieces = F.concat(F.array(piece(zero, zero, F.col("passage"))), F.flatten(below))
    found = found.select("_conv", "_turn", "level", "no", F.inline(pieces))
    return found.where(F.col("text") != "").select(
        "_conv", "_turn", "level", "no", "paragraph", "part", F.length("text").alias("chars"),
        F.xxhash64("text").alias("_quoted"))


def links(lines: DataFrame) -> DataFrame:
    """``_conv, _turn, level, no, paragraph, part, chars, original``: quotes with the turn that they come from.

    Paragraphs count only where their passage is not found as a whole, lines where their paragraph is not.
    """
    said, quotes = originals(lines), quoted(lines).distinct()
    found = quotes.join(said, (quotes["_conv"] == said["_of"]) & (quotes["_quoted"] == said["_said"])
                        & (said["_at"] < quotes["_turn"]))
    found = found.withColumnRenamed("_at", "original").drop("_of", "_said", "_quoted")
    passage = ["_conv", "_turn", "level", "no"]
    as_whole = found.where("paragraph = 0")
    rest = found.where("paragraph > 0").join(as_whole.select(*passage).distinct(), passage, "left_anti")
    paragraphs = rest.where("part = 0")
    place = [*passage, "paragraph"]
    lines_only = rest.where("part > 0").join(paragraphs.select(*place).distinct(), place, "left_anti")
    return as_whole.unionByName(paragraphs).unionByName(lines_only)


def answers(found: DataFrame) -> DataFrame:
    """``_conv, _turn, reply_to, n_linked``: the one message that each quoting message answers."""
    votes = found.groupBy("_conv", "_turn", "level", "original").agg(
        F.sum("chars").alias("chars"), F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "chars", "original"))
    return votes.groupBy("_conv", "_turn").agg(
        best["original"].alias("reply_to"), F.sum("n").alias("n_linked"))


def threads(pairs: DataFrame) -> DataFrame:
    """``_conv, _turn, thread, depth`` of the answers: the first message, and the steps to it."""
    state = saved(pairs.select("_conv", "_turn", F.col("reply_to").alias("up"),
                               F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = state.select(F.col("_conv").alias("_of"), F.col("_turn").alias("_at"),
                             F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        joined = state.join(above, (state["_conv"] == above["_of"]) & (state["up"] == above["_at"]), "left")
        state = saved(joined.select(
            "_conv", "_turn", F.coalesce("_up", "up").alias("up"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.col("_up").isNotNull().alias("moved")), "threads")
        if state.where("moved").isEmpty():
            return state.select("_conv", "_turn", F.col("up").alias("thread"), "depth")
        state = state.drop("moved")


def linked(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message, in no order: its own text, whom it answers, its thread and depth."""
    named = messages.select(F.col(conversation).alias("_conv"), F.col(turn).alias("_turn"),
                            F.col(role).alias("_role"), F.col(text).alias("_text"))
    lines = parsed(named, "_text")
    pairs = saved(answers(links(lines)), "answers")
    above = threads(pairs)
    info = pairs.join(above, ["_conv", "_turn"]).select(
        F.col("_conv").alias("_of"), F.col("_turn").alias("_at"), "reply_to", "n_linked", "thread", "depth")
    level = F.transform("_lines", lambda x: x["level"])
    own = lines.select(
        "_conv", "_turn", "_role", without_quotes("_text").alias("_own"),
        F.greatest(F.array_max(level), F.lit(0)).cast("long").alias("max_level"),
        F.size(F.filter(level, lambda x: x > 0)).cast("long").alias("n_quoted_lines"))
    both = own.join(info, (own["_conv"] == info["_of"]) & (own["_turn"] == info["_at"]), "left")
    return both.select(
        F.col("_conv").alias(conversation), F.col("_turn").alias(turn), F.col("_role").alias(role),
        F.col("_own").alias("own_text"), "max_level", "n_quoted_lines",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to", F.coalesce("thread", "_turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def reply_ordered(found: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The rows of ``linked`` in reply order, over partitions that follow one another.

    A long conversation is spread over several partitions.
    """
    order = [conversation, "thread", turn]
    return found.repartitionByRange(*order).sortWithinPartitions(*order)
