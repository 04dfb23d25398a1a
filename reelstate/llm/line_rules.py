"""Quality rules on lines that many documents of one host share.

Method: every line is normalised (lower case, white space as one blank) and hashed; for each host
and line the distinct texts that hold it are counted, and a line above the host's limit is
boilerplate. Boilerplate lines are removed from all documents but the first that has them, and a
document of which too little is left is rejected. All of it is DataFrame functions.

Copies of one text count once, so that a document is not called boilerplate for being copied. The
limit is a number of distinct texts that does not grow with the host. A ``share`` of the host's distinct texts
may raise it.

Defined cases: null text has no words and fails the base rule. A null host is a host of its own. A
null ``doc_id`` sorts first. Repeated rows get the same verdict each.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelstate.llm.common import SPACE, packed, same, unpacked, whole

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate in more documents of a host than both of these allow; the share is off.
LEAST_DOCUMENTS = 10
DOCUMENT_SHARE = 0.0
#: A document is depleted if fewer than this share of its words is left.
LEAST_LEFT = 0.2

_KEY = {"_id": "_id", "_host": "_host", "_hash": "_hash"}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def base_columns(df: DataFrame, text: str, carried: list[str]) -> DataFrame:
    """``carried`` columns and the base counts ``_n_words`` ... ``_base_failed`` of each row."""
    n = F.col("_n_words")
    step = df.select(*carried, whole(text).alias("_text"))
    step = step.select(
        *carried,
        words_of(F.col("_text")).alias("_words"),
        lines_of(F.col("_text")).alias("_lines"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).alias("_word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).alias("_n_symbols"),
    )
    counts = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines"]
    step = step.select(
        *carried,
        F.size("_words").alias("_n_words"),
        "_word_chars",
        "_n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_n_dup_lines"),
        F.when(
            F.size("_words") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_words") - WINDOW + 1),
                        lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
        ).alias("_windows"),
    )
    step = step.select(
        *carried, *counts,
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows",
                                     lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    last = F.size("_sorted") - 1

    def twice(x, i):
        before = (i > 0) & (F.get("_sorted", i - 1)["h"] == x["h"])
        return before | ((i < last) & (F.get("_sorted", i + 1)["h"] == x["h"]))

    step = step.select(
        *carried, *counts,
        F.sort_array(F.transform(F.filter("_sorted", twice), lambda x: x["i"])).alias("_places"),
    )
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"),
            (p + WINDOW).alias("end"),
        ),
    )["n"]
    step = step.select(*carried, *counts, F.coalesce(covered, F.lit(0)).alias("_n_repeat_words"))
    failed = (n < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED * n)
    return step.withColumn("_base_failed", failed)


def keyed(docs: DataFrame, key: str, text: str, host: str) -> list[Column]:
    """What names a row: repeated rows share it."""
    return [docs[key].alias("_id"), docs[host].alias("_host"),
            F.xxhash64(whole(docs[text])).alias("_hash")]


def frequent_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   host: str = "source", least: int = LEAST_DOCUMENTS,
                   share: float = DOCUMENT_SHARE) -> DataFrame:
    """Lines above their host's limit: ``_host, _line, n_docs, first`` with the row that keeps it."""
    lines = line_rows(docs, key, text, host).groupBy("_host", "_line").agg(
        F.count_distinct("_hash").alias("n_docs"),
        F.min(F.struct("_id", "_hash")).alias("first"),
    )
    lines = lines.where(F.col("n_docs") > least)
    if not share:
        return lines
    texts = docs.select(*keyed(docs, key, text, host))
    limits = texts.groupBy("_host").agg(F.count_distinct("_hash").alias("n")).select(
        F.col("_host").alias("_of"), F.greatest(F.lit(float(least)), share * F.col("n")).alias("most"))
    return lines.join(limits, same(lines, limits, {"_host": "_of"})).where(
        F.col("n_docs") > F.col("most")).select("_host", "_line", "n_docs", "first")


def line_rows(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """A slim row for each line: its row's name, place, hash and number of words."""
    rows = docs.select(*keyed(docs, key, text, host),
                       F.posexplode(F.split(whole(text), "\n")).alias("_pos", "_text"))
    rows = rows.where(F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    normal = F.lower(F.trim(F.regexp_replace("_text", SPACE, " ")))
    return rows.select("_id", "_host", "_hash", "_pos", F.xxhash64(normal).alias("_line"),
                       F.size(words_of(F.col("_text"))).alias("_n"))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                  least: int = LEAST_DOCUMENTS, share: float = DOCUMENT_SHARE) -> DataFrame:
    """One row for each named row that loses lines: their places, and how many words they hold."""
    rows = line_rows(docs, key, text, host)
    often = frequent_lines(docs, key, text, host, least, share).select(
        F.col("_host").alias("_of"), F.col("_line").alias("_often"), "first")
    hits = rows.join(often, rows["_host"].eqNullSafe(often["_of"])
                     & (rows["_line"] == often["_often"]))
    hits = hits.where(~F.struct("_id", "_hash").eqNullSafe(F.col("first")))
    found = hits.groupBy("_id", "_host", "_hash").agg(
        F.collect_set(F.struct("_pos", "_n")).alias("_gone"))
    return found.select(
        F.col("_id").alias("_rid"), F.col("_host").alias("_rhost"), F.col("_hash").alias("_rhash"),
        F.transform("_gone", lambda x: x["_pos"]).alias("_removed"),
        F.aggregate("_gone", F.lit(0), lambda a, x: a + x["_n"]).alias("_n_removed"),
    )


_JOINED = {"_id": "_rid", "_host": "_rhost", "_hash": "_rhash"}


def _depleted(least_left: float) -> Column:
    left = F.col("_n_words") - F.coalesce("_n_removed", F.lit(0))
    return left < least_left * F.col("_n_words")


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
             least: int = LEAST_DOCUMENTS, share: float = DOCUMENT_SHARE,
             least_left: float = LEAST_LEFT) -> DataFrame:
    """One row for each document: the base counts, the words removed, and whether it is kept."""
    named = docs.select(*keyed(docs, key, text, host), F.col(text).alias("_whole"))
    base = base_columns(named, "_whole", ["_id", "_host", "_hash"])
    gone = removed_lines(docs, key, text, host, least, share)
    both = base.join(gone, same(base, gone, _JOINED), "left")
    long = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return both.select(
        F.col("_id").alias(key),
        *[F.col(f"_{name}").cast("long").alias(name) for name in long],
        F.col("_base_failed").alias("base_failed"),
        F.coalesce("_n_removed", F.lit(0)).cast("long").alias("n_removed_words"),
        (~F.col("_base_failed") & ~_depleted(least_left)).alias("kept"),
    )


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
            least: int = LEAST_DOCUMENTS, share: float = DOCUMENT_SHARE,
            least_left: float = LEAST_LEFT) -> DataFrame:
    """The kept documents, all their columns, without their boilerplate lines.

    A column ``n_chars``, where there is one, is counted anew for texts that lose lines.
    """
    held = docs.select(*keyed(docs, key, text, host), F.col(text).alias("_whole"),
                       packed(docs).alias("_row"))
    base = base_columns(held, "_whole", ["_id", "_host", "_hash", "_row"])
    base = base.select("_id", "_host", "_hash", "_row", "_n_words", "_base_failed")
    gone = removed_lines(docs, key, text, host, least, share)
    # one condition on both sides: a condition on the counts alone would be pushed below the
    # projections that make them, which repeats their expressions many times over
    kept = F.when(F.col("_base_failed"), F.lit(False)).otherwise(~_depleted(least_left))
    both = base.join(gone, same(base, gone, _JOINED), "left").where(kept)
    row = F.col("_row")
    left = F.array_join(F.filter(F.split(row[text], "\n"),
                                 lambda _, i: ~F.array_contains("_removed", i)), "\n")
    new = F.when(F.col("_removed").isNull(), row[text]).otherwise(left)
    replaced = {text: new}
    if "n_chars" in docs.columns and text != "n_chars":
        kind = docs.schema["n_chars"].dataType
        replaced["n_chars"] = F.when(F.col("_removed").isNull(), row["n_chars"]).otherwise(
            F.length(left).cast(kind))
    return unpacked(both, "_row", docs.columns, **replaced)
