"""Sources mixed to target weights that change in the course of training.

Method: every source has a schedule, a weight at some instants between 0 and 1 and linear between them.
The integral of a schedule is the source's weight, which gives its target: the words that the mix takes from
it. A source's documents, in the order of a hash, are laid end to end, again and again where the target is larger
than the source; the words before a document are its demand, and the instant at which the schedule's integral has
grown to that demand is the document's position. Documents are range-sorted by position.

Targets share all words by weight. None is above ``MOST`` times its source's size: the excess is shared out
anew by weight, one aggregate over the sources for each round, until no target is above. The document at which
a target ends is taken up to the word that fulfils it, so that the taken words of a source are its target, rounded.

The sums before a document come from slices of the hash's range: words are summed by source and slice, slices are
added up by source, and inside a slice, which has about ``SLICE`` rows of all sources, documents by document.
No source is ever in one task. Only the rank among the sources, the sums and a document's slim row are shuffled.

Defined cases: a NULL text has 0 words. A document without words is never taken and has no position. NULL is a
source of its own, the last. A NULL id is an id like others. Repeated rows (id, source and text) are counted before
they are shuffled; each is a document of its own, one laid after the other, and gets its own share.
Without documents there is no result.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelstate.llm.common import same, saved, whole

Schedule = Sequence[tuple[float, float]]
#: Schedules of the sources by rank, in turn: one stays at its weight of 1, one falls around 2, one rises late, around 3.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 3.0), (1.0, 1.0)),
    ((0.0, 2.0), (0.5, 2.0), (1.0, 6.0)),
)
#: How often a source is taken at most.
MOST = 3
#: Rows of a slice, about.
SLICE = 50_000
#: Repeated rows that one row stands for while they are dealt out.
RUN = 1_000

WORD = r"[^\x20\x09-\x0D]+"


def legs(knots: Column) -> Column:
    """A schedule's pieces between its instants: start, weight there, slope, and the integral before."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(knots) - 2), lambda i: F.struct(
        F.get(knots, i).alias("a"), F.get(knots, i + 1).alias("b")))
    start = F.struct(F.lit(0.0).alias("total"), F.expr(
        "cast(array() as array<struct<at double, weight double, slope double, before double>>)").alias("legs"))

    def step(done: Column, pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        wide = b["at"] - a["at"]
        leg = F.struct(a["at"].alias("at"), a["weight"].alias("weight"),
                       ((b["weight"] - a["weight"]) / wide).alias("slope"), done["total"].alias("before"))
        return F.struct((done["total"] + (a["weight"] + b["weight"]) * wide / 2).alias("total"),
                        F.concat(done["legs"], F.array(leg)).alias("legs"))

    return F.aggregate(F.filter(pairs, lambda p: p["b"]["at"] > p["a"]["at"]), start, step)


def instant(pieces: Column, demand: Column) -> Column:
    """Where the integral of the schedule reaches ``demand``."""
    leg = F.try_element_at(F.filter(pieces, lambda x: x["before"] <= demand), F.lit(-1))
    rest, weight = demand - leg["before"], leg["weight"]
    inside = 2 * rest / (weight + F.sqrt(weight * weight + 2 * leg["slope"] * rest))
    return leg["at"] + F.when(rest > 0, inside).otherwise(F.lit(0.0))


def _order(key: str, text: str) -> Column:
    """What the documents of a source are ordered by."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), whole(text)))


def laid_out(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """A slim row for each distinct document: its words, its place in the order, and how often it is there."""
    rows = docs.select(
        F.col(key).alias("_id"), F.col(source).alias("_source"), _order(key, text).alias("_order"),
        F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("_size"),
    )
    return rows.groupBy("_id", "_source", "_order", "_size").agg(F.count(F.lit(1)).alias("_copies"))


def by_rank(sources: DataFrame) -> DataFrame:
    """``sources`` with ``_rank`` from 0, in the order of code points, NULL last; no task has them all."""
    ranged = sources.repartitionByRange(F.col("_source").asc_nulls_last())
    parts = saved(ranged.withColumn("_part", F.spark_partition_id()), "sources")
    sums = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_many")).select(
        F.col("_part").alias("_same"),
        F.coalesce(F.sum("_many").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(F.col("_source").asc_nulls_last()))
    numbered = parts.withColumn("_inside", inside - 1)
    return numbered.join(sums, numbered["_part"] == sums["_same"]).withColumn(
        "_rank", F.col("_before") + F.col("_inside")).drop("_part", "_same", "_before", "_inside")


def with_schedules(sources: DataFrame, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """``sources`` with ``_knots``: the schedules in turn, by rank."""
    every = F.array(*[F.array(*[F.struct(F.lit(float(at)).alias("at"), F.lit(float(weight)).alias("weight"))
                                for at, weight in schedule]) for schedule in schedules])
    turn = (F.col("_rank") % len(schedules)).cast("int")
    return by_rank(sources).withColumn("_knots", F.get(every, turn)).drop("_rank")


def with_targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """``sources`` (``_total``, ``_weight``) with ``_target``: all words by weight, none above ``most`` times its size."""
    sources = saved(sources, "targets")
    limit, weight = F.lit(float(most)) * F.col("_total"), F.col("_weight")
    share, capped = None, 0
    while True:
        over = F.lit(False) if share is None else share > limit
        total, fixed, left, now = sources.agg(
            F.sum(F.col("_total").cast("double")), F.sum(F.when(over, limit).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(weight)), F.sum(F.when(over, 1).otherwise(0)),
        ).first()
        if share is not None and now == capped:
            break
        if not left:  # nothing that could take more
            share = F.when(weight > 0, limit).otherwise(0.0)
            break
        share, capped = weight * F.lit(total - fixed) / F.lit(left), now
    return sources.withColumn("_target", F.least(share, limit))


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           schedules: Sequence[Schedule] = SCHEDULES, most: float = MOST) -> DataFrame:
    """One row for each document, in the order of training.

    ``size``, the source's ``source_size`` and ``target``, the words ``taken`` with repeats, the ``positions`` at which the
    document comes, one for each time, and the first of them as ``position``.
    """
    rows = saved(laid_out(docs, key, text, source), "laid-out")
    slices = max(1, -(-rows.count() // SLICE))
    # the source as a key that is never NULL
    rows = rows.withColumn("_of", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")))
    high = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_slice", F.shiftright(high * slices, 32))
    words = F.col("_size") * F.col("_copies")
    sums = saved(rows.groupBy("_of", "_source", "_slice").agg(F.sum(words).alias("_words")), "slices")
    totals = sums.groupBy("_of", "_source").agg(F.sum("_words").alias("_total"))
    found = with_schedules(totals, schedules).withColumn("_plan", legs(F.col("_knots")))
    found = found.select("_of", "_total", F.col("_plan.legs").alias("_legs"), F.col("_plan.total").alias("_weight"))
    targets = with_targets(found, most)
    earlier = W.partitionBy("_of").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_of", "_slice", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"))
    starts = starts.join(targets, "_of")
    inside = W.partitionBy("_of", "_slice").orderBy("_order", "_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    rows = rows.join(starts, ["_of", "_slice"]).withColumn("_start", F.col("_start") + F.col("_inside"))
    return _taken(_one_by_one(rows), key, most)


def _one_by_one(rows: DataFrame) -> DataFrame:
    """A row for each repeated row, every one after the copy before it; large groups are dealt out first."""
    runs = F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {RUN}"))
    dealt = rows.withColumn("_run", F.explode(runs)).repartition("_order", "_run")
    first = F.col("_run") * RUN
    copies = F.sequence(first, F.least(first + RUN, F.col("_copies")) - 1)
    return dealt.withColumn("_copy", F.explode(copies)).withColumn(
        "_start", F.col("_start") + F.col("_copy") * F.col("_size"))


def _taken(rows: DataFrame, key: str, most: float) -> DataFrame:
    wanted = F.floor(F.col("_target") + 0.5)
    rounds = F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))
    starts = F.transform(rounds, lambda again: again * F.col("_total") + F.col("_start"))
    starts = F.filter(starts, lambda at: (at < wanted) & (F.col("_size") > 0))
    step = rows.withColumns({"_wanted": wanted, "_starts": starts})
    taken = F.aggregate("_starts", F.lit(0).cast("long"), lambda sum, at: sum + F.least(
        F.col("_size"), F.col("_wanted") - at))
    places = F.transform("_starts", lambda at: instant(F.col("_legs"), F.col("_weight") * at / F.col("_wanted")))
    step = step.withColumns({"_taken": taken, "_places": places})
    return step.select(
        F.col("_id").alias(key), F.col("_size").alias("size"), F.col("_total").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"),
        F.get("_places", F.lit(0)).alias("position"), F.col("_places").alias("positions"),
        F.col("_order").alias("order"), F.col("_source").alias("source"),
    ).orderBy(F.col("position").asc_nulls_last(), "order")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          schedules: Sequence[Schedule] = SCHEDULES, most: float = MOST) -> DataFrame:
    """The training order itself: ``key, source, text, position``, a row for each time that a document is taken.

    Texts come whole, also the one at which a source's target ends.
    """
    places = placed(docs, key, text, source, schedules, most)
    times = places.select(F.col(key).alias("_id"), F.col("source").alias("_source"), F.col("order").alias("_at"),
                          F.explode("positions").alias("position"))
    texts = docs.select(F.col(key).alias("_key"), F.col(source).alias("_from"), F.col(text).alias("_text"),
                        _order(key, text).alias("_order")).dropDuplicates(["_key", "_from", "_order"])
    found = times.join(texts, (times["_at"] == texts["_order"])
                       & same(times, texts, {"_id": "_key", "_source": "_from"}))
    return found.orderBy("position", "_order").select(
        F.col("_key").alias(key), F.col("_from").alias(source), F.col("_text").alias(text), "position")
