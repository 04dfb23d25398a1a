"""Importance resampling: documents drawn by how much more a target's n-gram model likes them.

Method: words, runs of punctuation marks, and pairs of such neighbours are hashed into ``BUCKETS`` buckets. Two bag-of-n-grams
models are counted: the target's over labelled good documents, of which at most ``LABELLED`` are
taken, the raw one over all documents. A document's log weight is the mean over its n-grams of the logarithm of the
models' ratio; as a sum (``normalise=False``) it would grow with the text's length and leave the noise without effect.
Gumbel noise of scale ``noise`` is added and the ``share`` of the largest keys is drawn, which samples without
replacement in proportion to the exponential of log weight by noise.

The models have a fixed number of buckets, so that what the driver holds does not grow. The noise is a
hash of the document's id and text, so that a task that runs again draws the same. The cut between
drawn and other documents is found by counting keys, digit by digit, never by sorting all of them in
one place; ties at the cut go by id and text hash.

Defined cases: null text has no n-grams and a log weight of 0. A label counts for every row with its
id; a document is good if one of its labels says quality 1 and toxic 0 (null counts as 0). Repeated rows have equal
keys and are drawn or left together as far as the cut allows. Without good documents all weights are 0.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelstate.llm import wordgrams
from reelstate.llm.common import saved, with_arrow_columns

BUCKETS = 1 << 16
#: Share of the documents that are drawn.
KEEP = 0.85
#: Labelled good documents that the target's model is counted over, at most: a sample by hashed id.
LABELLED = 20_000
#: Added to each bucket's count, so that an unseen n-gram does not decide alone.
SMOOTH = 1.0
#: Scale of the noise. Mean log weights lie some hundredths apart; at 1 the noise would decide nearly alone.
NOISE = 0.05
DIGIT = 16


def gram_buckets(words: wordgrams.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of a piece, and the document of each."""
    places, pairs = words.grams(2)
    docs = np.repeat(np.arange(words.last - words.first), words.counts())
    found = np.concatenate([words.hashes, pairs]) % np.uint64(buckets)
    return found.astype(np.int64), np.concatenate([docs, docs[places]])


def model(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """N-grams of all documents in each bucket; every task sends its sums once."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for words in wordgrams.words(batch.column(text), wordgrams.MARKED, lower=True):
                found, _ = gram_buckets(words, buckets)
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """The models' log ratio; a bucket's pseudo-count is shared out by the raw model."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    prior = (raw + smooth) / (raw.sum() + smooth * len(raw))
    return np.log((target + smooth * len(raw) * prior) / (target.sum() + smooth * len(raw))) - np.log(prior)


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id",
                   most: int = LABELLED) -> DataFrame:
    """The documents of at most ``most`` good labels, those of the smallest hashes of their ids."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    good = good.select(F.col(key).alias("_good")).where("_good is not null").distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(most)
    return docs.join(F.broadcast(good), docs[key] == good["_good"], "left_semi")


def _scores(text: str, ratio: np.ndarray, normalise: bool):
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        weights, counts = np.zeros(len(batch)), np.zeros(len(batch), dtype=np.int64)
        for words in wordgrams.words(batch.column(text), wordgrams.MARKED, lower=True):
            found, docs = gram_buckets(words, len(ratio))
            n = words.last - words.first
            weights[words.first : words.last] = np.bincount(docs, ratio[found], minlength=n)
            counts[words.first : words.last] = np.bincount(docs, minlength=n)
        if normalise:
            weights = weights / np.maximum(counts, 1)
        return {"_weight": pa.array(weights), "_grams": pa.array(counts)}

    return work


def gumbel(*columns) -> Column:
    """Noise of a Gumbel distribution from the columns' hash: the same on every run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), *columns), 11)
    uniform = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def with_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """``df`` with a whole number that orders exactly as the double ``value`` does: its bits."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bits = (np.asarray(batch.column(value), dtype=np.float64) + 0.0).view(np.int64)  # -0 is 0
        return {order: pa.array(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))}

    return with_arrow_columns(df, work, T.StructType([T.StructField(order, T.LongType())]))


def kth_largest(df: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The ``k``-th largest whole number of a column, and how many larger ones there are.

    Numbers are counted by their digits of ``DIGIT`` bits, highest first; the driver sees at most
    one row for each digit.
    """
    # without sign: the smallest number is 0
    plain = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    low, above = 0, 0
    for shift in (48, 32, 16, 0):
        above_digit = shift + DIGIT
        part = df if above_digit == 64 else df.where(
            F.shiftrightunsigned(plain, above_digit) == F.lit(low >> above_digit))
        digit = F.shiftrightunsigned(plain, shift).bitwiseAND((1 << DIGIT) - 1)
        counts = dict(tuple(r) for r in part.groupBy(digit.alias("d")).count().collect())
        for d in sorted(counts, reverse=True):
            if above + counts[d] >= k:
                low |= d << shift
                break
            above += counts[d]
    return low - (1 << 63), above


def drawn(scored: DataFrame, weight: str, names: list[str], share: float = KEEP,
          noise: float = NOISE) -> DataFrame:
    """``scored`` with ``_key`` and ``_drawn``: the ``share`` of rows of the largest noisy weights.

    ``names`` are columns that tell rows apart; they seed the noise and break ties at the cut. Rows that agree in
    them are drawn together, so that repeated rows at the cut may add to the share.
    """
    keyed = scored.withColumn("_key", F.col(weight) + noise * gumbel(*names))
    keyed = saved(with_order(keyed, "_key", "_order"), "weights")
    k = math.ceil(share * keyed.count() - 1e-9)
    if k <= 0:
        return keyed.withColumn("_drawn", F.lit(False)).drop("_order")
    cut, above = kth_largest(keyed, "_order", k)
    # among equal keys the smaller hash comes first
    tie = F.shiftrightunsigned(F.xxhash64(F.lit("tie"), *names), 1)
    keyed = keyed.withColumn("_tie", F.when(F.col("_order") == cut, -1 - tie + F.lit((1 << 63) - 1)))
    last, _ = kth_largest(keyed.where(F.col("_tie").isNotNull()), "_tie", k - above)
    taken = (F.col("_order") > cut) | F.coalesce(F.col("_tie") >= last, F.lit(False))
    return keyed.withColumn("_drawn", taken).drop("_order", "_tie")


def resampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
              buckets: int = BUCKETS, share: float = KEEP, smooth: float = SMOOTH,
              noise: float = NOISE, normalise: bool = True) -> DataFrame:
    """One row for each document: number of n-grams, log weight, noisy key, and whether it is drawn."""
    own = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    target = model(good_documents(docs.select(key, text), labels, key), text, buckets)
    ratio = log_ratio(target, model(own, "_text", buckets), smooth)
    own = own.withColumn("_hash", F.xxhash64("_text"))
    added = T.StructType([T.StructField("_weight", T.DoubleType()), T.StructField("_grams", T.LongType())])
    scored = with_arrow_columns(own, _scores("_text", ratio, normalise), added).drop("_text")
    found = drawn(scored, "_weight", ["_id", "_hash"], share, noise)
    return found.select(F.col("_id").alias(key), F.col("_grams").alias("n_grams"),
                        F.col("_weight").alias("log_weight"), F.col("_key").alias("sample_key"),
                        F.col("_drawn").alias("kept"))
