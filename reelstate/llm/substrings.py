"""Substring dedup with automata of repeated phrases.

A window is ``WINDOW`` consecutive words; a word goes if a window over it starts earlier too: in a
document of a smaller id, or earlier in the same one. Windows are judged on the input.

Method: every window picks one phrase of ``PHRASE`` words within it, by a rule that looks at the
words alone, so that equal windows pick equal phrases.

1. The picked phrases of each block of documents are counted, and phrases that recur in the corpus
   are confirmed by their words, not by a hash.
2. For each block an Aho-Corasick automaton of the confirmed phrases that it holds is compiled, and
   the block's documents stream through it, which locates every occurrence. The automata are
   sharded by block, so that each document is read by one of them and the work grows with the
   corpus, not with its square. Windows next to each other that pick the same located phrase make
   a run; equal runs of a block become one row with the list of their places.
3. The rows meet by phrase. Of equal runs the first one stands; of runs that differ but share the
   phrase, the windows of each first one are compared.
4. The removed places go back to their block, where the words are cut out.

The documents are shuffled once, by block, and that shuffle serves steps 1, 2 and 4. A phrase
has one row at most for each block and distinct run, so that a frequent phrase in ever different
contexts has rows in proportion to its places, and one task takes all rows of a phrase.

Defined cases: null text has no words; a null id comes before all others. Repeated rows are one
document at the same place, so that neither removes the other. An empty table gives an empty table.
"""

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelstate.llm import wordgrams
from reelstate.llm.common import packed, releasing, unpacked

WINDOW = 20
PHRASE = 5
BLOCK_BYTES = 2 << 20
_FIRST = -(1 << 63)


def picks(words: wordgrams.Words, window: int, phrase: int):
    """Places of the windows, their hashes, and the place of the phrase that each one picks."""
    places, hashes = words.grams(window)
    if not len(places):
        return places, hashes, places
    phrases = wordgrams.gram_hashes(words.hashes, phrase)
    views = np.lib.stride_tricks.sliding_window_view(phrases, window - phrase + 1)
    return places, hashes, places + views[places].argmin(axis=1)


def _texts(docs: pa.Table, text: str):
    return pc.struct_field(docs.column("row").combine_chunks(), text)


def _phrases(text: str, window: int, phrase: int):
    """The phrases that the windows of a block pick, with the number of their places."""

    @releasing
    def run(docs: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        for words in wordgrams.words(_texts(docs, text)):
            _, _, picked = picks(words, window, phrase)
            data = words.data.tobytes()
            picked = np.unique(picked)
            for a, b in zip(words.starts[picked].tolist(), words.ends[picked + phrase - 1].tolist(),
                            strict=True):
                found = b" ".join(data[a:b].split())
                counts[found] = counts.get(found, 0) + 1
        block = docs.column("_block")[0].as_py()
        return pa.table({"_block": pa.array([block] * len(counts), pa.int64()),
                         "phrase": pa.array(list(counts), pa.binary()),
                         "n": pa.array(list(counts.values()), pa.int64())})

    return run


def _located(words: wordgrams.Words, automaton, phrase: int) -> np.ndarray:
    """For each word place whether a phrase of the automaton starts there."""
    found = np.zeros(len(words.hashes) + 1, dtype=bool)
    data, offsets = words.data.tobytes(), words.offsets.tolist()
    starts, ends = words.starts.tolist(), words.ends.tolist()
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        if high - low < phrase:
            continue
        text = b" %b " % b" ".join(data[starts[low] : ends[high - 1]].split())
        hits = [end for end, _ in automaton.iter(text.decode("latin-1"))]
        if hits:
            blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
            found[low + np.searchsorted(blanks, hits) - phrase] = True
    return found


def _runs(text: str, window: int, phrase: int):
    """Runs of windows of a block that pick located phrases; one row for equal runs."""

    @releasing
    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        automaton = ahocorasick.Automaton()
        for found in phrases.column("phrase").to_pylist():
            automaton.add_word(f" {found.decode('latin-1')} ", 1)
        parts = []
        if len(automaton) and docs.num_rows:
            automaton.make_automaton()
            for words in wordgrams.words(_texts(docs, text)):
                places, hashes, picked = picks(words, window, phrase)
                held = _located(words, automaton, phrase)[picked]
                if held.any():
                    parts.append(_piece_runs(words, places[held], hashes[held], picked[held], phrase))
        block = docs.column("_block")[0].as_py() if docs.num_rows else 0
        return _grouped(block, docs, parts)

    return run


def _piece_runs(words, places, hashes, picked, phrase):
    doc = words.document(places)
    new = np.ones(len(places), dtype=bool)
    new[1:] = (np.diff(places) != 1) | (np.diff(picked) != 0) | (np.diff(doc) != 0)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(places)))
    key = wordgrams.gram_hashes(words.hashes, phrase)[picked[heads]]
    with np.errstate(over="ignore"):
        # the first and the last window together cover all words of the run
        name = wordgrams.mix(hashes[heads] * wordgrams.BASE
                             + hashes[heads + sizes - 1] * wordgrams.STEP + sizes.astype(np.uint64))
    start = places[heads] - words.offsets[doc[heads]]
    return key, name, sizes, words.first + doc[heads], start, hashes


def _grouped(block: int, docs: pa.Table, parts: list) -> pa.Table:
    if parts:
        key, name, sizes, row, start, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        key = name = hashes = np.zeros(0, dtype=np.uint64)
        sizes = row = start = np.zeros(0, dtype=np.int64)
    ids = pc.take(docs.column("_id"), pa.array(row)).to_numpy()
    texts = pc.take(docs.column("_hash"), pa.array(row)).to_numpy()
    heads = np.cumsum(sizes) - sizes
    order = np.lexsort((start, ids, name, key))
    key, name, sizes, start, heads = (x[order] for x in (key, name, sizes, start, heads))
    ids, texts = ids[order], texts[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    lead = np.flatnonzero(new)
    n = sizes[lead]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    windows = hashes[np.repeat(heads[lead], n) + inner] if len(lead) else hashes[:0]
    places = pa.StructArray.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(start, pa.int64())],
        names=["doc", "hash", "start"])
    return pa.table({
        "_block": pa.array(np.full(len(lead), block), pa.int64()),
        "phrase": pa.array(key[lead].view(np.int64), pa.int64()),
        "run": pa.array(name[lead].view(np.int64), pa.int64()),
        "n": pa.array(n, pa.int64()),
        "windows": pa.ListArray.from_arrays(
            pa.array(np.append(np.cumsum(n) - n, n.sum()), pa.int32()),
            pa.array(windows.view(np.int64), pa.int64())),
        "places": pa.ListArray.from_arrays(
            pa.array(np.append(lead, len(key)), pa.int32()), places),
    })


_RUNS = ("_block long, phrase long, run long, n long, windows array<long>, "
         "places array<struct<doc: long, hash: long, start: long>>")


def _removed(runs: DataFrame) -> DataFrame:
    """Places of removed windows: ``_block, doc, hash, start, n`` windows from ``start`` on."""
    runs = runs.repartition("phrase")
    equal = Window.partitionBy("phrase", "run")
    around = Window.partitionBy("phrase")
    lead = F.col("places")[0]
    runs = runs.withColumn("first", F.min(F.struct(lead["doc"].alias("doc"),
                                                   lead["start"].alias("start"))).over(equal))
    runs = runs.withColumn("differ", F.min("run").over(around) != F.max("run").over(around))
    is_first = F.struct(lead["doc"].alias("doc"), lead["start"].alias("start")) == F.col("first")
    # the windows of first runs, one row each; other rows stay one row
    runs = runs.select(
        "_block", "phrase", "n", "places", "first", is_first.alias("is_first"),
        F.posexplode_outer(F.when(F.col("differ") & is_first, F.col("windows"))).alias("i", "window"))
    same_window = Window.partitionBy("phrase", "window")
    own = F.struct(F.col("first.doc").alias("doc"), (F.col("first.start") + F.col("i")).alias("start"))
    earliest = F.min(F.when(F.col("window").isNotNull(), own)).over(same_window)
    runs = runs.withColumn("late", F.col("window").isNotNull() & (earliest < own))

    def later(p):
        return F.struct(p["doc"].alias("doc"), p["start"].alias("start")) > F.col("first")

    def holds(p, start, n):
        return F.struct(p["doc"].alias("doc"), p["hash"].alias("hash"), start.alias("start"),
                        n.alias("n"))

    one = F.lit(1).cast("long")
    others = F.when(F.coalesce(F.col("i"), F.lit(0)) == 0,
                    F.transform(F.filter("places", later), lambda p: holds(p, p["start"], F.col("n"))))
    firsts = F.when(F.col("late"), F.transform(
        F.filter("places", lambda p: ~later(p)), lambda p: holds(p, p["start"] + F.col("i"), one)))
    none = F.array().cast("array<struct<doc: long, hash: long, start: long, n: long>>")
    gone = F.explode(F.concat(F.coalesce(others, none), F.coalesce(firsts, none)))
    return runs.select("_block", gone.alias("_gone")).select("_block", "_gone.*")


def _cut(text: str, window: int):
    """The documents of a block with what is removed from them."""

    @releasing
    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, own, start, n in zip(*(gone.column(c).to_pylist()
                                         for c in ("doc", "hash", "start", "n")), strict=True):
            spans.setdefault((doc, own), []).append((start, start + n + window - 1))
        counts, removed, digests, texts = [], [], [], []
        names = zip(docs.column("_id").to_pylist(), docs.column("_hash").to_pylist(), strict=True)
        old = _texts(docs, text).to_pylist()
        for name, own in zip(names, old, strict=True):
            raw = (own or "").encode()
            words = raw.split()
            left = np.ones(len(words), dtype=bool)
            for a, b in spans.get(name, ()):
                left[a:b] = False
            counts.append(len(words))
            removed.append(len(words) - int(left.sum()))
            kept = words if left.all() else [words[i] for i in np.flatnonzero(left)]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            texts.append(_without(raw, left).decode() if removed[-1] else own)
        return pa.table({
            "row": docs.column("row"), "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
            "left": pa.array(texts, pa.string())})

    return run


def _without(raw: bytes, left: np.ndarray) -> bytes:
    """The text of the words that are left, with the white space that follows each."""
    flags = np.zeros(len(raw) + 2, dtype=bool)
    flags[1:-1] = wordgrams.SPACED[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(flags[1:-1] & ~flags[:-2])
    stops = np.append(starts[1:], len(raw))
    keep = np.flatnonzero(left)
    if not len(keep):
        return b""
    return b"".join([raw[a:b] for a, b in zip(starts[keep], stops[keep], strict=True)]).strip(
        wordgrams.SPACES)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                 phrase: int = PHRASE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` with the columns of ``docs``, ``n_words``, ``n_removed``, ``kept_sha256`` (kept words,
    one blank between) and ``left``, the text that is left with the white space it had."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    row = F.xxhash64(key, text)
    named = docs.select(
        packed(docs).alias("row"),
        F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)).alias("_id"),
        F.xxhash64(text).alias("_hash"),
        F.pmod(row, F.lit(blocks)).alias("_block"),
    )
    counted = named.groupBy("_block").applyInArrow(_phrases(text, window, phrase),
                                                   "_block long, phrase binary, n long")
    total_n = F.sum("n").over(Window.partitionBy("phrase"))
    recurring = counted.withColumn("total", total_n).where(F.col("total") > 1)
    recurring = recurring.select("_block", "phrase")
    runs = named.groupBy("_block").cogroup(recurring.groupBy("_block")).applyInArrow(
        _runs(text, window, phrase), _RUNS)
    gone = _removed(runs)
    added = T.StructType([T.StructField("n_words", T.LongType()),
                          T.StructField("n_removed", T.LongType()),
                          T.StructField("kept_sha256", T.StringType()),
                          T.StructField("left", T.StringType())])
    schema = T.StructType([named.schema["row"], *added.fields])
    return named.groupBy("_block").cogroup(gone.groupBy("_block")).applyInArrow(
        _cut(text, window), schema)


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each document: its words, how many are removed, and the digest of the rest."""
    found = deduplicated(docs.select(key, text), key, text, **options)
    return found.select(F.col(f"row.`{key}`").alias(key), "n_words", "n_removed", "kept_sha256")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without their removed words; those of which no word is left go.

    A column ``n_chars``, where there is one, is counted anew for texts that lose words.
    """
    found = deduplicated(docs, key, text, **options)
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cut = F.col("n_removed") > 0
    new = {text: F.when(cut, F.col("left")).otherwise(F.col(f"row.`{text}`"))}
    if "n_chars" in docs.columns and text != "n_chars":
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(cut, F.length("left").cast(kind)).otherwise(F.col("row.n_chars"))
    return unpacked(found, "row", docs.columns, **new)
