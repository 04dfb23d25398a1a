"""Benchmark decontamination with one automaton over the normalised test items.

Method: each test item is normalised (A to Z in lower case, words of digits, letters and all beyond
ASCII) and laid out in blocks of ``BLOCK`` words; one Aho-Corasick automaton holds all blocks. A
document is normalised byte by byte and scanned once. Any run of ``WINDOW`` item words holds a whole
block, so that every match is found from a block by comparing the words around it; the run of equal
words there, if it is ``WINDOW`` long, is hit. An item of fewer words is one pattern of its own.
Normalising keeps the number of bytes, so that a word's place leads back to its span in the
original text.

The automaton has a node for each byte of the items at most. Items of more than ``SHARD_BYTES``
together are dealt to several automata, used one after the other over all documents, so that
what a task and the driver hold stays bounded whatever the benchmark's size.

Defined cases: null text has no words. Items without words never occur. Repeated items count by
their distinct ids; an item without id hits words and is not listed. Repeated documents get the same result
each.
"""

import hashlib
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelstate.llm.common import packed, saved, unpacked, whole, with_arrow_columns
from reelstate.llm.wordgrams import PLAIN_TABLE, buffers

WINDOW = 10
BLOCK = 5
SHARD_BYTES = 8 << 20

_SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
FOUND = T.StructType([
    T.StructField("hit_words", T.ArrayType(_SPAN)),
    T.StructField("hit_items", T.ArrayType(T.LongType())),
    T.StructField("n_words", T.LongType()),
])


def normalised(text: bytes) -> list[bytes]:
    return text.translate(PLAIN_TABLE).split()


class Items:
    """The automaton over the items' blocks, and the items' words to compare."""

    def __init__(self, items: list[tuple[int | None, str]], window: int, block: int):
        self.window, self.block = window, block
        self.words: list[list[bytes]] = []
        self.ids: list[int | None] = []
        places = defaultdict(list)
        for item, text in items:
            words = normalised((text or "").encode())
            if not words:
                continue
            at = len(self.words)
            self.words.append(words)
            self.ids.append(item)
            if len(words) < window:
                places[b" ".join(words)].append((at, 0, len(words)))
            else:
                for p in range(0, len(words) - block + 1, block):
                    places[b" ".join(words[p : p + block])].append((at, p, block))
        self.automaton = ahocorasick.Automaton()
        for phrase, found in places.items():
            self.automaton.add_word(f" {phrase.decode('latin-1')} ", found)
        if places:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words, merged, and the places of the items that hit them."""
        if not len(self.automaton) or not words:
            return [], set()
        text = f" {b' '.join(words).decode('latin-1')} "
        spans, items, starts = set(), set(), None
        done: dict[tuple[int, int], int] = {}  # end of the last run with this item at this shift
        for end, found in self.automaton.iter(text):
            if starts is None:
                starts = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
            after = int(np.searchsorted(starts, end))  # the match ends before this word
            for at, place, size in found:
                if size == len(self.words[at]) < self.window:
                    span = (after - size, after)
                elif done.get((at, after - size - place), 0) >= after:
                    continue
                else:
                    span = self.run(words, after - size, at, place)
                    done[at, after - size - place] = span[1] if span else after
                if span:
                    spans.add(span)
                    items.add(at)
        return merged(spans), items

    def run(self, words: list[bytes], first: int, at: int, place: int) -> tuple[int, int] | None:
        """The longest run of equal words around a block, if it holds a window."""
        item, low, high = self.words[at], 0, self.block
        while first - low > 0 and place - low > 0 and words[first - low - 1] == item[place - low - 1]:
            low += 1
        while (first + high < len(words) and place + high < len(item)
               and words[first + high] == item[place + high]):
            high += 1
        return (first - low, first + high) if low + high >= self.window else None


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _scanner(items, window, block, text, before: bool):
    """Work on a batch; the automaton is built once in each task."""
    built: list[Items] = []

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not built:
            built.append(Items(items, window, block))
        data, offsets = buffers(pc.struct_field(batch.column("row"), text))
        old = batch.column("found").to_pylist() if before else None
        spans, hits, counts = [], [], []
        for i in range(len(batch)):
            words = normalised(data[offsets[i] : offsets[i + 1]].tobytes())
            found, where = built[0].scan(words)
            ids = {built[0].ids[at] for at in where} - {None}
            if old:
                found = merged([*found, *((s["first"], s["last"]) for s in old[i]["hit_words"])])
                ids |= set(old[i]["hit_items"])
            spans.append([{"first": a, "last": b} for a, b in found])
            hits.append(sorted(ids, key=str))
            counts.append(len(words))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return {"found": pa.StructArray.from_arrays(
            [pa.array(spans, kind), pa.array(hits, pa.list_(pa.int64())), pa.array(counts, pa.int64())],
            names=["hit_words", "hit_items", "n_words"])}

    return work


def scanned(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, block: int = BLOCK,
            shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``row`` with the columns of ``docs``, and ``found``: spans of hit words, ids of occurring
    items, number of words."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), whole(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    added = T.StructType([T.StructField("found", FOUND)])
    docs = docs.select(packed(docs).alias("row"))
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard)
        rows = [tuple(row) for row in part.collect()]
        if shard:
            docs = saved(docs, "scanned")
        docs = with_arrow_columns(docs, _scanner(rows, window, block, text, bool(shard)), added)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                  text: str = "text", **options) -> DataFrame:
    """One row for each document: its words, hit words and occurring items."""
    found = scanned(docs.select(key, text), benchmark, text, **options)
    ids = F.col("found.hit_items")
    hit = F.aggregate("found.hit_words", F.lit(0).cast("long"),
                      lambda a, s: a + s["last"] - s["first"])
    listed = F.concat_ws(",", F.sort_array(F.transform(ids, lambda x: x.cast("string"))))
    return found.select(
        F.col(f"row.`{key}`").alias(key),
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col("found.hit_words").alias("hit_words"),
    )


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans in the original text of spans of words."""
    raw = text.encode()
    flags = np.frombuffer(b" " + raw.translate(PLAIN_TABLE) + b" ", np.uint8) != 0x20
    starts = np.flatnonzero(flags[1:-1] & ~flags[:-2])
    ends = np.flatnonzero(flags[1:-1] & ~flags[2:]) + 1
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(int(chars[starts[a]] - 1), int(chars[ends[b - 1] - 1])) for a, b in spans]


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no window of a test item, with the columns they came with."""
    found = scanned(docs, benchmark, text, **options)
    return unpacked(found.where(F.size("found.hit_words") == 0), "row", docs.columns)


def listed_sha256(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
