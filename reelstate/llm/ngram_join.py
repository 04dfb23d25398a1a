"""Jaccard join of documents on their word n-grams, with MinHash banding.

Method: each document is the set of its runs of ``GRAM`` words (A to Z in lower case, words of
digits, letters and all beyond ASCII; a shorter document is one gram of all its words). Documents of
equal sets are copies and count as one set from there on. The sets' MinHash values are shuffled by
band; bands and rows are chosen for the wanted recall at the threshold. Sets that share a band
are brought together in clusters, and within a cluster all pairs are verified on their full gram sets.

A bucket gives one edge for each of its sets, never all pairs. A large cluster is verified in blocks
of at most ``BLOCK`` sets against each other, in tasks of their own, which give the number of links
of each set to other sets (each once, however many texts have it) and a spanning forest of the links; no list of all pairs is ever made, and no link
within a cluster is lost.

Defined cases: null text and text without words match nothing: each such document is a class of its own, without
links. A null id comes before all others. Repeated rows are copies.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelstate.llm import wordgrams
from reelstate.llm.common import packed, releasing, same, saved, unpacked, whole
from reelstate.llm.components import components

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: MinHash values of a document at most.
HASHES = 128
BLOCK = 256
#: Sets of small clusters that one task group verifies.
PACK = 1000
#: Clusters up to this size are verified pair by pair.
SMALL = 24
COLUMNS = 8192


def bands_and_rows(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """As many rows a band as ``hashes`` allow, and the bands that find a pair at ``threshold``
    with probability ``recall``."""
    best = None
    for rows in range(1, hashes + 1):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError(f"{hashes} hashes do not reach a recall of {recall} at {threshold}")
    return best


def document_grams(words: wordgrams.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of a piece, and the document of each, in the order of the documents."""
    places, hashes = words.grams(n)
    docs = words.document(places)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = [wordgrams.gram_hashes(words.hashes[words.offsets[d] : words.offsets[d + 1]],
                                     int(counts[d]))[0] for d in short]
        docs = np.concatenate([docs, short])
        hashes = np.concatenate([hashes, np.array(own, dtype=np.uint64)])
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
    return hashes, docs


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _signatures(key: str, text: str, n: int, bands: int, rows: int):
    random = np.random.default_rng(20240229)
    flips = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    factors = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @releasing
    def run(batches):
        for batch in batches:
            sets = [None] * len(batch)
            values = np.zeros((len(batch), bands), dtype=np.uint64)
            for words in wordgrams.words(batch.column(text), wordgrams.PLAIN, lower=True):
                hashes, docs = document_grams(words, n)
                if not len(docs):
                    continue
                heads = np.flatnonzero(np.append(True, np.diff(docs) != 0))
                which = words.first + docs[heads]
                with np.errstate(over="ignore"):
                    for band in range(bands):
                        total = np.full(len(heads), band, dtype=np.uint64)
                        for k in range(band * rows, band * rows + rows):
                            least = np.minimum.reduceat((hashes ^ flips[k]) * factors[k], heads)
                            total = wordgrams.mix(total * wordgrams.BASE + least)
                        values[which, band] = total
                for d, a, b in zip(which, heads, np.append(heads[1:], len(docs)), strict=True):
                    sets[d] = _digest(np.unique(hashes[a:b]))
            flat = pa.array(values.view(np.int64).ravel(), pa.int64())
            offsets = pa.array(np.arange(len(batch) + 1) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("_hash"), pa.array(sets, pa.binary()),
                 pa.ListArray.from_arrays(offsets, flat)],
                names=["_id", "_hash", "_set", "bands"])

    return run


def signatures(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """``_id, _hash, _set, bands`` of each row; ``_set`` is null without words."""
    named = docs.select(F.col(key).cast("long").alias(key), F.xxhash64(text).alias("_hash"), text)
    return named.mapInArrow(_signatures(key, text, n, bands, rows),
                            "_id long, _hash long, _set binary, bands array<long>")


def _verified(text: str, n: int, threshold: float):
    """Links within the clusters, or between two blocks of one, of a group of sets."""

    @releasing
    def run(group: pa.Table) -> pa.Table:
        names, sides = group.column("_set").to_pylist(), group.column("right").to_pylist()
        parts = group.column("cluster").to_pylist()
        grams: list = [None] * len(names)
        for words in wordgrams.words(group.column(text), wordgrams.PLAIN, lower=True):
            hashes, docs = document_grams(words, n)
            bounds = np.searchsorted(docs, np.arange(words.last - words.first + 1))
            for d in range(words.last - words.first):
                grams[words.first + d] = np.unique(hashes[bounds[d] : bounds[d + 1]])
        clusters: dict = {}
        for i, name in enumerate(names):
            clusters.setdefault(parts[i], {}).setdefault((name, sides[i]), i)
        count: dict = {}
        forest: list[tuple[bytes, bytes]] = []
        for members in clusters.values():
            rows = [i for (_, right), i in members.items() if not right]
            across = [i for (_, right), i in members.items() if right]
            root: dict = {}

            def top(x, root=root):
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for a, b in _pairs([grams[i] for i in rows], [grams[i] for i in across], threshold):
                x, y = names[rows[a]], names[across[b] if across else rows[b]]
                count[x] = count.get(x, 0) + 1
                count[y] = count.get(y, 0) + 1
                if top(x) != top(y):
                    root[top(x)] = top(y)
                    forest.append((x, y))
        return pa.table({
            "a": pa.array([*count, *(x for x, _ in forest)], pa.binary()),
            "b": pa.array([*[None] * len(count), *(y for _, y in forest)], pa.binary()),
            "n": pa.array([*count.values(), *[0] * len(forest)], pa.int64()),
        })

    return run


def _pairs(left: list, right: list, threshold: float):
    """Places of the pairs at the threshold: within ``left``, or across to ``right`` if it has any."""
    within = not right
    if len(left) <= SMALL and within:
        for a in range(len(left)):
            for b in range(a + 1, len(left)):
                x, y = left[a], left[b]
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= threshold * (len(x) + len(y) - shared) - 1e-9:
                    yield a, b
        return
    everything = [*left, *right]
    sizes = np.array([len(x) for x in everything])
    flat = np.concatenate(everything)
    owner = np.repeat(np.arange(len(everything)), sizes)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    often = counts[inverse] > 1  # a gram of one set is shared by none
    columns, owner = (np.cumsum(counts > 1) - 1)[inverse[often]], owner[often]
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    n = len(left)
    shared = np.zeros((n, n if within else len(right)), dtype=np.float32)
    for low in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        a, b = np.searchsorted(columns, [low, low + COLUMNS])
        matrix = np.zeros((len(everything), COLUMNS), dtype=np.float32)
        matrix[owner[a:b], columns[a:b] - low] = 1
        shared += matrix[:n] @ (matrix[:n] if within else matrix[n:]).T
    union = sizes[:n, None] + (sizes[:n] if within else sizes[n:])[None, :] - shared
    hit = shared >= threshold * union - 1e-6
    if within:
        hit = np.triu(hit, 1)
    yield from zip(*(x.tolist() for x in np.nonzero(hit)), strict=True)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = GRAM,
            threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES,
            block: int = BLOCK) -> DataFrame:
    """``_id, _hash, _set, class_id, n_links, n_copies, first`` of each row of ``docs``.

    ``class_id`` is the smallest id of the documents that links bring together; ``n_links`` the
    number of different sets that the document is linked to; ``n_copies`` the number of rows of its
    own set; ``first`` the id and text hash of the class's first document.
    """
    bands, rows = bands_and_rows(threshold, recall, hashes)
    signed = saved(signatures(docs, key, text, n, bands, rows), "signatures")
    sets = signed.where(F.col("_set").isNotNull()).groupBy("_set").agg(
        F.min(F.struct("_id", "_hash")).alias("rep"), F.count("*").alias("n_copies"))
    band = signed.where(F.col("_set").isNotNull()).select("_set", F.explode("bands").alias("band")).distinct()
    shared = band.groupBy("band").agg(F.min("_set").alias("low"), F.max("_set").alias("high"))
    shared = shared.where(F.col("low") != F.col("high")).select(F.col("band").alias("at"), "low")
    edges = band.join(shared, band["band"] == shared["at"]).select(
        F.col("low").alias("a"), F.col("_set").alias("b"))
    found = components(edges)
    links = saved(_links(docs, sets, found, key, text, n, threshold, block), "links")
    forest = links.where(F.col("b").isNotNull()).select("a", "b")
    counts = links.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("n_links"))
    member = components(forest)
    member = member.select(F.col("node").alias("_of"), "component")
    sets = sets.join(member, sets["_set"] == member["_of"], "left").join(
        counts, sets["_set"] == counts["a"], "left")
    sets = sets.select("_set", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                       F.coalesce("component", "_set").alias("component"))
    first = sets.groupBy("component").agg(F.min("rep").alias("first"))
    sets = sets.join(first, "component").select(
        F.col("_set").alias("_of"), "first", "n_links", "n_copies")
    own = F.struct("_id", "_hash")
    return signed.join(sets, signed["_set"] == sets["_of"], "left").select(
        "_id", "_hash", "_set",
        F.when(F.col("_of").isNull(), F.col("_id")).otherwise(F.col("first._id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("first", own).alias("first"),
    )


def _links(docs, sets, clusters, key, text, n, threshold, block) -> DataFrame:
    """Number of links of each set (``b`` null) and a spanning forest, in parts that add up."""
    member = clusters.select(F.col("node").alias("_node"), F.col("component").alias("cluster"))
    size = member.groupBy("cluster").agg(F.count("*").alias("size"))
    member = member.join(size, "cluster")
    packs = max(1, member.count() // PACK)
    blocks = F.ceil(F.col("size") / block).cast("int")
    member = sets.join(member, sets["_set"] == member["_node"]).select(
        "_set", "rep", "cluster", blocks.alias("blocks"),
        F.pmod(F.xxhash64("_set"), blocks).cast("int").alias("own"))
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"),
                        whole(text).alias("_text"))
    wanted = member.select("_set", "cluster", "blocks", "own", F.col("rep._id").alias("_rid"),
                           F.col("rep._hash").alias("_rhash"))
    held = texts.join(wanted, same(texts, wanted, {"_id": "_rid", "_hash": "_rhash"}))
    # each block meets every other one once: left of those after it, right of those before it
    pairs = held.select(
        "_set", "cluster", "_text", "own",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(
            F.xxhash64("cluster")).alias("pack"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("_set", "cluster", "_text", "pack", F.least("own", "other").alias("x"),
                         F.greatest("own", "other").alias("y"),
                         (F.col("own") > F.col("other")).alias("right"))
    return pairs.groupBy("pack", "x", "y").applyInArrow(
        _verified("_text", n, threshold), "a binary, b binary, n long")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each document: its class, its number of links and of copies."""
    found = classes(docs, key, text, **options)
    return found.select(F.col("_id").alias(key), "class_id", "n_links", "n_copies")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The first document of each class, with the columns it came with, once."""
    found = classes(docs, key, text, **options)
    first = found.select("_id", "_hash", "_set").where(
        F.struct("_id", "_hash").eqNullSafe(F.col("first"))).select(
        F.col("_id").alias("_rid"), F.col("_hash").alias("_rhash"), "_set").distinct()
    named = docs.select(packed(docs).alias("row"), F.col(key).cast("long").alias("_id"),
                        F.xxhash64(text).alias("_hash"))
    kept = named.join(first, same(named, first, {"_id": "_rid", "_hash": "_rhash"}))
    # repeated rows of a first document; without words every row is a class
    copy = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(0)))
    kept = kept.withColumn("_copy", copy)
    kept = kept.where((F.col("_copy") == 1) | F.col("_set").isNull())
    return unpacked(kept, "row", docs.columns)
