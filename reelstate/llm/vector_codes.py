"""Product codes of vectors, the nearest codebook entry found by a walk over neighbour lists.

Method: a vector of whole numbers is cut into ``PARTS`` equal parts, each with a codebook of
``ENTRIES``. Every entry has the list of all entries in the order of their distance from it. A part
is coded by Orchard's search: from some entry on, its list is gone through; an entry that is nearer (or
as near and of lower index) becomes the current one and its list is taken up from the start; entries
met before are marked and not measured again. The walk ends where the list is beyond twice the current
distance: by the triangle inequality no entry further on can be nearer, or as near. A batch's parts walk
together, one step of all at a time.

Training is ``ROUNDS`` passes over all rows. Tasks send sums and counts per entry, one row each, so
the driver holds the codebooks and nothing that grows with the rows.

Defined cases: rows with a NULL vector, or with a component that is NULL or not finite, are left out.
Shorter vectors end in zeros, and all are filled up to a multiple of ``PARTS`` components. The first entries
are those of the smallest ids, NULL ids last, equal ids by their components; with fewer rows than
entries the codebooks are shorter. Repeated rows are coded alike. Without rows there is no result.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelstate.llm.common import releasing, saved, with_arrow_columns
from reelstate.llm.vectors import matrix, scaled, width

PARTS = 16
ENTRIES = 64
ROUNDS = 2


@dataclass(frozen=True)
class Neighbours:
    """A codebook: its entries, and for each of them all entries by distance, the nearest first."""

    entries: np.ndarray
    order: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> "Neighbours":
        gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        # an entry's own list starts with itself, also before its equals
        own = np.eye(len(entries), dtype=bool)
        order = np.lexsort((np.where(own, -1, np.arange(len(entries))), gaps))
        return cls(entries, order, np.take_along_axis(gaps, order, 1))


def nearest(points: np.ndarray, book: Neighbours) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry, the lowest of equals, and its squared distance."""
    entries, size = book.entries, len(book.entries)
    current = np.zeros(len(points), dtype=np.int64)
    if not len(points):
        return current, current.copy()
    best = ((points - entries[0]) ** 2).sum(1)
    spot = np.ones(len(points), dtype=np.int64)
    met = np.zeros((len(points), size), dtype=bool)
    met[:, 0] = True
    walking = np.arange(len(points)) if size > 1 else np.arange(0)
    while len(walking):
        at, place = current[walking], spot[walking]
        # twice the distance is four times its square
        within = book.gaps[at, place] <= 4 * best[walking]
        walking, at, place = walking[within], at[within], place[within]
        found = book.order[at, place]
        spot[walking] += 1
        new = ~met[walking, found]
        seen, entry = walking[new], found[new]
        met[seen, entry] = True
        distance = ((points[seen] - entries[entry]) ** 2).sum(1)
        nearer = (distance < best[seen]) | ((distance == best[seen]) & (entry < current[seen]))
        moved = seen[nearer]
        current[moved], best[moved], spot[moved] = entry[nearer], distance[nearer], 1
        walking = walking[spot[walking] < size]
    return current, best


def coded(rows: np.ndarray, books: list[Neighbours]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances of vectors, a column for each part."""
    step = rows.shape[1] // len(books)
    found = [nearest(rows[:, p * step : (p + 1) * step], book) for p, book in enumerate(books)]
    return np.stack([codes for codes, _ in found], 1), np.stack([far for _, far in found], 1)


def first_entries(kept: DataFrame, dims: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the rows of the smallest ids: an array by part, entry and component."""
    rows = kept.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()
    found = np.zeros((len(rows), dims), dtype=np.int64)
    for i, (vector,) in enumerate(rows):
        found[i, : len(vector)] = vector
    return found.reshape(len(rows), parts, dims // parts).transpose(1, 0, 2)


def retrained(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every entry at the floor of the mean of its parts; unused entries stay."""
    parts, size, step = books.shape
    lists = [Neighbours.of(book) for book in books]

    @releasing
    def run(batches):
        sums = np.zeros((parts, size, step), dtype=np.int64)
        counts = np.zeros((parts, size), dtype=np.int64)
        for batch in batches:
            rows = matrix(batch.column(0), parts * step)
            codes, _ = coded(rows, lists)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], rows[:, p * step : (p + 1) * step])
                counts[p] += np.bincount(codes[:, p], minlength=size)
        used = np.argwhere(counts)
        part, entry = used[:, 0], used[:, 1]
        total = sums[part, entry]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]),
             *[pa.array(total[:, i]) for i in range(step)]],
            names=["part", "entry", "n", *[f"x{i}" for i in range(step)]],
        )

    names = ["n", *[f"x{i}" for i in range(step)]]
    schema = "part long, entry long, " + ", ".join(f"{name} long" for name in names)
    total = kept.select("_vector").mapInArrow(run, schema).groupBy("part", "entry").agg(
        *[F.sum(name).alias(name) for name in names])
    out = books.copy()
    for part, entry, n, *x in total.collect():
        out[part, entry] = [value // n for value in x]
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
               parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``key, label, codes, error`` of all rows whose vector is whole, and the codebooks.

    ``codes`` has an entry's number for each part, ``error`` is the sum of the squared distances.
    """
    kept = table.select(F.col(key).alias("_id"), F.col(label).alias("_label"), scaled(vector).alias("_vector"))
    kept = saved(kept.where("_vector is not null"), "vectors")
    dims = -(-max(width(kept, "_vector"), 1) // parts) * parts
    books = first_entries(kept, dims, parts, entries)
    if books.shape[1]:
        for _ in range(rounds):
            books = retrained(kept, books)
    lists = [Neighbours.of(book) for book in books]

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codes, far = coded(matrix(batch.column("_vector"), dims), lists)
        offsets = np.arange(len(codes) + 1, dtype=np.int32) * parts
        return {"codes": pa.ListArray.from_arrays(offsets, codes.astype(np.int32).ravel()),
                "error": pa.array(far.sum(1))}

    added = T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    found = with_arrow_columns(kept, work, added)
    return found.select(F.col("_id").alias(key), F.col("_label").alias(label), "codes", "error"), books


def reported(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each coded vector: its code in hexadecimal, its error and that of its label."""
    found, books = compressed(table, key, vector, label, parts, entries, rounds)
    text = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = saved(found.select(F.col(key).alias("_id"), F.col(label).alias("_label"), text.alias("code"), "error"),
                 "codes")
    total = rows.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    both = rows.join(total, rows["_label"].eqNullSafe(total["_of"]))
    return both.select(F.col("_id").alias(key), "code", "error", "label_error",
                       F.lit(digest(books)).alias("codebooks_sha256"))
