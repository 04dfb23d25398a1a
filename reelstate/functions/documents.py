"""Nested result documents and JSON."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelstate import schemas as S


def detection(timestamp: Column, horse_id: Column, person_name: Column,
              confidence: Column) -> Column:
    return F.struct(
        timestamp.alias("timestamp"), horse_id.alias("horse_id"),
        person_name.alias("person_name"), confidence.alias("confidence"),
    )


def result(filename: Column, duration: Column, resolution: Column, processed_at: Column,
           detections: Column, part: Column | None = None, first_pos: Column | None = None,
           version: Column | None = None, parts: Column | None = None, total: Column | None = None) -> Column:
    """A result, or a part of one; the first part goes without its numbers.

    A stored result has the ``version`` of its detections and how many ``parts`` and detections (``total``) there are.
    """
    places = {"part": part, "first_pos": first_pos}
    stored = {"version": version, "parts": parts, "total": total}
    return F.struct(
        filename.alias("filename"), duration.alias("duration"), resolution.alias("resolution"),
        processed_at.alias("processed_at"), detections.alias("detections"),
        *[F.nullif(F.lit(0) if value is None else value, F.lit(0)).cast("long").alias(name)
          for name, value in places.items()],
        *[(F.lit(None) if value is None else value).cast("long").alias(name) for name, value in stored.items()],
    )


def with_part(head: Column, detections: Column, part: Column, first_pos: Column) -> Column:
    """A stored result with the detections of one of its parts."""
    return result(
        head["filename"], head["duration"], head["resolution"], head["processed_at"], detections,
        part, first_pos, head["version"], head["parts"], head["total"],
    )


def envelope(code: Column, message: Column, data: Column) -> Column:
    return F.struct(
        code.cast("int").alias("code"), message.alias("message"), data.alias("data")
    )


def compact_json(document: Column) -> Column:
    """One line; missing keys are left out."""
    return F.to_json(document, {"ignoreNullFields": "true"})


def pretty_json(document: Column) -> Column:
    """Two-space indented."""
    return F.to_json(document, {"pretty": "true"})


def parse_reply(text: Column) -> Column:
    """A reply as a struct; malformed text gives NULL fields."""
    return F.from_json(text, S.REPLY, {"mode": "PERMISSIVE"})
