"""Names, URLs, messages and ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelstate.schemas import PROGRESS_MESSAGE, STATUS_ENDPOINT, TASK_ID_LENGTH


def basename(path: Column) -> Column:
    """The part after the last separator, so a client name cannot leave its folder."""
    return F.regexp_replace(path, r"^.*[/\\]", "")


def storage_name(task_id: Column, filename: Column) -> Column:
    return F.concat(task_id.cast("string"), F.lit("_"), basename(filename))


def processed_name(task_id: Column, filename: Column) -> Column:
    return F.concat(F.lit("processed_"), storage_name(task_id, filename))


def in_folder(folder: str, name: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), name)


def stored_task_id(name: Column) -> Column:
    """Task id of a storage name; the id has a fixed width, so ``_`` in names is safe."""
    return F.when(_is_storage_name(name), F.substring(name, 1, TASK_ID_LENGTH))


def stored_filename(name: Column) -> Column:
    """Client file name of a storage name; a name without an id is kept as it is."""
    tail = F.substring(name, TASK_ID_LENGTH + 2, 2**31 - 1)
    return F.when(_is_storage_name(name), tail).otherwise(name)


def _is_storage_name(name: Column) -> Column:
    return name.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}_")


def extension(name: Column) -> Column:
    """Lower-case text after the last dot, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def public_url(base: str, name: Column) -> Column:
    return in_folder(base, name)


def progress_message(percent: Column) -> Column:
    return F.concat(F.lit(PROGRESS_MESSAGE), percent.cast("string"), F.lit("%"))


def percent_text(percent: Column) -> Column:
    return F.concat(percent.cast("string"), F.lit("%"))


def status_url(task_id: Column) -> Column:
    return F.concat(F.lit(f"{STATUS_ENDPOINT}?task_id="), task_id.cast("string"))


def query_parameter(url: Column, name: str = "task_id") -> Column:
    """Decoded query parameter; NULL when it is missing or the URL is malformed."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def completion_text(at: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, fractions cut off."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def random_task_id() -> Column:
    """A version 4 UUID. It changes when a stage is recomputed: persist it at ingest."""
    return F.expr("uuid()")


def derived_task_id(*parts: Column) -> Column:
    """UUID-shaped id from a SHA-256 of the parts: the same after every replay.

    Parts go in with their lengths, and NULL as a mark of its own, so that different parts
    never make one text.
    """
    texts = [p.cast("string") for p in parts]
    marked = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = F.sha2(F.concat_ws("|", *marked), 256)
    bounds = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in bounds])
