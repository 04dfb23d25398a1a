"""Progress arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelstate.schemas import PROGRESS_FIRST, PROGRESS_LAST, PROGRESS_STEP


def transfer_percent(loaded: Column, total: Column) -> Column:
    """Rounded share of ``total`` that is loaded, half up.

    An unknown total (NULL or 0) divides by 1, and the value is not clamped, so it
    may pass 100.
    """
    known = F.coalesce(F.nullif(total.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.round(loaded.cast("double") * 100 / known).cast("long")


def expected_steps() -> Column:
    """The array of progress values a task reports."""
    return F.sequence(F.lit(PROGRESS_FIRST), F.lit(PROGRESS_LAST), F.lit(PROGRESS_STEP))
