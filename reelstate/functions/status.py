"""Values derived from a task's status."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelstate import schemas as S


def status_label(status: Column) -> Column:
    label = F.lit(S.UNKNOWN_STATUS_LABEL)
    for value, text in S.STATUS_LABELS.items():
        label = F.when(status == value, F.lit(text)).otherwise(label)
    return label


def is_active(status: Column) -> Column:
    """Still worth polling."""
    return F.coalesce(status.isin(*S.ACTIVE_STATUSES), F.lit(False))


def may_start(filename: Column, status: Column) -> Column:
    """A file is chosen and nothing runs."""
    return F.coalesce(filename.isNotNull() & status.isin(*S.STARTABLE_STATUSES), F.lit(False))


def next_action(status: Column) -> Column:
    return F.when(status == S.COMPLETED, F.lit("reset")).otherwise(F.lit("start"))


def action_caption(status: Column) -> Column:
    return (
        F.when(status == S.IDLE, F.lit(S.CAPTION_IDLE))
        .when(status == S.COMPLETED, F.lit(S.CAPTION_COMPLETED))
        .otherwise(F.lit(S.CAPTION_BUSY))
    )


def result_pane(status: Column) -> Column:
    """``result``, ``empty`` or ``loading``; a failed task counts as loading."""
    return (
        F.when(status == S.COMPLETED, F.lit("result"))
        .when(status == S.IDLE, F.lit("empty"))
        .otherwise(F.lit("loading"))
    )


def loading_text(status: Column) -> Column:
    """Heading of the loading pane, NULL on the other panes."""
    text = F.when(status == S.UPLOADING, F.lit(S.LOADING_UPLOAD)).otherwise(
        F.lit(S.LOADING_ANALYSIS)
    )
    return F.when(result_pane(status) == "loading", text)


def has_output(url: Column) -> Column:
    return F.coalesce(url != "", F.lit(False))


def view_mode(status: Column) -> Column:
    return F.when(status == S.COMPLETED, F.lit("processed")).otherwise(F.lit("original"))


def display_name(mode: Column, filename: Column) -> Column:
    return F.when(mode == "original", filename).otherwise(
        F.concat(F.lit("Processed_"), filename)
    )


def status_after_upload(status: Column, code: Column) -> Column:
    """Any reply but 200, or none (NULL), is an error."""
    return F.when(code.eqNullSafe(F.lit(S.OK_CODE)), status).otherwise(F.lit(S.ERROR))


def status_after_poll(status: Column, code: Column, served: Column) -> Column:
    """200 takes the served status, another code changes nothing, no reply is an error."""
    return (
        F.when(code == S.OK_CODE, served)
        .when(code.isNull(), F.lit(S.ERROR))
        .otherwise(status)
    )
