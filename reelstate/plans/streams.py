"""Streaming queries, drained over a whole table and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelstate.plans import sql, standins
from reelstate.plans.catalog import ORACLES, query
from reelstate.plans.lookups import AS_OF, NOT_FOUND
from reelstate.plans.reads_writes import TABLE_FILES, UPLOADED, file_facts, landed_uploads
from reelstate.plans.scalars import s_m1_transfer_percent
from reelstate.plans.states import FIELDS
from reelstate.session import scratch_path
from reelstate.sources import files, landing, listing, state_levels
from reelstate.streaming import eviction, expiry, latest, progress, timeline

DRAIN = {"availableNow": True}
# The given tables are small: a few buckets hold them.
LAYOUT = state_levels.Layout(buckets=4)


def _drain(running: StreamingQuery) -> None:
    running.awaitTermination()


def _appended(df: DataFrame, name: str) -> DataFrame:
    """Drain an append stream into parquet and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _drain(progress.append_stream(df, path, scratch_path(spark, f"{name}-checkpoint")))
    return spark.read.schema(df.schema).parquet(path)


@query(TABLE_FILES)
def t1_upload_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All table files arriving as uploads."""
    arrivals = landing.stream_landing(spark, f"{sf_dir}/*", glob="*.parquet")
    return _appended(file_facts(arrivals), "arrivals")


@query(UPLOADED)
def t1_landed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files arriving on a stream that lists them in tasks."""
    files = listing.stream_files(spark, landed_uploads(spark, sf_dir), settle=0)
    return _appended(landing.to_manifest(files).select("task_id", "filename", "length"), "landed-manifest")


@query(ORACLES[s_m1_transfer_percent.__name__])
def t2_percent_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = standins.transfers(standins.table_stream(spark, sf_dir, "lineitem"))
    return _appended(progress.percent_stream(moves), "percents")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.as_task_events(standins.table_stream(spark, sf_dir, "events"))


_STATE = sql.with_tables(sql.merged_state(), sql.TASK_EVENTS)


@query(_STATE)
def t3_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running state from the state store, published in update mode."""
    table = scratch_path(spark, "latest-state")
    running = latest.latest_state_stream(_event_stream(spark, sf_dir), FIELDS)
    checkpoint = scratch_path(spark, "latest-checkpoint")
    _drain(latest.publish_state(running, table, checkpoint, FIELDS, trigger=DRAIN, layout=LAYOUT))
    return state_levels.read_state(spark, table, FIELDS).select("task_id", "last_seq", *FIELDS)


@query(_STATE)
def t3_restarted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events; a new start from the stored table; the other half, in which finished tasks are not held."""
    table, events = scratch_path(spark, "restarted-state"), standins.task_events(spark, sf_dir)
    for half in range(2):
        folder = scratch_path(spark, "half-log")
        events.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == half).write.parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        known = state_levels.read_state(spark, table, FIELDS) if half else None
        running = expiry.expiring_state_stream(stream, FIELDS, initial=known, stay=None)
        checkpoint = scratch_path(spark, "restart-checkpoint")
        with eviction.rocksdb_store(spark):
            # a new checkpoint numbers its batches from 0 again
            _drain(latest.publish_state(running, table, checkpoint, FIELDS, trigger=DRAIN, layout=LAYOUT,
                                         first_batch=half * 1000))
    return state_levels.read_state(spark, table, FIELDS).select("task_id", "last_seq", *FIELDS)


@query(AS_OF)
def j3_as_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls and events as streams in three batches out of order; a last row of each stream moves the watermark on."""
    events, fields = standins.task_events(spark, sf_dir), ["status", "progress"]
    columns = ["task_id", "event_time", "seq", *fields]
    rows = {"polls": events.where("status = 'error'").select("task_id", "event_time", F.col("seq").alias("request_id")),
            "events": events.where("coalesce(status, '') <> 'error'").select(columns)}
    end = events.agg((F.max("event_time") + F.expr("INTERVAL 4000 DAYS")).alias("event_time"))
    streams = {}
    for name, df in rows.items():
        folder, first = scratch_path(spark, name), 0
        for part in (df.where("seq % 2 = 1" if name == "events" else "request_id % 2 = 1"),
                     df.where("seq % 2 = 0" if name == "events" else "request_id % 2 = 0"),
                     df.limit(0).unionByName(end, allowMissingColumns=True)):
            part.write.mode("append").parquet(folder)
            # as many files a batch as the first part has
            first = first or sum(x.endswith(".parquet") for x in files.names(spark, folder))
        streams[name] = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", first).parquet(folder)
    answers = timeline.as_of_stream(streams["polls"], streams["events"], fields, delay="2000 days")
    with eviction.rocksdb_store(spark):
        return _appended(answers, "as-of-answers").where("task_id IS NOT NULL").select(
            "task_id", "request_id", *fields)


@query(sql.with_tables(
    """SELECT task_id, seq, status FROM task_events WHERE status IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1
         AND status IN ('processing', 'uploading')""",
    sql.TASK_EVENTS,
))
def t4_followed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks still followed once the stream has been read to its end."""
    table = scratch_path(spark, "followed")
    changes = eviction.follow_tasks(_event_stream(spark, sf_dir), late_milliseconds=None)
    checkpoint = scratch_path(spark, "follow-checkpoint")
    with eviction.rocksdb_store(spark):
        _drain(latest.publish_changes(changes, table, checkpoint, drop="followed = false", trigger=DRAIN,
                                       layout=LAYOUT))
    newest = state_levels.read_state(spark, table, ["row"])
    return newest.filter("row.followed").select("task_id", F.col("last_seq").alias("seq"), "row.status")


STEPS = 3


@query(sql.with_tables(
    f"""SELECT r.o_orderkey AS request_id, r.o_custkey AS task_id,
          CAST(CASE WHEN s.task_id IS NULL THEN 404 ELSE 200 END AS INTEGER) AS code,
          CASE WHEN s.task_id IS NULL THEN {NOT_FOUND} END AS reply_message,
          s.status, s.progress
        FROM orders r
        LEFT JOIN (
          SELECT step, task_id, max_by(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
            max_by(progress, seq) FILTER (WHERE progress IS NOT NULL) AS progress
          FROM task_events, range({STEPS}) AS steps(step) WHERE seq % {STEPS} <= step
          GROUP BY step, task_id
        ) s ON s.task_id = r.o_custkey AND s.step = r.o_orderkey % {STEPS}""",
    sql.TASK_EVENTS,
))
def t5_request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in three batches; the state table grows before each of them."""
    fields = ["status", "progress"]
    events = standins.task_events(spark, sf_dir)
    asked = standins.customer_requests(spark, sf_dir)
    folder, table, answers, checkpoint = (
        scratch_path(spark, name) for name in ("requests", "state", "answers", "answer-checkpoint")
    )
    for step in range(STEPS):
        asked.filter(F.col("request_id") % STEPS == step).coalesce(1).write.mode("append").parquet(folder)
    grown = 0

    def state_now(batch: DataFrame) -> DataFrame:
        nonlocal grown
        for step in range(grown, batch.first().request_id % STEPS + 1):
            part = events.filter(F.col("seq") % STEPS == step)
            rows = state_levels.merge_events(part, fields)
            state_levels.store_batch(rows, table, step, fields, layout=LAYOUT)
            grown = step + 1
        # with the batch's own session, whose settings hold for its reads
        return state_levels.read_state(batch.sparkSession, table, fields, asked=batch).select("task_id", *fields)

    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    _drain(progress.answer_stream(stream, state_now, answers, checkpoint))
    return progress.read_answers(spark, answers)


@query(_STATE)
def t6_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State merged into a keyed table batch by batch, and folded on read."""
    table = scratch_path(spark, "upserted-state")
    events = _event_stream(spark, sf_dir)
    checkpoint = scratch_path(spark, "upsert-checkpoint")
    _drain(latest.upsert_stream(events, table, checkpoint, FIELDS, trigger=DRAIN, layout=LAYOUT))
    return state_levels.read_state(spark, table, FIELDS).select("task_id", "last_seq", *FIELDS)
