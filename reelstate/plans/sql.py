"""SQL for the stand-ins, shared by the checks."""

from reelstate.schemas import PUBLIC_BASE as BASE


def padded(number: str, digits: int) -> str:
    text = f"CAST({number} AS VARCHAR)"
    return f"lpad({text}, CAST(greatest(length({text}), {digits}) AS INTEGER), '0')"


TASK_EVENTS = f"""
task_events AS (
  SELECT user_id AS task_id, event_id AS seq, ts AS event_time,
    CASE event_type WHEN 'signup' THEN 'uploading' WHEN 'view' THEN 'processing'
      WHEN 'purchase' THEN 'completed'
      WHEN 'error' THEN 'error' END AS status,
    CASE WHEN event_type IN ('signup', 'view', 'click')
      THEN CAST(json_extract_string(props, '$.k') AS INTEGER)
      WHEN event_type = 'purchase' THEN 100 END AS progress,
    CASE WHEN event_type IN ('view', 'click')
      THEN '正在进行 AI 识别... ' || json_extract_string(props, '$.k') || '%' END AS message,
    CASE WHEN event_type = 'purchase' THEN '{BASE}/processed_' || user_id || '_clip_'
      || event_id || '.mp4' END AS processed_video_url
  FROM events
)"""

DETECTIONS = f"""
detections AS (
  SELECT l_orderkey AS task_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_shipdate, l_extendedprice) - 1 AS pos,
    {padded("CAST(floor(l_extendedprice) AS BIGINT) // 60", 2)} || ':'
      || {padded("CAST(floor(l_extendedprice) AS BIGINT) % 60", 2)} AS "timestamp",
    'H' || {padded("l_suppkey % 1000", 3)} AS horse_id,
    'Supplier#' || {padded("l_suppkey", 9)} AS person_name,
    CAST(CAST(1 - l_discount AS DECIMAL(4,2)) AS VARCHAR) || '_'
      || CAST(CAST(1 - l_tax AS DECIMAL(4,2)) AS VARCHAR) AS confidence
  FROM lineitem
)"""


def _derived_id(text: str) -> str:
    digest = f"sha256({text})"
    parts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr({digest}, {start}, {size})" for start, size in parts)


UPLOADS = f"""
uploads AS (
  SELECT doc_id, {_derived_id("'6:upload|' || length(CAST(doc_id AS VARCHAR)) || ':' || doc_id")} AS task_id,
    source || '/clip_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'mp4' WHEN 'de' THEN 'MOV'
      WHEN 'fr' THEN 'avi' ELSE 'txt' END AS filename,
    'clip_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'mp4' WHEN 'de' THEN 'MOV'
      WHEN 'fr' THEN 'avi' ELSE 'txt' END AS basename,
    lang, n_chars
  FROM documents
)"""

SELECTED_TASKS = f"""
selected_tasks AS (
  SELECT task_id, status,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN clip END AS filename,
    CASE WHEN status = 'completed' THEN '{BASE}/' || clip END AS processed_video_url
  FROM (
    SELECT o_orderkey AS task_id, o_orderpriority, 'clip_' || o_orderkey || '.mp4' AS clip,
      CASE o_custkey % 6 WHEN 0 THEN 'idle' WHEN 1 THEN 'uploading' WHEN 2 THEN 'processing'
        WHEN 3 THEN 'completed' WHEN 4 THEN 'error' ELSE 'queued' END AS status
    FROM orders
  )
)"""


def merged_state(events: str = "task_events", keys: str = "task_id",
                 fields: tuple[str, ...] = ("status", "progress", "message",
                                            "processed_video_url")) -> str:
    columns = ", ".join(
        f"max_by({f}, seq) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in fields
    )
    return f"SELECT {keys}, max(seq) AS last_seq, {columns} FROM {events} GROUP BY {keys}"


def with_tables(body: str, *tables: str) -> str:
    return f"WITH {', '.join(tables)} {body}"
