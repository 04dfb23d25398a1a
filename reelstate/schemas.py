"""Table schemas and the fixed values of the reply contract.

Every table is declared, never inferred. A key that a task record does not
have yet is a NULL column.
"""

from pyspark.sql import types as T

# Statuses, texts and codes of the reply contract.
IDLE = "idle"
UPLOADING = "uploading"
PROCESSING = "processing"
COMPLETED = "completed"
ERROR = "error"
STATUSES = (IDLE, UPLOADING, PROCESSING, COMPLETED, ERROR)
ACTIVE_STATUSES = (PROCESSING, UPLOADING)
STARTABLE_STATUSES = (IDLE, COMPLETED)

STATUS_LABELS = {
    "idle": "等待提交",
    "uploading": "正在上传",
    "processing": "AI 处理中",
    "completed": "分析完成",
    "error": "任务失败",
}
UNKNOWN_STATUS_LABEL = "未知状态"

RECEIVED_MESSAGE = "文件已接收，等待处理"
PROGRESS_MESSAGE = "正在进行 AI 识别... "
ACCEPTED_MESSAGE = "上传成功"
NOT_FOUND_MESSAGE = "任务不存在"
OK_CODE = 200
NOT_FOUND_CODE = 404

CAPTION_IDLE = "开始上传处理"
CAPTION_COMPLETED = "上传新视频"
CAPTION_BUSY = "正在执行 AI 分析..."
LOADING_UPLOAD = "正在同步文件..."
LOADING_ANALYSIS = "后端正在分析..."

PROGRESS_FIRST, PROGRESS_LAST, PROGRESS_STEP = 0, 100, 10
MEDIA_EXTENSIONS = ("mp4", "avi", "mov")
PUBLIC_BASE = "http://localhost:8000/videos"
STATUS_ENDPOINT = "/api/status"
TASK_ID_LENGTH = 36
# End of fixed values.


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()

DETECTION = _struct(timestamp=_S, horse_id=_S, person_name=_S, confidence=_S)
# A result holds its detections, or names their stored version (``sources.result_store``) with its number of
# parts and detections; a reply of such a result holds one part. The first part has no ``part`` and ``first_pos``.
RESULT = _struct(
    filename=_S, duration=_S, resolution=_S, processed_at=_S, detections=T.ArrayType(DETECTION),
    part=_L, first_pos=_L, version=_L, parts=_L, total=_L,
)
UPLOAD_MANIFEST = _struct(task_id=_S, filename=_S, path=_S, length=_L, modificationTime=_TS)
TASK_EVENTS = _struct(
    task_id=_S, seq=_L, event_time=_TS, status=_S, progress=_I, message=_S, file_path=_S,
    processed_video_url=_S, result=RESULT, attempt=_I,
)
REQUESTS = _struct(request_id=_L, request_time=_TS, task_id=_S)
# A served record carries no storage path.
TASK_DATA = _struct(
    task_id=_S, status=_S, progress=_I, message=_S, processed_video_url=_S, result=RESULT
)
REPLY = _struct(code=_I, message=_S, data=TASK_DATA)
TRANSFER = _struct(task_id=_S, seq=_L, loaded=_L, total=_L)

# The fields of a task record that events may set, one by one.
STATE_FIELDS = ("status", "progress", "message", "file_path", "processed_video_url", "result")
