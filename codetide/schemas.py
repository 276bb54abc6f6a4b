"""Table layouts shared by readers, operators and writers."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


STRING, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

REPO_FILES = _struct(repo=STRING, file_path=STRING, size_bytes=LONG, content=STRING)

# file_ord is the position of the file in the change's file list: unique per change, gaps allowed.
# Readers add host_files, host_additions, host_deletions: totals of the host, which may list more than it delivers.
PR_FILES = _struct(
    repo=STRING, pr_id=LONG, file_ord=LONG, file_path=STRING, status=STRING,
    patch=STRING, additions=LONG, deletions=LONG,
)

# One JSON document per change request, as hosts deliver them.
PR_DOCUMENT = _struct(
    installation_id=LONG,
    repo=STRING,
    pr_id=LONG,
    head_sha=STRING,
    changed_files=LONG,
    additions=LONG,
    deletions=LONG,
    files=T.ArrayType(_struct(filename=STRING, status=STRING, patch=STRING, additions=LONG, deletions=LONG)),
)

CHUNKS = _struct(
    repo=STRING, file_path=STRING, chunk_index=LONG, chunk_type=STRING, name=STRING,
    content=STRING, embedding=T.ArrayType(DOUBLE),
)

POSTINGS = _struct(repo=STRING, file_path=STRING, symbol=STRING, mentions=LONG)

FILE_HASHES = _struct(repo=STRING, file_path=STRING, content_hash=STRING)

STATUSES = _struct(
    repo=STRING, pr_id=LONG, sha=STRING, seq=LONG, state=STRING, description=STRING, context=STRING,
)

REVIEWS = _struct(repo=STRING, pr_id=LONG, part=LONG, body=STRING)

# The event name and signature travel in headers; the body is the raw request text.
EVENTS = T.StructType([
    T.StructField("event_id", LONG),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("event", STRING),
    T.StructField("signature", STRING),
    T.StructField("body", STRING),
])

_REPO_REF = T.ArrayType(_struct(full_name=STRING))

# Only the payload fields that routing and review read.
EVENT_PAYLOAD = _struct(
    action=STRING,
    installation=_struct(id=LONG),
    repository=_struct(full_name=STRING),
    repositories=_REPO_REF,
    repositories_added=_REPO_REF,
    pull_request=_struct(
        number=LONG, title=STRING, body=STRING, changed_files=LONG,
        additions=LONG, deletions=LONG, head=_struct(sha=STRING),
    ),
)
