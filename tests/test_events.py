"""Event routing, signatures and streams."""

import datetime
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from codetide import hooks, schemas
from codetide.functions import signing
from codetide.operators import events
from codetide.sources import index_store, readers, sinks
from codetide.streaming import events as event_streams, index as index_stream

PAYLOADS = [
    ("pull_request", {"action": "opened", "installation": {"id": 1}, "repository": {"full_name": "o/r"},
                      "pull_request": {"number": 7, "title": "t", "changed_files": 1, "head": {"sha": "abc"}}}, "processing"),
    ("pull_request", {"action": "synchronize", "repository": {"full_name": "o/r"}, "pull_request": {"number": 8, "head": {"sha": "d"}}}, "processing"),
    ("pull_request", {"action": "closed"}, "ignored"),
    ("installation", {"action": "created", "installation": {"id": 5}, "repositories": [{"full_name": "o/a"}, {"id": 3}, {"full_name": "o/b"}]}, "indexing"),
    ("installation", {"action": "deleted"}, "ignored"),
    ("installation_repositories", {"action": "added", "installation": {"id": 6}, "repositories_added": [{"full_name": "o/c"}]}, "indexing"),
    ("installation_repositories", {"action": "created"}, "ignored"),
    ("push", {"action": "opened"}, "ignored"),
    (None, {}, "ignored"),
]
SECRET = "s3cret"


def sign(body, secret=SECRET):
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


@pytest.fixture
def event_dir(tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    with open(folder / "a.json", "w") as out:
        for i, (event, payload, _) in enumerate(PAYLOADS):
            body = json.dumps(payload)
            out.write(json.dumps({
                "event_id": i, "received_at": "2024-01-01T00:00:00Z", "event": event, "body": body, "signature": sign(body)}) + "\n")
        out.write(json.dumps({"event_id": 100, "event": "push", "body": "{}", "signature": "sha256=bad"}) + "\n")
        out.write(json.dumps({"event_id": 101, "event": "push", "body": "{}"}) + "\n")
    return str(folder)


@pytest.mark.parametrize("secret", ["k", "x" * 64, "long " * 40, "pässwörd"])
def test_hmac_matches_the_library(spark, secret):
    bodies = ["", "{}", "é" * 100, "x" * 1000]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = [r[0] for r in df.select(signing.expected_signature(secret, F.col("b"))).collect()]
    assert got == [sign(b, secret) for b in bodies]


def test_batch_routing_and_signatures(spark, event_dir):
    raw = readers.read_events(spark, event_dir)
    verdicts = {r.event_id: r.verdict for r in events.check_signatures(raw, SECRET).collect()}
    assert verdicts.pop(100) == "invalid_signature" and verdicts.pop(101) == "missing_signature"
    assert set(verdicts.values()) == {"ok"}
    routed = {r.event_id: r.status for r in event_streams.routed(raw, SECRET).collect()}
    assert routed == {i: status for i, (_, _, status) in enumerate(PAYLOADS)}


def test_worklist_and_requests(spark, event_dir):
    parsed = events.parse_payload(readers.read_events(spark, event_dir))
    assert sorted((r.installation_id, r.repo) for r in events.index_worklist(parsed).collect()) == [(5, "o/a"), (5, "o/b"), (6, "o/c")]
    requests = sorted((r.pr_id, r.sha, r.error) for r in events.review_requests(parsed).collect())
    assert requests == [(7, "abc", None), (8, "d", "Missing context data")]


def test_stream_equals_batch(spark, event_dir, tmp_path):
    stream = readers.read_events(spark, event_dir, streaming=True)
    query = sinks.stream_to_table(event_streams.routed(stream, SECRET), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    streamed = {(r.event_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.event_id, r.status) for r in event_streams.routed(readers.read_events(spark, event_dir), SECRET).collect()}
    assert streamed == batch and len(batch) == len(PAYLOADS)


def test_status_lifecycle(spark, event_dir, tmp_path):
    stream = readers.read_events(spark, event_dir, streaming=True)
    path = str(tmp_path / "statuses")
    sinks.stream_to_table(event_streams.pending(stream), path, str(tmp_path / "cp")).awaitTermination()
    pending = spark.read.parquet(path)
    assert {(r.sha, r.state, r.description) for r in pending.collect()} == {
        ("abc", "pending", "AI review in progress..."), ("d", "pending", "AI review in progress...")}
    requests = events.review_requests(events.parse_payload(readers.read_events(spark, event_dir)))
    gated = spark.createDataFrame([("o/r", 7, "success", "y" * 200)], "repo string, pr_id bigint, state string, description string")
    final = events.final_statuses(requests, gated)
    latest = {r.sha: (r.state, r.description) for r in events.latest_status(pending.unionByName(final)).collect()}
    assert latest == {"abc": ("success", "y" * 140), "d": ("error", "Failed: Missing context data")}
    sinks.write_statuses(final, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_no_status_without_a_sha(spark):
    requests = spark.createDataFrame([("o/r", 1, None, None)], "repo string, pr_id bigint, sha string, error string")
    assert events.pending_statuses(requests).count() == 0


def test_index_stream_is_idempotent(spark, tmp_path):
    source, index = str(tmp_path / "changes"), str(tmp_path / "index")
    schema = "repo string, file_path string, size_bytes bigint, content string, status string, seq bigint"
    rows = [("o/r", "a.md", 3, "one", "added", 1), ("o/r", "a.md", 3, "two", "modified", 2), ("o/r", "b.md", 3, "b", "added", 3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    embed = hooks.hashing_embedder(dimensions=8)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(source)
        index_stream.start_index(stream, index, embed, str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.file_path, r.content) for r in index_store.load_index(spark, index)[0].collect())

    assert run("cp") == [("a.md", "two"), ("b.md", "b")]
    again = [("o/r", "a.md", 3, "two", "modified", 2), ("o/r", "c.md", 3, "c", "added", None), ("o/r", "c.md", 3, "c", "added", None)]
    spark.createDataFrame(rows + again, schema).coalesce(1).write.mode("overwrite").parquet(source)
    assert run("cp1") == [("a.md", "two"), ("b.md", "b"), ("c.md", "c")]  # redelivered rows count once, rows without a number count
    spark.createDataFrame([("o/r", "c.md", 3, None, "removed", 1)], schema).coalesce(1).write.mode("overwrite").parquet(source)
    assert run("cp3") == [("a.md", "two"), ("b.md", "b")]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(source)
    # The same batch again, as after a lost checkpoint.
    assert run("cp2") == [("a.md", "two"), ("b.md", "b")]
    spark.createDataFrame([("o/r", "a.md", 3, None, "removed", 4)], schema).coalesce(1).write.mode("append").parquet(source)
    assert run("cp") == [("b.md", "b")]


def test_second_review_of_a_commit_opens_it_again(spark):
    rows = [(1, "s", 0, "pending", "a"), (1, "s", 1, "failure", "b"), (2, "s", 0, "pending", "c")]
    statuses = spark.createDataFrame(rows, "event_id bigint, sha string, seq bigint, state string, description string").selectExpr("'o/r' AS repo", "*")
    assert [(r.state, r.description) for r in events.latest_status(statuses).collect()] == [("pending", "c")]


def test_status_stream_after_restart(spark, tmp_path):
    """Shuffled, repeated and late events in several files, and a restart in between: the stream ends where the batch does."""
    import random

    from codetide.streaming import status

    draw = random.Random(6)
    schema = "repo string, sha string, received_at timestamp, event_id bigint, seq bigint, state string, description string"
    start = datetime.datetime(2024, 1, 1)
    rows = [("o/r", f"s{i % 7}", start + datetime.timedelta(minutes=i // 3) if i % 11 else None, i if i % 5 else None, i % 2, draw.choice(["pending", "success", "failure", None]), f"d{i}")
            for i in range(200)] + [(None, "s0", start, 1, 0, "pending", None)]
    rows += draw.sample(rows, 60)
    draw.shuffle(rows)
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    for part in (rows[:80], rows[80:200], rows[200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        status.start_statuses(stream, out, checkpoint).awaitTermination(120)
    want = {tuple(r) for r in events.latest_status(spark.createDataFrame(rows, schema)).collect()}
    table = spark.read.schema(status.LATEST).parquet(out)
    assert {tuple(r) for r in status.current(table).collect()} == want and len(want) == 8
    assert table.count() < len(rows) / 2  # what is late or repeated leaves no row


def test_answers_are_asked_once(spark, tmp_path):
    """A run that fails goes on where it stopped; failed answers are asked again, known ones are not."""
    from codetide.sources import answers

    asked, memory = tmp_path / "asked", str(tmp_path / "memory")
    asked.mkdir()

    def model(texts):
        import uuid
        (asked / uuid.uuid4().hex).write_text("\n".join(texts))
        return [None if t == "r13" else t.upper() for t in texts]

    def all_asked():
        return [line for p in asked.iterdir() for line in p.read_text().split("\n") if line]

    calls = []

    def dies_at_third(df):
        calls.append(1)
        if len(calls) == 4:  # the first call only asks for the type
            raise RuntimeError("lost")
        return hooks.batch_writer(model)(df)

    requests = spark.createDataFrame([(i, f"r{i % 30}") for i in range(90)], "id long, request string")
    options = dict(request_col="request", answer_col="text", keep_request=False, slice_rows=6)
    with pytest.raises(RuntimeError):
        answers.remembered(dies_at_third, memory, **options)(requests)
    before = all_asked()
    assert 0 < len(before) < 30
    got = answers.remembered(hooks.batch_writer(model), memory, **options)(requests)
    assert {(r.id, r.text) for r in got.collect()} == {(i, None if i % 30 == 13 else f"R{i % 30}") for i in range(90)}
    assert len([t for t in all_asked() if t != "r13"]) == len({t for t in all_asked() if t != "r13"}) == 29
    answers.remembered(hooks.batch_writer(model), memory, **options)(requests)
    assert all_asked().count("r13") >= 2 and len(set(all_asked())) == 30 and len([t for t in all_asked() if t != "r13"]) == 29
    vectors = answers.remembered(hooks.digest_embedder(8), str(tmp_path / "vectors"), request_col="content", answer_col="embedding")
    texts = spark.createDataFrame([("a b a",), ("",), (None,)], "content string")
    assert sorted((r.content or "", sum(r.embedding)) for r in vectors(texts).collect()) == [("", 0), ("", 0), ("a b a", 3.0)]
