"""Routing and checking of webhook events. All stateless, so they run on batches and streams alike."""

from pyspark.sql import Column, DataFrame, functions as F

from codetide import schemas
from codetide.functions import signing

# Fixed value: length of a status text.
STATUS_CHARS = 140
# Label under which a host lists the statuses.
STATUS_CONTEXT = "code-review"


def parse_payload(events: DataFrame) -> DataFrame:
    """Add `payload` (the fields of schemas.EVENT_PAYLOAD) and `action` from the JSON body."""
    return events.withColumn("payload", F.from_json("body", schemas.EVENT_PAYLOAD)).withColumn(
        "action", F.col("payload.action"))


def route_events(events: DataFrame) -> DataFrame:
    """Add `status` (processing, indexing or ignored) from columns event and action."""
    event, action = F.col("event"), F.col("action")
    review = (event == "pull_request") & action.isin("opened", "synchronize")
    index = ((event == "installation") & (action == "created")) | (
        (event == "installation_repositories") & (action == "added"))
    return events.withColumn("status", F.when(review, "processing").when(index, "indexing").otherwise("ignored"))


def index_worklist(parsed: DataFrame) -> DataFrame:
    """Repositories to index, one row each, from events routed to indexing."""
    listed = F.when(F.col("event") == "installation", F.col("payload.repositories")).otherwise(
        F.col("payload.repositories_added"))
    return (
        route_events(parsed).where(F.col("status") == "indexing")
        .select("event_id", F.col("payload.installation.id").alias("installation_id"), F.explode(listed).alias("r"))
        .select("event_id", "installation_id", F.col("r.full_name").alias("repo"))
        .where(F.col("repo").isNotNull() & (F.col("repo") != ""))
    )


def present(value: Column, empty) -> Column:
    """Neither missing nor zero nor an empty text."""
    return value.isNotNull() & (value != F.lit(empty))


def review_requests(parsed: DataFrame) -> DataFrame:
    """Changes to review from events routed to processing; `error` is set where context is missing."""
    pr = F.col("payload.pull_request")
    complete = (
        present(F.col("payload.installation.id"), 0) & present(F.col("payload.repository.full_name"), "") & present(pr["number"], 0))
    return (
        route_events(parsed).where((F.col("status") == "processing") & pr.isNotNull())
        .select(
            "event_id", *[c for c in ("received_at",) if c in parsed.columns], F.col("payload.repository.full_name").alias("repo"), pr["number"].alias("pr_id"),
            pr["head"]["sha"].alias("sha"), F.when(~complete, "Missing context data").alias("error"))
    )


def check_signatures(events: DataFrame, secret: str) -> DataFrame:
    """Add `verdict`: ok, missing_signature or invalid_signature."""
    signature = F.col("signature")
    valid = signature == signing.expected_signature(secret, F.col("body"))
    return events.withColumn(
        "verdict",
        F.when(F.coalesce(signature, F.lit("")) == "", "missing_signature")
        .when(valid, "ok").otherwise("invalid_signature"),
    )


def pending_statuses(requests: DataFrame) -> DataFrame:
    """First status of every request."""
    return _status_rows(requests, F.lit(0), F.lit("pending"), F.lit("AI review in progress..."))


def final_statuses(requests: DataFrame, gated: DataFrame) -> DataFrame:
    """Closing status of every request: the gate's, or an error where the diff is missing."""
    joined = requests.join(gated.select("repo", "pr_id", "state", "description"), ["repo", "pr_id"], "left")
    failed = F.col("error").isNotNull()
    state = F.when(failed, "error").otherwise(F.col("state"))
    description = F.when(failed, F.concat(F.lit("Failed: "), F.col("error"))).otherwise(F.col("description"))
    return _status_rows(joined, F.lit(1), state, description).where(F.col("state").isNotNull())


def _status_rows(rows: DataFrame, seq, state, description) -> DataFrame:
    """Statuses of commits; rows without a sha have nowhere to go."""
    return rows.where(F.col("sha").isNotNull()).select(
        *[c for c in ("event_id", "received_at") if c in rows.columns], "repo", "pr_id", "sha", seq.cast("bigint").alias("seq"), state.alias("state"),
        F.substring(description, 1, STATUS_CHARS).alias("description"), F.lit(STATUS_CONTEXT).alias("context"))


def latest_status(statuses: DataFrame, order: tuple[str, ...] = ("received_at", "event_id", "seq")) -> DataFrame:
    """Last status per (repo, sha) by those columns of `order` that are there.

    The request decides before its step, so a second review of a commit opens it again. One row wins as a
    whole; equal orders are decided by the texts. Partial maxima, so a busy commit does not pile up in one task.
    """
    row = F.struct("state", "description")
    last = F.struct(*[c for c in order if c in statuses.columns], "state", "description")
    return statuses.groupBy("repo", "sha").agg(F.max_by(row, last).alias("_last")).select("repo", "sha", "_last.*")
