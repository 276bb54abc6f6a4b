"""Event streams: routing, work lists and the status lifecycle."""

from pyspark.sql import DataFrame

from codetide.operators import events


def accepted(stream: DataFrame, secret: str | None) -> DataFrame:
    """Parsed events, without those whose signature does not verify."""
    if secret is not None:
        stream = events.check_signatures(stream, secret).where("verdict = 'ok'").drop("verdict")
    return events.parse_payload(stream)


def routed(stream: DataFrame, secret: str | None = None) -> DataFrame:
    return events.route_events(accepted(stream, secret)).select("event_id", "received_at", "event", "action", "status")


def worklist(stream: DataFrame, secret: str | None = None) -> DataFrame:
    return events.index_worklist(accepted(stream, secret))


def pending(stream: DataFrame, secret: str | None = None) -> DataFrame:
    """A pending status for every change request on arrival."""
    return events.pending_statuses(events.review_requests(accepted(stream, secret)))
