"""Date arguments of a job."""

from __future__ import annotations

from datetime import datetime, timezone


def argument_epoch(text: str) -> int:
    """Epoch seconds of an ISO date or datetime argument; naive means UTC.

    A bare date is its midnight. Anything else raises ValueError.
    """
    moment = datetime.fromisoformat(text)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return int(moment.timestamp())
