"""Where events go: callables of (rows, batch number) for ``foreachBatch``, or for a finished table with batch 0.

All but :func:`nothing` take rows as :func:`corvane.operators.payloads.event_json` shows
them, so fields that may hold what users wrote reach no sink.
"""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame

from corvane.operators.payloads import event_json

Sink = Callable[[DataFrame, int], None]


def nothing(events: DataFrame, number: int) -> None:
    """Events are not looked at."""


def json_lines(path: str) -> Sink:
    """A folder of JSON lines for each batch; a batch that runs again replaces its own."""

    def write(events: DataFrame, number: int) -> None:
        event_json(events).write.mode("overwrite").text(f"{path}/batch={number}")

    return write


def logged(name: str = "corvane.events", level: int = logging.INFO, most: int = 1000) -> Sink:
    """The first ``most`` events of a batch to the driver's log, and how many there were beyond: a log for people, not a store."""

    def write(events: DataFrame, number: int) -> None:
        log = logging.getLogger(name)
        lines = event_json(events)
        shown = lines.limit(most).collect()
        for r in shown:
            log.log(level, "%s", r.value)
        if len(shown) == most:
            log.log(level, "%d events in batch %d", lines.count(), number)

    return write


def buffered(into: deque) -> Sink:
    """JSON texts into a deque, which has a ``maxlen``: the last ones stay, for tests and consoles."""
    if into.maxlen is None:
        raise ValueError("a buffer needs a bound")

    def write(events: DataFrame, number: int) -> None:
        into.extend(r.value for r in event_json(events).limit(into.maxlen).toLocalIterator())

    return write


def several(*sinks: Sink) -> Sink:
    """All sinks, each with the same rows; what one raises is raised after the others have run."""

    def write(events: DataFrame, number: int) -> None:
        held, failed = events.persist(), []
        try:
            for s in sinks:
                try:
                    s(held, number)
                except Exception as e:
                    failed.append(e)
        finally:
            held.unpersist()
        if failed:
            raise failed[0]

    return write
