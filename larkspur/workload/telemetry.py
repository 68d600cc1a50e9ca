"""Observations of executions, free of literals."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.planner import Plan, equality_terms
from larkspur.plans.syntax import ArrayOf, Binary, Expr, Filter, ObjectOf, Query, Read, Unary

SCHEMA = (
    "fingerprint string, collection string, predicate_paths array<string>, candidate_paths array<string>, access string, "
    "index_name string, examined long, returned long, elapsed_micros long, succeeded boolean"
)


@dataclass(frozen=True)
class Event:
    """access is command, collection_scan or index_scan."""

    fingerprint: str
    collection: str | None
    predicate_paths: tuple[str, ...]
    candidate_paths: tuple[str, ...]
    access: str
    index_name: str | None
    examined: int
    returned: int
    elapsed_micros: int
    succeeded: bool


def fingerprint(query: Query) -> str:
    """The shape of a query: its command and the names of its stages."""
    c = query.command
    head = f"{c.verb}:{c.target}" if c.verb in ("get", "insert", "update", "delete") else c.verb
    return "|".join([head, *(s.name for s in query.stages)])


def paths_in(e: Expr) -> Iterator[str]:
    """All paths of an expression."""
    todo = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, Read):
            yield x.path.text
        elif isinstance(x, Unary):
            todo.append(x.operand)
        elif isinstance(x, Binary):
            todo += [x.left, x.right]
        elif isinstance(x, ArrayOf):
            todo += x.items
        elif isinstance(x, ObjectOf):
            todo += [v for _, v in x.fields]


def event_of(query: Query, plan: Plan, examined: int, returned: int, elapsed_micros: int, succeeded: bool) -> Event:
    filters = [s.predicate for s in query.stages if isinstance(s, Filter)]
    c = query.command
    return Event(
        fingerprint(query),
        c.target if c.verb in ("get", "insert", "update", "delete", "create_index") else None,
        tuple(sorted({p for f in filters for p in paths_in(f)})),
        tuple(sorted({".".join(p) for f in filters for p, _ in equality_terms(f)})),
        plan.access,
        plan.index.name if plan.index else None,
        examined,
        returned,
        elapsed_micros,
        succeeded,
    )


class Recorder:
    """A sink that keeps events in memory; safe to share between threads."""

    def __init__(self):
        self._events: list[Event] = []
        self._lock = threading.Lock()

    def record(self, event: Event) -> None:
        with self._lock:
            self._events.append(event)

    def snapshot(self) -> list[Event]:
        with self._lock:
            return list(self._events)

    def clear(self) -> None:
        with self._lock:
            self._events.clear()


def events_frame(spark: SparkSession, events: list[Event]) -> DataFrame:
    return spark.createDataFrame([(e.fingerprint, e.collection, list(e.predicate_paths), list(e.candidate_paths), e.access, e.index_name, e.examined, e.returned, e.elapsed_micros, e.succeeded) for e in events], SCHEMA)
