"""What becomes of recommendations: proposed, then accepted or dismissed, applied, evaluated."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row

from larkspur.errors import InvalidArgument, InvalidState, NotFound
from larkspur.workload.advisor import impact

# Which state each step needs, and which it leads to.
STEPS = {"accept": ("proposed", "accepted"), "dismiss": ("proposed", "dismissed"), "mark_applied": ("accepted", "applied"), "evaluate": ("applied", "evaluated")}


@dataclass(frozen=True)
class Record:
    recommendation: Row
    status: str = "proposed"
    evaluation: Row | None = None


class Lifecycle:
    """Decisions on the rows of recommend(), by collection and path."""

    def __init__(self, recommendations: Iterable[Row]):
        self._held: dict[tuple[str, str], Record] = {}
        for r in recommendations:
            key = (r["collection"], r["path"])
            if key in self._held:
                raise InvalidArgument(f"{key[0]}.{key[1]} is recommended twice")
            self._held[key] = Record(r)

    def records(self) -> list[Record]:
        return [self._held[k] for k in sorted(self._held)]

    def _at(self, step: str, collection: str, path: str) -> Record:
        r = self._held.get((collection, path))
        if r is None:
            raise NotFound(f"recommendation for {collection}.{path}")
        if r.status != STEPS[step][0]:
            raise InvalidState(f"a recommendation that is {r.status} cannot become {STEPS[step][1]}")
        return r

    def _step(self, step: str, collection: str, path: str, **more) -> None:
        r = self._at(step, collection, path)
        self._held[collection, path] = replace(r, status=STEPS[step][1], **more)

    def accept(self, collection: str, path: str) -> None:
        self._step("accept", collection, path)

    def dismiss(self, collection: str, path: str) -> None:
        self._step("dismiss", collection, path)

    def mark_applied(self, collection: str, path: str) -> None:
        self._step("mark_applied", collection, path)

    def evaluate(self, collection: str, path: str, later: DataFrame, min_index_scans: int = 3) -> Row:
        """The impact row of an applied recommendation, from the candidates of a later window."""
        if min_index_scans < 1:
            raise InvalidArgument("the number of observations must be above zero")
        r = self._at("evaluate", collection, path)
        one = later.filter((later["collection"] == collection) & (later["path"] == path))
        seen = one.first()
        if seen is None:
            raise NotFound(f"later telemetry for {collection}.{path}")
        if seen["index_scans"] < min_index_scans:
            raise InvalidState(f"{seen['index_scans']} index scans are too few to judge by, {min_index_scans} are wanted")
        told = impact(later.sparkSession.createDataFrame([r.recommendation], _SCHEMA), one, min_index_scans).first()
        self._step("evaluate", collection, path, evaluation=told)
        return told


_SCHEMA = (
    "collection string, path string, successful_executions decimal(20,0), collection_scans decimal(20,0), index_scans decimal(20,0), "
    "collection_scan_examined decimal(20,0), collection_scan_returned decimal(20,0), collection_scan_elapsed_micros decimal(20,0), return_ratio int"
)
