"""Documents by id: what a program, rather than a query, asks of a database; whole DataFrames at a time."""

from __future__ import annotations

from dataclasses import replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.errors import AlreadyExists, InvalidArgument, NotFound
from larkspur.operators.frame import ID, Frame, widened
from larkspur.plans.planner import IndexDefinition
from larkspur.sources.store import Snapshot


class Backend(Protocol):
    """What execution needs of storage; indexes are optional."""

    def scan(self, collection: str) -> Frame: ...
    def scan_index(self, collection: str, index: str, key) -> Frame: ...
    def insert(self, collection: str, documents: DataFrame) -> int: ...
    def replace(self, collection: str, documents: DataFrame) -> int: ...
    def delete(self, collection: str, ids: DataFrame) -> int: ...
    def create_collection(self, name: str) -> None: ...
    def drop_collection(self, name: str) -> None: ...
    def create_index(self, name: str, collection: str, path: tuple[str, ...]) -> None: ...
    def drop_index(self, name: str) -> None: ...
    def index_definitions(self) -> list[IndexDefinition]: ...


class DocumentApi:
    """The backend over an engine's database.  Documents are rows with their 16-byte id under `_id`."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def scan(self, collection: str) -> Frame:
        return self.engine.frame(collection)

    def scan_index(self, collection: str, index: str, key) -> Frame:
        frame = self.engine.frame(collection)
        return replace(frame, df=frame.df.join(self.engine.lookup(index, key), ID, "left_semi"))

    def _given(self, documents: DataFrame) -> Frame:
        if ID not in documents.columns or documents.schema[ID].dataType.simpleString() != "binary":
            raise InvalidArgument("documents need their ids, as binary, under _id")
        out = widened(documents)
        if out.filter(F.col(ID).isNull() | (F.length(ID) != 16)).limit(1).count():
            raise InvalidArgument("an id has 16 bytes")
        if out.groupBy(ID).count().filter("count > 1").limit(1).count():
            raise AlreadyExists("an id is given twice")
        return Frame(out, {f.name: f.dataType for f in out.schema.fields if f.name != ID})

    def insert(self, collection: str, documents: DataFrame) -> int:
        """Add documents; none is added if any id is there already."""
        new, old = self._given(documents), self.engine.frame(collection)
        if new.df.join(old.df.select(ID), ID, "left_semi").limit(1).count():
            raise AlreadyExists("a document with that id")
        part, n = self.engine.db.store.write_part(new)
        snapshot = self.engine.db.collections[collection]
        if n:
            self.engine._replace(collection, Snapshot((*snapshot.parts, part), self.engine.collection_len(collection) + n))
        return n

    def replace(self, collection: str, documents: DataFrame) -> int:
        """Put documents in the place of those with their ids; none is if any id is unknown."""
        new, old = self._given(documents), self.engine.frame(collection)
        if new.df.join(old.df.select(ID), ID, "left_anti").limit(1).count():
            raise NotFound("a document with that id")
        part, n = self.engine.db.store.write_part(new)
        rest, kept = self.engine.db.store.write_part(replace(old, df=old.df.join(new.df.select(ID), ID, "left_anti")))
        self.engine._replace(collection, Snapshot((rest, part), kept + n))
        return n

    def delete(self, collection: str, ids: DataFrame) -> int:
        """Take documents out by id; none goes if any id is unknown."""
        gone, old = ids.select(ID).distinct(), self.engine.frame(collection)
        if gone.join(old.df.select(ID), ID, "left_anti").limit(1).count():
            raise NotFound("a document with that id")
        before = self.engine.collection_len(collection)
        rest, kept = self.engine.db.store.write_part(replace(old, df=old.df.join(gone, ID, "left_anti")))
        self.engine._replace(collection, Snapshot((rest,), kept))
        return before - kept

    def get(self, collection: str, doc_id: bytes) -> Frame:
        frame = self.engine.frame(collection)
        return replace(frame, df=frame.df.filter(F.col(ID) == F.lit(bytes(doc_id))))

    def create_collection(self, name: str) -> None:
        self.engine.execute(f"create collection {name}")

    def drop_collection(self, name: str) -> None:
        self.engine.execute(f"drop collection {name}")

    def create_index(self, name: str, collection: str, path: tuple[str, ...]) -> None:
        self.engine.execute(f"create index {name} on {collection} ({'.'.join(path)})")

    def drop_index(self, name: str) -> None:
        self.engine.execute(f"drop index {name}")

    def index_definitions(self) -> list[IndexDefinition]:
        return self.engine.db.definitions()
