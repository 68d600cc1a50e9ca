"""The engine: query text in, typed results out."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import AlreadyExists, EngineError, InvalidArgument, NotFound, Unsupported
from larkspur.functions import values as V
from larkspur.functions.compiler import compile_expr
from larkspur.operators import index as ix
from larkspur.operators.frame import ABSENT, ID, Frame, quoted, widened
from larkspur.plans.parser import parse
from larkspur.plans.planner import IndexDefinition, Plan, plan
from larkspur.plans.syntax import Assign, Filter, Limit, ObjectOf, Project, Query, Skip
from larkspur.security import Guard
from larkspur.sources.ids import fresh_id, key_id
from larkspur.sources.store import Database, Part, Snapshot, Store
from larkspur.workload.telemetry import event_of

#: A candidate list of so many ids at most is sent to all executors.
BROADCAST_IDS = 100_000


@dataclass(frozen=True)
class Documents:
    """Documents as a frame; df has their fields, in no order; rows() has them in result order."""

    frame: Frame

    @property
    def df(self) -> DataFrame:
        return self.frame.visible()

    def ordered(self) -> DataFrame:
        return self.frame.visible(ordered=True)

    def rows(self) -> list[dict]:
        """All documents in order, each with its id under `_id` and without the fields that it lacks."""
        f = self.frame
        df = f.ordered().select(ID, *([ABSENT] if f.missing else []), *f.document_columns())
        out = []
        for r in _told(df.collect):
            gone = set(r[ABSENT]) if f.missing else set()
            out.append({ID: bytes(r[ID]), **_plain({n: r[n] for n in sorted(f.fields)}, gone, {n for n, t in f.fields.items() if isinstance(t, T.VariantType)})})
        return out

    def count(self) -> int:
        return _told(self.frame.df.count)


@dataclass(frozen=True)
class Inserted:
    id: bytes


@dataclass(frozen=True)
class Updated:
    count: int


@dataclass(frozen=True)
class Deleted:
    count: int


@dataclass(frozen=True)
class CollectionCreated:
    name: str


@dataclass(frozen=True)
class CollectionDropped:
    name: str


@dataclass(frozen=True)
class IndexCreated:
    name: str


@dataclass(frozen=True)
class IndexDropped:
    name: str


@dataclass(frozen=True)
class Explained:
    text: str


def _plain(row: dict, gone: set[str], variants: set[str], at: str = "") -> dict:
    out = {}
    for k, v in row.items():
        path = f"{at}.{k}" if at else k
        if path in gone or (v is None and k in variants and not at):
            continue
        if hasattr(v, "asDict"):
            v = _plain({n: v[n] for n in sorted(v.__fields__)}, gone, set(), path)
        elif hasattr(v, "toPython"):
            v = v.toPython()
        out[k] = v
    return out


def _told(action):
    """Run an action; a row's own failure comes back as the engine's error."""
    try:
        return action()
    except PySparkException as e:
        text = str(e)
        at = text.find(V.MARK)
        if at < 0:
            raise
        raise InvalidArgument(text[at:].split("\n")[0].split(" SQLSTATE")[0].rstrip(". ")) from e


class Engine:
    """A database of document collections over a Spark session.

    telemetry: a sink whose record() gets an event for every execution; guard: checks a token's right to
    each command (None: everyone may do everything)."""

    def __init__(self, spark: SparkSession, root: str | None = None, telemetry=None, guard: Guard | None = None):
        self.spark = spark
        self.db = Database.open(Store(spark, root))
        self.telemetry, self.guard = telemetry, guard

    # -- collections from outside

    def attach(self, name: str, df: DataFrame, keys: tuple[str, ...] = (), rename: dict[str, str] | None = None, non_null: tuple[str, ...] | str | None = None) -> None:
        """Make a DataFrame a collection without copying it.

        keys name the columns that ids (and so the default order) are made of; rename maps columns whose
        names are reserved words; non_null lists the columns that hold no nulls ("check": find out with one
        aggregation), whose predicates then need no null handling."""
        if name in self.db.collections:
            raise AlreadyExists(f"collection {name}")
        out = widened(df.withColumnsRenamed(rename or {}))
        fields = {f.name: f.dataType for f in out.schema.fields}
        doc_id = key_id(*keys) if keys else F.concat(F.unhex(F.lpad(F.hex(F.xxhash64(*out.columns)), 16, "0")), F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(1), *out.columns)), 16, "0")))
        nulls = None
        if non_null == "check":
            row = df.withColumnsRenamed(rename or {}).agg(F.count(F.lit(1)).alias("__n"), *[F.count(quoted(c)).alias(c) for c in fields]).first()
            nulls = frozenset(c for c in fields if row[c] < row["__n"]) | _inner(fields)
        elif non_null is not None:
            nulls = (frozenset(fields) - frozenset(non_null)) | _inner(fields)
        out = out.select(doc_id.alias(ID), *[quoted(c) for c in fields])
        part = Part(None, out.schema.json(), tuple(sorted(fields)), (), None if nulls is None else tuple(sorted(nulls)), out)
        self.db.collections[name] = Snapshot((part,), -1)

    def frame(self, name: str) -> Frame:
        if name not in self.db.collections:
            raise NotFound(f"collection {name}")
        return self.db.collections[name].frame(self.spark)

    def collection_count(self) -> int:
        return len(self.db.collections)

    def collection_len(self, name: str) -> int:
        s = self.db.collections.get(name)
        if s is None:
            raise NotFound(f"collection {name}")
        return s.count if s.count >= 0 else self.frame(name).df.count()

    # -- execution

    def execute(self, source: str | Query, token: str | None = None):
        """The result of one query."""
        query = parse(source) if isinstance(source, str) else source
        if self.guard is not None:
            self.guard.check(token, query.command.verb)
        began = time.perf_counter_ns()
        chosen = plan(query, self.db.definitions())
        seen = {"examined": 0}
        if self.telemetry is None:
            return self._run(query, chosen, seen)
        result, error, size = None, None, 0
        try:
            result = self._run(query, chosen, seen, counted=True)
            # an execution is over when its rows are known: counting runs the query
            size = _size(result)
        except EngineError as e:
            error = e
        try:
            self.telemetry.record(event_of(query, chosen, seen["examined"], size, (time.perf_counter_ns() - began) // 1000, error is None))
        except Exception:  # noqa: BLE001  an observer never changes a result
            pass
        if error is not None:
            raise error
        return result

    def _run(self, query: Query, chosen: Plan, seen: dict, counted: bool = False):
        c = query.command
        if query.explain:
            return Explained(str(chosen))
        if c.verb in ("get", "update", "delete"):
            banned = {"get": (Assign,), "update": (Project,), "delete": (Project, Assign)}[c.verb]
            if any(isinstance(s, banned) for s in query.stages):
                raise InvalidArgument(V.MARK + "pipeline stage is not valid for this command")
            base = self._access(chosen, c.target, seen, counted)
            return {"get": self._get, "update": self._update, "delete": self._delete}[c.verb](query, base)
        return getattr(self, f"_{c.verb}")(query)

    def _access(self, chosen: Plan, name: str, seen: dict, counted: bool) -> Frame:
        frame = self.frame(name)
        if chosen.access != "index_scan":
            if counted:
                seen["examined"] = self.collection_len(name)
            return frame
        ids = ix.exact(self.side_table(chosen.index.name), chosen.key)
        n = ids.count()
        seen["examined"] = n
        return replace(frame, df=frame.df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, ID, "left_semi"))

    def _get(self, query: Query, base: Frame) -> Documents:
        return Documents(base.run(query.stages))

    def _split(self, query: Query, base: Frame, chosen: Frame) -> Frame:
        """The rows that the pipeline does not select, without a join where a predicate alone selects."""
        if not any(isinstance(s, (Limit, Skip)) for s in query.stages):
            first = next((s for s in query.stages if isinstance(s, Filter)), None)
            whole = self.frame(query.command.target)
            if first is None:
                return replace(whole, df=whole.df.limit(0))
            return replace(whole, df=whole.df.filter(~whole.condition(first)))
        whole = self.frame(query.command.target)
        return replace(whole, df=whole.df.join(chosen.df.select(ID), ID, "left_anti"))

    def _update(self, query: Query, base: Frame) -> Updated:
        name = query.command.target
        part, count = _told(lambda: self.db.store.write_part(base.run(query.stages)))
        if not count:
            return Updated(0)
        fixed = part.frame(self.spark)
        rest, kept = _told(lambda: self.db.store.write_part(self._split(query, base, fixed)))
        self._replace(name, Snapshot((rest, part) if kept else (part,), kept + count))
        return Updated(count)

    def _delete(self, query: Query, base: Frame) -> Deleted:
        name = query.command.target
        before = self.collection_len(name)
        gone = base.run(query.stages)
        rest, kept = _told(lambda: self.db.store.write_part(self._split(query, base, gone)))
        if kept == before:
            return Deleted(0)
        self._replace(name, Snapshot((rest,), kept))
        return Deleted(before - kept)

    def _replace(self, name: str, snapshot: Snapshot) -> None:
        """Commit a collection's new snapshot with its indexes; a key that cannot be indexed stops both."""
        frame = snapshot.frame(self.spark)
        indexes = dict(self.db.indexes)
        for n, (d, _) in self.db.indexes.items():
            if d.collection == name:
                indexes[n] = (d, (self._write_side(frame, d),))
        self.db.changed({**self.db.collections, name: snapshot}, indexes)

    def _insert(self, query: Query) -> Inserted:
        name, document = query.command.target, query.command.document
        if not isinstance(document, ObjectOf):
            raise InvalidArgument(V.MARK + "insert requires an object")
        old = self.frame(name)
        # expressions see an empty document whose id is all zeros
        empty = Frame(self.spark.range(1).select(F.lit(bytes(16)).alias(ID)), {})
        new_id = fresh_id()
        cols, fields, nulls = [], {}, set()
        for key, e in document.fields:
            if key == ID:
                continue  # a field that no path can read
            v = compile_expr(e, empty)
            col, dtype, may_null = V.stored(v)
            have = old.fields.get(key)
            if v.sure == V.NULL and have is not None:
                col, dtype = (F.lit(None).cast(have), have) if not isinstance(have, T.VariantType) else (col, dtype)
            fields[key] = dtype
            cols.append(col.alias(key))
            if may_null or v.sure == V.NULL:
                nulls.add(key)
        df = empty.df.select(*cols, F.lit(new_id).alias("__new")).withColumnRenamed("__new", ID)
        frame = Frame(df.select(ID, *[quoted(k) for k in fields]), fields, nulls=frozenset(nulls) | _inner(fields))
        part, _ = _told(lambda: self.db.store.write_part(frame))
        snapshot = self.db.collections[name]
        indexes = dict(self.db.indexes)
        for n, (d, folders) in self.db.indexes.items():
            if d.collection == name:
                indexes[n] = (d, (*folders, self._write_side(part.frame(self.spark), d)))
        grown = Snapshot((*snapshot.parts, part), (snapshot.count if snapshot.count >= 0 else self.collection_len(name)) + 1)
        self.db.changed({**self.db.collections, name: grown}, indexes)
        return Inserted(new_id)

    def _create_collection(self, query: Query) -> CollectionCreated:
        name = query.command.target
        if name in self.db.collections:
            raise AlreadyExists(f"collection {name}")
        self.db.changed({**self.db.collections, name: Snapshot()})
        return CollectionCreated(name)

    def _drop_collection(self, query: Query) -> CollectionDropped:
        name = query.command.target
        if name not in self.db.collections:
            raise NotFound(f"collection {name}")
        self.db.changed({n: s for n, s in self.db.collections.items() if n != name}, {n: x for n, x in self.db.indexes.items() if x[0].collection != name})
        return CollectionDropped(name)

    # -- indexes

    def _create_index(self, query: Query) -> IndexCreated:
        c = query.command
        if len(c.paths) != 1:
            raise Unsupported("an index has one path")
        for word in (c.name, c.target, *c.paths[0].parts):
            if not word or not all(ch == "_" or ch.isalnum() for ch in word):
                raise InvalidArgument(f"invalid identifier {word!r}")
        if c.name in self.db.indexes:
            raise AlreadyExists(f"index {c.name}")
        d = IndexDefinition(c.name, c.target, c.paths[0].parts)
        folder = self._write_side(self.frame(c.target), d)
        self.db.changed(indexes={**self.db.indexes, c.name: (d, (folder,))})
        return IndexCreated(c.name)

    def _drop_index(self, query: Query) -> IndexDropped:
        name = query.command.name
        if name not in self.db.indexes:
            raise NotFound(f"index {name}")
        self.db.changed(indexes={n: x for n, x in self.db.indexes.items() if n != name})
        return IndexDropped(name)

    def _write_side(self, frame: Frame, d: IndexDefinition) -> str:
        # sorted within files: a key's entries sit in few row groups
        rows = ix.entries(frame, d.path).sortWithinPartitions("rank", *[f"key_{k}" for k in ix.KEYS])
        return self.db.store.write("indexes", rows)[0]

    def side_table(self, name: str) -> DataFrame:
        if name not in self.db.indexes:
            raise NotFound(f"index {name}")
        cols = ", ".join(f"key_{k} {t}" for k, t in ix.KEYS.items())
        return self.spark.read.schema(f"rank int, {cols}, {ID} binary").parquet(*self.db.indexes[name][1])

    def lookup(self, name: str, value) -> DataFrame:
        """Ids with exactly the key, ascending."""
        return ix.exact(self.side_table(name), ix.key_literal(value)).orderBy(ID)

    def lookup_range(self, name: str, low, high) -> DataFrame:
        """Entries from low to high, both included, in key order."""
        return ix.between(self.side_table(name), ix.key_literal(low), ix.key_literal(high))

    def verify_index(self, name: str) -> DataFrame:
        """(fault, entries) rows; none if the index agrees with its collection."""
        d, _ = self.db.indexes[name]
        return ix.faults(self.side_table(name), self.frame(d.collection), d.path)

    def vacuum(self) -> int:
        """Delete what older versions alone refer to."""
        live = {p.path for s in self.db.collections.values() for p in s.parts if p.path} | {f for _, fs in self.db.indexes.values() for f in fs}
        return self.db.store.vacuum(live)


def _inner(fields: dict[str, T.DataType], at: str = "") -> frozenset[str]:
    """All paths below struct fields: nothing is known of their nulls."""
    out: set[str] = set()
    for n, t in fields.items():
        if isinstance(t, T.StructType):
            inner = {f.name: f.dataType for f in t.fields}
            out |= {f"{at}{n}.{k}" for k in inner} | _inner(inner, f"{at}{n}.")
    return frozenset(out)


def _size(result) -> int:
    """Returned rows, as telemetry counts them."""
    if isinstance(result, Documents):
        return result.count()
    if isinstance(result, Inserted):
        return 1
    return result.count if isinstance(result, (Updated, Deleted)) else 0
