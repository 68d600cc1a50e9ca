"""The syntax tree of a query: plain immutable values.  Spans are ranges of UTF-8 bytes of the source."""

from __future__ import annotations

from dataclasses import dataclass, field

Span = tuple[int, int]


@dataclass(frozen=True)
class Path:
    """A dotted field path."""

    parts: tuple[str, ...]
    span: Span = field(default=(0, 0), compare=False)

    @property
    def text(self) -> str:
        return ".".join(self.parts)


class Expr:
    """Base of expressions."""


@dataclass(frozen=True)
class Literal(Expr):
    """kind is null, bool, int, float or string."""

    kind: str
    value: object
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class Read(Expr):
    path: Path
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class ArrayOf(Expr):
    items: tuple[Expr, ...]
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class ObjectOf(Expr):
    fields: tuple[tuple[str, Expr], ...]
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class Unary(Expr):
    """op is not, - or +."""

    op: str
    operand: Expr
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class Binary(Expr):
    """op is or, and, ==, !=, <, <=, >, >=, contains, +, -, *, / or %."""

    op: str
    left: Expr
    right: Expr
    span: Span = field(default=(0, 0), compare=False)


class Stage:
    """Base of pipeline stages; name is what plans and fingerprints show."""

    name = ""


@dataclass(frozen=True)
class Filter(Stage):
    predicate: Expr
    name = "filter"


@dataclass(frozen=True)
class Project(Stage):
    paths: tuple[Path, ...]
    name = "project"


@dataclass(frozen=True)
class Sort(Stage):
    """keys: (path, descending)."""

    keys: tuple[tuple[Path, bool], ...]
    name = "sort"


@dataclass(frozen=True)
class Limit(Stage):
    count: int
    name = "limit"


@dataclass(frozen=True)
class Skip(Stage):
    count: int
    name = "skip"


@dataclass(frozen=True)
class Assign(Stage):
    """pairs: (path, value)."""

    pairs: tuple[tuple[Path, Expr], ...]
    name = "set"


@dataclass(frozen=True)
class Command:
    """verb is get, insert, update, delete, create_collection, drop_collection, create_index or drop_index;
    target is the collection (or, for dropping an index, nothing)."""

    verb: str
    target: str | None = None
    name: str | None = None
    document: Expr | None = None
    paths: tuple[Path, ...] = ()


@dataclass(frozen=True)
class Query:
    command: Command
    stages: tuple[Stage, ...] = ()
    explain: bool = False
    span: Span = field(default=(0, 0), compare=False)
