"""A frame of documents: a DataFrame with the bookkeeping that the language needs.

Documents are rows with a hidden `_id`; a field that some rows lack is in `missing`, and the hidden column
__missing lists each row's absent paths (VARIANT fields need none: SQL NULL is their missing).  Where no
path can be missing there is no such column.  Order is kept as hidden sort keys and applied only where a
limit or a reader needs it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import InvalidArgument, Unsupported
from larkspur.functions import values as V
from larkspur.functions.compiler import compile_expr
from larkspur.plans.syntax import Assign, Filter, Limit, Path, Project, Skip, Sort, Stage

ID, ABSENT = "_id", "__missing"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    fields: dict[str, T.DataType]
    #: Paths that some rows may lack (dotted).
    missing: frozenset[str] = frozenset()
    #: Paths that may be null; None: any nullable one.
    nulls: frozenset[str] | None = None
    #: Hidden sort keys, the most significant first: (column, descending).
    order: tuple[tuple[str, bool], ...] = ()
    serial: int = 0

    # -- reading

    def may_null(self, dotted: str, nullable: bool) -> bool:
        return nullable if self.nulls is None else dotted in self.nulls

    def absent(self, dotted: str) -> Column | None:
        return F.array_contains(F.col(ABSENT), dotted) if dotted in self.missing else None

    def read(self, parts: tuple[str, ...]) -> V.Value:
        """The value of a path; `_id` alone is the document's id."""
        if parts == (ID,):
            return V.Value({"id": None}, {"id": F.col(ID)}, {"id": T.BinaryType()})
        dtype = self.fields.get(parts[0])
        if dtype is None:
            return V.missing()
        col, gone, dotted = quoted(parts[0]), self.absent(parts[0]), parts[0]
        for k, name in enumerate(parts[1:], 1):
            if isinstance(dtype, T.VariantType):
                for rest in parts[k:]:
                    col = V.variant_part(col, rest)
                return V.of_column(col, T.VariantType(), True, None)
            if not isinstance(dtype, T.StructType) or name not in dtype.fieldNames():
                return V.missing()
            # below a null or missing parent everything is missing
            if self.may_null(dotted, True):
                gone = col.isNull() if gone is None else gone | col.isNull()
            dotted += "." + name
            own = self.absent(dotted)
            gone = own if gone is None else gone if own is None else gone | own
            dtype = dtype[name].dataType
            col = col.getField(name)
        return V.of_column(col, dtype, self.may_null(dotted, True), gone)

    def document_columns(self) -> list[Column]:
        return [quoted(n) for n in sorted(self.fields)]

    def ordered(self) -> DataFrame:
        """The rows in result order: the frozen sort keys, then ids."""
        return self.df.orderBy(*[self.key(c, d) for c, d in self.order], F.col(ID).asc())

    def key(self, name: str, down: bool) -> Column:
        return quoted(name).desc_nulls_last() if down else quoted(name).asc_nulls_first()

    def visible(self, ordered: bool = False, ids: bool = False) -> DataFrame:
        """Just the documents' fields, by name."""
        df = self.ordered() if ordered else self.df
        return df.select(*([F.col(ID)] if ids else []), *self.document_columns())

    def hidden(self) -> list[str]:
        return [ID, *([ABSENT] if self.missing else []), *[c for c, _ in self.order]]

    # -- stages

    def run(self, stages: tuple[Stage, ...]) -> Frame:
        frame, k = self, 0
        while k < len(stages):
            s, after = stages[k], stages[k + 1] if k + 1 < len(stages) else None
            if isinstance(s, Skip) and isinstance(after, Limit) and s.count + after.count < 1 << 31:
                # a page of a sorted frame is a top-k that drops its first rows: no full sort
                frame = replace(frame, df=frame.ordered().limit(s.count + after.count).offset(s.count))
                k += 2
                continue
            frame = _STAGES[type(s)](frame, s)
            k += 1
        return frame

    def condition(self, stage: Filter) -> Column:
        col, err = V.as_bool(compile_expr(stage.predicate, self), "predicate")
        return V.checked(col, err)

    def filtered(self, stage: Filter) -> Frame:
        return replace(self, df=self.df.filter(self.condition(stage)))

    def sorted(self, stage: Sort) -> Frame:
        """Freeze the keys as they are now: later stages may change what they came from.

        Missing sorts below null, null below all values; a key of several kinds fails, as do arrays and objects."""
        df, keys, n = self.df, [], self.serial
        for path, down in stage.keys:
            v = self.read(path.parts)
            kinds = [k for k in v.tests if k not in (V.MISSING, V.NULL)]
            if not kinds:
                continue
            if len(kinds) > 1:
                kinds = self._kinds_present(v, path)
            if not kinds:
                continue
            k = kinds[0]
            if k in ("array", "object"):
                if v.sure == k or self.df.filter(v.test(k)).limit(1).count():
                    if self.df.limit(1).count():
                        raise InvalidArgument(V.MARK + f"{path.text} holds {k}s, which have no order")
                continue
            col = v.cols[k]
            if k == "bool" or v.sure != k:
                rank = F.when(v.test(V.MISSING), F.lit(0)).when(v.test(V.NULL), F.lit(1)).otherwise(F.lit(2)) if V.MISSING in v.tests else None
                if rank is not None:
                    df = df.withColumn(f"__o{n}", rank)
                    keys.append((f"__o{n}", down))
                    n += 1
                col = F.when(v.test(k), col)
            df = df.withColumn(f"__o{n}", col)
            keys.append((f"__o{n}", down))
            n += 1
        # a later sort is the more significant; the earlier one breaks its ties
        return replace(self, df=df, order=(*keys, *self.order), serial=n)

    def _kinds_present(self, v: V.Value, path: Path) -> list[str]:
        """Which kinds a VARIANT key really has: one aggregation over it."""
        kinds = [k for k in v.tests if k not in (V.MISSING, V.NULL)]
        row = self.df.agg(*[F.max(v.test(k)).alias(k) for k in kinds]).first()
        there = [k for k in kinds if row[k]]
        if len(there) > 1:
            raise InvalidArgument(V.MARK + f"{path.text} holds {' and '.join(there)}, which have no common order")
        return there

    def limited(self, stage: Limit) -> Frame:
        return replace(self, df=self.ordered().limit(min(stage.count, (1 << 31) - 1)))

    def skipped(self, stage: Skip) -> Frame:
        return replace(self, df=self.ordered().offset(min(stage.count, (1 << 31) - 1)))

    def projected(self, stage: Project) -> Frame:
        """Only the listed paths; what a nested path does not name is cut out of its parents."""
        tree: dict = {}
        for p in stage.paths:
            if p.parts == (ID,) or p.parts[0] not in self.fields:
                continue
            at = tree
            for k, name in enumerate(p.parts):
                if at.get(name, 0) is None:
                    break  # the whole parent is in already
                if k == len(p.parts) - 1:
                    at[name] = None
                else:
                    at = at.setdefault(name, {})
        fields, cols, gone, missing = {}, [], [], set()
        for name in sorted(tree):
            dtype = self.fields[name]
            v = self.read((name,))
            if tree[name] is None:
                fields[name] = dtype
                cols.append(quoted(name))
                missing |= {m for m in self.missing if m == name or m.startswith(name + ".")}
                continue
            if isinstance(dtype, T.VariantType):
                raise Unsupported("projection below a field of several kinds")
            if not isinstance(dtype, T.StructType):
                continue
            col, kept = self._cut(quoted(name), dtype, tree[name])
            fields[name] = kept
            if v.sure != "object":
                # a parent that is null or missing leaves nothing
                cols.append(F.when(v.test("object"), col).alias(name))
                gone.append((name, ~v.test("object")))
                missing.add(name)
            else:
                cols.append(col.alias(name))
            missing |= {m for m in self.missing if m.startswith(name + ".")}
        df = self.df
        if gone or missing:
            old = F.col(ABSENT) if self.missing else F.array().cast("array<string>")
            extra = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in gone])) if gone else F.array().cast("array<string>")
            # the cut parents' own marks are told anew
            df = df.withColumn(ABSENT, F.array_union(old, extra))
        hidden = [ID, *([ABSENT] if missing else []), *[c for c, _ in self.order]]
        return replace(self, df=df.select(*hidden, *cols), fields=fields, missing=frozenset(missing))

    def _cut(self, col: Column, dtype: T.StructType, tree: dict) -> tuple[Column, T.StructType]:
        cols, types = [], []
        for name in sorted(tree):
            if name not in dtype.fieldNames():
                continue
            t = dtype[name].dataType
            if tree[name] is None:
                cols.append(col.getField(name).alias(name))
            elif isinstance(t, T.StructType):
                inner, t = self._cut(col.getField(name), t, tree[name])
                cols.append(F.when(col.getField(name).isNotNull(), inner).alias(name))
            else:
                continue
            types.append(T.StructField(name, t, True))
        return (F.struct(*cols) if cols else F.expr("named_struct()")), T.StructType(types)

    def assigned(self, stage: Assign) -> Frame:
        frame = self
        for path, e in stage.pairs:
            frame = frame._set(path.parts, compile_expr(e, frame))
        return frame

    def _set(self, parts: tuple[str, ...], v: V.Value) -> Frame:
        if parts[0] == ID:
            raise InvalidArgument(V.MARK + "the id cannot be set")
        col, dtype, may_null = V.stored(v)
        name, dotted = parts[0], ".".join(parts)
        fields, nulls, missing, df = dict(self.fields), self.nulls, set(self.missing), self.df
        marks: list[tuple[str, Column]] = []  # paths that become absent, and where
        if len(parts) == 1:
            fields[name], new = dtype, col
            cleared = {m for m in missing if m == name or m.startswith(name + ".")}
        else:
            new, fields[name], marks = self._nest(name, quoted(name) if name in fields else None, fields.get(name), parts[1:], col, dtype)
            cleared = {m for m in missing if dotted.startswith(m + ".") or m == dotted or m.startswith(dotted + ".")}
        if cleared or marks:
            old = F.col(ABSENT) if self.missing else F.array().cast("array<string>")
            kept = F.filter(old, lambda p: ~p.isin(*sorted(cleared))) if cleared else old
            extra = [F.when(test, F.lit(p)) for p, test in marks]
            df = df.withColumn("__marks", F.array_union(kept, F.array_compact(F.array(*extra))) if extra else kept)
        df = df.withColumn(name, new)
        missing = (missing - cleared) | {p for p, _ in marks}
        if cleared or marks:
            df = df.drop(ABSENT).withColumnRenamed("__marks", ABSENT) if missing else df.drop(ABSENT, "__marks")
        if nulls is not None:
            nulls = frozenset({x for x in nulls if x != dotted} | ({dotted} if may_null else set()))
        return replace(self, df=df, fields=fields, missing=frozenset(missing), nulls=nulls)

    def _nest(self, at: str, col: Column | None, dtype, rest: tuple[str, ...], value: Column, vtype) -> tuple[Column, T.DataType, list]:
        """A column with value at the path rest below it; parents that are missing are made."""
        made, made_type = value, vtype
        for name in reversed(rest):
            made, made_type = F.struct(made.alias(name)), T.StructType([T.StructField(name, made_type, True)])
        if dtype is None:
            return made, made_type, []
        if isinstance(dtype, T.VariantType):
            raise Unsupported("assignment below a field of several kinds")
        scalar = F.raise_error(F.lit(V.MARK + f"{at} is not a document"))
        if not isinstance(dtype, T.StructType):
            gone = self.absent(at)
            if gone is None:
                return F.when(F.lit(True), scalar.cast(dtype)).otherwise(quoted(at.split(".")[0])), dtype, []
            raise Unsupported(f"assignment below {at}, which is a document in some rows only")
        first, marks = rest[0], []
        inner = dtype[first].dataType if first in dtype.fieldNames() else None
        if len(rest) == 1:
            leaf, leaf_type = value, vtype
        else:
            leaf, leaf_type, marks = self._nest(f"{at}.{first}", col.getField(first) if inner is not None else None, inner, rest[1:], value, vtype)
        kept = [f for f in dtype.fields if f.name != first]
        names = sorted([*kept, T.StructField(first, leaf_type, True)], key=lambda f: f.name)
        full = F.struct(*[(leaf if f.name == first else col.getField(f.name)).alias(f.name) for f in names])
        gone = self.absent(at)
        out_type = T.StructType(names)
        if gone is not None:
            bare = F.struct(*[(value if f.name == first and len(rest) == 1 else F.lit(None).cast(f.dataType)).alias(f.name) for f in names])
            marks += [(f"{at}.{f.name}", gone) for f in kept]
            full = F.when(gone, bare).when(col.isNull(), scalar.cast(out_type)).otherwise(full)
        elif self.may_null(at, True):
            full = F.when(col.isNull(), scalar.cast(out_type)).otherwise(full)
        return full, out_type, marks


_STAGES = {Filter: Frame.filtered, Sort: Frame.sorted, Limit: Frame.limited, Skip: Frame.skipped, Project: Frame.projected, Assign: Frame.assigned}


def widened(df: DataFrame) -> DataFrame:
    """Columns in the language's types: whole numbers as long, other numbers as double, dates as timestamps."""
    return df.select(*[quoted(f.name).cast(_wide(f.dataType)).alias(f.name) for f in df.schema.fields])


def _wide(t: T.DataType) -> T.DataType:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return T.LongType()
    if isinstance(t, (T.FloatType, T.DecimalType)):
        return T.DoubleType()
    if isinstance(t, (T.DateType, T.TimestampNTZType)):
        return T.TimestampType()
    if isinstance(t, (T.CharType, T.VarcharType)):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_wide(t.elementType), t.containsNull)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _wide(f.dataType), f.nullable) for f in t.fields])
    return t
