"""Typed values as columns.

The language knows ten kinds and never converts between them; missing is not null and null equals null.  A
Value says which kinds an expression can have, how to tell at run time (a never-null boolean column a kind),
the typed column for each, and a message column for rows whose evaluation must fail.  Kinds that the schema
settles cost nothing: a comparison of a column with a literal of its kind is a plain, pushable predicate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING, NULL = "missing", "null"
#: Kinds with an order; only equal ones can be compared.
ORDERED = ("int", "float", "string", "timestamp", "id")
_KIND_OF = {T.BooleanType: "bool", T.LongType: "int", T.DoubleType: "float", T.StringType: "string", T.TimestampType: "timestamp", T.BinaryType: "id", T.ArrayType: "array", T.StructType: "object"}
_VARIANT = {"bool": "BOOLEAN", "int": "BIGINT", "float": "DOUBLE", "string": "STRING", "timestamp": "TIMESTAMP", "id": "BINARY"}


def kind_of(dtype: T.DataType) -> str | None:
    """The kind that a column type holds; None for VARIANT, which holds any."""
    return _KIND_OF.get(type(dtype))


@dataclass
class Value:
    """tests: kind -> whether the row has that kind; cols: kind -> typed column; err: message, null if fine."""

    tests: dict[str, Column | None]
    cols: dict[str, Column] = field(default_factory=dict)
    types: dict[str, T.DataType] = field(default_factory=dict)
    err: Column | None = None
    literal: object = None
    is_literal: bool = False

    @property
    def kinds(self) -> set[str]:
        return set(self.tests)

    def test(self, kind: str) -> Column:
        """Whether the row has the kind (true where that is settled)."""
        if kind not in self.tests:
            return F.lit(False)
        t = self.tests[kind]
        return F.lit(True) if t is None else t

    @property
    def sure(self) -> str | None:
        """The only kind that it can have."""
        return next(iter(self.tests)) if len(self.tests) == 1 else None


def both(a: Column | None, b: Column | None) -> Column | None:
    return a if b is None else b if a is None else a & b


def first_error(*errs: Column | None) -> Column | None:
    got = [e for e in errs if e is not None]
    return None if not got else got[0] if len(got) == 1 else F.coalesce(*got)


def missing() -> Value:
    return Value({MISSING: None})


def null() -> Value:
    return Value({NULL: None}, is_literal=True)


def constant(kind: str, value) -> Value:
    types = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType()}
    return Value({kind: None}, {kind: F.lit(value).cast(types[kind])}, {kind: types[kind]}, literal=value, is_literal=True)


def of_bool(col: Column, err: Column | None = None) -> Value:
    return Value({"bool": None}, {"bool": col}, {"bool": T.BooleanType()}, err)


def of_column(col: Column, dtype: T.DataType, may_null: bool, absent: Column | None) -> Value:
    """The value of a stored column; absent tells the rows where the field is missing (None: nowhere)."""
    if isinstance(dtype, T.VariantType):
        return _of_variant(col)
    kind = kind_of(dtype)
    here = None if absent is None else ~absent
    tests: dict[str, Column | None] = {kind: here}
    if may_null:
        tests[kind] = both(here, col.isNotNull())
        tests[NULL] = both(here, col.isNull())
    if absent is not None:
        tests[MISSING] = absent
    return Value(tests, {kind: col}, {kind: dtype})


def _of_variant(col: Column) -> Value:
    """Missing is SQL NULL, null is the variant null, all else is asked of the value itself."""
    shape = F.schema_of_variant(col)
    here = col.isNotNull()
    tests: dict[str, Column | None] = {MISSING: col.isNull(), NULL: here & F.is_variant_null(col)}
    cols, types = {}, {}
    for kind, name in _VARIANT.items():
        tests[kind] = here & (shape == name)
        types[kind] = next(t for t, k in _KIND_OF.items() if k == kind)()
        cols[kind] = F.try_variant_get(col, "$", types[kind].simpleString())
    for kind, name in (("array", "ARRAY"), ("object", "OBJECT")):
        tests[kind] = here & shape.startswith(name)
        cols[kind], types[kind] = col, T.VariantType()
    return Value(tests, cols, types)


def variant_part(col: Column, name: str) -> Column:
    """A field of a VARIANT object as VARIANT; SQL NULL where there is none."""
    return F.when(F.schema_of_variant(col).startswith("OBJECT"), F.try_variant_get(col, "$['" + name.replace("'", "\\'") + "']", "variant"))


def _same(kind: str, a: Value, b: Value) -> Column:
    """Equality of two values of one kind."""
    x, y = a.cols[kind], b.cols[kind]
    if kind in ("array", "object"):
        s, t = a.types[kind], b.types[kind]
        if isinstance(s, T.VariantType) or isinstance(t, T.VariantType):
            return F.to_json(x if isinstance(s, T.VariantType) else F.to_variant_object(x)) == F.to_json(y if isinstance(t, T.VariantType) else F.to_variant_object(y))
        if s.simpleString() != t.simpleString():
            empty = kind == "array" and (F.size(x) == 0) & (F.size(y) == 0)
            return empty if kind == "array" else F.lit(False)
        return x == y
    if kind == "float" and not (a.is_literal or b.is_literal):
        return (x == y) & ~F.isnan(x)  # SQL holds NaN equal to itself
    return x == y


def equal(a: Value, b: Value) -> Value:
    """Equal kind and equal content; never fails by itself."""
    err = first_error(a.err, b.err)
    for x, y in ((a, b), (b, a)):
        if y.is_literal and y.sure not in (None, NULL) and not x.is_literal and y.sure not in ("array", "object"):
            k = y.sure
            if k not in x.tests:
                return of_bool(F.lit(False), err)
            if set(x.tests) <= {k, NULL, MISSING}:
                # null and missing rows hold SQL NULL: a null-safe comparison is all it takes
                return of_bool(x.cols[k].eqNullSafe(y.cols[k]), err)
    cases = []
    for k in sorted(a.kinds & b.kinds):
        guard = both(a.tests[k], b.tests[k])
        same = F.lit(True) if k in (MISSING, NULL) else _same(k, a, b)
        cases.append(same if guard is None else F.when(guard, same).otherwise(False))
    out = F.lit(False)
    for c in cases:
        out = c if out is None or len(cases) == 1 else out | c
    return of_bool(F.coalesce(out, F.lit(False)), err)


def compare(op: str, a: Value, b: Value) -> Value:
    """Order of two values of one ordered kind; anything else fails."""
    shared = [k for k in ORDERED if k in a.tests and k in b.tests]
    err = first_error(a.err, b.err)
    ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    message = F.lit(f"values of these kinds have no order for `{op}`")
    if not shared:
        return of_bool(F.lit(False), first_error(err, message))
    if a.sure and a.sure == b.sure:
        return of_bool(ops[op](a.cols[a.sure], b.cols[a.sure]), err)
    ok, out = F.lit(False), F.lit(False)
    for k in shared:
        guard = a.test(k) & b.test(k)
        ok = ok | guard
        out = F.when(guard, ops[op](a.cols[k], b.cols[k])).otherwise(out)
    return of_bool(out, first_error(err, F.when(~ok, message)))


def as_bool(v: Value, what: str) -> tuple[Column, Column | None]:
    """The boolean column, and the failure of rows that are not boolean."""
    if v.sure == "bool":
        return v.cols["bool"], v.err
    if "bool" not in v.tests:
        return F.lit(False), first_error(v.err, F.lit(f"{what} must be boolean"))
    bad = F.when(~v.test("bool"), F.lit(f"{what} must be boolean"))
    return F.coalesce(v.cols["bool"], F.lit(False)), first_error(v.err, bad)


def conjunction(op: str, a: Value, b: Value) -> Value:
    """Short-circuit `and` / `or`: the right side can fail only where the left does not decide."""
    x, ex = as_bool(a, f"left side of `{op}`")
    y, ey = as_bool(b, f"right side of `{op}`")
    if ex is None and ey is None:
        return of_bool(x & y if op == "and" else x | y)
    out = F.when(x, y).otherwise(False) if op == "and" else F.when(x, True).otherwise(y)
    late = None if ey is None else F.when(x if op == "and" else ~x, ey)
    return of_bool(out, first_error(ex, late))


def negation(v: Value) -> Value:
    x, err = as_bool(v, "operand of `not`")
    return of_bool(~x, err)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Checked integers, finite floats; nothing else and never mixed."""
    err = first_error(a.err, b.err)
    tests, cols, types, fails = {}, {}, {}, []
    for k in ("int", "float"):
        if k in a.tests and k in b.tests:
            guard = both(a.tests[k], b.tests[k])
            col, bad = _ARITH[k](op, a.cols[k], b.cols[k], b.literal if b.is_literal else None)
            tests[k], cols[k], types[k] = guard, col, T.LongType() if k == "int" else T.DoubleType()
            if bad is not None:
                fails.append(bad if guard is None else F.when(guard, bad))
    if not tests:
        return Value({"int": None}, {"int": F.lit(None).cast("long")}, {"int": T.LongType()}, first_error(err, F.lit(f"operands of `{op}` must be two integers or two floats")))
    if any(t is not None for t in tests.values()):
        ok = F.lit(False)
        for t in tests.values():
            ok = ok | t
        fails.insert(0, F.when(~ok, F.lit(f"operands of `{op}` must be two integers or two floats")))
    if len(tests) == 1:
        tests = dict.fromkeys(tests)
    return Value(tests, cols, types, first_error(err, *fails))


def _ints(op: str, x: Column, y: Column, known) -> tuple[Column, Column | None]:
    over = F.lit("integer arithmetic overflows")
    if op in "+-*":
        out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        return out, F.when(out.isNull() & x.isNotNull() & y.isNotNull(), over)
    if known is not None and known not in (0, -1):
        return (F.call_function("div", x, y) if op == "/" else x % y), None
    bad = F.when(y == 0, F.lit("division by zero")).when((y == -1) & (x == F.lit(-(1 << 63)).cast("long")), over)
    safe = F.when((y == 0) | ((y == -1) & (x == F.lit(-(1 << 63)).cast("long"))), F.lit(1)).otherwise(y)
    return (F.call_function("div", x, safe) if op == "/" else x % safe), bad


def _floats(op: str, x: Column, y: Column, known) -> tuple[Column, Column | None]:
    if op in "+-*":
        out = {"+": x + y, "-": x - y, "*": x * y}[op]
        zero = None
    else:
        safe = y if known else F.when(y == 0, F.lit(None)).otherwise(y)
        out = x / safe if op == "/" else x % safe
        zero = None if known else F.when(y == 0, F.lit("division by zero"))
    wild = F.when(F.isnan(out) | (F.abs(out) == float("inf")), F.lit("float arithmetic is not finite"))
    return out, first_error(zero, wild)


_ARITH = {"int": _ints, "float": _floats}


def signed(op: str, v: Value) -> Value:
    """Unary minus and plus."""
    keep = [k for k in ("int", "float") if k in v.tests]
    what = F.lit(f"operand of unary `{op}` must be a number")
    if not keep:
        return Value({"int": None}, {"int": F.lit(None).cast("long")}, {"int": T.LongType()}, first_error(v.err, what))
    err = v.err
    if set(v.tests) - set(keep):
        ok = F.lit(False)
        for k in keep:
            ok = ok | v.test(k)
        err = first_error(err, F.when(~ok, what))
    cols = dict(v.cols)
    if op == "-":
        if "int" in keep:
            least = F.lit(-(1 << 63)).cast("long")
            if not v.is_literal:
                err = first_error(err, F.when(v.test("int") & (v.cols["int"] == least), F.lit("integer arithmetic overflows")))
                cols["int"] = F.when(v.cols["int"] != least, -v.cols["int"])
            else:
                cols["int"] = -v.cols["int"]
        if "float" in keep:
            cols["float"] = -v.cols["float"]
    tests = {k: (v.tests[k] if len(keep) > 1 else None) for k in keep}
    flip = -1 if op == "-" else 1
    return Value(tests, {k: cols[k] for k in keep}, {k: v.types[k] for k in keep}, err, v.literal * flip if v.is_literal else None, v.is_literal)


def member(array: Value, x: Value) -> Value:
    """Whether an array column holds the value, by kind and content."""
    err = first_error(array.err, x.err)
    if "array" not in array.tests:
        return of_bool(F.lit(False), first_error(err, F.lit("left side of `contains` must be an array")))
    if array.sure != "array":
        err = first_error(err, F.when(~array.test("array"), F.lit("left side of `contains` must be an array")))
    dtype = array.types["array"]
    if isinstance(dtype, T.VariantType):
        one = Value(x.tests, x.cols, x.types)
        items = F.try_variant_get(array.cols["array"], "$", "array<variant>")
        hit = F.exists(items, lambda e: equal(_of_variant(e), one).cols["bool"])
    else:
        hit = F.exists(array.cols["array"], lambda e: equal(of_column(e, dtype.elementType, dtype.containsNull, None), Value(x.tests, x.cols, x.types, literal=x.literal, is_literal=x.is_literal)).cols["bool"])
    return of_bool(F.coalesce(hit, F.lit(False)), err)


def as_variant(v: Value) -> Column:
    """Any value as VARIANT (missing: SQL NULL)."""
    out = F.lit(None).cast("variant")
    for k in v.tests:
        if k == MISSING:
            continue
        if k == NULL:
            one = F.parse_json(F.lit("null"))
        else:
            c = v.cols[k]
            one = c if isinstance(v.types[k], T.VariantType) else F.to_variant_object(c) if k in ("array", "object") else c.cast("variant")
        out = F.when(v.test(k), one).otherwise(out)
    return out


def stored(v: Value) -> tuple[Column, T.DataType, bool]:
    """(column, type, may be null) in which a value can be kept; several kinds make a VARIANT.

    A missing value cannot be stored, nor can a float that is not finite: such rows fail."""
    bad = v.err
    if MISSING in v.tests:
        bad = first_error(bad, F.when(v.test(MISSING), F.lit("a missing value cannot be stored")))
    if "float" in v.tests and not v.is_literal:
        c = v.cols["float"]
        bad = first_error(bad, F.when(v.test("float") & (F.isnan(c) | (F.abs(c) == float("inf"))), F.lit("a float that is not finite cannot be stored")))
    kinds = [k for k in v.tests if k not in (MISSING, NULL)]
    if len(kinds) == 0:
        col, dtype, may_null = F.lit(None).cast("variant"), T.VariantType(), True
        col = F.parse_json(F.lit("null"))
    elif len(kinds) == 1:
        k = kinds[0]
        col, dtype, may_null = v.cols[k], v.types[k], NULL in v.tests
        if NULL in v.tests:
            col = F.when(v.test(k), col)
    else:
        col, dtype, may_null = as_variant(v), T.VariantType(), True
    return checked(col, bad), dtype, may_null


MARK = "query execution: "


def checked(col: Column, err: Column | None) -> Column:
    """The column, failing where there is a message; in the scan itself, without a pass of its own."""
    return col if err is None else F.when(err.isNull(), col).otherwise(F.raise_error(F.concat(F.lit(MARK), err)))
