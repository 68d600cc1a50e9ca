"""Expressions to values over a frame of documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import values as V
from larkspur.plans.syntax import ArrayOf, Binary, Expr, Literal, ObjectOf, Read, Unary


def compile_expr(e: Expr, frame) -> V.Value:
    """frame.read(path parts) gives the value of a path."""
    if isinstance(e, Literal):
        return V.null() if e.kind == "null" else V.constant(e.kind, e.value)
    if isinstance(e, Read):
        return frame.read(e.path.parts)
    if isinstance(e, Unary):
        v = compile_expr(e.operand, frame)
        return V.negation(v) if e.op == "not" else V.signed(e.op, v)
    if isinstance(e, Binary):
        return _binary(e, frame)
    if isinstance(e, ArrayOf):
        return _array([compile_expr(x, frame) for x in e.items])
    if isinstance(e, ObjectOf):
        return _object({k: compile_expr(x, frame) for k, x in e.fields})
    raise TypeError(f"not an expression: {e!r}")


def _binary(e: Binary, frame) -> V.Value:
    if e.op == "contains" and isinstance(e.left, ArrayOf):
        return _listed([compile_expr(x, frame) for x in e.left.items], compile_expr(e.right, frame))
    a, b = compile_expr(e.left, frame), compile_expr(e.right, frame)
    if e.op in ("and", "or"):
        return V.conjunction(e.op, a, b)
    if e.op == "==":
        return V.equal(a, b)
    if e.op == "!=":
        v = V.equal(a, b)
        return V.of_bool(~v.cols["bool"], v.err)
    if e.op == "contains":
        return V.member(a, b)
    if e.op in ("<", "<=", ">", ">="):
        return V.compare(e.op, a, b)
    return V.arithmetic(e.op, a, b)


def _listed(items: list[V.Value], x: V.Value) -> V.Value:
    """Membership in an array that is written out: the terms of an IN list."""
    kinds = {v.sure for v in items}
    k = next(iter(kinds)) if len(kinds) == 1 else None
    if items and k not in (None, V.NULL, V.MISSING) and all(v.is_literal for v in items) and set(x.tests) <= {k, V.NULL, V.MISSING} and k in x.tests:
        return V.of_bool(F.coalesce(x.cols[k].isin(*[v.literal for v in items]), F.lit(False)), x.err)
    hit, err = F.lit(False), x.err
    for v in items:
        one = V.equal(v, x)
        hit, err = hit | one.cols["bool"], V.first_error(err, one.err)
    return V.of_bool(hit, err)


def _array(items: list[V.Value]) -> V.Value:
    """An array of one type if its items have one, else of VARIANT; a missing item fails."""
    err = V.first_error(*[v.err for v in items])
    for v in items:
        if V.MISSING in v.tests:
            err = V.first_error(err, F.when(v.test(V.MISSING), F.lit("a missing value cannot be in an array")))
    kinds = {k for v in items for k in v.tests} - {V.MISSING, V.NULL}
    shapes = {v.types[k].simpleString() for v in items for k in kinds if k in v.types}
    if len(kinds) == 1 and len(shapes) == 1:
        k = next(iter(kinds))
        dtype = next(v.types[k] for v in items if k in v.types)
        cols = [F.when(v.test(k), v.cols[k]) if v.sure != k else v.cols[k] for v in items if True] if all(k in v.tests for v in items) else [F.when(v.test(k), v.cols[k]) if k in v.tests else F.lit(None).cast(dtype) for v in items]
        return V.Value({"array": None}, {"array": F.array(*cols)}, {"array": T.ArrayType(dtype, True)}, err, is_literal=False)
    if not items:
        return V.Value({"array": None}, {"array": F.array().cast("array<string>")}, {"array": T.ArrayType(T.StringType(), True)}, err)
    col = F.to_variant_object(F.array(*[V.as_variant(v) for v in items]))
    return V.Value({"array": None}, {"array": col}, {"array": T.VariantType()}, err)


def _object(fields: dict[str, V.Value]) -> V.Value:
    """A struct with its fields in name order."""
    cols, types, err = [], [], None
    for k in sorted(fields):
        c, t, may_null = V.stored(V.Value(fields[k].tests, fields[k].cols, fields[k].types, None, fields[k].literal, True))
        bad = fields[k].err
        if V.MISSING in fields[k].tests:
            bad = V.first_error(bad, F.when(fields[k].test(V.MISSING), F.lit("a missing value cannot be stored")))
        err = V.first_error(err, bad)
        cols.append(c.alias(k))
        types.append(T.StructField(k, t, may_null))
    if not cols:
        return V.Value({"object": None}, {"object": F.parse_json(F.lit("{}"))}, {"object": T.VariantType()}, err)
    return V.Value({"object": None}, {"object": F.struct(*cols)}, {"object": T.StructType(types)}, err)
