"""The document interface, timestamps, the command line, and random predicates against a plain evaluator."""

import math
import random

import pytest

from larkspur.__main__ import main
from larkspur.engine import Engine
from larkspur.errors import AlreadyExists, EngineError, InvalidArgument, NotFound
from larkspur.functions.timestamps import iso_text
from larkspur.plans.parser import parse
from larkspur.plans.syntax import ArrayOf, Literal, Read, Unary
from larkspur.sources.backend import DocumentApi
from larkspur.sources.ids import fresh_id


def test_documents_by_id(spark):
    e = Engine(spark)
    api = DocumentApi(e)
    api.create_collection("c")
    a, b, c = sorted(fresh_id() for _ in range(3))
    frame = lambda *rows: spark.createDataFrame(rows, "_id binary, k int, name string")
    assert api.insert("c", frame((bytearray(a), 1, "x"), (bytearray(b), 2, None))) == 2
    api.create_index("by_k", "c", ("k",))
    with pytest.raises(AlreadyExists):
        api.insert("c", frame((bytearray(a), 9, "y")))
    with pytest.raises(AlreadyExists):
        api.insert("c", frame((bytearray(c), 9, "y"), (bytearray(c), 9, "z")))
    with pytest.raises(InvalidArgument):
        api.insert("c", spark.createDataFrame([(bytearray(b"short"), 1)], "_id binary, k int"))
    assert api.replace("c", frame((bytearray(b), 20, "z"))) == 1
    with pytest.raises(NotFound):
        api.replace("c", frame((bytearray(c), 1, "z")))
    assert [r["k"] for r in e.execute("c.get {}").rows()] == [1, 20]
    assert api.scan_index("c", "by_k", 20).df.count() == 1 and api.get("c", a).df.count() == 1
    with pytest.raises(NotFound):
        api.delete("c", spark.createDataFrame([(bytearray(c),)], "_id binary"))
    assert api.delete("c", spark.createDataFrame([(bytearray(a),)], "_id binary")) == 1 and e.collection_len("c") == 1
    api.drop_index("by_k")
    api.drop_collection("c")
    assert api.index_definitions() == []


def test_timestamps():
    assert iso_text(0) == "1970-01-01T00:00:00.000Z"
    assert iso_text(-1) == "1969-12-31T23:59:59.999Z"
    assert iso_text(951_782_400_000) == "2000-02-29T00:00:00.000Z"
    assert iso_text(1_704_067_200_123) == "2024-01-01T00:00:00.123Z"


def test_command_line(capsys):
    assert main(["version"]) == 0 and main(["help"]) == 0 and main([]) == 2 and main(["query", "x"]) == 2
    assert "larkspur" in capsys.readouterr().out


# -- a plain evaluator of the language, on Python values


class Fail(Exception):
    pass


MISSING = object()


def kind(v):
    return "missing" if v is MISSING else "null" if v is None else "bool" if isinstance(v, bool) else {int: "int", float: "float", str: "string", list: "array"}[type(v)]


def truth(v):
    if not isinstance(v, bool):
        raise Fail
    return v


def same(a, b):
    if kind(a) != kind(b):
        return False
    return len(a) == len(b) and all(map(same, a, b)) if isinstance(a, list) else a is b or a == b


def plain(e, row):
    if isinstance(e, Literal):
        return e.value
    if isinstance(e, Read):
        return row.get(e.path.text, MISSING)
    if isinstance(e, ArrayOf):
        return [plain(x, row) for x in e.items]
    if isinstance(e, Unary):
        v = plain(e.operand, row)
        if e.op == "not":
            return not truth(v)
        if kind(v) not in ("int", "float"):
            raise Fail
        return -v if e.op == "-" else v
    a = plain(e.left, row)
    if e.op in ("and", "or"):
        if truth(a) == (e.op == "or"):
            return a
        return truth(plain(e.right, row))
    b = plain(e.right, row)
    if e.op in ("==", "!="):
        return same(a, b) == (e.op == "==")
    if e.op == "contains":
        if kind(a) != "array":
            raise Fail
        return any(same(x, b) for x in a)
    if e.op in ("<", "<=", ">", ">="):
        if kind(a) != kind(b) or kind(a) not in ("int", "float", "string"):
            raise Fail
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]
    if kind(a) != kind(b) or kind(a) not in ("int", "float"):
        raise Fail
    if e.op in "/%" and b == 0:
        raise Fail
    if isinstance(a, int):
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if e.op in "/%" else 0
        out = {"+": a + b, "-": a - b, "*": a * b, "/": q, "%": a - q * b if e.op == "%" else 0}[e.op]
        if not -(1 << 63) <= out < 1 << 63:
            raise Fail
        return out
    out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b)}[e.op]()
    if not math.isfinite(out):
        raise Fail
    return out


def random_predicate(rng, depth=0):
    leaf = lambda: rng.choice(["a", "b", "f", "s", "t", "n", "nowhere", "1", "2", "0", "1.5", "0.0", "-2", '"x"', '"y"', "null", "true", "[1, 2]", '["x"]', "arr"])
    if depth > 2 or rng.random() < 0.25:
        return leaf()
    r = rng.random()
    inner = lambda: random_predicate(rng, depth + 1)
    if r < 0.1:
        return f"not ({inner()})"
    if r < 0.4:
        return f"({inner()}) {rng.choice(['and', 'or'])} ({inner()})"
    if r < 0.75:
        return f"({inner()}) {rng.choice(['==', '!=', '<', '<=', '>', '>='])} ({inner()})"
    if r < 0.85:
        return f"{rng.choice(['arr', '[1, 2]', inner()])} contains {leaf()}" if rng.random() < 0.7 else f"arr contains {leaf()}"
    return f"({inner()}) {rng.choice('+-*/%')} ({inner()})"


def test_random_predicates_match_the_plain_evaluator(spark):
    rows = [
        {"a": 1, "b": 2, "f": 1.5, "s": "x", "t": True, "n": None, "arr": [1, 2]},
        {"a": -3, "b": 0, "f": 0.0, "s": "y", "t": False, "n": 4, "arr": []},
        {"a": 2, "b": 1, "f": -2.5, "s": "", "t": True, "n": None, "arr": [2]},
    ]
    e = Engine(spark)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a long, b long, f double, s string, t boolean, n long, arr array<long>")
    e.attach("c", df.coalesce(1), ("a",), non_null=("a", "b", "f", "s", "t", "arr"))
    rng = random.Random(42)
    outcomes = {"fail": 0, "rows": 0, "none": 0}
    for _ in range(160):
        text = random_predicate(rng)
        tree = parse(f"c.get {{ {text} }}").stages[0].predicate
        try:
            want = sorted(r["a"] for r in rows if truth(plain(tree, r)))
        except Fail:
            want = "fail"
        try:
            got = sorted(r["a"] for r in e.execute(f"c.get {{ {text} }}").df.select("a").collect())
        except EngineError:
            got = "fail"
        except Exception as x:  # noqa: BLE001  the engine's own failures, raised within a row
            assert "query execution" in str(x), (text, str(x)[:300])
            got = "fail"
        assert got == want, text
        outcomes["fail" if want == "fail" else "rows" if want else "none"] += 1
    assert min(outcomes.values()) > 10
