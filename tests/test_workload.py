"""Telemetry, evidence, advice, lifecycle, security, transactions, recovery, codec, streaming."""

import threading

import pytest

from larkspur.engine import Engine
from larkspur.errors import AuthError, Corruption, EngineError, InvalidArgument, InvalidState, NotFound, PermissionDenied
from larkspur.operators import redo
from larkspur.plans.parser import parse
from larkspur.plans.planner import plan
from larkspur.security import Guard
from larkspur.sources import codec
from larkspur.sources.ids import fresh_id, id_text, parse_id
from larkspur.sources.transactions import TransactionManager
from larkspur.streaming.events import evidence, watch
from larkspur.workload import advisor, analysis, assistant
from larkspur.workload.lifecycle import Lifecycle
from larkspur.workload.telemetry import Event, Recorder, event_of, events_frame


def test_advice_from_scan_to_evaluation(spark):
    sink = Recorder()
    e = Engine(spark, telemetry=sink)
    rows = spark.createDataFrame([("CSE" if k == 0 else "ECE", k) for k in range(10)], "branch string, score long")
    e.attach("students", rows, ("score",))
    query = 'students.get { branch == "CSE" }'
    for _ in range(3):
        e.execute(query)
    with pytest.raises(EngineError):
        e.execute("students.get { score }")
    first = events_frame(spark, sink.snapshot())
    total = analysis.totals(first).first()
    assert (total["total_events"], total["failed_events"], total["collection_scans"], total["total_examined"], total["total_returned"]) == (4, 1, 4, 30, 3)
    found = advisor.recommend(analysis.candidates(first), e.db.definitions(), advisor.Thresholds(examined=1)).collect()
    assert [(r["collection"], r["path"], r["return_ratio"]) for r in found] == [("students", "branch", 1000)]
    told = assistant.explain(found[0])
    assert told.suggestion == "create index by_students_branch on students (branch)" and told.narrative is None
    life = Lifecycle(found)
    with pytest.raises(InvalidState):
        life.mark_applied("students", "branch")
    life.accept("students", "branch")
    e.execute(told.suggestion)
    life.mark_applied("students", "branch")
    sink.clear()
    for _ in range(3):
        e.execute(query)
    later = analysis.candidates(events_frame(spark, sink.snapshot()))
    with pytest.raises(InvalidState):
        life.evaluate("students", "branch", later, 4)
    got = life.evaluate("students", "branch", later)
    assert (got["baseline_average_examined"], got["observed_average_examined"], got["examined_reduction"]) == (10, 1, 9000)
    assert "from 10 to 1" in assistant.explain(found[0], got).summary
    with pytest.raises(InvalidState):
        life.dismiss("students", "branch")
    with pytest.raises(NotFound):
        life.accept("students", "score")
    assert advisor.recommend(analysis.candidates(first), e.db.definitions(), advisor.Thresholds(examined=1)).count() == 0


def test_events_hold_no_literals():
    q = parse('c.get { a == "secret" and (b.c > 5 or d == [e, 1]) and 7 == f } | sort a | limit 3')
    e = event_of(q, plan(q), 1, 2, 3, True)
    assert e.fingerprint == "get:c|filter|sort|limit" and e.predicate_paths == ("a", "b.c", "d", "e", "f") and e.candidate_paths == ("a", "f")
    assert "secret" not in repr(e)


def test_recorder_keeps_all_threads_events():
    sink, event = Recorder(), Event("f", None, (), (), "command", None, 0, 0, 0, True)
    threads = [threading.Thread(target=lambda: [sink.record(event) for _ in range(250)]) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(sink.snapshot()) == 2000


def test_ratio_reduction_and_thresholds(spark):
    rows = spark.createDataFrame([(0, 0), (1, 3), (5, 2), (2**60, 2**61)], "r long, e long")
    from pyspark.sql import functions as F

    assert [x[0] for x in rows.select(advisor.return_ratio(F.col("r"), F.col("e"))).collect()] == [10000, 3333, 10000, 5000]
    rows = spark.createDataFrame([(10, 1), (0, 5), (3, 10), (7, 2)], "b long, a long")
    assert [x[0] for x in rows.select(advisor.reduction(F.col("b"), F.col("a"))).collect()] == [9000, 0, -23333, 7142]
    for bad in (advisor.Thresholds(examined=0), advisor.Thresholds(return_ratio=10_001)):
        with pytest.raises(InvalidArgument):
            bad.checked()


def test_counters_saturate(spark):
    big = spark.createDataFrame([("f", "c", ["p"], ["p"], "collection_scan", None, 2**63 - 1, 0, 0, True)] * 3, "fingerprint string, collection string, predicate_paths array<string>, candidate_paths array<string>, access string, index_name string, examined long, returned long, elapsed_micros long, succeeded boolean")
    assert int(analysis.totals(big).first()["total_examined"]) == analysis.U64_MAX


def test_assistant_limits():
    row = {"collection": "c", "path": "a.b", "collection_scans": 3, "collection_scan_examined": 9, "collection_scan_returned": 1, "return_ratio": 1111}

    class Says:
        def __init__(self, text):
            self.text = text

        def explain(self, prompt):
            return self.text

    assert assistant.explain(row, provider=Says("fine")).narrative == "fine"
    for provider, limits in ((Says(" "), assistant.Limits()), (Says("x" * 9), assistant.Limits(output_bytes=8)), (None, assistant.Limits(schema_bytes=3)), (None, assistant.Limits(output_bytes=0))):
        with pytest.raises(InvalidArgument):
            assistant.explain(row, provider=provider, limits=limits)
    with pytest.raises(InvalidArgument):
        assistant.explain({**row, "path": "a.b;drop"})


def test_guard(spark):
    g = Guard()
    g.create_user("reader", "password1", "read_only")
    g.create_user("boss", "password2", "admin")
    e = Engine(spark, guard=g)
    boss, reader = g.authenticate("boss", "password2"), g.authenticate("reader", "password1")
    e.execute("create collection c", boss)
    assert e.execute("c.get {}", reader).rows() == []
    for text in ("c.insert {a: 1}", "explain drop collection c"):
        with pytest.raises(PermissionDenied):
            e.execute(text, reader)
    for token in (None, "x"):
        with pytest.raises(AuthError):
            e.execute("c.get {}", token)
    g.set_role("reader", "read_write")
    with pytest.raises(AuthError):
        e.execute("c.get {}", reader)
    for name, password in (("reader", "wrong-one"), ("nobody", "password1")):
        with pytest.raises(AuthError):
            g.authenticate(name, password)
    for args in (("x y", "password1", "admin"), ("ok", "short", "admin"), ("ok", "password1", "king")):
        with pytest.raises(InvalidArgument):
            g.create_user(*args)


def test_transactions():
    m = TransactionManager()
    a, b = m.begin(), m.begin()
    m.share(a, "c"), m.share(b, "c")
    with pytest.raises(InvalidState):
        m.own(a, "c")
    m.rollback(b)
    m.own(a, "c"), m.share(a, "c"), m.own(a, "c")
    c = m.begin()
    with pytest.raises(InvalidState):
        m.share(c, "c")
    m.commit(a)
    m.own(c, "c")
    with pytest.raises(InvalidState):
        m.commit(a)
    again = TransactionManager(m.log)
    assert again.status(a) == "committed" and again.status(b) == "rolled_back" and again.begin() == c + 1


def test_redo(spark):
    rows = [(0, 1, "begin", None, None), (1, 1, "write", 7, "a"), (2, 2, "begin", None, None), (3, 2, "write", 7, "b"), (4, 1, "write", 8, "c"), (5, 1, "commit", None, None), (6, 3, "write", 7, "d"), (7, 3, "commit", None, None), (8, 3, "abort", None, None)]
    log = spark.createDataFrame(rows, "lsn long, txn long, op string, page_id long, image string")
    assert sorted(map(tuple, redo.recovered(log).collect())) == [(7, 1, "a"), (8, 4, "c")]
    assert redo.gaps(log).count() == 0
    assert [r[0] for r in redo.gaps(log.filter("lsn <> 4")).collect()] == [3]


def test_codec():
    doc = codec.Doc(fresh_id(), {"b": [1, -2.5, None, True, "é", [codec.Millis(-5)]], "a": codec.Doc(bytes(16), {"x": codec.DocId(bytes(range(16)))})})
    data = codec.encode(doc)
    assert codec.decode(data) == doc and codec.encode(codec.decode(data)) == data
    for cut in range(len(data)):
        with pytest.raises(Corruption):
            codec.decode(data[:cut])
    with pytest.raises(Corruption):
        codec.decode(data + b"x")
    deep = None
    for _ in range(300):
        deep = [deep]
    with pytest.raises(InvalidArgument):
        codec.encode(codec.Doc(bytes(16), {"d": deep}))


def test_export(spark):
    e = Engine(spark)
    e.attach("t", spark.createDataFrame([(1, "a", [1, 2]), (2, None, [])], "k long, s string, l array<long>"), ("k",))
    out = [codec.decode(bytes(r["data"])) for r in codec.exported(e.frame("t").visible(ids=True)).orderBy("_id").collect()]
    assert [d.fields for d in out] == [{"k": 1, "l": [1, 2], "s": "a"}, {"k": 2, "l": [], "s": None}]


def test_ids():
    raw = fresh_id()
    assert parse_id(id_text(raw)) == raw and parse_id("doc_" + raw.hex().upper()) == raw
    with pytest.raises(InvalidArgument):
        parse_id("12")


def test_streamed_evidence(spark, tmp_path):
    from larkspur.queries import derived_events

    events = derived_events(spark, "/root/testdata/sf0.001")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    got = evidence(spark, f"{tmp_path}/out")
    want = analysis.candidates(events)
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert key(got) == key(want)
