"""Semantics of queries: kinds, missing and null, stages, mutations, indexes."""

import pytest

from larkspur.engine import Deleted, Engine, Explained, Inserted, Updated
from larkspur.errors import AlreadyExists, InvalidArgument, InvalidState, NotFound, Unsupported
from larkspur.sources.store import Database, Store

PEOPLE = [
    '{name: "Ada", score: 91, ratio: 0.5, active: true, tags: ["x", "y"], address: {city: "Pune", zip: 1}}',
    '{name: "Bob", score: 72, ratio: -1.5, active: false, tags: ["y"], address: {city: "Delhi", zip: 2}}',
    '{name: "Cy", score: null, ratio: 2.5, active: true, tags: [], address: {city: "Pune", zip: 3}}',
    '{name: "Di", ratio: 0.0, active: true, tags: ["z"], address: {city: "Oslo", zip: 4}}',
]


@pytest.fixture(scope="module")
def people(spark):
    e = Engine(spark)
    e.execute("create collection p")
    for d in PEOPLE:
        assert isinstance(e.execute(f"p.insert {d}"), Inserted)
    return e


def names(e, text):
    return [r["name"] for r in e.execute(text).rows()]


@pytest.mark.parametrize(
    ("test", "found"),
    [
        ("score == 91", ["Ada"]),
        ("score = 91", ["Ada"]),
        ("score == 91.0", []),
        ("score == null", ["Cy"]),
        ("score != null", ["Ada", "Bob", "Di"]),
        ("score == nothing", ["Di"]),
        ("nothing == absent", ["Ada", "Bob", "Cy", "Di"]),
        ("null == null", ["Ada", "Bob", "Cy", "Di"]),
        ("ratio == -0.0", ["Di"]),
        ('name > "Bob"', ["Cy", "Di"]),
        ("ratio >= 0.5 and active", ["Ada", "Cy"]),
        ("active == false or ratio > 2.0", ["Bob", "Cy"]),
        ("not active", ["Bob"]),
        ("!active", ["Bob"]),
        ('tags contains "y"', ["Ada", "Bob"]),
        ('["Ada", "Di"] contains name', ["Ada", "Di"]),
        ("[1, 91.0, 91] contains score", ["Ada"]),
        ('address.city == "Pune" and address.zip % 2 == 1', ["Ada", "Cy"]),
        ('address == {city: "Oslo", zip: 4}', ["Di"]),
        ('tags == ["y"]', ["Bob"]),
        ("address.city.deeper == 1", []),
        ("-ratio > +1.0", ["Bob"]),
        ("ratio * 2.0 == 1.0", ["Ada"]),
        ("address.zip / 2 == 1", ["Bob", "Cy"]),
        ("(0 - address.zip) / 2 == -1", ["Bob", "Cy"]),
        ("active or ratio < 0.0", ["Ada", "Bob", "Cy", "Di"]),
        ('_id == "00"', []),
    ],
)
def test_predicates(people, test, found):
    assert names(people, f"p.get {{ {test} }}") == found


@pytest.mark.parametrize(
    "test",
    [
        "score > 1", "name > 5", "active < true", "score", "not ratio", "name and active", "active and score", "ratio + 1 == 1.0", 'name + "x" == name',
        "name contains 1", "ratio / 0.0 == 1.0", "address.zip / 0 == 1", "address.zip % (address.zip - address.zip) == 1", "address.zip * 9223372036854775807 == 1",
        "ratio * 1e308 * 1e308 == 1.0", "-name == 1", "nothing > 1", "tags < tags",
    ],
)
def test_failures(people, test):
    with pytest.raises(InvalidArgument):
        people.execute(f"p.get {{ {test} }}").rows()


def test_short_circuit_hides_the_right_side(people):
    assert names(people, 'p.get { name == "Ada" and score > 1 }') == ["Ada"]
    assert len(names(people, "p.get { ratio < 100.0 or score > 1 }")) == 4


def test_stage_order(people):
    assert names(people, "p.get {} | limit 3 | skip 1") == ["Bob", "Cy"]
    assert names(people, "p.get {} | skip 1 | limit 2") == ["Bob", "Cy"]
    assert names(people, "p.get {} | sort score | project name") == ["Di", "Cy", "Bob", "Ada"]
    assert names(people, "p.get {} | sort score desc") == ["Ada", "Bob", "Cy", "Di"]
    assert names(people, "p.get {} | project name | sort ratio desc") == ["Ada", "Bob", "Cy", "Di"]
    assert names(people, "p.get {} | sort name desc | sort active") == ["Bob", "Di", "Cy", "Ada"]
    assert names(people, "p.get {} | sort address.city, ratio desc | limit 3") == ["Bob", "Di", "Cy"]
    with pytest.raises(InvalidArgument):
        people.execute("p.get {} | sort tags").rows()


def test_projection(people):
    rows = people.execute("p.get {} | sort ratio | limit 1 | project address.zip, address.city, name, nothing, name.x").rows()
    assert [{k: v for k, v in r.items() if k != "_id"} for r in rows] == [{"address": {"city": "Delhi", "zip": 2}, "name": "Bob"}]
    assert set(people.execute("p.get {} | project _id").rows()[0]) == {"_id"}
    rows = people.execute('p.get { name == "Di" } | project score, address, address.zip').rows()
    assert "score" not in rows[0] and rows[0]["address"] == {"city": "Oslo", "zip": 4}


@pytest.fixture
def small(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    e.execute("create collection c")
    for k in range(4):
        e.execute(f'c.insert {{k: {k}, name: "n{k}"}}')
    return e


def plain(e, text="c.get {} | sort k"):
    return [{k: v for k, v in r.items() if k != "_id"} for r in e.execute(text).rows()]


def test_update_delete(small):
    assert small.execute("c.update { k > 1 } | set k = k + 10, twice = k * 2, a.b.c = name") == Updated(2)
    rows = plain(small)
    assert rows[:2] == [{"k": 0, "name": "n0"}, {"k": 1, "name": "n1"}]
    assert rows[2] == {"k": 12, "name": "n2", "twice": 24, "a": {"b": {"c": "n2"}}}
    assert small.execute("c.update {} | sort k desc | limit 1 | set name = 5") == Updated(1)
    assert [r["name"] for r in plain(small)] == ["n0", "n1", "n2", 5]
    assert plain(small, 'c.get { name == 5 }')[0]["k"] == 13
    assert small.execute("c.delete { k == 0 }") == Deleted(1)
    assert small.execute("c.delete {} | skip 1") == Deleted(2)
    assert small.collection_len("c") == 1 and small.collection_count() == 1
    assert small.execute("c.delete { k == 99 }") == Deleted(0)
    assert small.execute("c.update { k == 99 } | set k = 1") == Updated(0)


def test_failed_update_writes_nothing(small):
    before = plain(small)
    for text in ("c.update {} | set k = 10 / k", "c.update {} | set k = nothing", "c.update {} | set name.x = 1", "c.update {} | set _id = 1"):
        with pytest.raises(InvalidArgument):
            small.execute(text)
    assert plain(small) == before
    with pytest.raises(InvalidArgument):
        small.execute("c.update {} | project k | set k = 1")
    with pytest.raises(InvalidArgument):
        small.execute("c.insert {a: b}")
    small.execute("c.insert {a: b == c, k: 7}")
    assert plain(small)[-1] == {"a": True, "k": 7}


def test_definitions(small):
    with pytest.raises(AlreadyExists):
        small.execute("create collection c")
    with pytest.raises(NotFound):
        small.execute("drop collection d")
    with pytest.raises(NotFound):
        small.execute("d.get {}")
    with pytest.raises(Unsupported):
        small.execute("create index i on c (a, b)")
    small.execute("create index i on c (k)")
    with pytest.raises(AlreadyExists):
        small.execute("create index i on c (name)")
    small.execute("drop collection c")
    assert small.db.definitions() == []


def test_index_follows_writes(small):
    small.execute("create index by_k on c (k)")
    assert small.execute("explain c.get { k == 2 }") == Explained("IndexScan(c, by_k, Int64(2)) -> Filter")
    assert plain(small, "c.get { k == 2 }") == [{"k": 2, "name": "n2"}]
    small.execute("c.update { k == 2 } | set k = 20")
    small.execute("c.insert {k: 2.5}")
    small.execute("c.delete { k == 1 }")
    assert plain(small, "c.get { k == 2 }") == [] and len(plain(small, "c.get { k == 20 }")) == 1
    assert [r["key_int"] for r in small.lookup_range("by_k", 0, 20).collect()] == [0, 3, 20]
    assert small.lookup("by_k", 2.5).count() == 1 and small.verify_index("by_k").count() == 0
    with pytest.raises(InvalidArgument):
        small.lookup_range("by_k", "a", 1)
    with pytest.raises(InvalidArgument):
        plain(small)  # sorts integers with floats
    before = plain(small, "c.get {}")
    with pytest.raises(InvalidArgument):
        small.execute("c.insert {k: true}")
    with pytest.raises(InvalidArgument):
        small.execute("c.update { k == 0 } | set k = [1]")
    assert plain(small, "c.get {}") == before


def test_reopening_and_concurrent_commits(spark, small):
    again = Engine(spark, small.db.store.root)
    assert plain(again) == plain(small)
    again.execute("c.insert {k: 50}")
    with pytest.raises(InvalidState):
        small.execute("c.insert {k: 51}")  # its version is taken
    fresh = Engine(spark, small.db.store.root)
    assert [r["k"] for r in plain(fresh)] == [0, 1, 2, 3, 50]
    fresh.execute("c.delete { k > 1 }")
    assert fresh.vacuum() > 0 and [r["k"] for r in plain(fresh)] == [0, 1]
    assert Database.open(Store(spark, small.db.store.root)).version == fresh.db.version


def test_pages_are_top_k(spark, data):
    e = Engine(spark)
    e.attach("events", spark.read.parquet(f"{data}/events.parquet"), ("event_id",))
    r = e.execute("events.get {} | sort value desc | skip 5 | limit 3 | project event_id")
    plan = r.df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert r.count() == 3


def test_attached_tables_push_down(spark, data):
    e = Engine(spark)
    e.attach("events", spark.read.parquet(f"{data}/events.parquet"), ("event_id",), non_null="check")
    r = e.execute('events.get { event_type == "error" and value > 50.0 } | project event_id')
    text = r.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,50.0)" in text and "EqualNullSafe(event_type,error)" in text and "user_id" not in text.split("ReadSchema")[1]
    e.attach("words", spark.createDataFrame([(1, 2)], "`set` int, a int"), ("a",), rename={"set": "set_"})
    assert [r["set_"] for r in e.execute("words.get { set_ == 1 }").rows()] == [1]
