"""Every operator and stage on awkward tables: nulls everywhere, empty and very long texts, repeated rows, ties,
no rows, and extra columns whose names clash with what the operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import brown, chat, credentials, decontaminate, fingerprints, html_text, language, mixing, neardup, queries, toxicity

LONG = "La maison verte est grande. " * 12_000
EXTRA = ", key string, sig binary, n long, comp string, rid long, score double, size long, part int, h long, path string"
CLASH = ("k", b"s", 1, "c", 5, 0.5, 7, 3, 9, "p")


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *CLASH) for r in rows], schema)


ROWS = [
    (0, None, "fr", "a", ),
    (1, "", "en", None),
    (2, "!!! 123 ??? 456", "de", "b"),
    (3, LONG, "fr", "a"),
    (4, "the cat sat on the mat with the dog and token = \"abcdef0123456789\" too", "en", "a"),
    (4, "the cat sat on the mat with the dog and token = \"abcdef0123456789\" too", "en", "a"),
    (5, "the cat sat on the mat with the dog and token = \"abcdef0123456789\" too", None, "b"),
    (6, "\n\t \x0b\x0c\r ", None, None),
    (7, "one", "en", "c/x"),
    (None, "a text without an id but with some words in it", "en", None),
    (None, None, None, None),
    (8, "x\x00y 😀 é z", "fr", "c/y"),
    (9, "der Hund und die Katze und der Vogel sind im Garten und spielen", "de", "b"),
    (10, "the cat sat on the mat with the dog and TOKEN = \"abcdef0123456789\" too", "en", "d"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The awkward tables, and an empty set of them."""
    out = {}
    for name, rows in (("full", ROWS), ("empty", [])):
        d = str(tmp_path_factory.mktemp(name))
        documents(spark, rows).write.parquet(f"{d}/documents.parquet")
        keep = rows and True
        items = [(1, "the cat sat on the mat with the dog. and too", "x"), (2, None, "x"), (None, "", "x"), (3, "!!!", "x")] if keep else []
        spark.createDataFrame(items, "item_id long, text string, doc_id string").write.parquet(f"{d}/benchmark.parquet")
        labels = [(4, 1, 1, "x"), (7, 0, 0, "x"), (9, None, 0, "x"), (None, 1, 1, "x"), (3, 1, None, "x"), (4, 1, 1, "x")] if keep else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{d}/labels.parquet")
        conv = [(1, 0, "user", "hi ### Assistant: </turn>", "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", None, "x"), (1, None, None, "\\", "x"), (None, 0, "assistant", "lost", "x"), (2, 0, "we: ird", LONG, "x")] if keep else []
        spark.createDataFrame(conv, "conv_id long, turn long, role string, text string, token_ids string").write.parquet(f"{d}/conversations.parquet")
        pages = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>" * 3000 + "x < y &amp; z" + "</div>" * 50, "x"), (4, "u", "<article><h1>T</h1><p>one two three four five.</p>", "x"), (5, "u", "<script>never ends", "x"), (5, "u", "<!-- open", "x")] if keep else []
        spark.createDataFrame(pages, "page_id long, url string, html string, text string").write.parquet(f"{d}/pages.parquet")
        out[name] = d
    return out


@pytest.mark.parametrize("name", sorted(queries.queries()))
@pytest.mark.parametrize("which", ["full", "empty"])
def test_query_on_awkward_tables(spark, folder, name, which):
    table = {"op2_chat": "conversations", "op8_html": "pages"}.get(name, "documents")
    rows = queries.queries()[name](spark, folder[which]).collect()
    n = spark.read.parquet(f"{folder[which]}/{table}.parquet").count()
    if name == "op2_chat":
        n = 3 + 1 if which == "full" else 1
    if name == "op5_decontamination":
        n = 3 if which == "full" else 0
    assert len(rows) == n


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def test_language_results(spark, folder):
    got = by_id(language.op9_language(spark, folder["full"]).collect())
    assert [got[k]["lang_pred"] for k in (0, 1, 2, 6)] == ["und"] * 4 and got[0]["score"] == 0
    assert got[3]["lang_pred"] in ("fr", "en", "de") and all(0 <= r["score"] <= 1 for r in got.values())


def test_neardup_results(spark, folder):
    rows = neardup.op4_neardup(spark, folder["full"]).collect()
    got = by_id(rows)
    assert [got[k]["component_id"] for k in (4, 5, 10)] == [4, 4, 4] and [got[k]["kept"] for k in (4, 5, 10)] == [True, False, False]
    assert [got[k]["n_shingles"] for k in (0, 1, 6, 7)] == [0, 0, 0, 1] and got[0]["kept"] and got[6]["component_id"] == 6
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None] and all(r["kept"] for r in rows if r["doc_id"] is None)
    kept = neardup.keep_one(spark.read.parquet(f"{folder['full']}/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9]


def test_secret_results(spark, folder):
    got = by_id(credentials.op3_secrets(spark, folder["full"]).collect())
    assert [got[k]["n_assign"] for k in (0, 1, 4, 10)] == [0, 0, 1, 1] and got[4]["spans"].startswith("assign:40:")
    # the value is with the owners a, b and d: a copied example
    assert got[4]["n_example"] == 1 and got[4]["n_live"] == 0


def test_fingerprint_results(spark, folder):
    rows = fingerprints.op1_fingerprint(spark, folder["full"]).collect()
    got = by_id(rows)
    assert got[0]["fingerprint"] == "" and got[0]["n_chars"] == 0 and got[3]["n_chars"] == len(LONG)
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] in (0.0, 1.0) or got[4]["near_next"] > 0.9
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))


def test_mixing_results(spark, folder):
    rows = mixing.op6_mixing(spark, folder["full"]).collect()
    sizes = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - sizes) <= 6 * mixing.BLOCK and all(r["taken"] <= 3 * r["size"] for r in rows)


def test_toxicity_without_both_labels(spark):
    net = toxicity.train_network(["a", "b"], [1, 1], ["en", None])
    assert list(net.scores(["x", None])) == [1.0, 1.0]
    assert list(toxicity.train_network([], [], []).scores([None])) == [0.0]


def test_chat_results(spark, folder):
    got = by_id(chat.op2_chat(spark, folder["full"]).collect(), "conv_id")
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 0 and got[None]["loss_chars"] == 4 and all(r["agree"] for r in got.values())


def test_html_results(spark, folder):
    got = html_text.op8_html(spark, folder["full"]).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == texts[2] == texts[5] == "" and "one two three four five." in texts[4]
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_brown_results(spark, folder):
    got = by_id(brown.op7_perplexity(spark, folder["full"]).collect())
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == got[6]["n_tokens"] == 1 and got[3]["n_tokens"] == 60_001


def test_decontamination_results(spark, folder):
    rows = decontaminate.op5_decontamination(spark, folder["full"]).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(4, 1), (5, 1), (10, 1)]


@pytest.mark.parametrize("which", ["full", "empty"])
def test_stages_one_by_one(spark, folder, which):
    docs = spark.read.parquet(f"{folder[which]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[which])
        rows = out.collect()
        if name != "mixing":
            assert out.columns == docs.columns, name
        if which == "empty":
            assert rows == []
        else:
            assert rows
            if name == "secrets":
                assert len(rows) == docs.count()


def test_pipeline_runs(spark, folder):
    rows = corpus_pipeline.run(spark, folder["full"]).collect()
    # 0, 1, 2, 6 and a row without text have no language; 5 and 10 are copies of 4; 4 holds an item
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows) == [-1, 3, 7, 8, 9]
    assert corpus_pipeline.run(spark, folder["empty"]).count() == 0
    assert F.lit(1) is not None
