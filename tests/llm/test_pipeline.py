"""The whole pipeline against plain Python, stage by stage in order."""

import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import credentials, decontaminate, language, mixing
from test_operators import plain_components


def plain_masked(rows):
    """rows (doc_id, text, source) -> texts without live values."""
    found, owners = {}, collections.defaultdict(set)
    for i, text, source in rows:
        found[i] = []
        for kind, pattern, group, least in credentials.KINDS:
            for m in re.finditer(pattern, text or "", re.A):
                if len(m[group]) >= least:
                    found[i].append((m.end() - len(m[group]), m.end(), kind, m[group]))
                    owners[m[group]].add((source or "").split("/")[0])
    out = {}
    for i, text, _ in rows:
        live = []
        for lo, hi, kind, v in sorted(found[i]):
            key = kind == "pem"
            if len(owners[v]) < credentials.MANY_OWNERS and len(set(v)) >= credentials.VARIED and not (key and re.search(credentials.PROSE, v)):
                if (key and len(v) >= credentials.LONG) or not re.search(credentials.PLACEHOLDERS, v):
                    live.append((lo, hi))
        new, at = "", 0
        for lo, hi in live:
            if hi > at:
                new += text[at : max(lo, at)] + credentials.MASK
                at = hi
        out[i] = None if text is None else new + text[at:]
    return out


def test_pipeline_matches_plain_python(spark, data, tmp_path):
    table = spark.read.parquet(f"{data}/documents.parquet")
    texts = ["The token=Zx81qP0rLm and password: qW3eR5tY7u of this one.", "Copied api_key=Ab12Cd34Ef here.", "!!! 123"]
    more = [(900_000 + k, texts[k % 3].replace("qP0rLm", f"qP0r{k}m").replace("qW3e", f"q{k}3e") + "".join(f" the w{k}x{j} and" for j in range(12)), "en", f"own{k}/r") for k in range(9)] + [(900_100, "... 12", None, None), (900_101, None, "en", "a")]
    rows = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in more], "doc_id long, text string, lang string, source string, n_chars long")
    table.unionByName(rows.select([F.col(c).cast(t) for c, t in table.dtypes])).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = str(tmp_path)
    table = spark.read.parquet(f"{data}/documents.parquet")
    docs = {r["doc_id"]: r for r in table.collect()}
    net = language.train_network(*language.training_sample(table))
    ids = sorted(docs)
    langs, scores = net.predict([docs[i]["text"] for i in ids])
    least = 1 / len(net.langs) + corpus_pipeline.MARGIN * (1 - 1 / len(net.langs)) - 1e-9
    told = [i for i, x, s in zip(ids, langs, scores, strict=True) if x != language.UNKNOWN and s >= least]
    groups = plain_components([(i, docs[i]["text"]) for i in told])
    kept = [i for i in told if groups[i][1] == i]
    items = [decontaminate.words_in(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    joined = [b" " + b" ".join(w) + b" " for w in items if w]
    clean = [i for i in kept if not any(w in b" " + b" ".join(decontaminate.words_in(docs[i]["text"])) + b" " for w in joined)]
    assert len(told) > len(kept) > len(clean) > 100
    texts = plain_masked([(i, docs[i]["text"], docs[i]["source"]) for i in clean])
    assert any(credentials.MASK in t for t in texts.values()) and any("Ab12Cd34Ef" in t for t in texts.values())
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data).collect()}
    assert {i: r["text"] for i, r in rows.items()} == texts
    slots = collections.Counter()
    for i, r in rows.items():
        assert r["size"] == len((texts[i] or "").encode().split()) and r["taken"] == sum(b["words"] for b in r["blocks"]) <= 3 * r["size"]
        assert all(0 <= b["first"] and b["first"] + b["words"] <= r["size"] for b in r["blocks"])
        for b in r["blocks"]:
            slots[b["slot"]] += b["words"]
    # every slot but each source's last one is full
    assert max(slots.values()) == mixing.BLOCK and sum(n < mixing.BLOCK for n in slots.values()) <= len({d["source"] for d in docs.values()})


def test_without_labels_nothing_is_dropped(spark):
    docs = spark.createDataFrame([(1, "one two", None, "a", 7), (2, "!!", None, "a", 2), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, corpus_pipeline.language_stage(spark, docs, "").collect())) == sorted(map(str, docs.collect()))


def test_missing_languages_are_filled_in(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 1, None).otherwise(F.col("lang")))
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = corpus_pipeline.language_stage(spark, some, data).collect()
    assert all(r["lang"] for r in got) and sum(r["lang"] == want[r["doc_id"]] for r in got) > 0.97 * len(got)


def test_benchmark_stage_fits_its_space_on_all_documents(spark, data, tmp_path, monkeypatch):
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(22_000).selectExpr("id AS doc_id", "concat('the word ', id % 97, ' of it') AS text")
    fitted, product = [], decontaminate._product
    monkeypatch.setattr(decontaminate, "_product", lambda docs, *rest: fitted.append(docs.count()) or product(docs, *rest))
    assert corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).count() == 22_000
    assert fitted == [22_000]
