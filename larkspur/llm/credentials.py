"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns give candidate spans in each whole text.  Candidates are hashed, and the corpus says in how many
texts, repositories and owners a value occurs: a value that many owners hold is a widely copied example,
one that few hold and that looks random is a live credential of its owner.  The source is the repository;
what stands before its first slash is the owner (all of it if there is none).

Counting goes (value, owner, repository) -> (value, owner) -> value, so a value that a third of all rows
share is summed before it moves.  Texts never move: only candidates do.

Defined results: null is the empty text, without spans; a null source is one unnamed repository; repeated
rows are all reported, and count each; an empty table gives an empty result; only the id, text and source
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

#: A private key's value is its body: all after the header line, up to the dash that begins the END line (or to
#: whatever else a body has not).
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\x20\t\r\n]*(?:\\[nr]){0,4}((?:(?:Proc-Type|DEK-Info):[^\n]*\n[\x20\t\r\n]*){0,4}[A-Za-z0-9+/=\\\x20\t\r\n]*)"
# The kinds, their patterns, the group that holds the secret, and its (or the match's) least length.
KINDS = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 0, 20),
    ("pem", PEM, 1, 20),
]
BASE_KINDS = ("assign", "access", "hex")
#: Matches of a text that are placed one after another; such chunks are then placed by their lengths.
_PLACED = 256
#: What is cheap to look for before a pattern is run in earnest.
_MAYBE = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}", "github": r"gh[pousr]_", "jwt": r"eyJ", "pem": "-----BEGIN"}
# Words that mark a placeholder.
PLACEHOLDERS = r"(?i)example|changeme|placeholder|your[_-]|xxxx|dummy|sample|redacted"
#: In a private key's body of this length a placeholder's word may stand by chance; short words in a row are prose.
LONG = 100
PROSE = r"[A-Za-z]{1,12}\x20[a-z]{1,12}\x20[a-z]{1,12}\x20"
#: A value held by so many owners is a widely copied example.
MANY_OWNERS = 3
#: A live-looking value has so many different characters at least.
VARIED = 6
MASK = "[secret]"


def _spans_of(text: Column, number: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind_no, kind, end, value>> of the leftmost non-overlapping matches, in code points.

    Matches lie between the pieces that the same pattern splits the text into; adding up lengths places them, in
    chunks, so that a text of very many matches is not copied for each of them.  A match that is too short is
    dropped after it has used up its characters."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("p"), whole.alias("m"), value.alias("v"))
    shape = "struct<start:int,kind_no:int,kind:string,end:int,value:string>"
    none = F.array().cast(f"array<{shape}>")

    def add(acc: Column, s: Column) -> Column:
        start = acc["pos"] + F.length(s["p"])
        end = start + F.length(s["m"])
        one = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), s["v"].alias("value"))
        return F.struct(end.alias("pos"), F.when(F.length(s["v"]) >= least, F.array_append(acc["got"], one)).otherwise(acc["got"]).alias("got"))

    def chunked(all_steps: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(all_steps), F.lit(_PLACED)), lambda k: k < F.size(all_steps))
        return F.transform(firsts, lambda k: F.aggregate(F.slice(all_steps, k + 1, F.lit(_PLACED)), F.struct(F.lit(0).alias("pos"), none.alias("got")), add))

    def moved(chunks: Column) -> Column:
        upto = lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + c["pos"])
        bases = F.aggregate(chunks, F.array(F.lit(0)), upto)
        put = lambda s, base: F.struct((s["start"] + base).alias("start"), s["kind_no"].alias("kind_no"), s["kind"].alias("kind"), (s["end"] + base).alias("end"), s["value"].alias("value"))
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), F.slice(bases, 1, F.size(chunks)).alias("b")), lambda x: F.transform(x["c"]["got"], lambda s: put(s, x["b"]))))

    # an array of one binds what must be worked out just once
    bound = F.transform(F.array(steps), lambda s: F.transform(F.array(chunked(s)), moved)[0])[0]
    return F.when(text.rlike(_MAYBE[kind]), bound).otherwise(none)


def span_column(text: Column, kinds: list = KINDS) -> Column:
    """All spans of a text, by start and then kind as listed."""
    return F.array_sort(F.concat(*[_spans_of(text, n, *k) for n, k in enumerate(kinds)]))


def _hashed(found: Column) -> Column:
    """Spans with the length and hash of their value, and whether it looks random."""

    def shaped(s: Column) -> Column:
        v = s["value"]
        varied = F.size(F.array_distinct(F.split(v, ""))) >= VARIED
        no_prose, long_body = (s["kind"] != "pem") | ~v.rlike(PROSE), (s["kind"] == "pem") & (F.length(v) >= LONG)
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.length(v).alias("size"), F.sha2(v, 256).alias("hash"), (varied & no_prose & (long_body | ~v.rlike(PLACEHOLDERS))).alias("random"))

    return F.transform(found, shaped)


def scanned(docs: DataFrame, kinds: list = KINDS) -> DataFrame:
    """doc_id, source, cand (the spans, with hashed values and whether they look random) of every row."""
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    spans = rows.select("doc_id", "source", span_column(F.col("text"), kinds).alias("found"))
    return spans.select("doc_id", "source", _hashed(F.col("found")).alias("cand"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_docs, n_repos, n_owners of every candidate value of the corpus."""
    repo = F.coalesce(F.col("source"), F.lit(""))
    each = found.filter(F.size("cand") > 0).select(
        repo.alias("repo"), F.substring_index(repo, "/", 1).alias("owner"), F.explode(F.array_distinct(F.transform("cand", lambda s: s["hash"]))).alias("hash")
    )
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("d"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("r"))
    return by_owner.groupBy("hash").agg(F.sum("d").alias("n_docs"), F.sum("r").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(found: DataFrame) -> DataFrame:
    """doc_id, ck, verdicts (array of struct<start, kind, end, size, verdict, spread>) of every distinct row that has
    spans; ck is the hash of cand, spread tells that the value is in several repositories."""
    rows = found.filter(F.size("cand") > 0).select("doc_id", "cand").withColumn("ck", F.xxhash64("cand")).dropDuplicates(["doc_id", "ck"])
    # written first: a join of two tables can be split where very many rows share a value
    owners = staged(ownership(found).select("hash", "n_owners", "n_repos"), "owners")
    each = staged(rows.select("doc_id", "ck", F.explode("cand").alias("s")).select("doc_id", "ck", "s.*"), "candidates")
    verdict = F.when(F.col("n_owners") >= MANY_OWNERS, "example").when(F.col("random"), "live").otherwise("placeholder")
    told = each.join(owners, "hash").withColumn("verdict", verdict).withColumn("spread", F.col("n_repos") > 1)
    return told.groupBy("doc_id", "ck").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "size", "verdict", "spread"))).alias("verdicts"))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: spans of every document; how many of its values are live, live and in several repositories
    (n_spread), or copied examples."""
    found = staged(scanned(table(spark, sf_dir, "documents")), "scanned")
    text_of = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("cand", lambda s: s["kind"] == k)).cast("long")
    told = lambda f: F.size(F.filter("verdicts", f)).cast("long")
    base = F.filter("cand", lambda s: s["kind"].isin(*BASE_KINDS))
    rows = found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, text_of), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("cand", text_of), ",").alias("spans"),
        F.when(F.size("cand") > 0, F.xxhash64("cand")).alias("ck"),
    )
    said = judged(found).select(
        F.col("doc_id").alias("j_id"),
        F.col("ck").alias("j_ck"),
        told(lambda s: s["verdict"] == "live").alias("n_live"),
        told(lambda s: (s["verdict"] == "live") & s["spread"]).alias("n_spread"),
        told(lambda s: s["verdict"] == "example").alias("n_example"),
    )
    out = rows.join(said, (rows.ck == said.j_ck) & rows.doc_id.eqNullSafe(said.j_id), "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_live", "n_spread", "n_example")])


def masked(docs: DataFrame) -> DataFrame:
    """Pipeline decision: live values are masked, copied examples and all else stay; n_chars follows the text.

    The patterns run once: the rows are written with what was found in them.  The caller's columns travel in one
    struct, so their names meet none of those used here."""
    held = docs.columns
    spans = _hashed(span_column(F.coalesce(docs["text"], F.lit(""))))
    scan = staged(docs.select(F.struct(*[docs[c] for c in held]).alias("row"), spans.alias("cand")), "scanned")
    live = judged(scan.select("row.doc_id", "row.source", "cand")).select(
        "doc_id", "ck", F.filter("verdicts", lambda s: s["verdict"] == "live").alias("live")
    ).filter(F.size("live") > 0)
    # texts without any candidate pass as they are; only the others are joined
    plain = scan.filter(F.size("cand") == 0).select("row")
    keyed = scan.filter(F.size("cand") > 0).select("row", F.xxhash64("cand").alias("ck"))
    hit = keyed.join(live, (keyed.ck == live.ck) & F.col("row.doc_id").eqNullSafe(live.doc_id), "left").select("row", "live")
    text = F.col("row.text")

    def cut(acc: Column, s: Column) -> Column:
        lo, hi = F.greatest(s["end"] - s["size"], acc["pos"]), s["end"]
        kept = F.array_append(acc["out"], F.substring(text, acc["pos"] + 1, lo - acc["pos"]))
        return F.struct(F.greatest(hi, acc["pos"]).alias("pos"), F.when(hi > lo, kept).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate("live", start, cut, lambda a: F.array_join(F.array_append(a["out"], F.substring(text, a["pos"] + 1, F.length(text))), MASK))
    done = hit.select("row", F.when(F.col("live").isNull(), text).otherwise(new).alias("new"), F.col("live").isNotNull().alias("changed"))

    def shown(c: str) -> Column:
        if c == "text":
            return F.col("new").alias(c)
        if c == "n_chars":
            return F.when(F.col("changed"), F.length("new").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c)
        return F.col("row").getField(c).alias(c)

    return plain.select("row.*").unionByName(done.select(*[shown(c) for c in held]))


def _oracle() -> str:
    """The query in DuckDB SQL: the same patterns, pieces and sums."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for n, (kind, pattern, group, least) in enumerate(KINDS):
        p = q(pattern.replace('\\"', '"'))
        parts.append(
            f"""SELECT rid, {n} AS kind_no, '{kind}' AS kind, start, start + length(m) AS stop, v FROM (
  SELECT rid, m, v, sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS start FROM (
    SELECT rid, unnest(ms) AS m, unnest(vs) AS v, unnest(list_slice(ps, 1, len(ms))) AS p, unnest(generate_series(1, len(ms))) AS i FROM (
      SELECT rid, string_split_regex(text, {p}) AS ps, regexp_extract_all(text, {p}, 0) AS ms, regexp_extract_all(text, {p}, {group}) AS vs FROM docs) WHERE len(ms) > 0))
  WHERE length(v) >= {least}"""
        )
    return (
        """WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS repo FROM documents),
spans AS ("""
        + "\nUNION ALL ".join(parts)
        + f"""),
owners AS (SELECT v, count(DISTINCT split_part(repo, '/', 1)) AS n_owners, count(DISTINCT repo) > 1 AS spread FROM spans JOIN docs USING (rid) GROUP BY v),
told AS (SELECT s.*, spread, CASE WHEN n_owners >= {MANY_OWNERS} THEN 'example'
  WHEN len(list_distinct(string_split(s.v, ''))) >= {VARIED} AND (kind <> 'pem' OR NOT regexp_matches(s.v, {q(PROSE)}))
    AND (kind = 'pem' AND length(s.v) >= {LONG} OR NOT regexp_matches(s.v, {q(PLACEHOLDERS)})) THEN 'live' ELSE 'placeholder' END AS verdict FROM spans s JOIN owners USING (v))
SELECT d.doc_id,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(BASE_KINDS)}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no), '') AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'live' AND spread) AS n_spread, count(*) FILTER (verdict = 'example') AS n_example
FROM docs d LEFT JOIN told USING (rid) GROUP BY d.rid, d.doc_id"""
    )


ORACLE = _oracle()
