"""Queries against DuckDB, and the parts that SQL can't state against plain Python."""

import math
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cardloom import catalog, registry
from cardloom.functions import text as T
from cardloom.operators import dedup as D
from cardloom.operators import evaluate as E
from cardloom.plans import query as Q
from cardloom.plans import rank as R
from cardloom.sources import feeds, files
from cardloom.streaming.ingest import ArticleStore, collected, ingest
from cardloom.streaming.jobs import JobLog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BASE = ["documents", "labels", "pages", "benchmark", "events", "conversations"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return float(x) if isinstance(x, int) and not isinstance(x, bool) else str(x) if x is not None and not isinstance(x, (bool, str)) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.ORACLES[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    expected = canon((float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in got.fetchall())
    assert canon(tuple(r) for r in df.select(*cols).collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dedup_recall(spark):
    assert registry.QUERIES["dup_recall"](spark, SF).first()["recall"] >= 0.85


def greedy(rows, threshold):
    """Brute force: best first, those with a kept neighbour go."""
    sets = {i: {(f"{title} {body[:500]}").lower()[k : k + 5] for k in range(len(f"{title} {body[:500]}") - 4)} for i, title, body, _ in rows}
    kept = []
    for i, *_ in sorted(rows, key=lambda r: (-len(r[2]) * r[3], r[0])):
        near = lambda a, b: (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= threshold
        if not any(near(i, j) for j in kept):
            kept.append(i)
    return set(kept)


def test_dedup_against_brute_force(spark):
    import random

    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [(f"a{i}", words(3), words(60), 0.5) for i in range(40)]
    base = words(70)
    for i in range(200):  # a large group of near copies, some of them better than others
        w = base.split()
        w[r.randrange(70)] = words(1)
        rows.append((f"n{i}", "near", " ".join(w) + " x" * r.randrange(4), r.choice([0.5, 0.7, 1.0])))
    rows += [(f"c{i}", "same", base, 0.5 + i / 1000) for i in range(50)] + [("e1", "", "", 0.5), ("e2", "", "ab", 0.5), ("e3", "a", "b", 0.9)]
    docs = spark.createDataFrame(rows, "id string, title string, body string, source_authority double")
    assert {x.id for x in D.deduplicated(docs).select("id").collect()} == greedy(rows, 0.8)
    assert D.deduplicated(docs, 1.0).count() == len(rows)


def test_pairs_against_brute_force(spark):
    import random

    r = random.Random(7)
    words = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [("e1", "", ""), ("e2", "", "ab")]
    for n, copies in [(k, 8) for k in (1, 3, 8, 20, 60, 90) for _ in range(4)] + [(700, 30)]:  # the last: sets of several size classes
        base = words(n).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(n // 8 + 1)):
                w[r.randrange(n)] = words(1)
            rows.append((f"n{len(rows)}", " ".join(w[: r.choice([100, 110, 140, 170, 700])]) if n > 90 else "t", "" if n > 90 else " ".join(w)))
    docs = spark.createDataFrame(rows, "id string, title string, body string")
    texts = {i: f"{title} {body[:500]}" for i, title, body in rows}
    sets = {i: frozenset(x[k : k + 5] for k in range(len(x) - 4)) for i, x in texts.items()}
    named = {x: min(i for i in sets if sets[i] == x) for x in sets.values()}
    copies = {(named[x], i): 1.0 for i, x in sets.items() if named[x] != i}
    for threshold in (0.9, 0.8, 0.6, 0.3):
        near = {(a, b): len(x & y) / len(x | y) for x, a in named.items() for y, b in named.items() if a < b and x and y}
        expected = {k: j for k, j in near.items() if j >= threshold} | copies
        assert {(x.a, x.b): x.jaccard for x in D.duplicates(docs, threshold, exact=True).collect()} == expected
        assert {(x.a, x.b): x.jaccard for x in D.duplicates(docs, threshold).collect()}.items() <= expected.items()


def test_different_texts_of_one_class_keep_their_links(spark):
    head = "a head that all of them share, " * 20
    rows = [("d", "t", head), ("b", "t", head + "one"), ("c", "t", head + "two"), ("c2", "t", head + "two"), ("a", "t", "so different " + head), ("a2", "T", "so different " + head), ("n1", None, None), ("n2", None, None), ("n3", "", ""), ("x", "t", "alone and like none of the others")]
    docs = spark.createDataFrame(rows, "id string, title string, body string").repartition(4)
    text = dict((i, (t, b)) for i, t, b in rows)
    heads = {i: "" if t is None else f"{t} {b[:500]}".lower() for i, t, b in rows}
    sets = {i: frozenset(x[k : k + 5] for k in range(len(x) - 4)) for i, x in heads.items()}
    first = {i: min(j for j in text if text[j] == text[i]) for i in text}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] or sets[b] else 1.0
    some = sorted(set(first.values()))
    expected = {(a, b): jaccard(a, b) for a in some for b in some if a < b and jaccard(a, b) >= 0.6} | {(first[i], i): 1.0 for i in text if first[i] != i}
    got = D.duplicates(docs, 0.6, exact=True).collect()
    assert len(got) == len(expected) == 13 and {(x.a, x.b): x.jaccard for x in got} == expected


def listed_part(sets, each, rows, pool):
    """Packed rows of one part: sets of 450 hashes with random bitmaps, and so many signatures of pool for each."""
    r, per = np.random.default_rng(0), sets // rows
    columns = [[0] * rows, [0] * rows, [], [], [], [], []]
    for i in range(rows):
        own = (np.arange(i * per, (i + 1) * per), np.full(per, 450, np.int32), r.integers(0, 256, (per, 8 * D.WORDS), np.uint8), np.full(per, each, np.int32), r.integers(0, pool, per * each, np.uint32))
        for x, held in zip(own, columns[2:], strict=True):
            held.append(x.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["part", "c", "k", "n", "bits", "counts", "s"])


def test_a_full_part_needs_little_memory():
    part = listed_part(400_000, 5, 200, 1 << 20)
    tracemalloc.start()
    for _ in D._met(0.8, 27)(iter([part])):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 130e6


def test_pairs_are_whole_whatever_is_held(monkeypatch):
    def pairs():
        found = [x for b in D._met(0.01, 3)(iter([listed_part(300, 30, 3, 400)])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        return {(block, *p) for block, n, *ends in found for p in zip(*(D._summed(x, n).tolist() for x in ends), strict=True)}

    whole = pairs()
    monkeypatch.setattr(D, "CHUNK", 64)
    assert len(whole) > 30_000 and pairs() == whole


def test_near_copies_that_meet_in_every_part_are_held_once():
    """1,500 near copies: each of 40 parts gives all their pairs."""
    texts = pa.table({"k": np.arange(1500), "id": [f"n{i}" for i in range(1500)], "s": ["a text of its own " * 3 + f"{i:04}" for i in range(1500)]})
    alike = listed_part(1500, 1, 1, 1).set_column(4, "bits", pa.array([bytes(1500 * 8 * D.WORDS)]))
    parts = list(D._met(0.8, 1)(iter([alike]))) * 40
    pairs = pa.Table.from_batches(parts)
    assert pairs.nbytes < 40 * 1500 * 1499 // 2  # a byte a pair; it was 16
    tracemalloc.start()
    got = D._compared(0.5)(pairs, texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 1500 * 1499 // 2 and most < 250e6


def test_parts_are_bounded_by_signatures_and_bytes():
    for signatures, sets in ((10**6, 10**5), (57 * 10**6, 440_000), (10**8, 800_000), (2 * 10**9, 15 * 10**6)):
        each = signatures / D._parts(signatures, sets)
        assert each <= D.PART and 4 * each + (12 + 8 * D.WORDS) * min(sets, each) <= D.ROOM


def test_dedup_keeps_one_article_without_a_text(spark):
    rows = [("a", None, None, 0.5), ("b", None, None, 0.9), ("c", "long enough", "text of c", None), ("d", "another title", "text of d", 0.5)]
    docs = spark.createDataFrame(rows, "id string, title string, body string, source_authority double")
    for exact in (False, True):
        assert {x.id for x in D.deduplicated(docs, exact=exact).collect()} == {"a", "c", "d"}
        assert {x.id for x in D.deduplicated(docs.unionByName(spark.createDataFrame([("z", "", "", 0.5)], docs.schema)), exact=exact).collect()} == {"c", "d", "z"}


def stored(spark):
    """Bytes of all checkpoints."""
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(folder) for x in names)


@pytest.mark.parametrize("name", ["dup_pairs_exact", "rank_pipeline", "exact_dedup", "lsh_pairs", "lsh_dedup", "dup_recall"])
def test_near_duplicates_store_less_than_their_input(spark, name):
    before = stored(spark)
    registry.QUERIES[name](spark, SF).count()
    assert stored(spark) - before < os.path.getsize(f"{SF}/documents.parquet")


def near_copies(spark, groups, each):
    """Groups of texts that differ in their first word, group by group in none of the orders of ids."""
    import random

    r = random.Random(11)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(90)) for _ in range(groups)]
    rows = [(f"d{(i * groups + g) * 7919 % 100_003:06}", "t", f"copy{i} {text}", 0.5 + i / 1000) for g, text in enumerate(texts) for i in range(each)]
    return rows, spark.createDataFrame(rows, "id string, title string, body string, source_authority double").repartition(8)


def test_near_copies_are_neighbours_by_number(spark):
    """Else a text is sent to as many pairs of blocks as it has near copies."""
    rows, docs = near_copies(spark, 60, 20)
    number = {x.id: x.k for x in D.classes(docs)[0].collect()}
    assert sorted(number.values()) == list(range(len(rows)))
    by_group = [[number[i] for i, *_ in rows[g : g + 20]] for g in range(0, len(rows), 20)]
    near = [abs(a - b) < 20 for group in by_group for a in group for b in group if a < b]
    assert sum(near) > 0.75 * len(near)


def test_edges_of_a_group_of_near_copies_are_stored_packed(spark):
    rows, docs = near_copies(spark, 1, 600)
    before = stored(spark)
    assert D.deduplicated(docs).count() == 1
    assert stored(spark) - before < 600 * 599 // 2 * 20  # 20 bytes a pair


def test_a_query_without_hits_counts_as_zero(spark):
    ranks = spark.createDataFrame([("v", "q1", "a", 1), ("v", "q2", "b", 1)], "variant string, query_id string, id string, rank int")
    qrels = spark.createDataFrame([("q1", "a"), ("q2", "a")], "query_id string, id string")
    assert E.variant_means(ranks, qrels).first().asDict() == {"variant": "v", "n": 2} | dict.fromkeys(E.GATES, 0.5)


def test_rank_pipeline_counts_what_stays(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta " * 4
    rows = [(f"c{i}", "t", text, 0.5) for i in range(30)] + [("a", "t", "alpha alone in another text", 0.5), ("b", "t", "nothing of the kind", 0.5)]
    docs = spark.createDataFrame(rows, "id string, title string, body string, source_authority double").withColumn("published_on", F.to_date(F.lit("2025-01-01")))
    got = R.pipeline(docs, Q.Mode(keywords=[Q.Keyword("alpha")]), "2025-01-01", threshold=0.0).orderBy("position").collect()
    one = docs.where("id in ('a', 'b', 'c0')")
    alone = {x.id: round(x.score, 9) for x in R.scored(one, Q.Mode(keywords=[Q.Keyword("alpha")]), "2025-01-01").collect()}
    assert {x.id: round(x.score, 9) for x in got} == {i: alone[i] for i in ("a", "c0")}


def test_presets():
    assert [Q.preset(n).keywords[0].term for n in Q.PRESETS] == ["実装", "定理", "リリース"]
    assert (Q.preset("theory").k1, Q.preset("theory").morph_weight) == (1.8, 0.35)


def test_query_parser():
    p = Q.parse('"SQLite BM25" 保存済みカード -UI -"x y"', {"sqlite bm25": ["fts"]})
    assert (p.phrases, p.terms, p.excluded) == (["sqlite bm25"], ["保存済みカード"], ["ui", "x y"])
    assert [(k.term, k.weight, k.synonyms) for k in p.keywords] == [("sqlite bm25", 3.0, ["fts"]), ("保存済みカード", 1.0, [])]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_parser_never_fails(raw):
    p = Q.parse(raw)
    assert all(x == Q.norm(x) for x in p.phrases + p.terms + p.excluded)


@given(st.floats(0, 10), st.integers(0, 9))
def test_phrase_weight(w, n):
    got = T.phrase_weight(w, n)
    assert got == w if n <= 1 else got <= 3.0


def test_limits():
    assert [Q.clamp_limit(x, 20) for x in (None, 0, -1, 7.9, 1000)] == [20, 20, 20, 7, 100]


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("全文検索 Engine と engine",)], "s string")
    r = df.select(*[c.alias(n) for c, n in zip(T.stored_tokens(F.col("s")), ("m", "n"), strict=True)]).first()
    assert r.m == ["全文検索", "engine", "engine"]
    assert r.n == ["全文検索", "engine", "全文", "文検", "検索"]


def test_normalize(spark):
    df = spark.createDataFrame([(" ＡＢｃ ",), ("Abc",), (None,)], "s string")
    assert [r[0] for r in df.select(T.normalize(F.col("s"))).collect()] == ["abc", "abc", None]


def test_rank_semantics(spark):
    rows = [("a", "t", "alpha beta gamma", "2024-12-31"), ("b", "t", "alpha delta delta", "2024-12-31"), ("c", "t", "omega", "2024-12-31"), ("d", "t", "alpha beta", "2025-06-01")]
    docs = spark.createDataFrame(rows, "id string, title string, body string, published_on string").withColumn("published_on", F.to_date("published_on"))
    mode = Q.Mode(keywords=[Q.Keyword("alpha"), Q.Keyword("beta")], decay=0.01)
    got = {r.id: r for r in R.scored(docs, mode, "2025-01-01").collect()}
    assert got["a"].score > got["b"].score > got["c"].score == 0
    assert got["d"].decay > 1  # a future date
    assert [r.id for r in R.ranked(docs, mode, "2025-01-01", 2).collect()] == ["d", "a"]
    assert R.scored(docs, Q.Mode(), "2025-01-01").count() == 0


def test_synonyms_collapse(spark):
    docs = spark.createDataFrame([("a", "t", "car automobile"), ("b", "t", "car")], "id string, title string, body string").withColumn("published_on", F.to_date(F.lit("2025-01-01")))
    mode = Q.Mode(keywords=[Q.Keyword("car", 1.0, ["automobile"])])
    got = {r.id: r.ngram_score for r in R.scored(docs, mode, "2025-01-01").collect()}
    assert got["a"] > got["b"] > 0


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "x.csv").write_text('title,body,tags\nCSV card,"say ""hi""","csv,import"\nNo body,,\n', "utf-8")
    rows = files.read_csv(spark, str(tmp_path / "x.csv")).collect()
    assert [(r.title, r.body, r.tags) for r in rows] == [("CSV card", 'say "hi"', ["csv", "import"]), ("No body", "", [])]
    df = spark.createDataFrame([('[{"name":"n","content":"c"}]',), ("not json",), ('{"title":"solo"}',)], "text string")
    assert sorted((r.title, r.body) for r in files.from_json(df).collect()) == [("n", "c"), ("solo", "solo")]


def test_empty_feeds(spark):
    none = spark.createDataFrame([], "name string, text string")
    assert feeds.collected(feeds.rss(none, "2025"), feeds.atom(none), feeds.repositories(none)).count() == 0


def test_stream_upsert_keeps_first_seen(spark, tmp_path):
    schema = "id string, url string, title string, created_on string, first_seen_on string, candidate_status string"
    for k, rows in enumerate(([("1", "u1", "old", "d1", "d1", "unreviewed")], [("1", "u1", "new", "d2", "d2", "unreviewed"), ("2", "u1", "same url", "d2", "d2", "unreviewed"), ("3", "u3", "x", "d2", "d2", "unreviewed")])):
        spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", seq int").write.parquet(str(tmp_path / "in" / f"{k}"))
    for k in range(2):
        store = ArticleStore(spark, str(tmp_path / "store"), spark.createDataFrame([], schema).schema)  # as a new process would
        source = spark.readStream.schema(schema + ", seq int").parquet(str(tmp_path / "in" / f"{k}"))
        q = ingest(source, store, str(tmp_path / f"check{k}"))
        q.awaitTermination(60)
    store.upsert(store.read().withColumn("title", F.lit("again")).withColumn("seq", F.lit(0)), 0, str(tmp_path / "check1"))  # applied before
    got = {r.id: r for r in store.read().collect()}
    assert set(got) == {"1", "3"}
    assert (got["1"].title, got["1"].created_on, got["1"].first_seen_on) == ("new", "d1", "d1")


def test_collection_goes_on_without_a_failing_source(spark, tmp_path):
    schema = "id string, url string, title string, created_on string, first_seen_on string, candidate_status string"
    rows = lambda i: spark.createDataFrame([(i, f"u{i}", "t", "d", "d", "unreviewed", 0)], schema + ", seq int")

    def broken():
        raise OSError("no answer")

    store = ArticleStore(spark, str(tmp_path / "s"), spark.createDataFrame([], schema).schema)
    got = collected({"a": lambda: rows("1"), "b": broken, "c": lambda: rows("2")}, store, "hourly", 0)
    assert got == [("a", 1, None), ("b", 0, "no answer"), ("c", 1, None)]
    assert {r.id for r in store.read().collect()} == {"1", "2"}
    for n in range(1, 7):
        collected({"a": lambda: rows(str(n))}, store, "hourly", n)
    assert store.read().count() == 6 and len(store.versions()) <= 4


def test_exports(spark, tmp_path):
    files.export_json(str(tmp_path / "x"), cards=spark.createDataFrame([("1", "t")], "id string, title string"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "x" / "cards")).collect()] == [("1", "t")]


def test_replaced_table_is_whole_or_old(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), "card_id string, tag string")
    store = ArticleStore(spark, str(tmp_path / "t"), df(("x", "x")).schema)
    for rows in ([("1", "a"), ("2", "b")], [("3", "c")], [("1", "d")]):
        store.replace(df(*rows))
    (tmp_path / "t" / "v9-abc-0").mkdir()  # a writer that was lost
    assert [tuple(r) for r in store.read().collect()] == [("1", "d")]


def test_job_log(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "jobs"))
    good, done = log.submit("sum", lambda: {"n": 3})
    done.result(60)
    bad, done = log.submit("sum", lambda: 1 / 0)
    done.result(60)
    log._append([("lost", "sum", "running", 1, None, None, None, None)])
    JobLog(spark, str(tmp_path / "jobs")).recover()
    got = {r.id: r for r in log.states().collect()}
    assert (got[good].status, got[good].result_json, got[good].error) == ("succeeded", '{"n": 3}', None)
    assert (got[bad].status, got[bad].error) == ("failed", "division by zero")
    assert got["lost"].status == "failed" and len(got) == 3
    assert [r.id for r in log.listed().collect()][:2] == [bad, good] and log.get(good).count() == 1


def test_stored_articles(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":" 1 ","title":"t","url":"u","published_at":"2024-02-03T01:00:00Z","tokens":["a","b"]},\n {"id":"2","title":" ","url":"u"}]', "utf-8")
    kept, rejected = files.read_articles(spark, str(tmp_path / "a.json"), "2025-01-01")
    r = kept.first()
    assert (r.id, r.body, r.source_authority, str(r.published_on), r.doc_length) == ("1", "", 0.0, "2024-02-03", 2)
    assert kept.count() == 1 and rejected.count() == 1
