"""Sources, sinks, streams, graphs and rules on small inputs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.operators import evidence, ingest, joins, metrics
from lexmill.operators import graph as G
from lexmill.operators import retrieval as R
from lexmill.operators.rules import Registry, Rule, SeenHashes, Stage, evaluate, run_stages
from lexmill.plans import registry
from lexmill.plans._registering import register
from lexmill.sources import readers, sinks
from lexmill.streaming import state, windows


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "b.md").write_text("one\ftwo")
    rows = readers.text_files(spark, str(tmp_path)).orderBy("path", "sheet").collect()
    assert [r.text for r in rows] == ["café", "one", "two"]


def test_archive(spark, tmp_path):
    points = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    sinks.save_archive(points, str(tmp_path / "x"))
    assert sorted(map(tuple, readers.point_archive(spark, str(tmp_path / "x")).select("id", "text").collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        sinks.save_archive(points.where("false"), str(tmp_path / "y"))


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n,ok,at\n1,Yes,2024-01-02\nNone,no,x\n")
    rows = readers.typed_csv(spark, str(tmp_path / "t.csv"), StructType.fromDDL("n int, ok boolean, at date")).collect()
    assert [(r.n, r.ok, r["at"] and str(r["at"])) for r in rows] == [(1, True, "2024-01-02"), (None, False, None)]


def test_loose_json(spark, tmp_path):
    (tmp_path / "t.json").write_text("{a: 1, 'b': 'x'}")
    assert tuple(readers.loose_json(spark, str(tmp_path / "t.json")).first()) == (1, "x")


def test_csv_escapes(spark, tmp_path):
    sinks.save_csv(spark.createDataFrame([("=1",)], "a string"), str(tmp_path / "c"))
    assert "'=1" in "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))


def test_delete_prefers_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, document_id string")
    ids = rows.where("chunk_id = 1")
    assert [r[0] for r in sinks.without(rows, ids, rows).collect()] == [2]


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    query = windows.tumbling(stream, "1 day", ["event_type"]).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, windows.tumbling(events, "1 day", ["event_type"]).collect()))


def test_breaker_stream(spark, tmp_path):
    rows = [("k", f"2024-01-01T00:00:{s:02d}", failed) for s, failed in ((0, True), (1, True), (2, False), (20, False), (21, True))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"key": k, "ts": t, "failed": f}) for k, t, f in rows))
    stream = spark.readStream.schema("key string, ts timestamp, failed boolean").json(str(tmp_path / "in"))
    query = state.breaker_stream(stream, "key", 2, 10).writeStream.format("memory").queryName("broke").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.state for r in spark.table("broke").orderBy("ts").collect()] == ["closed", "open", "open", "closed", "closed"]


def test_sync_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(([(1, "a", 1, "upsert")], [(1, "b", 2, "upsert"), (2, "c", 2, "delete")])):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps(dict(zip(("id", "v", "n", "op"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema("id long, v string, n long, op string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    state.sync_table(stream, str(tmp_path / "out"), "id", ["n"], str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out/v=1"))
    assert sorted(map(tuple, state.latest_state(last, "id", ["n"]).collect())) == [(1, "b", 2)]


def test_components_of_a_long_path(spark):
    nodes = spark.range(40).withColumnRenamed("id", "id")
    edges = spark.range(39).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in G.components(nodes, edges).collect()} == {0}


def test_components_move_ever_fewer_links(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(G, "saved", lambda df, keep=G.saved: rows.append((out := keep(df)).count()) or out)
    pairs = sorted({(i * 37 % 300 + 1, -(i * i % 23) - 1 - 23 * (i * 37 % 300 // 150)) for i in range(900)} | {(500, 500), (501, 502), (502, 503), (504, 503), (7, 7)})
    low = {x: x for p in pairs for x in p}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    edges = spark.createDataFrame([*pairs, (None, 600), *pairs[:50]], "src long, dst long")
    got = G.components(None, edges).collect()
    assert len(got) == len(low) and {r.id: r.component for r in got} == low
    assert sum(rows) < 2 * len(pairs)
    some = spark.createDataFrame([(1,), (700,)], "id long")
    assert {r.id: r.component for r in G.components(some, edges).collect()} == {1: low[1], 700: 700}


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3)], "src long, dst long")
    assert sorted(map(tuple, G.reach(edges, spark.createDataFrame([(1,)], "id long"), 2).collect())) == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_fusion_golden(spark):
    lists = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "b", 1, "y")], "query long, arm string, rank int, item string")
    got = {r.item: r.score for r in R.rrf(lists).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 1 / 61)}


def test_rules_and_registry(spark):
    rows = spark.range(4)
    assert evaluate(rows, "id", [Rule("even", "info", F.col("id") % 2 == 0)]).count() == 2
    registry = Registry()
    registry.add("small")(lambda df: df.where("id < 2"))
    assert registry("small", rows).count() == 2
    with pytest.raises(KeyError):
        registry("none", rows)
    broken = Stage("broken", lambda df: df.select("nothing"), isolate=True)
    assert run_stages(rows, [broken, Stage("off", lambda df: df.limit(0), enabled=False)]).count() == 4
    hashes = rows.select(F.col("id").cast("string").alias("hash"))
    new, seen = SeenHashes(hashes.where("hash < '2'")).split(hashes)
    assert (new.count(), seen.count()) == (2, 2)


def test_cleaning_diff_reads_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = registry.QUERIES["cleaning_diff"](spark, "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())


def test_cosine_hits_without_bound(spark):
    points = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(8)], "item long, v array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query long, q array<double>")
    hits = R.cosine_topk(points, queries, None, 0.9).collect()
    assert sorted(r.item for r in hits) == [0, 1, 2, 3, 4]


def test_fuzzy_scores_read_whole_turns(spark, tmp_path):
    """60 of 120 characters are common, all of them in front."""
    rows = [("c", 0, "user", "x" * 60 + "a" * 60), ("c", 1, "user", "x" * 60 + "b" * 60)]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    (row,) = registry.QUERIES["fuzzy_scores"](spark, str(tmp_path)).collect()
    assert row.ratio == pytest.approx(50)


def test_ingestion_can_be_run_again(spark):
    long = "a sentence of several words that goes on for a while and then some more " * 20
    rows = [(1, long), (2, f"  {long}"), (3, None), (4, ""), (5, "short"), (6, f"{long}and another end"), (7, long + "b" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = ingest.ingest(docs.where("doc_id < 6"), "doc_id", "text")
    assert {r.document for r in first.collect()} == {1}
    later = ingest.ingest(docs, "doc_id", "text", first)
    assert {r.document for r in later.collect()} == {6, 7}
    assert ingest.ingest(docs, "doc_id", "text", first.unionByName(later)).count() == 0
    assert ingest.ingest(docs.where("false"), "doc_id", "text").count() == 0


def test_bootstrap_interval_covers_the_mean(spark):
    rows = spark.range(4000).selectExpr("id % 2 AS grp", "CASE WHEN id % 2 = 0 THEN rand(7) ELSE rand(8) + 0.5 END AS a", "0.5D AS b").withColumnRenamed("grp", "group")
    found = {r.group: r for r in metrics.paired_bootstrap(rows, 400).collect()}
    assert found["0"].low < 0 < found["0"].high and not found["0"].significant
    assert found["1"].significant and found["1"].low < found["1"].mean < found["1"].high
    width = found["1"].high - found["1"].low
    assert width == pytest.approx(2 * 1.96 * (1 / 12 / 2000) ** 0.5, rel=0.2)
    assert metrics.paired_bootstrap(rows.where("false"), 10).count() == 0


def test_isotonic_pools_violators(spark):
    rows = spark.createDataFrame([("g", s, y) for s, y in ((1.0, 0), (2.0, 1), (2.0, 1), (3.0, 0), (4.0, 1))], "group string, score double, label int")
    assert [(r.from_score, round(r.value, 6)) for r in metrics.isotonic(rows).orderBy("from_score").collect()] == [(1.0, 0.0), (2.0, 0.666667), (4.0, 1.0)]


def test_cosine_of_many_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    points = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(8)], "item long, v array<double>")
    queries = points.withColumnsRenamed({"item": "query", "v": "q"})
    assert {(r.query, r.item) for r in R.cosine_topk(points, queries, 1).collect()} == {(i, i) for i in range(8)}


def test_conflicts_are_counted_not_paired(spark):
    facts = spark.createDataFrame([("k", 1, ["5"]), ("k", 2, ["5", "6"]), ("k", 3, ["7"]), ("k", 4, []), ("m", 5, ["7"])], "k string, id long, v array<string>")
    assert {(r.id, r.n_conflicts) for r in joins.conflicts(facts, "k", "id", "v").collect()} == {(1, 1), (2, 1), (3, 2), (5, 0)}


def test_conflicts_of_values_that_many_hold(spark, monkeypatch):
    """Seldom values, subsets of frequent ones, and sets with too many of these, against all pairs; null keys, null and repeated orders."""
    monkeypatch.setattr(joins, "OFTEN", 3)
    monkeypatch.setattr(joins, "SUBSETS", 2)
    rows = [("k", i, sorted({str(i % 3), str(i % 4), str(i % 7), str(i * i % 11), *("x" for _ in range(i % 2))})[: i % 6]) for i in range(40)]
    rows += [("k", 7, ["9", None]), ("k", None, ["0"]), (None, 50, ["0"]), (None, 51, ["0", "1"]), ("m", 52, ["1", "1"]), ("m", 53, None)]
    want = {}
    for k, i, v in rows:
        if v:
            want[k, i] = want.get((k, i), 0) + sum(k is not None and k == m and j is not None and bool(w) and not set(v) & set(w) for m, j, w in rows)
    got = joins.conflicts(spark.createDataFrame(rows, "k string, id long, v array<string>"), "k", "id", "v").collect()
    assert len(got) == len(want) and {(r.k, r.id): r.n_conflicts for r in got} == want


def test_bundle_takes_the_best_group_that_satisfies(spark):
    rows = [(1, "a", 1, 9.0, False), (1, "a", 2, 8.0, None), (1, "a", 3, 7.0, False), (1, "b", 4, 5.0, True), (1, "b", 5, 5.0, True), (1, "b", 6, 4.0, False), (2, "c", 7, 1.0, False)]
    df = spark.createDataFrame(rows, "q int, g string, i int, s double, good boolean")
    got = sorted(tuple(r) for r in evidence.bundle(df, "q", "g", "i", "s", F.col("good")).collect())
    assert got == [(1, "a", 1, "related", 1), (1, "a", 2, "related", 2), (1, "b", 4, "primary", 1), (1, "b", 5, "primary", 2), (2, "c", 7, "related", 1)]
    assert evidence.bundle(df.limit(0), "q", "g", "i", "s", F.col("good")).collect() == []


def test_task_coverage_counts_tasks_without_chunks(spark):
    tasks = spark.createDataFrame([(0, 1, "fine for milk"), (0, 2, "licence of sellers"), (0, 3, None)], "plan int, task int, question string")
    chunks = spark.createDataFrame([(1, "The FINE on milk"), (1, None), (3, "milk")], "task int, text string")
    assert [tuple(r) for r in evidence.task_coverage(tasks, chunks, "plan", "task", 0.5).collect()] == [(0, 3, 1, 0.3333)]


def test_edges_from_text_and_unique_names(spark):
    df = spark.createDataFrame([(1, "see section 4(2) and rule 7"), (None, "section 9"), (2, None)], "id int, text string")
    got = {(r["source"], r["target"]) for r in evidence.text_edges(df, "id", "text", F.lit("A")).collect()}
    assert got == {(1, "A::4(2)"), (1, "A::7")}
    with pytest.raises(ValueError, match="twice"):
        register("bm25_topk", None, "documents")


def test_iterative_retrieval_equals_a_loop_per_query(spark):
    import random

    from lexmill.operators import iterative

    rng = random.Random(3)
    words = "food act rule penalty appeal licence water milk".split()
    kinds = ["statute", "penalty", "procedure", "power"]
    items = [(i, rng.choice(kinds), rng.sample(words, rng.randrange(1, 5))) for i in range(60)]
    asked = {q: rng.sample(words, 2) for q in range(12)} | {50: ["nowhere"]}
    needs = {q: kinds[: rng.randrange(5)] for q in asked}
    extra = {"statute": ["act"], "penalty": ["penalty", "appeal"], "procedure": ["rule"], "power": ["nowhere"]}

    def found(terms):
        hits = [(len(set(terms) & set(w)), i, k) for i, k, w in items if set(terms) & set(w)]
        return sorted(hits, key=lambda h: (-h[0], h[1]))[:6]

    def evidence(pool):
        pool = sorted(pool, key=lambda h: (-h[0], h[1]))[:8]
        seen, first, rest = set(), [], []
        for h in pool:
            (rest if h[2] in seen else first).append(h)
            seen.add(h[2])
        return pool, (first + rest)[:5]

    want = {}
    for q, terms in asked.items():
        pool, own = evidence(found(terms))
        gaps, rounds = [], 1
        for _ in range(2):
            missing = [k for k in needs[q] if k not in {h[2] for h in own}]
            if not missing or 1 - len(missing) / len(needs[q]) >= 0.7:
                break
            best = {}
            for n, i, k in pool + found(terms + extra[missing[0]]):
                best[i] = max(best.get(i, (0, i, k)), (n, i, k))
            pool, own = evidence(best.values())
            gaps.append(missing[0])
            rounds += 1
        missing = [k for k in needs[q] if k not in {h[2] for h in own}]
        want[q] = (rounds, round(1 - len(missing) / len(needs[q]), 6) if needs[q] else 1.0, gaps, [(i, k, n) for n, i, k in own])

    corpus = spark.createDataFrame([(i, k, w) for i, k, ws in items for w in ws], "item long, kind string, term string")

    def fetch(terms):
        score = terms.distinct().join(corpus, "term").groupBy("query", "item", "kind").agg(F.count("*").cast("double").alias("score"))
        return R.top_per(score, ["query"], [F.desc("score"), F.asc("item")], 6).drop("rank")

    queries = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query long, term string")
    required = spark.createDataFrame([(q, k, p) for q, ks in needs.items() for p, k in enumerate(ks)], "query long, kind string, priority int")
    gap_terms = spark.createDataFrame([(k, t) for k, ts in extra.items() for t in ts], "kind string, term string")
    evidence_rows, report = iterative.iterate(queries, required, gap_terms, fetch, 3, 0.7, 8, 5)
    got = {r.query: [r.rounds, round(r.coverage, 6), list(r.gaps), []] for r in report.collect()}
    for r in evidence_rows.orderBy("query", "place").collect():
        got[r.query][3].append((r.item, r.kind, r.score))
    assert {q: tuple(x) for q, x in got.items()} == want
    assert len({x[0] for x in want.values()}) == 3
