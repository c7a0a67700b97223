"""Enrichment that is lost half way, and tables kept in step with changes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import enrichment as E
from lexmill.sources import manifest as M
from lexmill.streaming.synced import SyncedTable

CHUNKS = "document long, chunk_id string, chunk_index int, act string, section string, text string"


def chunks(spark, changed=()):
    rows = []
    for d in range(12):
        for i in range(4):
            text = f"Under section {(d + i) % 5 + 1} and section 99 of the law, words of document {d}." if (d, i) not in changed else "Section 2 says something else now."
            rows.append((d, f"{d}-{i}", i, "act" if d % 2 else None, str((d * 4 + i) % 7) if i % 2 else None, text if i != 3 else "short"))
    return spark.createDataFrame([*rows, (50, "n", 0, None, None, None)], CHUNKS)


def got(df):
    return sorted(map(str, df.select("document", "chunk_id", "before", "after", "names", "targets", "status").collect()))


def test_a_job_lost_between_rows_and_commit(spark, tmp_path, monkeypatch):
    plain = got(E.once(chunks(spark)))
    path, commit, calls = str(tmp_path), E.Ledger.commit, []

    def lost(self, name, entry):
        calls.append(name)
        if len(calls) == 4:
            raise RuntimeError("lost")
        commit(self, name, entry)

    monkeypatch.setattr(E.Ledger, "commit", lost)
    with pytest.raises(RuntimeError):
        E.run(chunks(spark), path, 5)
    half = got(E.rows(spark, path))
    assert len(calls) == 4 and set(half) < set(plain)
    monkeypatch.setattr(E.Ledger, "commit", commit)
    again = E.run(chunks(spark), path, 5)
    assert again["passed"] == 2 and got(E.rows(spark, path)) == plain
    assert E.run(chunks(spark), path, 5)["written"] == 0


def test_changed_documents_alone_are_done_again(spark, tmp_path):
    path = str(tmp_path)
    first = E.run(chunks(spark), path, 8)
    second = E.run(chunks(spark, {(3, 1)}), path, 8)
    assert (second["written"], second["passed"]) == (1, first["written"] - 1)
    assert got(E.rows(spark, path)) == got(E.once(chunks(spark, {(3, 1)})))
    assert len(os.listdir(f"{path}/rows")) == first["written"]


def test_documents_that_are_gone(spark, tmp_path):
    path = str(tmp_path)
    E.run(chunks(spark), path, 8)
    E.run(chunks(spark).where("document < 2"), path, 8)
    assert got(E.rows(spark, path)) == got(E.once(chunks(spark).where("document < 2")))


def test_enriched_rows(spark):
    rows = {r.chunk_id: r for r in E.once(chunks(spark)).collect()}
    assert (rows["1-1"].before, rows["1-1"].after, rows["1-1"].names) == ("1-0", "1-2", ["3", "99"])
    assert rows["1-3"].status == "FAILED" and rows["n"].status == "FAILED" and rows["n"].names == []
    assert all(c not in r.targets for c, r in rows.items())


def test_text_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "a/b.json")
    assert M.text_of(spark, path) is None
    for text in ("one é", "two"):
        M.replace_text(spark, path, text)
        assert M.text_of(spark, path) == text
    assert M.names_in(spark, str(tmp_path / "a")) in (["b.json"], [".b.json.crc", "b.json"])


ROWS = "doc long, chunk string, n long, v string, op string"


def model(changes, keep_for, newest_of=lambda seen: max(seen)):
    """The table after each batch, change by change."""
    live, gone, gone_parents, seen = {}, {}, {}, []
    for batch in changes:
        for d, c, n, v, op in batch:
            if d is None or n is None or (c is None and op != "delete_parent"):
                continue
            seen.append(n)
            if op == "delete_parent":
                gone_parents[d] = max(n, gone_parents.get(d, n))
            elif (d, c) not in live or (n, op == "delete", v or "") >= (live[d, c][0], live[d, c][2] == "delete", live[d, c][1] or ""):
                live[d, c] = (n, v, op)
        live = {k: x for k, x in live.items() if not (k[0] in gone_parents and x[0] <= gone_parents[k[0]])}
        if seen:
            live = {k: x for k, x in live.items() if x[2] != "delete" or x[0] >= max(seen) - keep_for}
            gone_parents = {d: n for d, n in gone_parents.items() if n >= max(seen) - keep_for}
    return sorted((d, c, n, v) for (d, c), (n, v, op) in live.items() if op == "upsert")


@pytest.mark.parametrize("keep_for", [1000, 5])
def test_synced_table_equals_a_model(spark, tmp_path, keep_for):
    rng = random.Random(keep_for)
    table = SyncedTable(spark, str(tmp_path), "doc", "chunk", "n", buckets=4, keep_for=keep_for)
    batches, at = [], 0
    for number in range(6):
        batch = []
        for _ in range(rng.randrange(1, 12)):
            at += 1
            late = at - rng.choice([0, 0, 0, 7])
            op = rng.choice(["upsert", "upsert", "upsert", "delete", "delete_parent"])
            batch.append((rng.choice([None, *range(5)]), None if op == "delete_parent" else rng.choice("abc"), late, rng.choice("xyz"), op))
        batches.append(batch)
        table.apply(spark.createDataFrame(batch, ROWS), number)
        table.apply(spark.createDataFrame(batch, ROWS), number)
        assert sorted(map(tuple, table.read().collect())) == model(batches, keep_for)


def test_untouched_buckets_keep_their_files_and_old_versions_go(spark, tmp_path):
    table = SyncedTable(spark, str(tmp_path), "doc", "chunk", "n", buckets=8, versions=2)
    table.apply(spark.createDataFrame([(d, "a", 1, "x", "upsert") for d in range(40)], ROWS))
    before = table.manifest()["folders"]
    table.apply(spark.createDataFrame([(7, "a", 2, "y", "upsert"), (7, "b", 3, "z", "upsert")], ROWS))
    after = table.manifest()["folders"]
    touched = [b for b in before if before[b] != after[b]]
    assert len(touched) == 1 and len(before) > 4
    table.apply(spark.createDataFrame([(7, None, 9, None, "delete_parent")], ROWS))
    table.apply(spark.createDataFrame([(7, "c", 4, "late", "upsert")], ROWS))
    assert sorted(os.listdir(f"{tmp_path}/manifest"))[-1] == "4.json" and {n for n in os.listdir(f"{tmp_path}/manifest") if n.endswith(".json")} == {"3.json", "4.json"}
    assert not os.path.exists(f"{tmp_path}/data/v2/_bucket={touched[0]}")
    assert not os.path.exists(f"{tmp_path}/data/v1/_bucket={touched[0]}")
    assert sorted(r.doc for r in table.read().collect()) == [d for d in range(40) if d != 7]
    assert sorted(r.doc for r in table.read(3).collect()) == [d for d in range(40) if d != 7]


def test_a_stream_of_changes_is_applied_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[(1, "a", 1, "x", "upsert"), (2, "a", 1, "y", "upsert")], [(1, None, 2, None, "delete_parent")], [(2, "b", 3, "z", "upsert")]]
    for i, rows in enumerate(batches):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps(dict(zip(("doc", "chunk", "n", "v", "op"), r, strict=True))) for r in rows))
    table = SyncedTable(spark, str(tmp_path / "t"), "doc", "chunk", "n", buckets=4)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):
        table.keep(stream, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, table.read().select("doc", "chunk", "v").collect())) == [(2, "a", "y"), (2, "b", "z")]
    assert table.manifest()["batch"] == 2


def test_nothing_to_apply(spark, tmp_path):
    table = SyncedTable(spark, str(tmp_path), "doc", "chunk", "n")
    assert table.apply(spark.createDataFrame([(None, "a", 1, "x", "upsert")], ROWS))["version"] == 0
    assert table.apply(spark.createDataFrame([], ROWS).where(F.lit(False)))["version"] == 0


def test_a_lookup_of_few_ids_opens_few_files(spark, tmp_path):
    from lexmill.sources import lookup as K

    path = str(tmp_path / "t")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k string, v string")
    many = rows(*[(str(i), f"v{i}") for i in range(500)], ("7", "a7"), (None, "none"))
    table = K.build_lookup({"second": rows(("x", None), ("7", "own")), "first": many}, path, "k", 32)
    ids = spark.createDataFrame([("7",), ("x",), ("499",), ("gone",), (None,), ("7",)], "id string")
    assert sorted(map(tuple, table.payloads(ids).collect())) == [("499", "first", '{"k":"499","v":"v499"}'), ("7", "first", '{"k":"7","v":"a7"}'), ("x", "second", '{"k":"x","v":null}')]
    assert sorted((r.id, r.collection) for r in table.all_of(ids).collect()) == [("499", "first"), ("7", "first"), ("7", "second"), ("x", "second")]
    found = table.all_of(ids)
    found.collect()
    scans = [m for m in _scans(found) if "numFiles" in m]
    assert scans and sum(m["numFiles"] for m in scans) <= 4 < len(os.listdir(path)) // 4
    every = table.all_of(spark.range(3000).selectExpr("cast(id AS string) AS id"))
    assert every.count() == 501


def _scans(df):
    """Metrics of the scans of a DataFrame that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves, out = plan.collectLeaves(), []
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        names = metrics.keys().toSeq()
        out.append({names.apply(k): metrics.apply(names.apply(k)).value() for k in range(names.size())})
    return out
