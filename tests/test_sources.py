"""Readers, log parsing, ledgers and streaming forms on small files."""

from __future__ import annotations

import collections
import json
import random

import pytest
from pyspark.sql import Row as spark_row
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from weftline.operators import scans
from weftline.sources import articles, logs, samples
from weftline.streaming import incremental, uploads

LOG = """2024-01-05 10:00:00,123 INFO 💬 dropped
2024-01-05 10:00:01,12 session_ab_1 start
2024-01-05 10:00:02,123 INFO 💬  first query   here
2024-01-05 10:00:03,123 session_cd_2 💬 second
2024-01-05 10:00:04,123 ⛔ failed
2024-01-05 10:00:05,123 session_ab_1 ⛔ late
2024-01-05 10:00:06,123 session_ef_3 ⛔ nothing asked
2024-01-05 10:00:07,123 INFO 💬 third ⛔
"""


@pytest.fixture
def log_dir(tmp_path):
    (tmp_path / "a.log").write_bytes(LOG.replace("\n", "\r\n").encode())
    (tmp_path / "b.log").write_text("2024-01-05 10:00:09,123 💬 before any session\nx session_zz_9\n2024-01-05 10:00:03,123 💬 second\n", encoding="utf-8")
    return tmp_path


def test_log_entries(spark, log_dir):
    got = logs.entries(logs.read_lines(spark, [f"{log_dir}/a.log"])).orderBy("line_no").collect()
    assert [(r.search_query, r.session_id, r.has_error) for r in got] == [("first query   here", "session_ab_1", True), ("second", "session_cd_2", True), ("third ⛔", "session_ef_3", True)]


def test_missing_files_give_no_rows(spark, log_dir):
    assert logs.read_lines(spark, [f"{log_dir}/none.log"]).count() == 0


def test_large_reader_numbers_lines_over_splits(spark, tmp_path):
    """Files of many splits, packed several to a task, give the numbers of the whole-file reader."""
    ends = ["\n", "\r\n"]
    for k, n in enumerate((700, 1, 333)):
        (tmp_path / f"{k}.log").write_bytes("".join(f"{'x' * (j * 7 % 50)} {k} {j}{ends[j % 2]}" for j in range(n)).encode())
    paths = [f"{tmp_path}/{k}.log" for k in range(4)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        large = logs.read_large(spark, paths)
        assert large.rdd.getNumPartitions() > 7
        got = sorted(map(tuple, large.collect()))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == sorted(map(tuple, logs.read_lines(spark, paths).collect()))
    assert logs.read_large(spark, paths[3:]).collect() == []


@pytest.mark.parametrize("span", [1, 3, 10, 10**6])
def test_scans_over_parts_are_scans_of_the_whole(spark, span):
    """Sessions and islands that reach over many parts, parts without rows of their own, numbers with gaps."""
    r = random.Random(span)
    rows = [(f, 5 * k - 40, r.choice([None, None, None, None, "p", "q"]), r.random() < 0.15, r.random() < 0.1) for f in ("a", "b", None) for k in range(60)]
    df = spark.createDataFrame(rows, "f string, k long, s string, opens boolean, bad boolean").repartition(3)
    held, want_filled, open_, want = {}, [], {}, {}
    for f, k, s, opens, bad in rows:
        held[f] = s or held.get(f)
        want_filled.append((f, k, held[f]))
        key = (f, held[f])
        if opens:
            open_[key] = k
            want[f, held[f], k] = False
        if bad and key in open_:
            want[f, held[f], open_[key]] = True
    full = scans.filled(df, F.col("s"), "session", ["f"], "k", span)
    assert sorted(map(str, full.select("f", "k", "session").collect())) == sorted(str(spark_row(f=f, k=k, session=s)) for f, k, s in want_filled)
    got = scans.islands(full, F.col("opens"), F.col("bad"), ["f", "session"], "k", span)
    assert {(x.f, x.session, x.k): x.flag for x in got.collect()} == want


def test_numbers_are_dense_over_ranges(spark):
    rows = [(r % 2 or None, r * 7919 % 501, "x") for r in range(501)]
    df = spark.createDataFrame(rows, "g int, o int, extra string").repartition(5)
    got = {(x.g, x.o): x.n for x in scans.numbered(df, ["g"], ["o"], "n").collect()}
    for g in (1, None):
        own = sorted(o for h, o, _ in rows if h == g)
        assert [got[g, o] for o in own] == list(range(1, len(own) + 1))


def test_merge_and_append(spark, log_dir, tmp_path):
    both = logs.merged(logs.entries(logs.read_lines(spark, [f"{log_dir}/a.log", f"{log_dir}/b.log"])), ["file", "line_no"])
    second = both.where("search_query = 'second'").first()
    assert second.session_id == "session_cd_2" and second.has_error
    rows = logs.derived(both)
    assert logs.new_entries(rows, rows).count() == 0
    assert rows.select("year_month", "week_idx").distinct().collect() == [("2024-01", 0)]


def test_weeks(spark):
    df = spark.createDataFrame([(d,) for d in (1, 7, 8, 28, 29, 31, 0)], "day int")
    assert [r.w for r in df.select(logs.week_index(F.col("day")).alias("w")).collect()] == [0, 0, 1, 3, 4, 4, 0]


def test_articles(spark, tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"item": {"title": "t", "content": "c", "art_id": "1", "service_daytime": "2024-02-03 04:05:06"}}))
    (folder / "2.json").write_text("{broken")
    (folder / "3.json").write_text(json.dumps({"other": 1}))
    got = articles.read_articles(spark, str(folder))
    assert sorted((r.file, r.title, r.author) for r in got.collect()) == [("1.json", "t", ""), ("3.json", "", "")]
    assert [r.art_id for r in got.where(articles.is_valid()).collect()] == ["1"]
    assert articles.file_count(spark, str(folder)) == 3
    assert [r.file for r in articles.list_files(spark, str(folder)).collect()] == ["1.json", "2.json", "3.json"]
    row = got.where("art_id = '1'").select(articles.metadata().alias("m"), articles.date_of(F.col("service_daytime")).alias("d")).first()
    assert row.m == {"year_month": "2024-02", "art_id": "1"} and row.d == "2024-02-03"


def test_pending(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    ledger = spark.createDataFrame([("a", "uploaded"), ("b", "failed")], "file string, status string")
    assert [r.file for r in articles.pending(files, ledger, 0).collect()] == ["c", "d"]
    assert [r.file for r in articles.pending(files, ledger, 1).collect()] == ["c"]
    assert tuple(articles.upload_status(files, ledger).first()) == (4, 1, 1, 2)


@pytest.mark.parametrize("name,body,seeds", [("s.txt", " one \n\ntwo\n", ["one", "two"]), ("s.json", '["one", "two"]', ["one", "two"]), ("t.json", '{"seeds": ["one"]}', ["one"]), ("s.yaml", "seed_instructions:\n  a: [one]\n  b: [two]\n", ["one", "two"])])
def test_seeds(spark, tmp_path, name, body, seeds):
    (tmp_path / name).write_text(body)
    assert [r.seed for r in samples.load_seeds(spark, str(tmp_path / name)).orderBy("ord").collect()] == seeds


def test_unknown_formats(spark, tmp_path):
    with pytest.raises(ValueError):
        samples.load_seeds(spark, "x.csv")
    with pytest.raises(ValueError):
        samples.save(spark.range(1), str(tmp_path / "x"), "xml")


def test_nightly_append_is_idempotent(spark, log_dir, tmp_path):
    rows = logs.entries(logs.read_lines(spark, [f"{log_dir}/a.log"])).select("datetime_str", "search_query", "session_id", "has_error")
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        incremental.nightly_append(spark, stream, str(tmp_path / "months"), str(tmp_path / f"c{k}")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "months"))
    assert got.count() == 3 and sorted(r.row_no for r in got.collect()) == [4, 5, 6]


def test_samples_as_one_array(spark, tmp_path):
    for n in (0, 1, 7):
        samples.save(spark.range(n).repartition(3), str(tmp_path / f"a{n}"), "json")
        (part,) = (tmp_path / f"a{n}").glob("part-*")
        assert sorted(r["id"] for r in json.loads(part.read_text())) == list(range(n))


def test_a_large_array_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="too many"):
        samples.save(spark.range(7), str(tmp_path / "a"), "json", most=6)


def test_stage_tables_and_final_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "ask", "say", None), (2, None, "", "x")], "id long, instruction string, response string, extra string")
    back = samples.save_stage(df, str(tmp_path), "quality")
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    stats = spark.createDataFrame([(2, 0.5)], "n long, share double")
    samples.save_final(df, str(tmp_path), stats)
    assert sorted(map(str, spark.read.schema("instruction string, response string").json(str(tmp_path / "samples")).collect())) == sorted(map(str, df.select("instruction", "response").collect()))
    assert spark.read.json(str(tmp_path / "stats")).collect()[0].asDict() == {"n": 2, "share": 0.5}


def test_splits_and_evaluation_lists(spark, tmp_path):
    for name, n in (("train", 3), ("validation", 0), ("test", 2)):
        spark.range(n).write.parquet(str(tmp_path / name))
    got = samples.load_splits(spark, str(tmp_path)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 3, "test": 2}
    (tmp_path / "eval.json").write_text(json.dumps([{"input": {"prompt": "p"}, "output": "o"}, {"input": {}, "output": None}, {}]))
    assert [tuple(r) for r in samples.load_eval_list(spark, str(tmp_path / "eval.json")).collect()] == [("p", "o"), (None, None), (None, None)]


def test_reports_and_snapshots(spark, tmp_path):
    meta, summary = spark.createDataFrame([("m", 3)], "model string, n long"), spark.createDataFrame([(0.5,)], "accuracy double")
    samples.eval_report(meta, summary, spark.createDataFrame([("a",), ("b",)], "output string"), str(tmp_path / "r"))
    (row,) = spark.read.json(str(tmp_path / "r" / "report")).collect()
    assert row.metadata.asDict() == {"model": "m", "n": 3} and row.summary.asDict() == {"accuracy": 0.5}
    assert spark.read.json(str(tmp_path / "r" / "samples")).count() == 2
    shots = spark.createDataFrame([("int8", 20, 2.0), ("int8", 10, 1.0), ("fp16", 5, None)], "technique string, sequence_length long, kv_cache_mb double")
    nested = samples.nested_snapshots(shots)
    assert {r.technique: [tuple(x) for x in r.snapshots] for r in nested.collect()} == {"int8": [(10, 1.0), (20, 2.0)], "fp16": [(5, None)]}
    samples.save_json(nested, str(tmp_path / "n"))
    assert sorted(map(str, samples.load_json(spark, str(tmp_path / "n"), nested.schema).collect())) == sorted(map(str, nested.collect()))


def test_stores_are_tables(spark):
    spark.sql("DROP TABLE IF EXISTS shop")
    for _ in range(2):
        articles.create_store(spark, "shop", "art_id string, title string")
    assert spark.table("shop").columns == ["art_id", "title"] and "shop" in [t.name for t in spark.catalog.listTables()]
    spark.sql("DROP TABLE shop")


def test_broken_files_are_named(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"item": {"title": "t"}}')
    (tmp_path / "bad.json").write_text("{nothing")
    assert [r.file for r in articles.broken_files(spark, str(tmp_path)).collect()] == ["bad.json"]
    assert [r.file for r in articles.read_articles(spark, str(tmp_path)).collect()] == ["good.json"]


def test_attempts_stop_at_the_limit():
    waits, calls = [], []

    def send(row):
        calls.append(row)
        raise OSError(row["error"])

    assert uploads.attempt(send, {"error": "429 too many"}, 5, waits.append) == "failed"
    assert len(calls) == 6 and waits == [2.0, 4.0, 8.0, 16.0, 32.0]
    assert uploads.attempt(send, {"error": "no such store"}, 5, waits.append) == "failed" and len(calls) == 7
    assert uploads.attempt(lambda row: True, {}) == "uploaded" and uploads.attempt(lambda row: False, {}) == "failed"


def uploading(spark, tmp_path, names, checkpoint="c0", die_at=None, **options):
    """Uploads the names; sends are noted in a file each, and the sending process dies once after ``die_at``."""
    sent = tmp_path / "sent"
    sent.mkdir(exist_ok=True)
    spark.createDataFrame([(n,) for n in names], "file string").coalesce(1).write.mode("ignore").parquet(str(tmp_path / f"in-{checkpoint}"))

    def send(row, store, sent=str(sent), die_at=die_at):
        import os
        import uuid

        if die_at and len(os.listdir(sent)) == die_at:
            open(f"{sent}/died", "w").close()
            os._exit(1)
        with open(f"{sent}/{store}-{row['file']}-{uuid.uuid4().hex}.note", "w"):
            return row["file"] != "bad"

    stream = spark.readStream.schema("file string").parquet(str(tmp_path / f"in-{checkpoint}"))
    return uploads.upload(stream, send, str(tmp_path / "ledger"), str(tmp_path / checkpoint), **options)


def times_sent(tmp_path):
    return collections.Counter(p.name.split("-")[1] for p in (tmp_path / "sent").glob("*.note"))


def in_ledger(spark, tmp_path):
    return sorted((r.file, r.status) for r in uploads.read_ledger(spark, str(tmp_path / "ledger")).collect())


def test_upload_resumes_from_the_ledger(spark, tmp_path):
    assert in_ledger(spark, tmp_path) == []
    uploading(spark, tmp_path, ["a", "bad", "a"], "c0", store="first").awaitTermination()
    uploading(spark, tmp_path, ["a", "bad", "c"], "c1", store="second").awaitTermination()
    uploading(spark, tmp_path, ["c", "d"], "c2", store="third", resume=False).awaitTermination()
    assert in_ledger(spark, tmp_path) == [("a", "uploaded"), ("bad", "failed"), ("c", "uploaded"), ("d", "uploaded")]
    assert sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "sent").glob("*.note")) == ["first-a", "first-bad", "first-c", "third-d"]


def test_a_killed_task_goes_on_from_its_progress(spark, tmp_path):
    names = [f"f{k:03d}" for k in range(35)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with pytest.raises(StreamingQueryException):
            uploading(spark, tmp_path, names, die_at=27, save_every=10).awaitTermination()
        assert in_ledger(spark, tmp_path) == [] and len(times_sent(tmp_path)) == 27
        uploading(spark, tmp_path, names, save_every=10).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert in_ledger(spark, tmp_path) == [(n, "uploaded") for n in names]
    assert sorted(times_sent(tmp_path).values()) == [1] * 28 + [2] * 7  # only the 7 that weren't saved yet
    assert not list((tmp_path / "ledger" / "progress").glob("*/*"))


def test_a_repeated_epoch_changes_nothing(spark, tmp_path):
    names = ["a", "b", "bad"]
    uploading(spark, tmp_path, names).awaitTermination()
    ledger, sent = in_ledger(spark, tmp_path), times_sent(tmp_path)
    # the driver is lost between the sink's commit and the stream's own
    for p in (tmp_path / "c0" / "commits").iterdir():
        p.unlink()
    uploading(spark, tmp_path, names).awaitTermination()
    assert in_ledger(spark, tmp_path) == ledger and times_sent(tmp_path) == sent


def test_attention_state_goes_on_between_batches(spark, tmp_path):
    for k, rows in enumerate(([(0, 0, 1, 0.5), (0, 1, 1, 0.25), (0, 0, 2, 1.0)], [(0, 2, 1, 2.0)])):
        spark.createDataFrame(rows, "layer int, step int, token_idx int, weight double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("layer int, step int, token_idx int, weight double").parquet(str(tmp_path / "in"))
        write = lambda batch, i: batch.write.mode("overwrite").parquet(str(tmp_path / f"out{i}"))
        incremental.attention_state(stream, 0.5).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = {r.token_idx: (r.score, r.total, r.updates) for r in spark.read.parquet(str(tmp_path / "out1")).collect()}
    assert last == {1: ((0.5 * 0.5 + 0.25) * 0.5 + 2.0, 2.75, 3)}


def test_streamed_texts_once(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "text string").write.parquet(str(tmp_path / "in"))
    out = incremental.unseen_texts(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), "text")
    q = out.writeStream.format("memory").queryName("seen_once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.text for r in spark.table("seen_once").collect()) == ["a", "b"]
