"""The jobs over growing copies of their inputs, run again, and after a batch that failed."""

import datetime as dt
import json
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from corvane.functions.vectors import embed_texts
from jobs import common, index_documents, queries, usage_report

ROOT = Path(__file__).resolve().parents[2]
DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("events", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR), c.execute(queries.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want.fetchall()))


def rows_of(df):
    return sorted((str(tuple(r)) for r in df.select(sorted(df.columns)).collect()))


def arriving(spark, folder, first, last, **fixed):
    """Documents of a copy of the test table, by id, as files that arrive."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").filter(f"doc_id >= {first} AND doc_id < {last}")
    docs.repartition(2).write.mode("append").parquet(folder)
    return docs.count()


def index_state(out):
    return sorted(p.name for p in Path(out, "texts").glob("batch=*"))


def test_growing_documents(spark, tmp_path):
    place, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arriving(spark, place, 0, 60)
    assert index_documents.run(spark, place, out, state).count() == 60
    before = {p: p.stat().st_mtime_ns for p in Path(out).rglob("part-*") if "batch=" in str(p)}
    arriving(spark, place, 60, 150)
    # A copy of a text that the first run has, a null text and a null language.
    old = spark.read.parquet(place).filter("doc_id = 7").first().text
    spark.createDataFrame([(900, old, "en", "x"), (901, None, None, None), (901, None, None, None), (None, "", "", "y")], index_documents.INCOMING).coalesce(1).write.mode("append").parquet(place)
    got = index_documents.run(spark, place, out, state)
    assert got.count() == 154
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # what was there is not written again
    assert len(index_state(out)) == 2
    hashes = spark.read.parquet(f"{out}/texts").select("content_hash")
    assert hashes.count() == hashes.distinct().count()  # no text was embedded twice
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[900].content_hash == by_id[7].content_hash and by_id[901].token_count == 1 and by_id[901].lang is None
    texts = {r.doc_id: r.text for r in spark.read.parquet(place).collect()}
    for k in (0, 7, 100, 149):
        assert np.allclose(by_id[k].embedding, embed_texts([texts[k]])[0], atol=1e-6)
    # Without new files nothing changes; all files at once give the same index.
    same = rows_of(got.drop("batch"))
    assert rows_of(index_documents.run(spark, place, out, state).drop("batch")) == same and len(index_state(out)) == 2
    assert rows_of(index_documents.run(spark, place, str(tmp_path / "out2"), str(tmp_path / "state2")).drop("batch")) == same


def test_batch_that_failed_half_way(spark, tmp_path, monkeypatch):
    """The texts of a batch are written, its documents are not; the next run does it again."""
    place, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arriving(spark, place, 0, 40)
    whole, calls = index_documents._replace, []

    def failing(df, batch, path, *by):
        calls.append(path)
        if path.endswith("documents"):
            raise OSError("lost")
        whole(df, batch, path, *by)

    monkeypatch.setattr(index_documents, "_replace", failing)
    with pytest.raises(Exception, match="lost"):
        index_documents.run(spark, place, out, state)
    monkeypatch.setattr(index_documents, "_replace", whole)
    assert len(calls) == 2
    got = index_documents.run(spark, place, out, state)
    assert got.count() == 40 and got.select("doc_id").distinct().count() == 40
    assert rows_of(got) == rows_of(index_documents.run(spark, place, str(tmp_path / "o"), str(tmp_path / "s")))


def test_several_batches(spark, tmp_path):
    place, out = str(tmp_path / "in"), str(tmp_path / "out")
    arriving(spark, place, 0, 80)
    got = index_documents.run(spark, place, out, str(tmp_path / "state"), {"files_per_batch": 1, "dimensions": 16})
    assert got.count() == 80 and len(index_state(out)) > 1 and len(got.first().embedding) == 16


LOG = "ts timestamp, user_id bigint, event_type string, value double, props string"


def call(day, minute, user, kind="click", value=1.0, props='{"k": 2}'):
    return (dt.datetime(2024, 1, day, 0, minute, tzinfo=dt.UTC).replace(tzinfo=None), user, kind, value, props)


def test_growing_log(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    first = [call(1, k % 60, 1, value=k / 4) for k in range(70)] + [call(1, 0, 2, "purchase", 3.0), call(2, 0, 1), (None, 1, "click", 1.0, None), call(2, 5, None, None, None, None)]
    spark.createDataFrame(first, LOG).write.parquet(log)
    got = {(str(r.day), r.kind, r["name"]): r for r in usage_report.run(spark, log, out).collect()}
    clicks = got["2024-01-01", "operation", "click"]
    assert (clicks.n, clicks.total, clicks.low, clicks.high) == (70, sum(k / 4 for k in range(70)), 0.0, 69 / 4)
    assert got["2024-01-01", "tier", "ingestion"].high == 70.0 and ("2024-01-02", "tier", "ingestion") not in got
    assert got["2024-01-02", "operation", "unknown"].n == 0 and got["2024-01-02", "operation", "unknown"].total is None
    assert got["2024-01-01", "operation", "purchase"].cost_usd == round((2 * 1.25 + 30 * 5.0) / 1e6, 4)
    # The second day grows and loses nothing; the first, no longer in the log, stays.
    spark.createDataFrame([call(2, 0, 1), call(2, 1, 1), call(3, 0, 4)], LOG).write.mode("overwrite").parquet(log)
    again = usage_report.run(spark, log, out)
    told = {(str(r.day), r.kind, r["name"]): r for r in again.collect()}
    assert told["2024-01-01", "operation", "click"] == clicks and told["2024-01-02", "operation", "click"].n == 2
    assert ("2024-01-02", "operation", "unknown") not in told and ("2024-01-03", "operation", "click") in told
    before = rows_of(again)
    assert rows_of(usage_report.run(spark, log, out)) == before


def test_days_that_are_asked_for(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    spark.createDataFrame([call(d, 0, 1) for d in (1, 2, 3)], LOG).write.parquet(log)
    config = common.load(None, "usage_report.json") | {"from": "2024-01-02", "to": "2024-01-03"}
    assert [str(r.day) for r in usage_report.run(spark, log, out, config).collect()] == ["2024-01-02"]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"files_per_batch": 3}))
    assert common.load(str(tmp_path / "c.json"), "index_documents.json") == {"files_per_batch": 3, "dimensions": 768}
    (tmp_path / "d.json").write_text(json.dumps({"file_per_batch": 3}))
    with pytest.raises(ValueError, match="file_per_batch"):
        common.load(str(tmp_path / "d.json"), "index_documents.json")


def test_command_line(tmp_path):
    done = subprocess.run([sys.executable, "-m", "jobs.usage_report", "--calls", f"{DIR}/events.parquet", "--out", str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read 1000 rows" in done.stderr and "wrote" in done.stderr, done.stderr[-2000:]
    assert list((tmp_path / "out" / "report").glob("day=*"))
