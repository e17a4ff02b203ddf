"""Versions of a stored repository: failed runs, emptied tables, texts that are parsed and embedded once, lists and costs."""

import pytest
from corvane.operators import incremental, ingest, store
from corvane.sources import code as sources

CODE = {"a.py": "from b import one\n\n\ndef top(x):\n    y = one(x)\n    z = one(y)\n    w = one(z)\n    return w\n", "b.py": "def one(x):\n    a = x\n    b = a\n    c = b\n    return c\n", "c.py": "def alone(x):\n    a = x\n    b = a\n    c = b\n    return c\n"}


def scanned(spark, files):
    rows = [(p, len(t.encode()), bytearray(t.encode())) for p, t in files.items()]
    return sources.describe(spark.createDataFrame(rows, sources.RAW))


def rows_of(spark, out, name, repo=1):
    return sorted(map(str, ingest.table(spark, out, name, repo).collect()))


def test_life_of_a_repository(spark, tmp_path, monkeypatch):
    out, whole = str(tmp_path / "out"), store.write
    assert store.repositories(spark, out).count() == 0 and ingest.table(spark, out, "files", 1).count() == 0
    first = ingest.ingest(spark, scanned(spark, CODE), out, 1, "demo")
    assert (first["parsed_texts"], first["embedded_texts"]) == (3, ingest.table(spark, out, "chunks", 1).count())
    before = {t: rows_of(spark, out, t) for t in store.TABLES}
    cost = {r.model: r for r in store.cost(spark, out, 1).collect()}
    assert cost["2.0-flash"].n_calls == 3 and cost["embedding"].n_calls == first["embedded_texts"] and cost["embedding"].cost_usd == 0
    text = store.file_text(spark, out, 1, "a.py").collect()
    assert len(text) == 1 and text[0].language == "python" and text[0].content.startswith("def top") and store.file_text(spark, out, 1, "no.py").count() == 0

    # A run that is lost between two tables: readers have the whole old version.
    def failing(df, out, name, *rest):
        if name == "symbols":
            raise OSError("lost")
        whole(df, out, name, *rest)

    changed = CODE | {"c.py": CODE["c.py"].replace("alone", "lonely")}
    monkeypatch.setattr(store, "write", failing)
    with pytest.raises(OSError, match="lost"):
        ingest.ingest(spark, scanned(spark, changed), out, 1, "demo", incremental_run=True)
    monkeypatch.setattr(store, "write", whole)
    assert {t: rows_of(spark, out, t) for t in store.TABLES} == before
    assert store.repositories(spark, out).first().status == "failed" and store.current(spark, out, 1) == 1

    # Run again, it finds what the lost run has parsed and embedded.
    stats = ingest.ingest(spark, scanned(spark, changed), out, 1, "demo", incremental_run=True)
    assert (stats["parsed_texts"], stats["embedded_texts"], stats["processed_files"], stats["unchanged_files"]) == (0, 0, 1, 2)
    assert store.current(spark, out, 1) == 3 and {r.name for r in ingest.table(spark, out, "symbols", 1).collect()} == {"top", "one", "lonely"}
    assert {r.version for r in store.read(spark, out, "files").select("version").distinct().collect()} == {1, 3}  # the lost one is removed

    # All symbols and links go; then files come back, and links lead from them to others that come with them.
    stats = ingest.ingest(spark, scanned(spark, {"a.py": CODE["a.py"].replace("def top(x)", "top(x)").split("\n\n")[1], "d.md": "text\n"}), out, 1, "demo", incremental_run=True)
    assert stats["total_symbols"] == 0 and rows_of(spark, out, "symbols") == rows_of(spark, out, "edges") == [] and stats["deleted_files"] == 2
    back = ingest.ingest(spark, scanned(spark, CODE), out, 1, "demo", incremental_run=True)
    assert (back["parsed_texts"], back["embedded_texts"]) == (0, 0)
    keyed = lambda t: sorted(str(r) for r in ingest.table(spark, out, t, 1).collect())
    assert {t: keyed(t) for t in ("files", "symbols", "edges", "chunks", "folders")} == {t: before[t] for t in ("files", "symbols", "edges", "chunks", "folders")}
    states = [r.status for r in store.runs(spark, out).filter("version = 5").orderBy("step").collect()]
    assert states == store.STATES and (r := store.repositories(spark, out).first()).status == "ready" and (r.name, r.total_files) == ("demo", 3)

    ingest.drop_repository(spark, out, 1)
    assert store.repositories(spark, out).count() == 0 and all(ingest.table(spark, out, t, 1).count() == 0 for t in store.TABLES)


def test_partition_replaced_by_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, part string")
    incremental.write_partition(df, path, "part")
    incremental.replace_partition(df.filter("id > 2").drop("part"), path, "a", "part")
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]
    incremental.replace_partition(df.drop("part"), path, "b", "part")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
