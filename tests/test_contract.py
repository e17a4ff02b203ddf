import duckdb
import pytest
from corvane.plans import catalog, parsing, repository  # noqa: F401  (fill the catalogue)

DIR = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def duck():
    import os

    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DIR}/{t}'")
    return c


NAMES = ["keyword_topk", "diff_classify", "call_resolution", "import_resolution", "imported_symbol_edges", "context_pack", "pagerank_fixed10", "pagerank_converged", "bfs_depth3", "rate_limit",
         "trace_dedup", "hybrid_rrf", "importance_boosted_search", "vector_topk", "eval_recall_mrr", "extract_commands", "readme_section", "manifest_stack", "snippets", "cost_by_model",
         "scan_tree", "ingest_files", "ingest_symbols", "ingest_edges", "ingest_chunks", "ingest_embeddings", "ingest_folders", "ingest_repository", "repo_search", "repo_expand", "reading_order",
         "graph_view", "issue_difficulty", "good_first_issues", "evaluate_questions", "evaluate_json_questions", "malformed_text", "incremental_files", "incremental_edges", "incremental_chunks", "incremental_run",
         "repository_list", "repository_cost", "stored_tours", "agent_trace", "feature_trace_tour", "big_picture_tour", "tour_round_robin", "parse_classes", "parse_typescript", "parse_imports", "split_symbol",
         "file_importance", "entry_points", "partition_rewrite"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DIR), duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want.fetchall()))


def test_fusion_of_all_questions(spark):
    rows = catalog.QUERIES["hybrid_rrf"](spark, DIR).collect()
    assert {r.query_id for r in rows} == {r.item_id for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    assert {(r.vrank > 0, r.krank > 0) for r in rows} >= {(True, True)}


def test_steps_of_the_agent(spark):
    """Four steps a question; the second has the first hit's callers, the third the second hit's signature."""
    hits = {(r.query_id, r.rank): r for r in catalog.QUERIES["repo_search"](spark, DIR).collect()}
    near = {(r.query_id, r["rank"]): r for r in catalog.QUERIES["repo_expand"](spark, DIR).collect()}
    steps = {(r.query_id, r.step): r.observation for r in catalog.QUERIES["agent_trace"](spark, DIR).collect()}
    assert len(steps) == 4 * 25
    for q in range(25):
        first, second = hits[q, 1], hits[q, 2]
        assert f"- {first.name} in `{first.path}` (Lines {first.start_line}-{first.end_line})" in steps[q, 1].split("\n")[1]
        callers = [f"`{a}` in {b}" for a, b in (x.split("@") for x in near[q, 1].callers.split("|") if x)]
        assert steps[q, 2].startswith(f"Inspecting call hierarchy for `{first.name}`:") and all(c in steps[q, 2] for c in callers) and (callers or "None (Top-level" in steps[q, 2])
        assert second.name in steps[q, 3] or second.path in steps[q, 3]
        assert "### [File: " in steps[q, 4] and first.path in steps[q, 4]


def test_tours(spark):
    symbols = {(r.path, r.name): r for r in catalog.QUERIES["ingest_symbols"](spark, DIR).collect()}
    picture = catalog.QUERIES["big_picture_tour"](spark, DIR).orderBy("step_order").collect()
    assert [r.step_order for r in picture] == list(range(1, len(picture) + 1)) and 0 < len(picture) <= 12
    assert len({(r.path, r.name) for r in picture}) == len(picture)
    trace = catalog.QUERIES["feature_trace_tour"](spark, DIR).collect()
    for r in [*picture, *trace]:
        s = symbols[r.path, r.name]
        assert (r.start_line, r.end_line) == (s.start_line, s.end_line)
    assert {r.step_order for r in trace if r.query_id == 0} == set(range(1, 1 + sum(r.query_id == 0 for r in trace)))


def _star(duck):
    pair = "SELECT '{}:' || {}, '{}:' || {} FROM {}"
    parts = [("customer", "o_custkey", "order", "o_orderkey", "orders"), ("order", "l_orderkey", "supplier", "l_suppkey", "lineitem"), ("supplier", "s_suppkey", "nation", "s_nationkey", "supplier"), ("nation", "c_nationkey", "customer", "c_custkey", "customer")]
    edges = {e for p in parts for e in duck.execute(pair.format(*p)).fetchall()}
    nodes = {n for e in edges for n in e} | {f"nation:{k}" for (k,) in duck.execute("SELECT n_nationkey FROM nation").fetchall()}
    to = {n: [] for n in nodes}
    for a, b in edges:
        to[a].append(b)
    return to


def test_rank_of_whole_star(spark, duck):
    """Ten steps by hand over all customers, orders, suppliers and nations."""
    to = _star(duck)
    n = len(to)
    rank = dict.fromkeys(to, 1 / n)
    for _ in range(10):
        new = dict.fromkeys(to, 0.15 / n + 0.85 * sum(r for k, r in rank.items() if not to[k]) / n)
        for a, ends in to.items():
            for b in ends:
                new[b] += 0.85 * rank[a] / len(ends)
        rank = new
    got = {r["node"]: r["score"] for r in catalog.QUERIES["pagerank_fixed10"](spark, DIR).collect()}
    assert set(got) == set(to) and len(got) > 1500
    mean = sum(rank.values()) / n
    assert all(abs(got[k] - max(rank[k] / mean, 0.1)) < 1e-4 for k in to)


def test_search_of_whole_star(spark, duck):
    to = _star(duck)
    seen = {n: 0 for n in to if n.startswith("nation:")}
    for depth in range(1, 4):
        for a in [k for k, x in seen.items() if x == depth - 1]:
            for b in sorted(to[a])[:5]:
                seen.setdefault(b, depth)
    got = catalog.QUERIES["bfs_depth3"](spark, DIR).collect()
    assert sorted((r["node"], r["depth"]) for r in got) == sorted(seen.items())
    assert max(seen.values()) == 3


def test_tour_beside_a_hot_folder(spark, tmp_path):
    """250 of the longest documents in one folder; folders of one document make the turn pass over every other folder."""
    rows = [(k, "hot", "en", 90000 - k) for k in range(250)] + [(1000 + k, f"s{k:02}", "en", 500 - k) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r["path"] for r in catalog.QUERIES["tour_round_robin"](spark, str(tmp_path)).orderBy("step_order").collect()]
    assert got == ["hot/en/0.md"] + [f"s{k:02}/en/{1000 + k}.md" for k in range(0, 22, 2)]


@pytest.mark.parametrize("name", ["ingest_files", "ingest_edges"])
def test_files_by_blocks_of_keys(spark, duck, name, tmp_path, monkeypatch):
    """The repository in more files a nation than the test tables give: the same SQL, with smaller blocks."""
    monkeypatch.setattr(repository, "BLOCK", 4)
    monkeypatch.setattr(repository, "_DONE", _SMALL_BLOCKS)
    got, want = catalog.QUERIES[name](spark, DIR), duck.execute(catalog.ORACLES[name].replace("// 1000 ", "// 4 ").replace("// 1000,", "// 4,"))
    names = [c[0] for c in want.description]
    rows = sorted(map(str, (tuple(r) for r in got.select(names).collect())))
    assert rows == sorted(map(str, want.fetchall()))
    assert any("_1.py" in r for r in rows)


_SMALL_BLOCKS: dict = {}


def test_rank_that_converges_late(spark, tmp_path):
    """Two pages that link to each other and others that link to one of them: 30 steps of the SQL end above its tolerance."""
    to = {"/a": "/b", "/b": "/a", "/c": "/a", "/d": "/a"}
    spark.createDataFrame([(i, u, f'<a href="{v}">x</a>') for i, (u, v) in enumerate(to.items())], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES["pagerank_converged"](spark, str(tmp_path)).select("node", "score").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(catalog.ORACLES["pagerank_converged"]).fetchall())
