"""Core operators against independent plain-Python versions and small corpora."""

import json
import random
import re

import pytest
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import code, graph, incremental, observe, search, tours
from corvane.sources import code as sources
from pyspark.sql import functions as F


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def split_words(text):
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text))
    return [t.lower() for t in re.split(r"[_.\-/\s]+", s) if len(t) > 1]


def test_identifier_tokens(spark):
    texts = ["refreshToken", "APIResponse", "auth_service", "a/b-c.dd  JSONParser2", "", "x", "how does it work?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.identifier_tokens(F.col("t")).alias("x"))
    assert all(r.x == split_words(r.t) for r in df.collect())


def test_lines_and_estimates(spark):
    for text, n in [("", 0), ("a", 1), ("a\n", 1), ("a\r\nb\rc\n\n", 4), (None, 0)]:
        assert one(spark, T.line_count(F.lit(text).cast("string"))) == n
    assert [one(spark, T.token_estimate(F.lit(t))) for t in ("", "abc", "abcdefgh")] == [1, 1, 2]


def test_hygiene(spark):
    assert one(spark, T.sanitize(F.lit("a\x00b\x07c\n\td"))) == "abc\n\td"
    for path, clean, reason in [("/src\\a.py", "src/a.py", None), ("a/../b", None, "parent"), ("a b", None, "characters"), ("", "", None)]:
        c, r = T.sanitize_path(F.lit(path))
        assert (one(spark, c), one(spark, r)) == (clean, reason)
    for url, ok in [("https://github.com/a/b", True), ("http://github.com/a/b", False), ("https://evil.org", False), ("/local", True), ("http://localhost:1", True), ("", False)]:
        assert one(spark, T.valid_url(F.lit(url))) is ok
    assert one(spark, T.injection(F.lit("IGNORE previous  instructions"))) and not one(spark, T.injection(F.lit("hello")))
    for key, ok in [("k" * 20, True), ("test" + "k" * 20, False), ("short", False), ("x-your-key-" + "k" * 20, False)]:
        assert one(spark, T.valid_key(F.lit(key))) is ok
    assert one(spark, T.repo_of_url(F.lit("git@github.com:o/r.git"))) == "o/r" and one(spark, T.repo_of_url(F.lit("x"))) is None
    assert one(spark, T.commands(F.lit("use `npm test` or\n$ pytest -q\n"))) == ["npm test", "pytest -q"]


@pytest.mark.parametrize("model, cost", [("x-2.0-flash", 0.375), ("1.5-PRO", 6.25), ("text-embedding", 0.0), ("unknown", 0.375)])
def test_cost(spark, model, cost):
    assert abs(one(spark, T.cost(F.lit(model), F.lit(10**6), F.lit(10**6))) - cost) < 1e-9


def test_cosine_and_hashing(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine(arr(1, 0), arr(0, 0))) == 0 and abs(one(spark, V.cosine(arr(1, 1), arr(2, 2))) - 1) < 1e-12
    import hashlib

    h = int(hashlib.md5(b"word").hexdigest(), 16)
    i, s = V.hash_slot(F.lit("word"))
    assert (one(spark, i), one(spark, s)) == (h % 768, 1 if (h // 768) % 2 == 0 else -1)


def plain_pagerank(nodes, edges, d=0.85, most=100):
    n, out = len(nodes), {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    r = dict.fromkeys(nodes, 1 / n)
    for _ in range(most):
        loose = sum(r[v] for v in nodes if v not in out)
        new = {v: (1 - d) / n + d * (sum(r[a] / len(out[a]) for a, b in edges if b == v) + loose / n) for v in nodes}
        change, r = sum(abs(new[v] - r[v]) for v in nodes), new
        if change < 1e-5:
            break
    mean = sum(r.values()) / n
    return {v: max(round(x / mean, 4), 0.1) for v, x in r.items()}


EDGES = [(0, 1), (1, 2), (2, 0), (3, 2), (4, 2), (4, 4)]


def test_pagerank(spark):
    got = graph.pagerank(spark.range(6).withColumnRenamed("id", "node"), spark.createDataFrame(EDGES, "src bigint, dst bigint"))
    want = plain_pagerank(list(range(6)), EDGES)
    assert all(abs(r.score - want[r.node]) < 2e-4 for r in got.collect())
    assert graph.pagerank(spark.range(1).withColumnRenamed("id", "node"), spark.createDataFrame([], "src bigint, dst bigint")).first().score == 1.0
    assert graph.pagerank(spark.range(0).withColumnRenamed("id", "node"), spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


@pytest.mark.parametrize("nodes", [graph.BROADCAST_NODES, 0])
def test_pagerank_in_steps(spark, monkeypatch, nodes):
    """As for a graph that the driver does not rank: with broadcast shares, and with all exchanged."""
    monkeypatch.setattr(graph, "LOCAL_LINKS", 0)
    monkeypatch.setattr(graph, "BROADCAST_NODES", nodes)
    got = graph.pagerank(spark.range(6).withColumnRenamed("id", "node"), spark.createDataFrame(EDGES, "src bigint, dst bigint"), most=5)
    want = plain_pagerank(list(range(6)), EDGES, most=5)
    assert all(abs(r.score - want[r.node]) < 2e-4 for r in got.collect())


def test_bfs_cap_and_visited(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("c", "d", 1), ("d", "e", 1)], "src string, dst string, ordinal int")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.bounded_bfs(seeds, edges).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert {r.node for r in graph.bounded_bfs(seeds, edges, fan_out=1).collect()} == {"a", "b"}


def test_call_preference(spark):
    calls = spark.createDataFrame([("a.py", "f", "g"), ("a.py", "f", "h"), ("a.py", "f", "f")], "path string, caller string, called string")
    defs = spark.createDataFrame([("a.py", "f", 0), ("a.py", "g", 1), ("b.py", "g", 0), ("b.py", "h", 1), ("c.py", "h", 0)], "path string, name string, ordinal int")
    imported = spark.createDataFrame([("a.py", "h")], "path string, name string")
    got = {r.called: (r.def_path, r.def_name, r.level) for r in graph.resolve_calls(calls, defs, imported).collect()}
    assert got == {"g": ("a.py", "g", 0), "h": ("b.py", "h", 1), "f": ("a.py", "f", 2)}


def test_symbol_bonus_is_multiplied(spark):
    chunks = spark.createDataFrame([(1, "parse the file", "Parse"), (2, "other words", "")], "chunk_id bigint, text string, symbol string")
    got = search.keyword_topk(chunks, F.col("text"), spark.createDataFrame([(7, "parse file parse")], "query_id bigint, text string"), symbol=F.col("symbol")).collect()
    import math

    base = 15 + 3 * (1 + math.log(2))
    assert [(r.chunk_id, r.score) for r in got] == [(1, round(base * 1.75, 6))]


def test_packing_stops_at_first_overflow(spark):
    rng = random.Random(4)
    rows = [(q, k, f"k{k % 7}", "x" * rng.randint(1, 60)) for q in range(20) for k in range(12)]
    got = {r.query_id: (r.n_blocks, r.token_count) for r in search.pack_context(spark.createDataFrame(rows, "query_id int, rank int, key string, block string"), 40).collect()}
    for q in range(20):
        seen, n, used = set(), 0, 0
        for _, _, key, block in [r for r in rows if r[0] == q]:
            if key in seen:
                continue
            seen.add(key)
            t = max(1, len(block) // 4)
            if used + t > 40:
                break
            n, used = n + 1, used + t
        assert got.get(q, (0, 0)) == (n, used)


def test_round_robin_quirk(spark):
    rows = [(1, "A/1", 9.0), (1, "B/1", 8.0), (1, "C/1", 7.0), (1, "B/2", 6.0), (1, "C/2", 5.0)]
    got = tours.round_robin(spark.createDataFrame(rows, "group int, path string, importance double")).orderBy("step_order").collect()
    assert [r.path for r in got] == ["A/1", "C/1", "B/1", "C/2", "B/2"]


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "2"), ("b", "1"), ("d", "1"), ("e", "1")], "path string, hash string")
    status = incremental.classify(old, new)
    assert {r.path: r.status for r in status.collect()} == {"a": "changed", "b": "same", "c": "deleted", "d": "same", "e": "new"}
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b")], "source_file string, target_file string")
    assert {r.path for r in incremental.impacted(status, edges).collect()} == {"a", "b", "e"}


def test_partition_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "repo_id int, path string, importance double")
    incremental.write_partition(df, path)
    incremental.write_partition(spark.createDataFrame([(2, "c", 3.0)], "repo_id int, path string, importance double"), path)
    back = spark.read.parquet(path)
    assert {(r.repo_id, r.path) for r in back.collect()} == {(1, "a"), (2, "c")}
    assert incremental.drop_partition(back, 1).count() == 1
    fresh = incremental.refresh_importance(df, spark.createDataFrame([("a", 9.0)], "path string, importance double"))
    assert {r.path: r.importance for r in fresh.collect()} == {"a": 9.0, "b": 2.0}


CODE = '"""Top."""\nimport os, sys as s\nfrom .base import A, b as c\n\n\n@deco\ndef skipped():\n    pass\n\n\nclass K(A):\n    """Doc."""\n\n    def m(self, x):\n        return self.n(os.path.join(x))\n\n\ndef f(a, b=1) -> int:\n    def inner():\n        pass\n\n    return f(b)\n'


def test_parse_python():
    doc, symbols, imports = code.parse_python(CODE)
    assert doc == "Top." and [s["name"] for s in symbols] == ["K", "K.m", "f"]
    assert symbols[1]["calls"] == ["join", "os.path.join", "n", "self.n"] or set(symbols[1]["calls"]) == {"n", "self.n", "join", "os.path.join"}
    assert symbols[2]["signature"] == "def f(a, b=1) -> int" and symbols[0]["signature"] == "class K(A)" and symbols[0]["docstring"] == "Doc."
    assert [(i["module"], i["names"]) for i in imports] == [("os", []), (".base", ["A"])]
    assert code.parse_text("def broken(:\n", "python") == (None, [], [])


def test_parse_other():
    text = "import { a, b } from './m'\n\nexport class X extends Y {\n}\nexport const go = (a) => a(1)\nfunc (r *T) Do(x int) {\n  run(x)\n}\n"
    _, symbols, imports = code.parse_other(text)
    assert [(s["name"], s["kind"]) for s in symbols] == [("X", "class"), ("go", "function"), ("Do", "function")]
    assert imports[0]["module"] == "./m" and imports[0]["names"] == ["a", "b"] and symbols[0]["start_line"] == 2


def test_chunks():
    big = "def f():\n" + "".join(f"    x{i} = {i} + {i}\n" + ("\n" if i % 50 == 0 else "") for i in range(400))
    doc, symbols, imports = code.parse_python("import os\n\ndef a(): pass\n\n" + big)
    got = code.chunk_file("p.py", "", doc, symbols, imports)
    kinds = [c[3] for c in got]
    assert kinds[0] == "file_header" and kinds[-1] == "tiny_symbols" and kinds.count("symbol_part") >= 2
    assert [c[3] for c in code.chunk_file("r.md", "hello\nworld", None, [], [])] == ["file"]


def test_scan_tree(spark, tmp_path):
    for name, body in {"a.py": "x = 1\n", "node_modules/b.js": "y", "deep/c.ts": "z\n", "empty.py": "", "d.unknown": "q", "skip/e.py": "1", "skip/keep.py": "2", "out.min.js": "m"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)
    got = sources.scan(spark, str(tmp_path), ["skip/*", "!skip/keep.py"]).collect()
    assert {r.path: r.language for r in got} == {"a.py": "python", "deep/c.ts": "typescript", "skip/keep.py": "python"}
    parsed = code.parse(spark.createDataFrame(got))
    assert code.chunk(spark.createDataFrame(got), parsed).count() == 3


@pytest.mark.parametrize("rule, hit, miss", [("*.log", "a/b.log", "a/b.logs"), ("/top", "top/x", "a/top/x"), ("docs/", "docs/x", "docs"), ("a/**/b", "a/x/y/b", "b/a"), ("f?.c", "f1.c", "f12.c"),
         ("[Bb]in/", "a/Bin/x", "a/cin/x"), ("test[0-9].py", "test7.py", "testa.py"), ("x[!0-9_].c", "xa.c", "x_.c"), ("x[^ab]", "xc", "xa"), ("q[]-]z", "q]z", "qaz"),
         ("w[a-c-]", "w-", "wd"), ("lit[", "lit[", "lit"), (r"\!keep", "!keep", "keep"), (r"a\*b", "a*b", "axb"), (r"c[\]x]", "c]", "cy"), ("d?x", "dyx", "d/x"), ("e[!a]f", "ebf", "e/f"), ("g[&&]h", "g&h", "gah")])
def test_ignore_rules(rule, hit, miss):
    regex, negated = sources.ignore_regex(rule)
    assert re.search(regex, hit) and not re.search(regex, miss) and not negated


def test_ignore_rules_in_spark(spark):
    """The same expressions, as the engine reads them; a pattern that cannot match leaves the others alone."""
    rules = ["[Bb]in/", "test[0-9].py", "x[!0-9_].c", "q[]-]z", "w[a-c-]", r"\!keep", r"a\*b", "g[&&]h", "lit[", "[z-a]", "end\\"]
    paths = {"Bin/x": True, "cin/x": False, "test7.py": True, "testa.py": False, "xa.c": True, "x_.c": False, "q]z": True, "w-": True, "wd": False, "!keep": True, "a*b": True, "axb": False, "g&h": True, "lit[": True, "z": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.i for r in df.select("path", sources.ignored(F.col("path"), rules).alias("i")).collect()} == paths


def test_entry_points_by_importance(spark):
    """Two files a pattern, then the most important five, whatever their pattern; ties by the first pattern."""
    files = [("a/main.py", 1.0), ("b/main.py", 5.0), ("c/main.py", 4.0), ("app.py", 3.0), ("x/app.py", 2.0), ("index.ts", 9.0), ("web/index.js", 8.0), ("server.go", 0.5), ("cli.py", 3.0)]
    got = tours.entry_points(spark.createDataFrame(files, "path string, importance double"))
    assert [r.path for r in got.collect()] == ["index.ts", "web/index.js", "b/main.py", "c/main.py", "app.py"]


def test_logs(spark):
    rows = [("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:30"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:02")]
    log = spark.createDataFrame(rows, "c string, t string").withColumn("t", F.to_timestamp("t"))
    assert [(r.client, r.n) for r in observe.over_limit(log, "c", "t", 1, "1 minute").collect()] == [("a", 2)]


def test_stream(spark, tmp_path):
    from corvane.streaming import logs

    src = str(tmp_path / "in")
    log = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:10:00")))
    log.write.parquet(src)
    q = logs.windowed_totals(logs.read_stream(spark, src, log.schema), "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.n, r.total) for r in spark.sql("select * from totals").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}


def test_nest_and_recall(spark):
    kids = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "g int, o int, v string")
    assert json.loads(tours.nest(kids, "g", "o", ["o", "v"]).first()["items"]) == [{"o": 1, "v": "a"}, {"o": 2, "v": "b"}]
    ranked = spark.createDataFrame([(1, 10, 1), (2, 20, 4), (3, 30, 1)], "query_id int, chunk_id int, rank int")
    relevant = spark.createDataFrame([(1, 10), (2, 20), (3, 99)], "query_id int, chunk_id int")
    r = search.recall(ranked, relevant).first()
    assert (r.n, r.recall_at_1, r.recall_at_5, r.mrr) == (3, 33.3333, 66.6667, 0.416667)


def test_limits_over_a_growing_stream(spark, tmp_path):
    """Counts go on from run to run; late calls and those without a client are left out; state goes with the watermark."""
    from corvane.streaming import logs

    src, place, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(rows):
        df = spark.createDataFrame(rows, "c string, t string").withColumn("t", F.to_timestamp("t"))
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("c string, t timestamp").parquet(src)
        over = logs.over_limit(stream, "c", "t", 2, 3600)
        q = over.writeStream.format("parquet").option("path", place).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return held[-1], sorted((r.client, r.n) for r in spark.read.schema("client string, window_start timestamp, n bigint").parquet(place).collect())

    at = lambda c, *minutes: [(c, f"2024-01-01 {m // 60:02}:{m % 60:02}:00") for m in minutes]
    assert run(at("a", 1, 2, 3) + at("b", 1) + [(None, "2024-01-01 00:00:01"), ("b", None)])[1] == [("a", 3)]
    assert run(at("a", 4, 70) + at("b", 2, 3))[1] == [("a", 3), ("a", 4), ("b", 3)]
    kept, _ = run(at("b", 300))
    assert run(at("a", 5))[1] == [("a", 3), ("a", 4), ("b", 3)]  # too late
    assert kept == 1


def _dealt(df):
    """Tasks that have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_python_of_one_task_is_parsed_by_several(spark):
    files = spark.range(200).select(F.format_string("p%d.py", "id").alias("path"), F.lit("python").alias("language"), F.lit("def f(x):\n    return a.b(x)\n").alias("text")).coalesce(1)
    parsed = code.parse(files)
    assert parsed.count() == 200 and _dealt(parsed) > 4
    assert _dealt(code.chunk(files, parsed)) > 4


def test_names_as_unparsed():
    import ast

    for text in ["f", "a.b.c", "f().g", "a[0].b", "(x or y).z", "'s'.join"]:
        assert code._dotted(ast.parse(text, mode="eval").body) == ast.unparse(ast.parse(text, mode="eval"))
    for text in ["", "a, b", "a, /, b", "a: int, b", "a=1", "*a", "*, a", "**k", "a, *b, c=2, **d"]:
        node = ast.parse(f"def f({text}): pass").body[0].args
        assert code._arguments(node) == ast.unparse(node)


def _scripts(spark):
    return spark.range(200).select(F.format_string("c%d.ts", "id").alias("path"), F.lit("typescript").alias("language"), F.lit("import { a } from './m'\nfunction f(x) {\n}\n").alias("text")).coalesce(1)


def test_scripts_of_one_task_are_parsed_by_several(spark):
    assert _dealt(code.symbols_of(code.parse(_scripts(spark)))) > 4


def test_imports_of_one_task_are_parsed_by_several(spark):
    found = code.imports_of(code.parse(_scripts(spark)))
    assert found.count() == 200 and _dealt(found) > 4


_PIECES = ["export ", "default ", "abstract ", "async ", "class ", "interface ", "function ", "func ", "const ", "let ", "var ", "import ", "from ", "extends ", "implements ", "A", "b1", "$x", "é", "_f", "9", "(", "(", ")", "{", "}", ",", "=", "=>", ":",
           "'m'", '"n"', "\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u3000", " ", "  ", "\t", "* as ", "call(", "(x, y) ", "if (a)", "class A implements B,\n", "func (r *T) Do(x)",
           "const h = async (z) =>", "import { a,\n b } from './m'", "import 'q'", "import x from 'y'", "export class C extends D {", "function f(a)"]


def _by_patterns_everywhere(text):
    lines = text.splitlines(keepends=True)
    out = []
    for kind, pattern in code.OTHER_SYMBOLS:
        for m in re.finditer(pattern, text, re.M):
            first = text.count("\n", 0, m.start())
            content = "".join(lines[first : first + 1 + code.SPAN])
            out.append((len(out), m[1], kind, m[0].strip(), first + 1, min(first + 1 + code.SPAN, len(lines)), content, list(dict.fromkeys(code.CALL.findall(content)))))
    return out, [m[0] for m in code.OTHER_IMPORT.finditer(text)]


def test_patterns_are_tried_where_they_may_match():
    rnd, met = random.Random(5), 0
    for k in range(4000):
        text = "".join(rnd.choices(_PIECES, k=600 if k % 50 == 0 else rnd.choice([3, 8, 20, 60, 150])))
        _, symbols, imports = code.parse_other(text)
        got = [tuple(s[f] for f in ("ordinal", "name", "kind", "signature", "start_line", "end_line", "content", "calls")) for s in symbols]
        assert (got, [i["raw"] for i in imports]) == _by_patterns_everywhere(text), text
        met += len(got) + len(imports)
    assert met > 3000


def test_blank_lines_are_passed_once():
    import time

    start = time.process_time()
    _, symbols, imports = code.parse_other("\n" * 100_000 + "x\n" + "\n" * 1000 + "class A {\n")
    assert [(s["name"], s["start_line"]) for s in symbols] == [("A", 100_002)] and imports == []
    assert time.process_time() - start < 5  # by the patterns alone 8,000 of them took 17 s


def test_fields_that_are_asked_for_are_parsed(spark, monkeypatch):
    """Whatever the number of texts that are held at once."""
    monkeypatch.setattr(code, "HELD", 100)
    text = F.format_string("import { a } from './m%d'\nfunction f%d(x) {\n  return g(x)\n}\n", "id", "id")
    files = spark.range(300).select(F.format_string("c%d.ts", "id").alias("path"), F.lit("typescript").alias("language"), F.when(F.col("id") != 7, text).alias("text"))
    parsed = code.parse(files, ["symbols"])
    assert parsed.columns == ["path", "symbols"]
    want = {(f"c{i}.ts", f"f{i}", ("f%d" % i, "g")) for i in range(300) if i != 7}
    assert parsed.count() == 300 and {(r.path, r.name, tuple(r.calls)) for r in code.symbols_of(parsed).collect()} == want
    assert code.parse(files).schema.simpleString() == code.parse(files.limit(0), code.FIELDS).schema.simpleString()
    for language, body in [("python", "import os\n\n\ndef f():\n    pass\n"), ("typescript", "import 'os'\nfunction f() {\n}\n")]:
        assert [len(x) for x in code.parse_text(body, language, ["symbols"])[1:]] == [1, 0]
        assert [len(x) for x in code.parse_text(body, language, ["imports"])[1:]] == [0, 1]


def test_imports_are_parsed_without_symbols(spark, tmp_path):
    from corvane.plans import parsing

    spark.range(20).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    found = parsing.parse_imports(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "imports#" in plan and "symbols#" not in plan
    assert {(r.path, r.ordinal, r.module, r.names) for r in found.collect()} == {x for k in range(20) for x in [(f"c{k}.ts", 0, f"./m{k % 7}", "a|b"), (f"c{k}.ts", 1, "lib", "")]}


def test_links_and_ranks_stay_in_their_buckets(spark, monkeypatch):
    """A step over many nodes exchanges the partial sums alone."""
    plans, write = [], graph.bucketed

    def spied(df, name, key, parts):
        if name == "rank":
            plans.append(df.repartition(parts, key)._jdf.queryExecution().executedPlan().toString())
        return write(df, name, key, parts)

    monkeypatch.setattr(graph, "bucketed", spied)
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") * 7 % 100).alias("dst"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {r.node: r.score for r in graph.pagerank(spark.range(300).withColumnRenamed("id", "node"), edges, most=3, tolerance=None, local=0, numbered=True).collect()}
    named = graph.pagerank(spark.range(300).select(F.concat(F.lit("n"), F.col("id")).alias("node")), edges.select(*[F.concat(F.lit("n"), F.col(c)).alias(c) for c in ("src", "dst")]), most=3, tolerance=None)
    assert got == {int(r.node[1:]): r.score for r in named.collect()} and len(got) == 300
    assert len(plans) == 4 and all(p.count("Exchange") == 1 for p in plans[1:])
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


@pytest.mark.parametrize("few", [graph.BROADCAST_NODES, 0])
def test_levels_take_the_edges_of_their_frontier(spark, monkeypatch, few):
    """The edges of a level are taken before they are ordered; frontiers that are too large for it give the same nodes."""
    plans, write = [], graph.materialise
    monkeypatch.setattr(graph, "BROADCAST_NODES", few)
    monkeypatch.setattr(graph, "materialise", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), write(df, name))[1])
    pairs = [(a, (a * k + k) % 97, k) for a in range(97) for k in range(1, 9)]
    edges = spark.createDataFrame(pairs, "src int, dst int, ordinal int").repartition(3)
    want, at = {0: 0}, [0]
    for d in range(1, 4):
        at = sorted({b for a, b, k in pairs if a in at and k <= 5} - want.keys())
        want |= dict.fromkeys(at, d)
    assert {r.node: r.depth for r in graph.bounded_bfs(spark.createDataFrame([(0,)], "node int"), edges).collect()} == want
    levels = [p for name, p in plans if name == "bfs"][1:]
    assert len(levels) == 3 and sum(name == "bfs-links" for name, _ in plans) == (not few)
    if few:
        assert all(p.index("Window [") < p.index("LeftSemi") for p in levels)
    else:
        assert not any("Window [" in p for p in levels)


def test_words_are_counted_where_their_text_is(spark):
    """Texts of one task are dealt to several; nothing else is exchanged."""
    texts = [(k, f"word{k % 7} fooBar foo_bar a word{k % 7}") for k in range(200)]
    got = search.term_frequency(spark.createDataFrame(texts, "chunk_id long, text string").coalesce(1), F.col("text"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and _dealt(got) > 4
    want = {(k, w): n for k, _ in texts for w, n in ((f"word{k % 7}", 2), ("foo", 2), ("bar", 2))}
    assert {(r.chunk_id, r.token): r.tf for r in got.collect()} == want


def test_chunks_of_one_task_are_searched_by_several(spark, monkeypatch):
    """And words' slots are kept from text to text, up to a bound that changes no vector."""
    seen, write = [], search.top
    monkeypatch.setattr(search, "top", lambda df, *a: (seen.append(_dealt(df)), write(df, *a))[1])
    texts = spark.range(200).select(F.col("id").alias("chunk_id"), F.concat(F.lit("helper word"), F.col("id")).alias("text")).coalesce(1)
    got = search.keyword_topk(texts, F.col("text"), spark.createDataFrame([(1, "helper")], "query_id long, text string"), k=3)
    assert seen[0] > 4 and [r.chunk_id for r in got.orderBy("rank").collect()] == [0, 1, 2]
    some = ["a b c", None, "b b d", "", "e a"]
    want = V.embed_texts(some)
    assert V._SLOTS[V.DIMENSIONS].keys() >= set("abcde")
    monkeypatch.setattr(V, "MOST_SLOTS", 1)
    assert (V.embed_texts(some) == want).all()


def test_chunks_of_one_task_are_embedded_by_several(spark, monkeypatch, tmp_path):
    from corvane.functions.model import OFFLINE
    from corvane.operators import ingest

    seen, make = [], ingest.with_embedding
    monkeypatch.setattr(ingest, "with_embedding", lambda df, *a: (seen.append(_dealt(df)), make(df, *a))[1])
    text = F.concat(F.lit("word"), F.col("id"))
    chunks = spark.range(200).select(F.col("id").cast("string").alias("chunk_id"), F.sha2(text, 256).alias("content_hash"), text.alias("embedding_text")).coalesce(1)
    embedded, added = ingest.embed(spark, chunks, str(tmp_path), 1, 1, OFFLINE)
    assert seen[0] > 4 and embedded.count() == added.count() == 200
