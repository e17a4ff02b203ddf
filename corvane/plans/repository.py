"""Queries over source trees made from the test tables, and their SQL: scan, ingestion, search, tours, issues.

``nation`` and ``region`` give a small tree that is written and scanned. ``supplier`` gives a repository of Python files,
one a nation and block of keys: each supplier is a function that calls another supplier's, and each file imports from the next nation's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import assist, graph, incremental, ingest, store, tours
from corvane.plans.catalog import ORACLES, embedded_sql, half_up, query, rank_sql, ring_sql, table, tokens_sql
from corvane.session import discard_path, materialise, table_path
from corvane.sources import code as sources

# --- a tree on disk ---------------------------------------------------------------------------------------------------

_EXT = [".py", ".ts", ".md", ".min.js", ".txt"]
_ext_sql = "CASE n_nationkey % 5 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_EXT)) + " END"


@query(f"""WITH t AS (SELECT CASE WHEN n_nationkey % 7 = 3 THEN 'node_modules/' ELSE '' END || 'r' || n_regionkey || '/n' || n_nationkey || {_ext_sql} AS path,
 repeat(n_name || chr(13) || chr(10), n_nationkey) || CASE WHEN n_nationkey % 2 = 1 THEN 'end' ELSE '' END AS t, n_nationkey AS k, n_nationkey % 2 AS x FROM nation
 UNION ALL SELECT 'r' || r_regionkey || '/__init__.py', r_name, 1, 0 FROM region)
SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'markdown' END AS language, strlen(t)::BIGINT AS size_bytes, sha256(t) AS content_hash,
 (CASE WHEN path LIKE '%__init__.py' THEN 1 ELSE k + x END)::BIGINT AS line_count FROM t
WHERE t <> '' AND path NOT LIKE 'node_modules/%' AND path NOT LIKE '%.min.js' AND path NOT LIKE '%.txt' AND path NOT LIKE 'r4/%' AND NOT regexp_matches(path, '/n1[0-2]\\.[^t]')""")
def scan_tree(spark, d):
    """A file a nation and a region, scanned again: empty and ignored ones, unknown languages, one folder and a class of names are left out."""
    root = table_path(spark, "tree")
    files = []
    for r in table(spark, d, "nation").collect():  # 25 nations and 5 regions at any scale
        text = f"{r.n_name}\r\n" * r.n_nationkey + "end" * (r.n_nationkey % 2)
        files.append(("node_modules/" * (r.n_nationkey % 7 == 3) + f"r{r.n_regionkey}/n{r.n_nationkey}{_EXT[r.n_nationkey % 5]}", text.encode()))
    files += [(f"r{r.r_regionkey}/__init__.py", r.r_name.encode()) for r in table(spark, d, "region").collect()]
    sources.write_tree(spark, root, [*files, (".gitignore", b"# one folder\nr[4-9]/\nn1[0-2].[!t]*\n")])
    return sources.scan(spark, root).select("path", "language", "size_bytes", "content_hash", "line_count")


@query("""SELECT 'f' || n_nationkey || '.md' AS path, n_name || chr(65533) || chr(10) || chr(65533) || 'x' AS text, strlen(n_name)::BIGINT + 4 AS size_bytes,
 sha256(n_name::BLOB || '\\xE9'::BLOB || chr(10)::BLOB || '\\xFF'::BLOB || 'x'::BLOB) AS content_hash, 2::BIGINT AS line_count FROM nation""")
def malformed_text(spark, d):
    """Files with bytes that are no UTF-8: these are replaced, the hash is of the bytes as they are."""
    bad = F.concat(F.encode("n_name", "utf-8"), F.unhex(F.lit("E90AFF78")))
    files = table(spark, d, "nation").select(F.format_string("f%d.md", "n_nationkey").alias("path"), bad.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return sources.describe(files).select("path", "text", "size_bytes", "content_hash", "line_count")


# --- a repository -----------------------------------------------------------------------------------------------------

#: Keys of suppliers by which a nation's functions are parted into files, so that no file grows with the tables.
BLOCK = 1000
REPO = f"""bl AS (SELECT s_nationkey AS k, s_suppkey // {BLOCK} AS b FROM supplier UNION SELECT n_nationkey, 0 FROM nation),
np AS (SELECT k, b, n_name, 'r' || n_regionkey || '/n' || n_nationkey || CASE WHEN b > 0 THEN '_' || b ELSE '' END || '.py' AS path,
       'r' || n_regionkey || '.n' || n_nationkey || CASE WHEN b > 0 THEN '_' || b ELSE '' END AS module FROM nation JOIN bl ON k = n_nationkey),
fm AS (SELECT s_nationkey AS k, min(s_suppkey) AS m FROM supplier GROUP BY 1), sn AS (SELECT count(*) AS n FROM supplier),
hd AS (SELECT a.k, a.path, a.n_name, b.path AS target, 'from ' || b.module || ' import s' || coalesce(m, 0) AS raw, 's' || coalesce(m, 0) AS imported
       FROM np a JOIN np b ON b.k = (a.k + 1) % 25 AND b.b = 0 LEFT JOIN fm ON fm.k = b.k),
df AS (SELECT path, s_suppkey, 's' || s_suppkey AS name, 's' || (7 * s_suppkey % n + 1) AS called, s_suppkey % 2 = 1 AS long,
       CASE WHEN s_suppkey % 2 = 1 THEN s_name || ' of ' || n_name || '.' END AS doc, CASE WHEN s_suppkey % 2 = 1 THEN 6 ELSE 2 END AS lines,
       row_number() OVER (PARTITION BY path ORDER BY s_suppkey)::INT - 1 AS ordinal FROM supplier JOIN np ON k = s_nationkey AND b = s_suppkey // {BLOCK}, sn),
dt AS (SELECT *, CASE WHEN long THEN 'def ' || name || '(x):' || chr(10) || '    \"\"\"' || doc || '\"\"\"' || chr(10) || '    a = ' || called || '(x)' || chr(10) || '    b = [a, x]' || chr(10) || '    c = helper(b)' || chr(10) || '    return c' || chr(10)
              ELSE 'def ' || name || '(x):' || chr(10) || '    return ' || called || '(x)' || chr(10) END AS content,
       (5 + coalesce(sum(lines + 2) OVER (PARTITION BY path ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start_line FROM df),
sy AS (SELECT *, 'def ' || name || '(x)' AS signature, start_line + lines - 1 AS end_line, 'sym:' || path || ':' || name AS node FROM dt),
fl AS (SELECT hd.path, '\"\"\"' || n_name || '.\"\"\"' || chr(10) || raw || chr(10) || chr(10) || chr(10) || coalesce(string_agg(content, chr(10) || chr(10) ORDER BY s_suppkey), '') AS t, count(content) AS n
       FROM hd LEFT JOIN dt USING (path) GROUP BY hd.path, n_name, raw),
e0 AS (SELECT path AS source_file, split_part(path, '/', 2) AS source_symbol, path AS target_file, name AS target_symbol, 0 AS phase FROM sy
 UNION ALL SELECT path, split_part(path, '/', 2), target, split_part(target, '/', 2), 1 FROM hd
 UNION ALL SELECT hd.path, split_part(hd.path, '/', 2), sy.path, sy.name, 2 FROM hd JOIN sy ON imported = name
 UNION ALL SELECT a.path, a.name, b.path, b.name, 3 FROM sy a JOIN sy b ON a.called = b.name),
ed AS (SELECT source_file, source_symbol, target_file, target_symbol, ['defines', 'imports', 'imports_symbol', 'calls'][max(phase) + 1] AS edge_type FROM e0 GROUP BY ALL)""".replace('\\"', '"')
RANKED = f"""{REPO}, sc AS MATERIALIZED ({rank_sql('''el AS (SELECT CASE WHEN edge_type = 'calls' THEN 'sym:' || source_file || ':' || source_symbol ELSE 'file:' || source_file END AS src,
 CASE WHEN edge_type = 'imports' THEN 'file:' || target_file ELSE 'sym:' || target_file || ':' || target_symbol END AS dst FROM ed),
nd AS (SELECT 'file:' || path AS node FROM fl UNION ALL SELECT node FROM sy)''', 60, 1e-5)}),
ys AS (SELECT sy.*, score FROM sy JOIN sc USING (node)), fa AS (SELECT path, sum(round(score * 10000)::BIGINT) AS s, count(*) AS m FROM ys GROUP BY 1),
fi AS (SELECT fl.path, t, n, CASE WHEN s IS NULL THEN score ELSE ((round(score * 10000)::BIGINT * m + s + m) // (2 * m))::DOUBLE / 10000 END AS importance FROM fl JOIN sc ON node = 'file:' || fl.path LEFT JOIN fa ON fa.path = fl.path)"""
CODE_CHUNKS = f"""{RANKED},
ty AS (SELECT path, string_agg(name, ', ' ORDER BY ordinal) AS names, min(start_line) AS a, max(end_line) AS b, string_agg('# function ' || name || chr(10) || content, chr(10) || chr(10) ORDER BY ordinal) AS body
       FROM sy WHERE NOT long GROUP BY path),
ca AS (SELECT hd.path, 0 AS o, hd.path || '::header' AS name, 'file_header' AS chunk_type, 'file_header' AS kind, 'File Header: ' || hd.path AS header, n_name || '.' AS docstring, 1 AS start_line, 2 AS end_line,
       '\"\"\"' || n_name || '.\"\"\"' || chr(10) || raw AS content, score AS importance FROM hd JOIN sc ON node = 'file:' || path
 UNION ALL SELECT path, 1 + ordinal, name, 'symbol', 'function', signature, doc, start_line, end_line, content, score FROM ys WHERE long
 UNION ALL SELECT path, 1000000, 'Merged Properties (' || substr(names, 1, 50) || '...)', 'tiny_symbols', 'merged_properties', 'Merged tiny definitions in ' || path, '', a, b, body, 1.0 FROM ty),
cc AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY o)::INT - 1 AS ordinal, 'File: ' || path || chr(10) || 'Symbol: ' || name || ' (' || kind || ')' || chr(10) || 'Signature: ' || header || chr(10)
       || CASE WHEN docstring <> '' THEN 'Docstring: ' || docstring || chr(10) ELSE '' END || chr(10) || 'Code:' || chr(10) || content AS etext FROM ca)""".replace('\\"', '"')


def repository_files(spark: SparkSession, d: str, block: int | None = None) -> DataFrame:
    """path, length, content of the files; a file's functions are one aggregate of its nation's suppliers in a block of keys."""
    block = block or BLOCK
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name", F.format_string("r%d", "n_regionkey").alias("folder"))
    key = F.col("s_suppkey").cast("long")
    s = table(spark, d, "supplier").withColumn("b", F.floor(key / block))
    total = s.count()
    first = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("m"))
    module = F.format_string("%s.n%d", "folder", "k")
    nxt = n.join(first, "k", "left").select(((F.col("k") + 24) % 25).alias("k"), F.format_string("from %s import s%d", module, F.coalesce("m", F.lit(0).cast("long"))).alias("raw"))
    called = (7 * key) % total + 1
    long = F.format_string('def s%d(x):\n    """%s of %s."""\n    a = s%d(x)\n    b = [a, x]\n    c = helper(b)\n    return c\n', key, "s_name", "n_name", called)
    each = s.join(n, F.col("s_nationkey") == F.col("k")).select("k", "b", key.alias("s"), F.when(key % 2 == 1, long).otherwise(F.format_string("def s%d(x):\n    return s%d(x)\n", key, called)).alias("def"))
    body = each.groupBy("k", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "def"))), lambda x: x["def"]), "\n\n").alias("body"))
    text = F.concat(F.format_string('"""%s."""\n%s\n\n\n', "n_name", "raw"), F.coalesce("body", F.lit("")))
    blocks = body.select("k", "b").union(n.select("k", F.lit(0).cast("long"))).distinct()
    path = F.concat("folder", F.lit("/n"), F.col("k").cast("string"), F.when(F.col("b") > 0, F.concat(F.lit("_"), F.col("b").cast("string"))).otherwise(""), F.lit(".py"))
    files = blocks.join(n, "k").join(nxt, "k").join(body, ["k", "b"], "left").select(path.alias("path"), F.encode(text, "utf-8").alias("content"))
    return files.select("path", F.octet_length("content").cast("long").alias("length"), "content")


def earlier_files(spark: SparkSession, d: str) -> DataFrame:
    """The repository as it was before: nation 5's file reads otherwise, nation 7's is not there yet, and one that went since is."""
    files, at = repository_files(spark, d), lambda k: F.regexp_like("path", F.lit(f"/n{k}(_[0-9]+)?[.]py$"))
    other = F.encode(F.concat(F.decode("content", "utf-8"), F.lit("\n\ndef gone(x):\n    return x\n")), "utf-8")
    was = files.filter(~at(7)).withColumn("content", F.when(at(5), other).otherwise(F.col("content")))
    more = spark.createDataFrame([("r0/old.py", bytearray(b"x = 1\n"))], "path string, content binary")
    return was.select("path", "content").unionByName(more).select("path", F.octet_length("content").cast("long").alias("length"), "content")


_DONE: dict[tuple[str, ...], str] = {}


def _once(spark: SparkSession, d: str, name: str, fill) -> str:
    """The folder of a repository's tables: filled once a job, in the shared folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _DONE:
        out = table_path(spark, name)
        fill(out)
        _DONE[key] = out
    return _DONE[key]


def repository(spark: SparkSession, d: str) -> str:
    return _once(spark, d, "repository", lambda out: ingest.ingest(spark, sources.describe(repository_files(spark, d)), out, 1, "suppliers"))


def grown(spark: SparkSession, d: str) -> str:
    """The repository in two runs: as it was, then incrementally as it is."""

    def fill(out: str) -> None:
        ingest.ingest(spark, sources.describe(earlier_files(spark, d)), out, 1, "suppliers")
        ingest.ingest(spark, sources.describe(repository_files(spark, d)), out, 1, "suppliers", incremental_run=True)

    return _once(spark, d, "grown", fill)


def stored(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ingest.table(spark, repository(spark, d), name, 1)


@query(f"WITH {RANKED} SELECT path, 'python' AS language, strlen(t)::BIGINT AS size_bytes, sha256(t) AS content_hash, (length(t) - length(replace(t, chr(10), '')))::BIGINT AS line_count, importance FROM fi")
def ingest_files(spark, d):
    return stored(spark, d, "files").select("path", "language", "size_bytes", "content_hash", "line_count", "importance")


@query(ORACLES["ingest_files"])
def incremental_files(spark, d):
    """The second run's files: as those of a full run."""
    return ingest.table(spark, grown(spark, d), "files", 1).select("path", "language", "size_bytes", "content_hash", "line_count", "importance")


@query(f"""WITH {RANKED} SELECT path, ordinal, name, 'function' AS kind, signature, coalesce(doc, '') AS docstring, start_line, end_line, sha256(content) AS content_hash, score AS importance,
 CASE WHEN long THEN 'Function `' || name || '` (' || signature || '): ' || doc ELSE 'Component summary: ' || signature || ' | ' || signature || ': | return ' || called || '(x)' END AS summary FROM ys""")
def ingest_symbols(spark, d):
    s = stored(spark, d, "symbols")
    return s.select("path", "ordinal", "name", "kind", "signature", F.coalesce("docstring", F.lit("")).alias("docstring"), "start_line", "end_line", F.sha2("content", 256).alias("content_hash"), "importance", "summary")


@query(f"WITH {REPO} SELECT * FROM ed")
def ingest_edges(spark, d):
    return stored(spark, d, "edges").drop("repo_id")


@query(ORACLES["ingest_edges"])
def incremental_edges(spark, d):
    return ingest.table(spark, grown(spark, d), "edges", 1).drop("repo_id")


@query(f"WITH {CODE_CHUNKS} SELECT path, ordinal, name, chunk_type, header, start_line, end_line, greatest(1, length(content) // 4)::BIGINT AS token_count, sha256(etext) AS content_hash, importance::DOUBLE AS importance FROM cc")
def ingest_chunks(spark, d):
    return _chunks_told(stored(spark, d, "chunks"))


def _chunks_told(chunks: DataFrame) -> DataFrame:
    return chunks.select("path", "ordinal", "name", "chunk_type", "header", "start_line", "end_line", "token_count", "content_hash", "importance")


@query(ORACLES["ingest_chunks"])
def incremental_chunks(spark, d):
    return _chunks_told(ingest.table(spark, grown(spark, d), "chunks", 1))


_AT5, _AT7 = "regexp_matches(path, '/n5(_[0-9]+)?[.]py$')", "regexp_matches(path, '/n7(_[0-9]+)?[.]py$')"


@query(f"""WITH {CODE_CHUNKS}, pr AS (SELECT path FROM fl WHERE {_AT5} OR {_AT7}
 UNION SELECT source_file FROM ed WHERE {_AT5.replace('path', 'target_file')} AND NOT {_AT7.replace('path', 'source_file')})
SELECT (SELECT count(*) FROM fl) AS total_files, (SELECT count(*) FROM pr) AS processed_files, (SELECT count(*) FROM fl WHERE NOT {_AT5} AND NOT {_AT7}) AS unchanged_files, 1::BIGINT AS deleted_files,
 (SELECT count(*) FROM fl WHERE {_AT5} OR {_AT7}) AS parsed_texts, (SELECT count(DISTINCT sha256(etext)) FROM cc WHERE {_AT7} OR ({_AT5} AND chunk_type = 'tiny_symbols')) AS embedded_texts""")
def incremental_run(spark, d):
    """The second run's counts: files of which a text changed or that depend on one, texts parsed, chunks embedded."""
    counts = ["total_files", "processed_files", "unchanged_files", "deleted_files", "parsed_texts", "embedded_texts"]
    return ingest.ready(ingest.table(spark, grown(spark, d), "repositories"), 1).select(*counts)


@query(f"""WITH {REPO} SELECT 1::BIGINT AS repo_id, 'ready' AS status, 'suppliers' AS name, 'local_' || substr(sha256(count(*)::VARCHAR), 1, 12) AS commit_id, count(*) AS total_files, sum(n)::BIGINT AS total_symbols,
 2::BIGINT AS runs, 10::BIGINT AS states FROM fl""")
def repository_list(spark, d):
    """Repositories with the states that their two runs went through, after ``pending``."""
    out = grown(spark, d)
    log = store.runs(spark, out).filter("status <> 'pending'").groupBy("repo_id").agg(F.countDistinct("version").alias("runs"), F.count(F.lit(1)).alias("states"))
    return store.repositories(spark, out).join(log, "repo_id").select("repo_id", "status", "name", "commit_id", "total_files", "total_symbols", "runs", "states")


@query(f"""WITH {CODE_CHUNKS}, ln AS (SELECT path, string_agg('- ' || name || ' (function): ' || CASE WHEN long THEN 'Function `' || name || '` (' || signature || '): ' || doc
  ELSE 'Component summary: ' || signature || ' | ' || signature || ': | return ' || called || '(x)' END, chr(10) ORDER BY ordinal) AS t FROM sy WHERE ordinal < 20 GROUP BY 1),
pt AS (SELECT fl.path, 'File Header: ' || n_name || '.' || chr(10) || coalesce(ln.t, 'No discrete exported functions.') AS p FROM fl JOIN hd USING (path) LEFT JOIN ln USING (path)),
sm AS (SELECT path, p, list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(x)), lambda x: length(x) > 5) AS l FROM pt),
us AS (SELECT '2.0-flash' AS model, count(*) AS n, sum(greatest(1, length(p) // 4)) AS p, sum(greatest(1, length('Component summary: ' || array_to_string(l[1:4], ' | ')) // 4)) AS c FROM sm
 UNION ALL SELECT 'embedding', count(*), sum(t), 0 FROM (SELECT DISTINCT etext, greatest(1, length(etext) // 4) AS t FROM cc)),
cs AS (SELECT *, CASE WHEN model = 'embedding' THEN 0 ELSE (p * 0.075::DOUBLE + c * 0.3::DOUBLE) / 1000000 END AS cost FROM us)
SELECT model, sum(n)::BIGINT AS n_calls, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, round(sum(cost), 4) AS cost_usd FROM cs GROUP BY ROLLUP (model)""")
def repository_cost(spark, d):
    """What the run's calls of models took, by model and in all."""
    return store.cost(spark, repository(spark, d), 1)


@query(f"""WITH {embedded_sql('de', '(SELECT path, ordinal, etext AS text FROM x)', "path || '#' || ordinal").replace('(SELECT path, ordinal, etext AS text FROM x)', 'ct').replace('dew AS', f'{CODE_CHUNKS}, ct AS (SELECT path, ordinal, etext AS text FROM cc), dew AS', 1)}
SELECT split_part(key, '#', 1) AS path, split_part(key, '#', 2)::INT AS ordinal, idx, round(val, 5) AS val FROM de""")
def ingest_embeddings(spark, d):
    c = stored(spark, d, "chunks").select("path", "ordinal", F.posexplode("embedding").alias("idx", "val"))
    return c.filter("val <> 0").withColumn("val", F.round(F.col("val").cast("double"), 5))


@query(f"""WITH {RANKED}, fs AS (SELECT path, n, '\"\"\"' AS q FROM fi)
SELECT split_part(path, '/', 1) AS folder_path, count(*) AS files, sum(n)::BIGINT AS symbols, max(importance) AS importance FROM fi GROUP BY 1""".replace('\\"', '"'))
def ingest_folders(spark, d):
    """Folders as summaries have them, with their files and symbols counted."""
    n = stored(spark, d, "symbols").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    f = stored(spark, d, "files").join(n, "path", "left").withColumn("folder_path", F.split_part("path", F.lit("/"), F.lit(1)))
    g = f.groupBy("folder_path").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.max("importance").alias("importance"))
    return stored(spark, d, "folders").join(g, "folder_path").select("folder_path", "files", "symbols", "importance")


@query(f"WITH {REPO} SELECT 'suppliers' AS name, count(*) AS total_files, sum(n)::BIGINT AS total_symbols, sum(length(t) - length(replace(t, chr(10), '')))::BIGINT AS total_lines, count(*) AS processed_files, 0::BIGINT AS unchanged_files, 'local_' || substr(sha256(count(*)::VARCHAR), 1, 12) AS commit_id FROM fl")
def ingest_repository(spark, d):
    return ingest.ready(stored(spark, d, "repositories"), 1).select("name", "total_files", "total_symbols", "total_lines", "processed_files", "unchanged_files", "commit_id")


# --- answers over it --------------------------------------------------------------------------------------------------

ASKED = "aq AS (SELECT k AS query_id, 'How does s' || coalesce(m, 1) || ' of ' || n_name || ' use a helper?' AS text FROM np LEFT JOIN fm USING (k) WHERE b = 0)"


def asked(spark, d) -> DataFrame:
    """A question a nation, about its first supplier's function."""
    first = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("m"))
    n = table(spark, d, "nation").join(first, "n_nationkey", "left")
    return n.select(F.col("n_nationkey").alias("query_id"), F.format_string("How does s%d of %s use a helper?", F.coalesce("m", F.lit(1).cast("long")), "n_name").alias("text"))


def _hits_sql(k: int) -> str:
    emb = f"{embedded_sql('de', 'ct', 'key')}, {embedded_sql('qe', 'aq', 'query_id')}".replace("SELECT key AS key", "SELECT key")
    return f"""{CODE_CHUNKS}, {ASKED}, ct AS (SELECT path || '#' || lpad(ordinal::VARCHAR, 6, '0') AS key, etext AS text, path || ' ' || name || ' ' || header || ' ' || content AS kt, * FROM cc), {emb},
tf AS (SELECT key, token, count(*) AS tf FROM (SELECT key, unnest({tokens_sql('kt')}) AS token FROM ct) GROUP BY ALL),
qt AS (SELECT query_id, token, count(*) AS c FROM (SELECT query_id, unnest({tokens_sql('text')}) AS token FROM aq) GROUP BY ALL),
k0 AS (SELECT query_id, key, sum(c * (1 + ln(1 + tf))) AS base, sum(c) AS m FROM tf JOIN qt USING (token) GROUP BY ALL),
bo AS (SELECT query_id, key FROM aq, ct WHERE name <> '' AND contains(lower(aq.text), lower(name))),
ks AS (SELECT query_id, key, coalesce(base, 0) + CASE WHEN bo.key IS NULL THEN 0 ELSE 15 END AS base, coalesce(m, 0) AS m FROM k0 FULL JOIN bo USING (query_id, key)),
kr AS (SELECT query_id, key, round(CASE WHEN m > 1 THEN base * (1 + 0.25 * m) ELSE base END, 6) AS s FROM ks),
kw AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS r FROM kr QUALIFY r <= 50),
dv AS (SELECT key, idx, val::FLOAT::DOUBLE AS val FROM de), qv AS (SELECT key AS query_id, idx, val::FLOAT::DOUBLE AS val FROM qe),
dn AS (SELECT key, sqrt(sum(val * val)) AS n FROM dv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(val * val)) AS n FROM qv GROUP BY 1),
dp AS (SELECT query_id, key, sum(dv.val * qv.val) AS s FROM dv JOIN qv USING (idx) GROUP BY ALL),
vs AS (SELECT query_id, key, round(coalesce(s / (dn.n * qn.n), 0), 6) + 0 AS s FROM (SELECT query_id, key FROM aq, ct) LEFT JOIN dp USING (query_id, key) LEFT JOIN dn USING (key) LEFT JOIN qn USING (query_id)),
vr AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS r FROM vs QUALIFY r <= 50),
fu AS (SELECT query_id, key, round((coalesce(0.6::DOUBLE / (60 + vr.r), 0) + coalesce(0.4::DOUBLE / (60 + kw.r), 0)) * (1 + 0.35 * (importance::DOUBLE - 1)), 9) AS s FROM vr FULL JOIN kw USING (query_id, key) JOIN ct USING (key)),
ht AS (SELECT query_id, key, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key)::INT AS rank FROM fu QUALIFY rank <= {k}),
hits AS (SELECT ht.*, ct.* EXCLUDE (key) FROM ht JOIN ct USING (key))"""


CALLED = """cl AS (SELECT target_symbol AS name, string_agg(source_symbol || '@' || source_file, '|' ORDER BY source_file, source_symbol) AS callers FROM
 (SELECT * FROM ed WHERE edge_type = 'calls' QUALIFY row_number() OVER (PARTITION BY target_symbol ORDER BY source_file, source_symbol, target_file, target_symbol) <= 5) GROUP BY 1),
ce AS (SELECT source_symbol AS name, string_agg(target_symbol || '@' || target_file, '|' ORDER BY target_file, target_symbol) AS callees FROM
 (SELECT * FROM ed WHERE edge_type = 'calls' QUALIFY row_number() OVER (PARTITION BY source_symbol ORDER BY source_file, source_symbol, target_file, target_symbol) <= 5) GROUP BY 1)"""


def _tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return stored(spark, d, "chunks"), stored(spark, d, "edges"), stored(spark, d, "symbols")


@query(f"WITH {_hits_sql(12)} SELECT query_id, rank, path, name, start_line, end_line, {half_up('s', 5)} AS score FROM hits")
def repo_search(spark, d):
    """Sanitised, checked, hybrid with importance: twelve hits a question."""
    hits, _ = assist.search_repository(*_tables(spark, d), asked(spark, d))
    return hits.select("query_id", "rank", "path", "name", "start_line", "end_line", "score")


@query(f"WITH {_hits_sql(5)}, {CALLED} SELECT query_id, rank, hits.path, hits.name, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM hits LEFT JOIN cl ON cl.name = hits.name LEFT JOIN ce ON ce.name = hits.name")
def repo_expand(spark, d):
    _, found = assist.search_repository(*_tables(spark, d), asked(spark, d))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("@", x["symbol_name"], x["file_path"])), "|").alias(c)
    return found.select("query_id", "rank", "path", "name", told("callers"), told("callees"))


_PACKED = """cr AS (SELECT target_symbol AS name, string_agg('`' || source_symbol || '` in ' || source_file, ', ' ORDER BY r) AS every, string_agg('`' || source_symbol || '` in ' || source_file, ', ' ORDER BY r) FILTER (r <= 5) AS five
 FROM (SELECT *, row_number() OVER (PARTITION BY target_symbol ORDER BY source_file, source_symbol, target_file, target_symbol) AS r FROM ed WHERE edge_type = 'calls') GROUP BY 1),
cl AS (SELECT source_symbol AS name, string_agg('`' || target_symbol || '`', ', ' ORDER BY r) AS every, string_agg('`' || target_symbol || '`', ', ' ORDER BY r) FILTER (r <= 5) AS five
 FROM (SELECT *, row_number() OVER (PARTITION BY source_symbol ORDER BY source_file, source_symbol, target_file, target_symbol) AS r FROM ed WHERE edge_type = 'calls') GROUP BY 1),
bk AS (SELECT query_id, rank, path, start_line, end_line, path || ':' || start_line || ':' || end_line AS key, '### [File: ' || path || ' (Lines ' || start_line || '-' || end_line || ')] Symbol: ' || name || ' (' || header || ')' || chr(10)
 || coalesce('  * Called by: ' || cr.five || chr(10), '') || coalesce('  * Calls: ' || cl.five || chr(10), '') || '```' || chr(10) || content || chr(10) || '```' || chr(10) AS block
 FROM hits LEFT JOIN cr USING (name) LEFT JOIN cl USING (name) WHERE rank <= 4),
b1 AS (SELECT * FROM bk QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY rank) = 1),
b2 AS (SELECT *, sum(greatest(1, length(block) // 4)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM b1),
cx AS (SELECT query_id, count(*) AS n_blocks, string_agg(block, chr(10) ORDER BY rank) AS context FROM b2 WHERE running <= 6000 GROUP BY 1)"""


def _text_sql(form: str, *parts: str) -> str:
    """A fixed form as an expression."""
    pieces = [f"'{p}'" for p in form.replace("'", "''").split("%s")]
    return "(" + " || ".join(x for pair in zip(pieces, [*parts, "''"], strict=True) for x in pair) + ")"


@query(f"""WITH {_hits_sql(8)}, {_PACKED}
SELECT query_id, 1 AS step, 'hybrid_search' AS action, 'Top candidate symbols:' || chr(10) || string_agg('- ' || name || ' in `' || path || '` (Lines ' || start_line || '-' || end_line || ')', chr(10) ORDER BY rank) AS observation FROM hits WHERE rank <= 5 GROUP BY 1
UNION ALL SELECT query_id, 2, 'follow_call_hierarchy', 'Inspecting call hierarchy for `' || name || '`:' || chr(10) || '- Callers: ' || coalesce(cr.every, 'None (Top-level or entrypoint)') || chr(10) || '- Callees: ' || coalesce(cl.every, 'None (Leaf function)')
 FROM hits LEFT JOIN cr USING (name) LEFT JOIN cl USING (name) WHERE rank = 1
UNION ALL SELECT query_id, 3, 'read_symbol', 'Signature: ' || header || chr(10) || 'Purpose: ' || coalesce(nullif(docstring, ''), 'Core module logic') FROM hits WHERE rank = 2
UNION ALL SELECT query_id, 4, 'answer', '### Retrieval synthesis' || chr(10) || chr(10) || substr({_text_sql(assist.ANSWER_PROMPT, "'suppliers'", 'aq.text', 'context')}, 1, 1200) || chr(10) || chr(10) || '*(offline)*' FROM cx JOIN aq USING (query_id)""")
def agent_trace(spark, d):
    """A row a step of the agent, for every question."""
    return assist.agent(*_tables(spark, d), asked(spark, d), name="suppliers")[0]


@query(f"""WITH {_hits_sql(8)}, {_PACKED},
c1 AS (SELECT bk.*, n_blocks FROM bk JOIN cx USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id, path, start_line, end_line ORDER BY rank) = 1),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= n_blocks),
c3 AS (SELECT *, min(rank) OVER (PARTITION BY query_id, path, start_line) AS place FROM c2 QUALIFY row_number() OVER (PARTITION BY query_id, path, start_line ORDER BY rank DESC) = 1),
fs AS (SELECT query_id, place, c3.path, sy.name, sy.start_line, sy.end_line, signature FROM c3 JOIN sy ON sy.path = c3.path AND sy.start_line <= c3.start_line AND sy.end_line >= c3.end_line QUALIFY row_number() OVER (PARTITION BY query_id, place ORDER BY sy.ordinal) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS step_order, path, name, start_line, end_line, signature AS body FROM fs""")
def feature_trace_tour(spark, d):
    chunks, edges, symbols = _tables(spark, d)
    return assist.feature_trace(assist.agent(chunks, edges, symbols, asked(spark, d))[1], symbols)


_BIG_PICTURE = f"""WITH RECURSIVE {RANKED},
en AS (SELECT path FROM fi ORDER BY importance DESC, path LIMIT 3),
s0 AS (SELECT name FROM (SELECT * FROM ys QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, ordinal) <= 3) JOIN en USING (path)),
cs AS (SELECT source_symbol AS a, target_symbol AS b FROM ed WHERE edge_type = 'calls' QUALIFY row_number() OVER (PARTITION BY source_symbol ORDER BY source_file, target_file, target_symbol) <= 5),
s1 AS (SELECT b FROM cs WHERE a IN (SELECT name FROM s0)), s2 AS (SELECT b FROM cs WHERE a IN (SELECT b FROM s1)), s3 AS (SELECT b FROM cs WHERE a IN (SELECT b FROM s2)),
nm AS (SELECT name FROM s0 UNION SELECT b FROM s1 UNION SELECT b FROM s2 UNION SELECT b FROM s3),
st AS (SELECT split_part(path, '/', 1) AS folder, {{'path': path, 'name': name, 'start': start_line::VARCHAR}} AS place, score AS importance FROM ys WHERE name IN (SELECT name FROM nm)), {ring_sql('st')},
va AS (SELECT step, sy.*, length(t) - length(replace(t, chr(10), '')) AS line_count FROM turns JOIN sy ON sy.path = place.path AND sy.name = place.name JOIN fl ON fl.path = sy.path WHERE step > 0)
SELECT row_number() OVER (ORDER BY step)::INT AS step_order, path, name, start_line, end_line, 'Step ' || row_number() OVER (ORDER BY step) || ': ' || name AS title, signature AS body FROM va WHERE end_line <= line_count + 10"""


@query(_BIG_PICTURE)
def big_picture_tour(spark, d):
    return assist.big_picture(stored(spark, d, "files"), stored(spark, d, "symbols"), stored(spark, d, "edges"))


@query(f"""SELECT 1 AS tour_id, 'big_picture' AS kind, 'Around suppliers' AS title, count(*) AS n_steps, string_agg(step_order || ' ' || path || ' ' || name || ' ' || start_line || '-' || end_line || ' ' || body, '|' ORDER BY step_order) AS steps FROM ({_BIG_PICTURE})
UNION ALL SELECT 3, 'big_picture', 'Its first half', count(*), string_agg(step_order || ' ' || path || ' ' || name || ' ' || start_line || '-' || end_line || ' ' || body, '|' ORDER BY step_order) FROM ({_BIG_PICTURE}) WHERE step_order <= 6""")
def stored_tours(spark, d):
    """Three tours are saved and listed, after the second is deleted."""
    out = table_path(spark, "tours")
    steps = materialise(big_picture_tour(spark, d), "tour-steps")
    store.save_tour(steps, out, 1, "big_picture", "Around suppliers")
    second = store.save_tour(steps.limit(3), out, 1, "big_picture", "To be deleted")
    store.save_tour(steps.filter("step_order <= 6"), out, 1, "big_picture", "Its first half")
    store.delete_tour(spark, out, 1, second)
    told = F.transform("steps", lambda x: F.concat_ws(" ", x["step_order"].cast("string"), x["path"], x["name"], F.concat_ws("-", x["start_line"].cast("string"), x["end_line"].cast("string")), x["body"]))
    return store.tours_of(spark, out, 1).select(F.col("tour_id").cast("int").alias("tour_id"), "kind", "title", F.size("steps").cast("bigint").alias("n_steps"), F.array_join(told, "|").alias("steps"))


@query(f"""WITH {RANKED}, tp AS (SELECT *, row_number() OVER (ORDER BY importance DESC, path)::INT AS step FROM fi QUALIFY step <= 10),
ky AS (SELECT path, string_agg(name, '|' ORDER BY r) AS k FROM (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY score DESC, ordinal) AS r FROM ys) WHERE r <= 4 GROUP BY 1)
SELECT step, path, round(importance, 3) AS importance, CASE WHEN importance >= 2 THEN 'core' WHEN importance >= 1.2 THEN 'business logic' ELSE 'supporting' END AS tier,
 (length(t) - length(replace(t, chr(10), '')))::BIGINT AS line_count, coalesce(k, '') AS key_symbols FROM tp LEFT JOIN ky USING (path)""")
def reading_order(spark, d):
    out = assist.reading_order(stored(spark, d, "files"), stored(spark, d, "symbols"))
    names = F.array_join(F.transform("key_symbols", lambda x: x["name"]), "|")
    return out.select("step", "path", "importance", "tier", "line_count", F.coalesce(names, F.lit("")).alias("key_symbols"))


@query(f"""WITH {RANKED}, tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, path || '#' || lpad(ordinal::VARCHAR, 6, '0'))::INT - 1 AS place FROM ys QUALIFY place < 120)
SELECT path || '#' || lpad(a.ordinal::VARCHAR, 6, '0') AS source, (SELECT path || '#' || lpad(ordinal::VARCHAR, 6, '0') FROM tp b WHERE b.name = a.called) AS target,
 'calls' AS label, true AS animated, '#3b82f6' AS stroke FROM tp a WHERE called IN (SELECT name FROM tp)""")
def graph_view(spark, d):
    """Edges between the 120 most important symbols, as drawn."""
    s = stored(spark, d, "symbols").select(F.format_string("%s#%06d", "path", "ordinal").alias("symbol_id"), "name", "importance")
    return graph.drawn(s, stored(spark, d, "edges"))[1]


def issues(spark, d) -> DataFrame:
    """An issue a nation, a question for its body; every fifth a pull request."""
    a = asked(spark, d)
    return a.select(
        F.col("query_id").alias("number"), F.concat(F.lit("Trouble "), F.col("query_id").cast("string")).alias("title"), F.col("text").alias("body"),
        F.when(F.col("query_id") % 2 == 0, F.array(F.lit("good first issue"))).otherwise(F.array(F.lit("bug"))).alias("labels"), F.lit("open").alias("state"), (F.col("query_id") % 5 == 0).alias("is_pull_request"),
    )


def _issue_sql(form: str, k: int) -> str:
    return _hits_sql(k).replace(ASKED, f"{ASKED.replace('aq AS', 'a0 AS')}, aq AS (SELECT query_id, {form} AS text FROM a0)")


@query(f"""WITH {_issue_sql("'Trouble ' || query_id || ' ' || text", 6)}, {CALLED},
ct4 AS (SELECT query_id, sum(coalesce(len(string_split(callers, '|')), 0)) AS c FROM hits LEFT JOIN cl USING (name) WHERE rank <= 4 GROUP BY 1),
fs AS (SELECT query_id, string_agg(path, '|' ORDER BY r) AS f, count(*) AS n FROM (SELECT query_id, path, min(rank) AS r FROM hits GROUP BY ALL) GROUP BY 1)
SELECT query_id AS number, f AS affected_files, c::BIGINT AS total_callers, CASE WHEN n <= 2 AND c <= 3 THEN 'beginner' WHEN n <= 4 THEN 'intermediate' ELSE 'advanced' END AS difficulty FROM fs JOIN ct4 USING (query_id)""")
def issue_difficulty(spark, d):
    out = assist.issue_difficulty(*_tables(spark, d), issues(spark, d))
    return out.select("number", F.array_join("affected_files", "|").alias("affected_files"), "total_callers", "difficulty")


@query(f"""WITH {_issue_sql("'Trouble ' || query_id || chr(10) || chr(10) || substr(text, 1, 500)", 5)}
SELECT query_id AS number, path AS file_path, {half_up('max(s)', 5)} AS relevance, string_agg(name || ' ' || start_line || '-' || end_line, '|' ORDER BY rank) AS symbols FROM hits
WHERE query_id % 2 = 0 AND query_id % 5 <> 0 AND query_id IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0 ORDER BY n_nationkey DESC LIMIT 20) GROUP BY ALL""")
def good_first_issues(spark, d):
    """Open issues for beginners, a row a matched file."""
    out = assist.good_first_issues(stored(spark, d, "chunks"), issues(spark, d), spark.createDataFrame([("CONTRIBUTING.md", "Be kind.")], "path string, text string"))
    m = out.select("number", F.explode("matched_files").alias("m")).select("number", "m.*")
    return m.select("number", "file_path", "relevance", F.array_join(F.transform("symbols", lambda x: F.concat_ws(" ", x["name"], x["line_range"])), "|").alias("symbols"))


@query(f"""WITH {_hits_sql(5)}, r AS (SELECT query_id, min(rank) FILTER (WHERE hits.path = np.path) AS r FROM hits JOIN np ON k = query_id AND b = 0 GROUP BY 1)
SELECT count(*) AS n, round(100 * avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_1, round(100 * avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM r""")
def evaluate_questions(spark, d):
    """Questions with the names of their nations' files, against what five hits hold."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.array(F.format_string("n%d.py", "n_nationkey")).alias("expected_files"))
    return assist.evaluate(stored(spark, d, "chunks"), asked(spark, d).join(names, "query_id"))


@query(ORACLES["evaluate_questions"])
def evaluate_json_questions(spark, d):
    """The same questions, written as a JSON list and read from it."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.array(F.format_string("n%d.py", "n_nationkey")).alias("expected_files"))
    rows = asked(spark, d).join(names, "query_id").select(F.struct(F.col("query_id").alias("id"), F.col("text").alias("question"), "expected_files").alias("q"))
    path = table_path(spark, "questions")
    rows.agg(F.to_json(F.sort_array(F.collect_list("q"))).alias("value")).write.text(path)  # a question a nation
    return assist.evaluate(stored(spark, d, "chunks"), assist.read_questions(spark, path))


@query("""SELECT lang AS repo, count(*) AS files, sum(n_chars + CASE WHEN lang = 'de' THEN 1 ELSE 0 END)::BIGINT AS characters FROM documents WHERE lang NOT IN ('es', 'fr') GROUP BY 1""")
def partition_rewrite(spark, d):
    """A table by partitions: written, one replaced alone, one by no rows, one dropped, and read again."""
    path, doc = table_path(spark, "partitions"), table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    incremental.write_partition(doc, path, "lang")
    incremental.replace_partition(doc.filter("lang = 'de'").withColumn("n_chars", F.col("n_chars") + 1).drop("lang"), path, "de", "lang")
    incremental.replace_partition(doc.filter("lang = 'fr' AND doc_id < 0").drop("lang"), path, "fr", "lang")
    discard_path(spark, f"{path}/lang=es")
    return spark.read.parquet(path).groupBy(F.col("lang").alias("repo")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("characters"))


@query("""WITH w AS (SELECT conv_id * 1000 + turn AS query_id, string_split(text, ' ') AS w FROM conversations),
e AS (SELECT query_id, 0 AS position, '{"type":"status","text":"Analyzing symbol graph and citations..."}' AS event FROM w
 UNION ALL SELECT query_id, 1 + i, '{"type":"token","text":' || to_json(array_to_string(w[4 * i + 1:4 * i + 4], ' ') || ' ') || '}' FROM (SELECT query_id, w, unnest(range(0, (len(w) - 1) // 4 + 1)) AS i FROM w)
 UNION ALL SELECT query_id, 2 + (len(w) - 1) // 4, '{"type":"citations","citations":[]}' FROM w UNION ALL SELECT query_id, 3 + (len(w) - 1) // 4, '{"type":"done"}' FROM w)
SELECT query_id, position::INT AS position, event FROM e""")
def answer_events(spark, d):
    c = table(spark, d, "conversations")
    return assist.answer_events(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("answer"), F.array().cast("array<string>").alias("citations")))


@query("""SELECT lower(n_name) || '/repo' AS full_name, n_nationkey * 3 AS stars, n_regionkey AS forks, true AS has_contributing, 'make test|pytest -q' AS test_commands FROM nation""")
def repository_facts(spark, d):
    n = table(spark, d, "nation")
    facts = n.select(F.to_json(F.struct(F.concat(F.lower("n_name"), F.lit("/repo")).alias("full_name"), (F.col("n_nationkey") * 3).alias("stargazers_count"), F.col("n_regionkey").alias("forks_count"))).alias("json"))
    out = assist.repository_facts(facts, spark.createDataFrame([("docs/CONTRIBUTING.md", "no"), ("CONTRIBUTING.md", "Run `make test` or\n$ pytest -q\n")], "path string, text string"))
    return out.select("full_name", "stars", "forks", "has_contributing", F.array_join("test_commands", "|").alias("test_commands"))


@query("SELECT s_suppkey, s_name AS title, CASE s_suppkey % 2 WHEN 0 THEN 'Beginner' ELSE 'Advanced' END AS difficulty FROM supplier WHERE contains(lower(s_name), '7') AND s_suppkey % 2 = 0")
def shown_issues(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 2 == 0, "Beginner").otherwise("Advanced").alias("difficulty"))
    return assist.shown_issues(s, "7", "beginner")


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '^(.*)/[^/]*$', 1), ''), 'root') AS folder, regexp_extract(url, '[^/]*$') AS name FROM pages""")
def path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", T.dirname(F.col("url")).alias("folder"), T.basename(F.col("url")).alias("name"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, '- ' || o_orderkey || ' (order): ' || o_orderpriority AS l FROM orders)
SELECT o_custkey AS path, string_agg(l, chr(10) ORDER BY o_orderkey) AS text FROM o WHERE r <= 20 GROUP BY 1""")
def file_rollup(spark, d):
    line = ingest.summary_line(F.col("o_orderkey").cast("string"), F.lit("order"), F.col("o_orderpriority"))
    return tours.first_of(table(spark, d, "orders").select(F.col("o_custkey").alias("path"), "o_orderkey", line.alias("line")), "path", "line", "o_orderkey", 20, "\n")


@query("""WITH l AS (SELECT string_agg('- Directory `' || n_name || '`: key ' || n_nationkey, chr(10) ORDER BY n_name) AS t FROM nation),
s AS (SELECT list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: length(x) > 5) AS l FROM l) SELECT 'Component summary: ' || array_to_string(l[1:4], ' | ') AS repo_summary FROM s""")
def repo_rollup(spark, d):
    return ingest.repo_summary(table(spark, d, "nation").select(F.col("n_name").alias("folder_path"), F.concat(F.lit("key "), F.col("n_nationkey").cast("string")).alias("summary_text")))


@query("""SELECT doc_id AS number, lang || chr(10) || chr(10) || substr(text, 1, 500) AS query FROM documents""")
def issue_query(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("number"), F.col("lang").alias("title"), F.col("text").alias("body")).select("number", assist.issue_query().alias("query"))
