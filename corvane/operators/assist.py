"""Answers over an ingested repository: search, contexts, agent, issues, tours. Tables as ``ingest`` writes them; every
function takes a table of queries and answers all of them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as T
from corvane.functions.model import OFFLINE, TextModel
from corvane.functions.vectors import with_embedding
from corvane.operators import graph, search, tours
from corvane.session import materialise

# Forms of contexts, observations and names, labels of issues for beginners, files of guidelines in order.
BLOCK_HEAD, BLOCK_BODY = "### [File: %s (Lines %d-%d)] Symbol: %s (%s)\n", "```\n%s\n```\n"
PARENT_LINE, CALLERS_LINE, CALLEES_LINE = "  * Parent Class: `%s` (%s)", "  * Called by: %s", "  * Calls: %s"
FOUND, FOUND_LINE = "Top candidate symbols:\n%s", "- %s in `%s` (Lines %d-%d)"
HIERARCHY = "Inspecting call hierarchy for `%s`:\n- Callers: %s\n- Callees: %s"
NO_CALLERS, NO_CALLEES, READ, NO_PURPOSE = "None (Top-level or entrypoint)", "None (Leaf function)", "Signature: %s\nPurpose: %s", "Core module logic"
BEGINNER_LABELS = ["good first issue", "help wanted", "beginner-friendly"]
ANSWER_PROMPT = (
    "You are an expert software architect analyzing the repository '%s'.\nUser Question: \"%s\"\n\nRetrieved Code and Call Hierarchy:\n%s\n\nInstructions:\n"
    "1. Answer the question thoroughly, explaining the end-to-end execution flow.\n"
    "2. Cite every key function, class, and method with its exact file and line numbers (e.g. `[path:start-end]`).\n"
    "3. Mention who calls whom based on the provided call graph.\n4. Be direct, technical, and precise."
)
STATUS = "Analyzing symbol graph and citations..."
GUIDELINES = ["CONTRIBUTING.md", "CONTRIBUTING", ".github/CONTRIBUTING.md", "docs/CONTRIBUTING.md", "CONTRIBUTE.md"]
# End of fixed values.
FIELDS = ["path", "name", "header", "content", "docstring", "start_line", "end_line", "importance"]


def keyword_text() -> Column:
    """What keywords are looked for in: path, symbol, header and content."""
    return F.concat_ws(" ", "path", "name", "header", "content")


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 8, model: TextModel = OFFLINE) -> DataFrame:
    """chunks: chunk_id, ``FIELDS``, embedding; queries: query_id, text. (query_id, rank, score, vrank, krank, chunk_id, ``FIELDS``)."""
    keyword = search.keyword_topk(chunks, keyword_text(), queries, symbol=F.col("name"))
    vector = search.vector_topk(chunks.select("chunk_id", "embedding"), with_embedding(queries, F.col("text"), model.embed))
    best = search.fuse(vector, keyword, chunks.select("chunk_id", "importance"), k)
    return best.drop("importance").join(chunks.select("chunk_id", *FIELDS), "chunk_id")


def admitted(queries: DataFrame, most: int = 2000) -> DataFrame:
    """query_id, text (sanitised), rejected: whether it looks like a prompt injection."""
    clean = queries.select("query_id", T.sanitize(F.col("text"), most).alias("text"))
    return clean.withColumn("rejected", T.injection(F.col("text")))


def contexts(hits: DataFrame, edges: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` hits of each query with callers, callees and parent class."""
    return search.expand_symbols(hits.filter(F.col("rank") <= most).withColumn("symbol", F.col("name")), edges, symbols)


def search_repository(chunks: DataFrame, edges: DataFrame, symbols: DataFrame, queries: DataFrame, k: int = 12, model: TextModel = OFFLINE) -> tuple[DataFrame, DataFrame]:
    """(hits, expanded first five) of the queries that are admitted."""
    hits = hybrid(chunks, admitted(queries).filter("NOT rejected").drop("rejected"), k, model)
    return hits, contexts(hits, edges, symbols)


def _joined(items: Column, form: str, *fields: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.format_string(form, *[x[f] for f in fields])), ", ")


def blocks(expanded: DataFrame) -> DataFrame:
    """(query_id, rank, key, block): each context as text, keyed by its lines."""
    c = F.col
    lines = F.array(
        F.when(c("parent_class").isNotNull(), F.format_string(PARENT_LINE, c("parent_class.name"), c("parent_class.signature"))),
        F.when(F.size("callers") > 0, F.format_string(CALLERS_LINE, _joined(c("callers"), "`%s` in %s", "symbol_name", "file_path"))),
        F.when(F.size("callees") > 0, F.format_string(CALLEES_LINE, _joined(c("callees"), "`%s`", "symbol_name"))),
    )
    told = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    middle = F.when(told != "", F.concat(told, F.lit("\n"))).otherwise("")
    block = F.concat(F.format_string(BLOCK_HEAD, "path", "start_line", "end_line", "name", "header"), middle, F.format_string(BLOCK_BODY, "content"))
    return expanded.select("query_id", "rank", F.concat_ws(":", "path", c("start_line").cast("string"), c("end_line").cast("string")).alias("key"), block.alias("block"))


def agent(chunks: DataFrame, edges: DataFrame, symbols: DataFrame, queries: DataFrame, budget: int = 6000, model: TextModel = OFFLINE, name: str = "Project") -> tuple[DataFrame, DataFrame]:
    """(steps: query_id, step, action, observation; citations: query_id, path, name, start_line, end_line, importance).

    Search; all callers and callees of the first hit; the second hit; an answer from the packed contexts of the first four.
    The hits are written once, as every step reads them; ``name`` is the repository's, for the prompt.
    """
    c, place = F.col, F.concat_ws(":", "path", F.col("start_line").cast("string"))
    hits = materialise(hybrid(chunks, queries, 8, model), "agent-hits").withColumn("symbol", F.col("name"))
    line = F.format_string(FOUND_LINE, "name", "path", "start_line", "end_line")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    found = hits.filter("rank <= 5").groupBy("query_id").agg(F.format_string(FOUND, lines).alias("observation"))
    first = search.expand_symbols(hits.filter("rank = 1"), edges, symbols, None)
    some = lambda text, none: F.when(text != "", text).otherwise(none)
    callers, callees = _joined(c("callers"), "`%s` in %s", "symbol_name", "file_path"), _joined(c("callees"), "`%s`", "symbol_name")
    near = first.select("query_id", F.format_string(HIERARCHY, "name", some(callers, NO_CALLERS), some(callees, NO_CALLEES)).alias("observation"))
    read = hits.filter("rank = 2").select("query_id", F.format_string(READ, "header", some(F.coalesce("docstring", F.lit("")), NO_PURPOSE)).alias("observation"))
    expanded = contexts(hits.drop("symbol"), edges, symbols, 4)
    packed = search.pack_context(blocks(expanded), budget)
    prompt = F.format_string(ANSWER_PROMPT, F.lit(name), c("text"), c("context"))
    answer = packed.join(queries.select("query_id", "text"), "query_id").select("query_id", model.answer(prompt).alias("observation"))
    steps = None
    for k, (action, df) in enumerate((("hybrid_search", found), ("follow_call_hierarchy", near), ("read_symbol", read), ("answer", answer)), 1):
        part = df.select("query_id", F.lit(k).alias("step"), F.lit(action).alias("action"), "observation")
        steps = part if steps is None else steps.unionByName(part)
    cited = expanded.join(packed.select("query_id", "n_blocks"), "query_id").withColumn("_k", F.row_number().over(Window.partitionBy("query_id", place, "end_line").orderBy("rank"))).filter("_k = 1")
    cited = cited.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("_k <= n_blocks")
    last = Window.partitionBy("query_id", place).orderBy(F.desc("rank"))  # of one place the last one stays, where the first one stood
    cited = cited.withColumns({"_last": F.row_number().over(last), "rank": F.min("rank").over(Window.partitionBy("query_id", place))}).filter("_last = 1")
    return steps, cited.select("query_id", "rank", "path", "name", "start_line", "end_line", "importance")


# --- issues -------------------------------------------------------------------------------------------------------


def open_issues(issues: DataFrame, labels: list[str] | None = None, state: str = "open", most: int = 50) -> DataFrame:
    """issues: number, title, body, labels, state, is_pull_request. The first ``most`` by number from the last, pull
    requests among them, which then go."""
    has = F.forall(F.array(*[F.lit(x) for x in labels]), lambda x: F.array_contains("labels", x)) if labels else F.lit(True)
    kept = issues.filter(has & ((F.col("state") == state) | F.lit(state == "all")))
    return kept.orderBy(F.desc("number")).limit(most).filter(~F.coalesce("is_pull_request", F.lit(False)))


def guidelines(files: DataFrame) -> DataFrame:
    """files: path, text. The text of the first guideline file there is; no row without one."""
    order = F.array_position(F.array(*[F.lit(x) for x in GUIDELINES]), F.col("path"))
    return files.filter(F.col("path").isin(GUIDELINES)).orderBy(order).limit(1).select(F.col("text").alias("guidelines"))


def issue_query() -> Column:
    return F.concat("title", F.lit("\n\n"), F.substring(F.coalesce("body", F.lit("")), 1, 500))


def match_issues(chunks: DataFrame, issues: DataFrame, k: int = 5, model: TextModel = OFFLINE) -> DataFrame:
    """issues: number, title, body. (number, file_path, relevance, symbols): files in which an issue's hits lie."""
    hits = hybrid(chunks, issues.select(F.col("number").alias("query_id"), issue_query().alias("text")), k, model)
    item = F.struct("rank", F.col("name"), F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("line_range"), F.substring("content", 1, 200).alias("snippet"))
    found = hits.groupBy(F.col("query_id").alias("number"), F.col("path").alias("file_path"))
    return found.agg(F.max("score").alias("relevance"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("rank")).alias("symbols"))


def issue_difficulty(chunks: DataFrame, edges: DataFrame, symbols: DataFrame, issues: DataFrame, model: TextModel = OFFLINE) -> DataFrame:
    """issues: number, title, body. (number, affected_files, total_callers, difficulty, label, colour, roadmap)."""
    asked = issues.select(F.col("number").alias("query_id"), F.concat_ws(" ", "title", "body").alias("text"))
    hits = hybrid(chunks, asked, 6, model)
    files = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]))
    line = F.format_string(FOUND_LINE, "name", "path", "start_line", "end_line")
    lines = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), 1, 5), "\n")
    of_issue = hits.groupBy("query_id").agg(files.alias("affected_files"), lines.alias("lines"))
    callers = contexts(hits, edges, symbols, 4).groupBy("query_id").agg(F.sum(F.size("callers")).alias("total_callers"))
    both = of_issue.join(callers, "query_id").withColumn("difficulty", T.difficulty(F.size("affected_files"), F.col("total_callers")))
    label, colour = T.difficulty_told(F.col("difficulty"))
    return both.select(F.col("query_id").alias("number"), "affected_files", "total_callers", "difficulty", label.alias("label"), colour.alias("colour"), model.answer(F.col("lines")).alias("roadmap"))


def good_first_issues(chunks: DataFrame, issues: DataFrame, files: DataFrame, labels: list[str] | None = None, most: int = 20, model: TextModel = OFFLINE) -> DataFrame:
    """The open issues for beginners with matched files and a plan: (number, title, matched_files, plan, difficulty, estimated_time)."""
    kept = open_issues(issues, BEGINNER_LABELS[:1] if labels is None else labels, "open", most)
    matched = match_issues(chunks, kept, 5, model)
    items = F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("order"), "file_path", "symbols")))
    per = matched.groupBy("number").agg(F.transform(items, lambda x: F.struct(x["file_path"].alias("file_path"), (-x["order"]).alias("relevance"), x["symbols"].alias("symbols"))).alias("matched_files"))
    rules = guidelines(files).agg(F.max("guidelines").alias("guidelines"))  # one row
    named = F.array_join(F.transform(F.slice("matched_files", 1, 3), lambda x: F.format_string("- %s (relevance: %.3f)", x["file_path"], x["relevance"])), "\n")
    prompt = F.concat_ws("\n", "title", F.substring(F.coalesce("body", F.lit("")), 1, 800), named, F.substring(F.coalesce("guidelines", F.lit("")), 1, 1000))
    told = kept.join(per, "number").crossJoin(F.broadcast(rules)).withColumn("answer", model.answer(prompt))
    level = T.labelled_field(F.col("answer"), "DIFFICULTY", r"(\w+)", F.lit("Intermediate"))
    hours = T.labelled_field(F.col("answer"), "ESTIMATED_TIME", r"([^\n]+)", F.lit("2-4 hours"))
    plan = T.labelled_field(F.col("answer"), "PLAN", r"(.+)", F.col("answer"))
    return told.select("number", "title", "matched_files", plan.alias("plan"), level.alias("difficulty"), hours.alias("estimated_time"))


def shown_issues(issues: DataFrame, text: str = "", difficulty: str | None = None) -> DataFrame:
    """Issues whose title contains the text, letters in either case, and that have the difficulty asked for."""
    kept = issues.filter(F.contains(F.lower("title"), F.lit(text.lower())))
    return kept if difficulty is None else kept.filter(F.lower("difficulty") == difficulty.lower())


def repository_facts(facts: DataFrame, files: DataFrame) -> DataFrame:
    """facts: json, as a forge describes a repository; files: path, text. One row each, with its guidelines' head and test commands."""
    kind = "full_name string, description string, stargazers_count bigint, forks_count bigint, open_issues_count bigint, language string, html_url string"
    told = facts.select(F.from_json("json", kind).alias("f")).select("f.*").withColumnsRenamed({"stargazers_count": "stars", "forks_count": "forks", "open_issues_count": "open_issues"})
    rules = guidelines(files).agg(F.max("guidelines").alias("_g"))  # one row
    commands = F.coalesce(T.commands(F.coalesce("_g", F.lit(""))), F.array().cast("array<string>"))
    return told.crossJoin(F.broadcast(rules)).select(*told.columns, F.col("_g").isNotNull().alias("has_contributing"), F.substring("_g", 1, 500).alias("contributing_excerpt"), commands.alias("test_commands"))


def answer_events(answers: DataFrame) -> DataFrame:
    """answers: query_id, answer, citations. (query_id, position, event): what a client is sent, each a JSON text: a status,
    the answer four words at a time, the citations, the end."""
    said = lambda kind, **more: F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in more.items()]))
    tokens = F.transform(T.word_slices(F.col("answer")), lambda w: said("token", text=F.concat(w, F.lit(" "))))
    events = F.concat(F.array(said("status", text=F.lit(STATUS))), tokens, F.array(said("citations", citations=F.col("citations")), said("done")))
    return answers.select("query_id", F.posexplode(events).alias("position", "event"))


# --- tours --------------------------------------------------------------------------------------------------------


def reading_order(files: DataFrame, symbols: DataFrame, most: int = 10) -> DataFrame:
    """(step, path, importance, tier, label, why, summary, line_count, key_symbols): the most important files, four symbols each."""
    top = files.orderBy(F.desc("importance"), "path").limit(most)
    step = F.row_number().over(Window.orderBy(F.desc("importance"), "path"))  # of at most ``most`` rows
    best = symbols.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("importance"), "ordinal"))).filter("_r <= 4")
    item = F.struct("_r", "name", "kind", "signature", "start_line", "end_line")
    key = best.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("_r")).alias("key_symbols"))
    score = T.or_default(F.col("importance"), 1.0)
    label, why = T.tier_told(F.col("tier"))
    out = top.withColumns({"step": step, "tier": T.tier(score)}).join(key, "path", "left")
    return out.select("step", "path", F.round(score, 3).alias("importance"), "tier", label.alias("label"), why.alias("why"), "summary", "line_count", "key_symbols")


def _steps(symbols: DataFrame) -> DataFrame:
    signature = F.when(F.coalesce("signature", F.lit("")) != "", F.col("signature")).otherwise(F.concat_ws(" ", "kind", "name"))
    return symbols.select("path", "name", "start_line", "end_line", signature.alias("signature"), T.or_default(F.col("importance"), 1.0).alias("importance"))


def big_picture(files: DataFrame, symbols: DataFrame, edges: DataFrame, most: int = 12, depth: int = 3) -> DataFrame:
    """(step_order, path, name, start_line, end_line, title, body): from entry files down the calls, folders taking turns.

    Entry files are those marked so, else those named so, else the most important ones. Names are visited once, as the
    first symbol of the name.
    """
    marked = files.filter("is_entrypoint").orderBy(F.desc("importance"), "path").limit(5).select("path", "importance")
    entries = marked if not marked.isEmpty() else tours.entry_points(files.select("path", "importance"))
    inside = symbols.join(entries.select("path"), "path", "left_semi").filter(F.col("kind").isin("function", "class", "method"))
    best = inside.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("importance"), "ordinal"))).filter("_r <= 3")
    seeds = best.groupBy("name").agg(F.min(F.struct("path", "ordinal")).alias("_at")).select("name", "_at.*")
    calls = edges.filter("edge_type = 'calls'").select(F.col("source_symbol").alias("src"), F.col("target_symbol").alias("dst"), F.concat_ws("\0", "source_file", "target_file").alias("ordinal"))
    reached = graph.bounded_bfs(seeds.select(F.col("name").alias("node")), calls, depth).filter("depth > 0").select(F.col("node").alias("name"))
    of_name = symbols.groupBy("name").agg(F.min(F.struct("path", "ordinal")).alias("_at")).select("name", "_at.*")
    chosen = seeds.unionByName(reached.join(of_name, "name"))
    steps = _steps(symbols.join(chosen, ["path", "name", "ordinal"], "left_semi"))
    turns = tours.round_robin(steps.select(F.lit(1).alias("group"), F.concat_ws("\0", "path", "name", F.col("start_line").cast("string")).alias("path"), "importance"), most)
    part = lambda k: F.get(F.split("path", "\0"), F.lit(k))
    placed = turns.select("step_order", part(0).alias("path"), part(1).alias("name"), part(2).cast("int").alias("start_line"))
    valid = tours.validate_steps(placed.join(steps, ["path", "name", "start_line"]), files.select("path", "line_count"))
    order = F.row_number().over(Window.orderBy("step_order"))  # of at most ``most`` rows
    out = valid.withColumn("step_order", order)
    return out.select("step_order", "path", "name", "start_line", "end_line", F.format_string("Step %d: %s", "step_order", "name").alias("title"), F.col("signature").alias("body"))


#: Lines of a stretch by which citations and symbols of a file meet.
STRETCH = 64


def enclosing(spans: DataFrame, symbols: DataFrame) -> DataFrame:
    """spans: path, start_line, end_line; symbols: path, a, b (first and last line). Each span with each symbol around it.

    A symbol stands in every stretch of lines that it reaches into, a span in the one that it begins in, so the two meet by
    path and stretch, and not all symbols of a file meet all its spans.
    """
    stretches = F.sequence(F.floor(F.col("a") / STRETCH), F.floor(F.greatest("a", "b") / STRETCH))
    held = symbols.withColumn("_s", F.explode(stretches))
    return spans.withColumn("_s", F.floor(F.col("start_line") / STRETCH)).join(held, ["path", "_s"]).filter("a <= start_line AND b >= end_line").drop("_s")


def feature_trace(citations: DataFrame, symbols: DataFrame, most: int = 8) -> DataFrame:
    """citations: query_id, rank, path, start_line, end_line. (query_id, step_order, path, name, ...): the first symbol around each."""
    c, s = citations.filter(F.col("rank") <= most), symbols.select("path", "name", "ordinal", "kind", "signature", "importance", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    around = enclosing(c.select("query_id", "rank", "path", "start_line", "end_line"), s)
    first = around.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "rank").orderBy("ordinal"))).filter("_r = 1")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return first.select("query_id", order.alias("step_order"), "path", "name", F.col("a").alias("start_line"), F.col("b").alias("end_line"), F.col("signature").alias("body"))


# --- evaluation ---------------------------------------------------------------------------------------------------


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of id, question and expected_files."""
    asked = spark.read.schema("id int, question string, expected_files array<string>").option("multiLine", True).json(path)
    return asked.select(F.col("id").alias("query_id"), F.col("question").alias("text"), "expected_files")


def evaluate(chunks: DataFrame, questions: DataFrame, k: int = 5, model: TextModel = OFFLINE) -> DataFrame:
    """Recall at 1 and k and mean reciprocal rank, over all questions, of hits whose path contains an expected name."""
    hits = hybrid(chunks, questions.select("query_id", "text"), k, model).join(questions.select("query_id", "expected_files"), "query_id")
    good = hits.filter(F.exists("expected_files", lambda e: F.col("path").contains(e))).groupBy("query_id").agg(F.min("rank").alias("r"))
    every = questions.select("query_id").join(good, "query_id", "left")
    share = lambda cond: F.round(100 * F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)
    return every.agg(F.count(F.lit(1)).alias("n"), share(F.col("r") <= 1).alias("recall_at_1"), share(F.col("r") <= k).alias(f"recall_at_{k}"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))
