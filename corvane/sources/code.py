"""Source trees: listing, ignore rules, languages, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import line_count
from corvane.session import materialise

# Languages by extension, ignore patterns, limits, manifest words.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust",
    ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala", ".sh": "bash", ".bash": "bash", ".sql": "sql", ".md": "markdown", ".json": "json", ".yaml": "yaml",
    ".yml": "yaml", ".toml": "toml", ".html": "html", ".css": "css",
}
IGNORED = [
    ".git", ".svn", ".hg", "node_modules", "vendor", ".venv", "venv", "env", "__pycache__", ".pytest_cache", "dist", "build", "out", ".next",
    "target", "bin", "obj", "coverage", ".turbo", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock",
    "Cargo.lock", "go.sum", "composer.lock", "*.min.js", "*.min.css", "*.map", "*.exe", "*.dll", "*.so", "*.dylib", "*.png", "*.jpg", "*.jpeg",
    "*.gif", "*.ico", "*.svg", "*.pdf", "*.zip", "*.tar", "*.gz", "*.7z", "*.mp4", "*.mp3", "*.wasm", "*.pyc", "*.pyo", "*.db", "*.sqlite", "*.sqlite3",
]
PRUNED = [".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".next", "target"]
MAX_BYTES = 1024 * 1024
NODE_STACK = {"next": "Next.js", "react": "React", "express": "Express", "typescript": "TypeScript", "vue": "Vue"}
PYTHON_STACK = {"fastapi": "FastAPI", "django": "Django", "flask": "Flask", "sqlalchemy": "SQLAlchemy", "pydantic": "Pydantic"}
ENTRY_FILES = [
    "main.py", "app.py", "server.py", "cli.py", "run.py", "index.ts", "index.js", "server.ts", "server.js", "src/main.py", "src/app.py",
    "src/index.ts", "src/index.js", "app/main.py",
]
# End of fixed values.
RAW = "path string, length bigint, content binary"
#: Bytes of files that Spark's readers hide, read at once.
HIDDEN_BYTES = 64 << 20


def _class(p: str, i: int) -> tuple[str, int] | None:
    """The class that opens at p[i] as a regex and where it ends; None where it is never closed. No class matches a slash."""
    at = i + 1
    negated = p[at : at + 1] in ("!", "^")
    at += negated
    first, members = at, ""
    while at < len(p) and (p[at] != "]" or at == first):
        if p[at] == "-" and at > first and p[at + 1 : at + 2] not in ("", "]"):
            members, at = members + "-", at + 1
            continue
        at += p[at] == "\\" and at + 1 < len(p)
        members, at = members + re.escape(p[at]) if p[at].isalnum() else members + "\\" + p[at], at + 1
    return (f"(?!/)[{'^' * negated}{members}]", at + 1) if at < len(p) else None


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """A gitignore pattern as (regex over a relative path, negated), for Java's and Python's expressions alike.

    Classes with ranges and negation, escapes by a backslash, ``*``, ``?`` and ``**``; a class that is not closed is literal,
    and a pattern that ends in a lone backslash matches nothing.
    """
    negated = pattern.startswith("!")
    p = pattern[negated:].rstrip("/") if pattern.endswith("/") else pattern[negated:]
    only_dirs = pattern.endswith("/")
    anchored = "/" in p
    out, i = "", 0
    p = p.lstrip("/")
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (found := _class(p, i)):
            out, i = out + found[0], found[1]
        elif p[i] == "\\":
            out, i = out + (re.escape(p[i + 1]) if i + 1 < len(p) else "(?!)"), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    try:
        re.compile(out)
    except re.error:  # a range from a later to an earlier character
        out = "(?!)"
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_dirs else "(?:/|$)"), negated


def _clean(rules: list[str] | None) -> list[str]:
    return [x for x in (r.strip() for r in rules or []) if x and not x.startswith("#")]


def ignored(path: Column, extra: list[str] | None = None) -> Column:
    """The last matching pattern decides; runs of one polarity are one regex."""
    out: Column = F.lit(False)
    runs: list[tuple[list[str], bool]] = []
    for rule in [*IGNORED, *_clean(extra)]:
        regex, negated = ignore_regex(rule)
        if runs and runs[-1][1] == negated:
            runs[-1][0].append(regex)
        else:
            runs.append(([regex], negated))
    for regexes, negated in runs:
        out = F.when(path.rlike("|".join(regexes)), F.lit(not negated)).otherwise(out)
    return out


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def pruned(path: Column) -> Column:
    """Whether a folder above the file is one that is never entered. A folder's path is tested without the dots and slashes before it."""
    above = F.regexp_replace(path, "/?[^/]*$", "")
    hard = "|".join(re.escape(d) for d in PRUNED)
    return above.rlike(f"(^|/)({hard})(/|$)") | F.regexp_replace(above, "^[./]+", "").rlike(f"^({hard})(/|$)")


def kept(path: Column, length: Column, gitignore: list[str] | None = None) -> Column:
    """Whether a file is of the tree: of some size, at most ``MAX_BYTES``, not ignored, in no pruned folder, of a known language."""
    return length.between(1, MAX_BYTES) & ~ignored(path, gitignore) & ~pruned(path) & language(path).isNotNull()


def describe(files: DataFrame, gitignore: list[str] | None = None) -> DataFrame:
    """files: path (relative), length, content. Kept ones with language, text, hash and line count; malformed UTF-8 is replaced."""
    found = files.filter(kept(F.col("path"), F.col("length"), gitignore)).withColumn("language", language(F.col("path")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return found.select("path", "language", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), text.alias("text")).withColumn("line_count", line_count(F.col("text")))


def _rules(gitignore: list[str] | None) -> list[tuple[re.Pattern, bool]]:
    return [(re.compile(regex), negated) for regex, negated in map(ignore_regex, [*IGNORED, *_clean(gitignore)])]


def _ignored(path: str, rules: list[tuple[re.Pattern, bool]]) -> bool:
    return next((not negated for regex, negated in reversed(rules) if regex.search(path)), False)


def walk(spark: SparkSession, root: str, gitignore: list[str] | None = None) -> list[tuple[str, int]]:
    """(path below root, length) of the files that are kept: one listing a folder, pruned folders are not entered.

    A tree's listing is the driver's, as a repository's is small beside its contents, which are read by tasks.
    """
    fs, top = _file_system(spark, root)
    rules, out, todo = _rules(gitignore), [], [""]
    while todo:
        folder = todo.pop()
        for status in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(top + folder)):
            name = status.getPath().getName()
            path = f"{folder}{name}"
            if status.isDirectory():
                if name not in PRUNED and not _ignored(path.lstrip("./"), rules):
                    todo.append(path + "/")
            elif 0 < status.getLen() <= MAX_BYTES and not _ignored(path, rules) and re.sub(r"^.*(?=\.[^./]+$)", "", path.rsplit("/", 1)[-1]).lower() in LANGUAGES:
                out.append((path, status.getLen()))
    return sorted(out)


def _file_system(spark: SparkSession, root: str):
    """The file system, and the root's full name with a slash at its end."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(top).toString().rstrip("/") + "/"


def _contents(spark: SparkSession, fs, path: str) -> bytes:
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(path))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def scan(spark: SparkSession, root: str, gitignore: list[str] | None = None) -> DataFrame:
    """A source tree below ``root`` on any file system that Spark reads; without ``gitignore``, the file of that name at
    its top is obeyed. Paths and lengths are listed first; only files that are kept are then read, by tasks. Spark's
    readers hide names that begin with ``_`` or ``.`` (``__init__.py``): the driver reads those, so many bytes at a time.
    """
    fs, top = _file_system(spark, root)
    rules = top + ".gitignore"
    if gitignore is None and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(rules)):
        gitignore = _contents(spark, fs, rules).decode("utf-8", "replace").splitlines()
    listed = walk(spark, root, gitignore)
    shown = [p for p, _ in listed if p.rsplit("/", 1)[-1][0] not in "_."]
    parts, batch, size = [], [], 0
    if shown:
        escaped = [top + re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in shown]
        raw = spark.read.format("binaryFile").load(escaped)
        plain = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
        parts.append(raw.select(F.substr(plain, F.lit(len(re.sub("^[a-z]+:/+", "/", top)) + 1)).alias("path"), "length", "content"))
    hidden = [(p, n) for p, n in listed if p.rsplit("/", 1)[-1][0] in "_."]
    for k, (path, n) in enumerate(hidden, 1):
        batch.append((path, n, _contents(spark, fs, top + path)))
        size += n
        if size >= HIDDEN_BYTES or k == len(hidden):
            parts.append(materialise(spark.createDataFrame(batch, RAW), "hidden-files"))
            batch, size = [], 0
    raw = parts[0] if parts else spark.createDataFrame([], RAW)
    for more in parts[1:]:
        raw = raw.unionByName(more)
    return describe(raw, gitignore)


def write_tree(spark: SparkSession, root: str, files: list[tuple[str, bytes]]) -> str:
    """A small tree from the driver, for demonstrations and tests, on any file system."""
    for path, content in files:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
        stream.write(bytearray(content))
        stream.close()
    return root


def tech_stack(files: DataFrame) -> DataFrame:
    """files: path, text. One row: stack and entry points as sorted lists."""
    deps = F.map_keys(F.map_concat(*[F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for k in ("dependencies", "devDependencies")]))
    name = F.col("path")
    node = F.when(name == "package.json", F.filter(F.array(*[F.when(F.array_contains(deps, k), F.lit(v)) for k, v in NODE_STACK.items()]), lambda x: x.isNotNull()))
    python = F.when(name == "requirements.txt", F.filter(F.array(*[F.when(F.lower("text").contains(k), F.lit(v)) for k, v in PYTHON_STACK.items()], F.lit("Python")), lambda x: x.isNotNull()))
    docker = F.when(name == "Dockerfile", F.array(F.lit("Docker"))).when(name == "docker-compose.yml", F.array(F.lit("Docker Compose")))
    entry = F.when(name.isin(ENTRY_FILES), F.array(name)).when(name == "package.json", F.filter(F.array(F.get_json_object("text", "$.main")), lambda x: x.isNotNull()))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = files.agg(flat(F.coalesce(node, python, docker)).alias("stack"), flat(entry).alias("entrypoints"))
    some = lambda c, d: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(d)))
    return out.select(some("stack", "Python / Polyglot").alias("stack"), some("entrypoints", "main entrypoint").alias("entrypoints"))
