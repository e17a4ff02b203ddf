"""Queries over source files made from the test tables: classes and methods, another language, imports, symbols that are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import code
from corvane.plans.catalog import query, table

# --- Python: a class with methods, dotted calls, a decorated function that is left out -------------------------------

_CLASS = 'class P%d(Base):\n    """%s."""\n\n    def price(self, x):\n        y = self.scale(x)\n        return util.total(y, round(x))\n\n    async def scale(self, x=1) -> int:\n        return x\n'
_LEFT_OUT = "\n\n@cached\ndef skipped(x):\n    return x\n"


def _sql(form: str, *parts: str) -> str:
    pieces = ["'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in form.replace("%s", "%d").split("%d")]
    return "(" + " || ".join(x for pair in zip(pieces, [*parts, "''"], strict=True) for x in pair) + ")"


def _told(parsed: DataFrame) -> DataFrame:
    s = code.symbols_of(parsed)
    return s.select("path", "ordinal", "name", "kind", F.coalesce("parent", F.lit("")).alias("parent"), "signature", F.coalesce("docstring", F.lit("")).alias("docstring"), "start_line", "end_line",
                    F.sha2("content", 256).alias("content_hash"), F.array_join("calls", "|").alias("calls"))


@query(f"""WITH c AS (SELECT 'p' || p_partkey || '.py' AS path, 'P' || p_partkey AS cls, p_name, string_split({_sql(_CLASS, 'p_partkey', 'p_name')}, chr(10)) AS l FROM part)
SELECT path, 0 AS ordinal, cls AS name, 'class' AS kind, '' AS parent, 'class ' || cls || '(Base)' AS signature, p_name || '.' AS docstring, 1 AS start_line, 9 AS end_line, sha256(array_to_string(l[1:9], chr(10)) || chr(10)) AS content_hash, '' AS calls FROM c
UNION ALL SELECT path, 1, cls || '.price', 'method', cls, 'def ' || cls || '.price(self, x)', '', 4, 6, sha256(array_to_string(l[4:6], chr(10)) || chr(10)), 'total|util.total|round|scale|self.scale' FROM c
UNION ALL SELECT path, 2, cls || '.scale', 'method', cls, 'def ' || cls || '.scale(self, x=1) -> int', '', 8, 9, sha256(array_to_string(l[8:9], chr(10)) || chr(10)), '' FROM c""")
def parse_classes(spark, d):
    """A class a part: methods under their class, the last part of a dotted call and the whole, nothing of what is decorated."""
    p = table(spark, d, "part")
    text = F.concat(F.format_string(_CLASS, F.col("p_partkey").cast("long"), "p_name"), F.lit(_LEFT_OUT))
    return _told(code.parse(p.select(F.format_string("p%d.py", F.col("p_partkey").cast("long")).alias("path"), F.lit("python").alias("language"), text.alias("text")), ["symbols"]))


# --- TypeScript, by patterns ------------------------------------------------------------------------------------------

_SCRIPT = """import { a, b } from './m%d'
import x from 'lib'
export class C%d extends Base {
  run(a) { return go(a) }
}
export interface I%d {}
export async function f%d(x, y) {
  return g%d(x)
}
export const h%d = async (z) => f%d(z, 1)
"""


def _scripts(spark, d) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    return table(spark, d, "customer").select(F.format_string("c%d.ts", k).alias("path"), F.lit("typescript").alias("language"), F.format_string(_SCRIPT, k % 7, k, k, k, k % 5, k, k).alias("text"))


@query(f"""WITH c AS (SELECT 'c' || c_custkey || '.ts' AS path, c_custkey AS k, 'f' || c_custkey AS f, 'g' || (c_custkey % 5) AS g, string_split({_sql(_SCRIPT, 'c_custkey % 7', *['c_custkey'] * 3, 'c_custkey % 5', 'c_custkey', 'c_custkey')}, chr(10)) AS l FROM customer),
s AS (SELECT *, 0 AS ordinal, 'C' || k AS name, 'class' AS kind, 'export class C' || k || ' extends Base' AS signature, 3 AS start_line, 'run|go|' || f || '|' || g || '|async' AS calls FROM c
 UNION ALL SELECT *, 1, 'I' || k, 'interface', 'export interface I' || k, 6, f || '|' || g || '|async' FROM c
 UNION ALL SELECT *, 2, f, 'function', 'export async function ' || f || '(x, y)', 7, f || '|' || g || '|async' FROM c
 UNION ALL SELECT *, 3, 'h' || k, 'function', 'export const h' || k || ' = async (z) =>', 10, 'async|' || f FROM c)
SELECT path, ordinal, name, kind, '' AS parent, signature, '' AS docstring, start_line, 10 AS end_line, sha256(array_to_string(l[start_line:10], chr(10)) || chr(10)) AS content_hash, calls FROM s""")
def parse_typescript(spark, d):
    return _told(code.parse(_scripts(spark, d), ["symbols"]))


@query("""SELECT 'c' || c_custkey || '.ts' AS path, o::INT AS ordinal, CASE o WHEN 0 THEN './m' || (c_custkey % 7) ELSE 'lib' END AS module, CASE o WHEN 0 THEN 'a|b' ELSE '' END AS names,
 CASE o WHEN 0 THEN 'import { a, b } from ''./m' || (c_custkey % 7) || '''' ELSE 'import x from ''lib''' END AS raw FROM customer, (VALUES (0), (1)) v(o)""")
def parse_imports(spark, d):
    i = code.imports_of(code.parse(_scripts(spark, d), ["imports"]))
    return i.select("path", "ordinal", "module", F.array_join("names", "|").alias("names"), "raw")


# --- symbols over the limit -------------------------------------------------------------------------------------------

_LINE, _RETURN = "    x = '" + "a" * 29 + "'\n", "    return x\n"


@query(f"""WITH n AS (SELECT n_nationkey AS k, 5 + 2 * n_nationkey AS b, 'def f' || n_nationkey || '():' || chr(10) || repeat(repeat({_sql(_LINE)}, 10) || chr(10), 5 + 2 * n_nationkey) || {_sql(_RETURN)} AS t FROM nation),
p AS (SELECT *, unnest(range(0, b // 8 + 1)) AS i, string_split(t, chr(10)) AS l FROM n),
c AS (SELECT *, 1 + 88 * i AS a, CASE WHEN i = b // 8 THEN 11 * b + 2 ELSE 88 * (i + 1) END AS z FROM p),
x AS (SELECT *, array_to_string(l[a:z], chr(10)) || chr(10) AS content FROM c)
SELECT 'n' || k || '.py' AS path, i::INT AS ordinal, 'f' || k || CASE WHEN b >= 8 THEN ' (Part ' || (i + 1) || ')' ELSE '' END AS name, CASE WHEN b >= 8 THEN 'symbol_part' ELSE 'symbol' END AS chunk_type,
 a::INT AS start_line, z::INT AS end_line, greatest(1, length(content) // 4)::BIGINT AS token_count, sha256(content) AS content_hash FROM x""")
def split_symbol(spark, d):
    """A function a nation, of 5 to 53 blocks of 100 tokens: those over the limit are cut before the blank line that passes it."""
    k = F.col("n_nationkey").cast("int")
    block = F.repeat(F.concat(F.repeat(F.lit(_LINE), 10), F.lit("\n")), 5 + 2 * k)
    files = table(spark, d, "nation").select(F.format_string("n%d.py", k).alias("path"), F.lit("python").alias("language"), F.concat(F.format_string("def f%d():\n", k), block, F.lit(_RETURN)).alias("text"))
    c = code.chunk(files, code.parse(files))
    return c.select("path", "ordinal", "name", "chunk_type", "start_line", "end_line", F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("long").alias("token_count"), F.sha2("content", 256).alias("content_hash"))
