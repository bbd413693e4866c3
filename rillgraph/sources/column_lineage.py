"""Columns that PySpark code reads and writes, and which come from which.

Each file is one row in and its references out, in Arrow batches: names bound to tables, SQL strings, then method calls with
balanced brackets. A written column comes from those read in the same call; if there are none, from those on its line, and only
then from those on the line before or after.

Rows: (path, kind, column, table, context, line, source). kind: read, write, flow (source to column) or dynamic (a column
known only when the code runs; column holds the code). Null texts give nothing; each row comes once, at its first line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import LANGUAGES

SCHEMA = "path string, kind string, column string, table string, context string, line int, source string"
_STRING = re.compile(r"""^[rbuf]*("{3}|'{3}|["'])(.*)\1$""", re.S | re.I)
_COL = re.compile(r"""(?:\b(?:F\.)?col(?:umn)?\(\s*|\b\w+\[\s*)["']([^"']+)["']""")
_DYNAMIC = re.compile(r"""\b(?:F\.)?col\(\s*([A-Za-z_]\w*(?:\[[^\]]*\])?|f["'][^"']*\{[^"']*["'])\s*\)""")
_BIND = re.compile(r"""^[ \t]*(\w+)\s*=\s*\(?\s*spark\b[^\n]*?\.(?:table|parquet|csv|json|orc|load|read\.table)\(\s*["']([^"']+)["']""", re.M)
_CALL = re.compile(r"\.(select|selectExpr|filter|where|withColumn|withColumnRenamed|groupBy|groupby|agg|join|orderBy|sort|drop|dropDuplicates|partitionBy)\s*\(")
_CHAIN = re.compile(r"(\w+)\s*=\s*\(?\s*(\w+)\s*\\?\s*\.")
_SQL = re.compile(r"""\bsql\(\s*[rbf]*("{3}|'{3}|["'])(.*?)\1""", re.S)
_AGG = re.compile(r"""\b(?:F\.)?(sum|avg|mean|min|max|count|countDistinct|count_distinct|first|last|collect_list|collect_set|stddev|approx_count_distinct)\(\s*["']([^"']+)["']\s*\)(\s*\.alias\(\s*["'](\w+)["'])?""")
_WORD = re.compile(r"(?<![\w.'\"])([A-Za-z_]\w*(?:\.\w+)?)(?!\s*\()(?![\w.'\"])")
_KEYWORDS = set("select from where and or not in is null as on join left right inner outer full cross group by order having limit distinct case when then else end between like asc desc true false union all over partition with cast interval date".split())


def _inside(text: str, at: int) -> str:
    """What stands in the brackets that open just before at."""
    depth, quote, i = 1, "", at
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return text[at:i]
        i += 1
    return text[at:]


def split_arguments(s: str) -> list[str]:
    """Arguments of a call or items of a list, without those in brackets or strings apart."""
    out, depth, quote, last, i = [], 0, "", 0, 0
    while i < len(s):
        c = s[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(s[last:i])
            last = i + 1
        i += 1
    return [x.strip() for x in [*out, s[last:]] if x.strip()]


def _plain(arg: str) -> str | None:
    m = _STRING.match(arg)
    return m[2] if m and m[1] not in m[2] else None


def _sql_rows(sql: str) -> Iterator[tuple]:
    """(kind, column, table, context, sources) of one statement."""
    tables = re.findall(r"(?i)\b(?:from|join)\s+([\w.]+)(?:\s+(?:as\s+)?(?!on\b|where\b|join\b|left\b|right\b|inner\b|full\b|cross\b|group\b|order\b|limit\b|using\b)(\w+))?", sql)
    alias = {a: t for t, a in tables if a} | {t.split(".")[-1]: t for t, _ in tables}
    only = tables[0][0] if len(tables) == 1 else None

    def named(expr):
        for w in dict.fromkeys(_WORD.findall(re.sub(r"'[^']*'", " ", expr))):
            if w.lower() not in _KEYWORDS and not w.isdigit():
                yield (w.split(".", 1)[1], alias.get(w.split(".", 1)[0])) if "." in w else (w, only)

    if m := re.search(r"(?is)\bselect\s+(?:distinct\s+)?(.*?)\bfrom\b", sql):
        for item in split_arguments(m[1]):
            a = re.search(r"(?is)^(.*?)(?:\s+as\s+(\w+))?$", item)
            cols = list(named(a[1]))
            for c, t in cols:
                yield "read", c, t, "sql_select", None
            out = a[2] or (cols[0][0] if len(cols) == 1 and "(" not in a[1] else None)
            if out:
                yield "write", out, None, "sql_select", [c for c, _ in cols]
    for m in re.finditer(r"(?is)\bwhere\b(.*?)(?=\bgroup\s+by\b|\border\s+by\b|\bhaving\b|\blimit\b|$)", sql):
        for c, t in named(m[1]):
            yield "read", c, t, "sql_where", None
    for m in re.finditer(r"(?is)\bon\b(.*?)(?=\bjoin\b|\bleft\b|\bright\b|\binner\b|\bfull\b|\bwhere\b|\bgroup\s+by\b|\border\s+by\b|$)", sql):
        for c, t in named(m[1]):
            yield "read", c, t, "sql_join", None
    for m in re.finditer(r"(?is)\bgroup\s+by\b(.*?)(?=\bhaving\b|\border\s+by\b|\blimit\b|$)", sql):
        for c, t in named(m[1]):
            yield "read", c, t, "sql_group_by", None


def _name_before(text: str, at: int) -> str:
    """The name that ends before a place, white space and line continuations aside; empty if another sign stands there."""
    end = at
    while end and text[end - 1] in " \t\r\n\\":
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        start -= 1
    return text[start:end]


def references(text: str) -> list[tuple]:
    """(kind, column, table, context, line, source) of one file."""
    rows: list[tuple] = []
    table = dict(_BIND.findall(text))
    for new, old in _CHAIN.findall(text):
        if old in table:
            table.setdefault(new, table[old])
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    read_at: dict[int, dict[str, None]] = defaultdict(dict)

    def add(kind, column, tab, context, at, source=None):
        rows.append((kind, column, tab, context, at, source))
        if kind == "read":
            read_at[at][column] = None

    for m in _SQL.finditer(text):
        at = line(m.start())
        for kind, column, tab, context, sources in _sql_rows(m[2]):
            add(kind, column, tab, context, at)
            for s in sources or []:
                add("flow", column, None, context, at, s)
    for m in _CALL.finditer(text):
        name, body, at = m[1], _inside(text, m.end()), line(m.start())
        tab = table.get(_name_before(text, m.start()))
        args = split_arguments(body)
        context = {"where": "filter", "groupby": "groupBy", "sort": "orderBy"}.get(name, name)
        reads: list[str] = []
        for a in split_arguments(body.strip()[1:-1]) if body.strip().startswith("[") and body.strip().endswith("]") else args:
            plain = _plain(a)
            skip = (name in ("withColumn", "withColumnRenamed") and a is args[0]) or (name == "withColumnRenamed" and a is args[-1])
            if name == "join" and (a is args[0] or (len(args) > 2 and a is args[2]) or a.startswith("how")):
                continue
            if plain is not None and name in ("filter", "where", "selectExpr"):
                reads += [c for w in _WORD.findall(re.sub(r"'[^']*'", " ", re.split(r"(?i)\s+as\s+", plain)[0])) for c in [w.split(".")[-1]] if c.lower() not in _KEYWORDS]
            elif plain is not None and not skip and plain != "*":
                reads.append(plain.split(".")[-1])
            elif plain is None:
                reads += [c.split(".")[-1] for c in _COL.findall(a)] + [c for _, c, _, _ in _AGG.findall(a) if c != "*"]
                if name == "join" and a.startswith("["):
                    reads += [p for p in map(_plain, split_arguments(a[1:-1])) if p]
        for c in dict.fromkeys(reads):
            add("read", c, tab, context, at)
        for d in _DYNAMIC.findall(body):
            add("dynamic", d, tab, context, at)
        out: list[tuple[str, list[str]]] = []
        if name == "withColumn" and args and (p := _plain(args[0])):
            out.append((p, reads))
        elif name == "withColumnRenamed" and len(args) == 2 and (old := _plain(args[0])) and (new := _plain(args[1])):
            add("read", old, tab, context, at)
            out.append((new, [old]))
        elif name == "agg":
            for a in args:
                for f, c, _, alias in _AGG.findall(a):
                    out.append((alias or f"{f}({c})", [] if c == "*" else [c]))
        elif name in ("select", "selectExpr"):
            for a in args:
                if alias := re.search(r"""\.alias\(\s*["'](\w+)["']\s*\)\s*$""", a) or re.search(r"""(?i)\sas\s+(\w+)["']$""", a):
                    inner = _COL.findall(a) + [c for _, c, _, _ in _AGG.findall(a)]
                    out.append((alias[1], [c.split(".")[-1] for c in inner]))
        for column, sources in out:
            add("write", column, None, context, at)
            near = dict.fromkeys(sources) or read_at.get(at) or {**read_at.get(at - 1, {}), **read_at.get(at + 1, {})}
            for s in near:
                add("flow", column, None, context, at, s)
    seen: dict[tuple, tuple] = {}
    for r in sorted(rows, key=lambda r: r[4]):
        seen.setdefault((r[0], r[1], r[2], r[3], r[5]), r)
    return list(seen.values())


def column_lineage(files: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            out = [(p, *r) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for r in references(t)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], ["path", "kind", "column", "table", "context", "line", "source"])

    return files.filter(F.col("path").rlike(LANGUAGES["python"])).select("path", "text").mapInArrow(run, SCHEMA)


def confidence(rows: DataFrame) -> DataFrame:
    """(path, column, context, sources, confidence) of written columns: high, medium with several sources, low with none."""
    w = rows.filter("kind = 'write'").select("path", "column", "context").distinct()
    f = rows.filter("kind = 'flow'").groupBy("path", "column", "context").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    n = F.coalesce(F.size("sources"), F.lit(0))
    return w.join(f, ["path", "column", "context"], "left").withColumn("confidence", F.when(n == 1, "high").when(n > 1, "medium").otherwise("low"))
