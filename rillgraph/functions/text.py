"""Scalar functions on names, identifiers and patterns, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = "._-/:"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, then) -> Column:
    """then(value), where value is evaluated once, however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalize(c: str | Column, spaces: bool = False) -> Column:
    """Lower case without separators (and spaces)."""
    return F.translate(F.lower(col(c)), SEPARATORS + (" " if spaces else ""), "")


def tokenize(c: str | Column) -> Column:
    """Lower-case parts between separators and white space."""
    return F.filter(F.split(F.lower(col(c)), r"[_.\-/:\s]+"), lambda t: t != "")


def tokenize_context(c: str | Column) -> Column:
    """As tokenize, but camelCase is split too, and single characters are dropped."""
    return F.filter(tokenize(F.regexp_replace(col(c), "([a-z])([A-Z])", "$1_$2")), lambda t: F.length(t) >= 2)


def tokenize_suggest(c: str | Column) -> Column:
    """As tokenize, for mapping suggestions: tokens of three characters or more."""
    return F.filter(tokenize(c), lambda t: F.length(t) > 2)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared tokens over all tokens, 0 if there are none."""
    both = F.size(F.array_union(col(a), col(b)))
    return F.when(both > 0, F.size(F.array_intersect(col(a), col(b))) / both).otherwise(F.lit(0.0))


#: Token lists by preset: blocked tokens count nothing, weak ones half; short ones (under ``short``) 0.3.
PRESETS = {
    "default": {
        "blocked": "and api app auth bool config data db dict dir dst env err file for get host id in info int key list log map msg name new not num old out password path port secret set setting src str temp test the token type url user val var".split(),
        "weak": "aws azure backup bucket cache cloud cluster default dev development external gcp group instance internal local main master pool primary private prod production public queue read remote replica secondary service slave stage staging worker write".split(),
        "short": 3,
    },
    "lenient": {
        "blocked": "and bool config data dict dst err for get in info int list msg new not old out set setting src str the val var".split(),
        "weak": "aws azure bucket cloud cluster db default dev gcp group host id instance key main name password path pool port prod type url user".split(),
        "short": 3,
    },
}


def significant(tokens: str | Column, preset: str = "default") -> Column:
    p = PRESETS[preset]
    return F.filter(col(tokens), lambda t: (F.length(t) >= p["short"]) & ~t.isin(p["blocked"]))


def token_weight(t: Column, preset: str = "default") -> Column:
    p = PRESETS[preset]
    return F.when(t.isin(p["blocked"]), 0.0).otherwise(F.when(t.isin(p["weak"]), 0.5).otherwise(1.0) * F.when(F.length(t) < p["short"], 0.3).otherwise(1.0))


def _weights(tokens: Column, preset: str) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda a, t: a + token_weight(t, preset))


def weighted_overlap(a: str | Column, b: str | Column, preset: str = "default") -> Column:
    """Weight of the shared tokens over the weight of all."""
    lists = F.struct(F.array_distinct(col(a)).alias("a"), F.array_distinct(col(b)).alias("b"))
    sums = bound(lists, lambda x: F.struct(_weights(x["a"], preset).alias("a"), _weights(x["b"], preset).alias("b"), _weights(F.array_intersect(x["a"], x["b"]), preset).alias("shared")))
    share = lambda w: F.when(w["a"] + w["b"] - w["shared"] > 0, w["shared"] / (w["a"] + w["b"] - w["shared"])).otherwise(F.lit(0.0))
    return bound(sums, share)


def sufficient_overlap(a: str | Column, b: str | Column, least: int = 2, preset: str = "default") -> Column:
    return F.size(significant(F.array_intersect(col(a), col(b)), preset)) >= least


def match_quality(a: str | Column, b: str | Column, preset: str = "default") -> Column:
    """Struct of all that is said about two token lists: their significant tokens, what these share and how much of them that
    is, the weighted share of all tokens, the blocked and the weak tokens of both, and whether the overlap is sufficient."""
    given = F.struct(col(a).alias("a"), col(b).alias("b"))
    return bound(given, lambda x: bound(F.struct(significant(x["a"], preset).alias("a"), significant(x["b"], preset).alias("b")), lambda y: _quality(x["a"], x["b"], y["a"], y["b"], preset)))


def _quality(a: Column, b: Column, sa: Column, sb: Column, preset: str) -> Column:
    p = PRESETS[preset]
    both = F.array_sort(F.array_distinct(F.array_intersect(sa, sb)))
    of = lambda tokens, words: F.filter(tokens, lambda t: t.isin(p[words]))
    return F.struct(
        sa.alias("significant_source"), sb.alias("significant_target"), both.alias("overlap"), F.size(both).alias("overlap_count"), jaccard(sa, sb).alias("jaccard"), weighted_overlap(a, b, preset).alias("weighted"),
        of(a, "blocked").alias("blocked_source"), of(b, "blocked").alias("blocked_target"), of(a, "weak").alias("weak_source"), of(b, "weak").alias("weak_target"), (F.size(both) >= 2).alias("sufficient"),
    )


def glob_regex(pattern: str) -> str:
    """A glob as an anchored Java regular expression; everything but * ? and [..] is literal, case counts."""
    out = []
    for part in re.findall(r"\*+|\?|\[[^\]]+\]|[^*?\[]+|\[", pattern):
        if part[0] == "*":
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif part[0] == "[" and len(part) > 1:
            out.append("[" + ("^" + part[2:-1] if part[1] == "!" else part[1:-1]).replace("\\", "\\\\") + "]")
        else:
            out.append(re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", part))
    return "^" + "".join(out) + "$"


def glob_column(c: str | Column) -> Column:
    """glob_regex for a column of patterns (* and ? only), literal parts quoted."""
    quoted = F.concat(F.lit(r"\Q"), col(c), F.lit(r"\E"))
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(r"\E.*\Q")), F.lit("?"), F.lit(r"\E.\Q")), F.lit("$"))


def expand_wildcard(node_id: str | Column, source: str | Column, target: str | Column) -> Column:
    """The target of a wildcard mapping for a matching id: what the source's first * matched replaces the target's."""
    one = F.regexp_replace(glob_column(source), r"\.\*", "(.*)")
    got = F.call_function("regexp_extract", col(node_id), one, F.lit(1))  # the pattern is a column
    return F.when(F.instr(col(target), "*") > 0, F.replace(col(target), F.lit("*"), got)).otherwise(col(target))


def normal_path(c: str | Column) -> Column:
    """Path without leading dots and slashes."""
    return F.regexp_replace(col(c), r"^[./]+", "")


def name_of(c: str | Column) -> Column:
    """What follows '://' or the first ':' of an id."""
    c = col(c)
    return F.when(F.instr(c, "://") > 0, F.regexp_extract(c, "://(.*)$", 1)).when(F.instr(c, ":") > 0, F.regexp_extract(c, "^[^:]*:(.*)$", 1)).otherwise(c)


def last_name_of(c: str | Column) -> Column:
    return F.substring_index(col(c), ":", -1)


def type_of(c: str | Column) -> Column:
    """Node type by id prefix."""
    c = col(c)
    kinds = [("env:", "env_var"), ("infra:", "infra_resource"), ("k8s:", "infra_resource"), ("data:", "data_asset"), ("column:", "data_asset"), ("job:", "job"), ("test:", "job"), ("config:", "config_key"), ("file://", "code_file"), ("entity:", "code_entity")]
    out = F.when(c.startswith(kinds[0][0]), kinds[0][1])
    for prefix, kind in kinds[1:]:
        out = out.when(c.startswith(prefix), kind)
    return out.otherwise("unknown")


def blast_bucket(c: str | Column) -> Column:
    """Domain of an affected id: infra, data, code or unknown."""
    c = col(c)
    return F.when(c.rlike("^(infra|k8s):"), "infra").when(c.rlike("^(data|column):"), "data").when(c.rlike("^(file|entity|env|job):"), "code").otherwise("unknown")


def lineage_bucket(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.startswith("data:"), "data").when(c.rlike("^(file|job):"), "code").when(c.startswith("env:"), "config").when(c.startswith("infra:"), "infra").otherwise("other")


def confidence(c: str | Column = "confidence") -> Column:
    """Missing and zero confidence count as one half."""
    return F.coalesce(F.nullif(col(c), F.lit(0.0)), F.lit(0.5))


def confidence_level(c: str | Column = "confidence") -> Column:
    c = col(c)
    return F.when(c >= 0.8, "HIGH").when(c >= 0.6, "MEDIUM").when(c >= 0.4, "LOW").otherwise("VERY LOW")


def visible(c: str | Column = "confidence", mode: str = "discovery", show_low: bool = False) -> Column:
    """Whether an edge shows in a mode: from 0.3 in discovery (0.2 with show_low), from 0.5 in enforcement."""
    return col(c) >= (0.5 if mode == "enforcement" else 0.2 if show_low else 0.3)


def lowercase(c: Column) -> Column:
    """Whether a text has letters with case and all of them are lower case."""
    return (F.lower(c) == c) & (F.upper(c) != c)


#: Values that stand where a variable's name could, in calls with a default.
DEFAULT_WORDS = "admin app ascii critical default dev dev-secret development disabled enabled error false info localhost main myapp no none null off on prod production root secret staging test true user utf-8 utf8 warning yes".split()


def valid_env_name(c: str | Column) -> Column:
    """What extraction takes for a variable's name: two characters or more, no default value, number, path, URL or sentence, no
    leading digit or dot, and not a plain lower-case word of more than six letters."""
    c = col(c)
    word = lowercase(c) & ~c.rlike("[_-]") & (F.length(c) > 6)
    return (F.length(c) >= 2) & ~F.lower(c).isin(DEFAULT_WORDS) & ~c.rlike(r"^[\p{Nd}.]|[ /]") & ~word


def checked_env_name(c: str | Column) -> Column:
    """What the check gate takes for a variable's name: three characters or more, no brackets, braces, dollars or backslashes,
    none of some stand-ins (as they are written), and not a lower-case word without an underscore."""
    c = col(c)
    return (F.length(c) >= 3) & ~c.rlike(r"[\\${}()\[\]]") & ~c.isin("VAR", "config", "data", "key", "name", "options", "value") & ~(lowercase(c) & (F.instr(c, "_") == 0))


def valid_table_name(c: str | Column) -> Column:
    """What extraction takes for a table's name: two characters or more, no word that a variable is likely to have, and not
    a plain lower-case word, without dot, slash or underscore."""
    c = col(c)
    stand_in = F.lower(c).isin("data", "file", "input", "output", "path", "source", "table", "target", "temp", "tmp")
    return (F.length(c) >= 2) & ~stand_in & ~(lowercase(c) & ~c.rlike("[._/]"))


IGNORED_PARTS = [".git", ".tox", ".venv", "__pycache__", "__tests__", "build", "corpus", "dist", "e2e", "e2e_live", "fixtures", "node_modules", "site-packages", "test", "tests", "venv"]


def ignored_path(c: str | Column, parts: list[str] = IGNORED_PARTS) -> Column:
    """Whether a part of a path, whatever its case, is one of those; backslashes divide parts too."""
    return F.arrays_overlap(F.split(F.lower(col(c)), r"[/\\]"), F.array(*map(F.lit, parts)))


def suggest_patterns(c: str | Column) -> Column:
    """Globs that match an id, from the id itself to its whole prefix."""
    c = col(c)
    prefix, name = F.substring_index(c, ":", 1), F.regexp_extract(c, "^[^:]*:(.*)$", 1)
    dot, low = F.substring_index(name, ".", 1), F.substring_index(name, "_", 1)
    end = F.regexp_extract(name, "(_(?:ARN|HOST|ID|KEY|NAME|PORT|SECRET|TOKEN|URL))$", 1)
    made = F.array(
        c,
        F.when((F.instr(name, ".") > 0) & (dot != ""), F.concat(prefix, F.lit(":"), dot, F.lit(".*"))),
        F.when((F.instr(name, "_") > 0) & (low != ""), F.concat(prefix, F.lit(":"), low, F.lit("_*"))),
        F.when(end != "", F.concat(prefix, F.lit(":*"), end)),
        F.concat(prefix, F.lit(":*")),
    )
    return F.when(F.instr(c, ":") > 0, F.array_distinct(F.filter(made, lambda x: x.isNotNull()))).otherwise(F.array(c))


def source_format(pattern: str | Column) -> Column:
    """Storage format named by a read or write call."""
    p, out = F.lower(col(pattern)), None
    for kind in ("parquet", "delta", "csv", "json", "orc", "jdbc", "avro"):
        hit = F.instr(p, kind) > 0
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("table")


def js_framework(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.startswith("NEXT_"), "nextjs").when(c.startswith("VITE_"), "vite").when(c.startswith("REACT_APP_"), "create-react-app")


def js_public(c: str | Column) -> Column:
    """Whether bundlers put a variable into what browsers get."""
    return col(c).rlike("^(NEXT_PUBLIC_|VITE_|REACT_APP_)")


def selector_hash(c: str | Column) -> Column:
    """Eight hexadecimal digits of a label selector (a map of strings), the same whatever the labels' order: the MD5 of its JSON with
    sorted keys and a space after each comma and colon."""
    q = lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    pairs = F.transform(F.array_sort(F.map_entries(col(c))), lambda e: F.concat(q(e["key"]), F.lit(": "), q(e["value"])))
    return F.substring(F.md5(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))), 1, 8)


def hierarchy(c: str | Column) -> Column:
    """How far up an infrastructure name stands; the first part found decides."""
    c, out = F.lower(col(c)), None
    for part, rank in (("vpc", 10), ("subnet", 9), ("security_group", 8), ("iam", 7), ("rds", 5), ("db", 5), ("instance", 4), ("lambda", 3), ("s3", 3)):
        hit = F.instr(c, part) > 0
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return out.otherwise(0)
