"""The match score of two names as one Column expression: signals, penalties, explanation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, normalize, tokenize

COMMON = sorted(
    "url uri api id key app config info data name value val type env var str int bool num msg obj item list dict file path dir in out src dst old new tmp temp".split()
)
GENERIC = sorted(
    "uuid guid id version status state kind type name class category group owner note text comment description message error warning info debug trace date time timestamp".split()
)
LOW_VALUE = sorted(
    "prod production dev development staging test aws azure gcp docker k8s kubernetes default main master primary replica secondary private public external internal local remote".split()
)


@dataclass(frozen=True)
class Config:
    weights: dict = field(default_factory=lambda: {"exact": 1.0, "normalized": 0.9, "overlap_high": 0.8, "overlap_medium": 0.6, "suffix": 0.7, "prefix": 0.7, "contains": 0.4, "single": 0.2})
    multipliers: dict = field(default_factory=lambda: {"generic": 0.1, "direction": 0.1, "common": 0.3, "short": 0.5, "ambiguity": 0.8, "low_value": 0.6})
    short: int = 4
    high: int = 3
    medium: int = 2


DEFAULT = Config()


def _among(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def score(
    source: str | Column, target: str | Column, source_tokens: Column | None = None, target_tokens: Column | None = None, alternatives: Column | int = 0,
    source_type: Column | None = None, target_type: Column | None = None, config: Config = DEFAULT,
) -> Column:
    """struct(score, signals, penalties, matched) of a source (provider) and a target (variable).

    signals and penalties are arrays of structs in a fixed order, matched the shared tokens in order. A null name gives a
    null struct.
    """
    s, t = col(source), col(target)
    st = tokenize(s) if source_tokens is None else source_tokens
    tt = tokenize(t) if target_tokens is None else target_tokens
    alt = F.lit(alternatives) if isinstance(alternatives, int) else alternatives
    n = config.short
    # each value is bound once, since expressions under one another would be evaluated as often as they are named
    given = F.struct(s.alias("s"), t.alias("t"), normalize(s).alias("sn"), normalize(t).alias("tn"), F.array_sort(F.array_intersect(st, tt)).alias("matched"), alt.alias("alt"))
    value = bound(given, lambda g: bound(_parts(g, n), lambda q: bound(_fired(g, q, config), lambda e: _result(g, q, e, source_type, target_type, config))))
    return F.when(s.isNotNull() & t.isNotNull(), value)


def _parts(g: Column, n: int) -> Column:
    sn, tn, matched = g["sn"], g["tn"], g["matched"]
    plain = F.array_except(matched, _among(COMMON))  # not common
    long, exact = (F.length(sn) >= n) & (sn != tn), g["s"] == g["t"]
    return F.struct(
        F.size(matched).alias("matched"), F.size(plain).alias("plain"), F.size(F.filter(plain, lambda x: F.length(x) >= n)).alias("strong"), F.size(F.array_intersect(matched, _among(LOW_VALUE))).alias("low"),
        F.size(F.filter(matched, lambda x: F.length(x) >= n)).alias("longer"), exact.alias("exact"), ((sn == tn) & ~exact).alias("normal"), (long & F.endswith(tn, sn)).alias("suffix"), (long & F.startswith(tn, sn)).alias("prefix"),
        ((F.length(sn) >= n) & F.contains(tn, sn)).alias("inside"),
    )


def _fired(g: Column, q: Column, config: Config) -> Column:
    w, strong, ends = config.weights, q["strong"], q["suffix"] | q["prefix"]
    inside = q["inside"] & ~q["exact"] & ~q["normal"] & ~q["suffix"] & ~q["prefix"]
    single = (q["matched"] > 0) & ~(q["exact"] | q["normal"] | ends | inside) & (strong < config.medium)
    fired = [
        ("exact", q["exact"]), ("normalized", q["normal"]), ("overlap_high", strong >= config.high),
        ("overlap_medium", (strong >= config.medium) & (strong < config.high)), ("suffix", q["suffix"]), ("prefix", q["prefix"]), ("contains", inside), ("single", single),
    ]
    return F.filter(F.array(*(F.when(c, F.struct(F.lit(k).alias("signal"), F.lit(float(w[k])).alias("weight"))) for k, c in fired)), lambda x: x.isNotNull())


def _result(g: Column, q: Column, signals: Column, source_type: Column | None, target_type: Column | None, config: Config) -> Column:
    m, alt = config.multipliers, g["alt"]
    top = F.array_max(F.transform(signals, lambda x: x["weight"]))
    base = F.when(F.size(signals) > 0, F.least(F.lit(1.0), top + F.least(F.lit(0.1), F.lit(0.02) * (F.size(signals) - 1)))).otherwise(F.lit(0.0))
    reverse = F.lit(False) if source_type is None or target_type is None else (source_type == "env_var") & (target_type == "infra_resource")
    cut = [
        ("generic", g["sn"].isin(GENERIC), F.lit(m["generic"])),
        ("direction", reverse, F.lit(m["direction"])),
        ("common", (q["matched"] > q["plain"]) & (q["plain"] == 0), F.lit(m["common"])),
        ("short", (q["matched"] > 0) & (q["longer"] == 0), F.lit(m["short"])),
        ("ambiguity", (alt > 1) & (g["sn"] != g["tn"]), F.greatest(F.lit(0.2), F.pow(F.lit(m["ambiguity"]), alt - 1))),
        ("low_value", (q["low"] >= 1) & (q["low"] >= q["plain"]), F.lit(m["low_value"])),
    ]
    made = F.filter(F.array(*(F.when(c, F.struct(F.lit(k).alias("penalty"), v.cast("double").alias("multiplier"))) for k, c, v in cut)), lambda x: x.isNotNull())
    value = lambda p: F.round(F.aggregate(p, base.cast("double"), lambda a, x: a * x["multiplier"]), 4)
    return bound(made, lambda p: F.struct(value(p).alias("score"), signals.alias("signals"), p.alias("penalties"), g["matched"].alias("matched")))


def explanation(result: Column) -> Column:
    """A report of a score in lines."""
    lines = F.concat(
        F.array(F.format_string("score %.2f", result["score"])),
        F.transform(result["signals"], lambda x: F.format_string("+ %s %.2f", x["signal"], x["weight"])),
        F.transform(result["penalties"], lambda x: F.format_string("- %s x%.2f", x["penalty"], x["multiplier"])),
    )
    return F.array_join(lines, "\n")
