"""URL filtering by host-suffix and path-prefix expressions.

Each URL becomes its host's suffixes times its path's prefixes: the whole host and its last labels, the path with the query,
without it, and its leading folders. As many labels and folders are tried as the deepest rule has, so every rule can match.
Expressions equi-join with the rules on the first four bytes of their SHA-256; only then the whole digests are compared.
Everything is built-in Spark SQL. The rule that decides is that with the longest host suffix, then the longest path; at
equal lengths 'allow' beats 'block'.

URLs and rules are made canonical first: hosts in lower case without port, user and closing dots; percent signs that encode
unreserved characters (letters, digits and ``-._~``) are decoded, hosts altogether, and the hexadecimal digits of the others are upper case, so neither case nor ``%2e``
evades a rule; fragments, tabs and line ends are dropped. Hosts that are IP addresses (four numbers, or in brackets) have no suffixes but themselves.

Defined results: null and unparsable URLs have no expression and get action 'allow' with a null rule; rules with null parts are left out, equal rules
count once; every row of pages gives one row, equal rows equal ones; empty tables give empty results. Without rules all are
allowed. Only page_id and url are read; very long URLs are tried whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The default list: (host suffix, path prefix, action). A production list is a table with these columns.
RULES = [
    ("cheap-pills.example.com", "/", "block"),
    ("cheap-pills.example.com", "/de/", "allow"),
    ("casino-win.example.org", "/", "block"),
    ("free-bets.example.com", "/", "block"),
    ("ads-track.example.org", "/", "block"),
    ("example.net", "/es/", "block"),
    ("tionsh.example.net", "/", "allow"),
    ("example.org", "/fr/", "block"),
    ("example.org", "/fr/", "allow"),
]


UNRESERVED = [c for c in range(0x30, 0x7F) if chr(c).isalnum()] + [0x2D, 0x2E, 0x5F, 0x7E]


def canonical(c: F.Column, every: bool = False) -> F.Column:
    """Percent codes of unreserved characters decoded (of any ASCII sign that shows, for hosts), the others in upper case. One pass
    over the codes of a text; texts without a percent sign are left as they are."""
    codes = range(0x21, 0x7F) if every else UNRESERVED
    table = F.create_map(*(F.lit(x) for k in codes for x in (f"{k:02X}", chr(k))))
    pieces = F.split(c, "%(?=[0-9A-Fa-f]{2})")
    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda x: F.concat(F.coalesce(F.try_element_at(table, F.upper(F.substring(x, 1, 2))), F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)))), F.substring(x, 3, 1 << 30)))
    return F.when(F.instr(c, "%") > 0, F.concat(pieces[0], F.array_join(rest, ""))).otherwise(c)


def host_of(c: F.Column) -> F.Column:
    return F.regexp_replace(F.lower(canonical(c, every=True)), r"^\.+|\.+$", "")


ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"


def parts(url: str = "url") -> tuple[F.Column, F.Column, F.Column]:
    """Host, path and query of a URL as columns; the host is null where the URL can't be parsed."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"[\t\r\n]", "")
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?(\[[^\]/]*\]|[^/?:]+)(?::[0-9]*)?(/[^?]*)?(\?.*)?$"
    path = canonical(F.regexp_extract(clean, pattern, 2))
    return F.nullif(host_of(F.regexp_extract(clean, pattern, 1)), F.lit("")), F.when(path == "", "/").otherwise(path), canonical(F.regexp_extract(clean, pattern, 3))


def expressions(pages: DataFrame, labels: int, folders: int) -> DataFrame:
    """_row, host and path of every expression of every URL, with up to so many last labels and leading folders."""
    host, path, query = parts()
    split = pages.select("_row", host.alias("_host"), path.alias("_path"), query.alias("_query")).filter("_host is not null")
    own = F.split("_host", r"\.")
    most = F.least(F.lit(labels), F.size(own))
    suffixes = F.transform(F.sequence(F.lit(1), most), lambda k: F.array_join(F.slice(own, -k, k), "."))
    hosts = F.when((most < 1) | F.col("_host").rlike(ADDRESS), F.array("_host")).otherwise(F.array_distinct(F.concat(F.array("_host"), suffixes)))
    part = F.split("_path", "/")  # the first is empty
    deep = F.transform(F.sequence(F.lit(1), F.least(F.lit(folders), F.size(part) - 1)), lambda k: F.concat(F.array_join(F.slice(part, 1, k), "/"), F.lit("/")))
    paths = F.array_distinct(F.concat(F.array(F.concat("_path", "_query"), F.col("_path")), deep))
    return split.select("_row", F.explode(hosts).alias("host"), paths.alias("_paths")).select("_row", "host", F.explode("_paths").alias("path"))


def filtered(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, action, rule): every row of pages and the rule that decides."""
    digest = F.sha2(F.concat("host", "path"), 256)
    pages = pages.select("page_id", "url")
    given = C.saved(
        rules.filter("host is not null and path is not null and action is not null")
        .select(host_of(F.col("host")).alias("host"), F.concat(canonical(F.substring_index("path", "?", 1)), F.when(F.instr("path", "?") > 0, canonical(F.regexp_extract("path", r"(\?.*)$", 1))).otherwise("")).alias("path"), "action").distinct()
    )
    known = given.withColumn("_digest", digest).select(F.substring("_digest", 1, 8).alias("_short"), "_digest", F.concat("host", "path").alias("rule"), F.length("host").alias("_h"), F.length("path").alias("_p"), "action")
    deepest = given.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.size(F.split("path", "/")) - 1)).first()
    urls = pages.select("url").filter("url is not null").distinct().select(F.col("url").alias("_row"), "url")
    tried = expressions(urls, max(1, deepest[0] or 1), max(1, deepest[1] or 1)).withColumn("_full", digest).select("_row", "_full", F.substring("_full", 1, 8).alias("_short"))
    hits = tried.join(C.checked_broadcast(known, 200), "_short").filter("_full = _digest")
    best = hits.groupBy("_row").agg(F.max(F.struct("_h", "_p", (F.col("action") == "allow").alias("_allow"), "rule", "action")).alias("_best"))
    return pages.join(best, pages.url == best._row, "left").select("page_id", "url", F.coalesce("_best.action", F.lit("allow")).alias("action"), F.col("_best.rule").alias("rule"))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, action string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"), default_rules(spark))


SQL = (
    "WITH rules(host, path, action) AS (VALUES "
    + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    + r"""), parsed AS (
  SELECT DISTINCT url, rtrim(lower(regexp_extract(clean, p, 1)), '.') AS host, CASE WHEN regexp_extract(clean, p, 2) = '' THEN '/' ELSE regexp_extract(clean, p, 2) END AS path, regexp_extract(clean, p, 3) AS query
  FROM (SELECT url, regexp_replace(trim(url), '#.*$', '') AS clean, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]+)(?::[0-9]*)?(/[^?]*)?(\?.*)?$' AS p FROM pages)
), hits AS (
  SELECT url, r.host || r.path AS rule, r.action,
    row_number() OVER (PARTITION BY url ORDER BY length(r.host) DESC, length(r.path) DESC, r.action) AS nr
  FROM parsed x JOIN rules r
    ON (x.host = r.host OR ends_with(x.host, '.' || r.host))
    AND (r.path = x.path || x.query OR r.path = x.path OR (ends_with(r.path, '/') AND starts_with(x.path || '/', r.path)))
  WHERE x.host <> ''
)
SELECT p.page_id, p.url, coalesce(h.action, 'allow') AS action, h.rule AS rule
FROM pages p LEFT JOIN hits h ON p.url = h.url AND h.nr = 1
"""
)
