"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names the literal tokens that any URL it matches must hold. Token
counts over the whole table pick the rarest of them, and the rule is indexed
there. A URL's tokens fetch candidate rules through a join; only candidates run
their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, UPPER, quoted

#: (action, host and path) of the path rules: fixed values.
PATH_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: (literal tokens, pattern) of the method's own rules; a match blocks.
PATTERNS = (
    (("casino",), r"[./-]casino[./-]"),
    (("poker",), r"[./-]poker[./-]"),
    (("porn",), r"[./-]porn[./-]"),
    (("viagra",), r"[./-]viagra[./-]"),
    (("warez",), r"[./-]warez[./-]"),
    (("phpsessid",), r"[?&;]phpsessid="),
    (("wp", "login", "php"), r"/wp-login\.php"),
    (("cgi", "bin"), r"/cgi-bin/"),
    (("doubleclick", "net"), r"^[a-z]+://([^/?#]*\.)?doubleclick\.net([/?#]|$)"),
    (("exe",), r"\.exe([?#]|$)"),
)

#: An index of so many rules is sent to every task; a larger one is joined by its tokens.
MAX_BROADCAST = 100_000


@dataclass(frozen=True)
class Rule:
    name: str | None
    action: str
    tokens: tuple[str, ...]
    pattern: str
    #: longer rules win; patterns of the method come after all path rules
    rank: int


def path_rule(action: str, text: str) -> Rule:
    """A rule for a host, its subdomains and the paths that start with its path."""
    host, _, path = text.partition("/")
    whole = re.split(r"[^a-z0-9]+", host) + re.split(r"[^a-z0-9]+", path.lower())[:-1]
    pattern = r"^([^/]*\.)?" + re.escape(host) + re.escape("/" + path)
    return Rule(text, action, tuple(sorted({t for t in whole if t})), pattern, len(text))


def default_rules() -> list[Rule]:
    return [path_rule(*r) for r in PATH_RULES] + [Rule(None, "block", t, p, 0) for t, p in PATTERNS]


def parts(urls: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``; both empty for a null url and one without ``://``."""
    pick = lambda k: F.coalesce(F.regexp_extract("url", "://([^/?#]*)([^?#]*)", k), F.lit(""))
    return urls.withColumns({"host": F.translate(pick(1), UPPER, LOWER), "path": pick(2)})


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    The longest path rule that fits decides; ties cannot be, as equal texts are
    one rule. Without one, the verdict is the method's: block if one of its
    patterns matches the A-Z lower-cased url or the host is empty (so for null
    urls), else allow. A rule that names no token is tried on every url. Equal
    urls are judged once; repeated rows each give a row, and other columns are
    ignored.
    """
    rules = default_rules() if rules is None else rules
    sent = F.broadcast if len(rules) <= MAX_BROADCAST else (lambda df: df)
    spark = pages.sparkSession
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = parts(rows.filter("url is not null").select("url").distinct())
    urls = urls.withColumns({"low": F.translate("url", UPPER, LOWER), "place": F.concat("host", "path")})
    # every url has the empty token, for rules that name none
    tokens = F.array_distinct(F.concat(F.split("low", "[^a-z0-9]+"), F.array(F.lit(""))))
    found = urls.withColumn("token", F.explode(tokens))

    every = sorted({t for r in rules for t in r.tokens})
    known = spark.createDataFrame([(t,) for t in every], "token string")
    counts = {r.token: r.n for r in found.join(sent(known), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    index = spark.createDataFrame(
        [(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), r.name, r.action, r.pattern, r.rank) for r in rules],
        "token string, rule string, action string, pattern string, rank int",
    )
    at = F.when(F.col("rule").isNull(), F.col("low")).otherwise(F.col("place"))
    candidates = found.join(sent(index), "token")
    matched = candidates.filter(F.regexp(at, F.col("pattern")))
    best = matched.groupBy("url").agg(F.max(F.struct("rank", "rule", "action")).alias("best"))
    # null urls match nothing and need no join, which would bring them all to one task
    nulls = parts(rows.filter("url is null")).withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    return (
        parts(rows.filter("url is not null"))
        .join(best, "url", "left")
        .unionByName(nulls)
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.when(F.col("host") == "", "block").otherwise("allow")).alias("verdict"),
        )
    )


def duckdb_sql() -> str:
    """The same verdicts in DuckDB SQL over ``pages``, each rule tried on each url."""
    longest = sorted(PATH_RULES, key=lambda r: -len(r[1]))
    fits = {t: f"regexp_matches(host || path, {quoted(path_rule(a, t).pattern)})" for a, t in longest}
    rule = "CASE " + " ".join(f"WHEN {fits[t]} THEN {quoted(t)}" for _, t in longest) + " END"
    action = "CASE rule " + " ".join(f"WHEN {quoted(t)} THEN {quoted(a)}" for a, t in longest)
    bad = " OR ".join(f"regexp_matches(low, {quoted(p)})" for _, p in PATTERNS)
    return f"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r AS (SELECT *, {rule} AS rule FROM u)
SELECT page_id, host, path, rule,
       {action} ELSE CASE WHEN {bad} OR host = '' THEN 'block' ELSE 'allow' END END AS verdict
FROM r"""
