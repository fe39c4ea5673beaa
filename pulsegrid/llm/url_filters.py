"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression with literal tokens that any URL it fits must hold. How often the rules' tokens occur is
counted over all URLs, and each rule is filed under its rarest one. A URL's tokens fetch its candidate rules, and only
those run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, Tables, pick, table

TOKEN = re.compile(r"[a-z0-9]+")
#: Rules that one pass takes to every task; more rules make more passes.
RULES_PER_PASS = 50_000


@dataclass(frozen=True)
class Rule:
    """name: what a match reports; verdict: allow or block; regex: searched in what `on` names; tokens: literals that a match needs.

    Of the host rules that fit, the longest wins, and any host rule comes before pattern rules.
    """

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    host_rule: bool = False


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule such as example.com/en/: its host and all subdomains, for paths that start with the rule's."""
    host, _, path = rule.partition("/")
    whole = [m[0].lower() for m in re.finditer(r"[A-Za-z0-9]+", rule) if m.end() < len(rule)]  # the last may go on in the URL
    return Rule(rule, verdict, rf"^([^/]*\.)?{re.escape(host.lower())}{re.escape('/' + path)}", tuple(dict.fromkeys(whole)), host_rule=True)


def word_rule(verdict: str, words: str) -> Rule:
    """A rule that fits where these words, joined by the same signs, stand by themselves in a lower-cased URL."""
    return Rule(f"word:{words}", verdict, rf"(^|[^a-z0-9]){re.escape(words)}($|[^a-z0-9])", tuple(TOKEN.findall(words)))


def read_rules(path: str) -> tuple[Rule, ...]:
    """Rules of a file: lines `block host/path`, `allow host/path`, or `block word:cheap-pills`. Empty lines and those that start with # are left out."""
    out = []
    with open(path, encoding="utf-8") as file:
        for number, line in enumerate(file, 1):
            parts = line.split()
            if not parts or parts[0].startswith("#"):
                continue
            if len(parts) != 2 or parts[0] not in ("allow", "block") or not ("/" in parts[1] or parts[1].startswith("word:")):
                raise ValueError(f"{path}, line {number}: {line.strip()!r} is no rule")
            verdict, rule = parts
            out.append(word_rule(verdict, rule[5:].lower()) if rule.startswith("word:") else host_rule(verdict, rule))
    return tuple(out)


#: The host rules that the query op7 has to apply.
HOST_RULES = tuple(host_rule(*x) for x in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")))
#: For URLs that no host rule fits.
PATTERN_RULES = tuple(word_rule("block", w) for w in ("cheap-pills", "pills", "casino", "viagra", "porn", "xxx", "warez", "jackpot", "free-money"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Without `://`, or for null, both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def token_counts(urls: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """In how many URLs each of these tokens occurs, over all rows; at most as many counts come back as there are tokens."""
    if not tokens:
        return {}
    own = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)"), F.lit(1)))
    # the rules' tokens, which go to every task with the rules themselves; all others end there
    wanted = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in tokens], "wanted string"))
    rows = urls.select(F.explode(own).alias("token")).join(wanted, F.col("token") == F.col("wanted")).groupBy("token").count()
    return {r["token"]: r["count"] for r in rows.collect()}


class RuleIndex:
    def __init__(self, rules: Sequence[tuple[int, Rule]], counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always = []
        for rank, rule in rules:
            entry = (rank, re.compile(rule.regex), rule)
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def match(self, url: str, place: str) -> tuple | None:
        """The best rule that fits: host rules first, longest first, then pattern rules in their order."""
        lowered, best = url.lower(), None
        candidates = [e for t in set(TOKEN.findall(lowered)) for e in self.by_token.get(t, ())]
        for rank, regex, rule in (*candidates, *self.always):
            if regex.search(place if rule.host_rule else lowered):
                key = (not rule.host_rule, -len(rule.name) if rule.host_rule else 0, rank)
                if best is None or key < best[0]:
                    best = (key, rule)
        return best


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = HOST_RULES + PATTERN_RULES, rules_per_pass: int = RULES_PER_PASS) -> DataFrame:
    """Judge every URL: page_id, host, path, rule, verdict, pattern.

    rule is the longest host rule that fits, or null; verdict is its verdict, else that of the first pattern rule that
    fits (named in pattern), else allow. A null URL, or one without `://`, has an empty host and path, but its text still
    meets the pattern rules. One row for each input row, null and repeated ids included; other columns are ignored.

    One small aggregation counts the rules' tokens; the URLs themselves are never shuffled. More than rules_per_pass rules
    make several passes, each of which is written before the next one starts.
    """
    host, path = split_url(F.col("url"))
    rows = pick(pages, "page_id", "url")
    counts = token_counts(rows, sorted({t for r in rules for t in r.tokens}))
    spark = pages.sparkSession
    schema = "page_id long, url string, host string, path string, is_host boolean, length int, rank int, rule string, verdict string"
    out = rows.select("page_id", "url", host.alias("host"), path.alias("path"), *(F.lit(None).cast(t).alias(n) for n, t in (("is_host", "boolean"), ("length", "int"), ("rank", "int"), ("rule", "string"), ("verdict", "string"))))
    ranked = list(enumerate(rules))
    tables, written = Tables(spark, "url-filter"), None
    for a in range(0, len(ranked), rules_per_pass):
        index = Shared(spark, (ranked[a : a + rules_per_pass], counts))
        out = out.mapInArrow(_pass(index), schema)
        if a + rules_per_pass < len(ranked):
            out, before = tables.write(out), written
            written = out
            if before is not None:
                tables.drop(before)
    found, is_host = F.col("rule").isNotNull(), F.coalesce("is_host", F.lit(False))
    return out.select(
        "page_id",
        "host",
        "path",
        F.when(is_host, F.col("rule")).alias("rule"),
        F.when(found, F.col("verdict")).otherwise("allow").alias("verdict"),
        F.when(found & ~is_host, F.col("rule")).alias("pattern"),
    )


def _pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or RuleIndex(*shared.value)
            best = []
            columns = [batch.column(i).to_pylist() for i in range(1, 9)]
            for url, host, path, is_host, length, rank, rule, verdict in zip(*columns, strict=True):
                old = None if rule is None else ((not is_host, -length if is_host else 0, rank), (is_host, length, rank, rule, verdict))
                if m := index.match(url or "", host + path):
                    key, r = m
                    if old is None or key < old[0]:
                        old = (key, (r.host_rule, len(r.name), key[2], r.name, r.verdict))
                best.append(old[1] if old else (None,) * 5)
            kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            new = [pa.array([b[i] for b in best], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *new], batch.schema.names)

    return run


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    host_cases = "\n    ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r.name}'"
        for r in sorted(HOST_RULES, key=lambda r: -len(r.name))
        for h, _, p in [r.name.partition("/")]
    )
    verdicts = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in HOST_RULES)
    words = "\n    ".join(f"WHEN regexp_matches(lower(coalesce(url, '')), '{r.regex}') THEN '{r.name}'" for r in PATTERN_RULES)
    return f"""
WITH r AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM r),
p AS (
  SELECT page_id, url, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h),
m AS (
  SELECT *, CASE
    {host_cases}
    ELSE NULL END AS rule, CASE
    {words}
    ELSE NULL END AS word FROM p)
SELECT page_id, host, path, rule,
       CASE rule {verdicts} ELSE CASE WHEN word IS NULL THEN 'allow' ELSE 'block' END END AS verdict,
       CASE WHEN rule IS NULL THEN word END AS pattern
FROM m
"""


OP7_SQL = _sql()
