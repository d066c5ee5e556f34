"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that any URL it fits must contain. Each rule is
filed under the one of its tokens that the fewest URLs of the table hold. A URL's tokens fetch the rules
filed under them, and only those run their expressions. Rules without a literal token run always.

Verdict: of the host and path rules that fit, the one with the longest text decides; without one, the
first fitting pattern rule does (a block before an allow); without that, the URL is allowed.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no host rule, but
pattern rules still see its text. Rows may repeat and ids may be null; each row is judged by itself.
Very long URLs are read whole. Of rules of equal length that fit, and of patterns, the first listed decides.
An empty table gives no rows. Columns other than the id and the URL are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import pick, table

_UPPER = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class UrlRule:
    action: str
    name: str
    pattern: str
    tokens: tuple[str, ...]
    #: Host and path rules win over pattern rules, the longest first.
    length: int = 0


def host_rule(action: str, rule: str) -> UrlRule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, slash, path = rule.partition("/")
    path = slash + path
    pattern = rf"(?s)\A(?:(?!://).)*://(?:[^/?#]*\.)?(?ai:{re.escape(host)})(?=[/?#]|\Z)" + (rf"(?=[^?#]*){re.escape(path)}" if path else "")
    whole = path if re.search(r"[^A-Za-z0-9]\Z", path) else re.sub(r"[A-Za-z0-9]*\Z", "", path)  # the last token may go on in the URL
    return UrlRule(action, rule, pattern, tuple(dict.fromkeys(_TOKEN.findall((host + whole).translate(_UPPER)))), len(rule))


#: The rules asked for, and the method's own for hosts that farm links.
HOST_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
PATTERN_RULES = (
    UrlRule("block", "pills", r"(?i)://[^/?#]*\bcheap-pills\b", ("cheap", "pills")),
    UrlRule("block", "farm", r"(?i)://[^/?#]*\bspam-farm\b", ("spam", "farm")),
    UrlRule("block", "casino", r"(?i)://[^/?#]*\bcasino\b", ("casino",)),
    UrlRule("block", "adult", r"(?i)[/.]xxx[/.]", ("xxx",)),
    UrlRule("block", "session", r"(?i)[?&;](?:phpsessid|jsessionid|sid)=[0-9a-f]{16,}", ()),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(_UPPER), m[2]


def default_rules() -> tuple[UrlRule, ...]:
    return tuple(host_rule(*x) for x in HOST_RULES) + PATTERN_RULES


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands. Only these tokens are counted: the result is as small as the rules."""
    found = F.array_intersect(F.split(F.lower("url"), "[^a-z0-9]+"), F.array(*map(F.lit, tokens)))
    rows = urls.where(F.col("url").isNotNull()).select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(tokens, 0) | {r["token"]: r["count"] for r in rows}


def index_rules(rules: tuple[UrlRule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token to rules, and the rules that have no token."""
    index: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def judge(url: str | None, rules, compiled, index, always) -> tuple[str | None, str, str | None]:
    """rule, verdict, pattern."""
    text = url or ""
    candidates = set(always)
    for token in set(_TOKEN.findall(text.translate(_UPPER))):
        candidates.update(index.get(token, ()))
    fits = [rules[i] for i in sorted(candidates) if compiled[i].search(text)]
    if hosts := [r for r in fits if r.length]:
        best = max(hosts, key=lambda r: r.length)
        return best.name, best.action, None
    if fits:
        best = min(fits, key=lambda r: r.action != "block")
        return None, best.action, best.name
    return None, "allow", None


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of every row of ``pages``."""
    rules = default_rules() if rules is None else rules
    pages = pick(pages, page_id=id_col, url=url_col)
    tokens = sorted({t for r in rules for t in r.tokens})
    index, always = index_rules(rules, token_counts(pages, tokens) if tokens else {})
    names = ("page_id", "host", "path", "rule", "verdict", "pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            urls = batch.column("url").to_pylist()
            rows = [(*split_url(u), *judge(u, rules, compiled, index, always)) for u in urls]
            columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], list(names))

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS p FROM pages
), r AS (
  SELECT page_id, url, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), j AS (
  SELECT page_id, url, host, path,
         CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
         CASE WHEN regexp_matches(url, '(?i)://[^/?#]*\bcheap-pills\b') THEN 'pills'
              WHEN regexp_matches(url, '(?i)://[^/?#]*\bspam-farm\b') THEN 'farm'
              WHEN regexp_matches(url, '(?i)://[^/?#]*\bcasino\b') THEN 'casino'
              WHEN regexp_matches(url, '(?i)[/.]xxx[/.]') THEN 'adult'
              WHEN regexp_matches(url, '(?i)[?&;](?:phpsessid|jsessionid|sid)=[0-9a-f]{16,}') THEN 'session' END AS pattern
  FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM j
"""
