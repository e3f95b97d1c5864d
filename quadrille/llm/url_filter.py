"""URL rules, indexed by their rarest literal token.

A rule is ``(action, pattern)`` with the pattern ``host/path``: it fits the host and its subdomains if the path starts
with the rule's path. A blocked word (``words``) blocks a URL that has it as a whole token, unless a rule decides. All
of them become regular expressions; each is filed under the one of its literal tokens that is rarest in the URLs, a
URL's tokens fetch the candidate expressions, and only those run.

A token is a run of ASCII letters, digits and non-ASCII characters. A pattern's token can index it only where the
pattern itself ends the token: the last word of ``/en/1`` may go on, so it can't. A rule without such a token is tried
on every URL. What no rule fits gets ``default``, or is blocked by a word; there are no words unless the caller gives them.

At most ``max_rules`` rules are broadcast at a time (a documented bound of memory). More rules are judged in several
passes over the URLs, each with a part of them, and the longest of the passes' rules decides: the same result.

Defined results: null URLs and URLs without ``://`` have an empty host and path, fit no rule and get ``default``;
very long URLs are read whole; of rules of equal length that fit, the one whose action and then pattern sorts last
decides; repeated URLs each get their own row; extra columns are kept, and one that has the output's name is replaced.
"""

import re
from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.arrow import shielded, with_kernel

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict", "word")])

_TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_URL = re.compile(r"\A.*?://([^/?#]*)([^?#]*)", re.S)
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.match(url) if url is not None else None
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def literal_tokens(pattern: str) -> set[str]:
    """The tokens that every URL which fits the rule has as whole tokens."""
    host, _, path = pattern.partition("/")
    whole = [*_TOKEN.findall(host), *(m[0] for m in _TOKEN.finditer("/" + path) if m.end() <= len(path))]
    return set(whole)


class Index:
    """Rules and blocked words by their rarest token."""

    def __init__(self, rules: Sequence[tuple[str, str]], words: Iterable[str], counts: dict[str, int], default: str):
        self.default, self.by_token, self.always = default, defaultdict(list), []
        for action, pattern in sorted(set(rules)):
            host, _, path = pattern.partition("/")
            entry = (len(pattern), action, pattern, re.compile(rf"(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}"))
            tokens = sorted(literal_tokens(pattern), key=lambda t: (counts.get(t, 0), t))
            (self.by_token[tokens[0]] if tokens else self.always).append(entry)
        for word in sorted(set(words)):
            self.by_token[word].append((0, "block", word, re.compile(rf".*?(?<![0-9A-Za-z\u0080-\U0010ffff]){re.escape(word)}(?![0-9A-Za-z\u0080-\U0010ffff])", re.S)))

    def judge(self, url: str | None) -> tuple:
        host, path = split_url(url)
        target, best, word = host + path, None, None
        for entry in (e for group in (self.always, *(self.by_token.get(t, ()) for t in set(_TOKEN.findall(target)))) for e in group):
            if entry[3].match(target):
                if not entry[0]:
                    word = min(word or entry[2], entry[2])
                elif best is None or (entry[0], entry[1], entry[2]) > (best[0], best[1], best[2]):
                    best = entry
        verdict = best[1] if best else "block" if word else self.default
        return host, path, best and best[2], verdict, word


def token_counts(urls: DataFrame, column: str, tokens: Iterable[str]) -> dict[str, int]:
    """URLs by token, over all rows, for the rules' own tokens: as many groups as rules have tokens."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    found = F.array_intersect(F.split(F.col(f"`{column}`").cast("string"), "[^0-9A-Za-z\\x{80}-\\x{10ffff}]+"), F.array(*map(F.lit, wanted)))
    return {r[0]: r[1] for r in urls.select(F.explode(found).alias("token")).groupBy("token").count().collect()}


@shielded("url")
def url_filter(urls: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, words: Iterable[str] = (), default: str = "allow", url: str = "url", out: str = "judged", keep=None, max_rules: int = 200_000) -> DataFrame:
    """``urls`` and a struct ``out``: host, path, rule (the longest that fits), verdict, word (a blocked word it has)."""
    rules, names = sorted(set(rules)), [c for c in (keep if keep is not None else urls.columns) if c != out]
    parts = [rules[i : i + max_rules] for i in range(0, len(rules), max_rules)] or [[]]
    found, made = urls, [f"__part{i}" for i in range(len(parts))]
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        columns = [*names, *made[:i], *([] if last or url in names else [url])]
        found = _judged(found, part, tuple(words) if not i else (), default, url, made[i], columns, counted=urls)
    length = lambda p: F.coalesce(F.length(f"{p}.rule"), F.lit(-1))
    ranked = [F.struct(length(p).alias("n"), F.col(f"{p}.verdict").alias("verdict"), F.col(f"{p}.rule").alias("rule")) for p in made]
    best, first = F.greatest(*ranked) if len(ranked) > 1 else ranked[0], made[0]
    verdict = F.when(best["n"] >= 0, best["verdict"]).otherwise(F.when(F.col(f"{first}.word").isNotNull(), "block").otherwise(default))
    return found.select(*(F.col(f"`{c}`") for c in names), F.struct(F.col(f"{first}.host").alias("host"), F.col(f"{first}.path").alias("path"), best["rule"].alias("rule"), verdict.alias("verdict"), F.col(f"{first}.word").alias("word")).alias(out))


def _judged(urls: DataFrame, rules: Sequence[tuple[str, str]], words: Sequence[str], default: str, url: str, out: str, keep: list[str], *, counted: DataFrame) -> DataFrame:
    counts = token_counts(counted, url, {t for _, p in rules for t in literal_tokens(p)})
    shared = urls.sparkSession.sparkContext.broadcast((tuple(rules), words, counts, default))

    def start():
        index = Index(*shared.value)
        return lambda column: [index.judge(u) for u in column.to_pylist()]

    return with_kernel(urls, url, out, RESULT, start, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), out="j", keep=["page_id"])
    return found.select("page_id", "j.host", "j.path", "j.rule", "j.verdict")


_RULE_ROWS = ", ".join(f"('{a}', '{p.partition('/')[0]}', '/{p.partition('/')[2]}')" for a, p in RULES)
ORACLE = f"""
WITH split AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(action, rule_host, rule_path) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT n, max_by(action, length(rule_host) + length(rule_path)) AS action, max_by(rule_host || rule_path, length(rule_host) + length(rule_path)) AS rule
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, rule,
  coalesce(action, 'allow') AS verdict
FROM split LEFT JOIN fits USING (n)
"""
