"""URL filter with rules indexed by their rarest literal token (operator 2).

A rule is a regular expression for the host and one for the path, with literal tokens
(runs of letters and digits) that any fitting url contains. Each rule is filed under that
one of its tokens which the urls at hand contain least often, counted over all of them.
The tokens of a url fetch candidate rules by an equi-join; only for these the regular
expressions run. The best rule is aggregated by (host, path) before the shuffle and joined
back, so repeated urls cost one row and a hot host none of its rows gathered.

Long urls are read whole. Nulls: a null url, or one without "://", has empty host and path and fits no rule. Ties
between rules go to the greater rank, then length, then text. Repeated rows stay repeated;
an empty table gives no rows; other columns (also ones named like results) are ignored,
except the key columns that the caller names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import lower_ascii

#: Rules up to this number are sent to every executor; more are joined by a shuffle.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class UrlRule:
    """name; verdict; Java patterns for host and path; tokens as "h:net" or "p:en";
    rank and length decide between rules that fit."""

    name: str
    verdict: str
    host: str
    path: str
    tokens: tuple[str, ...]
    rank: int = 0
    length: int = 0


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def host_rule(text: str, verdict: str) -> UrlRule:
    """A rule such as example.net/en/: the host and its subdomains, paths that start with
    the rest; * in the path stands for anything. A path token counts only where the rule
    itself ends it on both sides."""
    host, _, path = text.partition("/")
    pieces = ("/" + path).split("*")
    tokens = {f"h:{t}" for t in re.findall("[a-z0-9]+", host)}
    for piece in pieces:
        tokens |= {f"p:{t}" for t in re.findall("(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", piece)}
    return UrlRule(text, verdict, rf"(?s)^(.*\.)?{_quoted(host)}\z", "(?s)^" + ".*".join(map(_quoted, pieces)), tuple(sorted(tokens)), 1, len(text))


def word_rule(text: str, verdict: str) -> UrlRule:
    """A rule for hosts of which neighbouring parts between dots, dashes and the like are the
    words of text."""
    words = text.split(" ")
    between = "[^a-z0-9]+".join(words)
    return UrlRule(f"word:{text}", verdict, rf"(?s)^(.*[^a-z0-9])?{between}([^a-z0-9].*)?\z", "", tuple(sorted(f"h:{w}" for w in words)), 0, len(text))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens, marked by where they stand."""
    def of(c: Column, mark: str) -> Column:
        return F.transform(F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda t: t != ""), lambda t: F.concat(F.lit(mark), t))

    return F.array_distinct(F.concat(of(host, "h:"), of(path, "p:")))


def rule_index(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """The rules, each under the token of its own that fewest urls (host, path) contain."""
    if bad := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token: {bad}")
    spark = urls.sparkSession
    fields = "token string, name string, verdict string, host_re string, path_re string, rank int, length int"
    filed = spark.createDataFrame([(t, r.name, r.verdict, r.host, r.path, r.rank, r.length) for r in rules for t in r.tokens], fields)
    few = len(rules) <= BROADCAST_RULES
    own = filed.select("token").distinct()
    seen = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    seen = seen.join(F.broadcast(own) if few else own, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    counted = filed.join(seen, "token", "left").fillna(0, ["urls"])
    rarest = counted.groupBy("name").agg(F.min_by(F.struct(*filed.columns), F.struct("urls", "token")).alias("r")).select("r.*")
    return F.broadcast(rarest) if few else rarest


def judge_urls(pages: DataFrame, rules: list[UrlRule], keys: tuple[str, ...] = ("page_id",), url: str = "url", default: str = "allow") -> DataFrame:
    """keys, host, path, fitted (name of the best rule or null), rank of it, verdict."""
    host, path = url_parts(F.col(url))
    parts = pages.select(*keys, host.alias("host"), path.alias("path"))
    index = rule_index(parts, rules)
    fetched = parts.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(index, "token")
    fits = fetched.filter(F.rlike("host", F.col("host_re")) & F.rlike("path", F.col("path_re")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("rank", "length", "name", "verdict")).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        *keys,
        "host",
        "path",
        F.col("best.name").alias("fitted"),
        F.col("best.rank").alias("rank"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
