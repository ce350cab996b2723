"""URL filters: pattern rules, each found through its rarest literal token.

A rule is a pattern over the canonical string ``host + path``. Tokens that every
matching URL must contain whole are read off the pattern; the rule is filed under
the one that is rarest in the corpus. A URL's own tokens fetch the rules filed
under them, and only those run their regular expression; the longest that fits
decides. Rules without any whole token are filed under the empty token, which
every URL has.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no
rule and gets the default verdict; a very long URL is judged whole; repeated rows are
judged alike; other columns of the table, whatever their names, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import counted

#: Rule sets up to this size go into the plan as a literal map from token to rules;
#: larger ones are joined as a table.
MAX_INLINE_RULES = 512
DEFAULT_VERDICT = "allow"
TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``host`` with its subdomains and a path prefix; kind "name": a host with a label ``host``; kind "glob":
    host and path, each from start to end, where ``*`` stands for anything (in the host: within a label)."""

    verdict: str
    host: str
    path: str = ""
    kind: str = "site"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        if self.kind == "name":
            return rf"^([^/]*\.)?{re.escape(self.host)}(\.[^/]*)?(/|$)"
        if self.kind == "glob":
            parts = lambda glob, any_: any_.join(map(re.escape, glob.split("*")))
            return rf"(?s)^{parts(self.host, '[^./]*')}{parts(self.path, '.*')}$"
        return rf"^([^/]*\.)?{re.escape(self.host)}" + (re.escape(self.path) if self.path else "(/|$)")

    @property
    def tokens(self) -> list[str]:
        """Tokens that stand whole in every URL that fits: one at the end of a path prefix or beside a ``*`` may go on."""
        found = []
        for part, open_end in ((self.host, False), (self.path, self.kind == "site")):
            for m in re.finditer(TOKEN, part):
                beside = part[max(m.start() - 1, 0) : m.start()] + part[m.end() : m.end() + 1]
                if not (open_end and m.end() == len(part)) and "*" not in beside:
                    found.append(m[0])
        return found


#: The rules of the site list.
SITE_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Host labels that only spam sites carry; they decide where no site rule fits.
NAME_RULES = tuple(Rule("block", name, kind="name") for name in ("cheap-pills", "spam-farm", "casino", "free-download", "adserver", "tracker"))


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(sites: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many URLs have each of the rules' tokens; ``sites`` has host and path."""
    seen = F.array_intersect(F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN), F.lit(0)), F.array(*[F.lit(t) for t in tokens]))
    return {r["token"]: r["n"] for r in sites.select(F.explode(seen).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token (ties: the token itself)."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(rule)
    return index


def _own_tokens(subject: Column) -> Column:
    """A URL's distinct tokens, and the empty one."""
    return F.array_union(F.array(F.lit("")), F.regexp_extract_all(subject, F.lit(TOKEN), F.lit(0)))


def _decide(candidates: Column) -> Column:
    """Of candidate structs (site, size, rule, verdict, pattern): the best that fits ``subject``, or null."""
    fitting = F.filter(candidates, lambda r: F.regexp_like(F.col("subject"), r["pattern"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["site"].alias("site"), r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _struct(rule: Rule) -> Column:
    return F.struct(F.lit(int(rule.kind != "name")).alias("site"), F.lit(len(rule.text)).alias("size"), F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + NAME_RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict and n_candidates for every row.

    ``rule`` names the site rule that decided; where a name rule or the default
    verdict did, it is null.
    """
    host, path = canonical(F.col(url))
    sites = pages.select(*keep, host.alias("host"), path.alias("path"))
    counts = token_counts(sites, sorted({t for r in rules for t in r.tokens}) or [""])
    index = build_index(rules, counts)
    subject = F.concat("host", "path")
    if len(rules) <= MAX_INLINE_RULES:
        table = F.create_map(*[c for t, found in sorted(index.items()) for c in (F.lit(t), F.array(*[_struct(r) for r in found]))])
        fetched = F.flatten(F.filter(F.transform(_own_tokens(subject), lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull()))
        judged = sites.withColumn("subject", subject).withColumn("candidates", fetched)
    else:
        judged = _fetched_by_join(sites.withColumn("subject", subject), index)
    best = judged.withColumn("best", _decide(F.col("candidates")))
    site = F.col("best.site") == 1
    return best.select(*keep, "host", "path", F.when(site, F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"), F.size("candidates").cast("long").alias("n_candidates"))


def _fetched_by_join(sites: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """The same candidates where the rules are a table: joined on the token, once per distinct subject."""
    spark = sites.sparkSession
    rows = [(t, int(r.kind != "name"), len(r.text), r.text, r.verdict, r.pattern) for t, found in index.items() for r in found]
    filed = spark.createDataFrame(rows, "token string, site int, size int, rule string, verdict string, pattern string")
    tokens = sites.select("subject").distinct().select("subject", F.explode(_own_tokens(F.col("subject"))).alias("token"))
    fetched = tokens.join(counted(filed), "token").groupBy("subject").agg(F.collect_list(F.struct("site", "size", "rule", "verdict", "pattern")).alias("candidates"))
    empty = F.array().cast("array<struct<site:int,size:int,rule:string,verdict:string,pattern:string>>")
    return sites.join(fetched, "subject", "left").withColumn("candidates", F.coalesce("candidates", empty))
