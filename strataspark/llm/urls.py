"""URL filter by a tree of path templates.

A url's path is cut into segments, and segments that name one thing (numbers, dates, digests, ids) become wildcards at
once, so that a host's urls fold into few raw paths before anything is shuffled. The tree of a host grows level by level:
under a node, a word stays as a branch if it has a fair share of the node's pages and is a wildcard else; branches whose
children and labels differ no more than chance allows are merged. Each path of the tree is a template; it is rejected
where the share of bad pages among its labelled ones, smoothed towards that of all pages, is high. Given rules come first.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import stored


@dataclass(frozen=True)
class Rule:
    """verdict for the urls of host and its subdomains whose path begins with path; the longest name wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Parts of a host's name that make its pages examples of bad ones, where no rule decides them.
BAD_WORDS = ("adult", "ads", "bet", "bets", "casino", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
#: Segments of a path; the last holds all that follow.
DEPTH = 8
#: A word stays a branch with this share of its node's pages and so many pages; a node so has 50 word branches at most.
MIN_SHARE, MIN_PAGES = 0.02, 4
#: Segments of more characters are wildcards.
LONG = 64
#: Pages that the prior counts as; the prior is the bad share of all labelled pages, MAX_PRIOR at most.
PRIOR_PAGES, MAX_PRIOR = 4.0, 0.5
#: Smoothed share of bad pages from which a template is rejected.
REJECT = 0.8
#: Normal quantile of the merge test, for a level of 0.05: six bad pages stay apart from one without a label.
Z = 1.645
#: The wildcards, as (name, pattern), the first that matches; words of any other kind are <other>.
SHAPES = (
    ("<end>", "^$"), ("<long>", f"^(?s).{{{LONG + 1},}}$"), ("<num>", "^[0-9]+$"), ("<date>", "^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), ("<num.ext>", r"^[0-9]+\.[A-Za-z0-9]{1,5}$"),
    ("<uuid>", "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), ("<hex>", "^(?=.*[0-9])[0-9A-Fa-f]{8,}$"), ("<id>", "^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]+$"),
    ("<word>", "^[A-Za-z]+$"), ("<slug>", "^[A-Za-z]+([_-][A-Za-z]+)+$"), ("<word.ext>", r"^[A-Za-z_-]+\.[A-Za-z0-9]{1,5}$"),
)
_NAMES = (*(n for n, _ in SHAPES), "<other>")
#: Shapes that may be branches of their own, by their text.
WORDS = ("<word>", "<slug>", "<word.ext>", "<other>")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for urls without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    none = F.lit("")
    return F.when(at > 0, host).otherwise(none), F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(none)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _shape(segment: Column) -> Column:
    out = F.lit(_NAMES[-1])
    for name, pattern in reversed(SHAPES):
        out = F.when(segment.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _general(token: Column) -> Column:
    """The wildcard of a token: words begin with =, wildcards are their own."""
    return F.when(token.startswith("="), _shape(F.substring(token, 2, F.length(token)))).otherwise(token)


def raw_path(path: Column) -> Column:
    """The path as tokens with a / between: wildcards, and words with = in front."""
    shape = lambda s: F.when(_shape(s).isin(*WORDS), F.concat(F.lit("="), s)).otherwise(_shape(s))
    segments = F.when(path.startswith("/"), F.split(F.substring(path, 2, F.length(path)), "/", DEPTH)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.transform(segments, shape), "/")


def _differ(a: list[int], b: list[int]) -> bool:
    """Whether two rows of counts differ by the likelihood ratio test at the level of Z."""
    na, nb = sum(a), sum(b)
    g, kinds = 0.0, 0
    for x, y in zip(a, b, strict=True):
        if x + y:
            kinds += 1
            g += sum(2 * o * log(o * (na + nb) / (n * (x + y))) for o, n in ((x, na), (y, nb)) if o)
    df = kinds - 1
    return df > 0 and g > df * (1 - 2 / (9 * df) + Z * (2 / (9 * df)) ** 0.5) ** 3


def merged_branches(names: list[str], counts: list[list[int]]) -> list[str]:
    """The branch of each name under one node: those that don't differ are one, named by its members.

    counts are bad, good and unlabelled pages and then the pages by the next segment's wildcard. Branches are taken with the
    most pages first (then by name), and each joins the first earlier one that it doesn't differ from. Wildcards and words are
    not merged with each other.
    """
    groups: list[tuple[list[str], list[int]]] = []
    for n, c in sorted(zip(names, counts, strict=True), key=lambda p: (-sum(p[1][:3]), p[0])):
        for members, total in groups:
            if members[0][0] == n[0] == "=" and not _differ(total[:3], c[:3]) and not _differ(total[3:], c[3:]):
                members.append(n)
                total[:] = map(int.__add__, total, c)
                break
        else:
            groups.append(([n], list(c)))
    label = {n: "=" + "|".join(sorted(m[1:] for m in members)) if len(members) > 1 else n for members, _ in groups for n in members}
    return [label[n] for n in names]


@F.pandas_udf(ArrayType(StringType()))
def _merged(names: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series([merged_branches(list(n), [[int(x) for x in c] for c in cs]) for n, cs in zip(names, counts, strict=True)])


def templates(raw: DataFrame) -> DataFrame:
    """host, raw, template, n, bad, good of raw(host, raw, n, bad, good): what each raw path became in its host's tree."""
    tokens = F.when(F.col("raw") == "", F.array().cast("array<string>")).otherwise(F.split("raw", "/", DEPTH))
    t = stored(raw.withColumn("tokens", tokens).withColumn("node", F.lit("")))
    sums = ["bad", "good", "none", *(f"s{k}" for k in range(len(_NAMES) + 1))]
    for d in range(t.agg(F.max(F.size("tokens"))).first()[0] or 0):
        here = t.where(F.size("tokens") > d).withColumn("token", F.col("tokens")[d]).withColumn("general", _general(F.col("token")))
        after = F.coalesce(_general(F.get("tokens", F.lit(d + 1))), F.lit(""))
        kinds = [F.sum(F.when(after == x, F.col("n")).otherwise(0)).alias(f"s{k}") for k, x in enumerate(("", *_NAMES))]
        child = here.groupBy("host", "node", "token", "general").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum(F.col("n") - F.col("bad") - F.col("good")).alias("none"), *kinds)
        total = here.groupBy("host", "node").agg(F.sum("n").alias("total"))
        fair = (F.col("n") >= F.lit(MIN_SHARE) * F.col("total")) & (F.col("n") >= MIN_PAGES)
        child = child.join(total, ["host", "node"]).withColumn("branch", F.when(fair, F.col("token")).otherwise(F.col("general")))
        child = child.groupBy("host", "node", "branch").agg(*(F.sum(c).alias(c) for c in sums))
        # MIN_SHARE bounds the branches of a node
        nodes = child.groupBy("host", "node").agg(F.collect_list("branch").alias("branches"), F.collect_list(F.array(*sums)).alias("counts"))
        nodes = stored(nodes.select("host", "node", F.map_from_arrays("branches", _merged("branches", "counts")).alias("to")))
        name = F.coalesce(F.col("to")[F.col("tokens")[d]], F.col("to")[_general(F.col("tokens")[d])])
        moved = t.join(nodes, ["host", "node"], "left").withColumn("node", F.when(F.size("tokens") > d, F.concat("node", F.lit("/"), name)).otherwise(F.col("node")))
        t = stored(moved.drop("to"))
    return t.select("host", "raw", F.col("node").alias("template"), "n", "bad", "good")


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, label: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, n_labelled, purity of each page.

    label is a column of pages: 1 for bad pages, 0 for good ones, null for others; by default the rules' verdicts, and bad for other
    pages of hosts with one of BAD_WORDS in their name. verdict is the rule's, else block where purity is REJECT or more, else allow.
    purity is (bad + PRIOR_PAGES * prior) / (labelled + PRIOR_PAGES) of the page's template. Null urls and urls without :// have an
    empty host, path and template; so they are allowed unless their labelled ones are bad. Repeated rows and null ids are judged each.
    Urls of any length are judged whole: what follows the first seven segments counts as the eighth, long segments as wildcards. Ties of
    branches go by name. Other columns are ignored; an empty table gives an empty result.
    """
    host, path = host_path(F.col(url_col))
    given = F.lit(None).cast("int") if label is None else label.cast("int")
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), given.alias("label"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", "label", name.alias("rule"), verdict.alias("by_rule"), raw_path(F.col("path")).alias("raw"))
    if label is None:
        seed = F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*map(F.lit, BAD_WORDS)))
        known = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0).when(seed, 1)
    else:
        known = F.col("label")
    raw = base.groupBy("host", "raw").agg(F.count("*").alias("n"), F.sum(F.when(known == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(known == 0, 1).otherwise(0)).alias("good"))
    tree = stored(templates(raw))
    # the prior depends on a single row of sums
    prior = tree.agg(F.least(F.lit(MAX_PRIOR), F.coalesce(F.try_divide(F.sum("bad"), F.sum(F.col("bad") + F.col("good"))), F.lit(0.0))).alias("prior")).first()[0]
    leaf = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("n_labelled"))
    leaf = leaf.withColumn("purity", (F.col("bad") + PRIOR_PAGES * prior) / (F.col("n_labelled") + PRIOR_PAGES))
    found = tree.select("host", "raw", "template").join(leaf.drop("bad"), ["host", "template"])
    out = base.join(found, ["host", "raw"], "left")
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "template", "n_labelled", "purity")


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    """A verdict for each page's url."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
