"""Quality rules as a bitmask ledger, in DataFrame functions only.

Each document is measured once and every rule is evaluated once; its failure sets a bit of `failures`. A policy is a
version with a mask of rules: it keeps a document when failures & mask = 0. Policies and ablations (what a rule
removes alone, what it would save if dropped) are then bitwise expressions over the ledger, without the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let


@dataclass(frozen=True)
class Rule:
    """fails is a SQL predicate over the measurements."""

    name: str
    fails: str


#: Bit k belongs to rule k; new rules are appended, so that old ledgers stay readable.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length_low", "n_words > 0 and word_chars < 3 * n_words"),
    Rule("word_length_high", "word_chars > 12 * n_words"),
    Rule("bullets", "n_lines > 0 and 100 * n_bullet_lines > 90 * n_lines"),
    Rule("ellipses", "n_lines > 0 and 100 * n_ellipsis_lines > 30 * n_lines"),
)
#: Version and the names of the rules that it applies.
POLICIES = {
    "v1": ("too_few_words", "repeated_trigrams"),
    "v2": ("too_few_words", "repeated_trigrams", "symbols", "duplicate_lines"),
    "v3": tuple(r.name for r in RULES),
}


def mask(names, rules=RULES) -> int:
    """The bits of the named rules."""
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more."""
    windows = F.slice(F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]))
        return F.array_sort(F.transform(twice, lambda e: e["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def ordered(w: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(w, lambda e: e["h"])))
        return F.when(distinct == F.size(w), F.lit(0).cast("bigint")).otherwise(let(let(F.array_sort(w), places), covered))

    return let(windows, ordered)


def _of_words(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        _repeat_words(words).alias("n_repeat_words"),
    )


def _of_lines(lines: Column) -> Column:
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("bigint")
    return F.struct(
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        count(rf"^[{SPACE}]*[-*•]").alias("n_bullet_lines"),
        count(rf"(\.\.\.|…)[{SPACE}]*$").alias("n_ellipsis_lines"),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each row of docs; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = let(F.split(text, rf"[{SPACE}]+"), lambda w: F.filter(w, lambda x: x != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    m = docs.select(
        F.col(id_col).alias("doc_id"),
        let(words, _of_words).alias("w"),
        let(lines, _of_lines).alias("l"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
    )
    return m.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "l.n_bullet_lines", "l.n_ellipsis_lines")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The measurements and failures (bigint, bit k set if rule k fails) of each row of docs.

    Null and empty texts have 0 for every measurement, so only rules that zeros fail apply. Rows are judged one by
    one: repeated rows give repeated rows, a null id stays null, other columns are ignored, no rows give no rows.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, r in enumerate(rules)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured(docs, id_col, text_col).withColumn("failures", failures)


def verdicts(led: DataFrame, policies=None, rules=RULES) -> DataFrame:
    """The ledger with a boolean keep_<version> for each policy."""
    policies = POLICIES if policies is None else policies
    return led.withColumns({f"keep_{v}": F.col("failures").bitwiseAND(F.lit(mask(names, rules))) == 0 for v, names in policies.items()})


def ablations(led: DataFrame, policies=None, rules=RULES) -> DataFrame:
    """One row a policy and rule of it: removed by the policy, failing the rule, failing it alone, kept if it were dropped.

    One pass: the ledger is first counted by its distinct bitmasks, of which there are at most 2 ** len(rules).
    """
    policies = POLICIES if policies is None else policies
    counts = led.groupBy("failures").agg(F.count("*").alias("n"))
    each = [F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.lit(mask(names, rules)).cast("bigint").alias("p"), F.lit(mask([name], rules)).cast("bigint").alias("r")) for v, names in policies.items() for name in names]
    x = counts.select("failures", "n", F.explode(F.array(*each)).alias("x")).select("failures", "n", "x.*")
    total = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0).cast("bigint"))
    return x.groupBy("policy", "rule").agg(
        total(F.expr("failures & p <> 0")).alias("n_removed"),
        total(F.expr("failures & r <> 0")).alias("n_failing"),
        total(F.expr("failures & p = r")).alias("n_alone"),
        total(F.expr("failures & (p & ~r) = 0")).alias("n_kept_without"),
    )


#: The policy that the query applies beside the base rules.
POLICY = "v2"


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents, with the base verdict and the one of policy v2."""
    led = verdicts(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failures",
        (F.col("failures").bitwiseAND(F.lit(mask(POLICIES["v1"]))) != 0).alias("base_failed"), F.col(f"keep_{POLICY}").alias("kept"),
    )


OP5_SQL = r"""
with m as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from m),
h as (select doc_id, i, [w[i], w[i + 1], w[i + 2]] as g from g),
p as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from h) where n > 1),
r as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from p) group by doc_id),
s as (
  select m.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(len(l) as bigint) as n_lines,
         cast(len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) as bigint) as n_bullet_lines,
         cast(len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as bigint) as n_ellipsis_lines
  from m left join r using (doc_id)),
f as (select *, cast(FAILURES as bigint) as failures from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures, failures & BASE <> 0 as base_failed, failures & POLICY = 0 as kept from f
""".replace("FAILURES", " + ".join(f"case when {r.fails} then {1 << k} else 0 end" for k, r in enumerate(RULES))).replace("BASE", str(mask(POLICIES["v1"]))).replace("POLICY", str(mask(POLICIES[POLICY])))


def quality_rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of each policy does over all documents, and what would be kept without it."""
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_EACH = ", ".join(f"('{v}', '{name}', {mask(names)}, {mask([name])})" for v, names in POLICIES.items() for name in names)
_COUNT = "cast(count(*) filter (where {}) as bigint)"
ABLATIONS_SQL = f"""
with o as ({OP5_SQL}), k(policy, rule, p, r) as (values {_EACH})
select policy, rule, {_COUNT.format('(failures & p) <> 0')} as n_removed, {_COUNT.format('(failures & r) <> 0')} as n_failing, {_COUNT.format('(failures & p) = r')} as n_alone,
  {_COUNT.format('(failures & (p & ~r)) = 0')} as n_kept_without from o cross join k group by policy, rule
"""
