"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted by cell, a combination of source, language and topic; the token weights of the cells are raked
to the target share of each source, language and topic in turn; a document's inclusion probability is its cell's raked
weight per token, scaled so that the largest is 1; documents are kept when a hash of their id, read as a number from 0
to 1, is below it. The same id and seed always decide alike, so lost tasks can be run again.

With a budget, a share of all tokens, one small cell can't scale the others down: where that scale keeps less, cells
whose raked tokens exceed what they have are kept whole, and the rest is raked again and scaled until the budget is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, let

DIMS = ("source", "lang", "topic")
#: Target shares of tokens by dimension and value. Values that a table doesn't name share what it leaves of 1.
TARGETS = {"lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.1}, "topic": {"general": 0.88, "legal": 0.035, "contact": 0.03, "tabular": 0.03, "security": 0.02}}
#: They share it by their tokens to this power: below 1 raises what is rare.
ALPHAS = {"source": 0.8, "lang": 0.8, "topic": 1.0}
#: Topics and their terms; a text's topic is the one with most of its terms in the text, the first of several, or general.
TOPICS = {
    "legal": ("licens", "licenc", "copyright", "warrant", "permission", "liab"),
    "security": ("password", "passwd", "secret", "token", "api_key", "apikey", "akia"),
    "contact": ("@", "http://", "https://", "www.", "+1 ("),
    "tabular": (" | ",),
}
ROUNDS = 8
SEED = "mix"
#: The share of all tokens that the pipeline keeps at least. op2 has none: its SQL scales by the largest rate alone.
BUDGET = 0.7
#: Times that cells are set to be kept whole and the rest is raked again; what is over after that is cut by the last scale.
CAP_ROUNDS = 12
#: Up to this many cells, raking is one task without shuffles and the cells are broadcast; they are counted first.
SMALL_CELLS = 20_000


def words_of(text: Column) -> Column:
    """Words of a text, separated by ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda x: x != "")).cast("bigint")


def topic_of(text: Column) -> Column:
    """The topic of TOPICS with most terms in a text, or general."""

    def best(t: Column) -> Column:
        counts = F.array(*(F.struct(sum((t.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(TOPICS.items())))
        return let(F.array_max(counts), lambda m: F.when(m["n"] > 0, m["name"]).otherwise("general"))

    return let(F.lower(F.coalesce(text, F.lit(""))), best)


def labelled(docs: DataFrame, text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """row (a struct of the columns of docs), _source, _lang, _topic (null: '(none)') and _tokens."""
    named = {f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit("(none)")) for d in ("source", "lang")}
    own = named | {"_topic": F.coalesce(topic_of(F.col(text_col)) if topic is None else topic, F.lit("(none)")), "_tokens": words_of(F.col(text_col))}
    return docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in own.items()))


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None, alphas=None, rounds: int = ROUNDS, budget: float | None = None) -> DataFrame:
    """cells(_source, _lang, _topic, tokens) with the targets t_ of each dimension, weight (adds up to 1) and probability (the largest is 1).

    With a budget, probabilities keep that share of the tokens at least, or all tokens that have a weight.

    targets has a dict or a frame (value, share) by dimension (none: TARGETS). Values that it doesn't name share what is
    left of 1 by their tokens to the power alphas; values without tokens get weight 0, and the others' shares are scaled to
    1. Each round scales the weights to each dimension's shares once.
    """
    alphas, targets = ALPHAS | (alphas or {}), TARGETS if targets is None else targets
    cells = cut(cells.groupBy(*(f"_{d}" for d in DIMS)).agg(F.sum("tokens").alias("tokens")))
    small = cells.count() <= SMALL_CELLS
    x = cells = cells.coalesce(1) if small else cells
    for d in DIMS:
        n = cells.groupBy(F.col(f"_{d}").alias("v")).agg(F.sum("tokens").cast("double").alias("n"))
        given = targets.get(d, {})
        if isinstance(given, DataFrame):
            n = n.join(given.select(F.col("value").alias("v"), F.col("share").cast("double").alias("share")), "v", "left")
            rest = 1 - (given.agg(F.sum("share")).first()[0] or 0)
        else:
            n = n.withColumn("share", F.coalesce(*(F.when(F.col("v") == v, float(share)) for v, share in given.items()), F.lit(None).cast("double")))
            rest = 1 - sum(given.values())
        every = Window.partitionBy(F.lit(1))
        p = F.pow("n", F.lit(float(alphas[d])))
        raw = F.when(F.col("n") <= 0, 0.0).when(F.col("share").isNotNull(), F.col("share")).otherwise(F.lit(max(0.0, rest)) * p / F.sum(F.when(F.col("share").isNull(), p)).over(every))
        n = n.withColumn("raw", raw).select("v", F.when(F.sum("raw").over(every) > 0, F.col("raw") / F.sum("raw").over(every)).otherwise(0.0).alias(f"t_{d}"))
        x = x.join(n, F.col(f"_{d}") == F.col("v")).drop("v")
    x = cut(x)
    x = (x.coalesce(1) if small else x).withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in DIMS:
            total = F.sum("weight").over(Window.partitionBy(f"_{d}"))
            x = x.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"t_{d}") / total).otherwise(F.lit(0.0)))
    x = cut(x.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))))
    top, total, able = x.agg(F.max("rate"), F.sum("tokens"), F.sum(F.when(F.col("rate") > 0, F.col("tokens")))).first()
    top = top or 1.0
    plain = F.col("rate") / F.lit(top)
    if budget is not None and able and x.agg(F.sum(F.col("tokens") * plain)).first()[0] < min(budget * total, able):
        x, kept = _calibrated(x, float(min(budget * total, able)), rounds)
        plain = F.least(F.greatest(plain, kept / F.col("tokens")), F.lit(1.0))
    # cells without tokens have nothing to weigh; their documents stay
    return x.withColumn("probability", F.when(F.col("tokens") > 0, plain).otherwise(F.lit(1.0))).select(*(f"_{d}" for d in DIMS), *(f"t_{d}" for d in DIMS), "tokens", "weight", "probability")


def marginals(cells: DataFrame) -> DataFrame:
    """dimension, value, target, raked and expected: the shares of each value asked for, after raking, and of the tokens that sampling is expected to keep; cells is what raked gives."""
    parts = []
    for d in DIMS:
        kept = F.sum(F.col("tokens") * F.col("probability"))
        own = cells.groupBy(F.col(f"_{d}").alias("value")).agg(F.first(f"t_{d}").alias("target"), F.sum("weight").alias("raked"), kept.alias("kept"))
        parts.append(own.select(F.lit(d).alias("dimension"), "value", "target", "raked", (F.col("kept") / F.sum("kept").over(Window.partitionBy(F.lit(1)))).alias("expected")))
    return parts[0].union(parts[1]).union(parts[2])


def _calibrated(x: DataFrame, budget: float, rounds: int) -> tuple[DataFrame, Column]:
    """x(tokens, weight, t_ by dimension) with more columns, and the tokens to keep of each cell, which add up to budget."""
    tokens, kept, full = F.col("tokens").cast("double"), F.col("kept"), F.col("full")
    x = cut(x.withColumn("kept", F.col("weight") * F.lit(budget)).withColumn("full", F.lit(False)))
    for _ in range(CAP_ROUNDS):
        over = ~full & (tokens > 0) & (kept >= tokens)
        if x.where(over).isEmpty():
            break
        x = x.withColumn("full", full | over).withColumn("kept", F.when(full, tokens).otherwise(kept))
        for _ in range(rounds):
            for d in DIMS:
                sum_of = lambda c, d=d: F.sum(F.when(c, kept).otherwise(F.lit(0.0))).over(Window.partitionBy(f"_{d}"))
                left = F.greatest(F.col(f"t_{d}") * F.lit(budget) - sum_of(full), F.lit(0.0))
                x = x.withColumn("kept", F.when(full | (sum_of(~full) <= 0), kept).otherwise(kept * left / sum_of(~full)))
        x = cut(x)
    # the scale of the rest that meets the budget, from below: each step adds cells that it fills
    scale = 0.0
    while True:
        filled = full | (kept * F.lit(scale) >= tokens)
        spent, rest = x.agg(F.sum(F.when(filled, tokens)), F.sum(F.when(~filled, kept))).first()
        better = (budget - (spent or 0.0)) / rest if rest else scale
        if better <= scale * (1 + 1e-12):
            break
        scale = better
    return x, F.when(full, tokens).otherwise(kept * F.lit(scale))


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, targets=None, alphas=None, rounds: int = ROUNDS, seed: str = SEED, budget: float | None = None) -> DataFrame:
    """row (a struct of the columns of docs), _source, _lang, _topic, _tokens, probability and sampled (boolean) of each row.

    A null source, language or topic is the value '(none)'; a null or blank text has no tokens, and adds none to its
    cell; a cell that has no tokens at all is kept whole. Rows with equal ids are decided alike; a null id counts as the
    empty string. Columns of docs stay as they are, inside row. An empty table gives an empty result.
    """
    own = labelled(docs, text_col, topic)
    keys = [f"_{d}" for d in DIMS]
    cells = raked(own.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")), targets, alphas, rounds, budget).select(*keys, "probability")
    if cells.count() <= SMALL_CELLS:
        cells = F.broadcast(cells)
    return own.join(cells, keys).withColumn("sampled", uniform(F.col(f"row.{id_col}"), seed) < F.col("probability"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Sampling decision of each document, for the languages and topics of TARGETS and sources at the power 0.8."""
    m = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), "sampled")


def _sql() -> str:
    t = "lower(coalesce(text, ''))"
    counts = {k: " + ".join(f"cast(contains({t}, '{w}') as int)" for w in words) for k, words in TOPICS.items()}
    most = f"greatest({', '.join(f'n_{k}' for k in TOPICS)})"
    topic = " ".join(f"when n_{k} > 0 and n_{k} = {most} then '{k}'" for k in TOPICS)
    steps = [
        rf"""l0 as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, {', '.join(f'{c} as n_{k}' for k, c in counts.items())},
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens from documents)""",
        f"l as (select doc_id, source, lang, case {topic} else 'general' end as topic, n_tokens from l0)",
        "c as (select source, lang, topic, cast(sum(n_tokens) as bigint) as tokens from l group by all)",
    ]
    for d in DIMS:
        given = TARGETS.get(d, {})
        share = f"case {' '.join(f'when {d} = {v!r} then cast({s!r} as double)' for v, s in given.items())} end" if given else "cast(null as double)"
        steps.append(f"n_{d} as (select {d}, cast(sum(tokens) as double) as n, {share} as share from c group by {d})")
        steps.append(f"s_{d} as (select {d}, case when n <= 0 then 0.0 when share is not null then share else {max(0.0, 1 - sum(given.values()))!r} * pow(n, {float(ALPHAS[d])!r}) / sum(case when share is null then pow(n, {float(ALPHAS[d])!r}) end) over () end as raw from n_{d})")
        steps.append(f"t_{d} as (select {d}, case when sum(raw) over () > 0 then raw / sum(raw) over () else 0.0 end as t_{d} from s_{d})")
    steps.append("w0 as (select c.*, t_source, t_lang, t_topic, cast(tokens as double) as weight from c join t_source using (source) join t_lang using (lang) join t_topic using (topic))")
    n = 0
    for _ in range(ROUNDS):
        for d in DIMS:
            s = f"sum(weight) over (partition by {d})"
            steps.append(f"w{n + 1} as materialized (select * replace (case when {s} > 0 then weight * t_{d} / {s} else 0.0 end as weight) from w{n})")
            n += 1
    steps.append(f"r as (select source, lang, topic, case when tokens > 0 then (weight / tokens) / max(case when tokens > 0 then weight / tokens else 0.0 end) over () else 1.0 end as p from w{n})")
    return f"with {', '.join(steps)} select doc_id, source, lang, topic, n_tokens, round(p, 6) as probability, cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) / {float(16**13)!r} < p as sampled from l join r using (source, lang, topic)"


OP2_SQL = _sql()
