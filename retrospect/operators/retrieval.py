"""Inverted index, BM25 over a table of queries, re-ranking, class pooling, backtests and parameter grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources.scratch import staged

K1, B = 1.2, 0.75
VARIANTS = ("sum", "prevalence", "mean3", "mean3_prev", "count", "count_prev")


def tokenised(chunks: DataFrame, label: str = "terms") -> DataFrame:
    """chunks with their index terms (t) instead of their text, written once for the passes that follow."""
    names = [c for c in chunks.columns if c != "text"]
    return staged(chunks.select(*names, terms(F.col("text")).alias("t")), label)


def postings(tokens: DataFrame) -> DataFrame:
    """chunk_id, length, term, tf from tokenised chunks."""
    rows = tokens.select("chunk_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return rows.groupBy("chunk_id", "length", "term").agg(F.count("*").alias("tf"))


def term_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def bm25(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, score of every chunk of tokenised chunks that shares a term with a query (query_id, text)."""
    shape = tokens.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("average")).first()  # two numbers
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    # Only terms that are asked for are counted and joined: they leave before the rows are grouped.
    rows = tokens.select("chunk_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    index = rows.join(asked.select("term").distinct(), "term", "left_semi").groupBy("chunk_id", "length", "term").agg(F.count("*").alias("tf"))
    wanted = staged(index, "postings")
    weighed = wanted.join(term_frequencies(wanted), "term").withColumn("idf", F.log(1 + (shape["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.greatest(F.lit(shape["average"] or 0.0), F.lit(1e-9))))
    scored = weighed.select("term", "chunk_id", part.alias("part")).join(asked, "term")
    return scored.groupBy("query_id", "chunk_id").agg(F.sum(F.col("part") * (1 + F.log("qf"))).alias("score"))


def bm25_by_class(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """bm25, with chunks of the same terms scored once: copies only count for the statistics and take their class's score."""
    shape = tokens.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("average")).first()  # two numbers
    bag = F.array_sort("t")
    member = staged(tokens.select("chunk_id", F.sha2(F.to_json(F.struct(bag.alias("t"))).cast("binary"), 256).alias("class_id"), bag.alias("t")), "classes")
    classes = member.groupBy("class_id").agg(F.count("*").alias("copies"), F.any_value("t").alias("t"))
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    rows = classes.select("class_id", "copies", F.size("t").alias("length"), F.explode("t").alias("term"))
    index = rows.join(asked.select("term").distinct(), "term", "left_semi").groupBy("class_id", "copies", "length", "term").agg(F.count("*").alias("tf"))
    wanted = staged(index, "class-postings")
    df = wanted.groupBy("term").agg(F.sum("copies").alias("df"))
    weighed = wanted.join(df, "term").withColumn("idf", F.log(1 + (shape["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.greatest(F.lit(shape["average"] or 0.0), F.lit(1e-9))))
    scored = weighed.select("term", "class_id", part.alias("part")).join(asked, "term")
    sums = scored.groupBy("query_id", "class_id").agg(F.sum(F.col("part") * (1 + F.log("qf"))).alias("score"))
    return sums.join(member.select("class_id", "chunk_id"), "class_id").select("query_id", "chunk_id", "score")


def top_hits(scores: DataFrame, k: int, order: Column | None = None, apart: Column | None = None) -> DataFrame:
    """The k best chunks of each query; `apart` leaves pairs out before they are ranked."""
    best = Window.partitionBy("query_id").orderBy((F.col("score") if order is None else order).desc(), "chunk_id")
    left = scores if apart is None else scores.filter(apart)
    return left.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def opposed(tags: Column, pairs: dict[str, str]) -> Column:
    """The labels that contradict an array of labels."""
    both = {**pairs, **{b: a for a, b in pairs.items()}}
    table = F.create_map(*[F.lit(x) for kv in both.items() for x in kv])
    return F.array_compact(F.transform(tags, lambda t: F.try_element_at(table, t)))


def reranked(hits: DataFrame, gamma: float, delta: float, pairs: dict[str, str]) -> DataFrame:
    """hits (score, query_tags, tags) with the score raised by shared labels and lowered by contradicting ones."""
    n = F.size("query_tags")
    shared, against = F.size(F.array_intersect("query_tags", "tags")), F.size(F.array_intersect(opposed(F.col("query_tags"), pairs), "tags"))
    factor = F.when(n > 0, F.greatest(F.lit(0.05), 1 + gamma * shared / n - delta * against / n)).otherwise(1.0)
    return hits.withColumn("score", F.col("score") * factor)


def best_of_parent(hits: DataFrame, *keys: str) -> DataFrame:
    return hits.groupBy("query_id", "parent", *keys).agg(F.max("score").alias("score"))


def class_counts(parents: DataFrame) -> DataFrame:
    """action, class_n: how many parents (parent, action) have each class."""
    return parents.filter("action is not null").groupBy("action").agg(F.count("*").alias("class_n"))


def top_parents(parents: DataFrame, keys: list[str], m: Column) -> DataFrame:
    """The m best parents (score) of each query and keys; all where m is 0."""
    best = Window.partitionBy("query_id", *keys).orderBy(F.round("score", 6).desc(), "parent")  # sums differ in their last digits
    return parents.withColumn("rank", F.row_number().over(best)).filter((m == 0) | (F.col("rank") <= m))


def _raw(variant: str, total: Column, many: Column, best3: Column, n: Column, beta: float) -> Column:
    n = F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))
    return {
        "sum": total, "prevalence": total / n, "mean3": best3 / 3, "mean3_prev": best3 / 3 / F.sqrt(n), "count": many.cast("double"), "count_prev": many / n,
        "fractional": total / F.pow(n, F.lit(beta)),
    }[variant]


def pooled(top: DataFrame, keys: list[str], counts: DataFrame, classes: list[str], variants: tuple[str, ...], beta: float = 0.0, smoothing: float = 0.12) -> DataFrame:
    """query_id, keys, variant and a probability for each class from the top parents (query_id, keys, action, score).

    A class weighs by its sum, number or three best scores, some divided by its number of all parents (or a power beta of it);
    a share of the total is added to each. Parents without a class are passed over.
    """
    known = top.filter("action is not null")
    nth = F.row_number().over(Window.partitionBy("query_id", *keys, "action").orderBy(F.round("score", 6).desc(), "parent"))
    by_class = known.withColumn("nth", nth).groupBy("query_id", *keys, "action").agg(
        F.sum("score").alias("total"), F.count("*").alias("many"), F.sum(F.when(F.col("nth") <= 3, F.col("score")).otherwise(0.0)).alias("best3")
    )
    weighed = by_class.join(F.broadcast(counts.filter(F.col("action").isin(classes))), "action", "left")  # one row a class
    raws = F.array(*[F.struct(F.lit(v).alias("variant"), _raw(v, F.col("total"), F.col("many"), F.col("best3"), F.col("class_n"), beta).alias("raw")) for v in variants])
    each = weighed.withColumn("v", F.explode(raws)).select("query_id", *keys, "action", "v.variant", "v.raw")
    sums = each.groupBy("query_id", *keys, "variant").agg(*[F.coalesce(F.sum(F.when(F.col("action") == c, F.col("raw"))), F.lit(0.0)).alias(f"s_{c}") for c in classes])
    total = reduce(lambda a, b: a + b, [F.col(f"s_{c}") for c in classes])
    share = smoothing * F.when(total == 0, 1.0).otherwise(total)
    return sums.select("query_id", *keys, "variant", *[((F.col(f"s_{c}") + share) / (total + len(classes) * share)).alias(c.lower()) for c in classes])


def arg_max_class(probabilities: DataFrame, classes: list[str]) -> DataFrame:
    """The class with the largest probability (to nine digits); the first of them on a tie."""
    rounded = {c: F.round(c.lower(), 9) for c in classes}
    top = F.greatest(*rounded.values())
    choice = reduce(lambda other, c: F.when(rounded[c] == top, c).otherwise(other), reversed(classes), F.lit(None).cast("string"))
    return probabilities.withColumn("predicted", choice)


def backtest_report(said: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """keys, n, accuracy, balanced from rows (keys, actual, predicted): balanced accuracy is the mean recall over all classes."""
    hit = F.col("actual") == F.col("predicted")
    recall = [F.coalesce(F.try_divide(F.count_if(hit & (F.col("actual") == c)), F.count_if(F.col("actual") == c)), F.lit(0.0)) for c in classes]
    measures = [F.count("*").alias("n"), (F.count_if(hit) / F.count("*")).alias("accuracy"), (reduce(lambda a, b: a + b, recall) / len(classes)).alias("balanced")]
    return said.groupBy(*keys).agg(*measures)


def parameter_grid(hits: DataFrame, parents: DataFrame, counts: DataFrame, classes: list[str], ks: list[int], ms: list[int], variants: tuple[str, ...]) -> DataFrame:
    """query_id, k, m, variant, predicted for every setting, from one retrieval: hits (query_id, rank, parent, score)."""
    by_k = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rank") <= F.col("k"))
    best = best_of_parent(by_k, "k").join(parents.select("parent", "action"), "parent", "left")
    top = top_parents(best.withColumn("m", F.explode(F.array(*[F.lit(m) for m in ms]))), ["k", "m"], F.col("m"))
    return arg_max_class(pooled(top, ["k", "m"], counts, classes, variants), classes).select("query_id", "k", "m", "variant", "predicted")


#: What a scenario's numbers say, the first rule of a group that holds; bounds on level and momentum.
PHRASES = {
    "cpi": [
        (">=", 3.5, "inflation remains elevated well above the Committee's 2 percent longer-run objective, price pressures are broad based, upside risks to inflation, inflation expectations"),
        (">=", 2.5, "inflation remains somewhat elevated relative to the Committee's 2 percent objective, inflation has moderated but remains above goal"),
        (">=", 1.6, "inflation is running close to the Committee's 2 percent longer-run objective, price stability"),
        ("<", 1.6, "inflation has continued to run below the Committee's longer-run objective, disinflation, subdued price pressures, inflation compensation declined"),
    ],
    "u": [
        (">=", 6.5, "unemployment rate is elevated, substantial slack, underutilization of labor resources, weak labor market conditions"),
        (">=", 5, "unemployment rate remains somewhat above its longer-run normal level, labor market slack remains"),
        ("<", 5, "unemployment rate is low, labor market conditions remain tight, maximum employment"),
    ],
    "du": [
        (">=", 0.5, "unemployment rate has moved up notably, job gains have slowed, deterioration in labor market conditions, rising layoffs"),
        (">=", 0.2, "unemployment rate has edged up, job gains have moderated"),
        ("<=", -0.3, "unemployment rate has declined further, labor market has strengthened"),
    ],
    "pay": [
        ("<=", -0.5, "payroll employment has declined, job losses, contraction in economic activity, recession"),
        ("<=", 0.5, "job gains have slowed, employment growth has been modest"),
        (">=", 2, "job gains have been strong, robust payroll growth, solid expansion"),
    ],
    "spread": [
        (">=", 4.5, "severe strains in financial markets, credit markets are not functioning normally, extraordinary liquidity measures, acute financial market stress, sharply wider risk spreads, impaired credit availability for households and businesses"),
        (">=", 3.2, "strains in financial markets, credit spreads have widened substantially, tighter credit conditions, financial market stress, disruptions in credit markets"),
        (">=", 2.3, "credit spreads have widened somewhat, financial conditions have tightened"),
        ("<", 2.3, "financial conditions remain accommodative, credit spreads are narrow, risk appetite"),
    ],
    "curve": [
        ("<=", -0.3, "the yield curve is inverted, market participants expect policy easing, term premium, restrictive policy stance"),
        (">=", 1.5, "the yield curve has steepened, longer-term yields have risen"),
    ],
    "mid": [
        (">=", 2.753099173553719, "the current stance of monetary policy is restrictive, policy is well into restrictive territory, cumulative tightening"),
        ("<=", 0.5, "the federal funds rate is at the effective lower bound, policy accommodation, balance sheet"),
    ],
    "cpi_3m": [
        ("<=", -0.8, "inflationary pressures have started to moderate, energy and other commodity prices have declined markedly, inflation expectations are diminishing, the upside risks to price stability have diminished, the Committee expects inflation to moderate in coming quarters"),
        ("<=", -0.3, "inflation has moderated somewhat in recent months, price pressures have eased"),
        (">=", 0.8, "inflation has picked up sharply, price pressures have intensified and broadened, upside risks to inflation have increased"),
        (">=", 0.3, "inflation has moved up in recent months"),
    ],
    "spread_3m": [
        (">=", 1.0, "the intensification of financial market turmoil, strains in financial markets have increased significantly, conditions in financial markets have deteriorated, disruptions in credit markets are likely to exert additional restraint on spending, downside risks to growth have increased"),
        (">=", 0.4, "financial conditions have tightened somewhat, credit spreads have widened in recent months"),
        ("<=", -0.6, "strains in financial markets have eased, functioning of credit markets has improved, financial conditions have become more supportive"),
    ],
    "u_3m": [
        (">=", 0.4, "labor market conditions have deteriorated rapidly, job losses have mounted, payroll employment has declined further"),
        ("<=", -0.3, "labor market conditions have improved further, the unemployment rate has declined in recent months"),
    ],
}
#: Labels of a scenario and the conditions for each.
SCENARIO_TAGS = {
    "infl_high": "cpi >= 2.5", "infl_low": "cpi < 1.6", "labor_tight": "u < 5 and du <= 0.2", "labor_soft": "du >= 0.3 or pay <= 0", "growth_weak": "pay <= -0.5",
    "growth_solid": "pay >= 1.0", "fin_stress": "spread >= 2.6", "infl_moderating": "cpi_3m <= -0.5", "infl_accelerating": "cpi_3m >= 0.5",
    "stress_intensifying": "spread_3m >= 0.8", "stress_easing": "spread_3m <= -0.6", "labor_deteriorating": "u_3m >= 0.4",
}
MOMENTUM = ("cpi_3m", "spread_3m", "u_3m")


def scenario_text() -> Column:
    """The words for a row of scenario numbers."""
    parts = []
    for name, rules in PHRASES.items():
        said = F.lit(None).cast("string")
        for sign, bound, words in reversed(rules):
            holds = F.expr(f"{name} {sign} {bound}D")
            said = F.when(holds, words).otherwise(said)
        parts.append(said)
    return F.concat_ws(" ", *parts)


def scenario_tags() -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(tag)) for tag, rule in SCENARIO_TAGS.items()]))


def ordered_logit(model: dict) -> list[Column]:
    """Probabilities of cut, hold and hike from stored features, means, scales, coefficients and two cutpoints."""
    eta = reduce(lambda a, b: a + b, [(F.col(f) - F.lit(float(model["means"][f]))) / F.lit(float(model["scales"][f])) * F.lit(float(model["coefficients"][f])) for f in model["features"]])
    low, high = (1 / (1 + F.exp(eta - F.lit(float(c)))) for c in model["cutpoints"])
    return [low, high - low, 1 - high]


def blended_choice(p: list[Column], q: list[Column], weight: float, classes: list[str]) -> Column:
    """The class with the largest geometric blend of two distributions; the first on a tie."""
    raw = [F.round(F.pow(a, F.lit(1 - weight)) * F.pow(b, F.lit(weight)), 9) for a, b in zip(p, q, strict=True)]
    top = F.greatest(*raw)
    return reduce(lambda other, x: F.when(x[1] == top, x[0]).otherwise(other), reversed(list(zip(classes, raw, strict=True))), F.lit(None).cast("string"))


def scenario_evaluation(
    scenarios: DataFrame, tokens: DataFrame, records: DataFrame, model: dict, classes: list[str], pairs: dict[str, str],
    k: int = 400, m: int = 8, gamma: float = 0.0, delta: float = 1.5, weight: float = 0.45,
) -> DataFrame:
    """query_id, momentum, predicted, truth, hit, analogs for scenarios (query_id, truth, numbers) with and without momentum.

    records: chunk_id, parent, action, tags. A scenario's words retrieve chunks, parents are re-ranked by labels, their
    classes pooled and blended with the stored model's probabilities. Scenarios of the same words and labels are asked once,
    chunks of the same terms are scored once; every scenario and every chunk takes part.
    """
    both = scenarios.withColumn("momentum", F.explode(F.array(F.lit(True), F.lit(False))))
    numbered = both.withColumns({c: F.when(F.col("momentum"), F.col(c)).otherwise(0.0) for c in MOMENTUM})
    named = numbered.withColumn("scenario", F.col("query_id")).withColumn("query_id", F.concat_ws("|", F.col("query_id").cast("string"), F.col("momentum").cast("string")))
    said = named.withColumns({"text": scenario_text(), "query_tags": scenario_tags()})
    asked = staged(said.withColumn("asked_id", F.sha2(F.to_json(F.struct("text", "query_tags")).cast("binary"), 256)), "scenarios")
    alike = staged(asked.groupBy(F.col("asked_id").alias("query_id")).agg(F.any_value("text").alias("text"), F.any_value("query_tags").alias("query_tags")), "asked")
    hits = top_hits(bm25_by_class(tokens, alike.select("query_id", "text")), k, F.round("score", 6))
    found = best_of_parent(hits.join(records, "chunk_id").filter("action is not null"), "action", "tags").join(alike.select("query_id", "query_tags"), "query_id")
    top = staged(top_parents(reranked(found, gamma, delta, pairs), [], F.lit(m)), "analogs")
    p = pooled(top, [], class_counts(records), classes, ("sum",))
    analogs = top.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "parent"))), lambda x: x["parent"]).alias("analogs"))
    even = [F.coalesce(F.col(c.lower()), F.lit(1.0 / len(classes))) for c in classes]
    judged = asked.withColumn("query_id", F.col("asked_id")).join(p, "query_id", "left").join(analogs, "query_id", "left").withColumn("predicted", blended_choice(ordered_logit(model), even, weight, classes))
    return judged.select(F.col("scenario").alias("query_id"), "momentum", "predicted", "truth", (F.col("predicted") == F.col("truth")).alias("hit"), F.coalesce("analogs", F.array().cast("array<bigint>")).alias("analogs"))
