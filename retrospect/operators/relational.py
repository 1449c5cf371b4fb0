"""Filters, constraints, joins, aggregates, set operations and rankings over decision records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join


def manifest_filter(documents: DataFrame, cutoff: Column, allowed: list[str]) -> DataFrame:
    """documents with the reason that excludes them: usage is tested before lateness."""
    reason = F.when(~F.col("usage").isin(allowed), "USAGE").when(F.col("published") > cutoff, "LATE")
    return documents.withColumn("excluded", reason)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rule, key of every row that breaks a rule; a rule that is null is not broken."""
    broken = F.array_compact(F.array(*[F.when(~condition, F.lit(name)) for name, condition in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), F.col(key).alias("key"))


def key_audit(child: DataFrame, child_key: list[str], parent: DataFrame, foreign: str, parent_key: str) -> DataFrame:
    """problem, n: duplicate keys of the child, and its rows without a parent."""
    twice = child.groupBy(*child_key).count().filter("count > 1").agg(F.count("*").alias("n"))
    orphans = child.join(parent.select(F.col(parent_key).alias(foreign)), foreign, "left_anti").agg(F.count("*").alias("n"))
    return twice.select(F.lit("DUPLICATE_KEY").alias("problem"), "n").unionByName(orphans.select(F.lit("ORPHAN").alias("problem"), "n"))


def interval_faults(episodes: DataFrame) -> DataFrame:
    """Episodes (start, end) that begin on or before the end of the one before, or end before they start."""
    order = Window.orderBy("start", "end", "name")  # a spec table of a few rows
    return episodes.withColumn("previous_end", F.lag("end").over(order)).filter((F.col("start") <= F.col("previous_end")) | (F.col("end") < F.col("start")))


def inside_any(rows: DataFrame, at: str, episodes: list[tuple[str, str]]) -> DataFrame:
    flag = reduce(lambda a, b: a | b, [F.col(at).between(F.lit(x).cast("date"), F.lit(y).cast("date")) for x, y in episodes])
    return rows.withColumn("constrained", flag)


def official_host(url: Column, hosts: list[str]) -> Column:
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#:]+)", 1))
    return reduce(lambda a, b: a | b, [(host == h) | host.endswith("." + h) for h in hosts])


def pattern_hits(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text holds."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def round_tallies(votes: DataFrame) -> DataFrame:
    return votes.groupBy("meeting", "round").agg(F.count_if(~F.col("dissent")).alias("votes_for"), F.count_if(F.col("dissent")).alias("votes_against"))


def count_histogram(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """How many parents have how many children, parents without any included."""
    counted = parents.select(key).join(children.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    return counted.groupBy(F.coalesce("n", F.lit(0)).alias("n_children")).agg(F.count("*").alias("n_parents"))


def member_profiles(votes: DataFrame, events: int = 6) -> DataFrame:
    """Votes, dissents, first and last meeting, and the newest dissents of each member."""
    newest = F.slice(F.sort_array(F.collect_list(F.when(F.col("dissent"), F.col("meeting"))), asc=False), 1, events)
    return votes.groupBy("participant").agg(
        F.count("*").alias("n_votes"), F.count_if("dissent").alias("n_dissents"),
        F.min("meeting").alias("first_meeting"), F.max("meeting").alias("last_meeting"), newest.alias("newest_dissents"),
    )


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def coverage(expected: DataFrame, found: DataFrame, group: str, member: str) -> DataFrame:
    """Missing and extra members of each group."""
    sets = lambda x, name: x.groupBy(group).agg(F.collect_set(member).alias(name))
    both = sets(expected, "want").join(sets(found, "have"), group, "full_outer")
    empty = F.array().cast("array<bigint>")
    want, have = F.coalesce("want", empty), F.coalesce("have", empty)
    return both.select(group, F.sort_array(F.array_except(want, have)).alias("missing"), F.sort_array(F.array_except(have, want)).alias("extra"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of rows missing on a side, with another version, and with another value."""
    a = before.select(*keys, F.col("version").alias("v0"), F.col("value").alias("x0"), F.lit(True).alias("in0"))
    b = after.select(*keys, F.col("version").alias("v1"), F.col("value").alias("x1"), F.lit(True).alias("in1"))
    both = F.col("in0").isNotNull() & F.col("in1").isNotNull()
    return a.join(b, keys, "full_outer").agg(
        F.count_if(F.col("in1").isNull()).alias("missing_after"), F.count_if(F.col("in0").isNull()).alias("missing_before"),
        F.count_if(both & ~F.col("v0").eqNullSafe(F.col("v1"))).alias("version_changed"),
        F.count_if(both & ~F.col("x0").eqNullSafe(F.col("x1"))).alias("value_changed"),
    )


def resolved_names(labels: DataFrame, people: DataFrame) -> DataFrame:
    """labels (label) with the person (id, name): by whole name, else by a surname that one person has."""
    exact = people.select(F.col("id").alias("exact_id"), F.col("name").alias("label"))
    surname = lambda c: F.element_at(F.split(c, "[ #]"), -1)
    unique = people.groupBy(surname(F.col("name")).alias("surname")).agg(F.min("id").alias("surname_id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    joined = labels.join(exact, "label", "left").withColumn("surname", surname(F.col("label"))).join(unique, "surname", "left")
    return joined.select("label", F.coalesce("exact_id", "surname_id").alias("id"))


def mentions(texts: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """text id with up to `most` ids of names (id, surname) whose surname is a word of the text; the first id wins a shared surname."""
    first = names.groupBy("surname").agg(F.min("id").alias("id"))
    words = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("surname"))
    found = words.join(first, "surname").groupBy("text_id").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return found.select("text_id", F.slice("ids", 1, most).alias("ids"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def top_then_top(rows: DataFrame, group: list[str], newest: list[Column], first_n: int, keep: Column, order: list[Column], n: int) -> DataFrame:
    """The first_n newest of a group, of those that pass `keep` the n first in another order."""
    recent = top_per_group(rows, group, newest, first_n).drop("rank").filter(keep)
    return top_per_group(recent, group, order, n)


def plurality(rows: DataFrame, group: str, choice: str) -> DataFrame:
    """The most frequent choice of a group; ties to the alphabetically first."""
    counts = rows.groupBy(group, choice).agg(F.count("*").alias("n"))
    return top_per_group(counts, [group], [F.col("n").desc(), F.col(choice)], 1).drop("rank")


def exact_quantiles(rows: DataFrame, group: str, value: str, probabilities: list[float]) -> DataFrame:
    """group, probability, quantile: linearly interpolated quantiles at position (n - 1) * p.

    Equal values are counted first and ranked by running counts, so no task holds the values of a group in memory.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("many"))
    order = Window.partitionBy(group).orderBy(value)
    ranked = counts.select(
        group, F.col(value).cast("double").alias("value"), F.sum("many").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        F.lead(value).over(order).cast("double").alias("next"), F.sum("many").over(Window.partitionBy(group)).alias("n"), "many",
    )
    asked = ranked.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    place = F.col("probability") * (F.col("n") - 1)
    low = F.floor(place)
    part = place - low
    held = asked.filter((low >= F.col("upto") - F.col("many")) & (low < F.col("upto")))
    step = F.when((low + 1 < F.col("upto")) | F.col("next").isNull(), 0.0).otherwise(F.col("next") - F.col("value"))
    return held.select(group, "probability", (F.col("value") + part * step).alias("quantile"))


def newest_before(documents: DataFrame, cutoffs: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The n documents last published before each cutoff, by day and then `order`, with their rank.

    A day keeps its first n documents, and counts for the cutoffs until n later days with documents have passed.
    """
    daily = top_per_group(documents, ["published"], order, n).drop("rank")
    days = daily.select("published").distinct()
    until = F.date_add(F.lead("published", n).over(Window.orderBy("published")), 1)  # one row a day of the calendar
    spans = days.select("published", F.date_add("published", 1).alias("from_day"), until.alias("to_day"))
    shown = interval_join(spans, cutoffs, "from_day", "to_day", "cutoff").drop("from_day", "to_day")
    return top_per_group(daily.join(shown, "published"), ["meeting_id"], [F.col("published").desc(), *order], n)


def standardised(rows: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation; no row where the deviation is not positive."""
    return rows.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation")).filter("deviation > 0")
