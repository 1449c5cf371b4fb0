"""Point-in-time operators: what was visible when, as-of and interval joins, change points, runs and prior history.

Versions are rows (keys, observation_date, realtime_start, realtime_end, value). A version is visible at a cutoff if its
observation and its version date lie on or before it and its value is not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import carried, interval_join
from .ranges import RANGE, ranged, with_earlier


def visible(versions: DataFrame, cutoff: Column) -> DataFrame:
    return versions.filter((F.col("observation_date") <= cutoff) & (F.col("realtime_start") <= cutoff) & F.col("value").isNotNull())


def _retired(newest: DataFrame, limits: dict[str, int], default: int) -> DataFrame:
    """newest with retired_on: the day by which as many later observations of the series are visible as its limit keeps."""
    shown = newest.groupBy("series_id", "observation_date").agg(F.min("shown_on").alias("shown_on"))
    order = Window.partitionBy("series_id").orderBy("observation_date")
    retired = F.lit(None).cast("date")
    by_limit: dict[int, list[str]] = {}
    for series, n in limits.items():
        by_limit.setdefault(n, []).append(series)
    for n in {default, *by_limit}:
        later = order.rowsBetween(1, n)
        gone = F.when(F.count("shown_on").over(later) == n, F.max("shown_on").over(later))
        own = F.col("series_id").isin(by_limit[n]) if n in by_limit else F.lit(False)
        retired = F.when(own | (~F.col("series_id").isin(list(limits)) if n == default else F.lit(False)), gone).otherwise(retired)
    return newest.join(shown.select("series_id", "observation_date", retired.alias("retired_on")), ["series_id", "observation_date"])


def visible_versions(versions: DataFrame, cutoffs: DataFrame, limits: dict[str, int] | None = None, default: int | None = None) -> DataFrame:
    """meeting_id, cutoff, keys, observation_date and its newest visible version, for all cutoffs in one job.

    Versions are reduced to intervals of the time they are newest before they meet the cutoffs, so every
    (cutoff, observation) pair is made once. With limits, an observation's interval also ends when as many later ones
    are visible, so that a cutoff meets few more than it keeps.
    """
    chain = Window.partitionBy("series_id", "observation_date").orderBy("realtime_start")
    newest = versions.filter(F.col("value").isNotNull()).select(
        "series_id", "observation_date", "realtime_start", "value",
        F.greatest("observation_date", "realtime_start").alias("shown_on"), F.lead("realtime_start").over(chain).alias("replaced_on"),
    )
    if default is not None:
        newest = _retired(newest, limits or {}, default).withColumn("replaced_on", F.least("replaced_on", "retired_on"))
    found = interval_join(newest, cutoffs, "shown_on", "replaced_on", "cutoff")
    return found.select("meeting_id", "cutoff", "series_id", "observation_date", "realtime_start", "value")


def snapshot(versions: DataFrame, cutoffs: DataFrame, limits: dict[str, int], default: int) -> DataFrame:
    """The newest `limits[series]` observation dates visible at each cutoff, each with its newest visible version."""
    limit = F.lit(default)
    for series, n in limits.items():
        limit = F.when(F.col("series_id") == series, n).otherwise(limit)
    newest = Window.partitionBy("meeting_id", "series_id").orderBy(F.col("observation_date").desc())
    ranked = visible_versions(versions, cutoffs, limits, default).withColumn("rank", F.row_number().over(newest))
    return ranked.filter(F.col("rank") <= limit).drop("rank")


def as_of_join(versions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The newest visible observation (then version) of each series at each cutoff, by interval join and aggregate."""
    best = F.max_by(F.struct("observation_date", "realtime_start", "value"), F.struct("observation_date", "realtime_start"))
    return visible_versions(versions, cutoffs, {}, 1).groupBy("meeting_id", "cutoff", "series_id").agg(best.alias("v")).select("meeting_id", "cutoff", "series_id", "v.*")


def as_of_union(versions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The same rows by one time order of versions and cutoffs, the last best observation carried on."""
    seen = visible(versions, F.lit("9999-12-31").cast("date")).select(
        "series_id",
        F.greatest("observation_date", "realtime_start").alias("at"),
        F.lit(0).alias("kind"),
        F.struct("observation_date", "realtime_start", "value").alias("best"),
        F.lit(None).cast("string").alias("meeting_id"),
    )
    # A series is asked from its first visible version on only: cutoffs before it have no row.
    begun = seen.groupBy("series_id").agg(F.min("at").alias("first_day")).withColumn("no_end", F.lit(None).cast("date"))
    asked = interval_join(begun, cutoffs, "first_day", "no_end", "cutoff").select(
        "series_id", F.col("cutoff").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(seen.schema["best"].dataType).alias("best"), "meeting_id"
    )
    along = carried(seen.unionByName(asked), ["series_id"], "at", ["kind"], ["best"])
    return along.filter("kind = 1 and best is not null").select("meeting_id", F.col("at").alias("cutoff"), "series_id", "best.*")


def leakage(snapshots: DataFrame) -> DataFrame:
    """Per meeting, rows dated or versioned after the cutoff."""
    late = (F.col("observation_date") > F.col("cutoff")) | (F.col("realtime_start") > F.col("cutoff"))
    return snapshots.groupBy("meeting_id").agg(F.count("*").alias("n_rows"), F.count_if(late).alias("n_leaks"))


def valid_at(versions: DataFrame, points: DataFrame) -> DataFrame:
    """The version in force at each point (series_id, observation_date, at); the newest start wins."""
    newest = Window.partitionBy("series_id", "observation_date", "at").orderBy(F.col("realtime_start").desc())
    inside = F.col("at").between(F.col("realtime_start"), F.col("realtime_end"))
    found = points.join(versions, ["series_id", "observation_date"]).filter(inside)
    return found.withColumn("rank", F.row_number().over(newest)).filter("rank = 1").drop("rank")


def first_releases(versions: DataFrame) -> DataFrame:
    """versions with is_initial_release: the earliest version with a value."""
    first = F.min(F.when(F.col("value").isNotNull(), F.col("realtime_start"))).over(Window.partitionBy("series_id", "observation_date"))
    return versions.withColumn("is_initial_release", F.col("value").isNotNull() & (F.col("realtime_start") == first))


def shifted_join(values: DataFrame, days: int, keep_unmatched: bool) -> DataFrame:
    """values (series_id, day, level) with the level of the same series `days` earlier."""
    prior = values.select("series_id", F.date_add("day", days).alias("day"), F.col("level").alias("prior_level"))
    return values.join(prior, ["series_id", "day"], "left" if keep_unmatched else "inner")


def year_ago_strict(dates: DataFrame, day: str = "day") -> DataFrame:
    """dates with the same month and day of the year before, null where there is none (29 February)."""
    text = F.concat((F.year(day) - 1).cast("string"), F.date_format(day, "-MM-dd"))
    return dates.withColumn("year_ago", F.try_to_date(text, "yyyy-MM-dd"))


def year_ago_clamped(dates: DataFrame, day: str = "day") -> DataFrame:
    return dates.withColumn("year_ago", F.add_months(day, -12))


def first_after(versions: DataFrame, points: DataFrame, inclusive: bool = False) -> DataFrame:
    """The smallest observation date after (or on) each point (meeting_id, at) of each series; ties to the newest version.

    An observation is the first one after the points between the one before it and itself, so each point meets one.
    """
    newest = versions.groupBy("series_id", "observation_date").agg(
        F.max("realtime_start").alias("realtime_start"), F.max_by("value", "realtime_start").alias("value")
    )
    shift = 1 if inclusive else 0
    before = F.lag("observation_date").over(Window.partitionBy("series_id").orderBy("observation_date"))
    spans = newest.withColumns({"from_day": F.date_add(before, shift), "to_day": F.date_add("observation_date", shift)})
    found = interval_join(spans, points, "from_day", "to_day", "at")
    return found.select("meeting_id", "at", "series_id", "observation_date", "realtime_start", "value")


def carried_axis(left: DataFrame, right: DataFrame) -> DataFrame:
    """day, left_level, right_level on the days of either, each carried on; days before both have values are left out."""
    a, b = (x.select("day", F.col("level").alias(n)) for x, n in ((left, "left_level"), (right, "right_level")))
    names = ("left_level", "right_level")
    # The last value is the one with the largest day.
    dated = a.join(b, "day", "full_outer").withColumns({n: F.when(F.col(n).isNotNull(), F.struct("day", F.col(n).alias("level"))) for n in names})
    along = carried(dated, [], "day", [], list(names)).filter("left_level is not null and right_level is not null")
    return along.select("day", *[F.col(f"{n}.level").alias(n) for n in names])


def nearest_within(points: DataFrame, candidates: DataFrame, days: int) -> DataFrame:
    """For each point (day) the candidate (other_day) within `days`; nearer first, then the later side."""
    around = points.withColumns({"from_day": F.date_sub("day", days), "to_day": F.date_add("day", days + 1)})
    gap = F.date_diff("other_day", "day")
    best = Window.partitionBy("day").orderBy(F.abs(gap), -gap)
    found = interval_join(around, candidates, "from_day", "to_day", "other_day").drop("from_day", "to_day")
    return found.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")


def change_points(levels: DataFrame) -> DataFrame:
    """Rows of levels (series_id, day, level) whose level differs from the one before."""
    keys, order = ["series_id"], ["day"]
    along = with_earlier(ranged(levels, keys, order), keys, order, lasts={"__before": F.struct("level")})
    changed = F.col("__before").isNull() | ~F.col("level").eqNullSafe(F.col("__before.level"))
    return along.filter(changed).select(*levels.columns)


def directions(states: DataFrame) -> DataFrame:
    """INITIAL, UP, DOWN or UNCHANGED against the state before."""
    keys, order = ["series_id"], ["day"]
    along = with_earlier(ranged(states, keys, order), keys, order, lasts={"__before": F.struct("level")})
    before = F.col("__before.level")
    return along.select(
        "series_id",
        "day",
        "level",
        F.when(before.isNull(), "INITIAL")
        .when(F.col("level") > before, "UP")
        .when(F.col("level") < before, "DOWN")
        .otherwise("UNCHANGED")
        .alias("direction"),
    )


def regime_starts(directed: DataFrame, floor_level: float) -> DataFrame:
    """regime_start: first day of the run at the floor, else of the run of one direction, that a state belongs to."""
    keys, order = ["series_id"], ["day"]
    kind = F.when(F.col("level") <= floor_level, "FLOOR").otherwise(F.col("direction"))
    kinds = with_earlier(ranged(directed.withColumn("kind", kind), keys, order), keys, order, lasts={"__before": F.struct("kind")})
    begins = F.col("__before").isNull() | ~F.col("kind").eqNullSafe(F.col("__before.kind"))
    marked = kinds.withColumn("__begun", F.when(begins, F.col("day")))
    along = with_earlier(marked, keys, order, lasts={"__running": F.col("__begun")})
    return along.select(*directed.columns, "kind", F.coalesce("__begun", "__running").alias("regime_start"))


def rate_context(directed: DataFrame, cutoffs: DataFrame, changes: int = 8) -> DataFrame:
    """Per meeting and series one CURRENT row (ordinal 0, days since its start) and the newest changes (ordinals from 1)."""
    # A change is among the newest until so many later ones have come.
    later = F.lead("day", changes).over(Window.partitionBy("series_id").orderBy("day"))
    known = interval_join(directed.withColumn("until", later), cutoffs, "day", "until", "cutoff")
    newest = Window.partitionBy("meeting_id", "series_id").orderBy(F.col("day").desc())
    ranked = known.withColumn("rank", F.row_number().over(newest))
    columns = ["meeting_id", "series_id", "ordinal", "kind", "day", "level", "direction", "duration_days"]
    current = ranked.filter("rank = 1").select(
        "meeting_id", "series_id", F.lit(0).alias("ordinal"), F.lit("CURRENT").alias("kind"), "day", "level", "direction",
        F.date_diff("cutoff", "day").alias("duration_days"),
    )
    past = ranked.filter(F.col("rank") <= changes).select(
        "meeting_id", "series_id", F.col("rank").alias("ordinal"), F.lit("CHANGE").alias("kind"), "day", "level", "direction",
        F.lit(None).cast("int").alias("duration_days"),
    )
    return current.unionByName(past).select(*columns)


def prior_history(member_votes: DataFrame) -> DataFrame:
    """Strictly earlier votes of each member: number, dissents, rate (null if none), the vote before (false if none)."""
    keys, order = ["participant"], ["meeting"]
    votes = ranged(member_votes.select("meeting", "participant", "dissent"), keys, order)
    totals = {"prior_votes": F.lit(1), "prior_dissents": F.col("dissent").cast("int")}
    counted = with_earlier(votes, keys, order, totals, {"__before": F.struct("dissent")})
    return counted.select(
        "meeting", "participant", "dissent", "prior_votes", "prior_dissents",
        F.when(F.col("__before").isNull(), False).otherwise(F.col("__before.dissent")).alias("previous_dissent"),
        F.try_divide(F.col("prior_dissents"), F.col("prior_votes")).alias("prior_rate"),
    )


def recency(member_votes: DataFrame, before_meeting: int, newest: int = 8) -> DataFrame:
    """Per member, over votes before a meeting: newest-3 dissent rate, votes since the last dissent, newest votes."""
    order = Window.partitionBy("participant").orderBy(F.col("meeting").desc())
    ranked = member_votes.filter(F.col("meeting") < before_meeting).withColumn("rank", F.row_number().over(order))
    return ranked.groupBy("participant").agg(
        F.avg(F.when(F.col("rank") <= 3, F.col("dissent").cast("int"))).alias("recent3_rate"),
        (F.min(F.when(F.col("dissent"), F.col("rank"))) - 1).alias("votes_since_dissent"),
        F.max(F.when(F.col("dissent"), F.col("meeting"))).alias("last_dissent"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("rank") <= newest, F.struct("rank", "meeting")))), lambda x: x["meeting"]
        ).alias("newest_votes"),
    )


def persistence(outcomes: DataFrame, group: str) -> DataFrame:
    """outcomes with the last known action before each, gaps carried over."""
    keys, order = [group], ["meeting"]
    return with_earlier(ranged(outcomes, keys, order), keys, order, lasts={"persisted": F.col("action")}).drop(RANGE)


def filled_levels(rows: DataFrame, group: str, tolerance: float = 0.05) -> DataFrame:
    """Level carried forward, and an action from its change where none was recorded."""
    keys, order = [group], ["meeting"]
    along = with_earlier(ranged(rows, keys, order), keys, order, lasts={"__before": F.col("level")})
    filled = along.withColumn("filled", F.coalesce("level", "__before"))
    change = F.col("filled") - F.col("__before")
    imputed = F.when(change >= tolerance, "HIKE").when(change <= -tolerance, "CUT").when(change.isNotNull(), "HOLD")
    return filled.withColumn("imputed", F.coalesce("action", imputed)).drop("__before", RANGE)


def monthly_growth(levels: DataFrame, points: int = 24) -> DataFrame:
    """Growth over the same month a year before (null where that month is missing), newest months only."""
    month = levels.groupBy("series_id", F.trunc("day", "MM").alias("month")).agg(F.sum("level").alias("level"))
    prior = month.select("series_id", F.add_months("month", 12).alias("month"), F.col("level").alias("prior"))
    joined = month.join(prior, ["series_id", "month"], "left").withColumn("growth", F.try_divide(F.col("level"), F.col("prior")) - 1)
    newest = Window.partitionBy("series_id").orderBy(F.col("month").desc())
    return joined.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= points).drop("rank", "prior")


def review_states(events: DataFrame) -> DataFrame:
    """First time of each event type of an assumption, its state and recognition lag in seconds."""
    kinds = ("MONITORED", "CONTRADICTION", "REVIEW_REQUESTED", "REVIEWED")
    firsts = events.groupBy("assumption_id").agg(*[F.min(F.when(F.col("kind") == k, F.col("occurred_at"))).alias(k.lower()) for k in kinds])
    state = (
        F.when(F.col("reviewed").isNotNull(), "REVIEWED")
        .when(F.col("review_requested").isNotNull(), "REVIEW_REQUESTED")
        .when(F.col("contradiction").isNotNull(), "CONTRADICTED")
        .otherwise("MONITORED")
    )
    return firsts.select(
        "assumption_id", *[k.lower() for k in kinds], state.alias("state"),
        F.timestamp_diff("SECOND", "contradiction", "review_requested").alias("recognition_lag_s"),
    )


def even_sample(rows: DataFrame, order: str, group: str, target: int) -> DataFrame:
    """`target` evenly spaced rows of each group in order; positions are rounded half to even."""
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    picks = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(target - 1)))).select(
        group, F.bround(F.col("i") * (F.col("n") - 1) / F.lit(max(1, target - 1))).cast("int").alias("position")
    )
    return ranked.join(picks.distinct(), [group, "position"])


def classified_alerts(statements: DataFrame, adopted: Column, contradicted: Column) -> DataFrame:
    """statements (group, at, id, support, flip) classified in order around an adoption and a contradiction time."""
    keys, order = ["group"], ["at", "id"]
    alerting = (F.col("at") >= contradicted) & F.col("flip") & ~F.col("support")
    along = with_earlier(ranged(statements, keys, order), keys, order, {"__alerts": alerting.cast("int")})
    kind = (
        F.when(F.col("at") < adopted, "PRE_ADOPTION")
        .when(F.col("support") & F.col("flip"), "SUPPRESSED_SUPPORT_FLIP_COOCCURRENCE")
        .when(F.col("support"), "SUPPORT")
        .when(F.col("flip") & (F.col("at") < contradicted), "SUPPRESSED_PRE_CONTRADICTION")
        .when(F.col("flip") & (F.col("__alerts") == 0), "ALERT")
        .when(F.col("flip"), "POST_ALERT_REPEAT")
        .otherwise("NO_MATCH")
    )
    return along.withColumn("class", kind).drop("__alerts", RANGE)
