"""Case assembly: phrase flips, responses to them, name registries, merged evidence, nested references, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import surname


def first_phrase_flip(statements: DataFrame, claims: DataFrame) -> DataFrame:
    """The first statement at or after a claim's contradiction that flips and gives no support, for each claim.

    statements: claim, at, id, support, flip. claims: claim, adopted_at, contradiction_at. Status is OBSERVED where a
    statement from adoption to contradiction, before the flip, gave support; NO_SUPPORT_BEFORE where none did;
    NO_STATEMENT_FLIP without a flip.
    """
    rows = claims.join(statements, "claim", "left").withColumn("place", F.struct("at", "id"))
    adopted, late = F.col("at") >= F.col("adopted_at"), F.col("at") >= F.col("contradiction_at")
    supports = F.col("support") & adopted & (F.col("at") <= F.col("contradiction_at"))
    found = rows.groupBy("claim").agg(
        F.min(F.when(supports, F.col("place"))).alias("supported"),
        F.min(F.when(adopted & late & F.col("flip") & ~F.col("support"), F.col("place"))).alias("turned"),
    )
    status = F.when(F.col("turned").isNull(), "NO_STATEMENT_FLIP").when(F.col("supported") < F.col("turned"), "OBSERVED").otherwise("NO_SUPPORT_BEFORE")
    return found.select("claim", F.col("turned.at").alias("flip_at"), F.col("turned.id").alias("flip_id"), status.alias("status"))


def first_response(flips: DataFrame, outcomes: DataFrame, by: str) -> DataFrame:
    """flips (by, flip_at, direction) with the first outcome (by, meeting, decided_on, action) on or after them that closes them."""
    closing = F.when(F.col("direction") == "HAWKISH", "HIKE").otherwise("CUT")
    answers = flips.join(outcomes, by).filter((F.col("action") == closing) & (F.col("decided_on") >= F.col("flip_at")))
    first = answers.groupBy(by).agg(F.min(F.struct("decided_on", "meeting")).alias("first"))
    return flips.join(first, by, "left").select(*flips.columns, F.col("first.decided_on").alias("response_at"), F.col("first.meeting").alias("response_meeting"))


def full_names(names: DataFrame) -> DataFrame:
    """surname, full_name: the longest variant (the last of equally long ones) of surnames with one first name."""
    full = names.filter(F.contains("name", F.lit(" "))).select("name", surname(F.col("name")).alias("surname")).distinct()
    given = F.lower(F.regexp_extract("name", "([A-Za-z'-]+)", 1))
    longest = F.max_by("name", F.struct(F.length("name"), "name"))
    found = full.groupBy("surname").agg(longest.alias("full_name"), F.min(given).alias("least"), F.max(given).alias("most"))
    return found.filter("least = most").select("surname", "full_name")


def merged_evidence(existing: DataFrame, supplemental: DataFrame, keep: int = 5) -> DataFrame:
    """Both sets of communications (participant, document_id, published, importance), existing ones first; `keep` are ranked."""
    fresh = supplemental.join(existing, ["participant", "document_id"], "left_anti")
    columns = ["participant", "document_id", "published", "importance"]
    both = existing.select(*columns, F.lit(False).alias("added")).unionByName(fresh.select(*columns, F.lit(True).alias("added")))
    order = Window.partitionBy("participant").orderBy(F.col("importance").desc(), "published", "document_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


_PLACES = {
    "context": lambda: F.col("context.evidence_refs"),
    "options": lambda: _inner(F.col("options")),
    "debate": lambda: _inner(F.col("debate")),
    "decision": lambda: F.col("decision.evidence_refs"),
    "vote.rounds": lambda: _inner(F.col("vote.rounds")),
    "assumptions": lambda: _inner(F.col("assumptions")),
}


def _inner(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda part: F.coalesce(part["evidence_refs"], F.array())))


def evidence_references(traces: DataFrame, key: str) -> DataFrame:
    """key, path, and the fields of every evidence reference in the six places of a decision trace; one pass, no shuffle."""

    def tagged(path: str, refs: Column) -> Column:
        return F.transform(F.coalesce(refs, F.array()), lambda r: F.struct(F.lit(path).alias("path"), r.alias("ref")))

    return traces.select(key, F.explode(F.concat(*[tagged(path, refs()) for path, refs in _PLACES.items()])).alias("found")).select(key, "found.path", "found.ref.*")


def repaired_attribution(items: DataFrame, references: DataFrame) -> DataFrame:
    """Items (item, participant) against their references (item, owner, known: whether it is a transcript segment).

    Where a known reference is the participant's own, known ones of others are dropped; where none is, the item goes to
    the committee (participant null) and keeps all. Unknown references are always kept.
    """
    own = F.col("known") & F.equal_null("owner", "participant")
    counted = items.join(references, "item", "left").groupBy("item", "participant").agg(
        F.count("known").alias("n_references"), F.count_if(own).alias("n_own"), F.count_if(F.col("known") & ~F.equal_null("owner", "participant")).alias("n_foreign")
    )
    matched = F.col("n_own") > 0
    kept = F.col("n_references") - F.when(matched, F.col("n_foreign")).otherwise(0)
    return counted.select("item", F.when(matched, F.col("participant")).alias("participant"), kept.alias("kept"), (~matched).alias("demoted"))


def end_of_day(url: Column, heading: Column) -> Column:
    """Publication instant: the last second of the day in the link (yyyyMMdd), else of the heading in either month format."""
    token = F.regexp_extract(url, r"(\d{8})", 1)
    day = F.coalesce(F.try_to_date(token, "yyyyMMdd"), F.try_to_date(heading, "MMMM d, yyyy"), F.try_to_date(heading, "MMM d, yyyy"))
    return F.date_format(day, "yyyy-MM-dd'T23:59:59Z'")


def write_once_status(stored: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """What a write-once store does with offered artifacts (key, fingerprint): written, unchanged, or refused if they differ."""
    known = stored.select(key, F.col("fingerprint").alias("stored"), F.lit(True).alias("held"))
    status = F.when(F.col("held").isNull(), "written").when(F.equal_null("stored", "fingerprint"), "unchanged").otherwise("refused")
    return offered.join(known, key, "left").select(key, status.alias("status"))


def spec_rules(rows: DataFrame, required: list[str], metrics: list[str]) -> DataFrame:
    """Rules over rows of specs (spec, variant_id, metric, is_probe, shows_date, shows_more), one row a spec.

    unique_ids; missing (required variants that are absent); exact_metrics; probes_closed (probe rows show the date only).
    """
    want = F.array(*[F.lit(v) for v in sorted(required)])
    exact = F.array(*[F.lit(m) for m in sorted(metrics)])
    open_probe = F.col("is_probe") & (~F.col("shows_date") | F.col("shows_more"))
    return rows.groupBy("spec").agg(
        (F.count("*") == F.count_distinct("variant_id")).alias("unique_ids"),
        F.array_except(want, F.collect_set("variant_id")).alias("missing"),
        (F.sort_array(F.collect_set("metric")) == exact).alias("exact_metrics"),
        (F.count_if(open_probe) == 0).alias("probes_closed"),
    )
