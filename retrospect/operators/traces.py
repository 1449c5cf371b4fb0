"""Decision traces and forecasts: parsing, validation, repair, review queues and samples, assembly and revalidation."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.substring import longest_common
from ..sources.workers import ship_package

_REF = "array<struct<document_id: string, locator: string, excerpt: string>>"
#: The nested record of a decision.
TRACE_SCHEMA = f"""decision_id string, meeting_id string, context struct<summary: string, evidence_refs: {_REF}>,
options array<struct<option_id: string, action_class: string, evidence_refs: {_REF}>>,
debate array<struct<speaker_scope: string, participant_id: string, evidence_refs: {_REF}>>,
decision struct<action_class: string, target_lower: double, target_upper: double, evidence_refs: {_REF}>,
vote struct<rounds: array<struct<vote_round: int, for_count: int, against_count: int, evidence_refs: {_REF}>>>,
assumptions array<struct<assumption_id: string, claim: string, monitor_series_id: string, threshold_value: double, evidence_refs: {_REF}>>"""


def rule_list(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null is not broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def parsed_traces(documents: DataFrame) -> DataFrame:
    """documents (key, json) with the fields of the trace and `malformed`: rules of its shape that it breaks."""
    read = documents.withColumn("trace", F.from_json("json", TRACE_SCHEMA, {"mode": "PERMISSIVE"})).select("key", "trace.*")
    few = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    rules = {
        "DECISION_ID": F.col("decision_id").isNull(), "OPTIONS": few("options"), "ROUNDS": few("vote.rounds"), "ASSUMPTIONS": few("assumptions"),
        "ACTION": F.col("decision.action_class").isNull(), "SCOPE": F.exists("debate", lambda x: ~x["speaker_scope"].isin("committee", "participant")),
    }
    return read.withColumn("malformed", rule_list(rules))


def _repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) < F.size(values)


def trace_violations(traces: DataFrame, references: DataFrame, labels: DataFrame, series: DataFrame) -> DataFrame:
    """key, violations of parsed traces against what is known.

    references: key, path, participant, found (the excerpt is in the located text), owner (member who speaks there, or
    null). labels: key, action_class, votes_for, votes_against. series: series_id, the monitors that are allowed.
    """
    cited = references.groupBy("key").agg(
        F.count_if(~F.col("found")).alias("not_found"),
        F.count_if(F.col("participant").isNotNull() & F.col("owner").isNotNull() & (F.col("participant") != F.col("owner"))).alias("foreign"),
    )
    watched = traces.select("key", F.explode("assumptions.monitor_series_id").alias("series_id")).join(series.select("series_id"), "series_id", "left_anti")
    unknown = watched.groupBy("key").agg(F.count("*").alias("unknown"))
    named = labels.select("key", F.col("action_class").alias("labelled"), "votes_for", "votes_against")
    joined = traces.join(cited, "key", "left").join(unknown, "key", "left").join(named, "key", "left")
    first = F.get("vote.rounds", F.lit(0))
    rules = {
        "OPTION_REPEATED": _repeats(F.col("options.option_id")), "ASSUMPTION_REPEATED": _repeats(F.col("assumptions.assumption_id")),
        "EXCERPT_NOT_FOUND": F.col("not_found") > 0, "FOREIGN_ATTRIBUTION": F.col("foreign") > 0,
        "ACTION_MISMATCH": ~F.equal_null("decision.action_class", "labelled"),
        "VOTE_MISMATCH": (first["for_count"] != F.col("votes_for")) | (first["against_count"] != F.col("votes_against")), "MONITOR_UNKNOWN": F.col("unknown") > 0,
    }
    return joined.select("key", F.concat("malformed", rule_list(rules)).alias("violations"))


def enterprise_violations(traces: DataFrame, references: DataFrame, registry: DataFrame) -> DataFrame:
    """key, violations of traces of made-up companies; registry: assumption_id, claim, monitor_series_id, threshold_value."""
    missing = references.groupBy("key").agg(F.count_if(~F.col("found")).alias("not_found"))
    claims = traces.select("key", F.explode("assumptions").alias("a")).select("key", "a.assumption_id", F.struct("a.claim", "a.monitor_series_id", "a.threshold_value").alias("said"))
    listed = registry.select("assumption_id", F.struct("claim", "monitor_series_id", "threshold_value").alias("listed"))
    odd = claims.join(listed, "assumption_id", "left").filter(~F.equal_null("said", "listed")).groupBy("key").agg(F.count("*").alias("odd"))
    joined = traces.join(missing, "key", "left").join(odd, "key", "left")
    rules = {
        "MEETING": F.col("meeting_id").isNotNull(), "OPTION_REPEATED": _repeats(F.col("options.option_id")), "ASSUMPTION_REPEATED": _repeats(F.col("assumptions.assumption_id")),
        "EXCERPT_NOT_FOUND": F.col("not_found") > 0, "ATTRIBUTED": F.exists("debate", lambda x: (x["speaker_scope"] != "committee") | x["participant_id"].isNotNull()),
        "ACTION": ~F.col("decision.action_class").isin("PROCEED", "DEFER", "REJECT"), "RATE": F.col("decision.target_lower").isNotNull() | F.col("decision.target_upper").isNotNull(),
        "ROUND_REPEATED": _repeats(F.col("vote.rounds.vote_round")), "EMPTY_ROUND": F.exists("vote.rounds", lambda x: x["for_count"] + x["against_count"] <= 0), "MONITOR": F.col("odd") > 0,
    }
    return joined.select("key", rule_list(rules).alias("violations"))


def repaired_excerpts(spark: SparkSession, references: DataFrame, longest: int = 1000, window: int = 900, lead: int = 350) -> DataFrame:
    """references (key, hint, unit) with excerpt and tier: EXACT, UNIT for short units, ANCHOR for long ones, KEPT.

    The first two are column expressions; only what is left goes through Python: the longest common part of hint and unit,
    in any case, anchors a window of the unit, if it is long enough. Its time grows with the sum of both lengths.
    """
    ship_package(spark)

    @F.pandas_udf("string")
    def anchored(hints: pd.Series, units: pd.Series) -> pd.Series:
        out = []
        for hint, unit in zip(hints, units, strict=True):
            size, _, at = longest_common(hint.casefold(), unit.casefold())
            end = min(len(unit), max(0, at - lead) + window)
            out.append(unit[max(0, end - window) : end] if size >= min(40, max(12, len(hint) // 3)) else None)
        return pd.Series(out, dtype=object)

    flat = lambda c: F.trim(F.regexp_replace(c, "[\\s ]+", " "))
    tier = F.when(F.contains("unit", "hint") & (F.length("hint") <= longest), "EXACT").when(F.length("unit") <= longest, "UNIT")
    rows = references.withColumns({"hint": flat(F.col("hint")), "unit": flat(F.col("unit"))}).withColumn("tier", F.when(F.col("unit").isNull(), "KEPT").otherwise(tier))
    easy = rows.filter("tier is not null").withColumn("excerpt", F.when(F.col("tier") == "UNIT", F.col("unit")).otherwise(F.col("hint")))
    rest = rows.filter("tier is null").withColumn("found", anchored(F.col("hint"), F.col("unit")))
    hard = rest.select("key", "hint", "unit", F.when(F.col("found").isNull(), "KEPT").otherwise("ANCHOR").alias("tier"), F.coalesce("found", "hint").alias("excerpt"))
    return easy.unionByName(hard).select("key", "tier", "excerpt")


def review_queue(cases: DataFrame) -> DataFrame:
    """cases with flags and priority (HIGH if any). Columns: participant_items, transcript_references, attempts, demoted, removed, violations."""
    flags = {
        "NO_PARTICIPANT_LEVEL_DEBATE": F.col("participant_items") == 0, "NO_TRANSCRIPT_EVIDENCE": F.col("transcript_references") == 0, "SEMANTIC_REPAIR_USED": F.col("attempts") > 1,
        "ATTRIBUTION_DEMOTED_TO_COMMITTEE": F.col("demoted") > 0, "MISMATCHED_ATTRIBUTION_REFERENCE_REMOVED": F.col("removed") > 0,
    }
    found = cases.withColumn("flags", rule_list(flags))
    return found.select("case", "flags", F.when(F.size("flags") > 0, "HIGH").otherwise("STANDARD").alias("priority"), (F.size("violations") == 0).alias("valid"))


def queue_summary(queue: DataFrame) -> DataFrame:
    return queue.groupBy("priority").agg(F.count("*").alias("cases"), F.count_if("valid").alias("valid"))


def review_sample(queue: DataFrame, target: int, seed: str, repair_flag: str = "SEMANTIC_REPAIR_USED") -> DataFrame:
    """case, reasons: a deterministic sample of a queue (case, flags, priority) by tiers, `target` cases where the queue has them.

    All repairs; one representative for each flag that those before leave uncovered, flags in order; then STANDARD cases
    and then any, by SHA-256 of (seed, stratum, case). Each flag's step sees a few rows; the fills rank the queue by
    prefixes of their hash, so no task sorts it whole.
    """
    rank = lambda stratum: F.sha2(F.concat_ws("|", F.lit(seed), F.lit(stratum), F.col("case").cast("string")).cast("binary"), 256)
    chosen = queue.filter(F.array_contains("flags", repair_flag)).select("case", "flags", F.lit("ALL_SEMANTIC_REPAIRS").alias("reason"))
    flags = [row[0] for row in queue.select(F.explode("flags")).distinct().orderBy("col").collect()]  # the few names of flags
    covered = {row[0] for row in chosen.select(F.explode("flags")).distinct().collect()}
    for flag in flags:
        if flag not in covered:
            best = F.min_by(F.struct("case", "flags"), rank(f"FLAG:{flag}")).alias("b")
            one = queue.filter(F.array_contains("flags", flag)).agg(best).select("b.case", "b.flags", F.lit(f"FLAG_REPRESENTATIVE:{flag}").alias("reason"))
            covered |= set(one.first()["flags"])
            chosen = chosen.unionByName(one)
    picked = chosen.groupBy("case").agg(F.collect_list("reason").alias("reasons"))
    for stratum, reason, rows in (("STANDARD", "STANDARD_HASH_SAMPLE", queue.filter("priority = 'STANDARD'")), ("FALLBACK", "HASH_FILL", queue)):
        need = target - picked.count()
        if need > 0:
            fill = rows.join(picked, "case", "left_anti").select("case", F.array(F.lit(reason)).alias("reasons"), rank(stratum).alias("h")).orderBy("h").limit(need)
            picked = picked.unionByName(fill.drop("h"))
    return picked


def combined_forecast(predictions: DataFrame, roster: DataFrame, fallback: DataFrame, policy_support: int = 3, against_support: int = 2) -> DataFrame:
    """case, action, support, models, consensus, votes (participant, against_support, vote) and problem for every case of roster.

    predictions: case, model, action, votes (map of participant to choice). A leading action (alphabetical on a tie) needs
    policy_support models, else the case's fallback action (case, fallback) counts; a member is against by against_support
    models. Problems: COVERAGE if a model's votes are not the roster's, DUPLICATE_MODEL, NO_MODEL. roster: case and
    participant, or case (once) and members, each once and in order. A case's predictions are collected once and counted in its row.
    """
    members = roster if "members" in roster.columns else roster.groupBy("case").agg(F.sort_array(F.collect_set("participant")).alias("members"))
    collected = predictions.groupBy("case").agg(F.collect_list(F.struct("model", "action", "votes")).alias("made"))
    of = lambda name: F.transform("made", lambda p: p[name])
    models = collected.select("case", F.size("made").cast("long").alias("models"), of("model").alias("numbers"), of("action").alias("actions"), F.filter(of("votes"), lambda v: v.isNotNull()).alias("cast"))
    known = F.filter("numbers", lambda n: n.isNotNull())
    times = F.transform(F.array_distinct("actions"), lambda a: F.struct((-F.size(F.filter("actions", lambda x: F.equal_null(x, a)))).cast("long").alias("m"), a.alias("action")))
    uneven = F.exists("cast", lambda v: F.sort_array(F.map_keys(v)) != F.col("members"))
    whole = members.select("case", "members").join(models, "case", "left").join(fallback, "case", "left").withColumns({
        "t": F.array_min(times), "twice": F.size(F.array_distinct(known)) < F.size("numbers"), "uneven": uneven,
    })
    votes = F.transform(
        "members", lambda p: F.struct(p.alias("participant"), F.size(F.filter(F.coalesce("cast", F.array().cast("array<map<bigint,string>>")), lambda v: F.try_element_at(v, p) == "AGAINST")).alias("against_support"))
    )
    said = F.transform(votes, lambda v: F.struct(v["participant"].alias("participant"), v["against_support"].alias("against_support"), F.when(v["against_support"] >= against_support, "AGAINST").otherwise("FOR").alias("vote")))
    support = F.coalesce(-F.col("t.m"), F.lit(0))
    problem = F.when(F.col("models").isNull(), "NO_MODEL").when(F.col("twice"), "DUPLICATE_MODEL").when(F.col("uneven"), "COVERAGE")
    return whole.select(
        "case", F.when(support >= policy_support, F.col("t.action")).otherwise(F.col("fallback")).alias("action"), support.alias("support"),
        F.coalesce("models", F.lit(0)).alias("models"), (support >= policy_support).alias("consensus"), said.alias("votes"), problem.alias("problem"),
    )


def revalidated(stored: DataFrame, combined: DataFrame, variants: list[str]) -> DataFrame:
    """case, blockers of stored forecasts (case, as_of, locked_on, starts_on, variants, action, votes) against a fresh combination."""
    want = F.array(*[F.lit(v) for v in sorted(variants)])
    fresh = combined.select("case", F.col("action").alias("fresh_action"), F.col("votes").alias("fresh_votes"), "problem")
    joined = stored.join(fresh, "case", "left")
    rules = {
        "CUTOFF": F.col("as_of") >= F.col("starts_on"), "LOCK": F.col("locked_on").isNull() | (F.col("locked_on") >= F.col("starts_on")),
        "VARIANTS": ~(F.sort_array(F.array_distinct("variants")) == want), "MODELS": F.col("problem").isNotNull(),
        "ACTION": ~F.equal_null("action", "fresh_action"), "VOTES": ~F.equal_null("votes", F.transform("fresh_votes", lambda v: v["vote"])),
    }
    return joined.select("case", rule_list(rules).alias("blockers"))


def assembled_forecast(persisted: DataFrame, scored: DataFrame, accuracy: DataFrame, voters: DataFrame, combined: DataFrame) -> DataFrame:
    """One nested row a case: the action of the model with the best stored accuracy, or of the combination, and the voters.

    persisted: case, persistence_action. scored: case, logit_action, probabilities. accuracy: one row (persistence, logit).
    voters: case, participant, baseline_vote, evidence. combined: combined_forecast. Persistence wins an equal accuracy.
    """
    best = accuracy.select(F.when(F.col("logit") > F.col("persistence"), "logit").otherwise("persistence").alias("primary"))
    rows = voters.groupBy("case").agg(F.sort_array(F.collect_list(F.struct("participant", "baseline_vote", "evidence"))).alias("rows"))
    usable = combined.filter("problem is null").select("case", F.col("action").alias("combined_action"), F.map_from_entries(F.transform("votes", lambda v: F.struct(v["participant"], v["vote"]))).alias("combined_votes"))
    joined = persisted.join(scored, "case").join(rows, "case", "left").join(usable, "case", "left").join(F.broadcast(best))  # one row
    chosen = F.when(F.col("primary") == "logit", F.col("logit_action")).otherwise(F.col("persistence_action"))
    vote = lambda x: F.coalesce(F.try_element_at("combined_votes", x["participant"]), x["baseline_vote"])
    merged = F.transform("rows", lambda x: F.struct(x["participant"].alias("participant"), vote(x).alias("vote"), x["baseline_vote"].alias("baseline_vote"), x["evidence"].alias("evidence")))
    return joined.select(
        "case", F.coalesce("combined_action", chosen).alias("action"), F.when(F.col("combined_action").isNotNull(), "ensemble").otherwise(F.col("primary")).alias("model"),
        "probabilities", (F.col("persistence_action") == F.col("logit_action")).alias("models_agree"), F.coalesce(merged, F.array().cast("array<struct<participant:bigint,vote:string,baseline_vote:string,evidence:array<string>>>")).alias("voters"),
    )


def explanation_inputs(forecasts: DataFrame, history: DataFrame) -> DataFrame:
    """case, participant, input: what an explanation of a member's vote may use, nested; history: participant, prior_votes, prior_dissents."""
    each = forecasts.select("case", "action", "probabilities", F.explode("voters").alias("v")).withColumn("participant", F.col("v.participant"))
    meeting = F.struct(F.col("case").alias("meeting_id"), F.col("action").alias("predicted_policy_action"), F.col("probabilities").alias("reference_probabilities"))
    rate = F.try_divide(F.col("prior_dissents"), F.col("prior_votes"))
    member = F.struct("participant", F.col("v.vote").alias("predicted_vote"), "prior_votes", "prior_dissents", rate.alias("prior_dissent_rate"), F.col("v.evidence").alias("communications"))
    guards = F.struct(*[F.lit(True).alias(n) for n in ("records_are_evidence", "concerns_are_inferences", "may_not_change_prediction", "may_not_invent_evidence")])
    return each.join(history, "participant", "left").select("case", "participant", F.struct(meeting.alias("meeting"), member.alias("member"), guards.alias("guardrails")).alias("input"))


def variant_matrix(deterministic: DataFrame, reports: DataFrame, stored: DataFrame) -> DataFrame:
    """variant, kind, n, accuracy, error, f1, agrees: deterministic rows without dissent metrics beside those of model runs.

    deterministic: variant, n, accuracy, error. reports: variant, case, hit, error, tp, fp, fn, summed here; stored: variant,
    n, accuracy, f1 as published, which must be equal.
    """
    f1 = F.coalesce(F.try_divide(2.0 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")), F.lit(0.0))
    fresh = reports.groupBy("variant").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("accuracy"), F.avg("error").alias("error"), f1.alias("f1"))
    known = stored.select("variant", F.struct("n", F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1")).alias("said"))
    agrees = F.equal_null("said", F.struct("n", F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1")))
    runs = fresh.join(known, "variant", "left").withColumn("agrees", agrees).drop("said").withColumn("kind", F.lit("model"))
    return deterministic.withColumn("kind", F.lit("deterministic")).unionByName(runs, allowMissingColumns=True)


def case_bundles(cases: DataFrame, parts: dict[str, DataFrame | Column], left_out: tuple[str, ...] = ()) -> DataFrame:
    """cases (case, ...) with one array of structs for each part (case, ...), in order, and a hash over all of them.

    A part that a case's own columns make is an array of structs and joins nothing; columns that only make parts are left out.
    """
    out = cases.select("*", *[F.sort_array(made).alias(name) for name, made in parts.items() if isinstance(made, Column)]).drop(*left_out)
    for name, rows in parts.items():
        if isinstance(rows, Column):
            out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
            continue
        fields = F.struct(*[c for c in rows.columns if c != "case"])
        grouped = rows.groupBy("case").agg(F.sort_array(F.collect_list(fields)).alias(name))
        out = out.join(grouped, "case", "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    out = out.select(*[c for c in cases.columns if c not in left_out], *parts)
    return out.withColumn("bundle_hash", F.sha2(F.to_json(F.struct(*out.columns)).cast("binary"), 256))


def bundle_sizes(bundles: DataFrame, parts: list[str], *more: Column) -> DataFrame:
    """case, the number of entries of each part, the bundle's bytes, and more columns of a bundle."""
    return bundles.select("case", *[F.size(p).alias(f"n_{p}") for p in parts], F.octet_length(F.to_json(F.struct(*parts))).alias("bytes"), *more)


def salient_topics(communications: DataFrame, taxonomy: dict[str, list[str]], limit: int = 3, evidence: int = 3) -> DataFrame:
    """participant, rank, topic, score, share, evidence_ids from communications (participant, document_id, title, text).

    A document scores four for a term in the title and up to eight in the text; shares are within the topics kept.
    """
    count = lambda c, term: F.size(F.filter(F.split(F.lower(c), r"[^\w]+"), lambda w: w == term))
    score = lambda terms: reduce(lambda a, b: a + b, [4 * count(F.col("title"), t) + F.least(F.lit(8), count(F.col("text"), t)) for t in terms])
    scores = F.array(*[F.struct(F.lit(topic).alias("topic"), score(terms).cast("long").alias("score")) for topic, terms in taxonomy.items()])
    rows = communications.select("participant", "document_id", F.explode(scores).alias("t")).select("participant", "document_id", "t.*").filter("score > 0")
    place = F.row_number().over(Window.partitionBy("participant", "topic").orderBy(F.col("score").desc(), "document_id"))
    ids = F.sort_array(F.collect_list(F.when(F.col("place") <= evidence, F.struct("place", "document_id"))))
    topics = rows.withColumn("place", place).groupBy("participant", "topic").agg(F.sum("score").alias("score"), F.transform(ids, lambda x: x["document_id"]).alias("evidence_ids"))
    best = Window.partitionBy("participant").orderBy(F.col("score").desc(), "topic")
    kept = topics.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    return kept.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("participant")))


def context_rules(members: DataFrame, communications: DataFrame, cutoffs: DataFrame, size: int) -> DataFrame:
    """context, broken: rules over members (context, participant, role), communications (context, participant, published) and cutoffs (context, as_of)."""
    counts = members.groupBy("context").agg(
        F.count("*").alias("n"), F.count_distinct("participant").alias("distinct"), F.count_if(F.col("role") == "chair").alias("chairs"),
        F.count_if(F.col("role") == "vice_chair").alias("vices"), F.count_if(~F.col("role").isin("chair", "vice_chair", "member")).alias("odd"), F.collect_set("participant").alias("who"),
    )
    late = communications.join(cutoffs, "context").join(counts.select("context", "who"), "context", "left").groupBy("context").agg(
        F.count_if(F.col("published") > F.col("as_of")).alias("late"), F.count_if(~F.coalesce(F.array_contains("who", F.col("participant")), F.lit(False))).alias("strangers")
    )
    rules = {
        "MEMBERS": F.col("n") != size, "DUPLICATE": F.col("distinct") < F.col("n"), "CHAIR": F.col("chairs") != 1, "VICE_CHAIR": F.col("vices") != 1, "ROLE": F.col("odd") > 0,
        "LATE": F.col("late") > 0, "STRANGER": F.col("strangers") > 0,
    }
    return counts.join(late, "context", "left").select("context", rule_list(rules).alias("broken"))


def prediction_rules(records: DataFrame, evidence: DataFrame, classes: list[str]) -> DataFrame:
    """case, violations of prediction records against the evidence (case, evidence_id) that they may cite.

    records: case, roster, profiles, contributions, votes (arrays of member ids), chairs, proposer (ids), options, cited.
    """
    known = evidence.groupBy("case").agg(F.collect_set("evidence_id").alias("known"))
    same = lambda c: F.sort_array(c) == F.sort_array("roster")
    rules = {
        "PROFILES": ~same("profiles"), "CONTRIBUTIONS": ~same("contributions"), "VOTES": ~same("votes"), "CHAIR": F.size("chairs") != 1,
        "PROPOSER": ~F.equal_null("proposer", F.get("chairs", F.lit(0))), "EVIDENCE": F.size(F.array_except("cited", F.coalesce("known", F.array().cast("array<bigint>")))) > 0,
        "OPTIONS": ~(F.sort_array("options") == F.array(*[F.lit(c) for c in sorted(classes)])),
    }
    return records.join(known, "case", "left").select("case", rule_list(rules).alias("violations"))


def transcript_segments(transcripts: DataFrame, people: DataFrame, pattern: str, least: int) -> DataFrame:
    """document, segment_id, ordinal, speaker, member, text_hash, accepted: segments of transcripts (document, text).

    A label resolves to the person (id, name) with that surname if one has it; a transcript with fewer segments than
    `least` is not accepted.
    """
    from ..functions.text import speaker_segments

    parts = speaker_segments(F.col("text"), pattern)
    rows = transcripts.select("document", F.size(parts).alias("n"), F.posexplode(parts).alias("ordinal", "p")).select("document", "n", "ordinal", "p.*")
    word = lambda c: F.lower(F.regexp_extract(c, r"(\S+?)[.]?$", 1))
    unique = people.groupBy(word(F.col("name")).alias("surname")).agg(F.min("id").alias("member"), F.count("*").alias("k")).filter("k = 1").drop("k")
    named = rows.withColumn("surname", word(F.col("speaker"))).join(unique, "surname", "left")
    return named.select(
        "document", F.concat_ws("-", F.lit("segment"), F.col("document").cast("string"), F.col("ordinal").cast("string")).alias("segment_id"), "ordinal", "speaker", "member",
        F.sha2(F.col("body").cast("binary"), 256).alias("text_hash"), (F.col("n") >= least).alias("accepted"),
    )


def replay_records(outcomes: DataFrame, votes: DataFrame, traces: DataFrame, levels: DataFrame) -> DataFrame:
    """meeting, decided_on, action, level, votes, tier (full with a trace, else base), assumptions, series (its levels up to the day)."""
    cast = votes.groupBy("meeting").agg(F.sort_array(F.collect_list(F.struct("participant", "dissent"))).alias("votes"))
    kept = traces.select("meeting", F.col("assumptions").alias("assumptions"), F.lit(True).alias("traced"))
    joined = outcomes.join(cast, "meeting", "left").join(kept, "meeting", "left").join(levels, "meeting", "left")
    return joined.select("meeting", "decided_on", "action", "level", "votes", F.when(F.col("traced"), "full").otherwise("base").alias("tier"), "assumptions", "series")
