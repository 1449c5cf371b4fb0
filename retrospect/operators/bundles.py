"""Trace bundles: a meeting's documents in numbered units with its roster, outcome, vote rounds and series; locators in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html
from .names import redacted_in_row
from .traces import rule_list

#: The types of documents in their order, and the usage that each must be registered for.
USAGE = {"statement": "label_only", "minutes": "label_only", "transcript": "persona_evidence"}
#: What locators of each kind of document begin with.
SEGMENT, PARAGRAPH = "transcript segment ", "paragraph "


def _hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _grouped(rows: DataFrame, key: str, name: str, *fields: str | Column) -> DataFrame:
    """key, name: the key's entries as an array in the order of their fields."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def spoken_units(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """meeting, spoken: for each document with segments its id, segments (from 0), and whether all their hashes hold."""
    if "meeting" not in segments.columns:
        segments = segments.join(documents.filter("document_type = 'transcript'").select("document_id", "meeting"), "document_id")
    fields = ("ordinal", "speaker_label", "participant_id", "text", "content_hash")
    kept = segments.select("meeting", "document_id", F.struct(*fields).alias("s"), F.coalesce(_hashed(F.col("text")) == F.col("content_hash"), F.lit(False)).alias("holds"))
    parts = kept.groupBy("meeting", "document_id").agg(F.sort_array(F.collect_list("s")).alias("segments"), F.bool_and("holds").alias("holds"))
    return parts.groupBy("meeting").agg(F.collect_list(F.struct("document_id", "segments", "holds")).alias("spoken"))


def trace_bundles(
    meetings: DataFrame, documents: DataFrame, segments: DataFrame, roster: DataFrame, outcomes: DataFrame, votes: DataFrame, series: DataFrame,
    sparse: DataFrame, n_series: int,
) -> tuple[DataFrame, DataFrame]:
    """Bundles of the meetings that keep all rules, and (meeting, problems) of the others.

    roster: meeting, participant_id, display_name, role, is_voter, is_chair. outcomes: meeting, action_class, target_rate,
    target_lower, target_upper. votes: meeting, vote_round, voter_choice. series: series_id, title, units, exactly n_series
    of them, an error otherwise. sparse: the meetings that have no minutes, and must have none. Rules: a document of each
    type once, minutes as said; documents and segments keep their hashes and registered usage and have units; roster,
    outcome and votes are there. Rows with null meetings belong to no bundle. documents: meeting, document_id (once),
    document_type, usage_class, content, content_hash. segments: document_id, ordinal, speaker_label, participant_id, text,
    content_hash, and meeting, if it is known; those of other documents are left out. All parts are grouped and joined by
    meeting, so what is dealt by meeting isn't shuffled. Paragraphs are those of HTML, from 1, segments count from 0.
    """
    allowed = series.select("series_id", "title", "units").limit(n_series + 1).collect()  # a bounded list
    if len(allowed) != n_series:
        raise ValueError(f"the monitors' list has {'more' if len(allowed) > n_series else 'fewer'} than {n_series} series")
    monitors = F.array(*[F.struct(*[F.lit(v).cast("string").alias(k) for k, v in row.asDict().items()]) for row in sorted(allowed)])

    registered = documents.filter(F.col("document_type").isin(list(USAGE)))
    place = F.array_position(F.array(*[F.lit(kind) for kind in USAGE]), F.col("document_type"))
    usage = F.create_map(*[F.lit(v) for pair in USAGE.items() for v in pair])[F.col("document_type")]
    whole = F.coalesce(_hashed(F.col("content")) == F.col("content_hash"), F.lit(False))
    held = registered.groupBy("meeting").agg(
        F.sort_array(F.collect_list(F.struct(place.alias("place"), "document_id", "document_type", "usage_class", "content_hash", "content"))).alias("papers"),
        F.bool_and(whole).alias("hashes"), F.bool_and(F.equal_null("usage_class", usage)).alias("usages"),
    )
    people = _grouped(roster, "meeting", "participants", (~F.col("is_chair")).alias("after_chair"), (~F.col("is_voter")).alias("after_voters"), "display_name", "participant_id", "role")
    choice = lambda c: F.count_if(F.col("voter_choice") == c)
    counted = votes.groupBy("meeting", "vote_round").agg(choice("FOR").alias("for_count"), choice("AGAINST").alias("against_count"))
    rounds = _grouped(counted, "meeting", "vote_rounds", "vote_round", "for_count", "against_count")
    outcome = outcomes.select("meeting", F.struct("action_class", "target_rate", "target_lower", "target_upper").alias("outcome"))
    said = spoken_units(registered, segments)
    joined = meetings.select("meeting").join(held, "meeting", "left").join(said, "meeting", "left").join(sparse.select("meeting", F.lit(True).alias("is_sparse")), "meeting", "left")
    for part in (people, outcome, rounds):
        joined = joined.join(part, "meeting", "left")

    # Pages are read when all parts of a meeting are together: no paragraph is shuffled or sorted.
    written = F.transform("papers", lambda d: F.when(d["document_type"] != "transcript", d["content"]))
    joined = joined.withColumn("texts", html.paragraph_texts(meetings.sparkSession, written))
    types = F.coalesce(F.transform("papers", lambda d: d["document_type"]), F.array().cast("array<string>"))
    own = lambda d: F.get(F.filter("spoken", lambda x: (d["document_type"] == "transcript") & (x["document_id"] == d["document_id"])), F.lit(0))
    numbered = lambda t: F.when(F.size(t) > 0, F.transform(t, lambda x, i: F.struct((i + 1).alias("ordinal"), x.alias("text"))))
    units = F.zip_with("papers", "texts", lambda d, t: F.struct(
        *[d[c].alias(c) for c in ("place", "document_id", "document_type", "usage_class", "content_hash")], numbered(t).alias("paragraphs"), own(d)["segments"].alias("segments")
    ))
    no_units = F.zip_with("papers", "texts", lambda d, t: (F.coalesce(F.size(t), F.lit(0)) < 1) & own(d)["segments"].isNull())
    found = joined.withColumn("is_sparse", F.coalesce("is_sparse", F.lit(False))).withColumn("problems", rule_list({
        "MISSING_DOCUMENT": ~F.array_contains(types, "statement") | ~F.array_contains(types, "transcript"),
        "REPEATED_DOCUMENT": F.size(types) > F.size(F.array_distinct(types)),
        "MINUTES": F.array_contains(types, "minutes") == F.col("is_sparse"),
        "HASH": ~F.col("hashes"), "SEGMENT_HASH": F.exists("papers", lambda d: ~F.coalesce(own(d)["holds"], F.lit(True))),
        "USAGE": ~F.col("usages"), "NO_UNITS": F.exists(no_units, lambda x: x),
        "NO_ROSTER": F.col("participants").isNull(), "NO_OUTCOME": F.col("outcome").isNull(), "NO_VOTES": F.col("vote_rounds").isNull(),
    }))
    bundle = found.filter(F.size("problems") == 0).select("meeting", F.col("is_sparse").alias("sparse_minutes"), units.alias("documents"), "participants", "outcome", "vote_rounds", monitors.alias("monitor_series"))
    hashed = bundle.withColumn("bundle_hash", _hashed(F.to_json(F.struct(*bundle.columns))))
    return hashed, found.filter(F.size("problems") > 0).select("meeting", "problems")


def located_in_bundles(references: DataFrame, bundles: DataFrame) -> DataFrame:
    """references (meeting, document_id, locator, excerpt) with unit, the text that the locator names, and found.

    "transcript segment n" counts from 0 and only in transcripts, "paragraph n" from 1 and only in other documents; blanks
    around a locator are left out. found: the unit holds the excerpt, both with blanks collapsed. Null or unreadable
    locators and unknown documents have a null unit and aren't found. A reference meets its bundle, not all units.
    """
    held = bundles.select("meeting", F.col("documents").alias("__documents"))
    return _located(references.join(held, "meeting", "left"), references.columns)


def located_in_own_bundles(bundles: DataFrame, references: Column) -> DataFrame:
    """located_in_bundles for references of each bundle itself, an array of (document_id, locator, excerpt): a bundle is made once and meets nothing."""
    each = bundles.select("meeting", F.col("documents").alias("__documents"), F.explode_outer(references).alias("r")).filter("r is not null")
    return _located(each.select("meeting", "r.*", "__documents"), ["meeting", "document_id", "locator", "excerpt"])


def _located(held: DataFrame, columns: list[str]) -> DataFrame:
    pattern = f"^({SEGMENT}|{PARAGRAPH})([0-9]{{1,18}})$"
    part = lambda i: F.nullif(F.regexp_extract(F.trim("locator"), pattern, i), F.lit(""))
    kind, number = part(1), part(2).cast("long")
    at = lambda units: F.get(F.filter(units, lambda u: u["ordinal"].cast("long") == F.col("__number")), F.lit(0))["text"]
    document = F.get(F.filter("__documents", lambda d: d["document_id"] == F.col("document_id")), F.lit(0))
    named = held.withColumns({"__kind": kind, "__number": number}).select(*columns, "__kind", "__number", document.alias("__document"))
    unit = F.when(F.col("__kind") == PARAGRAPH, at(F.col("__document.paragraphs"))).when(F.col("__kind") == SEGMENT, at(F.col("__document.segments")))
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    found = F.coalesce(F.contains(flat(F.col("unit")), flat(F.col("excerpt"))), F.lit(False))
    return named.select(*columns, unit.alias("unit")).withColumn("found", found)


def document_completeness(meetings: DataFrame, documents: DataFrame, required: list[str], exceptions: DataFrame, overrides: DataFrame) -> DataFrame:
    """meeting, types (sorted, repeats kept), overridden, complete: the types that each of the meetings has against those it must have.

    documents and overrides: meeting, document_type. An override stands in only where a selected meeting has no document
    of its type. exceptions (meeting, required) replace the common list. Complete is exact: nothing missing, more or twice.
    """
    chosen = meetings.select("meeting")
    added = overrides.select("meeting", "document_type").distinct().join(documents, ["meeting", "document_type"], "left_anti")
    both = documents.select("meeting", "document_type", F.lit(False).alias("added")).unionByName(added.withColumn("added", F.lit(True)))
    counted = both.filter("document_type is not null").groupBy("meeting").agg(
        F.sort_array(F.collect_list("document_type")).alias("types"), F.sort_array(F.collect_list(F.when(F.col("added"), F.col("document_type")))).alias("overridden")
    )
    none = F.array().cast("array<string>")
    wanted = F.coalesce(F.sort_array("required"), F.lit(sorted(required)))
    joined = chosen.join(counted, "meeting", "left").join(exceptions.select("meeting", "required"), "meeting", "left")
    types = F.coalesce("types", none)
    return joined.select("meeting", types.alias("types"), F.coalesce("overridden", none).alias("overridden"), (types == wanted).alias("complete"))


def _number(place: Column) -> Column:
    return F.when(place > 99, place.cast("string")).otherwise(F.lpad(place.cast("string"), 2, "0"))


def _model_id(is_chair: Column, place: Column) -> Column:
    return F.concat(F.when(is_chair, "chair-").otherwise("participant-"), _number(place))


def variant_bundles(cases: DataFrame, evidence: DataFrame, documents: DataFrame, snapshot: DataFrame, variants: list[dict]) -> DataFrame:
    """A model's bundle for each case and variant: meeting, variant, case_id, its parts, leaks and model_hash.

    cases: meeting, meeting_date, bundle_hash, participants (array of participant_id, display_name, is_chair, in order of
    the roster). evidence: meeting, evidence_id, participant_id, text. documents: meeting, document_id, text. snapshot:
    meeting, series_id, value. A variant is {"variant_id": ...} with the flags meeting_date, participant_names,
    economic_snapshot, persona_evidence; what isn't set is false.

    case_id tells nothing of the meeting. A meeting_date variant has only its date. Others have no date; without names,
    members are numbered by their place in the roster, and every text has the names of its own roster taken out; parts
    that a variant doesn't show are empty. leaks: ids and names that are still anywhere in a bundle without names, in any
    case; such a bundle must not be used. Evidence of people outside the roster is left out. Texts are redacted once for
    all variants, in the row of their case, whose roster is there already.
    """
    said = _grouped(evidence, "meeting", "evidence", F.col("evidence_id").cast("string").alias("id"), "participant_id", F.col("text").alias("shown"))
    written = _grouped(documents, "meeting", "documents", F.col("document_id").cast("string").alias("id"), F.col("text").alias("shown"))
    numbers = _grouped(snapshot, "meeting", "snapshot", "series_id", "value")
    whole = cases.join(said, "meeting", "left").join(written, "meeting", "left").join(numbers, "meeting", "left")
    shown = lambda name: F.transform(F.coalesce(name, F.array()), lambda x: x["shown"])
    texts = redacted_in_row(cases.sparkSession, F.concat(shown("evidence"), shown("documents")), F.transform("participants", lambda p: p["display_name"]))
    marked = whole.withColumn("__texts", texts)
    n_said = F.size(F.coalesce("evidence", F.array()))
    seats = F.transform("participants", lambda p, i: F.struct(p["participant_id"].alias("participant_id"), _model_id(p["is_chair"], i + 1).alias("model_id")))
    of = lambda e, i: F.transform(F.filter("__seats", lambda s: (s["participant_id"] == e["participant_id"]) & s["model_id"].isNotNull()), lambda s: F.struct(
        e["id"].alias("id"), e["participant_id"].alias("participant_id"), s["model_id"].alias("model_id"), e["shown"].alias("shown"), F.get("__texts", i).alias("text")
    ))
    paper = lambda d, i: F.struct(d["id"].alias("id"), d["shown"].alias("shown"), F.get("__texts", F.col("__n") + i).alias("text"))
    whole = marked.withColumns({"__seats": seats, "__n": n_said}).withColumns({
        "evidence": F.sort_array(F.flatten(F.transform("evidence", of))), "documents": F.sort_array(F.transform("documents", paper)),
    })

    flags = ("meeting_date", "participant_names", "economic_snapshot", "persona_evidence")
    each = F.explode(F.array(*[F.struct(F.lit(v["variant_id"]).alias("id"), *[F.lit(bool(v.get(f))).alias(f) for f in flags]) for v in variants]))
    rows = whole.withColumn("v", each)
    names, dated = F.col("v.participant_names"), F.col("v.meeting_date")
    shown_if = lambda made, shown: F.coalesce(F.filter(made, lambda _: shown), F.array())

    def person(p: Column, i: Column) -> Column:
        title = F.when(p["is_chair"], "Chair").otherwise(F.concat(F.lit("Participant "), _number(i + 1)))
        return F.struct(
            F.when(names, p["participant_id"]).otherwise(_model_id(p["is_chair"], i + 1)).alias("participant_id"), F.when(names, p["display_name"]).otherwise(title).alias("display_name"), p["is_chair"].alias("is_chair")
        )

    text = lambda x: F.when(names, x["shown"]).otherwise(x["text"]).alias("text")
    model = rows.select(
        "meeting", F.col("v.id").alias("variant"), "v", F.col("participants").alias("__people"),
        F.concat(F.lit("case-"), F.left(_hashed(F.to_json(F.struct("bundle_hash", F.col("v.id").alias("variant_id")))), F.lit(20))).alias("case_id"),
        F.when(dated, F.col("meeting_date")).alias("meeting_date"), shown_if(F.transform("participants", person), ~dated).alias("participants"),
        shown_if(F.col("snapshot"), ~dated & F.col("v.economic_snapshot")).alias("snapshot"),
        shown_if(F.transform("evidence", lambda e: F.struct(F.when(names, e["participant_id"]).otherwise(e["model_id"]).alias("participant_id"), text(e))), ~dated & F.col("v.persona_evidence")).alias("evidence"),
        shown_if(F.transform("documents", lambda d: F.struct(d["id"].alias("document_id"), text(d))), ~dated).alias("documents"),
    )
    parts = ["case_id", "meeting_date", "participants", "snapshot", "evidence", "documents"]
    json = F.to_json(F.struct(*parts))
    terms = F.array_distinct(F.flatten(F.transform("__people", lambda p: F.array(p["participant_id"], p["display_name"]))))
    # held in an array of one, so that a bundle is not written out again for each term
    left = F.flatten(F.transform(F.array(F.lower(json)), lambda j: F.filter(terms, lambda t: (t != "") & F.contains(j, F.lower(t)))))
    leaks = F.when(names | dated, F.array().cast("array<string>")).otherwise(left)
    return model.select("meeting", "variant", *parts, leaks.alias("leaks"), _hashed(json).alias("model_hash"))
