"""Articles from pages: what is title, date, speaker and body on each kind of site, and their ingest as communications."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions.text import slug
from .minutes import clean_paragraph


@dataclass(frozen=True)
class Site:
    """Where a kind of site keeps the parts of an article: marks are .class, #id, or @key for meta tags; "" is any."""

    inside: str = ""
    title: tuple[str, str] = ("h1", "")
    date: tuple[str, str] = ("p", "")
    speaker: tuple[str, str] = ("p", "")
    body: tuple[str, ...] = ("p", "li", "h2", "h3")
    body_inside: str = ""
    not_body: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    until: tuple[str, str] = ("", "")
    dates: tuple[str, ...] = ("MMMM d, yyyy", "MMMM dd, yyyy")
    one_speaker: str | None = None
    document: tuple[str, str] | None = None  # part of a link's path, words of the link


_REGIONAL = ("footnote", "related", "subscribe", "profile", "share")
#: Marks and date forms of the sites.
SITES = {
    "board": Site(
        inside="#article", title=("h3", ""), date=("p", ".article__time"), speaker=("p", ".speaker"), body=("p",), not_body=(".article__time", ".speaker", ".location"),
        excluded=("footnote", "share", "related", "lastupdate"), until=("hr", ""),
    ),
    "dallas": Site(
        inside=".dal-main-content", title=("h1", ".dal-headline"), date=("", ".dal-content-date"), speaker=("div", ".dal-crouton"), body=("p",),
        not_body=(".dal-content-date",), excluded=_REGIONAL,
    ),
    "chicago": Site(title=("h1", ""), date=("", ".cfeddetail__lastupdated"), body_inside=".cfedcontent__text", dates=("M/d/yy", "M/d/yyyy"), one_speaker="Resident Speaker"),
    "boston": Site(title=("meta", "@name"), date=("meta", "@article:published_time"), speaker=("a", ".byline-link"), body=(), dates=(), document=("/documents/speeches/pdf/", "full-text")),
    "san_francisco": Site(
        title=("h1", ".wp-block-post-title"), date=("meta", "@article:published_time"), speaker=("meta", "@parsely-author"), body_inside=".entry-content",
        until=("", ".sffed-associated-people__heading--in-content-flow"), dates=(),
    ),
    "richmond": Site(title=("meta", "@citation_title"), date=("meta", "@citation_publication_date"), speaker=("meta", "@citation_author"), body_inside=".tmplt__content", dates=("yyyy/MM/dd",)),
}


def _is(tag: str, mark: str) -> Column:
    conditions = [F.col("tag") == tag] if tag else []
    conditions += [F.array_contains("marks", mark)] if mark else []
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _part(site: Site) -> Column:
    """title, date, speaker, document, end or body, null for what is none of these."""
    inside = F.array_contains("within", site.inside) if site.inside else F.lit(True)
    marked = lambda names: F.exists(F.concat("marks", "within"), lambda m: reduce(lambda a, b: a | b, [F.startswith(m, F.lit(".")) & F.contains(m, F.lit(n)) for n in names], F.lit(False)))
    free = ~marked(site.excluded) if site.excluded else F.lit(True)
    where = F.array_contains("within", site.body_inside) if site.body_inside else inside
    outermost = ~F.arrays_overlap("within", F.array(*[F.lit(t) for t in site.body])) if site.body else F.lit(False)
    body = F.col("tag").isin(*site.body) & where & free & outermost & ~reduce(lambda a, b: a | b, [F.array_contains("marks", m) for m in site.not_body], F.lit(False))
    kind = F.when(_is(*site.title) & inside & free, "title").when(_is(*site.date) & inside & free, "date")
    if site.one_speaker is None:
        kind = kind.when(_is(*site.speaker) & inside & free, "speaker")
    if site.document:
        kind = kind.when((F.col("tag") == "a") & F.contains(F.lower("href"), F.lit(site.document[0])) & F.contains(F.lower("text"), F.lit(site.document[1])), "document")
    if any(site.until):
        kind = kind.when(_is(*site.until) & inside, "end")
    return kind.when(body, "body") if site.body else kind


def _by_site(parts: dict[str, Column]) -> Column:
    return reduce(lambda other, kv: F.when(F.col("site") == kv[0], kv[1]).otherwise(other), parts.items(), F.lit(None))


def articles(pages: DataFrame, sites: dict[str, Site] = SITES) -> DataFrame:
    """page_id, site, title, published, speaker, paragraphs, document_url, missing from pages (page_id, site, url, html; an id once).

    Years of two digits lie between 1969 and 2068. The last of several titles, dates and speakers counts. A date that a page lacks is read from a slug of six digits at
    the end of its link. Body is what comes after the title and before the end's mark. `missing` lists what an article
    should have and has not; such rows are the rejects of an ingest.
    """
    kind = _by_site({name: _part(site) for name, site in sites.items()})
    rows = html.blocks(pages, ("site", "url")).withColumn("kind", kind).withColumn("kind", F.when((F.col("text") != "") | (F.col("kind") == "end"), F.col("kind")))
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("text")), F.when(F.col("kind") == k, F.col("place")))
    listed = F.sort_array(F.collect_list(F.when(F.col("kind") == "body", F.struct("place", "text"))))
    whole = rows.groupBy("page_id", "site", "url").agg(
        last("title").alias("title"), last("date").alias("date_text"), last("speaker").alias("speaker"), F.when(F.count("kind") > 0, listed).alias("body"),
        F.min(F.when(F.col("kind") == "title", F.col("place"))).alias("title_at"), F.min(F.when(F.col("kind") == "end", F.col("place"))).alias("end_at"),
        F.max_by(F.when(F.col("kind") == "document", F.col("href")), F.when(F.col("kind") == "document", F.col("place"))).alias("document_href"),
    )
    token = F.regexp_replace("date_text", "(?i)^Last Updated: *", "")
    forms = sorted({form for site in sites.values() for form in site.dates})
    written = F.coalesce(*[F.try_to_date(token, form) for form in forms], F.try_to_date(F.left("date_text", F.lit(10)), "yyyy-MM-dd"))
    read = F.coalesce(written, F.try_to_date(F.regexp_extract("url", r"(\d{6})/?$", 1), "yyMMdd"))
    dated = F.when(F.year(read) >= 2069, F.add_months(read, -1200)).otherwise(read)  # years of two digits from 1969 on
    alone = _by_site({name: F.lit(site.one_speaker) for name, site in sites.items()})
    body = F.filter("body", lambda b: (b["place"] > F.coalesce("title_at", F.lit(0))) & (F.col("end_at").isNull() | (b["place"] < F.col("end_at"))))
    by_meta = _by_site({name: F.lit(site.title[0] == "meta") for name, site in sites.items()})
    link = F.regexp_replace("document_href", r"[?#].*$", "")
    out = whole.select(
        "page_id", "site", "url", "title", dated.alias("published"), F.coalesce(alone, F.regexp_replace("speaker", "^Speech by ", "")).alias("speaker"),
        F.transform(F.when(by_meta, F.col("body")).otherwise(body), lambda b: b["text"]).alias("paragraphs"),
        F.when(F.startswith(link, F.lit("/")), F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), link)).otherwise(link).alias("document_url"),
    )
    needs_link = _by_site({name: F.lit(site.document is not None) for name, site in sites.items()})
    lacks = {
        "date": F.col("published").isNull(), "speaker": F.col("speaker").isNull(), "title": F.col("title").isNull(),
        "document": needs_link & F.col("document_url").isNull(), "body": ~needs_link & (F.coalesce(F.size("paragraphs"), F.lit(0)) == 0),
    }
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in lacks.items()])))


#: Terms that make a communication one about policy.
POLICY_TERMS = ("monetary policy", "economic outlook", "inflation", "price stability", "maximum employment", "employment", "labor market", "federal funds rate", "dual mandate")


def policy_score(title: Column, text: Column) -> Column:
    """Four for each term in the title and up to five for each in the text; terms count inside words too."""
    count = lambda c, t: F.floor((F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t))
    head, body = F.lower(clean_paragraph(title)), F.lower(clean_paragraph(text))
    return reduce(lambda a, b: a + b, [4 * count(head, t) + F.least(F.lit(5), count(body, t)) for t in POLICY_TERMS]).cast("int")


def ingested(found: DataFrame, people: DataFrame) -> DataFrame:
    """page_id, site, document_id, participant, published, title, score, status from articles and people (id, name).

    Status is INGESTED, INCOMPLETE for articles that lack a part, or UNMATCHED where the speaker is not one person: the
    whole name at the label's end, else a surname that one person has.
    """
    surname = lambda c: F.lower(F.regexp_extract(c, r"(\S+?)[.]?$", 1))
    exact = people.select(F.lower("name").alias("label"), F.col("id").alias("exact_id"))
    unique = people.groupBy(surname(F.col("name")).alias("surname")).agg(F.min("id").alias("surname_id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    text = F.array_join("paragraphs", "\n")
    keyed = found.withColumns({"label": F.lower(clean_paragraph(F.col("speaker"))), "surname": surname(clean_paragraph(F.col("speaker")))})
    matched = keyed.join(exact, "label", "left").join(unique, "surname", "left").withColumn("participant", F.coalesce("exact_id", "surname_id"))
    status = F.when(F.size("missing") > 0, "INCOMPLETE").when(F.col("participant").isNull(), "UNMATCHED").otherwise("INGESTED")
    content = F.sha2(F.concat_ws("\n", "title", text).cast("binary"), 256)
    return matched.select(
        "page_id", "site", F.concat(F.lit("doc-"), F.left(content, F.lit(24))).alias("document_id"), "participant", slug(F.col("speaker")).alias("speaker_id"),
        F.date_format("published", "yyyy-MM-dd'T23:59:59Z'").alias("published_at"), "title", policy_score(F.col("title"), text).alias("score"), status.alias("status"),
    )
