"""Column functions over texts: cleaning, tokens, names, cues, extraction, redaction and excerpts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words left out of the index.
STOP_WORDS = (
    "the a an of to in and or for on at by with that this it as is are was were be been from has have had not but their they its would will "
    "which more than also these those such over under about into committee federal open market reserve percent participants members meeting "
    "policy other some most many few noted said continued remained however while although there here what when who whom been being can could should"
).split()
#: Typographic characters and their plain forms.
PUNCTUATION = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2011": "-", "\u00a0": " "}


def cleaned(text: Column) -> Column:
    """Plain punctuation, C1 controls as dashes, blanks collapsed, trimmed."""
    plain = F.translate(text, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[\u0080-\u009f]", "-"), "[ \\t\\n\\x0b\\f\\r]+", " "))


def collapsed(text: Column) -> Column:
    """White space, no-break spaces and soft hyphens as one space."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\x0b\\f\\r\u00a0\u00ad]+", " "))


def stemmed(word: Column) -> Column:
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when((n > 5) & word.endswith("ing"), cut(3))
        .when((n > 5) & word.endswith("ed"), cut(2))
        .when((n > 4) & word.endswith("es"), cut(2))
        .when((n > 4) & word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def terms(text: Column) -> Column:
    """Index terms of a text: words a-z of three letters or more that are no stop words, stemmed."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))
    return F.transform(kept, stemmed)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def surname(name: Column) -> Column:
    """Last word of a name that is no generational suffix."""
    words = F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.element_at(F.filter(words, lambda w: ~w.isin("Jr", "Sr", "II", "III", "IV")), -1)


def tag_labels(text: Column, tags: dict[str, str]) -> Column:
    """Labels of the patterns (case-insensitive) that a text matches, in the order given."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(label)) for label, p in tags.items()]))


def cue_score(text: Column, cues: dict[str, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(text.rlike(f"(?i){p}"), w).otherwise(0) for p, w in cues.items()])


def mixed_fraction(token: Column) -> Column:
    """Number of 3-1/2, 1/4, 2 or 2.5."""
    whole = F.regexp_extract(token, r"^(\d+(?:\.\d+)?)(?:$|-)", 1)
    over, under = F.regexp_extract(token, r"(\d+)/(\d+)$", 1), F.regexp_extract(token, r"(\d+)/(\d+)$", 2)
    number = lambda c: F.when(c == "", 0.0).otherwise(F.expr("1.0D") * c.cast("double"))
    return number(whole) + F.when(under == "", 0.0).otherwise(F.try_divide(number(over), number(under)))


def whole_word_count(text: Column, term: str) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w == term))


def relevance(title: Column, text: Column, words: list[str]) -> Column:
    """Four for each word in the title, and up to five for each in the text."""
    parts = [4 * whole_word_count(title, w) + F.least(F.lit(5), whole_word_count(text, w)) for w in words]
    return reduce(lambda a, b: a + b, parts)


def excerpt(text: Column, topics: list[str], lead: int = 5, size: int = 20) -> Column:
    """`size` words around the earliest topic word, with ellipses where text is left out."""
    words = F.split(F.trim(F.regexp_replace(text, "[ \\t\\n\\x0b\\f\\r]+", " ")), " ")
    found = [F.nullif(F.array_position(F.transform(words, lambda w: F.lower(w)), t), F.lit(0)) for t in topics]
    first = F.greatest(F.coalesce(F.least(*found), F.lit(1)) - lead, F.lit(1)).cast("int")
    body = F.array_join(F.slice(words, first, F.lit(size)), " ")
    return F.concat(F.when(first > 1, "... ").otherwise(""), body, F.when(first + size <= F.size(words), " ...").otherwise(""))


def redacted(text: Column, names: list[str], mark: str = "[MEMBER]") -> Column:
    """Names, longest first and in any case, as whole words replaced by a mark."""
    pattern = "|".join(sorted(names, key=lambda n: (-len(n), n)))
    return F.regexp_replace(text, rf"(?i)\b(?:{pattern})\b", mark)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def speaker_segments(text: Column, pattern: str) -> Column:
    """array<struct<speaker, body>> of a transcript; text before the first speaker and empty bodies are left out."""
    speakers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    bodies = F.slice(F.split(text, pattern), 2, F.size(speakers))
    pairs = F.zip_with(speakers, bodies, lambda a, b: F.struct(a.alias("speaker"), F.trim(b).alias("body")))
    return F.filter(pairs, lambda p: p["body"] != "")


def logit_probabilities(score: Column, cuts: tuple[float, float]) -> list[Column]:
    """Probabilities of the three classes of an ordered logit."""
    low, high = (1 / (1 + F.exp(score - c)) for c in cuts)
    return [low, high - low, 1 - high]


def blended(p: list[Column], q: list[Column], w: float) -> list[Column]:
    """Geometric blend of two distributions, summing to 1."""
    raw = [F.pow(a, F.lit(1 - w)) * F.pow(b, F.lit(w)) for a, b in zip(p, q, strict=True)]
    total = reduce(lambda a, b: a + b, raw)
    return [x / total for x in raw]


def tiered_cost(tokens: Column, cached: Column, threshold: int, short: tuple[float, float], long: tuple[float, float]) -> Column:
    """Price of tokens by the card for short or long contexts: (fresh, cached) a million."""
    fresh = F.greatest(F.lit(0), tokens - cached)
    price = lambda card: (fresh * card[0] + cached * card[1]) / 1e6
    return F.when(tokens > threshold, price(long)).otherwise(price(short))


def usage_cost(tokens: Column, cached: Column, written: Column, output: Column, threshold: int, short: dict[str, float], long: dict[str, float]) -> Column:
    """Price of a call by the card of its context's length: input, cached_input, cache_write and output a million tokens.

    Input that was neither read from the cache nor written to it is fresh, and never below none.
    """
    fresh = F.greatest(F.lit(0), tokens - cached - written)
    price = lambda card: (fresh * card["input"] + cached * card["cached_input"] + written * card["cache_write"] + output * card["output"]) / 1e6
    return F.when(tokens > threshold, price(long)).otherwise(price(short))


def calendar_meetings(headings: DataFrame) -> DataFrame:
    """page_id, meeting_id, start_day, end_day, cutoff from calendar headings (page_id, heading).

    Shapes: "January 29-30 Meeting - 2013", "April/May 30-1 ..." and "April 30 - May 1 ... - 2013"; a last month before
    the first is the next year's. Headings of no meeting, and calls, cancelled meetings and notation votes, are left out;
    a meeting that can't be read keeps null days.
    """
    low = F.lower("heading")
    wanted = F.contains(low, F.lit("meeting")) & ~low.rlike("conference call|cancelled|notation vote")
    part = lambda pattern, i: F.nullif(F.regexp_extract("heading", pattern, i), F.lit(""))
    two = r"^([A-Za-z]+)\s+(\d{1,2})\s*-\s*([A-Za-z]+)\s+(\d{1,2}).*?-\s*(\d{4})$"
    one = r"^([A-Za-z]+)(?:/([A-Za-z]+))?\s+(\d{1,2})(?:\s*-\s*(\d{1,2}))?.*?-\s*(\d{4})$"
    month, day, year = F.coalesce(part(two, 1), part(one, 1)), F.coalesce(part(two, 2), part(one, 3)), F.coalesce(part(two, 5), part(one, 5)).cast("int")
    last_month, last_day = F.coalesce(part(two, 3), part(one, 2), month), F.coalesce(part(two, 4), part(one, 4), day)
    of = lambda y, m, n: F.try_to_date(F.concat_ws(" ", y.cast("string"), m, n), "yyyy MMMM d")
    start, end = of(year, month, day), of(year, last_month, last_day)
    read = headings.filter(wanted).select("page_id", start.alias("start_day"), F.when(end < start, of(year + 1, last_month, last_day)).otherwise(end).alias("end_day"))
    return read.select("page_id", F.concat(F.lit("FOMC-"), F.col("start_day").cast("string")).alias("meeting_id"), "start_day", "end_day", F.date_sub("start_day", 1).alias("cutoff"))
