"""Paragraphs, line blocks and links of HTML pages, by a tokenizer in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workers import ship_package

_PAGE_COLUMNS = ["page_id", "url", "html"]
#: Pages of bare paragraphs without entities or other tags, which need no parser, and a paragraph of them.
_PLAIN, _PLAIN_PARAGRAPH = r"(?:</?html>|</?body>|<p>[^<&]*</p>)*", r"<p>([^<&]*)</p>"
#: Tags without attributes that only set text apart; pages of these, of paragraphs and of line breaks are cut without a parser too.
_SETTING = r"</?(?:html|body|div|span|strong|b|em|i|u|table|tbody|tr|td|th|ul|ol|li|h[1-6])>"
_BREAK = r"<br ?/?>"
_SIMPLE = rf"(?:{_SETTING}|</?p>|{_BREAK}|[^<&]+)*"


def _extractor():
    """A parser class; made where it is used, so that workers need nothing but the standard library."""

    class Paragraphs(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.done: list[list[str]] = []
            self.lines: list[str] | None = None
            self.hrefs: list[str] = []

        def _flush(self) -> None:
            if self.lines is not None:
                self.done.append([" ".join(line.split()) for line in self.lines])
            self.lines = None

        def handle_starttag(self, tag, attrs):
            if tag == "p":
                self._flush()
                self.lines = [""]
            elif tag == "br" and self.lines is not None:
                self.lines.append("")
            elif tag == "a":
                self.hrefs += [v for k, v in attrs if k == "href" and v]

        def handle_endtag(self, tag):
            if tag == "p":
                self._flush()

        def handle_data(self, data):
            if self.lines is not None:
                self.lines[-1] += data

    return Paragraphs


def _paragraph_reader():
    """A function from a page to the lines of its paragraphs, as the parser class has them in `done`; the last one also if unclosed where `whole`."""
    simple, setting, line_break, parser_class = re.compile(_SIMPLE), re.compile(_SETTING), re.compile(_BREAK), _extractor()

    def read(page: str, whole: bool = False) -> list[list[str]]:
        if not simple.fullmatch(page):
            parser = parser_class()
            parser.feed(page)
            if whole:
                parser._flush()
            return parser.done
        bodies = setting.sub("", page).split("<p>")[1:]
        if bodies and not whole and "</p>" not in bodies[-1]:
            bodies.pop()
        return [[" ".join(line.split()) for line in line_break.split(body.partition("</p>")[0])] for body in bodies]

    return read


def _parsed(batch: pd.DataFrame):
    parser_class = _extractor()
    for page_id, url, html in zip(*(batch[c] for c in _PAGE_COLUMNS), strict=True):
        parser = parser_class()
        parser.feed(html or "")
        yield page_id, url, parser


def paragraph_texts(spark: SparkSession, pages: Column) -> Column:
    """An array of pages as the arrays of their closed, non-empty paragraphs, null for null; a row is read once and stays a row."""
    ship_package(spark)

    def scan(rows: pd.Series) -> pd.Series:
        plain, paragraph, read = re.compile(_PLAIN), re.compile(_PLAIN_PARAGRAPH), _paragraph_reader()

        def texts(page: str | None) -> list[str] | None:
            if page is None:
                return None
            if plain.fullmatch(page):
                found = paragraph.findall(page)
            else:
                found = [" ".join(lines) for lines in read(page)]
            return [t for t in (" ".join(x.split()) for x in found) if t]

        return pd.Series([None if row is None else [texts(page) for page in row] for row in rows], dtype=object)

    # Filters on what is read would be pushed below it and read the pages again, were it not marked so.
    return F.pandas_udf(scan, "array<array<string>>").asNondeterministic()(pages)


def paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, ordinal (from 1), text of the closed, non-empty paragraphs; a line break is a space."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, _, parser in _parsed(batch):
                texts = [" ".join(" ".join(lines).split()) for lines in parser.done]
                rows += [(page_id, i + 1, text) for i, text in enumerate(t for t in texts if t)]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "text"])

    ship_package(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select(*_PAGE_COLUMNS).mapInPandas(scan, f"page_id {kind}, ordinal int, text string")


def line_blocks(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, lines of the paragraphs split at line breaks; an unclosed last one counts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, _, parser in _parsed(batch):
                parser._flush()
                blocks = [[line for line in lines if line] for lines in parser.done]
                rows += [(page_id, i + 1, lines) for i, lines in enumerate(b for b in blocks if b)]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "lines"])

    ship_package(pages.sparkSession)
    return pages.select(*_PAGE_COLUMNS).mapInPandas(scan, "page_id long, ordinal int, lines array<string>")


def links(pages: DataFrame) -> DataFrame:
    """page_id, link: absolute links of a page's own host without query and fragment, distinct."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, parser in _parsed(batch):
                found = (urlsplit(urljoin(url or "", href)) for href in parser.hrefs)
                own = urlsplit(url or "").netloc
                rows += [(page_id, link) for link in sorted({f"{u.scheme}://{u.netloc}{u.path}" for u in found if u.netloc == own and own})]
            yield pd.DataFrame(rows, columns=["page_id", "link"])

    ship_package(pages.sparkSession)
    return pages.select(*_PAGE_COLUMNS).mapInPandas(scan, "page_id long, link string")


#: Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _block_parser():
    class Blocks(HTMLParser):
        """Elements with their text, in order of their start: (place, tag, marks, within, text, href)."""

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open: list[tuple[int, str, list[str], list[str], list[str], str | None]] = []
            self.rows: list[tuple[int, str, list[str], list[str], str, str | None]] = []
            self.place = 0

        def _close(self) -> None:
            place, tag, marks, within, parts, href = self.open.pop()
            self.rows.append((place, tag, marks, within, " ".join("".join(parts).split()), href))

        def handle_starttag(self, tag, attrs):
            given = {k: v or "" for k, v in attrs}
            marks = [f".{c}" for c in given.get("class", "").lower().split()]
            marks += [f"#{given['id'].lower()}"] if given.get("id") else []
            within = [x for frame in self.open for x in (frame[1], *frame[2])]
            self.place += 1
            if tag == "br":
                self.handle_data(" ")
            elif tag == "meta":
                keys = [f"@{given[k].lower()}" for k in ("property", "name", "itemprop") if given.get(k)]
                self.rows.append((self.place, tag, keys, within, " ".join(given.get("content", "").split()), None))
            elif tag in _VOID:
                self.rows.append((self.place, tag, marks, within, "", None))
            else:
                if tag == "p" and self.open and self.open[-1][1] == "p":
                    self._close()
                self.open.append((self.place, tag, marks, within, [], given.get("href")))

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in _VOID:
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            if any(frame[1] == tag for frame in self.open):
                while self.open[-1][1] != tag:
                    self._close()
                self._close()

        def handle_data(self, data):
            for frame in self.open:
                frame[4].append(data)

    return Blocks


def blocks(pages: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """page_id, place, tag, marks (.class, #id; @key of meta tags), within (tags and marks around it), text, href.

    One row an element that is closed, in order of its start; elements inside p, li and headings give their text to these
    too. What an article holds is then chosen by filters over the rows. Columns of a page named in `kept` (strings) come
    with each row, so that rows need no join with their pages; a page without elements then has one row with place 0.
    """
    wanted = frozenset("h1 h2 h3 p li div span a hr meta".split())
    own = ["page_id", *kept]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser_class = _block_parser()
        for batch in batches:
            rows = []
            for *page, html in zip(*(batch[c] for c in [*own, "html"]), strict=True):
                parser = parser_class()
                parser.feed(html or "")
                found = [(*page, *row) for row in parser.rows if row[1] in wanted]
                rows += found if found or not kept else [(*page, 0, None, None, None, None, None)]
            yield pd.DataFrame(rows, columns=[*own, "place", "tag", "marks", "within", "text", "href"])

    ship_package(pages.sparkSession)
    schema = ", ".join(["page_id long", *(f"{c} string" for c in kept), "place int, tag string, marks array<string>, within array<string>, text string, href string"])
    return pages.select(*own, "html").mapInPandas(scan, schema)


def _visible_lines():
    class Lines(HTMLParser):
        """Lines of visible text after the mark of a list of participants."""

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.part: list[str] | None = None
            self.lines: list[str] = []

        def flush(self) -> None:
            if self.part is not None:
                line = " ".join("".join(self.part).split())
                self.lines += [line] if line else []
                self.part = []

        def handle_data(self, data):
            word = " ".join(data.split())
            if self.part is not None:
                self.part.append(data)
            elif word.rstrip(":").lower() in ("present", "attendance"):
                self.lines.append(word)
                self.part = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.flush()

        def handle_endtag(self, tag):
            if tag in ("p", "td", "tr"):
                self.flush()

    return Lines


def attendance_blocks(spark: SparkSession, page: Column) -> Column:
    """A page as the line blocks with the list of participants; a null page has none, and a row is read once and stays a row.

    Paragraphs as they are where one begins with the mark; else the lines of visible text after it, members (with an
    honorific) as one block and groups as blocks of their own, up to the first of the staff. No blocks where there is no mark.
    """
    ship_package(spark)
    staff, groups = (", secretary", ", general counsel", ", economist"), ("alternate members of", "presidents of the federal reserve banks")

    def scan(pages: pd.Series) -> pd.Series:
        read, simple, part, lines_class = _paragraph_reader(), re.compile(_SIMPLE), re.compile("<[^>]+>|[^<]+"), _visible_lines()

        def of_page(html: str) -> list[list[str]]:
            found = [[line for line in lines if line] for lines in read(html, whole=True)]
            found = [b for b in found if b]
            if any(b[0].rstrip(":").lower() in ("present", "attendance") for b in found):
                return found
            visible = lines_class()
            if simple.fullmatch(html):
                for piece in part.findall(html):
                    if piece[0] != "<":
                        visible.handle_data(piece)
                    elif piece[1] == "/":
                        visible.handle_endtag(piece[2:-1])
                    else:
                        visible.handle_starttag(piece[1:-1].rstrip(" /"), [])
            else:
                visible.feed(html)
            visible.flush()
            members, others = [], []
            for line in visible.lines[1:]:
                low = line.lower()
                if any(mark in low for mark in staff):
                    break
                if any(mark in low for mark in groups):
                    others.append([line])
                elif line.startswith(("Mr.", "Ms.", "Mrs.", "Dr.")):
                    members.append(line)
            return [[visible.lines[0]], members, *others] if members else []

        return pd.Series([of_page(html or "") for html in pages], dtype=object)

    return F.pandas_udf(scan, "array<array<string>>").asNondeterministic()(page)
