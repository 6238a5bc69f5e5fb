"""Chunking: legislation by parts and sections, handbooks by chapters, headings and appendices.

Acts are cut by expressions. A handbook is one row and its structure is sequential, so it is cut per document by a
UDF: small state, no shuffle. What depends on columns only (prefixes, labels) is expressed over columns.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.fusion import locator, page_text
from tessera.operators.pages import page_range

log = logging.getLogger(__name__)
#: Characters of a piece and of its overlap, separators, thresholds of segments, forms of structure lines. Digits
#: are those of ASCII, as in all patterns here that also run in Java and SQL, which agree on these only.
SIZE, OVERLAP, SEPARATORS = 2400, 480, ("\n\n", "\n", ". ", " ")
RUNT, OVERSIZE, STUB = 600, 4000, 50
PART_LINE, SECTION_LINE = r"\n(?=PART\s+[IVXLCDM]+)", r"\n(?=(?:Section\s+[0-9]+\.?|[0-9]+\.[—–\-]))"
PART_NAME, SECTION_NUMBER = r"(PART\s+[IVXLCDM]+)", r"(?:Section\s+([0-9]+)\.?|([0-9]+)\.[—–\-])"
CHAPTER, INDEX = re.compile(r"^CHAPTER ([0-9]{1,2})$", re.M), re.compile(r"^INDEX$", re.M)
HEADING = re.compile(r"^([0-9]{1,2}(?:\.[0-9]{1,3}){1,3})[^\S\n]+(\S.*)$", re.M)
APPENDIX = re.compile(r"^APPENDIX ([0-9]{1,2}\.[0-9]{1,3})\b\s*(.*)$", re.M)
OPENER, LEADER = re.compile("[A-Z0-9\"'“”‘’]|e[A-Z]"), re.compile(r"\.{3,}")


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters where the separators allow it, each overlapping the one before.

    Cuts are made at the first separator that occurs, which opens the piece after it; longer stretches are cut by the
    separators after that one, and stay whole if there are none.
    """
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    mark, rest = separators[at], separators[at + 1 :]
    stretches = [x for x in re.split(f"(?={re.escape(mark)})", text) if x]
    out: list[str] = []
    first = held = 0  # the window: stretches from the first to the one at hand, and their characters

    def flush(end: int) -> None:
        if whole := "".join(stretches[first:end]).strip():
            out.append(whole)

    for k, s in enumerate(stretches):
        if len(s) >= size:
            flush(k)
            first, held = k + 1, 0
            out.extend(split_text(s, size, overlap, rest) if rest else [s])
            continue
        if first < k and held + len(s) > size:
            flush(k)
            while first < k and (held > overlap or held + len(s) > size):
                held -= len(stretches[first])
                first += 1
        held += len(s)
    flush(len(stretches))
    return out


def split_column(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """split_text of a column, as an array; none of null."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([split_text(t or "", size, overlap) for t in s], dtype=object)

    return F.pandas_udf(run, "array<string>")(text)


def bare(text: Column) -> Column:
    """text without any white space around it, that of Unicode and the separators of ASCII too."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def legislation(text: Column) -> Column:
    """array<struct<section_number, parent_section, body>> of parts and their sections; the whole text if it has none."""
    whole = bare(F.coalesce(text, F.lit("")))
    head = r"(?iUs)\A"

    def sections(part: Column) -> Column:
        parent = F.regexp_extract(part, head + PART_NAME, 1)
        filled = F.filter(F.split(part, "(?iU)" + SECTION_LINE, -1), lambda s: bare(s) != "")
        number = lambda s: F.concat(F.regexp_extract(s, head + SECTION_NUMBER, 1), F.regexp_extract(s, head + SECTION_NUMBER, 2))
        return F.transform(filled, lambda s: F.struct(number(s).alias("section_number"), parent.alias("parent_section"), bare(s).alias("body")))

    found = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "(?iU)" + PART_LINE, -1), sections))
    return F.when(whole != "", found).otherwise(F.array(F.struct(F.lit("").alias("section_number"), F.lit("").alias("parent_section"), whole.alias("body"))))


def pieces_column(bodies: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """For each of an array of texts its pieces: itself, if it is no longer than size."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([[split_text(t, size, overlap) if len(t) > size else [t] for t in ts] for ts in s], dtype=object)

    return F.pandas_udf(run, "array<array<string>>")(bodies)


def chunk_legislation(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(source, title, document_type, section_number, parent_section, chunk_ord, text) of (source, title, document_type,
    text): sections, cut to size, each with a prefix that names its origin. Blank documents give one chunk of their prefix.

    Parts and sections are found by expressions; only the cutting of what is too long runs in Python.
    """
    own = documents.select("source", "title", "document_type", legislation(F.col("text")).alias("s"))
    own = own.withColumn("pieces", pieces_column(F.transform("s", lambda s: s["body"]), size, overlap))
    each = F.flatten(F.zip_with("s", "pieces", lambda s, ps: F.transform(ps, lambda p: F.struct(s["section_number"].alias("section_number"), s["parent_section"].alias("parent_section"), p.alias("text")))))
    own = own.select("source", "title", "document_type", F.posexplode(each).alias("chunk_ord", "c")).select("source", "title", "document_type", "c.section_number", "c.parent_section", "chunk_ord", "c.text")
    return own.withColumn("text", F.concat(legislation_prefix(F.col("title"), F.col("parent_section"), F.col("section_number")), "text"))


def legislation_prefix(title: Column, parent: Column, section: Column) -> Column:
    """[From: title, part, Section n] with a blank; empty parts are left out."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.concat(F.lit("["), F.concat_ws(", ", F.concat(F.lit("From: "), F.coalesce(title, F.lit("Unknown"))), filled(parent), F.concat(F.lit("Section "), filled(section))), F.lit("] "))


@dataclass
class Segment:
    chapter: int
    title: str
    number: str
    heading: str
    intro: bool
    start: int
    end: int

    @property
    def size(self) -> int:
        return self.end - self.start


def _is_heading(m: re.Match | None, chapter: int) -> bool:
    """Whether a heading line belongs to its chapter, has no leading zeros, opens like a title and is no contents line."""
    if not m:
        return False
    parts = m[1].split(".")
    return int(parts[0]) == chapter and all(p == "0" or p[0] != "0" for p in parts) and bool(OPENER.match(m[2])) and not LEADER.search(m[0])


def segments(text: str) -> list[Segment]:
    """An introduction and a segment per heading and appendix of each chapter, up to the index."""
    marks = list(CHAPTER.finditer(text))
    if not marks:
        raise ValueError("no chapter lines")
    numbers = [int(m[1]) for m in marks]
    if any(b <= a for a, b in zip(numbers, numbers[1:], strict=False)):
        log.warning("chapters are not in ascending order: %s", numbers)
    tail = INDEX.search(text, marks[-1].end())
    limit = tail.start() if tail else len(text)
    out: list[Segment] = []
    for k, m in enumerate(marks):
        end = min(limit, marks[k + 1].start() if k + 1 < len(marks) else limit)
        if end <= m.start():
            continue
        chapter, words, at, body = int(m[1]), [], m.end() + (text[m.end() : m.end() + 1] == "\n"), end
        while at < end:
            stop = text.find("\n", at, end)
            line = text[at : stop if stop >= 0 else end]
            if not line.strip() or _is_heading(HEADING.match(line), chapter) or APPENDIX.match(line) or any(c.islower() for c in line) or len(words) == 3:
                body = at
                break
            words.append(line.strip())
            at += len(line) + 1
        title = " ".join(w.capitalize() for w in " ".join(words).split())
        cuts = [(h.start(), h[1], h[2].strip()) for h in HEADING.finditer(text, body) if h.start() < end and _is_heading(h, chapter)]
        for a in APPENDIX.finditer(text, body):
            if a.start() < end:
                later = (x.strip() for x in text[a.end() : end].split("\n"))
                cuts.append((a.start(), f"APPENDIX {a[1]}", a[2].strip() or next((x for x in later if x), "")))
        cuts.sort(key=lambda c: c[0])
        edges = [c[0] for c in cuts] + [end]
        out.append(Segment(chapter, title, "", title, True, m.start(), edges[0]))
        out += [Segment(chapter, title, n, h, False, s, e) for (s, n, h), e in zip(cuts, edges[1:], strict=True)]
    return out


def reconciled(found: list[Segment]) -> list[Segment]:
    """Segments after merging: appendix stubs backward, runts forward into what they lead to, last runts backward.

    Nothing crosses a chapter.
    """
    kept: list[Segment] = []
    for s in found:
        if kept and s.number.startswith("APPENDIX") and s.size < STUB and kept[-1].chapter == s.chapter:
            kept[-1].end = s.end
        else:
            kept.append(s)
    ahead: list[Segment] = []
    for s in kept:
        last = ahead[-1] if ahead else None
        if last and last.chapter == s.chapter and last.size < RUNT and (last.intro or last.number and s.number.startswith(last.number + ".")):
            if last.intro:
                last.number, last.heading, last.intro = s.number, s.heading, False
            last.end = s.end
        else:
            ahead.append(s)
    out: list[Segment] = []
    for k, s in enumerate(ahead):
        out.append(s)
        if k + 1 == len(ahead) or ahead[k + 1].chapter != s.chapter:
            while len(out) > 1 and out[-1].size < RUNT and out[-2].chapter == out[-1].chapter:
                last = out.pop()
                out[-1].end = last.end
    return out


def located(text: str, s: Segment) -> Iterator[tuple[str, int, int]]:
    """(piece, start, end) of a segment: itself, or its pieces where it is oversize; a piece that is not found has the
    segment's range."""
    body = text[s.start : s.end]
    if len(body) <= OVERSIZE:
        yield body.strip(), s.start, s.end
        return
    cursor = s.start
    for piece in split_text(body):
        at = text.find(piece, cursor, s.end)
        if at < 0:
            at = text.find(piece, s.start, s.end)
        if at < 0:
            yield piece, s.start, s.end
        else:
            yield piece, at, at + len(piece)
            cursor = max(at + 1, at + len(piece) - OVERLAP)


def display_title(name: Column) -> Column:
    """A file name without its extension, underscores as blanks."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "_", " ")), F.lit("")), F.lit("Document"))


PIECES = "array<struct<chunk_ord:int,chapter_number:int,chapter_title:string,section_number:string,heading:string,body:string,char_start:int,char_end:int>>"


def handbook_pieces(text: Column) -> Column:
    """The chunks of a handbook's text, in order; a text without chapter lines is an error."""

    def made(text: str) -> list[tuple]:
        cut = ((s, *x) for s in reconciled(segments(text)) for x in located(text, s))
        return [(k, s.chapter, s.title, s.number, s.heading, body, a, b) for k, (s, body, a, b) in enumerate(cut) if body]

    return F.udf(made, PIECES, useArrow=False)(text)  # a few rows at a time: nested rows cost more by Arrow


def chunk_handbook(documents: DataFrame) -> DataFrame:
    """Chunks of (source, title, document_type, clean_text, page_map): section, chapter, heading, pages and prefixed text.

    A document's page map stays with it, so that several documents of one source do not mix. One without chapter lines is an error.
    """
    own = documents.select("source", "title", "document_type", "page_map", F.explode(handbook_pieces(F.col("clean_text"))).alias("c")).select("source", "title", "document_type", "page_map", "c.*")
    first, last = page_range(F.col("page_map"), F.col("char_start"), F.col("char_end"))
    own = own.withColumns({"page_start": first, "page_end": last})
    return own.select("source", "title", "document_type", "chunk_ord", "chapter_number", "chapter_title", "section_number", "heading", "page_start", "page_end", F.concat(handbook_prefix(), "body").alias("text"))


def handbook_prefix() -> Column:
    """[Title, Ch.N Chapter Title, para X, pages] with a blank; empty parts are left out."""
    filled = lambda c: F.nullif(c, F.lit(""))
    chapter = F.concat(F.lit("Ch."), F.col("chapter_number").cast("string"), F.coalesce(F.concat(F.lit(" "), filled(F.col("chapter_title"))), F.lit("")))
    return F.concat(F.lit("["), F.concat_ws(", ", display_title(F.col("title")), chapter, locator(F.col("section_number")), filled(page_text(F.col("page_start"), F.col("page_end")))), F.lit("] "))
