"""HTML pages to text: a tokenizer with a stack of open elements, run over pages."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that are dropped with their content (fixed values).
DROPPED = frozenset({"script", "style", "nav", "footer", "header"})
#: Elements without content, and those whose content is text up to their end tag (fixed values of HTML).
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})
#: A comment, a declaration, or a tag: its slash, name, and attributes, in which quotes hide what would end it. Unfinished ones reach to the end and count for nothing.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z)""",
    re.S | re.I,
)
PARSED = "title string, heading string, text string"


def parse(page: str | None) -> tuple[str | None, str | None, str]:
    """(title, heading, text): of the first title and the first h1 element, null where there is none, and of the body.

    An element ends with its end tag or with that of an element around it; an end tag of nothing open is passed over. Text
    of dropped elements, templates and comments is left out; character references are written out, also without a semicolon
    where HTML allows it. Without a body, or if a dropped element holds it, all text counts. Each run of text begins a line;
    lines are stripped, and blank ones left out.
    """
    page = page or ""
    stack: list[str] = []
    open_: Counter[str] = Counter()
    dropped = hidden = body = 0  # how deep in dropped elements, in templates; the height of the body's place in the stack
    every: list[str] = []
    inside: list[str] | None = None
    title: list[str] | None = None
    heading: list[str] | None = None
    in_heading = 0
    at = 0

    def text(run: str) -> None:
        if not run or hidden:
            return
        run = references.unescape(run)
        if in_heading and stack[-1] not in ("script", "style"):
            heading.append(run.strip())
        if not dropped:
            every.append(run)
            if body:
                inside.append(run)

    def closed(height: int) -> None:
        nonlocal dropped, hidden, body, in_heading
        while len(stack) > height:
            name = stack.pop()
            open_[name] -= 1
            dropped -= name in DROPPED
            hidden -= name == "template"
            body *= len(stack) >= body
            in_heading *= len(stack) >= in_heading

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name or page[at - 1] != ">":
            continue
        if m[1]:
            if open_[name]:
                height = len(stack) - 1
                while stack[height] != name:
                    height -= 1
                closed(height)
            continue
        if name in VOID:
            continue
        stack.append(name)
        open_[name] += 1
        dropped += name in DROPPED
        hidden += name == "template"
        if name == "body" and inside is None and not dropped:
            inside, body = [], len(stack)
        if name == "h1" and heading is None:
            heading, in_heading = [], len(stack)
        if m[3].endswith("/"):
            if name == "title" and title is None:
                title = []
            closed(len(stack) - 1)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            run, at = page[at : end.start() if end else len(page)], end.start() if end else len(page)
            if name == "title" and title is None:
                title = [references.unescape(run).strip()]
            text(run)
    text(page[at:])
    lines = [x.strip() for run in (every if inside is None else inside) for x in run.splitlines()]
    joined = lambda parts: None if parts is None else "".join(parts)
    return joined(title), joined(heading), "\n".join(x for x in lines if x)


def parsed(html: Column) -> Column:
    """struct(title, heading, text) of a page; see parse. Pages go to Python a few at a time, as rows: Arrow would take 64 MB of
    them together, which a worker would hold several times over."""
    return F.udf(parse, PARSED, useArrow=False)(html)


def load(pages: DataFrame, document_type: str) -> DataFrame:
    """(source, title, document_type, date, text) of fetched pages (url, html), titled by title element, else first heading, else
    URL; pages without text are left out."""
    return documents(pages.select(F.col("url").alias("source"), "html"), document_type, lambda p, source: F.when(p["title"] != "", p["title"]).otherwise(F.coalesce(p["heading"], source)))


def documents(pages: DataFrame, document_type: str, title: Callable[[Column, Column], Column]) -> DataFrame:
    """(source, title, document_type, date, text) of pages (source, html) with text; title is made of the parsed page and the source."""
    own = pages.select("source", parsed(F.col("html")).alias("p")).where("p.text <> ''")
    return own.select("source", title(F.col("p"), F.col("source")).alias("title"), F.lit(document_type).alias("document_type"), F.lit("").alias("date"), "p.text")
