"""Page cleaning: running headers, printed page numbers, hyphens, the page map, and corpus checks.

Pages are rows (source, page_number, text). Statistics are per source; every step is a column expression or a
window over the pages of one source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import lines, strip
from tessera.sources.shared import held

#: Forms of running headers, chapter lines and bare numbers (fixed values); tolerance of a header's offset.
TITLE = r"[A-Z][A-Z0-9&'(),.\- ]*[A-Z.)]"
RECTO, VERSO = rf"^({TITLE})\s+([0-9]{{1,3}})$", rf"^([0-9]{{1,3}})\s+({TITLE})$"
CHAPTER, NUMBER, HYPHENED = r"^CHAPTER [0-9]+$", r"^[0-9]{1,3}$", r"[A-Za-z]+(?:-[A-Za-z]+)+"
TOLERANCE = 1
#: Share of pages from which a line is a repeated one; characters below which a page is sparse (fixed values).
REPEATED, SPARSE = 0.10, 100


#: What has to be at an end of a line for white space there to be stripped; the last three may stand behind it.
_BLANK = r"[\s\x85\u2028\u2029]"


def ended(line: Column) -> Column:
    """A line without white space at its end; only lines that have it are read through."""
    return F.when(F.right(line, F.lit(1)).rlike(_BLANK), F.regexp_replace(line, r"\s+$", "")).otherwise(line)


def bare(line: Column) -> Column:
    """strip(line); only lines with white space at an end are read through. It names the line often: not for expressions."""
    return F.when(F.left(line, F.lit(1)).rlike(_BLANK) | F.right(line, F.lit(1)).rlike(_BLANK), strip(line)).otherwise(line)


def filled(text: Column) -> Column:
    """The stripped lines of a text that are not blank."""
    return F.filter(F.transform(lines(text), bare), lambda x: x != "")


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use names it: a filter that is pushed down repeats columns."""
    return F.transform(F.array(value), use)[0]


def first_line(text: Column) -> Column:
    return F.try_element_at(filled(text), F.lit(1))


def last_line(text: Column) -> Column:
    return F.try_element_at(filled(text), F.lit(-1))


def header_number(line: Column) -> Column:
    """The printed page number of a running header, null for other lines; chapter lines are none."""
    return F.when(line.rlike(CHAPTER), F.lit(None)).when(line.rlike(RECTO), F.regexp_extract(line, RECTO, 2).try_cast("int")).when(line.rlike(VERSO), F.regexp_extract(line, VERSO, 1).try_cast("int"))


def calibration(pages: DataFrame) -> DataFrame:
    """(source, mode, lower, upper): the commonest offset of page to printed number (of equal ones that of the earliest
    page), and the window in which missing numbers are inferred. Sources without headers have no row."""
    may = pages.where(F.col("text").rlike("[0-9]"))  # as any header and any chapter line has
    own = may.select("source", "page_number", first_line(F.col("text")).alias("line"), F.when(F.col("text").contains("CHAPTER "), F.exists(filled(F.col("text")), lambda x: x.rlike(CHAPTER))).otherwise(F.lit(False)).alias("opens"))
    own = own.withColumn("offset", F.col("page_number") - header_number(F.col("line"))).select("source", "page_number", "offset", "opens")
    own = held(own.where("offset is not null or opens"))  # the others have no say
    votes = own.where("offset is not null").groupBy("source", "offset").agg(F.count("*").alias("n"), F.min("page_number").alias("at"))
    mode = votes.groupBy("source").agg(F.max_by("offset", F.struct("n", (-F.col("at")).alias("at"))).alias("mode"))
    ok = F.abs(F.col("offset") - F.col("mode")) <= TOLERANCE
    spans = own.join(mode, "source").groupBy("source", "mode").agg(F.min(F.when(ok, F.col("page_number"))).alias("first"), F.max(F.when(ok, F.col("page_number"))).alias("last"), F.min(F.when(F.col("opens"), F.col("page_number"))).alias("chapter"))
    return spans.select("source", "mode", F.least("first", "chapter").alias("lower"), (F.col("last") + 1).alias("upper"))


def attested_words(pages: DataFrame) -> DataFrame:
    """(source, word): the lower-cased hyphenated words of each source."""
    return hyphenated_words(pages).distinct()


def hyphenated_words(pages: DataFrame) -> DataFrame:
    """(source, word): those of each page, once a page."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z]+(?:-[a-z]+)+"), F.lit(0))
    return pages.where(F.col("text").contains("-")).select("source", F.explode(F.array_distinct(found)).alias("word"))


def attested(pages: DataFrame) -> DataFrame:
    """(source, words): the same as an array."""
    return attested_words(pages).groupBy("source").agg(F.array_sort(F.collect_list("word")).alias("words"))


def _end(line: Column) -> Column:
    return F.regexp_extract(line, r"([a-z]+)-$", 1)


def _start(line: Column) -> Column:
    return F.regexp_extract(line, r"^([a-z]+)", 1)


def broken(text_lines: Column) -> Column:
    """struct(words, tails): the hyphenated words that lines may be broken in, whatever was decided before, and the parts of
    words that the last line may end in."""
    none = F.array().cast("array<string>")

    def step(acc: Column, line: Column) -> Column:
        joined = F.when(line.rlike(r"^\p{Ll}"), F.transform(acc["tails"], lambda t: F.concat(t, F.lit("-"), _start(line)))).otherwise(none)
        longer = F.when(line.rlike("^[a-z]+-$"), F.transform(acc["tails"], lambda t: F.concat(t, _end(line)))).otherwise(none)
        tails = F.when(_end(line) == "", none).otherwise(F.concat(F.array(_end(line)), longer))
        return F.struct(F.concat(acc["words"], joined).alias("words"), tails.alias("tails"))

    return F.aggregate(text_lines, F.struct(none.alias("words"), none.alias("tails")), step)


def needed_words(pages: DataFrame) -> DataFrame:
    """(source, words): of the attested words of a source those that a line or a page may be broken in. Any of the last two
    lines of a page may be its last once a foot is gone, any of the first two its first once a header is."""
    ls, hyphen = F.transform(lines(F.col("text")), ended), F.col("text").contains("-")
    heads = lambda full: F.transform(F.slice(full, 1, 2), _start)
    ends = lambda full: F.filter(F.transform(F.slice(full, F.greatest(F.lit(1), F.size(full) - 1), F.lit(2)), _end), lambda x: x != "")
    none = F.array().cast("array<string>")
    own = pages.select("source", "page_number", named(filled(F.col("text")), lambda full: F.struct(heads(full).alias("heads"), F.when(hyphen, ends(full)).otherwise(none).alias("ends"))).alias("l"), F.when(hyphen, broken(ls)).alias("b"))
    own = own.select("source", "page_number", F.struct(F.coalesce("b.words", none).alias("words"), F.coalesce("b.tails", none).alias("tails")).alias("b"), "l.heads", "l.ends")
    after = F.lead("heads").over(Window.partitionBy("source").orderBy("page_number"))
    seams = F.flatten(F.transform(F.concat("b.tails", "ends"), lambda t: F.transform(F.coalesce("after", F.array().cast("array<string>")), lambda h: F.concat(t, F.lit("-"), h))))
    may = own.withColumn("after", after).select("source", F.explode(F.array_distinct(F.concat("b.words", seams))).alias("word")).distinct()
    return may.join(hyphenated_words(pages), ["source", "word"], "left_semi").groupBy("source").agg(F.collect_list("word").alias("words"))


def joined_word(a: Column, b: Column, words: Column) -> Column:
    """Whether the hyphen between two parts of a word stays: if the whole is attested with it."""
    return F.array_contains(words, F.concat(a, F.lit("-"), b))


def repair(text_lines: Column, words: Column) -> Column:
    """Lines with words joined that a hyphen broke: a fold, as a joined line may end in a hyphen again."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("carry"))

    def step(acc: Column, line: Column) -> Column:
        c = acc["carry"]
        a, b = F.regexp_extract(c, r"([a-z]+)-$", 1), F.regexp_extract(line, r"^([a-z]+)", 1)
        broken = (a != "") & line.rlike(r"^\p{Ll}")
        kept = F.when(joined_word(a, b, words), c).otherwise(F.substring(c, F.lit(1), F.length(c) - 1))
        out = F.when(c.isNull() | broken, acc["out"]).otherwise(F.array_append(acc["out"], c))
        return F.struct(out.alias("out"), F.when(c.isNotNull() & broken, F.concat(kept, line)).otherwise(line).alias("carry"))

    return F.aggregate(text_lines, empty, step, lambda acc: F.when(acc["carry"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["carry"])))


def clean(pages: DataFrame) -> DataFrame:
    """(source, page_number, printed_page, text) of pages that hold text after cleaning.

    A valid running header, or else a bare number, is taken off the top, a bare number off the foot; broken words are
    joined, trailing blanks and more than one blank line dropped; numbers are read or inferred.
    """
    own = pages.join(calibration(pages), "source", "left").join(needed_words(pages), "source", "left")
    none = F.array().cast("array<string>")
    own = own.withColumns({"words": F.coalesce("words", none), "ls": F.transform(lines(F.col("text")), ended)})
    own = own.withColumn("head", first_line(F.col("text")))
    own = own.withColumn("read", F.when(F.abs(F.col("page_number") - header_number(F.col("head")) - F.col("mode")) <= TOLERANCE, header_number(F.col("head"))))
    top = F.coalesce(F.col("read").isNotNull() | F.col("head").rlike(NUMBER), F.lit(False))

    def without(ls: Column, at: Column) -> Column:
        return F.filter(ls, lambda _, k: k != at)

    place = lambda ls: F.filter(F.transform(ls, lambda x, k: F.when(bare(x) != "", k)), lambda k: k.isNotNull())
    def without_foot(ls: Column, foot: Column) -> Column:
        return F.when(F.coalesce(strip(F.element_at(ls, foot + 1)).rlike(NUMBER), F.lit(False)), without(ls, foot)).otherwise(ls)

    own = own.withColumn("ls", F.when(top, without(F.col("ls"), F.try_element_at(place(F.col("ls")), F.lit(1)))).otherwise(F.col("ls")))
    footed = named(F.col("ls"), lambda ls: named(F.try_element_at(place(ls), F.lit(-1)), lambda foot: without_foot(ls, foot)))
    mended = named(footed, lambda ls: F.when(F.col("text").contains("-"), repair(ls, F.col("words"))).otherwise(ls))
    closed = lambda t: F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    text = named(F.array_join(mended, "\n"), lambda t: F.when(t.contains("\n"), closed(t)).otherwise(t))
    guess = F.col("page_number") - F.col("mode")
    inferred = F.when(F.col("page_number").between(F.col("lower"), F.col("upper")) & (guess >= 1), guess)
    # Exploded, the text is made once; a filter would make it a second time, with all it is made of written out.
    own = own.select("source", "page_number", F.coalesce("read", inferred).cast("int").alias("printed_page"), "words", F.explode(F.filter(F.array(text), lambda t: bare(t) != "")).alias("text"))
    return own.select("source", "page_number", "printed_page", "text", F.when(F.col("text").contains("-") & F.col("text").rlike("[a-z]-$"), F.col("words")).otherwise(none).alias("words"))


#: Pages of a block, and characters of a stretch of positions, as bits: what one task has to order of a long source.
BLOCK_BITS, STRETCH_BITS = 10, 20


def page_map(cleaned: DataFrame) -> DataFrame:
    """(source, page_number, printed_page, text, char_start, char_end, separator): pages joined by a line end, or by
    nothing where a word goes on over the seam; the text between start and end is the page's, exactly.

    Pages are ordered within blocks of page numbers; of a block only its first letters, its last page's end and its size meet
    those of the other blocks of its source, so a source of very many pages is many tasks. Texts travel only if they are asked for.
    """
    blocks, within = Window.partitionBy("source").orderBy("block"), Window.partitionBy("source", "block").orderBy("page_number")
    before = (Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(*before)), F.lit(0))
    none = F.array().cast("array<string>")
    words = F.coalesce("words", none) if "words" in cleaned.columns else none
    tail = F.when(F.col("text").contains("-"), F.regexp_extract("text", r"([a-z]+)-$", 1)).otherwise("")
    own = cleaned.withColumns({"block": F.shiftright(F.col("page_number").cast("long"), BLOCK_BITS), "opening": F.regexp_extract("text", r"(?s)^(?:[a-z]+|.)", 0), "tail": tail, "words": F.when(tail != "", words), "length": F.length("text").cast("long")})

    def joint(after: Column) -> Column:
        """struct(cut, separator) of a page before another that opens so, or before none: whether its last hyphen goes."""
        seam = F.coalesce((F.col("tail") != "") & after.rlike(r"^\p{Ll}"), F.lit(False))
        cut = seam & ~joined_word(F.col("tail"), F.regexp_extract(after, r"^([a-z]+)", 1), F.coalesce("words", none))
        return F.struct(F.coalesce(cut, F.lit(False)).alias("cut"), F.when(after.isNull() | seam, "").otherwise("\n").alias("separator"))

    size = lambda j: F.col("length") - j["cut"].cast("int") + F.length(j["separator"])
    # Within a block all sizes are known but that of its last page, which asks for the block after it; none comes after that page.
    own = own.withColumn("after", F.lead("opening").over(within)).withColumn("joint", joint(F.col("after"))).withColumn("size", size(F.col("joint")))
    own = own.withColumn("before", so_far("size", within))
    last = F.max_by(F.struct("tail", "words", "length", "before"), F.col("page_number"))
    ends = own.groupBy("source", "block").agg(F.min_by("opening", "page_number").alias("first"), last.alias("last")).select("source", "block", "first", "last.*")
    ends = ends.withColumn("next", F.lead("first").over(blocks)).withColumn("total", F.col("before") + size(joint(F.col("next"))))
    ends = ends.withColumn("offset", so_far("total", blocks)).select("source", "block", "next", "offset")
    own = own.join(ends, ["source", "block"]).withColumn("joint", F.when(F.col("after").isNull(), joint(F.col("next"))).otherwise(F.col("joint")))
    text = F.when(F.col("joint.cut"), F.substring("text", F.lit(1), F.col("length").cast("int") - 1)).otherwise(F.col("text"))
    own = own.withColumn("char_start", (F.col("offset") + F.col("before")).cast("int"))
    end = (F.col("char_start") + F.col("length") - F.col("joint.cut").cast("int")).cast("int")
    return own.select("source", "page_number", "printed_page", text.alias("text"), "char_start", end.alias("char_end"), F.col("joint.separator").alias("separator"))


def pages_at(mapped: DataFrame, positions: DataFrame, position: str, page: str) -> DataFrame:
    """positions (source, position and others) with the printed page there: that of the last page that starts at or before
    it, else of the source's first; null for a source without pages.

    Positions and page starts are ordered together, by stretches of the text, and a stretch begins with the last page
    that any before it had: n log n in both, and no task holds a long source. Null positions have the first page.
    """
    none = F.lit(None)
    starts = mapped.select("source", F.col("char_start").cast("long").alias("at_"), F.struct("printed_page").alias("page_"), none.cast(positions.select(F.struct("*").alias("p")).schema["p"].dataType).alias("row_"))
    asked = positions.select("source", F.coalesce(F.col(position).cast("long"), F.lit(-1)).alias("at_"), none.cast(starts.schema["page_"].dataType).alias("page_"), F.struct("*").alias("row_"))
    both = held(starts.unionByName(asked).withColumn("stretch_", F.shiftright("at_", STRETCH_BITS)))  # it is read twice
    until = Window.unboundedPreceding
    stretches = both.groupBy("source", "stretch_").agg(F.max_by("page_", F.when(F.col("page_").isNotNull(), F.col("at_"))).alias("last_"))
    came = F.last("last_", ignorenulls=True).over(Window.partitionBy("source").orderBy("stretch_").rowsBetween(until, -1))
    first = starts.groupBy("source").agg(F.min_by("page_", "at_").alias("first_"))
    here = F.last("page_", ignorenulls=True).over(Window.partitionBy("source", "stretch_").orderBy("at_", F.col("page_").isNull()).rowsBetween(until, Window.currentRow))
    own = both.withColumn("here_", here).where("row_ is not null").join(stretches.withColumn("came_", came).select("source", "stretch_", "came_"), ["source", "stretch_"]).join(first, "source", "left")
    return own.select("row_.*", F.coalesce("here_", "came_", "first_")["printed_page"].alias(page))


def documents(mapped: DataFrame) -> DataFrame:
    """(source, clean_text, page_map): one row per source."""
    span = F.struct("page_number", "printed_page", "char_start", "char_end")
    parts = F.array_sort(F.collect_list(F.struct("page_number", F.concat("text", "separator").alias("t"), span.alias("span"))))
    return mapped.groupBy("source").agg(parts.alias("p")).select("source", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("clean_text"), F.transform("p", lambda x: x["span"]).alias("page_map"))


def extract(pages: DataFrame) -> DataFrame:
    """Raw pages to documents: cleaning, joining and the page map."""
    return documents(page_map(held(clean(pages.where(F.coalesce("text", F.lit("")) != "")))))  # it is read twice


def page_at(spans: Column, position: Column) -> Column:
    """The printed page of a position: that of the last span that starts at or before it, else of the first."""
    hit = F.try_element_at(F.filter(spans, lambda s: s["char_start"] <= position), F.lit(-1))
    return F.when(hit.isNotNull(), hit["printed_page"]).otherwise(F.try_element_at(spans, F.lit(1))["printed_page"])


def page_range(spans: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The printed pages of a half-open range of characters."""
    return page_at(spans, start), page_at(spans, F.greatest(start, end - 1))


def invariants(mapped: DataFrame) -> DataFrame:
    """(source, page_number, problem) of page maps: order, overlap, empty or untrimmed pages."""
    order = Window.partitionBy("source").orderBy("page_number")
    own = mapped.withColumn("next", F.lead("char_start").over(order))
    tests = {"empty": F.col("char_end") <= F.col("char_start"), "overlap": F.col("next") < F.col("char_end"), "length": F.length("text") != F.col("char_end") - F.col("char_start"), "untrimmed": F.col("text").rlike(r"^\n|\n$"), "negative": F.col("char_start") < 0}
    problems = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in tests.items()]))
    return own.select("source", "page_number", F.explode(problems).alias("problem"))


def numbering_census(pages: DataFrame, most: int = 8) -> DataFrame:
    """(depth, n, examples) of lines that open with a dotted number; the first distinct examples by order."""
    n = F.regexp_extract(F.col("line"), r"^([0-9]{1,2}(?:\.[0-9]{1,3})+)\b", 1)
    own = pages.select(F.explode(filled(F.col("text"))).alias("line")).select(n.alias("number")).where("number <> ''")
    counted = own.groupBy(F.size(F.split("number", r"\.")).alias("depth"), "number").agg(F.count("*").alias("n"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("depth").orderBy("number"))).where(F.col("place") <= most)
    shown = first.groupBy("depth").agg(F.array_sort(F.collect_list("number")).alias("examples"))  # at most so many a depth
    return counted.groupBy("depth").agg(F.sum("n").alias("n")).join(shown, "depth")


def repeated_lines(pages: DataFrame, share: float = REPEATED) -> DataFrame:
    """(line, pages) of lines on more than that share of all pages."""
    total = pages.agg(F.count("*").alias("total"))
    own = pages.select(F.explode(F.array_distinct(filled(F.col("text")))).alias("line")).groupBy("line").agg(F.count("*").alias("pages"))
    return own.join(F.broadcast(total), F.col("pages") > F.col("total") * share).select("line", "pages")  # total is one row


def chapter_census(pages: DataFrame) -> DataFrame:
    """(source, page_number, line) of chapter lines."""
    return pages.select("source", "page_number", F.explode(filled(F.col("text"))).alias("line")).where(F.col("line").rlike(CHAPTER))


def header_census(pages: DataFrame) -> DataFrame:
    """(place, shape, n) of first and last lines: header, number, chapter or other."""
    shape = lambda c: F.when(c.rlike(CHAPTER), "chapter").when(header_number(c).isNotNull(), "header").when(c.rlike(NUMBER), "number").otherwise("other")
    ends = F.array(F.struct(F.lit("first").alias("place"), first_line(F.col("text")).alias("line")), F.struct(F.lit("last").alias("place"), last_line(F.col("text")).alias("line")))
    own = pages.select(F.explode(ends).alias("e")).where("e.line is not null")
    return own.groupBy(F.col("e.place").alias("place"), shape(F.col("e.line")).alias("shape")).agg(F.count("*").alias("n"))


def hyphen_census(pages: DataFrame) -> DataFrame:
    """One row: lines that end in a letter and a hyphen."""
    ends = F.size(F.filter(lines(F.col("text")), lambda x: x.rlike("[a-z]-$")))
    return pages.agg(F.coalesce(F.sum(ends), F.lit(0)).alias("n_hyphen_lines"), F.count("*").alias("n_pages"))


def character_census(pages: DataFrame, allowed: str = "–—‘’“”•§£€…") -> DataFrame:
    """(character, n) of characters beyond ASCII that are not allowed ones."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"[^\x00-\x7F{allowed}]"), F.lit(0))
    return pages.select(F.explode(found).alias("character")).groupBy("character").agg(F.count("*").alias("n"))


def fidelity(pages: DataFrame) -> DataFrame:
    """One row: glyph codes that were not mapped, and replacement characters."""
    count = lambda p: F.coalesce(F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(0)))), F.lit(0))
    return pages.agg(count(r"\(cid:[0-9]+\)").alias("n_cid"), count("�").alias("n_replacement"))


def coverage(pages: DataFrame, images: Column | None = None) -> DataFrame:
    """One row: pages, those without text, of these those with images, and sparse ones."""
    size = F.length(strip(F.coalesce("text", F.lit(""))))
    number = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    only = number((size == 0) & images) if images is not None else F.lit(0).cast("long")
    return pages.agg(F.count("*").alias("n_pages"), number(size == 0).alias("n_no_text"), only.alias("n_image_only"), number((size > 0) & (size < SPARSE)).alias("n_sparse"))
