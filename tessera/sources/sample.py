"""A small made-up handbook of raw pages, for tests and trials: running headers, chapters, sections, appendices, an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE, TITLE = "sample/harbour_keeping.pdf", "harbour_keeping.pdf"
#: Chapters and their sections: (number, heading, subject of its prose).
CHAPTERS = {
    "MOORINGS AND BERTHS": (("1.1", "Allotting a Berth", "the allotment of berths"), ("1.2", "Mooring Lines", "the inspection of mooring lines"), ("1.3", "Visiting Vessels", "the reception of visiting vessels"), ("1.4", "Berth Charges", "the reckoning of berth charges"), ("APPENDIX 1.1", "TABLE OF CHARGES", "the table of berth charges")),
    "LIGHTS AND SIGNALS": (("2.1", "Harbour Lights", "the tending of harbour lights"), ("2.2", "Fog Signals", "the sounding of fog signals"), ("2.3", "Signal Flags", "the hoisting of signal flags"), ("2.3.1", "Storm Flags", "the warning by storm flags"), ("2.4", "Lamp Oil", "the storing of lamp oil")),
    "DREDGING AND DEPTHS": (("3.1", "Soundings", "the taking of soundings"), ("3.2", "Dredging Plans", "the drawing up of dredging plans"), ("3.3", "Spoil Grounds", "the choice of spoil grounds"), ("3.4", "Notices of Depth", "the posting of notices of depth"), ("APPENDIX 3.1", "FORM OF NOTICE", "the form of a notice of depth")),
}
SECTIONS = tuple(number for sections in CHAPTERS.values() for number, *_ in sections)
_SAYINGS = (
    "The keeper is answerable for {}.", "A record of {} is kept in the harbour book.", "Each week a second keeper looks over {}.", "In rough weather {} is put off until the swell has gone down.",
    "Whoever finds a fault in {} reports it before the next tide.", "The harbour office gives notice of any change in {}.", "No stranger is to take part in {}.", "At the end of the season {} is gone through once more.",
)


def prose(subject: str) -> str:
    """Eight sentences twice over on a subject, as lines."""
    once = [s.format(subject) for s in _SAYINGS]
    return "\n".join([*once, *("Further: " + s[0].lower() + s[1:] for s in once)])


def pages() -> list[str]:
    """Raw page texts in order: a front page, a page for each section (a chapter's first opens it), an index."""
    out = ["A HANDBOOK OF HARBOUR KEEPING\nMade up for trials"]
    for chapter, (title, sections) in enumerate(CHAPTERS.items(), 1):
        for k, (number, heading, subject) in enumerate(sections):
            printed = len(out)
            top = f"CHAPTER {chapter}\n{title}" if k == 0 else f"{title} {printed}" if printed % 2 else f"{printed} {title}"
            out.append(f"{top}\n{number} {heading}\n{prose(subject)}")
    return [*out, "INDEX\nberths 1.1\nlights 2.1\nsoundings 3.1"]


def handbook(spark: SparkSession, source: str = SOURCE) -> DataFrame:
    """(source, page_number, text) of the pages."""
    return spark.createDataFrame([(source, n, t) for n, t in enumerate(pages(), 1)], "source string, page_number int, text string")


def golden() -> list[dict]:
    """A question for each third section, one by its number, and one that the handbook does not answer."""
    asked = [(f"What holds for {subject}?", "direct", [number]) for sections in CHAPTERS.values() for number, _, subject in sections[::3]]
    asked += [("What does para 2.3 say?", "exact_token", ["2.3"]), ("How is a glacier crossed on skis?", "refusal", [])]
    return [{"question": q, "type": t, "expected_sections": s} for q, t, s in asked]
