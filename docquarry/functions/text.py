"""Text functions as Spark columns: tokens, masks, headings, references, citations, query normalisation.

Regular expressions spell out Unicode classes, since \\w is ASCII in Java.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, functions as F

# Token pattern, stop words, section numbers, abbreviations, glossary, furniture patterns.
TOKEN = r"[a-z]?\d+(?:\.\d+)*|[\p{L}\p{N}_]+"
STOPWORDS = """
about above after again all also am an and any are as at be because been before being between both but by
can could did do does doing during each either for from further had has have having he her here hers him his
how into is it its itself just me more most my of off on once only or other our ours out over own same she
should so some such than that the their theirs them then there these they this those through to too under
until up very was we were what when where which while who whom why will with would you your yours
""".split()
SECTION_NUMBER = r"(?:10\d{2}|[1-9]\d{2})"
SECTION_REF = r"(?i)\b([a-z]?\d{2,4}(?:\.\d+)+(?:\([a-z0-9]+\))*)"
ABBREVIATIONS = {
    "gfci": "ground-fault circuit-interrupter", "afci": "arc-fault circuit-interrupter", "adaag": "ADA Accessibility Guidelines",
    "tty": "text telephone teletypewriter", "atm": "automatic teller machine", "als": "assistive listening system",
    "ufas": "Uniform Federal Accessibility Standards", "cfr": "Code of Federal Regulations",
    "hud": "Department of Housing and Urban Development", "wc": "water closet toilet",
}
GLOSSARY = {
    "light switch": "operable parts, controls", "outlet": "operable parts, convenience receptacles", "thermostat": "operable parts, environmental controls",
    "door handle": "door hardware, operable parts", "bathroom": "toilet room", "restroom": "toilet room", "toilet": "water closet", "sink": "lavatory",
    "turn around": "turning space", "hallway": "circulation path, walking surface", "sidewalk": "walk, accessible route", "steep": "running slope",
    "step": "change in level", "stairs": "stairways", "curb cut": "curb ramp", "how wide": "clear width", "hotel room": "transient lodging guest room",
    "wheelchair seating": "wheelchair space", "raised letters": "tactile characters", "water fountain": "drinking fountain",
}
EDGE_FURNITURE = [
    r"^[A-Z ,:]*CHAPTER \d+: [A-Z ,:]+$",
    r"^\d+ - (?:Guidance on )?(?:the )?\d{4} Standards:? +Titles? I",
    r"\d{4} Standards:? +Titles? I[I ]*(?:and III)? ?- ?\d+",
    r"^Subpart D of 28 CFR Part 36$",
    r"^Section 35\.151 of 28 CFR Part 35$",
]
FURNITURE_ANYWHERE = [
    r"^Titles II and III - 2010 Standards - \d+$",
    r"^\d{4} Standards: +Titles? I[I ]*(?:and III)? ?- ?\d+$",
    r"^\d+ - \d{4} Standards: +Titles? I[I ]*(?:and III)?$",
    r"^Guidance on (?:the )?\d{4} Standards: +Titles? I[I ]*(?:and III)? ?- ?\d+$",
    r"^Department of Justice$",
]
PRINTED_PAGE = [r"^(\d{1,4}) - (?:Guidance on )?(?:the )?\d{4} Standards", r"\d{4} Standards:? +Titles? I[I ]*(?:and III)? ?- ?(\d{1,4})"]
DOT_LEADER, MIN_DOT_LEADERS = r"…|\.{4,}", 3
NUMBERED_ENTRY, MIN_NUMBERED_ENTRIES = r"^(?:10\d{2}|[1-9]\d{2})(?:\.\d+)* [A-Z][^.…]*? \d{1,3}$", 5
CONTENTS_TITLE = r"(?i)^(?:TABLE OF )?CONTENTS$"
NUMBERED_HEADING = rf"^({SECTION_NUMBER}(?:\.\d+)+) ([A-Z][^.…]{{0,100}}?)\.(?:\s|$)"
MULTI_HEADING = rf"^({SECTION_NUMBER}(?:\.\d+)*(?:,? (?:and )?{SECTION_NUMBER}(?:\.\d+)*)+),? ([A-Z][^.…]{{0,100}})$"
CHAPTER_HEADING = rf"^({SECTION_NUMBER}) ([A-Z][A-Za-z ,'’/()&-]{{2,80}})$"
REGULATION_HEADING = r"^§ ?(\d+\.\d+(?:\([a-z0-9]+\))*) ([A-Z][^…]{0,100}?)\.?$"
GUIDANCE_HEADING = r"^Section (\d+\.\d+(?:\([a-zA-Z0-9]+\))*)(?: ([A-Z][^…]{0,100}))?$"
PARAGRAPH = r"^\(([a-z])\)(?: +([A-Z].*))?$"
CITATION_GROUP = r"\[\s*(S\d+(?:\s*[,;]\s*S\d+)*)\s*\]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: White space at the ends of a line: blanks, tabs, separators and Unicode spaces.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def tokenize(text: Column, remove_stopwords: bool = False) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    if not remove_stopwords:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS))  # a hash set, not a scan of an array


def split_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")


def mask_digits(line: Column) -> Column:
    return F.regexp_replace(line, r"\d+", "#")


def repair_hyphens(text: Column) -> Column:
    word = r"[\p{L}\p{N}_]"
    return F.regexp_replace(F.regexp_replace(text, rf"({word})-\n({word})", "$1$2"), rf"({word})\n-\n({word})", "$1$2")


def any_of(line: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | line.rlike(p)
    return out


def printed_page(line: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in PRINTED_PAGE))


def is_contents_page(lines: Column) -> Column:
    many = lambda p, n: F.size(F.filter(lines, lambda x: x.rlike(p))) >= n
    return F.exists(lines, lambda x: x.rlike(CONTENTS_TITLE)) | many(DOT_LEADER, MIN_DOT_LEADERS) | many(NUMBERED_ENTRY, MIN_NUMBERED_ENTRIES)


def is_rejected_heading(line: Column) -> Column:
    return line.startswith("Advisory") | line.contains("--") | line.contains("…") | line.contains("....")


def match_heading(line: Column) -> Column:
    """STRUCT<id, title, type, body>, or null where the line starts no section."""
    got = lambda p, g: F.regexp_extract(line, p, g)
    shape = lambda i, title, kind, body=None: F.struct(i.alias("id"), strip(title).alias("title"), F.lit(kind).alias("type"), (body if body is not None else F.lit("")).alias("body"))
    numbers = F.array_join(F.regexp_extract_all(got(MULTI_HEADING, 1), F.lit(SECTION_NUMBER + r"(?:\.\d+)*"), F.lit(0)), ", ")
    body = strip(F.substr(line, F.length(got(NUMBERED_HEADING, 0)) + 1))
    found = (
        F.when(line.rlike(NUMBERED_HEADING), shape(got(NUMBERED_HEADING, 1), got(NUMBERED_HEADING, 2), "code", body))
        .when(line.rlike(MULTI_HEADING), shape(numbers, got(MULTI_HEADING, 2), "code"))
        .when(line.rlike(CHAPTER_HEADING), shape(got(CHAPTER_HEADING, 1), got(CHAPTER_HEADING, 2), "code"))
        .when(line.rlike(REGULATION_HEADING), shape(got(REGULATION_HEADING, 1), got(REGULATION_HEADING, 2), "regulation"))
        .when(line.rlike(GUIDANCE_HEADING), shape(got(GUIDANCE_HEADING, 1), got(GUIDANCE_HEADING, 2), "code"))
    )
    return F.when(~is_rejected_heading(line), found)


def paragraph_marker(line: Column) -> Column:
    """STRUCT<letter, title, body> of a regulation paragraph, or null."""
    rest = F.regexp_extract(line, PARAGRAPH, 2)
    first = strip(F.split_part(rest, F.lit("."), F.lit(1)))
    return F.when(line.rlike(PARAGRAPH), F.struct(F.regexp_extract(line, PARAGRAPH, 1).alias("letter"), F.when(F.length(first) <= 60, first).otherwise("").alias("title"), rest.alias("body")))


def ancestor_ids(section_id: Column) -> Column:
    """Outermost first: 216.2.1 has 216, 216.2; 35.151(b) has 35, 35.151. Lists of ids have none."""
    plain = F.regexp_extract(section_id, r"^[^(]*", 0)
    dots = F.split(plain, r"\.")
    by_dot = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda n: F.array_join(F.slice(dots, F.lit(1), n), "."))
    groups = F.regexp_extract_all(section_id, F.lit(r"\([^()]*\)"), F.lit(0))
    by_group = F.transform(F.sequence(F.lit(0), F.size(groups)), lambda n: F.concat(plain, F.array_join(F.slice(groups, F.lit(1), n), "")))
    every = F.array_distinct(F.concat(by_dot, by_group))
    return F.filter(every, lambda x: x != section_id)


def section_label(section_id: Column, title: Column) -> Column:
    return F.trim(F.concat_ws(" ", section_id, title))


def parent_id(source: Column, section_id: Column, occurrence: Column) -> Column:
    return F.sha1(F.when(occurrence > 1, F.concat_ws("|", source, section_id, occurrence.cast("string"))).otherwise(F.concat_ws("|", source, section_id)).cast("binary"))


def child_id(parent: Column, index: Column) -> Column:
    return F.sha1(F.concat_ws("|", parent, index.cast("string")).cast("binary"))


def section_refs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SECTION_REF), F.lit(1)), F.lower))


def _folded(text: Column) -> Column:
    """text in which a word stands wherever (?iu) finds it: four letters fold to Latin ones besides the capitals."""
    return F.lower(F.translate(text, "\u017f\u212a\u0131\u0130", "skii"))


def expand_abbreviations(text: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    def body(low: Column) -> Column:
        out = text
        for short, full in table.items():  # no expansion holds another key, so one after the other is one pass
            out = let(out, partial(expand, low, short, full))
        return out

    def expand(low: Column, short: str, full: str, t: Column) -> Column:
        return F.when(low.contains(short), F.regexp_replace(t, rf"(?iu)\b({short})\b", f"$1 ({full})")).otherwise(t)

    return let(_folded(text), body)


def expand_glossary(text: Column, table: dict[str, str] = GLOSSARY) -> Column:
    """Append the terms of everyday words that the text has, as ' (a, b)'."""
    def body(t: Column) -> Column:
        has = lambda low, word: low.contains(word) & t.rlike(rf"(?iu)\b{word}(?:s|es)?\b")
        found = let(_folded(t), lambda low: F.flatten(F.array(*(F.when(has(low, word), F.array(*map(F.lit, terms.split(", ")))).otherwise(F.array().cast("array<string>")) for word, terms in table.items()))))
        new = let(F.lower(t), lambda low: F.filter(F.array_distinct(found), lambda x: ~F.contains(low, F.lower(x))))
        return let(new, lambda n: F.when(F.size(n) > 0, F.concat(t, F.lit(" ("), F.array_join(n, ", "), F.lit(")"))).otherwise(t))

    return let(text, body)


def cited_labels(text: Column) -> Column:
    groups = F.regexp_extract_all(text, F.lit(CITATION_GROUP), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"S\d+"), F.lit(0)))))


def format_citation(source: Column, page_start: Column, page_end: Column, section_id: Column) -> Column:
    pages = F.when(page_start == page_end, page_start.cast("string")).otherwise(F.concat_ws("-", page_start.cast("string"), page_end.cast("string")))
    return F.concat(F.lit("["), source, F.lit(" p."), pages, F.lit(" §"), section_id, F.lit("]"))


def numeric_value(value: Column) -> Column:
    """'1:12' is 1/12, '32' is 32.0."""
    part = lambda i: F.split_part(value, F.lit(":"), F.lit(i)).cast("double")
    return F.when(value.contains(":"), F.try_divide(part(1), part(2))).otherwise(value.try_cast("double"))


def parse_grade(reply: Column) -> Column:
    """STRUCT<relevant, parsed>: the first whole word yes or no; neither counts as relevant, not parsed."""
    word = F.regexp_extract(F.lower(reply), r"\b(yes|no)\b", 1)
    return F.struct((word != "no").alias("relevant"), (word != "").alias("parsed"))


def parse_rewrite(reply: Column, fallback: Column) -> Column:
    """The first line of a reply that holds more than quotes and a 'Search query:' label, else the fallback."""
    bare = lambda line: F.regexp_replace(strip(F.regexp_replace(line, r"(?i)^\s*(?:search\s+query\s*:)?\s*", "")), r"^[\"'`]+|[\"'`]+$", "")
    said = F.filter(F.transform(F.split(reply, LINE_BREAK), lambda x: strip(bare(x))), lambda x: x != "")
    return F.coalesce(F.get(said, F.lit(0)), fallback)


def contains_expected(text: Column, expected: Column) -> Column:
    """Whether each string of an array appears; 'a|b' is either, a number counts only where it isn't part of another."""
    def pattern(x: Column) -> Column:
        quoted = F.regexp_replace(x, r"([\\\[\](){}.*+?^$|])", r"\\$1")
        return F.concat(F.when(x.rlike(r"^\d"), r"(?<![\d./])").otherwise(""), quoted, F.when(x.rlike(r"\d$"), r"(?![\d/]|\.\d)").otherwise(""))

    return F.forall(expected, lambda item: F.exists(F.split(item, r"\|"), lambda x: F.regexp_like(text, pattern(x))))


def percent(value: Column) -> Column:
    """A ratio as whole percents, a dash for null."""
    return F.coalesce(F.concat(F.round(value * 100).cast("int").cast("string"), F.lit("%")), F.lit("–"))


def short(text: Column, most: int = 300) -> Column:
    """One table cell's worth of text."""
    flat = F.translate(text, "\n|", " /")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit(" […]")))


def source_tag(section_id: Column, source: Column) -> Column:
    """'404.2.3 [standards]': the third word of the file's name tells files with equal section ids apart."""
    return F.concat(section_id, F.lit(" ["), F.split_part(F.split_part(source, F.lit("_"), F.lit(3)), F.lit("."), F.lit(1)), F.lit("]"))


def outcome_label(refused: Column, reason: Column, in_corpus: Column, contains_ok: Column, status: Column) -> Column:
    """How an answered question went, in words."""
    refusal = F.concat(F.lit("refused ("), reason, F.lit(")"), F.when(in_corpus, "").otherwise(" ✓"))
    told = F.when(contains_ok.isNull(), "answered").when(contains_ok, "correct").otherwise("WRONG")
    review = F.when(F.coalesce(status, F.lit("")) == "needs_review", " [review]").otherwise("")
    return F.when(refused, refusal).when(~in_corpus, "ANSWERED (out of corpus)").otherwise(F.concat(told, review))
