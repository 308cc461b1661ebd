"""Queries over lines, answers and reviews that are put together from rows of the tables, with SQL oracles.

No row of the tables holds a section number, a quantity or a verdict. So templates are filled with numbers and words of each
row of `part`; the oracles fill the same templates and work the result out in SQL: from the text where SQL can, else from the
numbers that went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docquarry.functions import quantities as Qt, text as X
from docquarry.operators import answers as A, evalx, ingest, models, search
from docquarry.plans import agent as G, answer as C, evaluate as E, review as R
from docquarry.plans.retrieve import Config, normalise
from docquarry.session import stash, table

Q, O = {}, {}  # noqa: E741


def register(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


#: Names in templates, and what they stand for: a Spark and a SQL expression over part.
_FILL = {
    "a": ("cast(101 + p_partkey % 800 as string)", "(101 + p_partkey % 800)::varchar"),
    "b": ("cast(p_partkey % 7 + 1 as string)", "(p_partkey % 7 + 1)::varchar"),
    "c": ("cast(30 + p_size as string)", "(30 + p_size)::varchar"),
    "d": ("cast(90 + p_size as string)", "(90 + p_size)::varchar"),
    "e": ("cast(20000 + p_partkey as string)", "(20000 + p_partkey)::varchar"),
    "w": ("concat(upper(left(p_name, 1)), substring(p_name, 2))", "upper(left(p_name, 1)) || substr(p_name, 2)"),
    "l": ("char(97 + p_partkey % 26)", "chr((97 + p_partkey % 26)::int)"),
}


def filled(spark, d, templates: list[str], *columns: str) -> DataFrame:
    """n, k and line: each template (number k) filled from each part (number n)."""
    line = F.col("t.line")
    for name, (expr, _) in _FILL.items():
        line = F.replace(line, F.lit("{" + name + "}"), F.expr(expr))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("line")) for k, t in enumerate(templates)))).alias("t")
    return table(spark, d, "part").select("*", each).select(F.col("p_partkey").alias("n"), F.col("t.k").alias("k"), line.alias("line"), *columns)


def _lit(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def _filled(templates: list[str], *columns: str) -> str:
    """The same as a SQL common table f."""
    line = "t.line"
    for name, (_, expr) in _FILL.items():
        line = f"replace({line}, '{{{name}}}', {expr})"
    rows = ", ".join(f"({k}, {_lit(t)})" for k, t in enumerate(templates))
    return f"f AS (SELECT p_partkey AS n, t.k, {line} AS line{''.join(', ' + c for c in columns)} FROM part, (VALUES {rows}) t(k, line))"


# --- headings, references

_HEADINGS = [
    "{a}.{b} {w}.  Openings of {c} inches.", "{a}.{b}.{b} {w}.", "{a} {w}", "{a}, {c}1, and {a}.{b} {w} and Bathing", "§ 35.{a} New {w} and alterations.", "§35.{a}(b) {w}", "Section 36.{a}(f) {w} Areas",
    "Section 36.{a}(f)", "Advisory {a}.{b} {w}.", "{a}.{b} {w} ...... {c}", "{w} {a}", "{a}.{b} lower. x", "{a} {w} -- {c}", "19{c} {w}", "{a}.{b} {w} without an end", "{a}.{b} {w}.\tTab",
]
_H = {k: v.replace("'", "''") for k, v in {"n": X.NUMBERED_HEADING, "m": X.MULTI_HEADING, "c": X.CHAPTER_HEADING, "r": X.REGULATION_HEADING, "g": X.GUIDANCE_HEADING}.items()}


@register(rf"""WITH {_filled(_HEADINGS)},
k AS (SELECT *, line LIKE 'Advisory%' OR contains(line, '--') OR contains(line, '…') OR contains(line, '....') AS no,
  CASE WHEN regexp_matches(line, '{_H["n"]}') THEN 'n' WHEN regexp_matches(line, '{_H["m"]}') THEN 'm' WHEN regexp_matches(line, '{_H["c"]}') THEN 'c' WHEN regexp_matches(line, '{_H["r"]}') THEN 'r' WHEN regexp_matches(line, '{_H["g"]}') THEN 'g' END AS h FROM f)
SELECT n, k, line, CASE WHEN no THEN NULL WHEN h = 'n' THEN regexp_extract(line, '{_H["n"]}', 1) WHEN h = 'm' THEN array_to_string(regexp_extract_all(regexp_extract(line, '{_H["m"]}', 1), '{X.SECTION_NUMBER}(?:\.\d+)*'), ', ')
    WHEN h = 'c' THEN regexp_extract(line, '{_H["c"]}', 1) WHEN h = 'r' THEN regexp_extract(line, '{_H["r"]}', 1) WHEN h = 'g' THEN regexp_extract(line, '{_H["g"]}', 1) END AS id,
  CASE WHEN no OR h IS NULL THEN NULL ELSE trim(CASE h WHEN 'n' THEN regexp_extract(line, '{_H["n"]}', 2) WHEN 'm' THEN regexp_extract(line, '{_H["m"]}', 2) WHEN 'c' THEN regexp_extract(line, '{_H["c"]}', 2) WHEN 'r' THEN regexp_extract(line, '{_H["r"]}', 2) ELSE regexp_extract(line, '{_H["g"]}', 2) END) END AS title,
  CASE WHEN no OR h IS NULL THEN NULL WHEN h = 'r' THEN 'regulation' ELSE 'code' END AS type,
  CASE WHEN no OR h IS NULL THEN NULL WHEN h = 'n' THEN trim(substr(line, length(regexp_extract(line, '{_H["n"]}', 0)) + 1)) ELSE '' END AS body FROM k""")
def heading_match(spark, d):
    return filled(spark, d, _HEADINGS).withColumn("h", X.match_heading(F.col("line"))).select("n", "k", "line", "h.id", "h.title", "h.type", "h.body")


_IDS = ["{a}.{b}.{c}", "{a}", "35.{a}(b)", "35.{a}(b)(1)", "{a}, {c}1, {d}0", "{a}.{b}"]


@register(rf"""WITH {_filled(_IDS)}, p AS (SELECT *, string_split(regexp_extract(line, '^[^(]*'), '.') AS dots, regexp_extract(line, '^[^(]*') AS plain, regexp_extract_all(line, '\([^()]*\)') AS g FROM f)
SELECT n, line AS id, array_to_string(list_filter(list_concat(list_transform(range(1, len(dots) + 1), lambda i: array_to_string(dots[1:i], '.')), list_transform(range(1, len(g) + 1), lambda i: plain || array_to_string(g[1:i], ''))), lambda x: x <> line), ' > ') AS ancestors FROM p""")
def ancestor_ids(spark, d):
    return filled(spark, d, _IDS).select("n", F.col("line").alias("id"), F.array_join(X.ancestor_ids(F.col("line")), " > ").alias("ancestors"))


_MARKERS = ["({l}) {w}.  (1) Each of {c}", "({l})", "(B) {w}", "({l}) lower {w}", "({l}) {w} {w} {w} {w} {w} {w} {w} {w} {w} {w} is long. Short.", "{l}) {w}"]


@register(rf"""WITH {_filled(_MARKERS)}, p AS (SELECT *, regexp_matches(line, '{X.PARAGRAPH}') AS hit, regexp_extract(line, '{X.PARAGRAPH}', 2) AS rest FROM f)
SELECT n, k, CASE WHEN hit THEN substr(line, 2, 1) END AS letter, CASE WHEN NOT hit THEN NULL WHEN length(trim(split_part(rest, '.', 1))) <= 60 THEN trim(split_part(rest, '.', 1)) ELSE '' END AS title FROM p""")
def paragraph_marker(spark, d):
    return filled(spark, d, _MARKERS).withColumn("p", X.paragraph_marker(F.col("line"))).select("n", "k", "p.letter", "p.title")


@register("SELECT source, string_agg(letter, '' ORDER BY i) AS letters FROM (SELECT p_brand AS source, p_partkey AS i, chr((97 + p_size % 26)::int) AS letter, max(p_size % 26) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, p_size % 26 AS v FROM part WHERE p_size % 26 NOT IN (8, 21, 23)) WHERE top IS NULL OR v > top GROUP BY source")
def paragraph_sequence(spark, d):
    """The letters that a fold over markers accepts; without letters that look Roman, those above all before them."""
    rows = table(spark, d, "part").where("p_size % 26 not in (8, 21, 23)").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("page"), F.lit(0).alias("i"), F.char(97 + F.col("p_size") % 26).alias("letter"), F.lit("").alias("title"), F.lit("").alias("body"))
    held = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page", "i", "letter", "title", "body"))).alias("m"))
    return held.select("source", F.array_join(F.transform(ingest.accepted_paragraphs(F.col("m")), lambda x: x["letter"]), "").alias("letters"))


_PAGES = ["{c} - 2010 Standards: Titles II and III", "2010 Standards: Titles II and III - {c}Department of Justice", "{c} - Guidance on the 2010 Standards: Title III", "Guidance on the 2010 Standards:  Titles II and III - {d}", "{w} {c}"]


@register(f"WITH {_filled(_PAGES)} SELECT n, line, coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in X.PRINTED_PAGE) + ") AS printed FROM f")
def printed_page(spark, d):
    return filled(spark, d, _PAGES).select("n", "line", X.printed_page(F.col("line")).alias("printed"))


_words = [*X.GLOSSARY, *X.ABBREVIATIONS]
_QUESTIONS = [f"How high can a {w} be for a {x} of {{c}} inches in {{a}}.{{b}}?" for w, x in zip(_words, [*_words[7:], *_words[:7]], strict=True)] + ["See 35.{a}(B), {a}.{b} and 35.{a}(b) for OUTLETS, sinks and the GFCI."]


def _expanded(text: str) -> str:
    for short, full in X.ABBREVIATIONS.items():
        text = rf"regexp_replace({text}, '(?i)\b({short})\b', '\1 ({full})', 'g')"
    return text


_TERMS = ", ".join(rf"CASE WHEN regexp_matches(t, '(?i)\b{w}(?:s|es)?\b') THEN [{', '.join(_lit(x) for x in v.split(', '))}] ELSE [] END" for w, v in X.GLOSSARY.items())


@register(rf"""WITH {_filled(_QUESTIONS)}, x AS (SELECT *, {_expanded('line')} AS t FROM f), y AS (SELECT *, flatten([{_TERMS}]) AS g FROM x),
z AS (SELECT *, list_filter(list_filter(g, lambda v, i: list_position(g, v) = i), lambda v: NOT contains(lower(t), lower(v))) AS new, list_transform(regexp_extract_all(line, '{X.SECTION_REF}', 1), lambda v: lower(v)) AS refs FROM y)
SELECT n * 1000 + k AS query_id, line AS original, CASE WHEN len(new) > 0 THEN t || ' (' || array_to_string(new, ', ') || ')' ELSE t END AS text, array_to_string(list_filter(refs, lambda v, i: list_position(refs, v) = i), ' ') AS refs FROM z""")
def glossary_expand(spark, d):
    asked = filled(spark, d, _QUESTIONS).select((F.col("n") * 1000 + F.col("k")).alias("query_id"), F.col("line").alias("text"))
    return normalise(asked, Config()).select("query_id", "original", "text", F.array_join("section_refs", " ").alias("refs"))


@register("""WITH s AS (SELECT DISTINCT '35.' || (p_partkey % 40) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '(B)' WHEN 2 THEN '(b)(1)' ELSE '(c)' END AS section_id FROM part),
q AS (SELECT p_partkey AS query_id, '35.' || (p_partkey % 50) AS plain FROM part),
t AS (SELECT query_id, pos, kept, CASE kept WHEN 0 THEN plain WHEN 1 THEN plain || g1 ELSE plain || g1 || g2 END AS id FROM q, (VALUES (0, '(b)', '(4)'), (1, '(c)', '(1)'), (2, '(b)', '(1)')) r(pos, g1, g2), (VALUES (0), (1), (2)) c(kept)),
m AS (SELECT query_id, pos, kept, lower(section_id) AS parent_id FROM t JOIN s ON lower(section_id) = id),
b AS (SELECT query_id, parent_id, min(pos) AS pin_pos FROM (SELECT *, max(kept) OVER (PARTITION BY query_id, pos) AS best FROM m) WHERE kept = best GROUP BY ALL),
f AS (SELECT query_id, '35.' || (query_id % 50) || x AS parent_id, 0.5 / y AS rrf, y AS fused_pos FROM q, (VALUES ('(b)', 1), ('', 2), ('(z)', 3)) v(x, y))
SELECT coalesce(f.query_id, b.query_id) AS query_id, coalesce(f.parent_id, b.parent_id) AS parent_id, pin_pos IS NOT NULL AS pinned, coalesce(rrf, 0)::double AS rrf,
  row_number() OVER (PARTITION BY coalesce(f.query_id, b.query_id) ORDER BY pin_pos NULLS LAST, f.fused_pos NULLS LAST, coalesce(f.parent_id, b.parent_id))::int AS fused_pos
FROM f FULL JOIN b ON f.query_id = b.query_id AND f.parent_id = b.parent_id""")
def exact_ref_pin(spark, d):
    """Three references a query, which fall back group by group to sections that exist."""
    p = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, "(B)").when(F.col("p_partkey") % 4 == 2, "(b)(1)").otherwise("(c)")
    sections = p.select(F.concat(F.lit("35."), F.col("p_partkey") % 40, kind).alias("section_id")).distinct().select("section_id", F.lower("section_id").alias("parent_id"), F.lit(True).alias("searchable"), F.lit(1).alias("occurrence"))
    plain = F.concat(F.lit("35."), F.col("p_partkey") % 50)
    refs = p.select(F.col("p_partkey").alias("query_id"), F.posexplode(F.array(*(F.concat(plain, F.lit(g)) for g in ("(b)(4)", "(c)(1)", "(b)(1)")))).alias("pos", "ref"))
    fused = p.select(F.col("p_partkey").alias("query_id"), F.posexplode(F.array(*(F.concat(plain, F.lit(g)) for g in ("(b)", "", "(z)")))).alias("i", "parent_id")).select("query_id", "parent_id", (0.5 / (F.col("i") + 1)).alias("rrf"), (F.col("i") + 1).alias("fused_pos"))
    return search.pin(fused, refs, search.exact_refs(sections)).select("query_id", "parent_id", "pinned", "rrf", "fused_pos")


_SAID = "text || ' [S1, S' || (turn % 12) || '; S9] and [ S' || (conv_id % 5) || ' ] not [S ' || turn || '] or S3'"


@register(rf"""WITH t AS (SELECT conv_id, turn, flatten(list_transform(regexp_extract_all({_SAID}, '{X.CITATION_GROUP}', 1), lambda g: regexp_extract_all(g, 'S\d+'))) AS l FROM conversations),
o AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS k FROM t)
SELECT conv_id, turn, array_to_string(list_filter(k, lambda x: x IN ('S1', 'S2', 'S3')), ' ') AS valid, array_to_string(list_filter(k, lambda x: x NOT IN ('S1', 'S2', 'S3')), ' ') AS invalid FROM o""")
def citation_parse(spark, d):
    c = table(spark, d, "conversations")
    said = F.concat("text", F.lit(" [S1, S"), F.col("turn") % 12, F.lit("; S9] and [ S"), F.col("conv_id") % 5, F.lit(" ] not [S "), "turn", F.lit("] or S3"))
    valid, labels = F.array(*map(F.lit, ("S1", "S2", "S3"))), X.cited_labels(said)
    return c.select("conv_id", "turn", F.array_join(F.array_intersect(labels, valid), " ").alias("valid"), F.array_join(F.array_except(labels, valid), " ").alias("invalid"))


@register("SELECT p_partkey AS n, '[' || p_brand || ' p.' || p_size || CASE WHEN p_partkey % 3 > 0 THEN '-' || (p_size + p_partkey % 3) ELSE '' END || ' §' || p_partkey || '.1]' AS citation FROM part")
def citation_format(spark, d):
    last = F.col("p_size") + (F.col("p_partkey") % 3).cast("int")
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), X.format_citation(F.col("p_brand"), F.col("p_size"), last, F.concat("p_partkey", F.lit(".1"))).alias("citation"))


# --- quantities: what must come out is known from what went in

_NUMBERS = {
    "{w} {c} inches ({e} mm) minimum": "{c} in, {e} mm", "{c} 1/4 in. and {b} ½ inch": "{c}.25 in, {b}.5 in", "a slope of 1 : {c}, see {a}.{b} and § 35.{a}(b)": "1:{c}", "the 2010 Standards [S{b}] of 19{c}": "",
    "1,{d}0 lbf or {c} percent": None, "{c}. {w}\n{c}) {d} ft": "{d} ft", "section {a}, {c} and {d}; comply with {c} and {d}": "", "3/8\" by {c}'": "0.375 in, {c} ft", "{c}.50 N": "{c}.5 N", "-{c} degrees": "{c} deg", "28 CFR part {c}, figure {c}.{b}": "",
}
_KEYS = {k: v for k, v in _NUMBERS.items() if v is not None}


@register(f"WITH {_filled(list(_KEYS))}, g AS (SELECT n, k, line AS keys FROM ({_filled(list(_KEYS.values()))[6:-1]})) SELECT f.n, f.k, f.line, g.keys FROM f JOIN g ON g.n = f.n AND g.k = f.k")
def extract_numbers(spark, d):
    return filled(spark, d, list(_KEYS)).select("n", "k", "line", F.array_join(F.transform(Qt.numbers(F.col("line")), Qt.shown_key), ", ").alias("keys"))


_REQUIRED = [
    "Openings shall be at least {c} inches wide.", "The height shall not exceed {c} inches.", "a clear width of {c} inches ({e} mm) minimum", "between {c} and {d} inches above the floor", "Openings are {c} inches.",
    "at least {c} inches or at least {d} inches", "{c}-{d} inches", "no less than {d} inches and no more than {c} inches", "not a minimum height, but a maximum height of {c} inches", "{c} feet minimum",
]
_LIMITS = "CASE k WHEN 0 THEN [c, NULL] WHEN 1 THEN [NULL, c] WHEN 2 THEN [c, NULL] WHEN 3 THEN [c, c + 60] WHEN 6 THEN [c, c + 60] WHEN 7 THEN [c + 60, c] WHEN 8 THEN [NULL, c] END"


@register(f"""WITH {_filled(_REQUIRED, "p_size", "p_partkey")}, g AS (SELECT *, 30 + p_size AS c, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'needs_review' ELSE 'verified' END AS status, 20 + p_partkey % 120 AS x FROM f),
h AS (SELECT *, {_LIMITS} AS lim FROM g)
SELECT n, k, CASE WHEN p_partkey % 13 = 0 OR status <> 'verified' OR lim IS NULL OR lim[1] > lim[2] THEN 'needs_review' WHEN x < lim[1] OR x > lim[2] THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN p_partkey % 13 = 0 THEN 'no grounded requirement (refused: no_valid_citation)' WHEN status <> 'verified' THEN 'requirement not verified (number grounding: needs_review)' WHEN k = 4 OR k = 9 THEN 'no minimum or maximum in in found in the requirement'
    WHEN k = 5 THEN 'several different limits: minimums [''' || least(c || ' inches', (c + 60) || ' inches') || ''', ''' || greatest(c || ' inches', (c + 60) || ' inches') || '''], maximums []'
    WHEN k = 7 THEN 'minimum ' || (c + 60) || ' inches is above maximum ' || c || ' inches' WHEN x < lim[1] THEN x || ' in is below the minimum ' || c || CASE WHEN k IN (3, 6) THEN '' ELSE ' inches' END
    WHEN x > lim[2] THEN x || ' in is above the maximum ' || lim[2] || ' inches' ELSE x || ' in is within the limits' END AS reason FROM h""")
def outcome_rules(spark, d):
    rows = filled(spark, d, _REQUIRED, "p_partkey").withColumn("given", F.when(F.col("p_partkey") % 13 != 0, F.col("line")))
    status = F.when(F.col("p_partkey") % 13 == 0, None).when(F.col("p_partkey") % 11 == 0, "needs_review").otherwise("verified")
    got = rows.withColumn("o", Qt.outcome(F.col("given"), status, (20 + F.col("p_partkey") % 120).cast("string"), F.lit("in"), F.when(F.col("given").isNull(), "no_valid_citation")))
    return got.select("n", "k", "o.status", "o.reason")


_ANSWERS = ["{w} is {c} inches [S1].", "{w} is {d} inches [S1].", "{w} is {e} lb [S1].", "{w} is {c} inches.\n[S1] Slope is 1:{b} [S2].", "{w} is {c} inches and {d} in. [S2]", "No numbers [S1].", "{w} is {d} inches. It has {c} in [S1]."]
_STATUS = "CASE k WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'refused' WHEN 3 THEN 'verified' WHEN 4 THEN 'needs_review' WHEN 5 THEN 'verified' ELSE 'needs_review' END"
_FLAGGED = "CASE k WHEN 1 THEN {d} || ' inches' WHEN 2 THEN {e} || ' lb' WHEN 4 THEN {c} || ' inches' WHEN 6 THEN {d} || ' inches' ELSE '' END".format(**{k: f"({v[1]})" for k, v in _FILL.items()})


@register(f"WITH {_filled(_ANSWERS, _FLAGGED + ' AS flagged')} SELECT n, k, {_STATUS} AS status, flagged FROM f")
def grounding_status(spark, d):
    """Each answer's numbers against two sources: its own part's size, and a larger one with a slope."""
    said = filled(spark, d, _ANSWERS, "p_size").withColumn("answer_id", F.col("n") * 100 + F.col("k"))
    texts = [F.concat(F.lit("clear width "), 30 + F.col("p_size"), F.lit(" in. minimum")), F.concat(F.lit("slope 1 : "), F.col("n") % 7 + 1, F.lit("; "), 90 + F.col("p_size"), F.lit(" inches maximum"))]
    src = said.select("answer_id", F.explode(F.array(*(F.struct(F.lit(f"S{i}").alias("label"), t.alias("text")) for i, t in enumerate(texts, 1)))).alias("s")).select("answer_id", "s.*")
    got = A.ground(said.select("answer_id", F.col("line").alias("text")), src)
    return got.select(F.floor(F.col("answer_id") / 100).alias("n"), (F.col("answer_id") % 100).cast("int").alias("k"), "status", F.array_join("flagged", ", ").alias("flagged"))


_CLAIMED = ["{w} is {c} in. wide [S1, S2]! See [S{b}].\n[S1; S3].\n\nThen {w}?", "{w}.", "[S{b}] alone"]


@register(f"WITH {_filled(_CLAIMED)} SELECT n, k, CASE k WHEN 0 THEN regexp_extract(line, '^(.*is \\d+ in\\.)', 1) || '|' || regexp_extract(line, '(wide .*!) See', 1) || ' S1 S2|' || regexp_extract(line, '(See .*)\\n\\[S1', 1) || ' [S1; S3]. ' || array_to_string(list_distinct_ordered, ' ') || '|' || regexp_extract(line, '(Then .*)$', 1) || ' ' WHEN 1 THEN line || ' ' ELSE line || ' S' || (n % 7 + 1) END AS claims FROM (SELECT *, list_filter(['S' || (n % 7 + 1), 'S1', 'S3'], lambda x, i: list_position(['S' || (n % 7 + 1), 'S1', 'S3'], x) = i) AS list_distinct_ordered FROM f)".replace("regexp_extract(line, '^(.*is \\d+ in\\.)', 1) || '|'", "regexp_extract(line, '^(.*is \\d+ in\\.)', 1) || ' |'"))
def claim_split(spark, d):
    got = filled(spark, d, _CLAIMED).withColumn("c", A.claims(F.col("line")))
    return got.select("n", "k", F.array_join(F.transform("c", lambda c: F.concat(c["sentence"], F.lit(" "), F.array_join(c["labels"], " "))), "|").alias("claims"))


# --- contexts and prompts


@register("SELECT p_partkey AS n, CASE WHEN t <= (a + b + c) THEN t ELSE a + b + c END AS total, least(least(a, b, c), t // 3) AS smallest FROM (SELECT p_partkey, p_size * 10 AS a, p_size * 20 AS b, 400 AS c, 300 + p_partkey % 900 AS t FROM part)")
def prompt_budget(spark, d):
    """Shares of three lengths: all of it is given out, and the shortest gets a third at most."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.array(F.col("p_size") * 10, F.col("p_size") * 20, F.lit(400)).alias("l"), (300 + F.col("p_partkey") % 900).alias("t"))
    shares = A.budget(F.col("l"), F.col("t"))
    return p.withColumn("s", shares).select("n", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("s").cast("long").alias("smallest"))


@register("SELECT p_partkey AS n, greatest(0, least(1000, greatest(0, m - 150) + 300) - 300) AS a, least(1000, greatest(0, m - 150) + 300) AS b FROM (SELECT p_partkey, (least(x, CASE WHEN greatest(x, y) + 50 - least(x, y) <= 300 THEN y ELSE x END) + greatest(x, CASE WHEN greatest(x, y) + 50 - least(x, y) <= 300 THEN y ELSE x END) + 50) // 2 AS m FROM (SELECT p_partkey, (p_partkey * 37) % 950 AS x, (p_partkey * 91) % 950 AS y FROM part))")
def window_choice(spark, d):
    """A window of 300 of 1,000 characters around two spans, where both fit."""
    p = table(spark, d, "part").withColumn("x", (F.col("p_partkey") * 37) % 950).withColumn("y", (F.col("p_partkey") * 91) % 950)
    w = A.window(F.lit(1000), F.array(A.span(F.col("x"), F.col("x") + 50), A.span(F.col("y"), F.col("y") + 50)), 300)
    return p.select(F.col("p_partkey").alias("n"), w.alias("w")).select("n", F.col("w.start").cast("long").alias("a"), F.col("w.end").cast("long").alias("b"))


@register("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE CASE WHEN s > 0 THEN '[…] ' ELSE '' END || substr(text, s + 1, 200) || CASE WHEN s + 200 < length(text) THEN ' […]' ELSE '' END END AS short FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE greatest(0, least(length(text), greatest(0, doc_id % 150 + 10 - 100) + 200) - 200) END AS s FROM documents)")
def shortened_sources(spark, d):
    """Documents cut to 200 characters around a focus of 20, a third of them from the start."""
    t = table(spark, d, "documents")
    focus = F.when(F.col("doc_id") % 3 != 0, A.span(F.col("doc_id") % 150, F.col("doc_id") % 150 + 20))
    return t.select("doc_id", A.shorten(F.col("text"), focus, F.lit(200))["text"].alias("short"))


def _ranked(spark, d) -> DataFrame:
    """Three documents as the contexts of each benchmark item."""
    t = table(spark, d, "documents").where("text != ''").select((F.col("doc_id") % 41).alias("query_id"), "doc_id", F.col("text").alias("context"), "source")
    w = Window.partitionBy("query_id").orderBy("doc_id")
    top = t.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return top.select("query_id", "rank", "context", F.lit(None).cast("struct<start:int,end:int>").alias("focus"), "source", F.concat(F.lit("doc."), "doc_id").alias("section_id"), F.lit("").alias("section_title"), F.concat(F.lit("C > "), "doc_id").alias("breadcrumb"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"))


_RANKED = """x AS (SELECT doc_id % 41 AS query_id, doc_id, text, source, row_number() OVER (PARTITION BY doc_id % 41 ORDER BY doc_id) AS rank FROM documents WHERE text <> ''), y AS (SELECT * FROM x WHERE rank <= 3),
z AS (SELECT *, length(text) AS len, row_number() OVER (PARTITION BY query_id ORDER BY length(text), rank) AS o, count(*) OVER (PARTITION BY query_id) AS m FROM y),
s1 AS (SELECT *, CASE WHEN o = 1 THEN least(len, 900 // m) END AS s FROM z), l1 AS (SELECT *, 900 - sum(s) OVER (PARTITION BY query_id) AS left1 FROM s1),
s2 AS (SELECT *, CASE WHEN o = 1 THEN s WHEN o = 2 THEN least(len, left1 // (m - 1)) END AS t FROM l1), s3 AS (SELECT *, CASE WHEN o < 3 THEN t ELSE least(len, 900 - sum(t) OVER (PARTITION BY query_id)) END AS share FROM s2),
src AS (SELECT query_id, rank, source, doc_id, CASE WHEN len <= share THEN text ELSE left(text, share::int) || ' […]' END AS text FROM s3)"""


@register(f"WITH {_RANKED} SELECT query_id, md5('Sources:' || chr(10) || chr(10) || string_agg('[S' || rank || '] [' || source || ' p.1-2 §doc.' || doc_id || '] C > ' || doc_id || chr(10) || src.text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(b.text) || chr(10) || 'Answer using only the sources, citing every claim as [S#], or reply NOT_IN_SOURCES.') AS prompt FROM src JOIN benchmark b ON item_id = query_id GROUP BY query_id")
def prompt_texts(spark, d):
    """Whole prompts of three sources in 900 characters: shares by filling the shortest first, labels in rank order."""
    src = A.sources(C.cite(_ranked(spark, d)), 900)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return src.join(items, "query_id").select("query_id", F.md5(A.user_prompt(F.col("question"), F.col("sources"))).alias("prompt"))


# --- answers

_REPLIES = ["Nothing: NOT_IN_SOURCES", "No label at all.", "Wrong label [S9].", "It is 987654321 lb [S1].", "A fact without numbers [S1]. Another [S7]."]


def scripted(rows: DataFrame) -> DataFrame:
    """A language model that replies by the query's number; it grades sources of every fourth query as irrelevant."""
    by_number = F.element_at(F.array(*map(F.lit, _REPLIES)), (F.col("query_id") % 5 + 1).cast("int"))
    verdict = F.when(F.col("query_id") % 4 == 0, "No.").when(F.col("query_id") % 4 == 1, "hard to say").otherwise("Yes, it does")
    grading, rewriting = F.col("user").contains("Reply with one word"), F.col("user").endswith("Search query:")
    return models.metered(rows.withColumn("reply", F.when(grading, verdict).when(rewriting, F.concat(F.lit("Search query: other "), "query_id")).otherwise(by_number)))


def _questions(spark, d) -> DataFrame:
    """The benchmark's items, and three that find nothing."""
    more = spark.range(1000, 1003).select(F.col("id").alias("query_id"), F.lit("nothing").alias("question"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).unionByName(more)


_ASKED = "a AS (SELECT item_id AS query_id, item_id IN (SELECT doc_id % 41 FROM documents WHERE text <> '') AS has FROM benchmark UNION ALL SELECT unnest(range(1000, 1003)), false)"
_REASON = "CASE WHEN NOT has THEN 'no_relevant_sources' ELSE CASE query_id % 5 WHEN 0 THEN 'model_not_in_sources' WHEN 1 THEN 'no_valid_citation' WHEN 2 THEN 'no_valid_citation' WHEN 3 THEN 'ungrounded_number' END END"
_OUT = f"""query_id, {{reason}} IS NOT NULL AS refused, {{reason}} AS refusal_reason, CASE WHEN {{reason}} IS NOT NULL THEN {_lit(A.REFUSAL_TEXT)} ELSE {_lit(_REPLIES[4])} END AS text,
  CASE WHEN {{given}} AND query_id % 5 = 2 THEN 'S9' WHEN {{given}} AND query_id % 5 = 4 THEN 'S7' ELSE '' END AS invalid, CASE WHEN {{given}} AND query_id % 5 = 3 THEN 'refused' WHEN {{given}} AND query_id % 5 = 4 THEN 'verified' END AS status,
  CASE WHEN {{given}} AND query_id % 5 = 3 THEN '987654321 lb' ELSE '' END AS flagged, CASE WHEN {{given}} AND query_id % 5 >= 3 THEN 'S1' ELSE '' END AS cited"""


def _told(answers: DataFrame, *more) -> DataFrame:
    return answers.select(
        "query_id", "refused", "refusal_reason", "text", F.array_join("invalid_labels", " ").alias("invalid"), F.col("grounding_status").alias("status"), F.array_join(F.transform("flagged", lambda f: f["key"]), " ").alias("flagged"),
        F.array_join(F.transform("citations", lambda c: c["label"]), " ").alias("cited"), *more)


@register(f"WITH {_ASKED} SELECT {_OUT.format(reason=_REASON, given='has')}, has::int AS llm_calls FROM a")
def answer_chain(spark, d):
    """Every gate of the chain, by a scripted model."""
    return _told(C.answer_from(_questions(spark, d), _ranked(spark, d), scripted, 900), "llm_calls")


_G_REASON = f"CASE WHEN NOT has THEN 'no_relevant_sources' WHEN query_id % 4 = 0 THEN 'graded_not_relevant' ELSE {_REASON} END"
_TRIES = "CASE WHEN NOT has OR query_id % 4 = 0 THEN 2 ELSE 0 END"


@register(f"WITH {_ASKED}, n AS (SELECT query_id, count(*) AS m FROM (SELECT doc_id % 41 AS query_id, row_number() OVER (PARTITION BY doc_id % 41 ORDER BY doc_id) AS r FROM documents WHERE text <> '') WHERE r <= 3 GROUP BY 1) SELECT {_OUT.format(reason=_G_REASON, given='has AND query_id % 4 <> 0').replace('query_id,', 'a.query_id,', 1).replace('query_id %', 'a.query_id %')}, {_TRIES.replace('query_id', 'a.query_id')} AS retries, (coalesce(m, 0) * (1 + {_TRIES.replace('query_id', 'a.query_id')}) + {_TRIES.replace('query_id', 'a.query_id')} + (has AND a.query_id % 4 <> 0)::int)::int AS llm_calls, (coalesce(m, 0) * (1 + {_TRIES.replace('query_id', 'a.query_id')}))::int AS n_grades FROM a LEFT JOIN n ON n.query_id = a.query_id")
def agent_rounds(spark, d):
    """Grading, two rewrites where no source is relevant, then an answer or a refusal."""
    ranked = stash(_ranked(spark, d), "ranked")
    retrieve = lambda q: ranked.join(q.select("query_id"), "query_id", "left_semi")
    got = G.agent(_questions(spark, d), retrieve, scripted, total=900)
    return _told(got, "retries", "llm_calls", F.size("grades").alias("n_grades"))


# --- checklists


def _items(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("element"), F.struct((20 + F.col("p_partkey") % 120).cast("string").alias("value"), F.lit("in").alias("unit")).alias("measured"), F.col("p_name").alias("question"),
        F.when(F.col("p_partkey") % 3 == 0, "pass").otherwise("fail").alias("expected_outcome"), F.concat((F.col("p_partkey") % 5).cast("string"), F.lit(".1")).alias("expected_section"))


def _answered(items: DataFrame):
    """Answers to items by their numbers: a minimum of 60 inches, refused for every tenth."""
    refused = F.col("query_id") % 10 == 9
    citation = F.struct(F.lit("S1").alias("label"), F.lit("f").alias("source"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("3.1").alias("section_id"), F.lit("").alias("section_title"), F.lit("[f p.1 §3.1]").alias("citation"))
    return lambda asked: asked.select(
        "query_id", "question", F.lit("at least 60 inches [S1]").alias("text"), refused.alias("refused"), F.when(refused, "no_valid_citation").alias("refusal_reason"),
        F.when(refused, F.array().cast(C.CITATION)).otherwise(F.array(citation).cast(C.CITATION)).alias("citations"), F.when(~refused, "verified").alias("grounding_status"), F.array().cast(C.FLAGGED).alias("flagged"))


_DRAFT = "CASE WHEN p_partkey % 10 = 9 THEN 'needs_review' WHEN 20 + p_partkey % 120 < 60 THEN 'fail' ELSE 'pass' END"


@register(f"SELECT p_partkey AS item_id, {_DRAFT} AS outcome, CASE WHEN p_partkey % 10 <> 9 THEN '60 inches' END AS minimum, CASE WHEN p_partkey % 10 <> 9 THEN 'at least 60 inches [S1]' END AS requirement, CASE WHEN p_partkey % 10 = 9 THEN '' ELSE '[f p.1 §3.1]' END AS cited FROM part")
def draft_findings(spark, d):
    items = _items(spark, d)
    return R.draft(items, _answered(items)).select("item_id", "outcome", "limits.minimum", "requirement", F.array_join("citations", " ").alias("cited"))


@register(f"SELECT count(*) AS items, count(*) FILTER (o = e) AS as_expected, count(*) FILTER (o <> e AND o <> 'needs_review') AS wrong, count(*) FILTER (o = 'needs_review') AS needs_review, count(*) FILTER (p_partkey % 10 <> 9 AND p_partkey % 5 = 3) AS cites_expected FROM (SELECT p_partkey, {_DRAFT} AS o, CASE WHEN p_partkey % 3 = 0 THEN 'pass' ELSE 'fail' END AS e FROM part)")
def checklist_ratios(spark, d):
    items = _items(spark, d)
    return R.ratios(R.draft(items, _answered(items)))


def _reviewed(spark, d) -> DataFrame:
    """Drafts with two decisions each, of which the last counts."""
    items = _items(spark, d)
    found = R.draft(items, _answered(items))
    told = F.array(F.struct(F.lit(1).alias("pos"), F.lit("edit").alias("action"), F.lit("needs_review").alias("outcome"), F.lit("first").alias("note")), F.struct(
        F.lit(2).alias("pos"), F.when(F.col("id") % 4 == 0, "edit").otherwise("approve").alias("action"), F.when(F.col("id") % 4 == 0, "fail").alias("outcome"), F.when(F.col("id") % 4 == 0, F.lit("measured again")).alias("note")))
    return A.apply_decisions(found, items.select(F.col("id").alias("item_id"), F.explode(told).alias("t")).select("item_id", "t.*"))


@register(f"SELECT p_partkey AS item_id, {_DRAFT} AS outcome, CASE WHEN p_partkey % 4 = 0 THEN 'fail' ELSE {_DRAFT} END AS final_outcome, CASE WHEN p_partkey % 4 = 0 THEN 'edit' ELSE 'approve' END AS action, p_partkey % 4 = 0 AND {_DRAFT} <> 'fail' AS changed FROM part")
def decision_merge(spark, d):
    return _reviewed(spark, d).select("item_id", "outcome", "final_outcome", "review.action", "review.changed")


_SHOWN = f"(SELECT p_partkey, p_name, {_DRAFT} AS o FROM part WHERE p_partkey < 20)"


@register(f"SELECT string_agg('| ' || p_name || ' | ' || (20 + p_partkey % 120) || ' in | ' || CASE WHEN p_partkey % 10 = 9 THEN '–' ELSE 'minimum 60 inches' END || ' | ' || CASE WHEN p_partkey % 10 = 9 THEN '–' ELSE '[f p.1 §3.1]' END || ' | ' || o || ' | **' || CASE WHEN p_partkey % 4 = 0 THEN 'fail' || CASE WHEN o <> 'fail' THEN ' (edited)' ELSE '' END ELSE o END || '** | ' || CASE WHEN p_partkey % 4 = 0 THEN 'measured again' ELSE '–' END || ' |', chr(10) ORDER BY p_partkey) AS lines FROM {_SHOWN}")
def findings_report(spark, d):
    """The report's table of a checklist of the first twenty items (a checklist is one document)."""
    out = R.report(_reviewed(spark, d).where("item_id < 20"), "c", "T", F.lit("now"))
    return out.select(F.array_join(F.filter(F.split("markdown", "\n"), lambda x: x.rlike(r"^\| (?!item )") & ~x.startswith("|---")), "\n").alias("lines"))


# --- evaluation

#: Events as answered questions of three setups.
_RESULTS = "SELECT event_id AS query_id, event_id % 3 AS setup, event_id % 6 < 4 AS in_corpus, value > 60 AS refused, CASE WHEN value > 100 THEN 'no_valid_citation' WHEN value > 60 THEN 'ungrounded_number' END AS refusal_reason, CASE WHEN event_id % 5 < 3 THEN value <= 60 AND user_id % 3 > 0 END AS contains_ok, CASE WHEN event_id % 6 < 4 AND value <= 60 THEN user_id % 2 = 0 END AS citation_valid, CASE WHEN value <= 60 THEN CASE WHEN user_id % 4 = 0 THEN 'needs_review' ELSE 'verified' END WHEN value <= 100 THEN 'refused' END AS grounding_status, (user_id % 4)::int AS llm_calls, user_id AS input_tokens, event_id % 50 AS output_tokens, value AS latency_ms FROM events"


def _evaluated(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    refused = F.col("value") > 60
    return e.select(
        F.col("event_id").alias("query_id"), (F.col("event_id") % 3).alias("setup"), (F.col("event_id") % 6 < 4).alias("in_corpus"), refused.alias("refused"),
        F.when(F.col("value") > 100, "no_valid_citation").when(refused, "ungrounded_number").alias("refusal_reason"), F.when(F.col("event_id") % 5 < 3, ~refused & (F.col("user_id") % 3 > 0)).alias("contains_ok"),
        F.when((F.col("event_id") % 6 < 4) & ~refused, F.col("user_id") % 2 == 0).alias("citation_valid"),
        F.when(~refused, F.when(F.col("user_id") % 4 == 0, "needs_review").otherwise("verified")).when(F.col("value") <= 100, "refused").alias("grounding_status"),
        (F.col("user_id") % 4).cast("int").alias("llm_calls"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"), F.col("value").alias("latency_ms"),
        models.shadow_cost(F.col("user_id"), F.col("event_id") % 50).alias("shadow_cost"))


def _ratio(name: str, hit: str, among: str) -> str:
    return f"count(*) FILTER ({among} AND {hit}) AS {name}_n, count(*) FILTER ({among}) AS {name}_of, round((count(*) FILTER ({among} AND {hit}))::double / nullif(count(*) FILTER ({among}), 0), 6) AS {name}"


@register(f"WITH r AS ({_RESULTS}) SELECT setup, count(*) AS n, count(*) FILTER (grounding_status = 'verified' AND NOT contains_ok) AS wrong_but_verified, " + ", ".join([
    _ratio("correct", "contains_ok", "contains_ok IS NOT NULL"), _ratio("correct_verified", "contains_ok", "contains_ok IS NOT NULL AND grounding_status = 'verified'"), _ratio("correct_review", "contains_ok", "contains_ok IS NOT NULL AND grounding_status = 'needs_review'"),
    _ratio("needs_review", "grounding_status = 'needs_review'", "grounding_status IN ('verified', 'needs_review')"), _ratio("citation_valid", "citation_valid", "citation_valid IS NOT NULL"), _ratio("refusal_accuracy", "refused", "NOT in_corpus"), _ratio("false_refusals", "refused", "in_corpus"),
]) + ", round(avg(llm_calls), 6) AS calls_mean, max(llm_calls) AS calls_max, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms, round(avg(input_tokens), 6) AS tokens_in, round(avg(output_tokens), 6) AS tokens_out FROM r GROUP BY setup")
def answer_metrics(spark, d):
    return evalx.answer_metrics(_evaluated(spark, d), ["setup"])


@register(f"WITH r AS ({_RESULTS}) SELECT setup, refusal_reason, count(*) AS n FROM r WHERE in_corpus AND refused GROUP BY ALL")
def refusal_reasons(spark, d):
    return evalx.refusal_reasons(_evaluated(spark, d), ["setup"])


_WORDS = "CASE WHEN refused THEN 'refused (' || refusal_reason || ')' || CASE WHEN in_corpus THEN '' ELSE ' ✓' END WHEN NOT in_corpus THEN 'ANSWERED (out of corpus)' ELSE CASE WHEN contains_ok IS NULL THEN 'answered' WHEN contains_ok THEN 'correct' ELSE 'WRONG' END || CASE WHEN grounding_status = 'needs_review' THEN ' [review]' ELSE '' END END"


@register(f"WITH r AS ({_RESULTS}) SELECT query_id, {_WORDS} AS outcome FROM r")
def outcome_labels(spark, d):
    return evalx.labelled(_evaluated(spark, d)).select("query_id", "outcome")


@register(f"WITH r AS ({_RESULTS}), l AS (SELECT query_id // 3 AS question, setup, {_WORDS} AS outcome FROM r), g AS (SELECT question, string_agg(setup || '=' || outcome, '; ' ORDER BY setup) AS outcomes FROM l GROUP BY question HAVING count(DISTINCT outcome) > 1) SELECT question AS query_id, outcomes FROM g")
def outcome_diff(spark, d):
    """Three events in a row as the outcomes of one question under three setups."""
    rows = evalx.labelled(_evaluated(spark, d)).select(F.floor(F.col("query_id") / 3).alias("query_id"), F.col("setup").cast("string").alias("setup"), "outcome")
    diff = evalx.outcome_diff(rows)
    return diff.select("query_id", F.array_join(F.transform(F.array_sort(F.map_entries("outcomes")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "; ").alias("outcomes"))


@register(f"WITH r AS ({_RESULTS}) SELECT setup, m.model, round(1000 * sum((input_tokens * m.a + output_tokens * m.b) / 1e6) / count(*), 6) AS usd FROM r, (VALUES ('small', 1.0::double, 5.0::double), ('medium', 2.0, 10.0), ('large', 5.0, 25.0)) m(model, a, b) GROUP BY ALL")
def cost_per_1000(spark, d):
    return evalx.cost_per_1000(_evaluated(spark, d), ["setup"])


@register("SELECT p_brand, arg_min(run, (-mrr, -hit_3, run)) AS run, max(mrr) AS mrr, -min((-mrr, -hit_3))[2] AS hit_3 FROM (SELECT p_brand, p_name AS run, p_size % 5 / 4 AS mrr, p_partkey % 3 / 2 AS hit_3 FROM part WHERE p_partkey % 4 > 0) GROUP BY p_brand")
def best_run(spark, d):
    """The best of the runs that rerank, by MRR, then hit@3, then name, of each brand."""
    runs = table(spark, d, "part").select("p_brand", F.col("p_name").alias("run"), (F.col("p_partkey") % 4 > 0).alias("uses_rerank"), (F.col("p_size") % 5 / 4).alias("mrr"), (F.col("p_partkey") % 3 / 2).alias("hit_3"))
    return evalx.best_run(runs, ["p_brand"])


@register("WITH c AS (SELECT p_brand, ['replace', 'rrf', 'blend'][p_partkey % 3 + 1] AS mode, p_partkey % 3 AS place, max(p_size) AS correct FROM part GROUP BY ALL), b AS (SELECT p_brand, max(correct) AS best FROM c GROUP BY 1) SELECT p_brand, arg_min(mode, place) AS mode, any_value(best) AS best FROM c JOIN b USING (p_brand) WHERE correct >= best - 1 GROUP BY p_brand")
def simplest_mode(spark, d):
    modes = F.element_at(F.array(*map(F.lit, evalx.MODES)), (F.col("p_partkey") % 3 + 1).cast("int"))
    counts = table(spark, d, "part").groupBy("p_brand", modes.alias("mode")).agg(F.max("p_size").alias("correct"))
    return evalx.simplest_mode(counts, ["p_brand"])


@register("SELECT user_id, event_type AS stage, sum(floor(value)) AS ms FROM events GROUP BY ALL")
def stage_times(spark, d):
    return G.stage_times(table(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), F.floor("value").cast("double").alias("ms")), ["user_id"])


@register("""WITH o AS (SELECT event_id % 500 AS query_id, event_id AS parent_id, value, event_id % 97 = 0 AS pinned, row_number() OVER (PARTITION BY event_id % 500 ORDER BY value DESC, event_id) AS position FROM events),
s(setting, threshold, final_k) AS (VALUES ('a', 0.0, 3), ('b', 50.0, 3), ('c', 100.0, 5)),
f AS (SELECT setting, query_id, parent_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY position) AS rank, final_k FROM o, s WHERE pinned OR value >= threshold),
k AS (SELECT * FROM f WHERE rank <= final_k), q AS (SELECT query_id, query_id % 4 > 0 AS in_corpus FROM (SELECT DISTINCT event_id % 500 AS query_id FROM events)),
a AS (SELECT setting, k.query_id, rank AS answer_rank FROM k WHERE parent_id = k.query_id), n AS (SELECT setting, query_id, count(*) AS n_found FROM k GROUP BY ALL),
r AS (SELECT s.setting, q.query_id, in_corpus, CASE WHEN in_corpus THEN answer_rank END AS answer_rank, coalesce(n_found, 0) AS n_found FROM q, s LEFT JOIN a ON a.setting = s.setting AND a.query_id = q.query_id LEFT JOIN n ON n.setting = s.setting AND n.query_id = q.query_id)
SELECT setting, count(*) AS n, round(avg(CASE WHEN in_corpus THEN coalesce((answer_rank <= 1)::int, 0) END), 6) AS hit_1, round(avg(CASE WHEN in_corpus THEN coalesce((answer_rank <= 3)::int, 0) END), 6) AS hit_3, round(avg(CASE WHEN in_corpus THEN coalesce((answer_rank <= 5)::int, 0) END), 6) AS hit_5, round(avg(CASE WHEN in_corpus THEN coalesce(1.0::double / answer_rank, 0) END), 6) AS mrr, round(avg(CASE WHEN NOT in_corpus THEN (n_found = 0)::int END), 6) AS refusal_accuracy, round(avg(CASE WHEN in_corpus THEN (n_found = 0)::int END), 6) AS false_refusals, count(*) FILTER (CASE WHEN in_corpus THEN coalesce(answer_rank <= 3, false) ELSE n_found = 0 END) AS correct FROM r GROUP BY setting""")
def config_grid(spark, d):
    """Events as reranked candidates of 500 questions; the event with the question's number answers it; three settings in one plan."""
    e = table(spark, d, "events").select((F.col("event_id") % 500).alias("query_id"), F.col("event_id").alias("parent_id"), F.col("value").alias("rerank_score"), (F.col("event_id") % 97 == 0).alias("pinned"))
    ordered = e.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "parent_id")))
    questions = e.select("query_id").distinct().withColumn("in_corpus", F.col("query_id") % 4 > 0)
    expected = questions.where("in_corpus").select("query_id", F.lit(1).alias("grp"), F.col("query_id").alias("parent_id"))
    settings = spark.createDataFrame([("a", 0.0, 3), ("b", 50.0, 3), ("c", 100.0, 5)], "setting string, threshold double, final_k int")
    return evalx.grid(ordered, expected, questions, settings)


@register("SELECT p_partkey AS n, p_partkey % 3 = 0 AS whole, p_partkey % 2 = 0 AS both FROM part")
def contains_numbers(spark, d):
    """'12' is in a text only where it stands alone, of 'a|b' either will do."""
    text = F.concat(F.lit("it is "), F.when(F.col("p_partkey") % 3 == 0, "12").when(F.col("p_partkey") % 3 == 1, "12.5").otherwise("112"), F.lit(" in. and "), F.when(F.col("p_partkey") % 2 == 0, "a 1:12 slope").otherwise("1:120"), F.lit("."))
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), X.contains_expected(text, F.array(F.lit("12 in"))).alias("whole"), X.contains_expected(text, F.array(F.lit("no|1:12"), F.lit("it"))).alias("both"))


_GRADED = ["Yes.", "no", "I think NO, not yes", "hard to say", "noted; yes"]


@register("SELECT p_partkey AS n, CASE p_partkey % 5 WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS relevant, p_partkey % 5 <> 3 AS parsed, CASE p_partkey % 3 WHEN 0 THEN 'door ' || p_name WHEN 1 THEN p_name ELSE 'fallback' END AS query FROM part")
def model_replies(spark, d):
    """Grades and rewritten queries as models put them."""
    grade = F.element_at(F.array(*map(F.lit, _GRADED)), (F.col("p_partkey") % 5 + 1).cast("int"))
    reply = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('\n Search query: "door '), "p_name", F.lit('"\nmore'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("`"), "p_name", F.lit("`"))).otherwise("''\n \n")
    return table(spark, d, "part").withColumn("g", X.parse_grade(grade)).select(F.col("p_partkey").alias("n"), "g.relevant", "g.parsed", X.parse_rewrite(reply, F.lit("fallback")).alias("query"))


@register("SELECT p_partkey AS n, CASE WHEN p_partkey % 2 = 0 THEN (p_size + 1) / (p_size + 2.0::double) ELSE p_size::double + 0.5 END AS value FROM part")
def numeric_values(spark, d):
    value = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size") + 1, F.lit(":"), F.col("p_size") + 2)).otherwise(F.concat("p_size", F.lit(".5")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), X.numeric_value(value).alias("value"))


@register("SELECT source, count(*) AS sections, count(*) FILTER (length(text) < 200) AS heading_only, count(*) FILTER (doc_id % 7 = 0) AS paragraphs, count(DISTINCT CASE WHEN o > 1 THEN g END) AS repeated_ids, count(*) FILTER (o > 1) AS extra_occurrences, sum(doc_id % 2) AS continuations FROM (SELECT *, doc_id % 35 AS g, row_number() OVER (PARTITION BY source, doc_id % 35 ORDER BY doc_id) AS o FROM documents) GROUP BY source")
def report_counts(spark, d):
    """Documents as sections of their source, with ids that repeat."""
    t = table(spark, d, "documents").withColumn("g", F.col("doc_id") % 35)
    ident = F.concat((F.col("g")).cast("string"), F.when(F.col("doc_id") % 7 == 0, "(a)").otherwise(""))
    rows = ingest.occurrences(t, ["source", "g"], ["doc_id"]).select("source", ident.alias("section_id"), "occurrence", (F.col("doc_id") % 2).alias("continuations"), (F.length("text") < 200).alias("heading_only"), F.when(F.col("doc_id") % 7 == 0, "regulation").otherwise("code").alias("section_type"))
    return ingest.report_counts(rows)


@register("SELECT '| run | hit@3 | MRR |' || chr(10) || '|---|---|---|' || string_agg(chr(10) || '| ' || r || ' | ' || round(100 * h)::int || '% | ' || printf('%.3f', m) || ' |', '' ORDER BY r) AS markdown FROM (SELECT p_brand AS r, avg(p_size) / 64 AS h, floor(avg(p_partkey % 4) * 100) / 1000 AS m FROM part GROUP BY 1)")
def report_table(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("run")).agg((F.avg("p_size") / 64).alias("h"), (F.floor(F.avg(F.col("p_partkey") % 4) * 100) / 1000).alias("m"))
    return E.markdown(rows, {"run": "run", "hit@3": X.percent(F.col("h")), "MRR": F.format_string("%.3f", "m")}, ["run"])
