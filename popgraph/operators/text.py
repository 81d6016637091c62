"""Text mining of responses and guideline pages as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keyword lists of the rules below.
HIGH_RISK = ["concerned", "worried", "anxious", "afraid", "terrified", "dangerous", "severe", "serious", "critical", "high risk"]
LOW_RISK = ["confident", "safe", "protected", "low risk", "minimal", "unlikely", "fine", "okay", "not worried"]
TOOLS = ["check_neighbors", "query_knowledge", "check_policy", "assess_risk", "check_calendar", "check_contacts"]
GUIDELINE = ["symptom", "transmission", "prevent", "protect", "isolate", "quarantine", "test", "vaccine", "mask", "distance", "wash", "contact", "spread", "risk", "guideline", "recommendation", "should", "avoid", "reduce", "increase", "maintain"]
BOILERPLATE = ["copyright", "privacy policy", "terms of service", "cookie", "navigation", "menu", "footer", "header"]
CATEGORIES = {
    "symptoms": ["symptom", "sign", "fever", "cough", "shortness of breath"],
    "transmission": ["transmit", "spread", "contagious", "infectious", "airborne", "droplet"],
    "prevention": ["prevent", "protect", "avoid", "reduce risk", "hygiene", "mask", "distance"],
    "testing": ["test", "PCR", "antigen", "swab", "diagnos"],
    "isolation": ["isolate", "isolat", "quarantine", "stay home", "separate"],
    "vaccination": ["vaccin", "immuniz", "shot", "dose"],
    "treatment": ["treat", "therapy", "medication", "hospital"],
    "risk_factors": ["risk factor", "elderly", "age", "comorbid", "vulnerable"],
}
#: Patterns of dates, statistics and named events whose sentences go, in the order of their removal.
LEAKS = [
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\bon \w+ \d+\b",
    r"\bsince \w+ \d{4}\b",
    r"\b\d+[,.]?\d*\s*%",
    r"\b\d+[,.]?\d*\s+(?:cases|deaths|infections|patients)",
    r"\b\d+[,.]?\d*\s+per\s+\w+",
    r"\b(?:increased|decreased|rose|fell)\s+by\s+\d+",
    r"\b\d+[,.]?\d*\s+times\s+(?:higher|lower)",
    r"circuit breaker",
    r"dormitory outbreak",
    r"heightened alert",
    r"phase \d+",
    r"safe management measures",
    r"TraceTogether",
    r"SafeEntry",
]
#: Words of time that are taken out of what is left.
TEMPORAL = r"(?i)\b(?:last|this|next)\s+(?:week|month|year)\b|\bcurrently\b|\bas of\s+\w+\s+\d+|\bto date\b|\brecently\b|\bin recent \w+"
#: What the audit looks for.
AUDIT_YEARS = ["2019", "2020", "2021", "2022", "2023", "2024"]
AUDIT_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
AUDIT_EVENTS = ["circuit breaker", "dormitory outbreak", "tracetogether", "safeentry", "phase 2", "heightened alert"]
#: Scores of the words of confidence.
CONFIDENCE = {"LOW": 0.6, "MODERATE": 0.8, "HIGH": 0.95}


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur."""
    return sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def first_number(text: Column, patterns: list[str], otherwise: Column) -> Column:
    found = [F.expr("cast(null as int)")]
    found += [F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")).try_cast("int") for p in patterns]
    return F.coalesce(*found, otherwise)


def contact_count(text: Column) -> Column:
    low = F.lower(text)
    default = F.when(low.contains("high contact") | low.contains("many contacts"), 10).when(low.contains("few contacts") | low.contains("low contact"), 2).otherwise(5)
    return first_number(text, [r"(\d+)\s+(?:infected\s+)?contacts?", r"(\d+)\s+out\s+of\s+\d+", r"(\d+)\s+people?\s+(?:are|were)\s+infected"], default)


def household_infections(text: Column) -> Column:
    low = F.lower(text)
    said = F.when(low.contains("all") | low.contains("entire"), 4).when(low.contains("some") | low.contains("one"), 1).otherwise(2)
    return first_number(text, [r"(\d+)\s+household\s+members?\s+(?:are|were)?\s*infected", r"household.*?(\d+)\s+infected"], F.when(low.contains("household"), said).otherwise(0))


def days_mention(text: Column) -> Column:
    low = F.lower(text)
    return first_number(text, [r"(\d+)\s+days?", r"day\s+(\d+)"], F.when(low.contains("just") | low.contains("recently"), 1).when(low.contains("week"), 7).otherwise(3))


def risk_perception(text: Column) -> Column:
    low = F.lower(text)
    high, less = hits(low, HIGH_RISK), hits(low, LOW_RISK)
    return F.when(high > less, F.least(0.5 + 0.1 * high, F.lit(1.0))).when(less > high, F.greatest(0.5 - 0.1 * less, F.lit(0.0))).otherwise(0.5)


def behaviour_pattern(text: Column) -> Column:
    """First rule that holds, in this order."""
    low = F.lower(text)
    has = low.contains
    return (
        F.when(has("household") & (has("terrified") | has("extremely")), "anxious_protector")
        .when(text.rlike(r"[×*%/]"), "rational_calculator")
        .when(has("days") & (has("typical") | has("timeline")), "timeline_tracker")
        .when(has("however") | (has("but") & has("young")), "optimistic_minimizer")
        .when(has("age") & text.rlike("[6-8][0-9]"), "elderly_vulnerable")
        .when(has("young") | has("15 years") | has("strong immune"), "youth_confident")
        .when(has("vaccinated") & has("protection"), "vaccine_reliant")
        .when(has("household"), "household_focused")
        .when(has("contacts") | has("out of"), "contact_counter")
        .otherwise("general_risk_assessor")
    )


def reasoning_text(text: Column) -> Column:
    """What follows ``REASONING:`` up to ``ADJUSTMENT:``, or without the former the first 200 characters; null unless longer than 20."""
    marked = F.split_part(F.split_part(text, F.lit("REASONING:"), F.lit(2)), F.lit("ADJUSTMENT:"), F.lit(1))
    said = F.when(text.contains("REASONING:"), F.regexp_replace(marked, r"^\s+|\s+$", "")).otherwise(F.substring(text, 1, 200))
    return F.when(F.length(said) > 20, said)


def parse_adjustment(text: Column) -> Column:
    n = F.regexp_extract(text, r"ADJUSTMENT:[ \t]*([0-9.]+)", 1).try_cast("double")
    return F.when(n.isNotNull(), F.greatest(F.lit(0.6), F.least(F.lit(1.5), n))).otherwise(1.0)


def parse_probability(text: Column, baseline: float) -> Column:
    n = F.regexp_extract(text, r"PROBABILITY:[ \t]*([0-9.]+)", 1).try_cast("double")
    p = F.when(text.rlike(r"PROBABILITY:[ \t]*[0-9.]+%"), n / 100).otherwise(n)
    return F.when(p.isNotNull(), F.greatest(F.lit(0.001), F.least(F.lit(0.80), p))).otherwise(baseline * parse_adjustment(text))


def parse_confidence(text: Column) -> Column:
    """Score of the word after ``CONFIDENCE:``; other words and none count as MODERATE."""
    said = F.regexp_extract(text, r"CONFIDENCE:\s*(\S+)", 1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[said], F.lit(CONFIDENCE["MODERATE"]))


def continuous_features(text: Column, age: Column, compliance: Column, activity: Column) -> Column:
    """Eight entries in [0, 1]: age, compliance, contacts, household infections, days, risk, tools and activity; no text gives the defaults."""
    part = lambda c, n: F.when(text.isNull(), 0.0).otherwise(F.least(c / float(n), F.lit(1.0)))
    f = F.array(
        F.coalesce(age, F.lit(30)) / 100.0, F.coalesce(compliance, F.lit(0.7)), part(contact_count(text), 20), part(household_infections(text), 5), part(days_mention(text), 14),
        F.when(text.isNull(), 0.5).otherwise(risk_perception(text)), part(hits(F.lower(text), TOOLS), 6), F.coalesce(activity, F.lit(0.7)),
    )
    return F.transform(f, lambda x: F.round(x.cast("double"), 6))


def is_guideline(text: Column) -> Column:
    low = F.lower(text)
    return (hits(low, GUIDELINE) >= 3) & (hits(low, BOILERPLATE) == 0)


def categorize(text: Column) -> Column:
    """The category with most keywords; the first on ties; general_guidelines if none."""
    low = F.lower(text)
    scores = F.array(*[hits(low, words) for words in CATEGORIES.values()])
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return F.when(F.array_max(scores) > 0, F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))).otherwise("general_guidelines")


#: What words are made of: letters and numbers of any language, so that the end of "région" is no "on".
WORD = r"[\p{L}\p{N}_]"


def _spelled(pattern: str) -> str:
    """``pattern`` with word characters and bounds spelled out: what the classes of Java hold depends on its version."""
    return re.sub(r"\\b(?=\||$)", lambda _: f"(?!{WORD})", pattern.replace(r"\w", WORD)).replace(r"\b", f"(?<!{WORD})")


def _without(leak: str):
    sentence = f"(?i)(?:^|(?<=[.!?]))[^.!?]*{leak}[^.!?]*[.!?]"
    return lambda x: F.when(x.rlike("(?i)" + leak), F.regexp_replace(x, sentence, "")).otherwise(x)


def remove_leakage(text: Column) -> Column:
    """Drops sentences with dates, statistics or named events, then words of time and spare white space.

    A sentence runs from its start or the last terminator to the next one, and a
    terminator inside a pattern (18.3 %) does not end it. What follows the last
    terminator stays. The search starts at sentence starts only and is skipped where the
    bare pattern does not occur, so it takes time in proportion to the text. Words are
    made of letters of any language.
    """
    clean, leaks = text, [_spelled(x) for x in LEAKS]
    for leak in leaks:
        clean = F.get(F.transform(F.array(clean), _without(leak)), F.lit(0))  # names the text, so that a step mentions it once
    clean = F.when(text.rlike("(?i)" + "|".join(leaks)), clean).otherwise(text)
    clean = F.regexp_replace(clean, _spelled(TEMPORAL), "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\n\s*\n\s*\n+", "\n\n"), "  +", " ")
    return F.regexp_replace(clean, r"^\s+|\s+$", "")


def audit_leakage(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, issue): ``year`` once for each year named, ``date`` once for a month with one of the years, ``event`` for each event."""
    text = F.col(text_col)
    checks = [(f"year {y}", text.contains(y)) for y in AUDIT_YEARS]
    checks += [("date", text.rlike(f"(?:{'|'.join(AUDIT_MONTHS)}) (?:{'|'.join(AUDIT_YEARS)})"))]
    checks += [(f"event {e}", F.lower(text).contains(e)) for e in AUDIT_EVENTS]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    return docs.select(id_col, F.explode(issues).alias("issue"))


def filter_sections(sections: DataFrame, shortest: int = 50) -> DataFrame:
    """(id, category, heading, content) of the sections that are guidelines and keep ``shortest`` characters without leaks.

    ``sections``: page_id, section, heading, content. The id is made of category, page and section.
    """
    kept = sections.where(is_guideline(F.col("content"))).withColumn("_clean", remove_leakage(F.col("content"))).where(F.length("_clean") >= shortest)
    kept = kept.withColumn("category", categorize(F.concat_ws(" ", "heading", "_clean")))
    return kept.select(F.concat_ws("_", "category", F.col("page_id").cast("string"), F.col("section").cast("string")).alias("id"), "category", "heading", F.col("_clean").alias("content"))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` and the rows of ``new`` whose key it lacks, one row a key."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").dropDuplicates([key]))


#: What makes a container a section, and how long a section or a list has to be.
SECTION_CLASS = re.compile("content|section|article|guideline", re.I)
SHORTEST_SECTION, SHORTEST_LIST, FEWEST_ITEMS = 50, 100, 3
HEADINGS = ("h1", "h2", "h3", "h4")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form header hr main menu nav ol p pre section table ul".split()) | frozenset(("h5", "h6", *HEADINGS))
#: Tags whose start ends open ones of these names, and the tags that such a search does not leave.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), **{h: HEADINGS for h in HEADINGS}}
_WITHIN = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


class _Elements(HTMLParser):
    """Elements of a page in the order of their starts, each with the span of its texts and of the elements inside.

    Open elements are a stack. Starts that imply the end of others (a paragraph before a
    block, an item before the next) close them; an end closes what is still open inside.
    """

    def __init__(self, html: str):
        super().__init__()
        self.texts: list[str] = []
        self.elements: list[list] = []  # [tag, class or None, texts before, texts up to its end, elements up to its end]
        self.stack: list[int] = []
        self.data: list[str] = []
        self.feed(html)
        self.close()
        self._text()
        self._pop(0)

    def _text(self) -> None:
        said = "".join(self.data).strip()
        self.data = []
        if said:
            self.texts.append(said)

    def _pop(self, depth: int) -> None:
        for at in self.stack[depth:]:
            self.elements[at][3:] = [len(self.texts), len(self.elements)]
        del self.stack[depth:]

    def _end(self, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Closes the outermost open element of ``tags`` that is reached without leaving ``within``."""
        found = None
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.elements[self.stack[depth]][0]
            if tag in within:
                break
            if tag in tags:
                found = depth
        if found is not None:
            self._pop(found)

    def handle_starttag(self, tag, attrs):
        self._text()
        if tag in _BLOCKS:
            self._end(("p",), ("table", "td", "th", "button"))
        if tag in _ENDS:
            self._end(_ENDS[tag], _WITHIN.get(tag, ("div", "section", "article", "ul", "ol", "table")))
        if tag not in _VOID:
            self.stack.append(len(self.elements))
            self.elements.append([tag, dict(attrs).get("class", "") if any(k == "class" for k, _ in attrs) else None, len(self.texts), 0, 0])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._pop(len(self.stack) - 1)

    def handle_endtag(self, tag):
        self._text()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.elements[self.stack[depth]][0] == tag:
                self._pop(depth)
                break

    def handle_data(self, data):
        if not self.stack or self.elements[self.stack[-1]][0] not in ("script", "style", "template"):
            self.data.append(data)

    def _other(self, *_):
        self._text()

    handle_comment = handle_decl = handle_pi = unknown_decl = _other


def page_sections(html: str) -> list[tuple[str, str | None, str]]:
    """(section, heading, content) of a page: containers, then lists."""
    page = _Elements(html)
    numbered = list(enumerate(page.elements))
    said = lambda e, between: between.join(page.texts[e[2] : e[3]])
    found = [x for x in numbered if x[1][0] in ("section", "article", "div") and SECTION_CLASS.search(x[1][1] or "")]
    if not found:
        found = [x for x in numbered if x[1][0] == "div" and x[1][1] is not None]
    out: list[tuple[str, str | None, str]] = []
    for no, (at, e) in enumerate(found):
        content = said(e, "\n")
        if len(content) >= SHORTEST_SECTION:
            heading = next((said(h, "") for h in page.elements[at + 1 : e[4]] if h[0] in HEADINGS), None)
            out.append((f"section_{no}", heading, content))
    for no, (at, e) in enumerate(x for x in numbered if x[1][0] in ("ul", "ol")):
        items = [said(x, "") for x in page.elements[at + 1 : e[4]] if x[0] == "li"]
        content = "\n".join(f"- {x}" for x in items)
        if len(items) >= FEWEST_ITEMS and len(content) > SHORTEST_LIST:
            out.append((f"list_{no}", "Guidelines", content))
    return out


def extract_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, section, heading, content) of guideline pages.

    Sections are ``section``, ``article`` and ``div`` elements whose class names content, a
    section, an article or a guideline; of a page without any, all ``div`` elements with a
    class. They may lie in one another. The content is the whole text inside, one line for
    each piece between tags, of 50 characters at least; the heading is the first h1 to h4
    inside, else null. Lists of three items, nested ones counted, and over 100 characters
    follow under "Guidelines", one "- " line an item. Text of scripts, styles and templates
    is none; character references are read as HTML does, old names without their semicolon
    too. ``section`` names the kind and counts from 0 in the page, the short ones included.
    Null and empty pages give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(page, *row) for page, html in zip(b["page_id"], b["html"], strict=True) for row in page_sections(html or "")]
            yield pd.DataFrame(out, columns=["page_id", "section", "heading", "content"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInPandas(run, "page_id long, section string, heading string, content string")
