"""Candidates for types without patterns, search keywords of chunks, and how good they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import candidate_confidence
from .spans import pairs, placed

# Shapes of candidates; those quoted or in parentheses count without their marks.
SHAPES = {
    "title_person": r"\b(?:Judge|Justice|Attorney|Lawyer|Dr|Mr|Ms|Mrs|Prof|President|CEO|Director|Chairman|Chief)\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*(?:\s*,?\s*(?:Esq|Jr|Sr|PhD|MD))?",
    "organization": r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z&][a-zA-Z&]*)*\s+(?:Inc|Corp|Corporation|LLC|LLP|Ltd|Limited|Company|Co|Group|Associates|Partners|Law|Firm)\b",
    "case_name": r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:v\.|vs\.|versus)\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*",
    "court": r"\b(?:Supreme|District|Superior|Circuit|Appellate|Municipal|County|Federal|State)\s+Court(?:\s+of\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)?",
    "legal_document": r"\b(?:Motion|Order|Judgment|Decree|Opinion|Brief|Pleading|Complaint|Answer|Petition)\b(?:\s+(?:for|to|of|in)\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)?",
    "quoted": r'"[^"]{3,50}"',
    "parenthetical": r"\([^)]{3,50}\)",
    "capitalized": r"\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*){1,4}\b",
    "citation": r"\b\d+\s+[A-Z][a-zA-Z.]*\s+\d+",
    "statute": r"\b(?:\d+\s+)?[A-Z][a-zA-Z.]*\s*(?:Code|CFR|USC)\s*(?:§|[Ss]ection)?\s*\d+",
}
MARKED = ("quoted", "parenthetical")
PERSON = r"\b(?:[A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?(?:\s+[A-Z][a-z]+)+)\b"
COURT = r"(?i)\b(?:Supreme Court|Court of Appeals|Circuit Court|District Court|Superior Court|Tax Court|Bankruptcy Court|Family Court|Probate Court)\b"
STANDARD = r"(?i)\b(?:reasonable\s+(?:doubt|person|care)|preponderance\s+of\s+(?:the\s+)?evidence|clear\s+and\s+convincing|strict\s+scrutiny|rational\s+basis|intermediate\s+scrutiny|arbitrary\s+and\s+capricious|de\s+novo|abuse\s+of\s+discretion)\b"
TERM = r"(?i)\b(?:plaintiff|defendant|appellant|appellee|petitioner|respondent|jurisdiction|venue|standing|mootness|ripeness|precedent|stare\s+decisis|holding|dicta|remand|affirm|reverse|vacate|motion|brief|complaint|answer)\b"
STATUTE = r"(?i)\b(?:\d+\s+U\.S\.C\.?|[A-Z]{2,}\s+(?:Rev\.\s*)?(?:Stat\.|Code)|(?:§|Section)\s*\d+[\d.-]*)\b"
SUFFIX = r"\b(?:Inc|LLC|Corp|Co|Ltd)\.?\b"


def shaped(text: Column) -> Column:
    """Candidates of all shapes: array of (kind, start, stop, text, confidence)."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(int(k in MARKED)).alias("mark"), pairs(text, p).alias("pairs")) for k, p in SHAPES.items()])

    def rows(k: Column) -> Column:
        def row(m: Column) -> Column:
            inner = F.substring(m["text"], k["mark"] + 1, F.length(m["text"]) - 2 * k["mark"])
            return F.struct(k["kind"].alias("kind"), (m["start"] + k["mark"]).alias("start"), (m["stop"] - k["mark"]).alias("stop"), inner.alias("text"), candidate_confidence(k["kind"], inner).alias("confidence"))

        return F.transform(placed(k["pairs"]), row)

    return F.flatten(F.transform(F.filter(kinds, lambda k: k["pairs"].isNotNull()), rows))


def valid(text: Column) -> Column:
    """Two characters or more, few odd ones, six words at most, and a capital or digit somewhere."""
    odd = F.length(F.regexp_replace(text, r"[A-Za-z0-9\s]", ""))
    return (F.length(F.trim(text)) >= 2) & (odd <= 0.3 * F.length(text)) & (F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) <= 6) & F.rlike(text, F.lit("[A-Z0-9]"))


def keyword_proximity(sentence: Column, phrase: Column, keywords: tuple[str, ...]) -> Column:
    """1 less the distance from a phrase to the nearest keyword over the sentence's length; 0 without either."""
    low = F.lower(sentence)
    at = F.instr(low, F.lower(phrase))
    gaps = F.filter(F.array(*[F.when(F.instr(low, F.lit(k)) > 0, F.abs(at - F.instr(low, F.lit(k)))) for k in keywords]), lambda x: x.isNotNull())
    return F.when((at == 0) | (F.size(gaps) == 0), 0.0).otherwise(1 - F.array_min(gaps) / F.length(sentence))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def entities(text: Column, most: int = 20) -> Column:
    """Distinct persons, organisations and courts, in order of text, so many at most."""
    return F.slice(F.array_sort(F.array_distinct(F.concat(_all(text, PERSON), _all(text, SHAPES["organization"]), _all(text, COURT)))), 1, most)


def contextual_keywords(text: Column) -> Column:
    """The first ten terms, five courts and five statutes (without marks), in lower case, sorted, 20 at most."""
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    statutes = F.transform(F.slice(_all(text, STATUTE), 1, 5), lambda x: F.lower(F.regexp_replace(x, r"[^\w\s]", "")))
    return F.slice(F.array_sort(F.array_distinct(F.concat(low(F.slice(_all(text, TERM), 1, 10)), low(F.slice(_all(text, COURT), 1, 5)), statutes))), 1, 20)


def search_keywords(text: Column) -> Column:
    """Ten entities without company suffixes, five standards and the contextual keywords: sorted, 30 at most."""
    names = F.transform(F.slice(entities(text), 1, 10), lambda x: F.lower(F.trim(F.regexp_replace(x, SUFFIX, ""))))
    standards = F.transform(F.slice(_all(text, STANDARD), 1, 5), lambda x: F.lower(x))
    return F.slice(F.array_sort(F.array_distinct(F.concat(names, standards, contextual_keywords(text)))), 1, 30)


def enhancement_quality(original: Column, contextual: Column, n_entities: Column) -> Column:
    """How much a layer adds: .3 for half as much again, .3 or .2 for entities, .2 for headers, .2 for a document's name and type."""
    score = F.when(F.length(contextual) > F.length(original) * 1.5, 0.3).otherwise(0.0) + F.when(n_entities > 5, 0.3).when(n_entities > 2, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(F.contains(contextual, F.lit("#")), 0.2).otherwise(0.0) + F.when(F.contains(contextual, F.lit("Document:")) & F.contains(contextual, F.lit("Type:")), 0.2).otherwise(0.0))


def phrase_score(phrase: Column, context: Column, kind: Column, keywords: Column, examples: Column) -> Column:
    """How well a phrase fits a type: .3 for keywords near by, .3 for the most alike example, .2 each for a proper name and a title, .3 for a court or company."""
    from .text import jaccard

    proper, title = F.rlike(phrase, F.lit(r"^[A-Z]")), F.rlike(phrase, F.lit(r"^(?:Judge|Justice|Mr|Ms|Mrs|Dr)\b"))
    near = F.when(F.size(keywords) > 0, 0.3 * F.size(F.filter(keywords, lambda k: F.contains(F.lower(context), k))) / F.size(keywords)).otherwise(0.0)
    like = F.coalesce(F.array_max(F.transform(examples, lambda e: jaccard(phrase, e))), F.lit(0.0)) * 0.3
    low = F.lower(kind)
    person = F.rlike(low, F.lit("person|judge|attorney"))
    score = near + like + F.when(proper, 0.2).otherwise(0.0) + F.when(title, 0.2).otherwise(0.0) + F.when(person & proper & title, 0.2).otherwise(0.0)
    score = score + F.when(F.contains(low, F.lit("court")) & F.contains(F.lower(phrase), F.lit("court")), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(F.rlike(low, F.lit("corporation|llc")) & F.rlike(F.lower(phrase), F.lit("inc|corp|llc|ltd")), 0.3).otherwise(0.0))
