"""Confidence and quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CANDIDATE_BASE = {"case_name": 0.9, "title_person": 0.8, "court": 0.8, "citation": 0.8, "statute": 0.8, "organization": 0.7, "legal_document": 0.6, "quoted": 0.5, "capitalized": 0.5, "parenthetical": 0.4}
LEGAL_WORDS = ("court", "judge", "plaintiff", "defendant", "law", "statute", "contract", "motion", "case", "license")
VOTES = {"pattern": 0.3, "semantic": 0.35, "dependency": 0.2, "section": 0.15}


def strategy_confidence(strategy: Column, base: Column, pass_: Column, context: Column, linguistic: Column) -> Column:
    """A mention's confidence by the strategy that found it: rising with the pass, mixed with context, or floored by source."""
    return (
        F.when((strategy == "multipass") & (pass_ > 0), F.least(0.3 + 0.1 * pass_, F.lit(0.95)))
        .when(strategy == "multipass", F.greatest(base, F.lit(0.65)))
        .when(strategy == "ai_enhanced", 0.3 * context + 0.3 * linguistic + 0.4 * base)
        .when(strategy == "unified", F.greatest(base, F.lit(0.65)))
        .otherwise(F.greatest(base, F.lit(0.8)))
    )


def default_confidence(confidence: Column, source: Column) -> Column:
    """The confidence, or what a source has by default where it is 0."""
    by = F.when(source == "regex", 0.8).when(source == "model", 0.9).when(source == "validated", 0.85).otherwise(0.7)
    return F.when(confidence == 0.0, by).otherwise(confidence)


def candidate_confidence(kind: Column, text: Column) -> Column:
    """By the kind of candidate, less for one word or more than four, for no capital, and for very common words; 1 at most."""
    base = None
    for k, v in CANDIDATE_BASE.items():
        base = F.when(kind == k, v) if base is None else base.when(kind == k, v)
    n = F.size(F.split(F.trim(text), r"\s+"))
    out = base.otherwise(0.5) * F.when(n == 1, 0.9).when(n > 4, 0.85).otherwise(1.0) * F.when(F.rlike(text, F.lit("[A-Z]")), 1.0).otherwise(0.8) * F.when(F.lower(F.trim(text)).isin("the", "this", "that", "and", "court", "section"), 0.5).otherwise(1.0)
    return F.least(F.lit(1.0), out)


def quoted_confidence(inner: Column) -> Column:
    """.4, more for title case and legal words, less for long quotes."""
    legal = F.lit(False)
    for w in LEGAL_WORDS:
        legal = legal | F.contains(F.lower(inner), F.lit(w))
    return F.lit(0.4) + F.when(F.rlike(inner, F.lit(r"^[A-Z][a-z]+(?: [A-Z][a-z]+)*$")), 0.2).otherwise(0.0) + F.when(legal, 0.3).otherwise(0.0) - F.when(F.length(inner) > 30, 0.1).otherwise(0.0)


def context_confidence(keywords: Column) -> Column:
    return 0.5 + F.least(F.lit(0.3), 0.1 * keywords) + 0.1


def by_place(confidence: Column, start: Column, stop: Column, text: Column) -> Column:
    """A little less in the first and last tenth of a text, a little more before punctuation; 1 at most."""
    n = F.length(text)
    edge = (start < n * 0.1) | (stop > n * 0.9)
    return F.least(F.lit(1.0), confidence * F.when(edge, 0.95).otherwise(1.0) * F.when(F.rlike(F.substring(text, stop + 1, F.lit(1)), F.lit(r"[.,;:!?]")), 1.05).otherwise(1.0))


def legal_density(text: Column) -> Column:
    """Legal words over a tenth of the words, five at most; .5 for a text too short to tell."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.isin(*LEGAL_WORDS)))
    room = F.least(F.lit(5), F.floor(F.size(words) / 10))
    return F.when(room == 0, 0.5).otherwise(F.least(F.lit(1.0), hits / room))


def completeness(content: Column) -> Column:
    """1 less .3 without a capital at the start, .2 without end punctuation, .2 under 50 characters."""
    t = F.trim(content)
    return 1.0 - F.when(F.rlike(t, F.lit("^[A-Z]")), 0.0).otherwise(0.3) - F.when(F.rlike(t, F.lit(r"[.!?]\z")), 0.0).otherwise(0.2) - F.when(F.length(t) < 50, 0.2).otherwise(0.0)


def density_score(entity_chars: Column, chars: Column) -> Column:
    d = F.when(chars == 0, 0.0).otherwise(entity_chars / chars)
    return F.when(d == 0, 0.3).when(d < 0.05, 0.6).when(d <= 0.3, 1.0).when(d <= 0.5, 0.7).otherwise(0.4)


def chunk_score(complete: Column, coherent: Column, dense: Column, bounded: Column, sized: Column) -> Column:
    return 0.25 * complete + 0.25 * coherent + 0.2 * dense + 0.2 * bounded + 0.1 * sized


def boundary_score(distance: Column, target: int, strength: Column, size: Column) -> Column:
    """How good a cut is: near the ideal place (.4), strong (.4), and of a good size (.2)."""
    return 0.4 * F.greatest(F.lit(0.0), 1 - distance / target) + 0.4 * strength + 0.2 * F.greatest(F.lit(0.0), 1 - F.abs(size - target) / target)


def voted(signals: dict[str, Column]) -> Column:
    """Weighted mean of the signals that are there."""
    total = sum((F.when(c.isNotNull(), F.lit(VOTES[k]) * c).otherwise(0.0) for k, c in signals.items()), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(VOTES[k])).otherwise(0.0) for k, c in signals.items()), F.lit(0.0))
    return F.when(weight == 0, 0.0).otherwise(total / weight)
