"""Layers of a chunk for search, section and boundary kinds, and choices by mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import standard_citations

# Fixed values.
SYNONYMS = {"plaintiff": ("claimant", "petitioner"), "defendant": ("respondent", "accused"), "contract": ("agreement", "covenant"), "court": ("tribunal",), "license": ("permit", "grant"), "judge": ("justice", "magistrate")}
LABELS = {"PERSON": "PERSON", "ORG": "CORPORATION", "GPE": "LOCATION", "LAW": "STATUTE_CITATION", "DATE": "DATE", "MONEY": "AMOUNT"}
DESCRIPTIONS = {"single_pass": "one prompt over the whole text", "three_wave": "three waves over the whole text", "three_wave_chunked": "three waves over chunks", "four_wave": "three waves and relationships", "eight_wave_fallback": "eight passes, the most thorough"}
PASSES = ((1, "regex"), (2, "regex"), (3, "ai_enhanced"), (4, "ai_enhanced"), (5, "ai_enhanced"), (6, "hybrid"), (7, "hybrid"))
GENERATORS = {"fast": ("pattern", "capitalized"), "adaptive": ("pattern", "capitalized", "quoted", "context"), "comprehensive": ("pattern", "capitalized", "quoted", "noun", "context")}


def cleaned(text: Column) -> Column:
    """Citations in standard form, white space collapsed, odd symbols dropped, repeated punctuation single."""
    t = F.regexp_replace(standard_citations(text), r"\s+", " ")
    t = F.regexp_replace(t, r"[^0-9A-Za-z\x{80}-\x{10FFFF} .,;:!?()'\"$%/@&-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"([.,;:!?])[.,;:!?]+", "$1"), " +", " "))


def synonyms(text: Column) -> Column:
    """Sorted synonyms of the terms that a text holds."""
    low = F.lower(text)
    each = [F.when(F.contains(low, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in SYNONYMS.items()]
    return F.array_sort(F.array_distinct(F.concat(*each)))


def search_layer(text: Column, source: Column) -> Column:
    """What is indexed for word search: source, synonyms and the text in lower case."""
    return F.concat_ws(" ", source, F.array_join(synonyms(text), " "), F.lower(text))


def section(text: Column) -> Column:
    """The first line that looks like a header; empty if none does."""
    return F.trim(F.regexp_extract(text, r"(?m)^((?:[IVX]+\.|[A-Z]\.|\d+\.)\s+[^\n]{1,80}|[A-Z][A-Z ]{3,60})$", 1))


def boundary_kind(before: Column, after: Column) -> Column:
    """What a cut between two texts is: document_end, paragraph, sentence, section or word."""
    return (
        F.when(F.length(after) == 0, "document_end").when(F.endswith(before, F.lit("\n\n")) | F.startswith(after, F.lit("\n\n")), "paragraph")
        .when(F.rlike(before, F.lit(r"[.!?]\s*\z")), "sentence").when(F.rlike(after, F.lit(r"\A\s*(?:[IVX]+\.|\d+\.)\s")), "section").otherwise("word")
    )


def citation_key(text: Column) -> Column:
    """A citation's form for comparison: no white space around punctuation, a sign for sections, lower case."""
    t = F.regexp_replace(text, r"\s*([.,§])\s*", "$1")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, "(?i)section", "§"), r"\s+", " ")))


def recommendations(one: dict[str, Column]) -> Column:
    """What to tune, by thresholds on a report's columns: ms, errors, tokens_per_second."""
    return F.array_compact(F.array(
        F.when(one["ms"] > 2000, "lower the batch size").when(one["ms"] > 500, "raise the concurrency"), F.when(one["errors"] > 5, "look at the failures"),
        F.when(one["tokens_per_second"] < 1, "keep the model busier"),
    ))
