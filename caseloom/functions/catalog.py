"""The pattern catalog as rows: a generic one is built in, others come from sources.patterns."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, pattern string, confidence double, entity_type string, source string, jurisdiction string, court_level string, pattern_type string, examples array<string>, dependencies array<string>, description string, rank int"


@dataclass(frozen=True)
class Pattern:
    name: str
    pattern: str
    confidence: float
    entity_type: str
    source: str = "regex"
    jurisdiction: str = "all"
    court_level: str = ""
    pattern_type: str = "unknown"
    examples: tuple[str, ...] = field(default_factory=tuple)
    dependencies: tuple[str, ...] = field(default_factory=tuple)
    description: str = ""


# A generic catalog for texts of any kind.
GENERIC = (
    Pattern("party_name", r"[A-Z][a-z]{2,} [A-Z][a-z]{2,}", 0.80, "PARTY", examples=("John Smith", "Acme Works"), description="two capitalised words"),
    Pattern("capital_word", r"[A-Z][a-z]{4,}", 0.72, "PARTY", "model", examples=("Smith",), description="a capitalised word"),
    Pattern("email_address", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]", 0.95, "CONTACT", pattern_type="contact", examples=("a.b@example.com",)),
    Pattern("email_host", r"@[A-Za-z0-9.]+[A-Za-z0-9]", 0.75, "CONTACT", "model", pattern_type="contact", examples=("@example.com",)),
    Pattern("case_citations_number", r"[0-9]{3,}", 0.70, "CASE_CITATION", jurisdiction="federal", pattern_type="citation", examples=("12345",), dependencies=("party_name",), description="a number of three digits or more"),
    Pattern("statute_citations_license", r"Licen[sc]ed?[A-Za-z ,]{0,24}", 0.85, "STATUTE_CITATION", jurisdiction="federal", court_level="supreme", pattern_type="citation", examples=("Licensed under the", "License"), dependencies=("missing_one",)),
    Pattern("license_version", r"Version [0-9]+\.[0-9]+", 0.88, "STATUTE_CITATION", "model", jurisdiction="state", pattern_type="citation", examples=("Version 2.0",)),
    Pattern("courts_token", r"(?:token|secret|password|api_key)", 0.78, "COURT", jurisdiction="state", court_level="district", pattern_type="court", examples=("token",)),
    Pattern("judge_shout", r"[A-Z]{3,}", 0.74, "JUDGE", pattern_type="judge", examples=("COURT",)),
    Pattern("long_word", r"[a-z]{16,}", 0.60, "PERSON", "model", examples=("thingtionerherethan",)),
)
PRIORITIES = (("case_citations", 95), ("constitutional", 92), ("statute_citations", 90), ("justices", 88), ("courts", 85), ("parties", 85), ("attorneys", 82), ("procedural", 80), ("short_forms", 75), ("dates", 70), ("monetary_amounts", 65))
TYPE_BOOSTS = {"CHIEF_JUSTICE": 1.05, "ASSOCIATE_JUSTICE": 1.03, "JUDGE": 1.02, "DISTRICT_JUDGE": 1.02, "CIRCUIT_JUDGE": 1.02, "COURT": 1.01, "CASE_CITATION": 1.04, "STATUTE_CITATION": 1.03, "CONSTITUTIONAL_CITATION": 1.04}
NAME_BOOSTS = ("chief_justice", "case_citation", "statute_citation", "supreme_court", "federal_court", "district_court")


def frame(spark: SparkSession, patterns=GENERIC) -> DataFrame:
    return spark.createDataFrame([{**asdict(p), "examples": list(p.examples), "dependencies": list(p.dependencies), "rank": n} for n, p in enumerate(patterns)], SCHEMA)


def applicable(catalog: DataFrame, jurisdiction: str | None = None, court_level: str | None = None, confidence: float = 0.7) -> DataFrame:
    """Patterns of a jurisdiction or of all, of a court level or of none, that are sure enough, the surest first."""
    out = catalog.filter(F.col("confidence") >= confidence)
    if jurisdiction:
        out = out.filter(F.col("jurisdiction").isin(jurisdiction, "all"))
    if court_level:
        out = out.filter(F.col("court_level").isin(court_level, ""))
    return out.withColumn("priority", priority(F.col("name"))).orderBy(F.desc("priority"), F.desc("confidence"), "rank")


def priority(name: Column) -> Column:
    out = F.lit(None)
    for part, value in PRIORITIES:
        out = F.when(F.contains(F.lower(name), F.lit(part)), value) if part == PRIORITIES[0][0] else out.when(F.contains(F.lower(name), F.lit(part)), value)
    return out.otherwise(50)


def name_class(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(F.contains(low, F.lit("citation")), "citation")
        .when(F.contains(low, F.lit("justice")) | F.contains(low, F.lit("judge")), "judge")
        .when(F.contains(low, F.lit("court")), "court")
        .when(F.contains(low, F.lit("procedural")), "procedural")
        .when(F.contains(low, F.lit("constitutional")), "constitutional")
        .otherwise("general")
    )


def length_factor(n: Column) -> Column:
    return F.when(n < 3, 0.85).when(n < 10, 0.95).when(n < 25, 1.0).otherwise(1.02)


def match_confidence(confidence: Column, name: Column, entity_type: Column, text: Column, filled: Column | None = None, year: Column | None = None) -> Column:
    """A pattern's confidence times factors for filled groups, length, type and name, and for unlikely years; from .5 to 1."""
    out = confidence * length_factor(F.length(text))
    if filled is not None:
        out = out * (0.9 + 0.1 * filled)
    boost = F.lit(None)
    for k, v in TYPE_BOOSTS.items():
        boost = F.when(F.upper(entity_type) == k, v) if k == "CHIEF_JUSTICE" else boost.when(F.upper(entity_type) == k, v)
    named = F.lit(False)
    for part in NAME_BOOSTS:
        named = named | F.contains(F.lower(name), F.lit(part))
    out = out * boost.otherwise(1.0) * F.when(named, 1.02).otherwise(1.0)
    if year is not None:
        out = out * F.when(year.isNull(), 1.0).when(year.cast("int").isNull(), 0.9).when(year.cast("int").between(1600, 2030), 1.0).otherwise(0.7)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.5), out))
