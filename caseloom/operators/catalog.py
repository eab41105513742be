"""Look-ups and listings over a catalog of patterns (name, entity_type, pattern, pattern_type, jurisdiction, confidence, bluebook, examples), and what matches of its groups say."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories of citations, the first whose words a type's name holds; indicators of kinds of patterns and of documents.
CITATION_CATEGORIES = (
    ("Case Citations", ("CASE", "PARALLEL_CITATION", "SHORT_FORM_CITATION")), ("Statutory Citations", ("STATUTE", "USC", "LAW")), ("Regulatory Citations", ("REGULATION", "CFR", "ADMINISTRATIVE")),
    ("Constitutional Citations", ("CONSTITUTION", "AMENDMENT")), ("Court Rules", ("RULE", "^FR")), ("Secondary Sources", ("REVIEW", "JOURNAL", "TREATISE", "HORNBOOK", "ENCYCLOPEDIA", "ALR", "RESTATEMENT", "UNIFORM")),
    ("News and Media", ("NEWS", "MAGAZINE", "PRESS")), ("Electronic Sources", ("WEB", "BLOG", "SOCIAL", "DATABASE", "WESTLAW", "LEXIS")), ("International Sources", ("INTERNATIONAL", "TREATY", "CONVENTION", "FOREIGN")),
    ("Legislative Materials", ("HEARING", "TESTIMONY", "REPORT", "CONGRESSIONAL")), ("Court Documents", ("BRIEF", "RECORD", "PLEADING", "MOTION")),
)
INDICATORS = {
    "judge": ("judge", "justice", "chief justice", "associate justice", "honorable", "j.", "magistrate", "presiding", "circuit judge", "district judge", "appellate judge"),
    "party": ("plaintiff", "defendant", "petitioner", "respondent", "appellant", "appellee", "movant", "claimant", "debtor", "creditor", "intervenor"),
    "statute": ("§", "section", "u.s.c.", "usc", "rcw", "code", "statute", "title", "chapter", "subsection", "paragraph", "clause", "cfr", "c.f.r.", "pursuant to", "under"),
    "procedural": ("motion", "order", "judgment", "decree", "ruling", "opinion", "decision", "verdict", "plea", "complaint", "answer", "brief", "memorandum", "affidavit", "deposition"),
}
DOCUMENT_INDICATORS = ("in the united states", "court of", "opinion of the court", "case no.", "civil action", "criminal case", "appeal from", "argued", "decided", "filed", "before:", "per curiam", "syllabus", "held:", "reversed", "affirmed", "remanded")
CRITICAL = ("chief_justice", "case_citation", "statute_citation", "supreme_court", "federal_court", "constitutional")
PRIORITY_TYPES = ("CHIEF_JUSTICE", "ASSOCIATE_JUSTICE", "JUDGE", "CASE_CITATION", "STATUTE_CITATION", "COURT")
#: Columns of a listing by how much it tells.
FORMATS = {"minimal": ("name", "entity_type"), "summary": ("name", "entity_type", "confidence"), "detailed": ("name", "entity_type", "confidence", "jurisdiction", "pattern_type", "pattern")}


def mapped(catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """catalog with `mapped_type`: the canonical type (alias, canonical), or the type itself. The map is a configuration file; Spark decides how to join it."""
    return catalog.join(aliases, catalog["entity_type"] == aliases["alias"], "left").withColumn("mapped_type", F.coalesce("canonical", "entity_type")).drop("alias", "canonical")


def of_type(catalog: DataFrame, entity_type: str) -> DataFrame:
    """Patterns whose type, as it stands or mapped, is this, once each."""
    return catalog.filter((F.col("entity_type") == entity_type) | (F.col("mapped_type") == entity_type)).dropDuplicates(["name"])


def unified(catalog: DataFrame, relations: DataFrame, kind: str = "all", entity_type: str | None = None, category: str | None = None, least: float = 0.0, shown: str = "summary") -> DataFrame:
    """Entity patterns and relationship patterns (relationship_type, category, confidence) in one listing, filtered, with the columns of a format."""
    e = catalog.filter(F.col("confidence") >= least)
    e = e.filter(F.col("mapped_type") == entity_type) if entity_type else e
    r = relations.filter(F.col("confidence") >= least)
    r = r.filter(F.contains(F.lower("category"), F.lit(category.lower()))) if category else r
    columns = FORMATS[shown]
    e = e.select(F.lit("entity").alias("kind"), *[F.col(c).cast("string").alias(c) for c in columns])
    r = r.select(F.lit("relationship").alias("kind"), *[F.col({"name": "relationship_type", "entity_type": "category"}.get(c, c)).cast("string").alias(c) if c in ("name", "entity_type", "confidence") else F.lit(None).cast("string").alias(c) for c in columns])
    return e if kind == "entities" else r if kind == "relationships" else e.unionByName(r)


def comprehensive(catalog: DataFrame, types: DataFrame, least: float = 0.0, category: str | None = None, has_patterns: bool | None = None, has_examples: bool | None = None, bluebook: bool | None = None) -> DataFrame:
    """Each type (entity_type, category) with counts of patterns and examples and the mean confidence, as filtered."""
    own = catalog.filter(F.col("confidence") >= least)
    own = own.filter(F.col("bluebook") == bluebook) if bluebook is not None else own
    told = own.groupBy("mapped_type").agg(F.count("*").alias("patterns"), F.sum(F.size("examples")).alias("examples"), F.round(F.avg("confidence"), 3).alias("mean"))
    rows = types.join(told, types["entity_type"] == told["mapped_type"], "left").select("entity_type", "category", F.coalesce("patterns", F.lit(0)).alias("patterns"), F.coalesce("examples", F.lit(0)).alias("examples"), "mean")
    if category:
        rows = rows.filter(F.contains(F.lower("category"), F.lit(category.lower())))
    if has_patterns is not None:
        rows = rows.filter((F.col("patterns") > 0) == has_patterns)
    if has_examples is not None:
        rows = rows.filter((F.col("examples") > 0) == has_examples)
    return rows


def citation_types(catalog: DataFrame) -> DataFrame:
    """Distinct types of citations: types that say so, else types made of the first part of names that do."""
    first = F.upper(F.split("name", r"\.")[0])
    made = F.when(F.contains(first, F.lit("CITATION")), first).otherwise(F.concat(first, F.lit("_CITATION")))
    told = F.when(F.contains("entity_type", F.lit("CITATION")), F.col("entity_type")).when(F.rlike(F.lower("name"), F.lit("citation|cite|reference")), made)
    return catalog.select(told.alias("citation_type")).filter("citation_type is not null").distinct()


def citation_category(citation_type: Column) -> Column:
    out = None
    for name, words in CITATION_CATEGORIES:
        test = F.rlike(citation_type, F.lit("|".join(words)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("Other Citations")


def group_name(pattern_type: Column, path: Column) -> Column:
    """The type of a file's patterns, or the file's name without its ending."""
    return F.when((pattern_type != "") & (pattern_type != "unknown"), pattern_type).otherwise(F.regexp_replace(F.regexp_extract(path, r"[^/]+$", 0), r"\.[^.]*$", ""))


def relevance(name: Column, entity_type: Column, confidence: Column, text: Column) -> Column:
    """How likely a pattern is to match a text, by words in its first 1000 characters and by its own name, type and confidence; 1 at most."""
    low = F.lower(F.substring(text, 1, 1000))
    count = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    own = F.greatest(*[F.when(F.contains(F.lower(name), F.lit(k)), F.least(F.lit(0.4), 0.15 * count(words))).otherwise(0.0) for k, words in INDICATORS.items()])
    kind = F.when(count(DOCUMENT_INDICATORS) >= 3, 0.25).when(count(DOCUMENT_INDICATORS) >= 1, 0.15).otherwise(0.0)
    band = F.when(confidence >= 0.95, 0.25).when(confidence >= 0.9, 0.2).when(confidence >= 0.85, 0.15).when(confidence >= 0.8, 0.1).when(confidence >= 0.75, 0.05).otherwise(0.0)
    critical = F.when(F.rlike(F.lower(name), F.lit("|".join(CRITICAL))), 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), own + kind + band + critical + F.when(F.upper(entity_type).isin(*PRIORITY_TYPES), 0.1).otherwise(0.0))


# --- matches with groups ---


@dataclass(frozen=True)
class Grouped:
    """A pattern whose groups have names, with ranges that its numbers should be in."""

    name: str
    pattern: str
    groups: tuple[str, ...]
    entity_type: str
    years: tuple[int, int] | None = None
    volumes: tuple[tuple[str, int, int], ...] = ()
    pages: tuple[int, int] | None = None


GROUPED = (
    Grouped("case_citation", r"([A-Z][a-z]+ v\. [A-Z][a-z]+), (\d+) (U\.S\.|F\.3d) (\d+)(?: \((\d{4})\))?", ("case_name", "volume", "reporter", "page", "year"), "CASE_CITATION", (1600, 2030), (("u.s.", 1, 600), ("f.3d", 1, 999)), (1, 999)),
    Grouped("statute_citation", r"(\d+) (U\.S\.C\.|C\.F\.R\.) § (\d+)", ("title", "code", "section"), "STATUTE_CITATION"),
    Grouped("justice_name", r"(Judge|Justice) ([A-Z][a-z]+ [A-Z][a-z]+)(?: of the ([A-Z][a-z]+ Court))?", ("justice_title", "name", "court_name"), "JUDGE"),
)
#: Groups that are parts of a citation, under the names that citations give them.
COMPONENTS = {"case_name": "case_name", "volume": "volume", "reporter": "reporter", "page": "page", "pinpoint": "pincite", "court": "court", "year": "year", "title": "title", "code": "code", "section": "section", "subsection": "subsection", "author": "author", "article_title": "article_title", "journal": "journal", "url": "url"}


def grouped_matches(docs: DataFrame, patterns: tuple[Grouped, ...] = GROUPED, by: str = "doc_id") -> DataFrame:
    """(by, name, entity_type, start, stop, text, groups) of all matches; groups: a map of the names of groups that hold something."""
    from ..functions.spans import spans

    text = F.col("text")

    def one(p: Grouped) -> Column:
        parts = F.arrays_zip(spans(text, p.pattern).alias("s"), *[F.regexp_extract_all(text, F.lit(p.pattern), F.lit(k + 1)).alias(g) for k, g in enumerate(p.groups)])

        def row(x: Column) -> Column:
            filled = F.map_filter(F.create_map(*[y for g in p.groups for y in (F.lit(g), x[g])]), lambda k, v: v.isNotNull() & (v != ""))
            return F.struct(F.lit(p.name).alias("name"), F.lit(p.entity_type).alias("entity_type"), F.lit(len(p.groups)).alias("all"), x["s"]["start"].alias("start"), x["s"]["stop"].alias("stop"), x["s"]["text"].alias("text"), filled.alias("groups"))

        return F.transform(parts, row)

    return docs.select(by, F.explode(F.concat(*map(one, patterns))).alias("m")).select(by, "m.*")


def rule_score(patterns: tuple[Grouped, ...] = GROUPED) -> Column:
    """1, times .5 for a year, .7 for a volume of its reporter and .8 for a page out of the pattern's range, or too large to read."""
    out, g = None, lambda k: F.col("groups")[k]
    within = lambda k, low, high: F.coalesce(g(k).try_cast("long").between(low, high), F.lit(False))
    for p in patterns:
        score = F.lit(1.0)
        if p.years:
            score = score * F.when(g("year").isNotNull() & ~within("year", *p.years), 0.5).otherwise(1.0)
        wrong = F.lit(None)
        for reporter, low, high in p.volumes:
            here = F.contains(F.lower(g("reporter")), F.lit(reporter))
            wrong = F.when(here, ~within("volume", low, high)) if reporter == p.volumes[0][0] else wrong.when(here, ~within("volume", low, high))
        if p.volumes:
            score = score * F.when(F.coalesce(wrong.otherwise(F.lit(False)), F.lit(False)), 0.7).otherwise(1.0)
        if p.pages:
            score = score * F.when(g("page").isNotNull() & ~within("page", *p.pages), 0.8).otherwise(1.0)
        out = F.when(F.col("name") == p.name, score) if out is None else out.when(F.col("name") == p.name, score)
    return out.otherwise(1.0)


def citation_components(groups: Column) -> Column:
    """The parts of a citation as a struct, and all other groups as a map."""
    rest = F.map_filter(groups, lambda k, v: ~k.isin(*COMPONENTS))
    return F.struct(*[groups[g].alias(c) for g, c in COMPONENTS.items()], rest.alias("additional"))


def entity_attributes(name: Column, groups: Column) -> Column:
    """What the groups say of an entity: judge's title, attorney's or party's name, court, jurisdiction, and all groups."""
    low, named = F.lower(name), groups["name"].isNotNull()
    return F.struct(
        F.when(named & F.contains(low, F.lit("justice")), F.coalesce(groups["justice_title"], F.lit("Justice"))).alias("judge_title"),
        F.when(named & ~F.contains(low, F.lit("justice")) & F.contains(low, F.lit("attorney")), groups["name"]).alias("attorney_name"),
        F.when(named & ~F.rlike(low, F.lit("justice|attorney")) & F.contains(low, F.lit("party")), groups["name"]).alias("party_name"),
        groups["court_name"].alias("court_name"), groups["jurisdiction"].alias("jurisdiction"), groups.alias("additional"),
    )


def bluebook(name: Column, groups: Column, flag: Column) -> Column:
    """Whether a citation is in standard form: as its pattern's flag says, else for cases whether volume, reporter and page are there."""
    told = F.lower(flag).isin("true", "yes", "22nd_edition")
    return F.when(flag.isNotNull(), told).when(F.contains(F.lower(name), F.lit("case")), groups["volume"].isNotNull() & groups["reporter"].isNotNull() & groups["page"].isNotNull()).otherwise(F.lit(True))
