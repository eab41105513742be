"""Windows of context around mentions: tokens, paragraphs, sections, the document, pairs; and what they say of a mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let, placed, pairs, running
from .smart import after_space, before_space, stripped

# Headers of sections, words that a sentence may end with and go on, and references to parties.
SECTION_HEADERS = (r"^[IVX]+\.\s+[A-Z][A-Z\s]+$", r"^\d+\.\s+[A-Z][A-Z\s]+$", r"^[A-Z][A-Z\s]+:$", r"^ARTICLE\s+\d+", r"^SECTION\s+\d+", r"^EXHIBIT\s+[A-Z]")
OPEN_ENDS = (
    "v.", "vs.", "cf.", "e.g.", "i.e.", "viz.", "al.", "et.", "Inc.", "Corp.", "Co.", "Ltd.", "LLC", "L.L.C.", "P.C.", "Esq.", "Jr.", "Sr.", "Ph.D.", "M.D.", "J.D.",
    "No.", "Nos.", "Art.", "Sec.", "Para.", "Subpara.", "U.S.C.", "F.3d", "F.2d", "F.Supp.", "Cal.App.", "N.Y.",
    "Jan.", "Feb.", "Mar.", "Apr.", "Jun.", "Jul.", "Aug.", "Sep.", "Sept.", "Oct.", "Nov.", "Dec.",
)
PARTY_REFERENCES = {
    "plaintiff": ("the plaintiff", "plaintiffs", "petitioner", "complainant"),
    "defendant": ("the defendant", "defendants", "respondent", "accused"),
    "party": ("the party", "the parties", "such party", "said party"),
}
SECTION_TITLES = (
    ("parties", "party_section"), ("case information", "case_header"), ("facts", "evidence"), ("procedural history", "procedural"), ("claims", "legal_concepts"), ("relief", "legal_concepts"),
    ("contract", "contractual"), ("agreement", "contractual"), ("criminal charges", "criminal"), ("sentence", "criminal"), ("damages", "monetary"), ("citations", "legal_citations"), ("authorities", "legal_citations"),
)
#: Words of a text: runs of letters, digits and what isn't ASCII, or single marks.
TOKEN = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[!-/:-@\[-^`{-~]"
HEADER = "|".join(SECTION_HEADERS)


def paragraphs(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, i, start, stop) of paragraphs that aren't blank, without white space at their ends; a text without breaks is one."""
    p = r"\n\s*\n"
    breaks = placed(F.coalesce(pairs(F.col("text"), p), F.array(F.struct(F.lit(None).cast("string").alias("m"), F.lit(0).alias("gap"), F.lit(0).alias("n")))))
    begins = F.zip_with(F.split("text", p, -1), F.concat(F.array(F.lit(0)), F.transform(breaks, lambda b: b["stop"])), lambda t, at: F.struct((at + F.length(F.regexp_extract(t, r"^\s*", 0))).alias("start"), F.length(stripped(t)).alias("n")))
    rows = docs.select(by, F.posexplode(F.filter(begins, lambda x: x["n"] > 0)).alias("i", "x"))
    return rows.select(by, "i", F.col("x.start").alias("start"), (F.col("x.start") + F.col("x.n")).alias("stop"))


def sections(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, i, title, start, stop) of sections with text: from the line after a header to the next; before the first, Introduction."""
    lines = F.split("text", "\n", -1)
    rows = docs.select(by, F.posexplode(let(lines, lambda s: F.arrays_zip(s.alias("line"), running(F.transform(s, lambda x: F.length(x) + 1)).alias("at")))).alias("k", "x")).select(by, "k", F.col("x.line").alias("line"), F.col("x.at").alias("at"))
    header = F.rlike(stripped(F.col("line")), F.lit(HEADER))
    rows = rows.withColumn("header", header).withColumn("s", F.count_if("header").over(Window.partitionBy(by).orderBy("k")))
    told = rows.groupBy(by, "s").agg(
        F.max(F.when(F.col("header"), stripped(F.col("line")))).alias("title"), F.min(F.when(~F.col("header"), F.col("at"))).alias("start"),
        F.max(F.when(~F.col("header"), F.col("at") + F.length("line"))).alias("stop"), F.max(~F.col("header") & F.rlike("line", F.lit(r"\S"))).alias("some"))
    kept = told.filter("some").withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy("s")) - 1)
    return kept.select(by, "i", F.coalesce("title", F.lit("Introduction")).alias("title"), "start", "stop")


def within(found: DataFrame, segments: DataFrame, around: int = 0, by: str = "doc_id", cell: int = 500) -> DataFrame:
    """found with the segment (by, i, start, stop) in which each mention begins, as `segment`, and first, last: where the
    segments around it begin and end. Segments go to all cells that they cover, mentions to that of their start."""
    w = Window.partitionBy(by).orderBy("i").rowsBetween(-around, around)
    s = segments.withColumns({"first": F.min("start").over(w), "last": F.max("stop").over(w)}).withColumnsRenamed({"i": "segment", "start": "_a", "stop": "_b"})
    s = s.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / cell), F.floor(F.col("_b") / cell))))
    m = found.withColumn("_cell", F.floor(F.col("start") / cell))
    return m.join(s, [by, "_cell"]).filter((F.col("start") >= F.col("_a")) & (F.col("start") < F.col("_b"))).drop("_cell", "_a", "_b")


def token_windows(found: DataFrame, docs: DataFrame, size: int, by: str = "doc_id") -> DataFrame:
    """(by, text, first, n, window) for each distinct mention text: `size` tokens on either side of its first occurrence.

    A document's tokens are made once, and joined by a control character, in which a mention's tokens are looked up.
    """
    sep = "\x01"
    tokens = lambda t: F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    asked = found.select(by, "text").groupBy(by).agg(F.collect_set("text").alias("asked"))
    whole = docs.select(by, tokens(F.col("text")).alias("t")).withColumn("joined", F.concat(F.lit(sep), F.array_join("t", sep), F.lit(sep)))

    def look(x: Column) -> Column:
        own = tokens(x)
        at = F.instr(F.col("joined"), F.concat(F.lit(sep), F.array_join(own, sep), F.lit(sep)))
        first = F.length(F.regexp_replace(F.left(F.col("joined"), at), f"[^{sep}]+", "")) - 1
        return F.struct(x.alias("text"), F.when(at > 0, first).alias("first"), F.size(own).alias("n"))

    rows = whole.join(asked, by).withColumn("x", F.transform("asked", look))
    start = lambda r: F.greatest(r["first"] - size, F.lit(0))
    cut = F.transform("x", lambda r: F.struct(r["text"].alias("text"), r["first"].alias("first"), r["n"].alias("n"), F.when(r["first"].isNotNull(), F.array_join(F.slice("t", start(r) + 1, r["first"] + r["n"] + size - start(r)), " ")).alias("window")))
    return rows.select(by, F.explode(cut).alias("x")).select(by, "x.*").filter("window is not null")


def pair_context(found: DataFrame, docs: DataFrame, around: int = 50, by: str = "doc_id") -> DataFrame:
    """found (by, start, stop) with the text `around` characters on either side, out to white space, as `context`."""
    joined = found.join(docs.select(F.col(by), F.col("text").alias("_text")), by)
    a = before_space(F.col("_text"), F.greatest(F.col("start") - around, F.lit(0)))
    b = after_space(F.col("_text"), F.least(F.col("stop") + around, F.length("_text")))
    return joined.withColumns({"context_start": a, "context_stop": b}).withColumn("context", stripped(F.substring(F.col("_text"), F.col("context_start") + 1, F.col("context_stop") - F.col("context_start")))).drop("_text")


def party_references(found: DataFrame, docs: DataFrame, around: int = 200, by: str = "doc_id") -> DataFrame:
    """Mentions (by, rank, start) with each reference to a party within reach: its kind, words and first place."""
    low = F.greatest(F.col("start") - around, F.lit(0))
    joined = found.join(docs.select(F.col(by), F.col("text").alias("_text")), by).withColumn("_low", low).withColumn("_near", F.lower(F.substring(F.col("_text"), F.col("_low") + 1, F.col("stop") + around - F.col("_low"))))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("reference")) for k, refs in PARTY_REFERENCES.items() for r in refs])
    rows = joined.filter(F.rlike("_near", F.lit("|".join(r for refs in PARTY_REFERENCES.values() for r in refs)))).select(by, "rank", "start", "_low", "_near", F.explode(each).alias("x"))
    at = F.instr(F.col("_near"), F.col("x.reference"))
    return rows.withColumn("_at", at).filter("_at > 0").select(by, "rank", "start", "x.kind", "x.reference", (F.col("_low") + F.col("_at") - 1).alias("reference_start"))


def segments(docs: DataFrame, most: int = 200, overlap: int = 50, by: str = "doc_id") -> DataFrame:
    """(by, sentence, pos, segment) of sentences of ten characters and more; longer ones than `most` in windows that overlap."""
    rows = docs.select(by, F.posexplode(F.split("text", r"[.!?]+", -1)).alias("i", "t")).select(by, (F.col("i") + 1).alias("sentence"), stripped(F.col("t")).alias("t")).filter(F.length("t") >= 10)
    step, n = most - overlap, F.length("t")
    last = F.when(n > most, F.ceil(n / step).cast("int") - 1).otherwise(0)
    rows = rows.withColumn("pos", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: k * step)))
    rows = rows.withColumn("segment", F.when(n > most, stripped(F.substring(F.col("t"), F.col("pos") + 1, F.lit(most)))).otherwise(F.col("t")))
    return rows.filter((n <= most) | (F.length("segment") > 20)).select(by, "sentence", "pos", "segment")


def joined_sentences(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, sentence, text, parts): sentences of docs (by, text), one that ends with an abbreviation together with the next."""
    rows = docs.select(by, F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*\s*"), F.lit(0))).alias("i", "t")).withColumn("t", stripped(F.col("t"))).filter("t <> ''")
    rows = rows.withColumn("open", F.regexp_extract("t", r"\S+\z", 0).isin(*OPEN_ENDS))
    w = Window.partitionBy(by).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("sentence", F.coalesce(F.count_if(~F.col("open")).over(w), F.lit(0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"])
    return rows.groupBy(by, "sentence").agg(F.array_join(parts, " ").alias("text"), F.count("*").alias("parts"))
