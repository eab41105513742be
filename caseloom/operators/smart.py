"""Chunks that respect a text's structure: sections, lines, paragraphs or sentences packed up to a size, chosen by kind of text.

Each function gives a column, array of (start, stop, text, kind). Pieces are cut once and packed in order by one fold whose
state is a size and the numbers of first pieces, so a text is walked once, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.context import sentence_spans
from ..functions.spans import let, pairs, placed, running, spans
from ..functions.text import document_type

#: Characters of a chunk at least and at most, shared with each neighbour, and of a text from which it is cut evenly.
LEAST, MOST, OVERLAP, LARGE = 100, 1000, 50, 50_000

# What begins a section, what isn't cut, and words by how hard they make a text.
SECTION_MARKERS = (
    r"^\s*(?:ARTICLE|Article|ART\.?)\s+[IVXLCDM]+",
    r"^\s*(?:SECTION|Section|SEC\.?|§)\s+\d+",
    r"^\s*\d+\.\s+[A-Z]",
    r"^\s*\([a-z]\)",
    r"^\s*\(\d+\)",
    r"^\s*[A-Z]\.\s+",
    r"^\s*\d+\.\d+",
    r"^\s*(?:WHEREAS|NOW,?\s*THEREFORE)",
    r"^\s*(?:WITNESSETH|RECITALS?)",
    r"^\s*(?:DEFINITIONS?|TERMS?)\s*:?$",
    r"^\s*(?:SCHEDULE|EXHIBIT|APPENDIX)\s+[A-Z0-9]",
)
CITATIONS = (
    r"\b\d+\s+[A-Z][a-z]+\.?\s*\d+[a-z]?\b",
    r"\b\d+\s+U\.S\.C\.?\s*§?\s*\d+",
    r"\b\d+\s+C\.F\.R\.?\s*§?\s*\d+",
    r"\b[A-Z][a-z]+\s+v\.\s+[A-Z][a-z]+",
    r"§§?\s*\d+(?:\.\d+)*",
)
QUOTES = (r'"[^"]{10,}"', r"'[^']{10,}'", r"``[^']+''")
HARD_WORDS = ("notwithstanding", "hereinafter", "whereas", "heretofore", "aforementioned", "hereunder", "thereunder", "pursuant", "estoppel", "certiorari", "mandamus")
MIDDLING_WORDS = ("plaintiff", "defendant", "appellant", "appellee", "jurisdiction", "precedent", "statute", "regulation", "liability", "negligence", "breach", "damages", "injunction", "motion", "discovery")
EASY_WORDS = ("court", "judge", "law", "legal", "case", "claim", "party", "agreement", "contract", "document", "filing", "order")

SECTION, CITATION, QUOTE = "(?im)" + "|".join(SECTION_MARKERS), "(?i)" + "|".join(CITATIONS), "|".join(QUOTES)
PARAGRAPH, TOKEN = r"\n\s*\n", r"[0-9a-z_\x{80}-\x{10FFFF}]+|[!-/:-@\[-^`{-~]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _chunk(start: Column, stop: Column, text: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), text.alias("text"), F.lit(kind).alias("kind"))


def _firsts(sizes: Column, most: int, must: Column | None = None, inside: Column | None = None, least: int = LEAST) -> Column:
    """Numbers of the pieces that begin a chunk: the first; one that must, after more than `least`; one that would pass `most`, unless it is inside a span."""
    none = F.transform(sizes, lambda _: F.lit(False))
    pieces = F.zip_with(F.zip_with(sizes, must if must is not None else none, lambda n, m: F.struct(n.alias("n"), m.alias("m"))), inside if inside is not None else none, lambda x, s: F.struct(x["n"].alias("n"), x["m"].alias("m"), s.alias("s")))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["i"] == 0) | (x["m"] & (acc["size"] > least)) | ((acc["size"] + x["n"] > most) & ~x["s"])
        return F.struct((acc["i"] + 1).alias("i"), F.when(new, x["n"]).otherwise(acc["size"] + x["n"]).alias("size"), F.when(new, F.concat(acc["out"], F.array(acc["i"]))).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(pieces, begin, step, lambda acc: acc["out"])


def _groups(pieces: Column, firsts: Column, body) -> Column:
    """body(number of the first piece, texts of a chunk's pieces) for each chunk."""
    return let(firsts, lambda f: F.transform(f, lambda a, k: body(a, F.slice(pieces, a + 1, F.coalesce(F.get(f, k + 1), F.size(pieces)) - a))))


def _lengths(pieces: Column, more: int = 0) -> Column:
    """Lengths, those of all but the last piece with so many more."""
    return F.transform(pieces, lambda x, i: F.length(x) + F.when(i < F.size(pieces) - 1, more).otherwise(0))


def paragraphs(text: Column, most: int = MOST) -> Column:
    def cut(p: Column) -> Column:
        return let(running(_lengths(p, 2)), lambda at: _groups(p, _firsts(_lengths(p, 2), most), lambda a, own: let(F.array_join(own, "\n\n"), lambda t: _chunk(F.get(at, a), F.get(at, a) + F.length(t), t, "paragraph"))))

    return let(F.split(text, PARAGRAPH, -1), cut)


def sentences(text: Column, most: int = MOST) -> Column:
    def cut(s: Column) -> Column:
        each = F.transform(s, lambda x: x["text"])
        return let(each, lambda e: _groups(e, _firsts(_lengths(e), most), lambda a, own: let(F.array_join(own, " "), lambda t: _chunk(F.get(s, a)["start"], F.get(s, a)["start"] + F.length(t), t, "sentence"))))

    lead = lambda x: F.length(F.regexp_extract(x["text"], r"^\s*", 0))
    found = F.transform(sentence_spans(text), lambda x: F.struct((x["start"] + lead(x)).alias("start"), stripped(x["text"]).alias("text")))
    return let(F.filter(found, lambda x: x["text"] != ""), cut)


def sections(text: Column, most: int = MOST) -> Column:
    """Sections from marker to marker; a longer one is cut at its paragraphs; without markers a text is cut at paragraphs."""

    def large(start: Column, t: Column) -> Column:
        def cut(p: Column) -> Column:
            parts = _groups(p, _firsts(_lengths(p), most), lambda a, own: F.array_join(own, "\n\n"))
            return let(parts, lambda c: F.zip_with(c, running(F.transform(c, lambda x: F.length(x) + 2)), lambda x, at: _chunk(start + at, start + at + F.length(x), x, "section_part")))

        return let(F.split(t, PARAGRAPH, -1), cut)

    heads = F.regexp_extract_all(text, F.lit(SECTION), F.lit(0))
    raw = F.zip_with(heads, F.slice(F.split(text, SECTION, -1), 2, F.size(heads)), lambda h, r: F.concat(h, r))
    found = F.zip_with(placed(pairs(text, SECTION)), raw, lambda s, r: F.struct(s["start"].alias("start"), F.length(r).alias("n"), stripped(r).alias("t")))
    each = F.transform(found, lambda s: F.when(F.length(s["t"]) <= most, F.array(_chunk(s["start"], s["start"] + s["n"], s["t"], "section"))).otherwise(large(s["start"], s["t"])))
    return F.when(F.rlike(text, F.lit(SECTION)), F.flatten(each)).otherwise(paragraphs(text, most))


def protected(text: Column) -> Column:
    """Spans of citations and quotes, which shouldn't be cut (as found; `merged_spans` joins those that touch)."""
    bare = lambda p: F.transform(spans(text, p), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.contains(s["text"], F.lit("\n")).alias("lines")))
    return F.concat(bare(CITATION), bare(QUOTE))


def legal(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Lines packed up to a size; a line that begins a section begins a chunk, one that begins inside a protected span doesn't for its size."""

    def cut(p: Column) -> Column:
        lines = p["lines"]
        starts = F.transform(lines, lambda x: F.rlike(x, F.lit(SECTION)))
        inside = F.transform(p["at"], lambda at: F.exists(p["spans"], lambda s: (s["start"] <= at) & (at < s["stop"])))
        whole = F.transform(lines, lambda x, i: F.concat(x, F.when(i < F.size(lines) - 1, "\n").otherwise("")))
        firsts = _firsts(_lengths(lines, 1), most, starts, inside, least)
        return let(whole, lambda w: _groups(w, firsts, lambda a, own: let(F.array_join(own, ""), lambda t: _chunk(F.get(p["at"], a), F.get(p["at"], a) + F.length(t), t, "legal_section"))))

    def held(x: Column) -> Column:
        """Spans that may hold the beginning of a line: those over several lines, and those that begin where a line does."""
        all_, at = x["spans"], x["at"]
        first = F.array_intersect(at, F.transform(all_, lambda s: s["start"]))
        some = let(first, lambda f: F.filter(all_, lambda s: s["lines"] | F.array_contains(f, s["start"])))
        return F.struct(x["lines"].alias("lines"), at.alias("at"), some.alias("spans"))

    lines = F.split(text, "\n", -1)
    found = let(lines, lambda x: F.struct(x.alias("lines"), running(_lengths(x, 1)).alias("at"), protected(text).alias("spans")))
    return let(let(found, held), cut)


def merged_spans(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, start, stop) of protected spans, those that overlap or touch as one."""
    rows = docs.select(by, F.explode(protected(F.col("text"))).alias("s")).select(by, "s.start", "s.stop")
    w = Window.partitionBy(by).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_r", reach).withColumn("_g", F.sum(F.when(F.col("start") <= F.col("_r"), 0).otherwise(1)).over(w))
    return rows.groupBy(by, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def complexity(text: Column) -> Column:
    """0 to 1 by words of law, length of sentences and density of citations."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    count = lambda t, words: F.size(F.filter(t, lambda x: x.isin(*words)))
    told = let(tokens, lambda t: F.struct(F.size(t).alias("n"), (count(t, HARD_WORDS) * 3 + count(t, MIDDLING_WORDS) * 2 + count(t, EASY_WORDS)).alias("hard")))
    sentences_ = F.size(F.filter(sentence_spans(text), lambda s: F.trim(s["text"]) != ""))
    cited = F.size(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)))

    def score(x: Column) -> Column:
        words = x["hard"] / (x["n"] * 3)
        both = F.when(sentences_ > 0, (words + F.least(x["n"] / sentences_ / 50, F.lit(1.0))) / 2).otherwise(words)
        return F.least(F.lit(1.0), both * 0.6 + F.least(cited / (x["n"] / 100) / 5, F.lit(1.0)) * 0.4)

    return let(told, lambda x: F.when(x["n"] == 0, F.lit(0.0)).otherwise(score(x)))


def strategy(text: Column) -> Column:
    """How a text is cut: by its kind, else by its complexity."""
    def chosen(kind: Column) -> Column:
        hard = let(complexity(text), lambda x: F.when(x > 0.7, "legal").when(x > 0.4, "paragraph").otherwise("sentence"))
        return F.when(kind.isin("contract", "statute"), "section").when(kind == "opinion", "legal").when(kind == "brief", "paragraph").otherwise(hard)

    return let(document_type(text), chosen)


def before_space(text: Column, at: Column) -> Column:
    """The last white space at or before a position, or the text's beginning."""
    return F.greatest(F.length(F.regexp_replace(F.substring(text, F.lit(1), at + 1), r"\S+\z", "")) - 1, F.lit(0))


def after_space(text: Column, at: Column) -> Column:
    """The first white space at or after a position, or the text's end."""
    return at + F.length(F.regexp_extract(F.substring(text, at + 1, F.length(text)), r"^\S*", 0))


def overlapped(chunks: DataFrame, overlap: int = OVERLAP, by: str = "doc_id") -> DataFrame:
    """chunks (by, chunk, start, stop) of texts (text) with so many characters of the neighbours, up to white space."""
    w = Window.partitionBy(by).orderBy("chunk")
    last = F.lead("chunk").over(w).isNull()
    start = F.when(F.col("chunk") == 0, F.col("start")).otherwise(before_space(F.col("text"), F.greatest(F.col("start") - overlap, F.lit(0))))
    stop = F.when(F.col("_last"), F.col("stop")).otherwise(after_space(F.col("text"), F.least(F.col("stop") + overlap, F.length("text"))))
    moved = chunks.withColumn("_last", last).withColumns({"_a": start, "_b": stop})
    return moved.withColumns({"start": F.col("_a"), "stop": F.col("_b")}).withColumn("content", stripped(F.substring(F.col("text"), F.col("_a") + 1, F.col("_b") - F.col("_a")))).drop("_a", "_b", "_last")


def smart(docs: DataFrame, over: int = LARGE, least: int = LEAST, most: int = 10_000, overlap: int = 500, by: str = "doc_id") -> DataFrame:
    """Texts of more than `over` characters in even chunks of .8 of their length, clamped, that overlap on both sides up to white space.

    splits: whether an end of the chunk is inside a protected span.
    """
    n, text = F.length("text"), F.col("text")
    size = F.greatest(F.lit(least), F.least(F.floor(n * 0.8), F.lit(most))).cast("int")
    rows = docs.filter(n > over).select(by, "text", size.alias("size"), protected(text).alias("_p")).withColumn("all", F.ceil(F.length("text") / F.col("size")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    start = F.when(F.col("chunk") == 0, 0).otherwise(before_space(text, F.greatest(F.lit(0), F.col("chunk") * F.col("size") - overlap)))
    stop = F.when(F.col("chunk") == F.col("all") - 1, n).otherwise(after_space(text, F.least(n, (F.col("chunk") + 1) * F.col("size") + overlap)))
    cut = rows.withColumns({"start": start, "stop": stop}).withColumn("content", stripped(F.substring(text, F.col("start") + 1, F.col("stop") - F.col("start")))).filter("content <> ''")
    # a touching neighbour is no matter: an end strictly inside a merged span is inside one span, or where two touch
    inside = lambda c: F.exists("_p", lambda s: (s["start"] < F.col(c)) & (F.col(c) < s["stop"])) | (F.exists("_p", lambda s: s["start"] == F.col(c)) & F.exists("_p", lambda s: s["stop"] == F.col(c)))
    return cut.withColumn("splits", inside("start") | inside("stop")).select(by, "chunk", "start", "stop", "content", "splits")


def rows(docs: DataFrame, chunks: Column, by: str = "doc_id") -> DataFrame:
    """(by, chunk, start, stop, content, kind) of texts that aren't empty, with the text."""
    return docs.filter(F.length("text") > 0).select(by, "text", F.posexplode(chunks).alias("chunk", "c")).select(by, "text", "chunk", "c.start", "c.stop", F.col("c.text").alias("content"), "c.kind")


def chunked(docs: DataFrame, how: str = "adaptive", least: int = LEAST, most: int = MOST, overlap: int = 0, by: str = "doc_id") -> DataFrame:
    """Chunks of docs (by, text) by a strategy (section, legal, paragraph, sentence or adaptive), extended by an overlap if asked."""
    text = F.col("text")
    ways = {"section": lambda: sections(text, most), "legal": lambda: legal(text, least, most), "paragraph": lambda: paragraphs(text, most), "sentence": lambda: sentences(text, most)}
    if how == "adaptive":
        cut = let(strategy(text), lambda h: F.when(h == "section", ways["section"]()).when(h == "legal", ways["legal"]()).when(h == "paragraph", ways["paragraph"]()).otherwise(ways["sentence"]()))
    else:
        cut = ways[how]()
    made = rows(docs, cut, by)
    return overlapped(made, overlap, by) if overlap else made
