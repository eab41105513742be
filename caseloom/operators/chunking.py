"""Chunks, pages and boundaries of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let, spans

# Fixed values.
PAGE_BREAKS = (r"\f", r"\n\s*Page\s+\d+\s*\n", r"\n\s*-\s*\d+\s*-\s*\n", r"\n\s*\d+\s*\n\s*\n")
PAGE_HEADERS = (
    r"\n\s*(?:CASE\s+NO\.?|Case\s+Number)\s*:?\s*\d+",
    r"\n\s*(?:IN\s+THE\s+(?:UNITED\s+STATES\s+)?(?:DISTRICT\s+)?COURT)",
    r"\n\s*(?:UNITED\s+STATES\s+(?:DISTRICT\s+)?COURT)",
    r"\n\s*(?:SUPERIOR\s+COURT\s+OF)",
    r"\n\s*(?:STATE\s+OF\s+\w+)",
    r"\n\s*(?:BEFORE\s+THE\s+)",
    r"\n\s*(?:ORDER\s*(?:GRANTING|DENYING)?)",
    r"\n\s*(?:MEMORANDUM\s+(?:OPINION\s+)?(?:AND\s+)?ORDER)",
)
#: Words of a page at least and at most where nothing else divides a text; of a page between headers, more than.
PAGE_WORDS, PAGE_LEAST = (250, 400), 20
BOUNDARIES = (("paragraph", r"\n\s*\n"), ("section", r"\n(?=(?:[IVX]+\.|[A-Z]\.|\d+\.)\s)"), ("sentence", r"[.!?]+\s+"), ("citation", r"\d+\s+[A-Z][A-Za-z.]*\s+\d+"), ("word", r"\s+"))


def windows(docs: DataFrame, size: int, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    """key, chunk, start, stop, content: windows of so many characters that share overlap with the next; the last ends with the text.

    A text is cut into steps once, and a window is joined from its steps: the cost grows with the text's length alone.
    """
    n, step = F.length("text"), size - overlap
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")

    def cut(pieces: Column) -> Column:
        content = lambda k: F.left(F.array_join(F.slice(pieces, k + 1, 1 + -(-overlap // step)), ""), F.lit(size))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("chunk"), (k * step).alias("start"), F.least(k * step + size, n).alias("stop"), content(k).alias("content")))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return docs.filter(n > 0).select(key, F.explode(let(pieces, cut)).alias("w")).select(key, "w.*")


def boundaries(docs: DataFrame, kinds: dict[str, tuple[str, float]], key: str = "doc_id") -> DataFrame:
    """key, kind, position (where a match ends), strength of each boundary; of several at a position the strongest."""
    each = [F.transform(spans(F.col("text"), p), _boundary(k, s)) for k, (p, s) in kinds.items()]
    rows = docs.select(key, F.explode(F.concat(*each)).alias("b")).select(key, "b.*")
    return rows.groupBy(key, "position").agg(F.max("strength").alias("strength"), F.max_by("kind", F.struct("strength", "kind")).alias("kind"))


def _boundary(kind: str, strength: float):
    return lambda m: F.struct(m["stop"].alias("position"), F.lit(strength).alias("strength"), F.lit(kind).alias("kind"))


def pages(docs: DataFrame, words_a_page: tuple[int, int] = PAGE_WORDS, key: str = "doc_id") -> DataFrame:
    """key, page, content of each page that isn't blank: cut at the first kind of page break that a text has; else before
    the headers of the first kind that gives two pages of some length; else by words.

    A page keeps the number of its piece, so numbers skip blank pieces.
    """
    text, strip = F.col("text"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    low, high = words_a_page

    def by_words(w: Column) -> Column:
        n = F.size(w)
        size = F.least(F.lit(high), F.greatest(F.lit(low), F.floor(n / F.greatest(F.lit(1), F.floor(n / high))))).cast("int")
        return let(size, lambda k: F.transform(F.sequence(F.lit(0), F.ceil(n / k).cast("int") - 1), lambda i: F.array_join(F.slice(w, i * k + 1, k), " ")))

    def by_headers(p: str) -> Column:
        heads = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        parts = let(F.split(text, p, -1), lambda x: F.zip_with(heads, F.slice(x, 2, F.size(x)), lambda h, r: F.concat(h, r)))
        joined = let(parts, lambda x: F.transform(x, lambda t, i: strip(F.when(i == 0, F.concat(F.split(text, p, 2)[0], t)).otherwise(t))))
        some = F.filter(joined, lambda t: F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))) > PAGE_LEAST)
        return F.when(F.size(heads) > 1, let(some, lambda x: F.when(F.size(x) > 1, x)))

    cut = F.when(F.rlike(text, F.lit("(?i)" + PAGE_BREAKS[0])), F.split(text, "(?i)" + PAGE_BREAKS[0], -1))
    for p in PAGE_BREAKS[1:]:
        cut = cut.when(F.rlike(text, F.lit("(?i)" + p)), F.split(text, "(?i)" + p, -1))
    headed = F.coalesce(*[by_headers("(?i)" + p) for p in PAGE_HEADERS], let(words, by_words))
    rows = docs.filter(F.rlike("text", F.lit(r"\S"))).select(key, F.posexplode(cut.otherwise(headed)).alias("page", "content"))
    return rows.select(key, (F.col("page") + 1).alias("page"), strip(F.col("content")).alias("content")).filter("content <> ''")


def with_previous_pages(pages_: DataFrame, k: int = 1, key: str = "doc_id") -> DataFrame:
    """pages with `context`: the contents of the k pages before, joined by blank lines."""
    w = Window.partitionBy(key).orderBy("page").rowsBetween(-k, -1)
    return pages_.withColumn("context", F.array_join(F.collect_list("content").over(w), "\n\n"))


def combined(pages_: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """(key, by, first, pages, content) of pages that share `by`, in order, each under a line with its number."""
    told = F.struct("page", F.concat(F.lit("=== PAGE "), F.col("page"), F.lit(" ===\n"), F.col("content")).alias("t"))
    parts = F.transform(F.sort_array(F.collect_list(told)), lambda x: x["t"])
    return pages_.groupBy(key, by).agg(F.min("page").alias("first"), F.count("*").alias("pages"), F.array_join(parts, "\n\n").alias("content"))


def extended(chunks: DataFrame, overlap: int, key: str = "doc_id") -> DataFrame:
    """chunks with so many characters of the neighbours on either side."""
    w = Window.partitionBy(key).orderBy("chunk")
    before, after = F.lag("content").over(w), F.lead("content").over(w)
    return chunks.withColumn("content", F.concat(F.coalesce(F.right(before, F.lit(overlap)), F.lit("")), F.col("content"), F.coalesce(F.left(after, F.lit(overlap)), F.lit(""))))


def statistics(chunks: DataFrame, by: list[str]) -> DataFrame:
    n = F.length("content")
    return chunks.groupBy(*by).agg(F.count("*").alias("n"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"))


def quality(content: Column) -> Column:
    """1, halved for short chunks, .8 of it without end punctuation, 1.1 with a sentence; 1 at most."""
    score = F.when(F.length(F.trim(content)) < 50, 0.5).otherwise(1.0) * F.when(F.rlike(F.trim(content), F.lit(r"[.!?]\z")), 1.0).otherwise(0.8) * F.when(F.rlike(content, F.lit(r"[.!?]\s")), 1.1).otherwise(1.0)
    return F.least(F.lit(1.0), score)


def size_score(actual: Column, target: int) -> Column:
    r = actual / target
    return F.when(r.between(0.8, 1.2), 1.0).when(r.between(0.5, 1.5), 0.7).when(r.between(0.3, 2.0), 0.4).otherwise(0.1)


def coherence(content: Column) -> Column:
    """Mean similarity of the words of consecutive sentences; 1 for a single sentence. Each sentence's words are listed once."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    sets = F.transform(F.filter(F.split(content, r"[.!?]+\s*"), lambda x: F.trim(x) != ""), words)

    def alike(a: Column, b: Column) -> Column:
        return let(F.size(F.array_intersect(a, b)), lambda k: F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(k / (F.size(a) + F.size(b) - k)))

    def mean(s: Column) -> Column:
        pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), alike)
        return F.when(F.size(s) < 2, 1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x) / (F.size(s) - 1))

    return let(sets, mean)


def checked(chunks: DataFrame, least: int = 100, most: int = 1000, limit: int = 100, key: str = "doc_id") -> DataFrame:
    """Chunks that aren't blank, the first of each document up to limit, with flags for those too short or over 1.2 times too long."""
    kept = chunks.filter(F.trim("content") != "")
    ranked = kept.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("chunk"))).filter(F.col("_r") <= limit).drop("_r")
    n = F.length("content")
    return ranked.withColumns({"below_min_size": n < least, "exceeds_max_size": n > 1.2 * most})


def distinct(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first chunk of each trimmed, lower-cased content of a document."""
    w = Window.partitionBy(key, F.lower(F.trim("content"))).orderBy("chunk")
    return chunks.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _each_text(docs: DataFrame, cut, key: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, a, b, t[a:b].strip()) for k, t in zip(f[key], f["text"], strict=True) for i, (a, b) in enumerate(cut(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "start", "stop", "content"])

    return docs.select(key, "text").mapInPandas(run, f"{key} long, chunk int, start int, stop int, content string")


def fixed_chunks(docs: DataFrame, most: int = 1000, key: str = "doc_id") -> DataFrame:
    """Chunks of at most so many characters, cut at the last space; each begins where the one before ended, so a text is walked in order."""

    def cut(text: str) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(text):
            while at < len(text) and text[at].isspace():
                at += 1
            stop = min(at + most, len(text))
            if stop < len(text):
                space = text.rfind(" ", at, stop)
                stop = space if space > at else stop
            if at < stop:
                yield at, stop
            at = max(stop, at + 1)

    return _each_text(docs, cut, key)


def boundary_chunks(docs: DataFrame, size: int = 8000, overlap: int = 500, before: int = 800, after: int = 200, key: str = "doc_id") -> DataFrame:
    """Chunks that end at the boundary nearest to their size: of the first kind (paragraph, section, sentence, citation, word) with any in reach."""
    found = [re.compile(p) for _, p in BOUNDARIES]

    def cut(text: str) -> Iterator[tuple[int, int]]:
        ends = [[m.end() for m in p.finditer(text)] for p in found]
        at = 0
        while at < len(text):
            ideal = at + size
            stop = len(text)
            if ideal < len(text):
                low, high = max(at + size // 2, ideal - before), ideal + after
                near = next((c for c in ([e for e in kind if low <= e <= high] for kind in ends) if c), [ideal])
                stop = min(min(near, key=lambda e: abs(e - ideal)), len(text))
            yield at, stop
            if stop >= len(text):
                break
            at = max(stop - overlap, at + 1)

    return _each_text(docs, cut, key)


def packed_paragraphs(docs: DataFrame, most: int = 1000, key: str = "doc_id") -> DataFrame:
    """Consecutive paragraphs together up to so many characters, with true positions; a longer paragraph is a chunk of its own."""

    def cut(text: str) -> Iterator[tuple[int, int]]:
        ends = [*(m.start() for m in re.finditer(r"\n\s*\n", text)), len(text)]
        at = 0
        for k, end in enumerate(ends):
            following = ends[k + 1] if k + 1 < len(ends) else None
            if following is None or following - at > most:
                if text[at:end].strip():
                    yield at, end
                at = end

    return _each_text(docs, cut, key)


def token_bins(chunks: DataFrame, most: int = 8000, key: str = "doc_id") -> DataFrame:
    """chunks with `bin`: consecutive ones share a bin while their tokens (a quarter of the characters) fit; one document at a time."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        bins, used, n = [], 0, 0
        for tokens in rows["content"].str.len() // 4:
            if used and used + tokens > most:
                n, used = n + 1, 0
            used += tokens
            bins.append(n)
        return rows.assign(bin=bins)

    return chunks.groupBy(key).applyInPandas(fill, chunks.withColumn("bin", F.lit(0)).schema)
