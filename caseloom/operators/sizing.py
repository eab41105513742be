"""Size of documents, edge cases, and the strategy by which a document is processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds in characters, budgets in tokens.
VERY_SMALL, SMALL, MEDIUM, FOUR_WAVE_FROM = 5_000, 50_000, 150_000, 20_000
CONTEXT, MARGIN, CHUNK, OVERLAP, LARGE_OVERLAP = 32_768, 2_000, 8_000, 500, 1_000
PROMPT = {"single_pass": 5_000, "three_wave": 17_500, "four_wave": 45_000, "eight_wave_fallback": 26_900}
RESPONSE = {"single_pass": 1_000, "three_wave": 4_096, "four_wave": 6_000}
COST_PER_1K = 0.000656


def with_size(docs: DataFrame, metadata: str | None = None) -> DataFrame:
    """chars, tokens (a quarter, cut), words, lines, pages, size_category, est_seconds and est_cost of each text.

    metadata: a map column with a page count under one of four names.
    """
    chars = F.length("text")
    pages = F.coalesce(*[F.when(F.col(metadata)[k].cast("int") != 0, F.col(metadata)[k].cast("int")) for k in ("pages", "page_count", "num_pages", "pageCount")], F.lit(0)) if metadata else F.lit(0)
    out = docs.withColumns({
        "chars": chars,
        "tokens": F.floor(chars / 4).cast("int"),
        "words": F.when(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))),
        "lines": F.when(chars == 0, 0).otherwise(F.size(F.split("text", "\n", -1))),
        "pages": pages,
        "size_category": size_category(chars),
    })
    chunks = F.floor(F.col("chars") / 32_000) + 1
    category = F.col("size_category")
    seconds = F.when(category == "very_small", 0.5).when(category == "small", 1.0).when(category == "medium", F.least(F.lit(4.0), chunks * 0.85)).otherwise(chunks * 1.0)
    cost = F.when(category == "very_small", F.lit(5810.0)).when(category == "small", F.lit(30838.0)).otherwise(chunks * 30838.0) * COST_PER_1K / 1000
    return out.withColumns({"est_seconds": seconds, "est_cost": cost})


def size_category(chars: Column) -> Column:
    return F.when(chars <= VERY_SMALL, "very_small").when(chars <= SMALL, "small").when(chars <= MEDIUM, "medium").otherwise("large")


def is_text(text: Column) -> Column:
    """At most a twentieth of the first 1000 characters are control characters other than tab and line ends."""
    bad = F.length(F.regexp_replace(F.substring(text, 1, 1000), r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return F.when(F.length(text) == 0, True).otherwise(bad / F.least(F.length(text), F.lit(1000)) <= 0.05)


def edge_case(text: Column) -> Column:
    """empty_document, too_small or invalid_document; null for others."""
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "empty_document").when(F.length(text) < 50, "too_small").when(~is_text(text), "invalid_document")


def chunk_count(tokens: Column, chunk: int = CHUNK) -> Column:
    return F.when(tokens <= chunk, 1).otherwise(F.floor(tokens / (chunk - OVERLAP)).cast("int") + 1)


def route(docs: DataFrame, override: str | None = None, relationships: bool = False, graph: bool = False) -> DataFrame:
    """with_size, and the decision: strategy, prompt_version, chunk_size, overlap, boundaries, num_chunks, est_tokens,
    est_duration, est_cost, accuracy, extract_relationships.

    Edge cases come first, then graph mode, an override, relationships over 5000 characters, over 20000 characters, and
    the size category.
    """
    sized = with_size(docs).drop("est_seconds", "est_cost")
    tokens, chars, category = F.col("tokens"), F.col("chars"), F.col("size_category")
    fits = F.lit(PROMPT["three_wave"]) + tokens + RESPONSE["three_wave"] <= CONTEXT - MARGIN
    small = F.when(fits, "three_wave").otherwise("small_chunked")
    by_size = F.when(category == "very_small", "single_pass").when(category == "small", small).when(category == "medium", "medium").otherwise("large")
    if graph:
        branch = F.lit("four_wave_graph")
    elif override == "single_pass":
        branch = F.lit("single_pass")
    elif override == "three_wave":
        branch = small
    elif override == "four_wave":
        branch = F.lit("four_wave_asked")
    elif override == "three_wave_chunked":
        branch = F.when(category.isin("medium", "large"), "medium").otherwise(small)
    elif override == "eight_wave_fallback":
        branch = F.lit("eight_wave_fallback")
    elif override:
        branch = by_size
    else:
        branch = F.when(chars > FOUR_WAVE_FROM, "four_wave_large").otherwise(by_size)
        if relationships:
            branch = F.when(chars > VERY_SMALL, "four_wave_asked").otherwise(branch)
    branch = F.coalesce(edge_case(F.col("text")), branch)
    out = sized.withColumn("_b", branch)
    b, n = F.col("_b"), chunk_count(tokens)
    is_edge, chunked, four = b.isin("empty_document", "too_small", "invalid_document"), b.isin("small_chunked", "medium", "large"), F.startswith(b, F.lit("four_wave"))
    total = (
        F.when(b.isin("empty_document", "invalid_document"), 0)
        .when(b == "too_small", tokens)
        .when(b == "single_pass", tokens + PROMPT["single_pass"] + RESPONSE["single_pass"])
        .when(b.isin("three_wave", "small_chunked"), tokens + PROMPT["three_wave"] + RESPONSE["three_wave"])
        .when(four, tokens + PROMPT["four_wave"] + RESPONSE["four_wave"])
        .when(b == "eight_wave_fallback", tokens + PROMPT["eight_wave_fallback"])
        .otherwise(tokens)
    )
    return out.withColumns({
        "strategy": F.when(chunked, "three_wave_chunked").when(four, "four_wave").otherwise(b),
        "prompt_version": F.when(is_edge, F.lit(None)).when(b == "single_pass", "single_pass_consolidated_v1").when(four, "four_wave_optimized_v1").when(b == "eight_wave_fallback", "eight_wave_multipass_v2").otherwise("three_wave_optimized_v1"),
        "chunk_size": F.when(chunked, CHUNK),
        "overlap": F.when(b == "large", LARGE_OVERLAP).when(chunked, OVERLAP),
        "boundaries": F.when(b == "large", "section").when(chunked, "paragraph"),
        "num_chunks": F.when(chunked, n).otherwise(0),
        "est_tokens": total.cast("int"),
        "est_duration": F.when(is_edge, 0.0).when(b == "single_pass", 0.5).when(b == "three_wave", 1.0).when(b == "large", n * 1.0).when(chunked, n * 0.85).when(b == "four_wave_graph", 180.0).when(b == "four_wave_asked", 150.0).when(four, 200.0).otherwise(2.0),
        "est_cost": F.when(is_edge, 0.0).when(b == "single_pass", 0.0038).when(b == "three_wave", 0.0159).when(chunked, n * 0.0159).when(four, total / 1000 * 0.00075).otherwise(0.0254),
        "accuracy": F.when(is_edge, 0.0).when(b == "single_pass", 0.87).when(b == "three_wave", 0.90).when(b == "small_chunked", 0.89).when(b == "medium", 0.91).when(b == "large", 0.92).when(b == "four_wave_asked", 0.92).when(four, 0.95).otherwise(0.93),
        "extract_relationships": four,
    }).drop("_b")


def decision_warnings(max_cost: float = 1.0, max_seconds: float = 30.0) -> Column:
    """Names of what is doubtful in a decision: tokens over the context, cost, duration, or no tokens outside an edge case."""
    return F.array_compact(F.array(
        F.when(F.col("est_tokens") > CONTEXT, "context"), F.when(F.col("est_cost") > max_cost, "cost"), F.when(F.col("est_duration") > max_seconds, "duration"),
        F.when((F.col("est_tokens") == 0) & ~F.col("strategy").isin("empty_document", "invalid_document"), "tokens"),
    ))


def optimal_strategy(document_type: Column, chars: Column, time_ms: Column, accuracy: Column) -> Column:
    """Time comes first, then accuracy, kind of document and length."""
    return (
        F.when((time_ms > 0) & (time_ms < 1000), "regex")
        .when((time_ms > 0) & (time_ms < 5000), "unified")
        .when(accuracy > 0.9, "multipass")
        .when(document_type.isin("court_opinion", "appellate_decision"), "multipass")
        .when(document_type.isin("contract", "agreement"), "ai_enhanced")
        .when(document_type.isin("statute", "regulation"), "unified")
        .when(chars > 100_000, "multipass")
        .when(chars > 20_000, "ai_enhanced")
        .otherwise("unified")
    )


def chunking_strategy(strategy: Column) -> Column:
    return F.when(strategy == "multipass", "legal").when(strategy == "ai_enhanced", "semantic").when(strategy == "unified", "hybrid").when(strategy == "regex_only", "simple").otherwise("hybrid")


def blended_tokens(text: Column, adjustment: float = 1.0) -> Column:
    """Tokens from characters (.4) and words (.6), and a tenth of the special characters."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    special = F.length(F.regexp_replace(text, r"[A-Za-z0-9\s]", ""))
    return F.when(F.length(text) == 0, 0).otherwise(F.floor((0.4 * (F.length(text) / 4.0) + 0.6 * (words / 0.75)) * adjustment) + F.floor(special / 10)).cast("int")


def token_tier(tokens: Column) -> Column:
    return F.when(tokens < 500, "small").when(tokens < 2000, "medium").when(tokens < 10_000, "large").otherwise("xlarge")


def latency_tier(ms: Column) -> Column:
    return F.when(ms < 100, "SS_LIGHTNING").when(ms < 250, "SS_ULTRA_FAST").when(ms < 500, "S_EXCEPTIONAL").when(ms < 1000, "A_FAST").when(ms < 2000, "B_STANDARD").when(ms < 5000, "C_SLOW").otherwise("D_VERY_SLOW")


def prompt_budget(prompt: Column, wanted: Column, context: int = CONTEXT) -> Column:
    """Completion tokens that fit beside a prompt; null where none do."""
    return F.when(prompt >= context, F.lit(None)).otherwise(F.least(wanted, F.lit(context) - prompt))


def overlapped_chunk_size(tokens: Column, most: int, percent: float = 0.1) -> Column:
    """Tokens a chunk if tokens are cut evenly into chunks of at most so many, each with that share more."""
    n = F.ceil(tokens / F.lit(most * (1 - percent)))
    return F.when(tokens <= most, tokens).otherwise(F.ceil(tokens / n * (1 + percent))).cast("int")


def processing_seconds(prompt: Column, completion: Column, read: float = 19_000.0, write: float = 150.0) -> Column:
    """Seconds for tokens read and written at so many a second."""
    return prompt / read + completion / write


def backoff_ms(attempt: Column, initial: float = 100.0, base: float = 2.0, most: float = 10_000.0) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(base), attempt - 1), F.lit(most))
