"""Mentions: catalog patterns matched on documents, with their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.spans import collapsed, pairs, placed, window

#: Matches of one pattern in one text, and characters of context on either side, by default.
MOST, AROUND = 1000, 100


def _matches(p: C.Pattern, rank: int) -> Column:
    """A pattern's constants, and its matches in _text."""
    boost = C.TYPE_BOOSTS.get(p.entity_type.upper(), 1.0)
    named = 1.02 if any(x in p.name.lower() for x in C.NAME_BOOSTS) else 1.0
    told = (("name", p.name), ("entity_type", p.entity_type), ("source", p.source), ("rank", rank), ("base", p.confidence), ("boost", boost), ("named", named))
    return F.struct(*[F.lit(v).alias(k) for k, v in told], pairs(F.col("_text"), p.pattern).alias("pairs"))


def mentions(docs: DataFrame, patterns=C.GENERIC, threshold: float = 0.7, most: int | None = MOST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, name, entity_type, source, rank, start, stop, text, confidence of each match that is sure enough.

    All patterns are applied in one pass over a text, which isn't copied for each of them, and nothing is shuffled. Of
    one pattern the first `most` matches above the threshold of a text are kept, by default 1000; None keeps all.
    """

    def rows(p: Column) -> Column:
        def row(m: Column) -> Column:
            n = F.length(m["text"])
            sure = p["base"] * C.length_factor(n) * p["boost"] * p["named"]
            kept = [p[c].alias(c) for c in ("name", "entity_type", "source", "rank")]
            return F.struct(*kept, m["start"].alias("start"), m["stop"].alias("stop"), m["text"].alias("text"), F.least(F.lit(1.0), F.greatest(F.lit(0.5), sure)).alias("confidence"))

        found = F.filter(F.transform(placed(p["pairs"]), row), lambda m: m["confidence"] >= threshold)
        return F.slice(found, 1, most) if most else found

    hits = F.filter(F.array(*[_matches(p, n) for n, p in enumerate(patterns)]), lambda p: p["pairs"].isNotNull())
    return docs.select(F.col(key), F.col(text).alias("_text")).select(key, F.explode(F.flatten(F.transform(hits, rows))).alias("m")).select(key, "m.*")


def with_context(found: DataFrame, docs: DataFrame, before: int = AROUND, after: int = AROUND, key: str = "doc_id") -> DataFrame:
    """found with the characters around each mention, white space collapsed."""
    joined = found.join(docs.select(F.col(key).alias("_key"), F.col("text").alias("_text")), F.col(key) == F.col("_key"))
    return joined.withColumn("context", collapsed(window(F.col("_text"), F.col("start"), F.col("stop"), before, after))).drop("_key", "_text")


def split_objects(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions whose pattern's name tells of a citation, and the others."""
    cited = C.name_class(F.col("name")) == "citation"
    return found.filter(cited), found.filter(~cited)
