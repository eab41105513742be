"""Entities of a document resolved from its mentions in order: folds that no join expresses, one document at a time.

Each fold takes the rows of one document in a pandas frame; a document's mentions are bounded by the matches that the
scan keeps of each pattern. Similarity of texts is the ratio of matching blocks, which depends on order.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relations import COMPATIBLE

#: Similarity from which two mentions are one entity; when merging aggressively; of citations.
SAME, AGGRESSIVE, CITATIONS = 0.85, 0.70, 0.90
PRONOUNS = {"he", "she", "him", "her", "his", "hers", "it", "its", "they", "them", "their"}
ENTITIES = "doc_id long, entity int, entity_type string, canonical string, variants array<string>, confidence double, occurrences int, first_start int, chunks array<int>"


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()


def compatible(a: str, b: str) -> bool:
    return a == b or any(a in g and b in g for g in COMPATIBLE)


def similarity(text: str, kind: str, entity: dict) -> float:
    """.4 for the most similar variant, .3 for the canonical form, .2 for one type, .1 for compatible ones."""
    best = 1.0 if text in entity["variants"] else max(ratio(text, v) for v in entity["variants"])
    return 0.4 * best + 0.3 * ratio(text, entity["canonical"]) + (0.3 if kind == entity["entity_type"] else 0.1 if compatible(kind, entity["entity_type"]) else 0.0)


class _Kind:
    """The entities of one type, and counts of the characters of their variants, which bound ratios from above."""

    def __init__(self) -> None:
        self.entities: list[dict] = []
        self.first: list[int] = []  # the row of each entity's canonical form
        self.rows = 0
        self.counts, self.sizes, self.owner = np.zeros((16, 128), np.int32), np.zeros(16, np.int64), np.zeros(16, np.int64)

    def add(self, text: str, into: dict) -> None:
        """A variant of an entity; its first is the canonical form."""
        if self.rows == len(self.sizes):
            self.counts, self.sizes, self.owner = (np.concatenate((x, np.zeros_like(x))) for x in (self.counts, self.sizes, self.owner))
        if not into["variants"]:
            into["_at"] = len(self.entities)
            self.entities.append(into)
            self.first.append(self.rows)
        self.counts[self.rows], self.sizes[self.rows], self.owner[self.rows] = _counts(text), len(text), into["_at"]
        self.rows += 1

    def near(self, text: str, threshold: float) -> list[dict]:
        """All entities whose similarity may reach the threshold: no ratio is above that of the characters in common."""
        n = self.rows
        bound = np.minimum(self.counts[:n], _counts(text)).sum(axis=1) * 2.0 / np.maximum(self.sizes[:n] + len(text), 1)
        best = np.zeros(len(self.entities))
        np.maximum.at(best, self.owner[:n], bound)
        return [self.entities[i] for i in np.flatnonzero(0.4 * best + 0.3 * bound[self.first] + 0.3 >= threshold)] if n else []


def _counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") & 127, minlength=128)


def resolve(found: DataFrame, threshold: float = SAME, chunk: int = 1000) -> DataFrame:
    """One row of each entity of a document: a mention, in order of start, joins the entity it is most similar to, or makes one.

    Confidences are a running mean. found: doc_id, start, rank, entity_type, text, confidence.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        entities: list[dict] = []
        by_text: dict[tuple[str, str], dict] = {}
        by_type: dict[str, _Kind] = {}
        for r in rows.sort_values(["start", "rank"]).itertuples(index=False):
            text = r.text.strip().lower()
            into = by_text.get((r.entity_type, text))
            if into is None or into["canonical"] != text:  # nothing is more similar than an equal canonical form
                least = threshold if into is None else max(threshold, similarity(text, r.entity_type, into))
                near = by_type[r.entity_type].near(text, least) if r.entity_type in by_type else ()
                score, _, into = max(((similarity(text, r.entity_type, e), -e["entity"], e) for e in near), default=(0.0, 0, None), key=lambda x: x[:2])
                into = into if score >= threshold else None
            if into is None:
                into = {"entity": len(entities), "entity_type": r.entity_type, "canonical": text, "variants": [], "confidence": 0.0, "occurrences": 0, "first_start": r.start, "chunks": set()}
                entities.append(into)
            by_text[r.entity_type, text] = into
            n = into["occurrences"]
            into["confidence"] = (into["confidence"] * n + r.confidence) / (n + 1)
            into["occurrences"] = n + 1
            into["chunks"].add(int(r.start) // chunk)
            if text not in into["variants"]:
                by_type.setdefault(r.entity_type, _Kind()).add(text, into)
                into["variants"].append(text)
        out = [{**e, "doc_id": rows["doc_id"].iloc[0], "chunks": sorted(e["chunks"]), "variants": sorted(e["variants"])} for e in entities]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ENTITIES.split(", ")])

    return found.select("doc_id", "start", "rank", "entity_type", "text", "confidence").groupBy("doc_id").applyInPandas(fold, ENTITIES)


def merged(entities: DataFrame, aggressive: bool = False) -> DataFrame:
    """Entities of one type and similar canonical forms as one: variants and chunks joined, confidences weighted by occurrences."""
    threshold = AGGRESSIVE if aggressive else SAME

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for e in rows.sort_values("entity").to_dict("records"):
            for k in kept:
                if k["entity_type"] == e["entity_type"] and ratio(k["canonical"], e["canonical"]) >= threshold:
                    n = k["occurrences"] + e["occurrences"]
                    k.update(confidence=(k["confidence"] * k["occurrences"] + e["confidence"] * e["occurrences"]) / n, occurrences=n, variants=sorted({*k["variants"], *e["variants"]}), chunks=sorted({*k["chunks"], *e["chunks"]}), first_start=min(k["first_start"], e["first_start"]))
                    break
            else:
                kept.append(dict(e))
        return pd.DataFrame(kept, columns=list(rows.columns))

    return entities.groupBy("doc_id").applyInPandas(fold, entities.schema)


def fuzzy_clusters(found: DataFrame, threshold: float = SAME) -> DataFrame:
    """Greedy clusters of similar mentions of a type in a document; the longest text stands for each."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        seeds: list[dict] = []
        for r in rows.sort_values(["start", "rank"]).itertuples(index=False):
            text = " ".join(r.text.lower().split()).strip(" .,;:!?")
            for s in seeds:
                if s["entity_type"] == r.entity_type and (text in s["seen"] or ratio(text, s["key"]) >= threshold):
                    s["seen"].add(text)
                    s["n"] += 1
                    s["confidence"] = max(s["confidence"], r.confidence)
                    s["text"] = max(s["text"], r.text, key=len)
                    break
            else:
                seeds.append({"doc_id": r.doc_id, "entity_type": r.entity_type, "text": r.text, "key": text, "seen": {text}, "n": 1, "confidence": r.confidence, "start": r.start})
        return pd.DataFrame([{c: s[c] for c in ("doc_id", "entity_type", "text", "n", "confidence", "start")} for s in seeds], columns=["doc_id", "entity_type", "text", "n", "confidence", "start"])

    return found.select("doc_id", "start", "rank", "entity_type", "text", "confidence").groupBy("doc_id").applyInPandas(fold, "doc_id long, entity_type string, text string, n int, confidence double, start int")


def merge_two(primary: DataFrame, secondary: DataFrame, threshold: float = SAME) -> DataFrame:
    """Primary mentions, then secondary ones that overlap none of similar text; a surer overlapping one replaces it. By start and stop."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept = rows[rows["_p"] == 0].sort_values(["start", "stop", "rank"]).to_dict("records")
        for r in rows[rows["_p"] == 1].sort_values(["start", "stop", "rank"]).to_dict("records"):
            for i, k in enumerate(kept):
                if r["start"] < k["stop"] and k["start"] < r["stop"] and ratio(r["text"].lower(), k["text"].lower()) >= threshold:
                    if r["confidence"] > k["confidence"]:
                        kept[i] = r
                    break
            else:
                kept.append(r)
        return pd.DataFrame(sorted(kept, key=lambda k: (k["start"], k["stop"])), columns=list(rows.columns)).drop(columns="_p")

    both = primary.withColumn("_p", F.lit(0)).unionByName(secondary.withColumn("_p", F.lit(1)))
    return both.groupBy("doc_id").applyInPandas(fold, primary.schema)


def without_overlaps(found: DataFrame) -> DataFrame:
    """Greedy, in order of start: a mention that overlaps a kept one is dropped, or replaces the first such if it is surer."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in rows.sort_values(["start", "stop", "rank"]).to_dict("records"):
            i = next((i for i, k in enumerate(kept) if r["start"] < k["stop"] and k["start"] < r["stop"]), None)
            if i is None:
                kept.append(r)
            elif r["confidence"] > kept[i]["confidence"]:
                kept[i] = r
        return pd.DataFrame(kept, columns=list(rows.columns))

    return found.groupBy("doc_id").applyInPandas(fold, found.schema)


def references(found: DataFrame) -> DataFrame:
    """found with `refers_to`: for "the ..." the last full form of its type before it, for a pronoun the last person or party."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "rank"])
        last, person, out = {}, None, []
        for r in rows.itertuples(index=False):
            low = r.text.strip().lower()
            if low in PRONOUNS:
                out.append(person)
            elif low.startswith("the "):
                out.append(last.get(r.entity_type))
            else:
                out.append(None)
                last[r.entity_type] = r.text
                person = r.text if r.entity_type in ("PERSON", "PARTY", "JUDGE") else person
        return rows.assign(refers_to=pd.Series(out, index=rows.index, dtype=object))

    return found.groupBy("doc_id").applyInPandas(fold, found.withColumn("refers_to", F.lit(None).cast("string")).schema)


def page_batches(pages: DataFrame, size: int = 3) -> DataFrame:
    """pages (doc_id, page, complexity) with `batch`: one page less where the next are complex, one more where they are plain."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("page")
        level, at, n, out = rows["complexity"].tolist(), 0, 0, [0] * len(rows)
        while at < len(level):
            ahead = level[at : at + 2 * size]
            high, low = ahead.count("high"), ahead.count("low")
            take = max(1, size - 1) if high > len(ahead) / 2 else size + 1 if low > len(ahead) / 2 else size
            out[at : at + take] = [n] * len(out[at : at + take])
            at, n = at + take, n + 1
        return rows.assign(batch=out)

    return pages.groupBy("doc_id").applyInPandas(fold, pages.withColumn("batch", F.lit(0)).schema)
