"""Pattern catalogs from YAML or JSON files, read through Spark's file sources."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # JSON catalogs do without it
    yaml = None

PATTERNS = "file string, hash string, section string, name string, pattern string, confidence double, entity_type string, jurisdiction string, court_level string, pattern_type string, description string, examples array<string>, dependencies array<string>"
RELATIONS = "file string, category string, relationship_type string, source_entity string, target_entity string, indicators array<string>, examples array<string>, confidence double, bidirectional boolean, description string"
RESERVED = {"metadata", "dependencies", "version", "description", "validation", "settings"}


def _loaded(path: str, raw: bytes) -> Any:
    """The content of a file; null if it can't be read as what its name says."""
    try:
        if not path.endswith((".yaml", ".yml")):
            return json.loads(raw)
        return yaml.safe_load(raw) if yaml else None
    except Exception:  # one bad file doesn't spoil a catalog
        return None


def _texts(x: Any) -> list[str]:
    return [str(v) for v in x] if isinstance(x, list) else [str(x)] if x else []


def _found(content: Any, section: str = "") -> Iterator[tuple[str, str, dict]]:
    """(section, name, fields) of every pattern: items of a `patterns` list, or any mapping that holds a `pattern`."""
    if not isinstance(content, dict):
        return
    for key, value in content.items():
        if key == "patterns" and isinstance(value, list):
            for n, item in enumerate(value):
                if isinstance(item, dict) and "pattern" in item:
                    yield section or "patterns", str(item.get("name", f"pattern_{n}")), item
        elif isinstance(value, dict) and key not in RESERVED:
            if "pattern" in value:
                yield section or key, str(value.get("name", key)), value
            else:
                yield from _found(value, key)


def read_files(spark: SparkSession, path: str, ending: str = "ya?ml|json") -> DataFrame:
    """path, content and sha256 of the catalog files below a folder; those that aren't YAML by their name are JSON."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(F.col("path").rlike(rf"\.({ending})$")).select("path", "content", F.sha2("content", 256).alias("hash"))


def load(spark: SparkSession, path: str, known: DataFrame | None = None, ending: str = "ya?ml|json") -> DataFrame:
    """The patterns of all files, one row each; files whose hash is known (a column, hash) are left out.

    A pattern without a confidence has .7; without a type that of its section. Files are parsed where they are read.
    """
    files = read_files(spark, path, ending)
    if known is not None:
        files = files.join(known.select("hash"), "hash", "left_anti").select("path", "content", "hash")

    def parse(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for p, raw, h in zip(f["path"], f["content"], f["hash"], strict=True):
                content = _loaded(p, bytes(raw))
                meta = content.get("metadata") if isinstance(content, dict) else None
                meta = meta if isinstance(meta, dict) else {}
                stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                kind = str(meta.get("pattern_type") or "unknown")
                for section, name, x in _found(content):
                    types = x.get("entity_types") or x.get("entity_type") or section
                    rows.append((stem, h, section, name, str(x["pattern"]), float(x.get("confidence", 0.7)), _texts(types)[0].upper(), str(meta.get("jurisdiction") or "all"), str(meta.get("court_level") or ""), kind if kind != "unknown" else stem, str(x.get("description") or ""), _texts(x.get("examples")), _texts(x.get("dependencies"))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PATTERNS.split(", ")])

    return files.mapInPandas(parse, PATTERNS)


def load_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relationship patterns; the category is the file's name unless stated."""

    def parse(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for p, raw in zip(f["path"], f["content"], strict=True):
                stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                content = _loaded(p, bytes(raw))
                items = content.get("relationships", content) if isinstance(content, dict) else content
                items = items.values() if isinstance(items, dict) else items or []
                for x in items:
                    if isinstance(x, dict) and "relationship_type" in x:
                        rows.append((stem, str(x.get("category") or stem), str(x["relationship_type"]), str(x.get("source_entity") or ""), str(x.get("target_entity") or ""), _texts(x.get("indicators")), _texts(x.get("examples")), float(x.get("confidence", 0.8)), bool(x.get("bidirectional", False)), str(x.get("description") or "")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RELATIONS.split(", ")])

    return read_files(spark, path).mapInPandas(parse, RELATIONS)


def relation_categories(relations: DataFrame) -> DataFrame:
    return relations.groupBy("category").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("relationship_type")).alias("types"), F.count_if("bidirectional").alias("bidirectional"), F.round(F.avg(F.size("indicators")), 2).alias("mean_indicators"))


def file_hash(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) of a JSON file that maps raw types to canonical ones under entity_type_mappings."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "entity_type_mappings map<string,string>").alias("x"))
    return raw.select(F.explode("x.entity_type_mappings").alias("alias", "canonical"))
