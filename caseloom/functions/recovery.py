"""Recovery of broken JSON in column functions: each step is linear and needs no parser; and checks of what came out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

RELATION = "struct<source_entity_id:string,target_entity_id:string,relationship_type:string,confidence:double,evidence:string>"
REQUIRED, FORBIDDEN = ("entity_type", "text", "confidence", "start_pos", "end_pos"), ("type", "start", "end")
RELATION_REQUIRED = ("source_entity_id", "target_entity_id", "relationship_type", "confidence", "evidence")


def numbers_fixed(json: Column) -> Column:
    """Confidences over 1 as hundredths, NaN as null, Infinity as 999999."""
    p = r'"confidence":\s*\d+\.?\d*'
    value = lambda m: F.regexp_extract(m, r"(\d+\.?\d*)$", 1).try_cast("double")
    fixed = F.transform(F.regexp_extract_all(json, F.lit(p), F.lit(0)), lambda m: F.when(value(m) > 1, F.concat(F.lit('"confidence": '), F.round(value(m) / 100, 6).cast("string"))).otherwise(m))
    both = F.zip_with(F.split(json, p, -1), fixed, lambda x, m: F.concat(x, F.coalesce(m, F.lit(""))))
    t = F.array_join(both, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\bNaN\b", "null"), r"-Infinity\b", "-999999"), r"\bInfinity\b", "999999")


def quotes_escaped(json: Column) -> Column:
    """A backslash before each quote that neither opens nor closes a key or a value, by what stands before and after it."""

    def joined(parts: Column) -> Column:
        def glued(x: Column, i: Column) -> Column:
            before = F.get(parts, i - 1)
            opens = F.rlike(before, F.lit(r"[{\[,:]\s*\z"))
            closes = F.rlike(x, F.lit(r"\A[,}\]:\s]")) | ((x == "") & (i == F.size(parts) - 1))
            own = F.endswith(before, F.lit("\\"))
            return F.when(i == 0, x).when(opens | closes | own, F.concat(F.lit('"'), x)).otherwise(F.concat(F.lit('\\"'), x))

        return F.array_join(F.transform(parts, glued), "")

    return let(F.split(json, '"', -1), joined)


def structure_fixed(json: Column) -> Column:
    """No trailing commas, commas between elements of lines, brackets and braces closed."""
    t = F.regexp_replace(json, r",(\s*[}\]])", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r'"\s*\n\s*"', '",\n"'), r"\}\s*\n\s*\{", "},\n{")
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    more = lambda x, a, b: F.repeat(F.lit(b), F.greatest(count(x, a) - count(x, b), F.lit(0)))
    return let(t, lambda x: F.concat(x, more(x, "{", "}"), more(x, "[", "]")))


def cleaned_up(json: Column) -> Column:
    """No control characters but line ends and tabs, an even number of quotes, braces at both ends."""
    t = F.regexp_replace(json, r"[\x00-\x08\x0b-\x1f]", "")
    count = lambda x, c: (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))) / len(c)
    t = let(t, lambda x: F.when((count(x, '"') - count(x, '\\"')) % 2 != 0, F.concat(x, F.lit('"'))).otherwise(x))
    t = let(F.regexp_replace(t, r"^\s+|\s+$", ""), lambda x: F.when(F.startswith(x, F.lit("{")), x).otherwise(F.concat(F.lit("{"), x)))
    return let(t, lambda x: F.when(F.endswith(x, F.lit("}")), x).otherwise(F.concat(x, F.lit("}"))))


def has_keys(json: Column, keys: tuple[str, ...]) -> Column:
    """Whether an object holds all keys; false for what is no object."""
    found = F.json_object_keys(json)
    return F.coalesce(F.size(F.array_intersect(found, F.array(*map(F.lit, keys)))) == len(keys), F.lit(False))


def salvaged_relations(text: Column) -> Column:
    """Relationship objects (flat ones that name both ends) found anywhere in a text."""
    found = F.regexp_extract_all(text, F.lit(r'\{[^{}]*"source_entity_id"[^{}]*"target_entity_id"[^{}]*\}'), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.from_json(x, RELATION)), lambda r: r["source_entity_id"].isNotNull() & r["target_entity_id"].isNotNull())


def section_items(text: Column, name: str) -> Column:
    """The list under a name, as text, wherever it stands; null without one."""
    found = F.regexp_extract(text, rf'(?s)"{name}"\s*:\s*\[(.*?)\]', 1)
    return F.when(F.rlike(text, F.lit(rf'(?s)"{name}"\s*:\s*\[(.*?)\]')), F.concat(F.lit("["), found, F.lit("]")))


def stated_confidence(text: Column) -> Column:
    """The first confidence or confidence_score in a text, over 1 as hundredths."""
    c = F.regexp_extract(text, r'"confidence(?:_score)?"\s*:\s*([0-9.]+)', 1).try_cast("double")
    return F.when(c > 1, c / 100).otherwise(c)


def entity_errors(e: Column) -> Column:
    """Names of what is wrong with an entity (a map of strings): forbidden or missing keys, a confidence or positions out of range."""
    number = lambda k: e[k].try_cast("double")
    whole = lambda k: e[k].try_cast("int")
    wrong = [F.when(F.map_contains_key(e, k), F.lit(f"forbidden:{k}")) for k in FORBIDDEN] + [F.when(~F.map_contains_key(e, k), F.lit(f"missing:{k}")) for k in REQUIRED]
    wrong += [F.when(F.map_contains_key(e, "confidence") & ~F.coalesce(number("confidence").between(0, 1), F.lit(False)), F.lit("confidence"))]
    wrong += [F.when(F.map_contains_key(e, k) & ~F.coalesce(whole(k) >= 0, F.lit(False)), F.lit(k)) for k in ("start_pos", "end_pos")]
    return F.array_compact(F.array(*wrong, F.when(whole("end_pos") < whole("start_pos"), F.lit("order"))))


def relation_errors(r: Column) -> Column:
    """Names of what is wrong with a relationship (a map of strings)."""
    c = r["confidence"].try_cast("double")
    wrong = [F.when(~F.map_contains_key(r, k), F.lit(f"missing:{k}")) for k in RELATION_REQUIRED]
    wrong += [F.when(F.map_contains_key(r, "confidence") & ~F.coalesce(c.between(0, 1), F.lit(False)), F.lit("confidence"))]
    return F.array_compact(F.array(*wrong, *[F.when(F.trim(r[k]) == "", F.lit(f"empty:{k}")) for k in ("source_entity_id", "target_entity_id", "evidence")]))
