"""JSON from models, records in one schema, and what is wrong with them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ENTITY = "struct<entity_id:string,entity_type:string,type:string,text:string,value:string,confidence:double,confidence_score:double,start_pos:int,start:int,end_pos:int,end:int>"
RESPONSE = f"struct<entities:array<{ENTITY}>,extracted_entities:array<{ENTITY}>,results:array<{ENTITY}>>"
#: Failures by the first word list that an error's text holds.
FAILURES = (
    ("connection_error", ("connection", "refused", "unreachable")), ("timeout", ("timeout", "timed out")), ("rate_limit", ("rate limit", "429", "too many")),
    ("context_overflow", ("context", "token limit", "too long")), ("server_error", ("500", "502", "503", "504")), ("memory_error", ("memory", "oom", "cuda")),
)


def bare_json(raw: Column) -> Column:
    """What stands between the first brace and the last, without code fences, control characters or trailing commas; NaN is null."""
    t = F.regexp_replace(raw, r"```(?:json)?", "")
    t = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    t = F.regexp_replace(t, r",\s*([}\]])", "$1")
    t = F.regexp_replace(t, r":\s*NaN\b", ": null")
    return F.regexp_replace(t, r":\s*-?Infinity\b", ": 999999")


def parsed(raw: Column) -> Column:
    """Response struct of a model's answer; null where it is no JSON or holds no list of entities."""
    r = F.from_json(bare_json(raw), RESPONSE)
    return F.when(F.coalesce(r["entities"], r["extracted_entities"], r["results"]).isNotNull(), r)


def entities(response: Column) -> Column:
    return F.coalesce(response["entities"], response["extracted_entities"], response["results"], F.array().cast(f"array<{ENTITY}>"))


def standard(e: Column) -> Column:
    """An entity under its standard names: confidences over 1 are percent, under 0 are 0, at most 1."""
    c = F.coalesce(e["confidence"], e["confidence_score"], F.lit(0.5))
    c = F.when(c > 1, c / 100).when(c < 0, 0.0).otherwise(c)
    start = F.coalesce(e["start_pos"], e["start"], F.lit(0))
    text = F.coalesce(e["text"], e["value"], F.lit(""))
    kind = F.upper(F.coalesce(e["entity_type"], e["type"], F.lit("UNKNOWN")))
    return F.struct(
        F.coalesce(e["entity_id"], F.concat(kind, F.lit("_"), F.substring(F.md5(F.concat_ws(":", kind, text)), 1, 8))).alias("entity_id"), kind.alias("entity_type"), text.alias("text"),
        F.least(F.lit(1.0), c).alias("confidence"), start.alias("start_pos"), F.coalesce(e["end_pos"], e["end"], start + F.length(text)).alias("end_pos"),
    )


def legacy(e: Column) -> Column:
    """A standard entity under its former names."""
    return F.struct(e["entity_id"].alias("id"), e["entity_type"].alias("type"), e["text"].alias("text"), e["confidence"].alias("confidence"), e["start_pos"].alias("start"), e["end_pos"].alias("end"))


def issues(e: Column) -> Column:
    """Names of what is wrong with a standard entity."""
    return F.array_compact(F.array(
        F.when(F.trim(e["text"]) == "", "empty_text"), F.when(e["start_pos"] < 0, "negative_start"), F.when(e["end_pos"] < e["start_pos"], "end_before_start"),
        F.when(~e["confidence"].between(0, 1), "confidence"), F.when(F.length(e["text"]) != e["end_pos"] - e["start_pos"], "length"),
    ))


def fixed(e: Column) -> Column:
    """A standard entity with confidence and positions clamped, and UNKNOWN for a blank text or type."""
    start = F.greatest(F.lit(0), e["start_pos"])
    return F.struct(
        e["entity_id"].alias("entity_id"), F.when(F.trim(e["entity_type"]) == "", "UNKNOWN").otherwise(e["entity_type"]).alias("entity_type"), F.when(F.trim(e["text"]) == "", "UNKNOWN").otherwise(e["text"]).alias("text"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), e["confidence"])).alias("confidence"), start.alias("start_pos"), F.greatest(start, e["end_pos"]).alias("end_pos"),
    )


def shifted(e: Column, offset: Column) -> Column:
    """A chunk's entity at its place in the document."""
    return e.withField("start_pos", e["start_pos"] + offset).withField("end_pos", e["end_pos"] + offset)


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def failure(error: Column, response: Column) -> Column:
    low, out = F.lower(error), None
    for name, words in FAILURES:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(F.trim(response) == "", "empty_response").when(response.isNotNull() & F.from_json(response, "map<string,string>").isNull(), "malformed_response").otherwise("server_error")


@F.pandas_udf(StringType())
def repaired(raw: pd.Series) -> pd.Series:
    """JSON text closed and quoted where it broke off, for answers that the column functions can't parse; null if nothing helps."""

    def one(t: str | None) -> str | None:
        t = re.sub(r"```(?:json)?", "", t or "")
        at = t.find("{")
        if at < 0:
            return None
        t, stack, text, escaped = t[at:], [], False, False
        for c in t:
            if text:
                escaped = c == "\\" and not escaped
                text = c != '"' or escaped
                escaped = escaped and c == "\\"
            elif c == '"':
                text = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack and stack[-1] == c:
                stack.pop()
        t = t + '"' * text
        t = re.sub(r",\s*$", "", t) + "".join(reversed(stack))
        t = re.sub(r",\s*([}\]])", r"\1", re.sub(r"\bNaN\b", "null", t))
        t = re.sub(r'("\s*)\n(\s*")', r"\1,\n\2", t)
        try:
            return json.dumps(json.loads(t))
        except ValueError:
            found = re.findall(r'\{[^{}]*"text"\s*:\s*"[^"]*"[^{}]*\}', t)
            good = []
            for x in found:
                try:
                    good.append(json.loads(x))
                except ValueError:
                    pass
            return json.dumps({"entities": good}) if good else None

    return raw.map(one)


def parse_all(rows: DataFrame, raw: str) -> DataFrame:
    """rows with `response`: by column functions where they can, by repair in Python for the rest alone."""
    first = rows.withColumn("response", parsed(F.col(raw)))
    rest = rows.filter(parsed(F.col(raw)).isNull()).withColumn("response", F.from_json(repaired(F.col(raw)), RESPONSE))
    return first.filter("response is not null").unionByName(rest)
