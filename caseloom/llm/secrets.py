"""Secret scans with a trigram index, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as rc
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import let, running
from .base import load, scratch, text_or_empty


@dataclass(frozen=True)
class Rule:
    """pattern: Java and Python syntax alike. A match stays if its group has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The rules of the base contract, then those that this method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("keyblock", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")
#: Strings that a part of a pattern may stand for, before it counts as any string.
VARIANTS = 64
#: Documents to verify up to which their ids (16 bytes each in memory) are broadcast; beyond, texts are joined by id.
BROADCAST_IDS = 500_000
#: Trigrams of a mask.
MASK_BITS = 62


# --- Boolean trigram queries of a pattern: a set of alternatives, each a set of trigrams that must all occur ---


def _listed(ranges: list[tuple[int, int]]) -> set[str] | None:
    """All members of a class in lower case; None if any isn't ASCII, whose case depends on where it stands."""
    if any(last > 127 for _, last in ranges):
        return None
    return {chr(c).lower() for first, last in ranges for c in range(first, last + 1)}


def _strings(items) -> tuple[set[str] | None, list[frozenset[str]]]:
    """What a parsed sequence matches exactly (None: too much to list), and, if not listed, its alternatives of trigrams.

    All is in lower case, so that one index serves patterns with and without regard to case.
    """
    run, facts = {""}, []

    def close() -> None:
        nonlocal run
        facts.append(_of_strings(run))
        run = {""}

    for op, arg in items:
        exact: set[str] | None = None
        inner: list[frozenset[str]] = [frozenset()]
        if op is rc.LITERAL:
            exact = _listed([(arg, arg)])
        elif op is rc.IN and not any(o is rc.NEGATE or o is rc.CATEGORY for o, _ in arg):
            exact = _listed([(a, a) if o is rc.LITERAL else a for o, a in arg])
        elif op is rc.AT:
            exact = {""}
        elif op is rc.SUBPATTERN:
            exact, inner = _strings(arg[3])
        elif op is rc.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                exact = set().union(*(p[0] for p in parts))
            else:
                inner = [x for p in parts for x in (_of_strings(p[0]) if p[0] is not None else p[1])]
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, body = arg
            one, inside = _strings(body)
            if most == 1 and one is not None:
                exact = one | {""} if least == 0 else one
            elif least >= 1 and one is not None and len(one) == 1 and least <= 64:
                inner = _of_strings({next(iter(one)) * least})
            elif least >= 1 and one is not None:
                inner = _of_strings(one)
            elif least >= 1 and one is None:
                inner = inside
        if exact is not None and len(exact) * len(run) <= VARIANTS:
            run = {a + b for a in run for b in exact}
        else:
            close()
            facts.append(inner if exact is None else [frozenset()])
    if not facts:
        return run, []
    close()
    return None, reduce(_both, facts)


def _of_strings(strings: set[str]) -> list[frozenset[str]]:
    return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    """Alternatives of two facts that both hold; too many: those of the stronger fact alone."""
    if len(a) * len(b) > VARIANTS:
        return max(a, b, key=lambda x: min(map(len, x)))
    every = {x | y for x in a for y in b}
    return [x for x in every if not any(y < x for y in every)]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, in lower case, one of which every match's lower-cased text holds. Empty: none are mandatory."""
    exact, facts = _strings(_parser.parse(pattern))
    facts = _of_strings(exact) if exact is not None else facts
    return sorted(facts, key=sorted) if facts and all(facts) else []


# --- the index ---


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram number, doc_id, row) for each of the trigrams that a row's lower-cased text holds."""
    low = F.lower("text")
    here = F.filter(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(n)) for n, t in enumerate(trigrams)]), lambda x: x.isNotNull())
    return docs.select("doc_id", low.alias("_low")).select("doc_id", F.explode(here).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """doc_id and the numbers of the rules whose query the postings of the id satisfy: an intersection by id, with partial masks.

    A mask holds MASK_BITS trigrams; there are as many masks as the trigrams need.
    """
    place = {t: divmod(n, MASK_BITS) for n, t in enumerate(trigrams)}
    width = -(-len(trigrams) // MASK_BITS)
    masks = index.groupBy("doc_id").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / MASK_BITS) == w, F.expr(f"shiftleft(1L, trigram % {MASK_BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"mask{w}") for w in range(width)])

    def needs(need: frozenset[str]) -> Column:
        bits = [0] * width
        for t in need:
            bits[place[t][0]] |= 1 << place[t][1]
        return reduce(lambda a, b: a & b, [F.col(f"mask{w}").bitwiseAND(F.lit(b)) == F.lit(b) for w, b in enumerate(bits) if b])

    held = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, map(needs, q)), F.lit(rule)) for rule, q in queries.items()]))
    return masks.select("doc_id", held.alias("rules")).filter(F.size("rules") > 0)


# --- verification ---


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """A rule's constants, and its matches as pairs of (piece before, match, asked group) lengths; null where there is none."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    asked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    both = F.zip_with(whole, asked, lambda w, a: F.struct(F.length(w).alias("w"), F.length(a).alias("a")))
    # one more piece than matches: the last pair has no match
    steps = F.zip_with(both, F.split(text, pattern, -1), lambda x, p: F.struct(F.length(p).alias("p"), F.coalesce(x["w"], F.lit(0)).alias("w"), x["a"].alias("a")))
    return F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), F.when(F.rlike(text, pattern), steps).alias("steps"))


def found(rules: list[Column]) -> Column:
    """Of `matches` of all rules the spans that stay: array of (start, rank, stop, kind) by start and rank, in code points.

    A match's start is the length of all pieces between matches, and of all matches, before it: a running sum.
    """

    def spans(r: Column) -> Column:
        one = lambda x, at: F.struct((at + x["p"]).alias("start"), r["rank"].alias("rank"), (at + x["p"] + x["w"]).alias("stop"), r["kind"].alias("kind"), x["a"].alias("a"))
        placed = let(r["steps"], lambda all_: F.slice(F.zip_with(all_, running(F.transform(all_, lambda x: x["p"] + x["w"])), one), 1, F.size(all_) - 1))
        return F.transform(F.filter(placed, lambda m: m["a"] >= r["least"]), lambda m: F.struct(*[m[c].alias(c) for c in ("start", "rank", "stop", "kind")]))

    hits = F.filter(F.array(*rules), lambda r: r["steps"].isNotNull())
    return F.array_sort(F.flatten(F.transform(hits, spans)))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of start, rank, stop, kind, by start and rank) of each row of docs (doc_id, text).

    Patterns mean what they mean in Java, whose (?i) is about ASCII letters. Rules with mandatory trigrams are verified
    on the rows that the index gives, the others on every row; there may be any number of rules. Each row has its own
    result: repeated rows have equal ones, and an id that several rows share is a candidate in all of them. Null and
    empty texts have no spans; null ids are always verified; an empty table gives an empty one; texts are searched whole,
    at a cost that grows with their length; other columns of docs, whatever their names, are neither read nor returned.
    """
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for need in q for t in need})
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    if not queries:
        return docs.select("doc_id", found([matches(F.col("text"), r, n) for n, r in enumerate(rules)]).alias("spans"))
    some = scratch(candidates(postings(docs, trigrams), queries, trigrams), "candidates").withColumnRenamed("doc_id", "_id")
    if some.count() <= BROADCAST_IDS:
        some = F.broadcast(some)
    joined = docs.join(some, docs["doc_id"] == some["_id"], "left")
    asked = lambda n: F.when(F.array_contains("rules", n) | F.col("doc_id").isNull(), F.col("text")) if n in queries else F.col("text")
    return joined.select("doc_id", found([matches(asked(n), r, n) for n, r in enumerate(rules)]).alias("spans"))


def op4_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_secrets(load(spark, sf_dir, "documents"))
    told = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return spans.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    select doc_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'start': (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))::bigint,
        'rank': {rank}, 'len': length(w[i]), 'got': length(a[i]), 'kind': '{kind}'}}), lambda m: m.got >= {least}) as spans
    from (select doc_id, regexp_extract_all(t, '{quoted}', 0) as w, regexp_extract_all(t, '{quoted}', {group}) as a, string_split_regex(t, '{quoted}') as p from d)"""


def _oracle() -> str:
    parts = [f"s{n} as ({_sql_spans(r.kind, n, r.pattern, r.group, r.least)})" for n, r in enumerate(RULES)]
    told = "list_aggregate(list_transform({0}, lambda m: m.kind || ':' || m.start || ':' || (m.start + m.len)), 'string_agg', ',')"
    joins = " ".join(f"join s{n} using (doc_id)" for n in range(1, len(RULES)))
    every = "list_sort(list_concat(" + ", ".join(f"s{n}.spans" for n in range(len(RULES))) + "))"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), {', '.join(parts)}, j as (select doc_id, {every} as spans from s0 {joins})
    select doc_id, {', '.join(f"len(list_filter(spans, lambda m: m.kind = '{k}')) as n_{k}" for k in BASE_KINDS)},
    sha256(coalesce({told.format("list_filter(spans, lambda m: m.kind in ('assign', 'access', 'hex'))")}, '')) as base_sha256, coalesce({told.format('spans')}, '') as spans from j"""


OP4_SQL = _oracle()
