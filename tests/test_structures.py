"""Operators on texts and logs against plain versions that walk them one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions import recovery as R
from caseloom.functions.spans import running, spans
from caseloom.operators import catalog, chunking, matching, metrics, relations, similar, smart, windows

LAW = [
    "ARTICLE I\nThe parties agree.\n\nSECTION 2 Terms\n" + "word " * 60 + "\n\n" + "more " * 70 + "\n(a) first\n(b) second \"a quoted passage\nover lines\" end\nWHEREAS it is so.",
    "No markers here.\n\nSecond paragraph! Third?\n \nLast one.", "one", "  \n\n ", "x" * 500, "1. Title\n" + "\n\n".join("p%d " % k * 20 for k in range(12)),
    "See 12 Foo 34 and Smith v. Jones at § 5.1. " * 8 + "\n'single quoted words' here\n" + "line\n" * 90,
]


def texts(spark, t):
    return spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")


def test_spans_and_running_sums(spark):
    r = random.Random(1)
    t = ["", "aaa", "x12y", "12", "é12 " * 500, "𝒜1 " * 130, " ".join(str(r.randint(0, 10**6)) for _ in range(64)), " ".join(str(r.randint(0, 10**6)) for _ in range(65))]
    got = {x.doc_id: [tuple(s) for s in x.s] for x in texts(spark, t).select("doc_id", spans(F.col("text"), "[0-9]+").alias("s")).collect()}
    assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", x)] for i, x in enumerate(t)}
    numbers = spark.createDataFrame([([],), ([3],), (list(range(200)),)], "n array<int>")
    assert [x.s for x in numbers.select(running(F.col("n")).alias("s")).collect()] == [[], [0], [sum(range(k)) for k in range(200)]]


def packed(sizes, most, must=None, inside=None, least=0):
    firsts, size = [], 0
    for i, n in enumerate(sizes):
        if i == 0 or must and must[i] and size > least or size + n > most and not (inside and inside[i]):
            firsts.append(i)
            size = 0
        size += n
    return [(a, b) for a, b in zip(firsts, [*firsts[1:], len(sizes)], strict=False)]


def plain_paragraphs(t, most):
    p = re.split(r"\n\s*\n", t)
    sizes = [len(x) + 2 * (i < len(p) - 1) for i, x in enumerate(p)]
    return [(sum(sizes[:a]), "\n\n".join(p[a:b])) for a, b in packed(sizes, most)]


def plain_legal(t, least, most):
    marks, held = re.compile(smart.SECTION), [m.span() for p in (smart.CITATION, smart.QUOTE) for m in re.finditer(p, t)]
    lines = t.split("\n")
    whole = [x + "\n" * (i < len(lines) - 1) for i, x in enumerate(lines)]
    at = [sum(map(len, whole[:i])) for i in range(len(whole))]
    groups = packed(list(map(len, whole)), most, [bool(marks.search(x)) for x in lines], [any(a <= x < b for a, b in held) for x in at], least)
    return [(at[a], "".join(whole[a:b])) for a, b in groups]


def plain_sections(t, most):
    found = list(re.finditer(smart.SECTION, t))
    if not found:
        return plain_paragraphs(t, most)
    out = []
    for m, end in zip(found, [*(x.start() for x in found[1:]), len(t)], strict=True):
        own = t[m.start() : end].strip()
        if len(own) <= most:
            out.append((m.start(), own))
            continue
        p, at = re.split(r"\n\s*\n", own), m.start()
        for a, b in packed(list(map(len, p)), most):
            part = "\n\n".join(p[a:b])
            out.append((at, part))
            at += len(part) + 2
    return out


def plain_sentences(t, most):
    s = [(m.start() + len(m[0]) - len(m[0].lstrip()), m[0].strip()) for m in re.finditer(r"[^.!?]+[.!?]*\s*", t)]
    s = [x for x in s if x[1]]
    return [(s[a][0], " ".join(x for _, x in s[a:b])) for a, b in packed([len(x) for _, x in s], most)]


@pytest.mark.parametrize("how", ["paragraph", "legal", "section", "sentence"])
def test_chunks_are_packed_as_by_hand(spark, how):
    most, least = 200, 40
    plain = {"paragraph": lambda t: plain_paragraphs(t, most), "legal": lambda t: plain_legal(t, least, most), "section": lambda t: plain_sections(t, most), "sentence": lambda t: plain_sentences(t, most)}[how]
    rows = smart.chunked(texts(spark, LAW), how, least, most).orderBy("doc_id", "chunk").collect()
    got = {i: [(r.start, r.content) for r in rows if r.doc_id == i] for i in range(len(LAW))}
    assert got == {i: plain(t) for i, t in enumerate(LAW)}


def test_adaptive_chunks_follow_the_kind_of_text(spark):
    t = ["This agreement between the parties: whereas obligations. " * 4, "The opinion of the circuit: affirm and remand the judgment. " * 4, "The plaintiff's motion and memorandum of argument. " * 4, "plain words. " * 20]
    assert [r.how for r in texts(spark, t).select("doc_id", smart.strategy(F.col("text")).alias("how")).orderBy("doc_id").collect()] == ["section", "legal", "paragraph", "sentence"]


def test_smart_chunks_overlap_up_to_white_space(spark):
    t = " ".join(f"word{k}" for k in range(3000))
    rows = smart.smart(texts(spark, [t, "short"]), 1000, 100, 900, 60).orderBy("chunk").collect()
    assert {r.doc_id for r in rows} == {0} and len(rows) == -(-len(t) // 900)
    for r in rows:
        assert r.content == t[r.start : r.stop].strip() and (r.start == 0 or t[r.start] == " ") and (r.stop == len(t) or t[r.stop] == " ")
        assert r.chunk == 0 or r.start <= r.chunk * 900 - 60


def test_windows_are_slices(spark):
    t = ["", "a" * 5, "é𝒜b" * 100, "x" * 1000]
    for size, overlap in ((50, 0), (50, 10), (30, 25)):
        rows = chunking.windows(texts(spark, t), size, overlap).collect()
        for r in rows:
            assert r.content == t[r.doc_id][r.start : r.stop] and r.start == r.chunk * (size - overlap)
        assert {r.doc_id: r.stop for r in sorted(rows, key=lambda r: r.stop)} == {i: len(x) for i, x in enumerate(t) if x}


def test_percentiles_are_places_in_order(spark):
    r = random.Random(3)
    groups = {n: [float(r.choice([1, 1, 1, 2, 5, r.random() * 100])) for _ in range(n)] for n in (1, 2, 19, 20, 100, 700)}
    rows = spark.createDataFrame([(n, v) for n, own in groups.items() for v in own], "g int, v double")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {x.g: (x.p50, x.p95, x.p99) for x in metrics.ordered_percentiles(rows, ["g"], "v", shares).collect()}
    assert got == {n: tuple(sorted(own)[int(n * s)] for s in shares.values()) for n, own in groups.items()}
    every = sorted(v for own in groups.values() for v in own)
    assert metrics.ordered_percentiles(rows, [], "v", shares).first() == tuple(every[int(len(every) * s)] for s in shares.values())


def test_most_alike_loses_no_pair(spark):
    r = random.Random(4)
    word = lambda: r.choice("abcdefghijklmnop")
    a, b = ([" ".join(word() for _ in range(r.randint(0, 12))) for _ in range(40)] for _ in range(2))
    alike = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    left, right = spark.createDataFrame(list(enumerate(a)), "id long, text string"), spark.createDataFrame(list(enumerate(b)), "other long, text string")
    for t in (0.05, 0.5):
        got = {x.id: (x.other, round(x.similarity, 9)) for x in similar.most_alike(left, right, t).collect()}
        want = {}
        for i, x in enumerate(a):
            scored = [(-alike(x, y), j) for j, y in enumerate(b) if x and y and alike(x, y) >= t]
            if scored:
                s, j = min(scored)
                want[i] = (j, round(-s, 9))
        assert got == want


def test_nearest_mentions(spark):
    r = random.Random(6)
    m = [(d, k, s := r.randint(0, 3000), s + r.randint(1, 700)) for d in (1, 2) for k in range(40)]
    rows = spark.createDataFrame(m, "doc_id long, rank int, start int, stop int")
    got = {(x.doc_id, x.t_rank, x.k): (x["rank"], x.distance) for x in relations.nearest(rows, 500, 5).collect()}
    want = {}
    for d, k, a, b in m:
        near = sorted((max(0, max(a, x) - min(b, y)), x, o) for e, o, x, y in m if e == d and o != k and max(0, max(a, x) - min(b, y)) <= 500)
        want |= {(d, k, n): (o, g) for n, (g, _, o) in enumerate(near[:5], 1)}
    assert got == want


def test_matches_may_be_limited(spark):
    t = texts(spark, ["abc@x.org " * 30])
    assert matching.mentions(t, most=None).filter("rank = 2").count() == 30 and matching.mentions(t, most=7).filter("rank = 2").count() == 7


def test_sections_and_paragraphs_have_true_places(spark):
    t = ["intro words\n\nII. FACTS AND LAW\nbody one\nbody two\nCLAIMS:\n\nSECTION 4\nlast", "no headers"]
    got = [(r.doc_id, r.title, t[r.doc_id][r.start : r.stop]) for r in windows.sections(texts(spark, t)).orderBy("doc_id", "i").collect()]
    assert got == [(0, "Introduction", "intro words\n"), (0, "II. FACTS AND LAW", "body one\nbody two"), (0, "SECTION 4", "last"), (1, "Introduction", "no headers")]
    p = [(r.doc_id, t[r.doc_id][r.start : r.stop]) for r in windows.paragraphs(texts(spark, t)).orderBy("doc_id", "i").collect()]
    assert p == [(0, "intro words"), (0, "II. FACTS AND LAW\nbody one\nbody two\nCLAIMS:"), (0, "SECTION 4\nlast"), (1, "no headers")]


def test_broken_json(spark):
    one = lambda f, t: texts(spark, [t]).select(f(F.col("text")).alias("t")).first().t
    assert one(R.numbers_fixed, '{"confidence": 95, "x": NaN, "confidence": 0.5}') == '{"confidence": 0.95, "x": null, "confidence": 0.5}'
    assert one(R.quotes_escaped, '{"a": "he said "no" twice", "b": 1}') == '{"a": "he said \\"no" twice", "b": 1}'
    assert one(R.quotes_escaped, '{"a": "x"y"z"}') == '{"a": "x\\"y\\"z"}'
    assert one(R.structure_fixed, '{"a": [1, 2,], "b": {"c": 1') == '{"a": [1, 2], "b": {"c": 1}}'
    assert one(R.cleaned_up, ' "a": "b\x01') == '{"a": "b"}'
    assert one(lambda c: R.has_keys(c, ("a",)), "no json") is False


def test_rules_on_numbers(spark):
    t = ["A v. B", "Brown v. Board, 99999999999999999999 U.S. 5 (1954)", "Brown v. Board, 5 U.S. 5 (1400)", "Brown v. Board, 5 U.S. 5", "Brown v. Board, 700 U.S. 1200 (3000)"]
    got = {r.doc_id: round(r.s, 6) for r in catalog.grouped_matches(texts(spark, t)).withColumn("s", catalog.rule_score()).collect()}
    assert got == {1: 0.7, 2: 0.5, 3: 1.0, 4: round(0.5 * 0.7 * 0.8, 6)}
