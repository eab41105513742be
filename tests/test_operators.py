"""Operators on small cases whose answers are known."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import records, text
from caseloom.functions.spans import spans
from caseloom.operators import chunking, graph, metrics, relations, resolving, sizing
from caseloom.sources import patterns, stores

MENTION = "doc_id long, start int, stop int, entity_type string, text string, confidence double, source string, rank int, name string"


def found(spark, *rows):
    return spark.createDataFrame([(1, a, b, t, x, c, s, n, f"p{n}") for n, (a, b, t, x, c, s) in enumerate(rows)], MENTION)


def one(df):
    return df.first()[0]


def test_size_ladder_and_edges(spark):
    sizes = [0, 3, 49, 50, 5000, 5001, 20000, 20001, 50000, 50001, 150000, 150001]
    docs = spark.createDataFrame([(n, "x" * n) for n in sizes], "doc_id long, text string")
    got = {r.doc_id: (r.size_category, r.strategy) for r in sizing.route(docs).collect()}
    assert got[0][1] == "empty_document" and got[3][1] == got[49][1] == "too_small" and got[50][1] == got[5000][1] == "single_pass"
    assert got[5001] == ("small", "three_wave") and got[20000][1] == "three_wave" and got[20001][1] == "four_wave"
    assert [got[n][0] for n in (50000, 50001, 150000, 150001)] == ["small", "medium", "medium", "large"]
    big = {r.doc_id: r for r in sizing.route(docs, override="three_wave_chunked").collect()}
    assert big[150001].num_chunks == 37500 // 7500 + 1 and big[150001].strategy == "three_wave_chunked"


@pytest.mark.parametrize("bad, ok", [(40, True), (50, True), (60, False)])
def test_share_of_control_characters(spark, bad, ok):
    docs = spark.createDataFrame([("\x01" * bad + "a" * (1000 - bad) + "\x01" * 500,)], "text string")
    assert one(docs.select(sizing.is_text(F.col("text")))) is ok


def test_spans_are_code_points(spark):
    docs = spark.createDataFrame([("é𝒜日 Ab cd Ef",), ("",), (None,)], "text string")
    got = [[(m.start, m.stop, m.text) for m in r[0] or []] for r in docs.select(spans(F.col("text"), "[A-Z][a-z]")).collect()]
    assert got == [[(4, 6, "Ab"), (10, 12, "Ef")], [], []]


def test_conflicts_look_at_the_one_before_and_fusion_at_any(spark):
    m = found(spark, (0, 20, "A", "long", 0.8, "regex"), (2, 5, "A", "in", 0.9, "model"), (10, 15, "A", "later", 0.95, "regex"), (30, 40, "B", "b", 0.7, "regex"), (30, 40, "C", "b", 0.7, "model"))
    assert sorted(r.text for r in resolving.resolve_conflicts(m).collect()) == ["b", "b", "in", "later"]
    fused = {r.start: r for r in resolving.fuse(m).collect()}
    assert set(fused) == {10, 30} and fused[10].confidence == 0.99 and fused[10].source == "fusion" and fused[30].confidence == pytest.approx(0.77)
    assert {r.start for r in resolving.fuse(m, "intersection").collect()} == {10, 30}
    assert {(r.start, r.text) for r in resolving.fuse(m, "cascade").collect()} == {(10, "later"), (30, "b"), (0, "long")}


def test_merge_with_model_mentions(spark):
    a, b = found(spark, (0, 2, "A", "ab", 0.5, "regex"), (5, 7, "A", "cd", 0.5, "regex")), found(spark, (0, 2, "A", "ab", 0.9, "model"))
    got = {(r.text, round(r.confidence, 3)) for r in resolving.merge_regex_and_model(a, b).collect()}
    assert got == {("ab", 0.9), ("cd", 0.4)}


def test_near_pairs_are_those_of_all_pairs(spark):
    import random

    r = random.Random(5)
    rows = [(a := r.randint(0, 2000), a + r.choice([0, 3, 30, 700]), r.choice("AB"), "x", 0.8, "regex") for _ in range(120)]
    got = {(x.a_rank, x.b_rank, x.distance) for x in relations.near_pairs(found(spark, *rows)).collect()}
    want = set()
    for i, (a, b, *_) in enumerate(rows):
        for j, (c, e, *_) in enumerate(rows):
            if (c, e, j) > (a, b, i) and c - b <= 100:
                want.add((i, j, max(0, c - b)))
    assert got == want


def test_edges(spark):
    e = spark.createDataFrame([(1, 2, "R", 0.9, 1), (1, 2, "R", 0.8, 2), (1, 2, "R", 0.9, 3), (3, 3, "R", 0.9, 1), (1, 9, "R", 0.9, 1), (2, 1, "R", 0.8499, 1), (2, 3, "R", 0.85, 1)], "src long, tgt long, relation string, confidence double, n int")
    merged = {(r.src, r.tgt): (r.confidence, r.merged_count) for r in relations.merge_duplicates(e, ["n"]).collect()}
    assert merged[1, 2] == (1.0, 3) and merged[2, 1] == (0.8499, 1)
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {(r.src, r.tgt) for r in relations.valid_edges(e, ids).collect()} == {(1, 2), (2, 3)}


def test_communities_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 99), (98, 99)], "src long, tgt long")
    got = {r.id: r.community for r in graph.communities(e).collect()}
    assert got == {**{i: 0 for i in range(65)}, 98: 98, 99: 98, 100: 98}


@pytest.mark.parametrize("n", [1, 2, 19, 20, 100])
def test_percentiles_are_places_not_interpolated(spark, n):
    rows = spark.createDataFrame([(float(i),) for i in reversed(range(n))], "ms double")
    got = metrics.ordered_percentiles(rows, [], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    assert (got.p50, got.p95, got.p99) == tuple(float(int(n * p)) for p in (0.5, 0.95, 0.99))


def test_bins_hold_their_lower_edges(spark):
    rows = spark.createDataFrame([(c,) for c in (0.2, 0.4, 0.5, 0.55, 0.6, 0.8, 0.85, 0.9, 1.0)], "c double")
    assert [r.n for r in metrics.histogram(rows, "c", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).orderBy("bin").collect()] == [0, 1, 3, 1, 4]


def test_smoothing_is_the_recursion(spark):
    values = [5.0, 1.0, 7.0, 2.0]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    want = values[0]
    for v in values[1:]:
        want = 0.9 * want + 0.1 * v
    assert metrics.smoothed(rows, "k", ["i"], "v", 0.1).first().smoothed == pytest.approx(want)


def test_text_forms(spark):
    t = spark.createDataFrame([("The  Smith's  Co.",), ("the big, house!",), ("42 USC 1983 and Section 5",), ("U.S.C Ct.",)], "t string")
    assert [r[0] for r in t.select(text.normal(F.col("t"))).collect()][:2] == ["the smith co.", "big house"]
    assert t.select(text.standard_citations(F.col("t"))).collect()[2][0] == "42 U.S.C. § 1983 and § 5"
    assert one(spark.range(1).select(text.jaccard(F.lit("a b  b"), F.lit("B c")))) == pytest.approx(1 / 3)


def test_chunkers_cover_the_text(spark):
    body = "One two three. " * 40 + "\n\nFour five.\n \nSix seven. " + "x" * 300
    docs = spark.createDataFrame([(1, body), (2, ""), (3, "   ")], "doc_id long, text string")
    w = chunking.windows(docs, 100, 20).filter("doc_id = 1").orderBy("chunk").collect()
    assert all(body[r.start : r.stop] == r.content for r in w) and w[-1].stop == len(body) and all(a.stop - b.start == 20 for a, b in zip(w, w[1:]))
    for cut in (chunking.fixed_chunks(docs, 100), chunking.packed_paragraphs(docs, 200), chunking.boundary_chunks(docs, 120, 0, 30, 20)):
        rows = cut.filter("doc_id = 1").orderBy("chunk").collect()
        assert "".join("".join(r.content.split()) for r in rows) == "".join(body.split())
    assert [r.content for r in chunking.pages(spark.createDataFrame([(1, "a\fb\f \fc"), (2, "x\nPage 3\ny"), (3, "p\n- 4 -\nq")], "doc_id long, text string")).orderBy("doc_id", "page").collect()] == ["a", "b", "c", "x", "y", "p", "q"]


@pytest.mark.parametrize("raw, n", [('```json\n{"entities":[{"text":"a","type":"X","confidence":95},],}\n```', 1), ('chat {"results": [{"text": "a", "confidence": NaN}]} bye', 1), ('{"entities": [{"text": "a"}, {"text": "b', 2), ("no json", 0), (None, 0)])
def test_json_is_parsed_or_repaired(spark, raw, n):
    r = records.parse_all(spark.createDataFrame([(raw,)], "raw string"), "raw").select(F.transform(records.entities(F.col("response")), records.standard).alias("e")).first()
    assert len(r.e) == n and all(0 <= e.confidence <= 1 for e in r.e)


def test_pattern_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.yaml").write_text("metadata:\n  pattern_type: court\n  jurisdiction: federal\npatterns:\n  - name: one\n    pattern: 'A+'\n    confidence: 0.9\n    examples: [AA]\n")
    (tmp_path / "b.yml").write_text("courts:\n  supreme:\n    pattern: 'S+'\n    entity_types: [court]\ndependencies: [x]\n")
    (tmp_path / "bad.yaml").write_text("a: [unclosed")
    got = {r.name: r for r in patterns.load(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "supreme"} and got["one"].jurisdiction == "federal" and got["supreme"].entity_type == "COURT" and got["supreme"].confidence == 0.7
    known = patterns.read_files(spark, str(tmp_path)).select("hash")
    assert patterns.load(spark, str(tmp_path), known).count() == 0


def test_stores(spark, tmp_path):
    chunks = spark.createDataFrame([("d1", 0, "a b"), ("d1", 1, "c"), ("d2", 0, "e")], "document_id string, chunk int, content string")
    path = str(tmp_path / "store" / "chunks")
    stores.store_chunks(chunks, path)
    assert [r.chunk_id for r in stores.get_chunks(spark, path, "d1").collect()] == ["d1_chunk_0", "d1_chunk_1"]
    stores.delete_documents(spark.createDataFrame([("d1",)], "id string"), str(tmp_path / "store"))
    assert stores.get_chunks(spark, path, "d1").count() == 0 and stores.get_chunks(spark, path, "d2").count() == 1
    stores.store_chunks(chunks, path, version=1)
    assert stores.get_chunks(spark, path, "d1").count() == 2 and stores.visible(spark, path).count() == 4
    rows = spark.createDataFrame([(1, ["b", "a"])], "id int, variants array<string>")
    stores.export(rows, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().variants == "a|b"
    with pytest.raises(ValueError):
        stores.export(rows, str(tmp_path / "x"), "xml")
    nodes, edges = spark.createDataFrame([(1, "A & B")], "id int, label string"), spark.createDataFrame([(1, 1, "R")], "src int, tgt int, relation string")
    stores.export_graphml(nodes, edges, str(tmp_path / "g"))
    assert "A &amp; B" in "".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
