"""Each stage of the pipeline against a plain version of what it must decide."""

import re

import corpus_pipeline as cp
from caseloom.llm import base, toxicity
from tests.llm.test_operators import brute_near, learned, plain_toxicity

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_cut(text: str | None, items: list[str | None]) -> str | None:
    """The text without the windows of ten words, or whole shorter items, that it shares with items; None if half of it is such."""
    low = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    raw, found = (text or "").encode(), list(WORD.finditer(low(text)))
    words, hit = [m[0] for m in found], set()
    for item in items:
        own = WORD.findall(low(item))
        k = min(10, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
    if not hit:
        return text
    if 2 * len(hit) >= len(words):
        return None
    out, at, n = [], 0, 0
    while n < len(words):
        if n in hit:
            last = n
            while last + 1 in hit:
                last += 1
            out.append(raw[at : found[n].start()])
            at, n = found[last].end(), last
        n += 1
    return b"".join([*out, raw[at:]]).decode()


def table(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_decide_as_a_plain_version(spark, tables):
    docs = base.load(spark, tables, "documents")
    model = learned(spark, tables, "toxic", toxicity)
    want = {r.doc_id for r in docs.collect() if plain_toxicity(model, r.text) < 0.5}
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in cp.STAGES[:-1]:
        before = table(docs)
        docs = base.scratch(stage(spark, docs, tables), name)
        after = table(docs)
        assert docs.columns == base.load(spark, tables, "documents").columns
        if name == "toxicity":
            assert set(after) == want
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub("[ \t-\r]+", " ", before[i].text or ""), i)
            assert set(after) == set(first.values())
        elif name == "near_dedup":
            assert set(after) == set(brute_near({i: r.text for i, r in before.items()}, 5).values())
        else:
            items = [r.text for r in base.load(spark, tables, "benchmark").collect()]
            cut = {i: plain_cut(r.text, items) for i, r in before.items()}
            assert {i: r.text for i, r in after.items()} == {i: t for i, t in cut.items() if t is not None or before[i].text is None}
            assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
        if name != "decontamination":
            assert all(after[i] == before[i] for i in after)
    packed = cp.STAGES[-1][1](spark, docs, tables)
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_run_on_empty_tables(spark, empty):
    assert cp.run(spark, empty).count() == 0


def test_run_leaves_only_its_last_table(spark, tables):
    since = base.opened()
    packed = cp.run(spark, tables)
    assert base.opened() == since + 1 and packed.count() > 0
