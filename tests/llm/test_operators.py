"""Each operator on a table of odd cases, against SQL, a brute-force version, or a round trip."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from caseloom.llm import context_tree, decontamination, exact_dedup, near_dedup, packing, quality, secrets, sharding, toxicity, warc
from caseloom.llm.queries import oracle_sql, queries

SPACE = re.compile("[ \t-\r]+")


def documents(spark, d):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, tables, same_as_sql, name):
    if name != "pipeline":
        same_as_sql(queries()[name](spark, tables), oracle_sql()[name], tables)


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in queries() if n != "op8_arc_to_warc"))
def test_one_row_for_each_document(spark, tables, name):
    rows = queries()[name](spark, tables).select("doc_id").collect()
    assert {r.doc_id for r in rows} == set(documents(spark, tables))
    if name != "op9_hilbert_packing":
        assert len(rows) == len(documents(spark, tables))


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (6, "x y")], "doc_id long, text string")
    assert sharding.assign_shards(docs, 2).count() == 5
    groups = exact_dedup.exact_groups(docs).collect()
    assert len(groups) == 5 and sum(r.kept for r in groups) == 3
    assert {r.keep_id for r in groups if r.text_sha256 == hashlib.sha256(b"a b c").hexdigest()} == {5}
    assert exact_dedup.drop_exact_copies(docs).count() == 3
    assert secrets.find_secrets(docs).count() == 5
    near = near_dedup.near_groups(docs, 2).collect()
    assert len(near) == 5 and all(r.kept for r in near)
    benchmark = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert sum(bool(r._items) for r in decontamination.find_passages(docs, benchmark).collect()) == 3
    assert packing.pack_documents(docs, packing.default_tokenizer()).count() == 5
    scored, n, v = context_tree.score_texts(docs, docs["doc_id"].isNotNull())
    assert scored.count() == 5 and (n, v) == (2 * 4 + 3, 6)
    model = toxicity.train(pa.array(["a bad word here"] * 3 + ["a good text"] * 3), np.array([1.0] * 3 + [0.0] * 3), 0.0)
    assert toxicity.score_documents(docs, model).count() == 5
    net = quality.train(pa.array(["a fine text of words"] * 3 + ["%%% $$$ ###"] * 3), np.array([1.0] * 3 + [0.0] * 3), 0.0)
    assert quality.score_documents(docs, net).count() == 5


# --- 1 ---


def brute_tree(texts: dict[int, str], training: set[int]) -> dict[int, float]:
    depth, counts = context_tree.DEPTH, collections.defaultdict(lambda: [0, 0])

    def steps(text):
        data = b"\n" * depth + context_tree.canonical((text or "").encode())
        for j in range(depth, len(data)):
            for bit in range(8):
                yield [(data[j - d : j], bit, data[j] >> (8 - bit)) for d in range(depth + 1)], data[j] >> (7 - bit) & 1

    for i in training:
        for nodes, value in steps(texts[i]):
            for node in nodes:
                counts[node][value] += 1
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    mixture, below = {}, collections.defaultdict(float)
    for node in sorted(counts, key=lambda x: -len(x[0])):
        mixture[node] = kt(counts[node]) if len(node[0]) == depth else np.logaddexp(kt(counts[node]), below[node]) - math.log(2)
        below[node[0][1:], node[1], node[2]] += mixture[node]
    out = {}
    for i, text in texts.items():
        total = 0.0
        for nodes, value in steps(text):
            chance = None
            for node in reversed(nodes):
                if node in counts:
                    n = counts[node]
                    own = (n[value] + 0.5) / (sum(n) + 1)
                    w = math.exp(kt(n) - math.log(2) - mixture[node])
                    chance = own if chance is None else w * own + (1 - w) * chance
            total += math.log10(chance or 0.5)
        out[i] = total
    return out


def test_context_tree_is_the_brute_force_one(spark, tables):
    texts = {i: t for i, t in documents(spark, tables).items() if len(t or "") < 3000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    from caseloom.llm.base import id_crc

    scored, n, v = context_tree.score_texts(docs, id_crc() % 5 != 1)
    want = brute_tree(texts, {i for i in texts if not held(i)})
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    c = collections.Counter(w for i in texts if not held(i) for w in tokens[i])
    assert (n, v) == (sum(c.values()), len(c))
    for r in scored.collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-5) and r.held_out == held(r.doc_id)
        assert r.n_tokens == len(tokens[r.doc_id]) and r.n_known == sum(c[w] > 0 for w in tokens[r.doc_id])
        assert r.base_sum == pytest.approx(sum(math.log10(c[w] + 0.5) for w in tokens[r.doc_id]))


def test_bit_probabilities_sum_to_one():
    data = np.frombuffer(b"the cat sat on the mat\n", np.uint8)
    ends = np.array([0, len(data)])
    keys, n = context_tree.counted(context_tree.gram_keys(data, ends), np.ones(len(data), bool))
    context = keys[0] >> np.uint64(8)
    every = np.sort((context << np.uint64(8)) | np.arange(256, dtype=np.uint64))
    both, count = context_tree.summed([(keys, n), (every, np.zeros(256, np.int64))])
    top = context_tree.Top(context_tree.Subtrees(keys, n).summary())
    p = context_tree.Subtrees(both, count).log_probabilities(top)
    assert (10 ** p[np.isin(both, every)]).sum() == pytest.approx(1)


def test_places_find_every_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 20_000, dtype=np.uint64))
    assert (keys[context_tree.Places(keys)(keys[::-1])] == keys[::-1]).all()


# --- 2 ---


def brute_near(texts: dict[int, str], width: int) -> dict[int, int]:
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}

    sets, up = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups_are_the_brute_force_ones(spark, width):
    import random

    r = random.Random(width)
    word = lambda: f"w{r.randint(0, 3000)}"
    texts, n = {}, 0
    for _ in range(12):  # chains of edits, whose ends are far from each other, and groups around an original
        base = [word() for _ in range(r.randint(20, 200))]
        for k in range(12):
            texts[n] = " ".join(base)
            n += 1
            edited = list(base)
            edited[r.randrange(len(base))] = word()
            base = edited if k % 2 else base
    texts |= {n + i: " ".join(word() for _ in range(30)) for i in range(50)} | {n + 60: None, n + 61: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(docs, width).collect()}
    assert got == brute_near(texts, width)


def test_members_that_the_centres_miss_are_linked(spark):
    """Two families that share buckets with a common centre, linked only with each other."""
    import random

    r = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    texts = {0: " ".join(base)}
    for n in range(1, 40):
        edited = list(base)
        for i in r.sample(range(400), 48):
            edited[i] = f"e{n // 2}-{i}"
        texts[n] = " ".join(edited)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(docs, 2).collect()}
    assert got == brute_near(texts, 2)


# --- 3 ---


def test_shards_are_contiguous_balanced_and_gapless(spark, tables):
    rows = queries()["op3_byte_prefix_shards"](spark, tables).orderBy("doc_id").collect()
    texts = documents(spark, tables)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    shards = collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.grown_shard is None and r.law == "bytes"
        shards[r.shard].append(r)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows) and set(shards) <= set(range(24))
    for own in shards.values():
        assert [r.slot for r in own] == list(range(len(own)))
        assert sum(r.size for r in own) <= total / 24 + largest


# --- 4 ---


def test_trigram_queries():
    assert secrets.trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert secrets.trigram_query("(abc|xyz)+[0-9]*") == [frozenset({"abc"}), frozenset({"xyz"})]
    assert secrets.trigram_query("ab?cd") == [frozenset({"abc", "bcd"}), frozenset({"acd"})]
    assert secrets.trigram_query("[a-f0-9]{32}") == [] and secrets.trigram_query("ab|cde") == [] and secrets.trigram_query("(abc)?") == []


def test_secret_spans_are_those_of_finditer(spark, tables):
    texts = documents(spark, tables)
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in secrets.find_secrets(spark.read.parquet(f"{tables}/documents.parquet")).collect()}
    base = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    for i, t in texts.items():
        want = []
        for n, (kind, p) in enumerate(base.items()):
            for m in re.finditer(p, t or "", re.I if kind == "assign" else 0):
                if len(m[2] if kind == "assign" else m[0]) >= (8, 16, 32)[n]:
                    want.append((m.start(), n, kind, m.end()))
        assert [x for x in got[i] if x[0] in base] == [(k, a, b) for a, _, k, b in sorted(want)]


def test_ranges_are_whole_or_not_listed():
    assert secrets.trigram_query("[A-ÿ]bcd") == [frozenset({"bcd"})] and all("abc" in need for need in secrets.trigram_query("[0-z]abc"))
    assert secrets.trigram_query("^ab[cC]$") == [frozenset({"abc"})] and secrets.trigram_query("abΣ") == []
    docs = "doc_id long, text string"
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rules = (secrets.Rule("a", "[A-ÿ]bcd"), secrets.Rule("a", "[0-z]abc"), secrets.Rule("c", "abΣ"))
    rows = secrets.find_secrets(spark.createDataFrame([(0, "x ébcd y"), (1, "zabc"), (2, "abΣ abΣx")], docs), rules).collect()
    assert {r.doc_id: [(s.rank, s.start, s.stop) for s in r.spans] for r in rows} == {0: [(0, 2, 6)], 1: [(1, 0, 4)], 2: [(2, 0, 3), (2, 4, 7)]}


def test_random_rules_find_what_finditer_finds(spark):
    import random

    r = random.Random(7)

    def part(deep=0):
        k = r.random()
        if k < 0.55 or deep > 2:
            return "".join(r.choice("abcXY12") for _ in range(r.randint(1, 4)))
        if k < 0.7:
            return r.choice(["[a-c]", "[A-Z]", "[0-9a-f]", "[^a]", ".", "[ -~]"]) + r.choice(["", "", "+", "{2}", "?"])
        if k < 0.85:
            return "(?:" + "|".join(part(deep + 1) + part(deep + 1) for _ in range(2)) + ")" + r.choice(["", "?", "{1,2}"])
        return "(?i:" + part(deep + 1) + ")"

    patterns = []
    while len(patterns) < 100:
        p = "".join(part() for _ in range(r.randint(1, 4)))
        if not re.match(p + r"\Z", ""):
            patterns.append(p)
    texts = ["".join(r.choice("abcXYxy12 ABC") for _ in range(r.randint(0, 300))) for _ in range(12)] + ["abc12" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for some in (patterns[:60], patterns[60:80], patterns[80:]):
        got = {x.doc_id: [(s.rank, s.start, s.stop) for s in x.spans] for x in secrets.find_secrets(docs, tuple(secrets.Rule(f"k{n % 7}", p) for n, p in enumerate(some))).collect()}
        for i, t in enumerate(texts):
            want = sorted(((m.start(), n, m.end()) for n, p in enumerate(some) for m in re.finditer(p, t)), key=lambda x: x[:2])
            assert got[i] == [(n, a, b) for a, n, b in want]


# --- 5 ---


def test_decontamination_cuts_passages_or_drops_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    benchmark = spark.read.parquet(f"{tables}/benchmark.parquet")
    out = decontamination.decontaminate(docs, benchmark)
    assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.collect()}
    before = documents(spark, tables)
    gone = set(before) - set(left)
    assert gone == {i for i, t in before.items() if t and ("Alpha beta" in t or t == "short item" or t == "a short item b")}
    long = spark.createDataFrame([(1, "one two three four five six seven eight nine ten " * 3 + "Alpha, beta gamma delta epsilon zeta eta theta iota kappa! end", 0)], "doc_id long, text string, n_chars long")
    text = decontamination.decontaminate(long, benchmark).first()
    assert text.text == "one two three four five six seven eight nine ten " * 3 + "! end" and text.n_chars == len(text.text)
    assert {i: r.text for i, r in left.items()} == {i: t for i, t in before.items() if i not in gone}


def test_several_automata_are_one(spark, tables, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {r.doc_id: (decontamination.pairs(r._spans), r._items) for r in decontamination.find_passages(docs, benchmark).collect()}
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", 40)
    monkeypatch.setattr(decontamination, "AT_ONCE", 2)
    assert one == {r.doc_id: (decontamination.pairs(r._spans), r._items) for r in decontamination.find_passages(docs, benchmark).collect()}


# --- 6, 7 ---


def test_learned_models_tell_held_out_texts_apart():
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7)))
    text = lambda bad: " ".join([*(word() for _ in range(r.randint(20, 200))), *(["dreadful", "vileness"] if bad else [])])
    y = [i % 2 for i in range(400)]
    model = toxicity.train(pa.array([text(k) for k in y[:300]]), np.array(y[:300], float), 0.0)
    from caseloom.llm.base import texts_of

    data, ends = texts_of(pa.array([text(k) for k in y[300:]]))
    rows, f = toxicity.grams(data, ends, model.number)
    score = np.bincount(rows, model.weight[f], 100) + model.bias
    assert ((score > 0) == np.array(y[300:])).mean() > 0.95
    junk = lambda good: " ".join(word() + ("" if good else r.choice(["%%%", "$$$"])) for _ in range(r.randint(5, 300)))
    net = quality.train(pa.array([junk(k) for k in y[:300]]), np.array(y[:300], float), 0.0)
    data, ends = texts_of(pa.array([junk(k) for k in y[300:]]))
    assert (((quality.pooled(data, ends, net) @ net.out + net.bias) > 0) == np.array(y[300:])).mean() > 0.95


def test_convolution_chunks_cover_whole_rows():
    r = np.random.default_rng(4)
    net = quality.Network(r.normal(size=(256, quality.EMBED)).astype(np.float32), r.normal(size=(quality.WIDTH * quality.EMBED, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), np.zeros(2 * quality.FILTERS), 0.0)
    for size in (1, 5, 6, 255, 256, 257, 1000, quality.PIECE + 77, 3 * quality.PIECE):
        data = r.integers(0, 256, size, dtype=np.uint8)
        x = net.embed[data] if size >= quality.WIDTH else np.concatenate((net.embed[data], np.zeros((quality.WIDTH - size, quality.EMBED), np.float32)))
        want = np.lib.stride_tricks.sliding_window_view(x, quality.WIDTH, axis=0).transpose(0, 2, 1).reshape(-1, quality.WIDTH * quality.EMBED) @ net.filters
        got = quality.pooled(np.concatenate((data, data[:3])), np.array([0, size, size + min(3, size)]), net)
        assert np.allclose(got[0, quality.FILTERS :], np.maximum(want.max(axis=0), 0), atol=1e-3)


def plain_toxicity(model: toxicity.Model, text: str | None) -> float:
    """A text's score from its distinct character n-grams, one by one."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    codes = [int.from_bytes(c.encode(), "little") for c in low]
    found = set()
    for n in toxicity.LENGTHS:
        for gram in {tuple(codes[i : i + n]) for i in range(len(codes) - n + 1)}:
            key = 0
            for c in gram:
                key = (key * 0x100000001B3 + c) % (1 << 64)
            found.add((key * (0x9E3779B97F4A7C15 + 2 * n)) % (1 << 64) >> (64 - toxicity.BITS))
    total = sum(model.weight[model.number[f]] for f in sorted(found) if model.number[f] >= 0)
    return 1 / (1 + math.exp(-(total + model.bias)))


def plain_quality(net: quality.Network, text: str | None) -> float:
    data, step, tops = (text or "").encode(), quality.CHUNK - quality.OVERLAP, []
    x = np.zeros((max(len(data), quality.WIDTH), quality.EMBED), np.float32)
    x[: len(data)] = net.embed[list(data)]
    for k in range(max(1, -(-(len(data) - quality.OVERLAP) // step)) if data else 0):
        spots = range(k * step, min(k * step + quality.CHUNK, max(len(data), quality.WIDTH) - quality.WIDTH + 1))
        tops.append(np.maximum(np.max([x[p : p + quality.WIDTH].reshape(-1) @ net.filters for p in spots], axis=0) + net.shift, 0))
    pooled = np.concatenate((np.mean(tops, axis=0), np.max(tops, axis=0))) if tops else np.zeros(2 * quality.FILTERS)
    return 1 / (1 + math.exp(-(float(pooled @ net.out) + net.bias)))


def learned(spark, d, label: str, module):
    """A model trained on the labelled rows that the contract leaves, chosen in plain Python."""
    texts, rows, shares = documents(spark, d), {}, [0, 0]
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        if r.doc_id is not None and r[label] in (0, 1) and not module.held_out(zlib.crc32(str(r.doc_id).encode())):
            rows[r.doc_id] = max(r[label], rows.get(r.doc_id, 0))
    for i, y in rows.items():
        shares[y] += 1
    ids = sorted(i for i in rows if i in texts)
    y = np.array([rows[i] for i in ids], float)
    shift = np.log((shares[1] + 1) / (shares[0] + 1)) - np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    return module.train(pa.array([texts[i] or "" for i in ids], pa.large_string()), y, float(shift))


def test_toxicity_query_is_the_plain_one(spark, tables):
    model, texts = learned(spark, tables, "toxic", toxicity), documents(spark, tables)
    for r in queries()["op6_ngram_toxicity"](spark, tables).collect():
        assert r.score == pytest.approx(plain_toxicity(model, texts[r.doc_id]), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)


def test_quality_query_is_the_plain_one(spark, tables):
    net, texts = learned(spark, tables, "quality", quality), documents(spark, tables)
    for r in queries()["op7_byte_convolution_quality"](spark, tables).collect():
        if len(texts[r.doc_id] or "") < 5000:
            assert r.score == pytest.approx(plain_quality(net, texts[r.doc_id]), abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7)


def test_characters_are_not_bytes():
    from caseloom.llm.base import texts_of

    codes, ends = toxicity.characters(*texts_of(pa.array(["aÉ漢", "", "𝒜b", None, "ab"])))
    assert ends.tolist() == [0, 3, 3, 5, 5, 7]
    assert codes.tolist() == [int.from_bytes(c.encode(), "little") for c in "aÉ漢𝒜bab"]


def test_samples_are_bounded_by_bytes(spark, monkeypatch):
    from caseloom.llm import learning

    docs = spark.createDataFrame([(i, "x" * (10 if i % 3 else 1000)) for i in range(60)] + [(1, "y")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(learning, "SAMPLE_BYTES", 500)
    texts, y, _ = learning.labelled_sample(docs, labels, "toxic", lambda crc: crc < 0, 100)
    assert max(map(len, texts.to_pylist())) == 10 and len(texts) == len(y) == 40


#: Names that the operators give their own columns, as columns of the caller.
OWN = "_words _spans _items _toxic _own _sha _keep _lost _s score several stay stay_sha kept keep_id component_id text_sha256 _id mask0 trigram row id key sig part block kind bucket training salt size stretch narrow ids n lost _text _low chunks recipe best group_size rules".split()


def test_callers_columns_are_unchanged(spark, tables):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in OWN])
    docs = docs.union(docs.filter("doc_id in (6, 9)")).union(docs.filter("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")))
    benchmark, texts = spark.read.parquet(f"{tables}/benchmark.parquet"), documents(spark, tables)
    model, net = learned(spark, tables, "toxic", toxicity), learned(spark, tables, "quality", quality)
    for out in (exact_dedup.drop_exact_copies(docs), near_dedup.drop_near_copies(docs), decontamination.decontaminate(docs, benchmark), toxicity.drop_toxic(docs, model)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in OWN if r.doc_id is not None)
        assert all(r[n] == f"{n}12" for r in rows for n in OWN if r.doc_id is None)
    assert len(exact_dedup.drop_exact_copies(docs).collect()) == len({SPACE.sub(" ", t or "") for t in texts.values()})
    for module, one in ((toxicity, model), (quality, net)):
        out = module.score_documents(docs, one)
        assert out.columns == [*docs.columns, "score_"] and all(r.score == f"score{r.doc_id}" and 0 <= r.score_ <= 1 for r in out.filter("doc_id is not null").collect())
    with pytest.raises(ValueError):
        decontamination.find_passages(docs, benchmark)
    n = docs.count()
    assert secrets.find_secrets(docs).count() == near_dedup.near_groups(docs).count() == exact_dedup.exact_groups(docs).count() == sharding.assign_shards(docs, 3).count() == n
    assert packing.pack_documents(docs, packing.default_tokenizer()).filter("start = 0").count() == n
    assert context_tree.score_texts(docs, docs["doc_id"] % 2 == 0)[0].count() == n


def test_very_long_texts(spark):
    """Batches are bounded by bytes: texts of 20 MB, of which 256 would not fit a batch of 32-bit offsets."""
    from pyspark.sql import functions as F

    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words here, "), 1_200_000).alias("text")).coalesce(1)
    assert decontamination.find_passages(docs, spark.createDataFrame([(1, "here some words")], "item_id long, text string")).agg(F.min("_words"), F.sum(F.size("_spans"))).first() == (3_600_000, 6)
    assert [r.kept for r in exact_dedup.exact_groups(docs).orderBy("doc_id").collect()] == [True] + [False] * 2


# --- 8 ---


def test_arc_versions_and_declared_lengths():
    one = b"filedesc://a 0.0.0.0 20240101000000 text/plain 4\n1 0 \n\nhttp://x/ 1.2.3.4 20230102030405 text/html 10\nab\n1 2 3 4\n\nhttp://y/ 1.2.3.4 20230102030405 text/html 0\n\n"
    assert [(f["URL"], c) for _, f, c in warc.parse_arc(one)] == [("http://x/", b"ab\n1 2 3 4"[:10]), ("http://y/", b"")]
    two = b"filedesc://a 0.0.0.0 20240101000000 text/plain 200 - - 0 a 4\n2 0 \n\nhttp://x/ 1.2.3.4 20230102030405 text/html 404 abc - 0 a 3\nxyz\n"
    assert [(f["Result-code"], c) for _, f, c in warc.parse_arc(two)] == [("404", b"xyz")]
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"nonsense\n"))
    record = warc.from_arc("urn:uuid:1", {"URL": "http://x/", "IP-address": "1.2.3.4", "Archive-date": "20230102030405", "Content-type": "text/plain"}, b"\xff\xfe", None)
    (fields, block), = warc.parse_warc(record + b"\r\n\r\n")
    assert fields["warc-type"] == "resource" and fields["warc-date"] == "2023-01-02T03:04:05Z" and block == b"\xff\xfe"
    assert fields["content-length"] == "2" and fields["warc-block-digest"] == "sha1:" + warc.sha1(b"\xff\xfe")
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_arc(two[:-2]))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_warc(record[:-1]))


def test_bytes_that_are_no_text_come_back(spark, monkeypatch):
    """ARC records of any bytes, through files, in archives closed by size."""
    from caseloom.llm.base import scratch_path

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    payloads = [bytes(range(256)), b"\xff\xfe\x00\n\r\n", "é".encode("latin-1") * 2000, b""]
    head = lambda n: f"HTTP/1.1 200 OK\r\nX-Page-Id: {n}\r\n\r\n".encode()
    one = b"\n".join([warc.arc_record(1, "filedesc://x.arc", "text/plain", "0", b"1 0 x\n"), *(warc.arc_record(1, f"http://x/{n}", "text/html", "200", head(n) + p) for n, p in enumerate(payloads))])
    warc._written(spark.createDataFrame([(bytearray(one),)], "value binary"), arcs, "\n")
    warc.convert(spark, arcs, warcs)
    got = {r.page_id: bytes(r.payload) for r in warc.read_warcs(spark, warcs, payloads=True).collect()}
    assert got == dict(enumerate(payloads)) and warc._archives(spark, warcs).count() > 1
    pages = spark.createDataFrame([(i, f"http://y/{i}", "z" * (100 * i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    arcs = scratch_path(spark, "arc")
    warc.write_arcs(pages, arcs)
    sizes = [len(warc._unzipped(bytes(r.content))) for r in warc._archives(spark, arcs).collect()]
    assert len(sizes) > 20 and max(sizes) < 3000 + 1500 + 4000


def test_payloads_come_back(spark, tables):
    from caseloom.llm.base import scratch_path

    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    warc.write_arcs(pages, arcs)
    warc.convert(spark, arcs, warcs)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_warcs(spark, warcs, payloads=True).filter("record_type = 'response'").collect()}
    want = {}
    for r in pages.collect():
        want[r.html or ""] = max(r.page_id, want.get(r.html or "", -1))
    assert got == {i: h for h, i in want.items()}


# --- 9 ---


def test_packing_round_trip(spark, tables, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "STRETCH_BYTES", 50_000)
    tokens = Tokenizer.from_file(packing.default_tokenizer())
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = packing.pack_documents(docs, packing.default_tokenizer(), 256, with_ids=True).collect()
    of, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
    for i, t in documents(spark, tables).items():
        own = sorted(of[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == [*tokens.encode(t or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) <= 256
    stretches = len({s >> 32 for s in sequences})
    assert stretches > 1 and len(sequences) <= sum(r.length for r in rows) / 256 + stretches


def test_ids_are_those_of_tokenizers(spark):
    """With its default setting, added tokens' contents and long white space included."""
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(packing.default_tokenizer())
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end} x", f"one\n\n{end}\n\ntwo", "<|endoftext|", "a" + " " * 99_999 + "b", "a" + " " * 100_000 + "b", "a" + "\n" * 1_100_000 + "b", "\u3000 \t" * 400_000, "é" * 200_000]
    want = {i: [*tokens.encode(t, add_special_tokens=False).ids, packing.END] for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 1]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.default_tokenizer(), with_ids=True).collect()
    got = {i: [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start) for x in r.ids] for i in want}
    assert all(got[i] == want[i] for i in want)
    assert all(r.doc_tokens == len(want[r.doc_id]) for r in rows)


def test_packing_follows_the_curve(spark, tables, monkeypatch):
    """Keys, stretches and sequences, from word counts one by one."""
    from caseloom.llm.base import SPACES, word_hashes

    monkeypatch.setattr(packing, "STRETCH_BYTES", 50_000)
    texts = documents(spark, tables)

    def key(text):
        point = np.zeros(packing.DIMENSIONS)
        tokens = (text or "").encode().split()
        for w in tokens:
            h = int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), SPACES)[0])
            for d in range(packing.DIMENSIONS):
                point[d] += 1 if h >> (63 - d) & 1 else -1
        share = 0.5 + np.arctan(point / math.sqrt(max(len(tokens), 1)) / 3) / math.pi
        return int(packing.hilbert(np.clip(share * (1 << packing.DEPTH), 0, (1 << packing.DEPTH) - 1).astype(np.int64)[None], packing.DEPTH)[0])

    rows = packing.pack_documents(spark.read.parquet(f"{tables}/documents.parquet"), packing.default_tokenizer(), 256).collect()
    keys = {i: key(t) for i, t in texts.items()}
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    order = [keys[r.doc_id] for r in rows if r.start == 0]
    assert order == sorted(order) and len({r.sequence_id >> 32 for r in rows}) > 1
    for stretch in {r.sequence_id >> 32 for r in rows}:
        own = [r for r in rows if r.sequence_id >> 32 == stretch]
        assert [(r.sequence_id % (1 << 32)) * 256 + r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])


def test_hilbert_neighbours_are_adjacent():
    import itertools

    for n, bits in ((2, 4), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        key = packing.hilbert(points, bits)
        order = points[np.argsort(key)]
        assert sorted(key) == list(range(len(points))) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# --- 10 ---


def test_shared_hashes_are_told_apart(spark, monkeypatch):
    """With hashes of one bit nearly all chunks share theirs; groups stay those of equal texts."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2)))
    texts = ["a b " * n for n in (1, 100, 200, 300, 300)] + ["c " * 500, "", None, " ", "c  " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()}
    normal = [SPACE.sub(" ", t or "") for t in texts]
    assert got == {i: normal.index(t) for i, t in enumerate(normal)}


def test_chunks_give_the_text_back(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    from pyspark.sql import functions as F

    text = exact_dedup.normal(F.coalesce("text", F.lit("")))
    assert docs.filter(F.array_join(exact_dedup.chunks(text), "") != text).count() == 0
