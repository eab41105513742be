"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import MARKS, blocks, fresh, load, scratch, small_batches, text_or_empty, texts_of, word_hashes, words

#: Consecutive words that count as a passage of an item; shorter items count as a whole.
WINDOW = 10
#: Bytes of items in one automaton (some 100 MB in a worker); automata that a worker holds at once. More items make more
#: automata, which the documents pass group after group, written to the shared folder between groups.
AUTOMATON_BYTES, AT_ONCE = 1 << 20, 4
#: Share of a document's words in passages from which the document goes, instead of its passages.
COVERAGE = 0.5
#: Names of the columns that tell of passages.
NAMES = ("_words", "_spans", "_items")


class SuffixAutomaton:
    """All word sequences of the items, as states with suffix links.

    Of each state it knows: length of its longest sequence; where it is reached from the state of its window (`up`: the
    ancestor that holds the last `window` words); the items in which that window occurs; items of fewer words that end here.
    """

    def __init__(self, items: Iterable[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        items = [(name, hashes) for name, hashes in items if len(hashes)]
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        coded = [(name, np.searchsorted(self.vocabulary, h).tolist()) for name, h in items]
        self.least = min([window, *(len(c) for _, c in coded)])
        for _, code in coded:
            last = 0
            for word in code:
                last = self._extend(last, word)
        n = len(self.length)
        self.items: list[set[str] | None] = [None] * n
        self.whole: list[set[tuple[int, str]] | None] = [None] * n
        for name, code in coded:
            state = 0
            for k, word in enumerate(code, 1):
                state = self.next[state][word]
                if k >= window:
                    at = self._holder(state, window)
                    self.items[at] = (self.items[at] or set()) | {name}
            if len(code) < window:
                at = self._holder(state, len(code))
                self.whole[at] = (self.whole[at] or set()) | {(len(code), name)}
        order = sorted(range(n), key=self.length.__getitem__)
        self.up = [-1] * n
        self.shorter: list[tuple[tuple[int, str], ...]] = [()] * n  # short items that end here, whatever the matched length
        for s in order[1:]:
            above = self.link[s]
            self.up[s] = s if self.length[above] < window <= self.length[s] else self.up[above]
            self.shorter[s] = self.shorter[above] + tuple(self.whole[above] or ())

    def _holder(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _clone(self, last: int, word: int, of: int) -> int:
        new = len(self.length)
        self.next.append(dict(self.next[of]))
        self.length.append(self.length[last] + 1)
        self.link.append(self.link[of])
        self.link[of] = new
        while last >= 0 and self.next[last].get(word) == of:
            self.next[last][word] = new
            last = self.link[last]
        return new

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, word, there)
        new = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][word]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._clone(last, word, there)
        return new

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def match(self, code: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Passages (first word, last+1) and items of a sequence of item words, from the longest match at each word."""
        state, length, spans, found = 0, 0, [], set()
        following, link, lengths = self.next, self.link, self.length
        for i, word in enumerate(code, 1):
            while state and word not in following[state]:
                state = link[state]
                length = lengths[state]
            if word in following[state]:
                state = following[state][word]
                length += 1
            if length >= self.window:
                spans.append((i - self.window, i))
                found |= self.items[self.up[state]] or set()
            if self.shorter[state] or self.whole[state]:
                for k, name in (*self.shorter[state], *(self.whole[state] or ())):
                    if k <= length:
                        spans.append((i - k, i))
                        found.add(name)
        return spans, found


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int) -> Iterator[SuffixAutomaton]:
    """Automata over benchmark (item_id, text), each of some AUTOMATON_BYTES at most besides its last item."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), text_or_empty().alias("text"))
    n = -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // AUTOMATON_BYTES) or 1
    for k in range(n):
        rows = own.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").collect()
        data, ends = texts_of(pa.array([r.text for r in rows], pa.string()))
        starts, stops, first = words(data, ends, MARKS)
        hashes = word_hashes(data, starts, stops, MARKS)
        yield SuffixAutomaton([(r.item or "", hashes[first[i] : first[i + 1]]) for i, r in enumerate(rows)], window)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """docs with _words (count), _spans (flat first, last+1 words of passages) and _items (sorted ids) for each row.

    names: of the three new columns, which docs must not have (base.fresh gives such names).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z. Null and empty texts have none. Each
    row is judged on its own, so repeated rows and ids are no matter; items without words match nothing; an empty
    benchmark marks nothing. Nothing is shuffled: texts stream past the broadcast automata, AT_ONCE of them at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column named as one of {names}: give other names")
    w, s, t = names
    out = docs.withColumns({w: F.lit(0).cast("long"), s: F.array().cast("array<long>"), t: F.array().cast("array<string>")})
    schema = out.schema
    for k, one in enumerate(automata(benchmark, window)):
        if k and k % AT_ONCE == 0:
            out = scratch(out, "marked")
        shared = spark.sparkContext.broadcast(one)

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                data, ends = texts_of(batch["text"])
                n_words, spans, items = np.zeros(batch.num_rows, np.int64), batch[s].to_pylist(), batch[t].to_pylist()
                for i, j in blocks(ends):
                    part, own = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
                    starts, stops, first = words(part, own, MARKS)
                    n_words[i:j] = np.diff(first)
                    code = automaton.codes(word_hashes(part, starts, stops, MARKS))
                    known = np.concatenate(([False], code >= 0, [False]))
                    cuts = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
                    for a, b in cuts[cuts[:, 1] - cuts[:, 0] >= automaton.least].tolist():
                        row = int(np.searchsorted(first, a, "right")) - 1
                        while a < b:
                            stop = min(b, int(first[row + 1]))
                            if stop - a >= automaton.least:
                                got, names = automaton.match(code[a:stop].tolist())
                                if got:
                                    at = a - int(first[row])
                                    spans[i + row] = spans[i + row] + [x + at for span in merged(got) for x in span]
                                    items[i + row] = sorted({*items[i + row], *names})
                            a, row = stop, row + 1
                keep = {w: pa.array(n_words), s: pa.array(spans, pa.list_(pa.int64())), t: pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([keep[name] if name in keep else batch[k] for k, name in enumerate(batch.schema.names)], batch.schema.names)

        out = out.mapInArrow(mark, schema)
    return out


def pairs(flat: list[int]) -> list[tuple[int, int]]:
    return merged(zip(flat[::2], flat[1::2], strict=True))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """docs without the passages of the benchmark: a document goes if they hold that share of its words or more,
    else they are cut out of its text (with what stands between their words), and n_chars, if there, follows.

    Null and empty texts, and those without passages, stay as they are. Each row is judged on its own, so ids, ties and
    repeated rows are no matter; an empty table stays empty. Other columns are unchanged, whatever their names.
    """
    small_batches(docs.sparkSession)
    new_names = [fresh(docs, n) for n in NAMES]
    marked = find_passages(docs, benchmark, window, tuple(new_names))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            data, ends = texts_of(batch["text"])
            text, keep = batch["text"].to_pylist(), np.ones(batch.num_rows, bool)
            chars = batch["n_chars"].to_pylist() if "n_chars" in names else None
            for row, flat in enumerate(batch[new_names[1]].to_pylist()):
                if not flat:
                    continue
                spans, own = pairs(flat), data[ends[row] : ends[row + 1]]
                starts, stops, _ = words(own, np.array([0, len(own)]), MARKS)
                if sum(b - a for a, b in spans) >= coverage * len(starts):
                    keep[row] = False
                    continue
                raw, left, at = own.tobytes(), [], 0
                for a, b in spans:
                    left.append(raw[at : starts[a]])
                    at = stops[b - 1]
                text[row] = b"".join([*left, raw[at:]]).decode()
                if chars is not None:
                    chars[row] = len(text[row])
            new = {"text": lambda: pa.array(text, batch["text"].type), "n_chars": lambda: pa.array(chars, batch["n_chars"].type)}
            columns = [(new[n]() if n in new else batch[k]) for k, n in enumerate(names) if n not in new_names]
            yield pa.RecordBatch.from_arrays(columns, [n for n in names if n not in new_names]).filter(pa.array(keep))

    return marked.mapInArrow(cut, docs.schema)


def op5_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = find_passages(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [sum(b - a for a, b in pairs(x)) for x in batch["_spans"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_words"], pa.array(hit, pa.int64()), batch["_items"]], ["doc_id", "n_words", "n_hit", "items"])

    told = marked.drop("text").mapInArrow(digest, "doc_id long, n_words long, n_hit long, items array<string>")
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
with low as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as gram from (select item, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct k from windows),
grams as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as gram from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from low, sizes where len(w) >= k)),
hits as (select doc_id, i, k, item from grams join windows using (k, gram)),
spots as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
named as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from low left join spots using (doc_id) left join named using (doc_id)
"""
