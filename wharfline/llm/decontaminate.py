"""Benchmark decontamination through suffix arrays over the training text.

The documents of a partition are cut into shards of bounded size. A shard's
suffix array lists its word positions in the order of the word sequences that
begin there. Every suffix of every benchmark item is binary-searched in it, a
word deeper at a time, which gives its longest verbatim match in the shard and,
at the depth of a window, all of that window's places.

The array is sparse: a word that no item has can't be part of a match, so only
runs of item words which are as long as the shortest window are sorted, and
only as deep as the longest item.

The benchmark is sent to the executors in blocks of at most ``block_bytes`` of
text, each a pass of its own over the documents; a small benchmark is one block.

Defined results: a null text has no words; an item without words has no window;
an item with fewer words than a window is one window; items without an id count
as hits but are never listed; repeated rows each get their own result; empty
tables give no rows or no hits; other columns are carried along unchanged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.llm.names import map_carrying, quoted, unused
from wharfline.session import materialise, ship

WINDOW = 10
#: Item text that one pass sends to the executors.
BLOCK_BYTES = 8 << 20
#: Document text whose positions one suffix array holds.
SHARD_BYTES = 12 << 20
#: A-Z to a-z; what is neither digit, letter nor part of a non-ASCII character to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


@dataclass
class TestSet:
    """A block of items as word ids from 1; ``begin`` and ``end`` bound each item."""

    ids: list[str | None]
    vocabulary: dict[bytes, int]
    words: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    window: int

    @property
    def shortest(self) -> int:
        return min(self.window, int((self.end - self.begin).min())) if len(self.ids) else 0


def test_set(rows: list[tuple], window: int) -> TestSet | None:
    """The items of (item_id, text) rows that have words; None without any."""
    vocabulary: dict[bytes, int] = {}
    items = [(i, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)]) for i, t in rows]
    items = [(i, w) for i, w in items if w]
    if not items:
        return None
    sizes = np.array([len(w) for _, w in items])
    end = np.cumsum(sizes)
    return TestSet([None if i is None else str(i) for i, _ in items], vocabulary, np.concatenate([np.array(w, np.int32) for _, w in items]), end - sizes, end, window)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``seq`` ordered by the ``depth`` words from there on."""
    rank, reach = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while reach < depth and order.size:
        later = np.zeros_like(rank)
        later[:-reach] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + later
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank = np.empty_like(rank)
        rank[order] = fresh
        reach *= 2
        if fresh[-1] == len(fresh) - 1:
            break
    return order


def _edge(seq: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
    """Binary search, for all queries at once, by the word ``depth`` places on."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = np.minimum(order[np.minimum(mid, order.size - 1)] + depth, seq.size - 1)
        below = seq[at] <= word if right else seq[at] < word
        low = np.where(open_ & below, mid + 1, low)
        high = np.where(open_ & ~below, mid, high)
    return low


def search(seq: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, int, np.ndarray]]]:
    """Longest match and one place of every test suffix, and all window places.

    ``seq`` has 0 where no item's word is. Window places come as (items,
    lengths, ...) lists: (item, place, length).
    """
    n = len(tests.words)
    longest, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    places: list = []
    inside = np.concatenate(([0], (seq > 0).astype(np.int8), [0]))
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    wide = ends - starts >= tests.shortest
    starts, ends = starts[wide], ends[wide]
    if not starts.size:
        return longest, where, places
    sizes = ends - starts + 1  # each run is followed by a 0
    base = np.concatenate(([0], np.cumsum(sizes)))
    back = np.arange(base[-1]) - np.repeat(base[:-1], sizes) + np.repeat(starts, sizes)
    run = np.where(back < np.repeat(ends, sizes), seq[np.minimum(back, seq.size - 1)], 0)
    room = (tests.end - tests.begin).max()
    order = suffix_array(run, int(room))
    order = order[run[order] > 0]
    item = np.repeat(np.arange(len(tests.ids)), tests.end - tests.begin)
    left = np.repeat(tests.end, tests.end - tests.begin) - np.arange(n)  # words of the suffix
    need = np.minimum(tests.window, (tests.end - tests.begin)[item])
    live = np.arange(n)
    low, high = np.zeros(n, np.int64), np.full(n, order.size, np.int64)
    for depth in range(int(room)):
        live = live[left[live] > depth]
        if not live.size:
            break
        word = tests.words[live + depth]
        a = _edge(run, order, low[live], high[live], depth, word, False)
        b = _edge(run, order, low[live], high[live], depth, word, True)
        met = a < b
        live = live[met]
        low[live], high[live] = a[met], b[met]
        longest[live] = depth + 1
        where[live] = back[order[low[live]]] if live.size else 0
        for q in live[need[live] == depth + 1]:
            places.append((item[q], back[order[low[q] : high[q]]], depth + 1))
    return longest, where, places


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _shards(texts: list[bytes | None], limit: int) -> Iterator[range]:
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or b"") > limit:
            yield range(first, i)
            first, size = i, 0
        size += len(t or b"")
    if first < len(texts):
        yield range(first, len(texts))


def _index_shard(texts: list[bytes | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The word ids of all texts, a 0 after each, and where each text begins."""
    parts, begin, at = [], [], 0
    for t in texts:
        got = np.array([vocabulary.get(w, 0) for w in words_of(t)], np.int32)
        parts += [got, np.zeros(1, np.int32)]
        begin.append(at)
        at += len(got) + 1
    begin.append(at)
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(begin)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks whose text is about ``block_bytes`` at most."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("string").cast("binary").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r[0], None if r[1] is None else bytes(r[1])) for r in part.collect()]


def _pass(docs: DataFrame, text: str, tests: TestSet | None, drop_text: bool, added: list[str]) -> DataFrame:
    """Adds what one block of items hits to the columns of the passes before, called as ``added``."""
    shared = ship(docs.sparkSession, tests)  # a block of bounded size
    kept = [c for c in docs.columns if c not in (*added, *([text] if drop_text else []))]
    fields = [T.StructField(added[0], T.LongType()), T.StructField(added[1], SPAN), T.StructField(added[2], T.ArrayType(T.StringType()))]
    later = added[0] in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = pickle.loads(shared.value)
        vocabulary = tests.vocabulary if tests else {}
        for whole in batches:
            every = whole.column("i0").cast(pa.binary()).to_pylist()
            for part in _shards(every, SHARD_BYTES):
                b = whole.slice(part.start, len(part))
                seq, begin = _index_shard(every[part.start : part.stop], vocabulary)
                spans: list[list[tuple[int, int]]] = [[] for _ in part]
                items: list[set[str]] = [set() for _ in part]
                if later:
                    spans = [[(s["start"], s["end"]) for s in x] for x in b.column("i1").to_pylist()]
                    items = [set(x) for x in b.column("i2").to_pylist()]
                for item, at, length in search(seq, tests)[2] if tests else ():
                    for d, p in zip((np.searchsorted(begin, at, "right") - 1).tolist(), at.tolist(), strict=True):
                        spans[d].append((p - begin[d], p - begin[d] + length))
                        if tests.ids[item] is not None:
                            items[d].add(tests.ids[item])
                out = [b.column(k) for k in range(len(kept))]
                out.append(pa.array(np.diff(begin) - 1, pa.int64()))
                out.append(pa.array([[{"start": a, "end": z} for a, z in _merged(x)] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                out.append(pa.array([sorted(x) for x in items], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(out, names=[*(f"c{k}" for k in range(len(kept))), "a0", "a1", "a2"])

    return map_carrying(docs, kept, [F.col(quoted(c)) for c in (text, *(added[1:] if later else []))], run, fields)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """``docs`` and what of it the benchmark has.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence of a window),
    ``hit_spans`` (those words as merged word ranges) and ``hit_items`` (ids of
    the items with occurring windows, sorted as strings), each with a ``_`` behind
    its name for as long as ``docs`` has a column of that name.
    """
    n_words, n_hit, hit_spans, hit_items = names = unused(docs.columns, "n_words", "n_hit", "hit_spans", "hit_items")
    own = [n_words, hit_spans, hit_items]
    out = docs.select(*[F.col(quoted(c)).cast("string").alias(c) if c == text else F.col(quoted(c)) for c in docs.columns])
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    held, n = next(blocks), 0
    while held is not None:
        ahead = next(blocks, None)
        out = _pass(out, text, test_set(held, window), ahead is None and not keep_text, own)
        n += 1
        if ahead is not None and n % 4 == 0:
            out = materialise(out, "decontaminate")
        held = ahead
    hit = F.aggregate(hit_spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    kept = [F.col(quoted(c)) for c in out.columns if c not in own]
    return out.select(*kept, *[hit.alias(c) if c == n_hit else F.col(c) for c in names])


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per benchmark suffix that occurs: its longest match over all shards.

    (item_id, item_pos, length, doc_id, doc_pos), positions in words. Only
    matches as long as the shortest window are looked for. Of equal lengths the
    least (doc_id, doc_pos) is given.
    """
    spark, found = docs.sparkSession, None
    for rows in _blocks(benchmark, item_id, item_text, block_bytes):
        tests = test_set(rows, window)
        if tests is None:
            continue
        shared = ship(spark, tests)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = pickle.loads(shared.value)
            item = np.repeat(np.arange(len(tests.ids)), tests.end - tests.begin)
            for whole in batches:
                every = whole.column("t").cast(pa.binary()).to_pylist()
                for part in _shards(every, SHARD_BYTES):
                    seq, begin = _index_shard(every[part.start : part.stop], tests.vocabulary)
                    longest, where, _ = search(seq, tests)
                    q = np.flatnonzero((longest >= tests.shortest) & (longest > 0))
                    d = np.searchsorted(begin, where[q], "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tests.ids[i] for i in item[q]], pa.string()), pa.array(q - tests.begin[item[q]]), pa.array(longest[q]), whole.column("d").slice(part.start, len(part)).take(pa.array(d)), pa.array(where[q] - begin[d])],
                        names=["item_id", "item_pos", "length", "doc_id", "doc_pos"],
                    )

        kind = docs.schema[doc_id].dataType.simpleString()
        got = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"item_id string, item_pos long, length long, doc_id {kind}, doc_pos long")
        found = got if found is None else found.union(got)
    if found is None:
        return spark.createDataFrame([], f"item_id string, item_pos long, length long, doc_id {docs.schema[doc_id].dataType.simpleString()}, doc_pos long")
    best = F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "doc_pos")).alias("b")
    return found.groupBy("item_id", "item_pos").agg(best).select("item_id", "item_pos", (-F.col("b.l")).alias("length"), "b.doc_id", "b.doc_pos")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that a benchmark window occurs in."""
    marked = contamination(docs, benchmark, text=text, keep_text=True, **how)
    n_hit = unused(docs.columns, "n_hit")[0]
    return marked.where(F.col(n_hit) == 0).select(*[F.col(quoted(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
