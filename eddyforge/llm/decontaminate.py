"""Benchmark decontamination on a distributed positional inverted index.

The index is partitioned by document shards: a shard holds about a million words of training text,
a row of it is a term with the ascending positions of all its occurrences in the shard. Documents
lie apart in a shard's position space, so an intersection never runs across two of them.

A search reads the posting lists of the benchmark's terms only. Per shard the windows all of whose
terms occur there start from the rarest of them; its positions, less the term's offset in the window,
are the candidate starts, which the other terms' lists cut down in ascending order of length. For
proximity a window matches at a start if each of its terms lies within SLOP words of its place. The
benchmark is taken in blocks of bounded size, each broadcast by itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick

WINDOW = 10
#: Words by which a term may be off its place in a proximity match.
SLOP = 2
#: Words of a shard; one document of more words is a shard by itself.
SHARD_WORDS = 1_000_000
#: Benchmark words of one broadcast block.
BLOCK_WORDS = 200_000
#: Posting lists handed on at once.
ROWS = 10_000
#: Space between two documents of a shard, above any window and slop.
GAP = 1024
_DELIMITERS = bytes(32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_DELIMITERS).split()


INDEX = "shard long, term binary, positions array<int>, ord int, doc_id long, n_words long"


class _Shard:
    def __init__(self) -> None:
        self.terms: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int]] = []
        self.bases: list[int] = []
        self.end = 0

    def add(self, doc_id: int | None, tokens: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.terms.__getitem__, tokens), np.int32, len(tokens)))
        self.at.append(np.arange(self.end, self.end + len(tokens), dtype=np.int32))
        self.docs.append((doc_id, len(tokens)))
        self.bases.append(self.end)
        self.end += len(tokens) + GAP

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64()]

        def batch(n: int, *columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, k in zip(columns, kinds)], names=names)

        d = len(self.docs)
        starts = pa.array([[b] for b in self.bases], kinds[2])
        yield batch(d, pa.array(np.full(d, shard)), None, starts, pa.array(range(d), pa.int32()), pa.array([x for x, _ in self.docs], pa.int64()), pa.array([n for _, n in self.docs], pa.int64()))
        ids = np.concatenate(self.ids)
        if len(ids):
            by = np.argsort(ids, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(self.terms))))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(self.at)[by]))
            t = len(self.terms)
            terms = batch(t, pa.array(np.full(t, shard)), pa.array(list(self.terms), pa.binary()), lists, None, None, None)
            for at in range(0, t, ROWS):
                yield terms.slice(at, ROWS)


def build_index(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The index of whole ``docs`` (doc_id, text), written to the shared folder.

    Rows with a term are posting lists; rows without one are the shard's documents, ``positions``
    then holding where the document begins. Every row of ``docs`` is one document, repeats included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, shard = TaskContext.get().partitionId(), 0, _Shard()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = words(text.as_py())
                if shard.docs and shard.end + len(tokens) > SHARD_WORDS:
                    yield from shard.rows((part << 32) + seq)
                    seq, shard = seq + 1, _Shard()
                shard.add(doc_id, tokens)
        if shard.docs:
            yield from shard.rows((part << 32) + seq)

    return materialize(spark, pick(docs, "doc_id", "text").mapInArrow(run, INDEX), "index")


def windows(items: list[tuple[str, list[bytes]]], size: int = WINDOW) -> tuple[list[bytes], list[tuple[tuple[int, ...], int]]]:
    """The block's terms, and each window as (term numbers, item number)."""
    terms: dict[bytes, int] = defaultdict(count().__next__)
    out = []
    for k, (_, tokens) in enumerate(items):
        ids = [terms[w] for w in tokens]
        if ids:
            out += [(tuple(ids[i : i + size]), k) for i in range(max(1, len(ids) - size + 1))]
    return list(terms), out


def _within(sorted_at: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
    i = np.searchsorted(sorted_at, want - slop)
    found = i < len(sorted_at)
    found[found] = sorted_at[i[found]] <= want[found] + slop
    return found


def intersect(lists: list[np.ndarray], window: tuple[int, ...], slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a window, and for each a position of its rarest term: exact ones, or with each term
    at most ``slop`` words off its place."""
    order = sorted(range(len(window)), key=lambda i: len(lists[window[i]]))
    at = lists[window[order[0]]]
    starts, anchors = at - order[0], at
    if slop:
        starts = (starts[:, None] + np.arange(-slop, slop + 1, dtype=starts.dtype)).ravel()
        anchors = np.repeat(at, 2 * slop + 1)
    for i in order[1:]:
        if not len(starts):
            break
        keep = _within(lists[window[i]], starts + i, slop)
        starts, anchors = starts[keep], anchors[keep]
    return starts, anchors


FOUND = "shard long, ord int, item string, first int, last int, exact boolean"


def search(spark: SparkSession, index: DataFrame, items: list[tuple[str, list[bytes]]], size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Matches of one block's items per shard, document and item: exact runs (first, last word of the
    document), and rows without a run for items that are only near."""
    terms, wins = windows(items, size)
    table = np.full((len(wins), max((len(w) for w, _ in wins), default=1)), len(terms), np.int32)  # past the end: always there
    for i, (w, _) in enumerate(wins):
        table[i, : len(w)] = w
    shared = spark.sparkContext.broadcast((terms, wins, table, [i for i, _ in items]))
    wanted = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    use = index.join(F.broadcast(wanted), "term", "left_semi").unionByName(index.where("term is null").select(*index.columns))

    def run(rows: pa.Table) -> pa.Table:
        terms, wins, table, item_ids = shared.value
        number = {t: i for i, t in enumerate(terms)}
        lists: list[np.ndarray] = [np.zeros(0, np.int32)] * len(terms)
        here = np.zeros(len(terms) + 1, bool)
        here[-1] = True
        shard = rows.column("shard")[0].as_py()
        begin, ords = [], []
        for term, at, o in zip(rows.column("term"), rows.column("positions"), rows.column("ord")):
            if term.is_valid:
                lists[number[term.as_py()]] = np.asarray(at.values)
                here[number[term.as_py()]] = True
            else:
                begin.append(at.values[0].as_py())
                ords.append(o.as_py())
        by = np.argsort(begin)
        begin, ords = np.array(begin)[by], np.array(ords)[by]
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        close: dict[int, set[int]] = defaultdict(set)
        for w in np.flatnonzero(here[table].all(axis=1)).tolist():
            window, item = wins[w]
            starts, anchors = intersect(lists, window)
            if len(starts):
                found[item].append(np.stack([starts, starts + len(window) - 1]))
            if slop:
                _, anchors = intersect(lists, window, slop)
            if len(anchors):
                close[item].update((np.searchsorted(begin, anchors, side="right") - 1).tolist())
        out = [[], [], [], [], []]
        for item, runs in found.items():
            first, last = np.concatenate(runs, axis=1)
            by = np.argsort(first, kind="stable")
            first, last = first[by], np.maximum.accumulate(last[by])
            new = np.flatnonzero(np.concatenate(([True], first[1:] > last[:-1] + 1)))
            first, last = first[new], last[np.concatenate((new[1:] - 1, [len(last) - 1]))]
            doc = np.searchsorted(begin, first, side="right") - 1
            out[0] += ords[doc].tolist()
            out[1] += [item_ids[item]] * len(first)
            out[2] += (first - begin[doc]).tolist()
            out[3] += (last - begin[doc]).tolist()
            out[4] += [True] * len(first)
            close[item] -= set(doc.tolist())
        for item, docs in close.items():
            out[0] += ords[sorted(docs)].tolist() if docs else []
            out[1] += [item_ids[item]] * len(docs)
            out[2] += [None] * len(docs)
            out[3] += [None] * len(docs)
            out[4] += [False] * len(docs)
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip([[shard] * len(out[0]), *out], kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    return use.groupBy("shard").applyInArrow(run, FOUND)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's items (as text id, words) in blocks of about ``block_words``; null ids are ''."""
    held, n = [], 0
    for r in pick(benchmark, "item_id", "text").toLocalIterator():
        tokens = words(r["text"])
        if tokens:
            held.append(("" if r["item_id"] is None else str(r["item_id"]), tokens))
            n += len(tokens)
        if n >= block_words:
            yield held
            held, n = [], 0
    if held:
        yield held


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated, all from exact
    matches, and n_near_items, the number of items with a window that matches within ``slop`` words.

    ``doc_id`` is an integer. An item of fewer than ``size`` words is one window; one without words none;
    items of one id are one. Null texts have no words; texts may be of any length up to 2**31 words. An
    empty benchmark leaves every document clean; an empty table gives no rows. Repeated rows give repeated
    result rows. Further columns are not read.
    """
    index = build_index(spark, docs)
    hits = None
    for block in item_blocks(benchmark, block_words):
        found = search(spark, index, block, size, slop)
        hits = found if hits is None else hits.unionByName(found)
    all_docs = index.where("term is null").select("shard", "ord", "doc_id", "n_words")
    if hits is None:
        hits = spark.createDataFrame([], FOUND)
    runs = F.array_sort(F.collect_list(F.when(F.col("exact"), F.struct("first", "last"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("reach"))
    covered = F.aggregate(
        runs,
        zero,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], a["reach"] + 1) + 1)).alias("n"),
            F.greatest(a["reach"], x["last"]).alias("reach"),
        ),
        lambda a: a["n"],
    )
    per = hits.groupBy("shard", "ord").agg(covered.alias("n_hit"), F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_distinct("item").alias("n_near_items"))
    out = all_docs.join(per, ["shard", "ord"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near_items", F.lit(0).cast("long")).alias("n_near_items"))


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark passage, all columns, whatever their names; by doc_id.

    Rows that share the doc_id of a contaminated row go with it; a null doc_id is one doc_id. The other
    cases are those of ``decontaminate``.
    """
    bad = decontaminate(spark, docs, benchmark, slop=0).where("contaminated").select(F.struct("doc_id").alias("bad_row")).distinct()
    bad = materialize(spark, bad, "contaminated")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = own.join(bad, F.col("row").getField("doc_id").eqNullSafe(F.col("bad_row.doc_id")), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
