"""SimHash near-duplicates: 64-bit fingerprints, linked by a generalised pigeonhole search.

The 64 bits are grouped into partitions of correlated bits. For a distance limit k and m partitions
with thresholds t_i (-1 upwards) summing to k - m + 1, two fingerprints within k bits agree within
t_i bits on at least one partition i. Both sides probe that partition's value with up to half t_i bits
flipped, rounded up, so that values within t_i bits meet and no link is lost. The number of partitions
and the thresholds are chosen by dynamic programming on candidate counts, estimated from the distances
of a bounded sample's pairs on each partition as it is; the estimate decides the cost and no result.

Copies collapse to one fingerprint before the search. Inside a bucket fingerprints are compared in
blocks of bounded size and only a spanning forest of the true links leaves a block, so a dense
group of n near copies yields O(n) rows per block pair and keeps every connection.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick
from .components import connected_components

BITS = 64
SHINGLE = 3
MAX_DISTANCE = 3
SEED = 42
#: Fingerprints of one bucket that are compared at once; larger buckets are split into pairs of blocks.
BLOCK = 2048
#: Fingerprints whose pairs' distances are counted for the estimate.
SAMPLE = 1024
#: What one probe row costs, in comparisons of two fingerprints; most probes of a value.
ROW_COST = 1000
MOST_PROBES = 1 << 12
#: Shingle hashes whose bits are counted at once, so that a very long text needs bounded memory.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned integer; no words or null: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined, h = b" ".join(tokens), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = starts + lengths
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : min(n, at + CHUNK)].tolist())
        hashes = np.array([h(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(each, "doc_id long, fp long")


def statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and a sample of SAMPLE of them at most, those with the smallest hash."""
    rows = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    return distinct.count(), np.array([r["fp"] for r in rows], np.int64)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width; each bit joins the open group it is most correlated with."""
    bits = _bits(sample) if len(sample) else np.zeros((1, BITS))
    p = bits.mean(axis=0)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((bits.T @ bits / len(bits) - np.outer(p, p)) / np.outer(sd, sd))
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = math.ceil(len(free) / (m - g))
        # Start from the bit that carries the most information among those left.
        first = min(free, key=lambda b: (abs(p[b] - 0.5), b))
        members = [first]
        free.discard(first)
        while len(members) < width:
            best = max(free, key=lambda b: (corr[b, members].sum(), -b))
            members.append(best)
            free.discard(best)
        groups.append(sorted(members))
    return groups


def distances(sample: np.ndarray, bits: list[int]) -> np.ndarray:
    """Share of pairs of fingerprints that differ in 0, 1, ... of these bits: the sample's histogram,
    with one pair's weight of what independent bits would give, so that no share is zero."""
    share = _bits(sample)[:, bits].mean(axis=0) if len(sample) else np.full(len(bits), 0.5)
    prior = np.ones(1)
    for d in 2 * np.clip(share, 0.01, 0.99) * (1 - np.clip(share, 0.01, 0.99)):
        prior = np.concatenate((prior * (1 - d), [0])) + np.concatenate(([0], prior * d))
    own = np.ascontiguousarray(sample & _signed(sum(1 << b for b in bits))).view(np.uint64)
    seen = np.zeros(len(bits) + 1)
    for i in range(len(own) - 1):
        seen += np.bincount(np.bitwise_count(own[i + 1 :] ^ own[i]), minlength=len(bits) + 1)
    return (seen + prior) / (seen.sum() + 1)


def radius(t: int) -> int:
    """Bits flipped on both sides so that values within ``t`` bits meet."""
    return (t + 1) // 2


def meetings(width: int, j: int, r: int) -> int:
    """Buckets that two values share that differ in ``j`` of ``width`` bits, each with its flips of up to ``r``."""
    return sum(math.comb(j, a) * math.comb(width - j, b) for a in range(j + 1) for b in range(width - j + 1) if a + b <= r and j - a + b <= r)


def ball(width: int, r: int) -> int:
    return sum(math.comb(width, j) for j in range(r + 1))


def candidate_pairs(n: int, width: int, shares: np.ndarray, t: int) -> float:
    """Expected comparisons in the buckets of one partition with threshold ``t``."""
    r = radius(t)
    return n * n / 2 * sum(shares[j] * meetings(width, j, r) for j in range(min(2 * r, width) + 1))


def allocate(n: int, sample: np.ndarray, groups: list[list[int]], k: int = MAX_DISTANCE) -> tuple[float, list[int]]:
    """Least estimated cost and thresholds with sum k - m + 1, by dynamic programming over partitions."""
    need = k - len(groups) + 1
    cost = []
    for bits in groups:
        shares, row = distances(sample, bits), {-1: 0.0}
        for t in range(min(k, len(bits)) + 1):
            rows = n * ball(len(bits), radius(t))
            if t and rows > n * MOST_PROBES:
                break
            row[t] = ROW_COST * rows + candidate_pairs(n, len(bits), shares, t)
        cost.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (c, ts) in best.items():
            for t, x in row.items():
                if (have + t) not in step or c + x < step[have + t][0]:
                    step[have + t] = (c + x, [*ts, t])
        best = step
    return best.get(need, (math.inf, []))


def plan_partitions(n: int, sample: np.ndarray, k: int = MAX_DISTANCE) -> list[tuple[list[int], int]]:
    """The cheapest (bits, threshold) list over two to k + 1 partitions."""
    plans = []
    for m in range(2, k + 2):
        groups = group_bits(sample, m)
        c, ts = allocate(n, sample, groups, k)
        plans.append((c, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def probes(distinct: DataFrame, k: int = MAX_DISTANCE) -> Column:
    """Array of the (part, value) buckets in which column fp meets all within k bits."""
    n, sample = statistics(distinct)
    found = []
    for i, (bits, t) in enumerate(plan_partitions(n, sample, k)):
        flips = [sum(1 << b for b in c) for d in range(radius(t) + 1) for c in itertools.combinations(bits, d)]
        value = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        found.append(F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), _probe(i, value)))
    return F.concat(*found)


def links(spark: SparkSession, distinct: DataFrame, k: int = MAX_DISTANCE) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (column fp) that connect all within k bits."""
    rows = distinct.select("fp", F.inline(probes(distinct, k)))
    sizes = rows.groupBy("part", "value").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    met = rows.join(sizes, ["part", "value"]).select("fp", "part", "value", blocks.alias("nb"))
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    other = F.explode(F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1)))
    met = met.select("fp", "part", "value", own.alias("own"), other.alias("other"))
    met = met.select("fp", "part", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    keys = ["part", "value", "a", "b"]
    found = met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(k), "src long, dst long")
    return found.distinct()


def _probe(part: int, value: Column):
    return lambda flip: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(flip).alias("value"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(k: int):
    """Streams rows sorted by bucket; holds one bucket block pair (at most some 2 * BLOCK rows) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_key = np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
        for b in batches:
            key = np.stack([b.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 4)], axis=1)
            fp, key = np.concatenate((held_fp, b.column(0).to_numpy())), np.concatenate((held_key, key))
            if not len(fp):
                continue
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from _emit(fp[:cut], key[:cut], k)
            held_fp, held_key = fp[cut:], key[cut:]
        yield from _emit(held_fp, held_key, k)

    return run


def _emit(fp: np.ndarray, key: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    if len(fp) < 2:
        return
    new = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    src, dst = [], []
    small = size[group] <= 64
    f, g = fp[small], group[small]
    for d in range(1, int(size[size <= 64].max(initial=1))):
        near = (g[d:] == g[:-d]) & (np.bitwise_count((f[d:] ^ f[:-d]).view(np.uint64)) <= k)
        src.append(f[:-d][near])
        dst.append(f[d:][near])
    for at in np.flatnonzero(size > 64):
        a, b = _forest(np.unique(fp[group == at]), k)
        src.append(a)
        dst.append(b)
    if src:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])


def _forest(fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fps``: breadth-first, one row of comparisons per node."""
    left, src, dst = np.ones(len(fps), bool), [], []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            x = todo.pop()
            near = np.flatnonzero(left)
            near = near[np.bitwise_count((fps[near] ^ fps[x]).view(np.uint64)) <= k]
            left[near] = False
            src.append(np.full(len(near), fps[x]))
            dst.append(fps[near])
            todo += near.tolist()
    return np.concatenate(src), np.concatenate(dst)


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = MAX_DISTANCE, words: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, n_copies of the same fingerprint.

    ``doc_id`` is an integer. Null and empty texts have fingerprint zero and link like any other; texts
    may be of any length. Repeated rows give repeated result rows; an empty table gives none. Further
    columns are not read. A component of null doc_ids alone has a null component_id.
    """
    fps = materialize(spark, fingerprints(docs, words), "simhash")
    distinct = materialize(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies")), "simhash-distinct")
    found = connected_components(spark, links(spark, distinct.select("fp"), k))
    labelled = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least", "n_copies", F.coalesce("component", "fp").alias("root")
    )
    labelled = materialize(spark, labelled, "simhash-labelled")
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = labelled.join(ids, "root").select("fp", "n_copies", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")
