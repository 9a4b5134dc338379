"""Near copies for a corpus: SimHash finds candidates, the exact similarity of word shingles decides.

Fingerprints within DISTANCE bits meet by the generalised pigeonhole search of ``simhash``. Two texts
are near copies if the sets of their runs of WORDS words have a Jaccard index of PERCENT hundredths or
more; texts of equal words collapse to one before that.

SimHash turns a Jaccard index J into an angle, so the distance needed for J = 0.8 is wide (see README
for what it catches), and in a large corpus it leads from almost any text to any other. Each text
therefore carries a min-hash sketch of its set into the buckets, and a pair that meets counts as a
candidate only if LEVELS[0] of its SKETCH positions agree. A pair at J = 0.8 agrees in 51 on average;
it falls below 36 about once in a hundred thousand.

Spanning forests of the candidates leave a bucket, one at each level of agreement, so a dense cluster
makes linear rows and its truest links are among them. The forests connect texts into groups; their
links are checked on the sets, and what holds connects texts into components. Pairs of one group and
different components are then compared in blocks, so that no link is lost to the choice of a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, pick
from .components import connected_components

WORDS = 5
#: Least similarity in hundredths, so that the comparison is exact.
PERCENT = 80
#: Bits in which fingerprints of PRINT_WORDS-word shingles of a candidate pair may differ.
DISTANCE = 10
PRINT_WORDS = 3
#: Texts of a bucket that are compared at once; larger ones are split into pairs of blocks.
BLOCK = 1 << 15
#: The same for the join of a group's texts, whose blocks are dealt over tasks.
GROUP_BLOCK = 1024
#: Positions of a sketch, and how many have to agree, from all candidates to the likeliest.
SKETCH = 64
LEVELS = (36, 46, 54)
#: Numbers compared in one step, shingles sketched in one step.
TILE = 1 << 17
_TURNS = np.array([xxhash.xxh64_intdigest(bytes([i]), simhash.SEED) | 1 for i in range(SKETCH)], np.uint64)
#: A text in a bucket: ``second`` marks the second block of a pair of blocks.
_MET = np.dtype([("key", "<i8", (4,)), ("second", "?"), ("id", "<i8"), ("fp", "<u8"), ("sketch", "u1", (SKETCH,))])


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words (of all words, if fewer); none for no words."""
    w = tokens(text)
    if not w:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    last = (starts + lengths)[min(words, len(w)) - 1 :]
    return np.unique(np.array([h(joined[a:b], simhash.SEED) for a, b in zip(starts.tolist(), last.tolist())], np.uint64))


def key_of(text: str | None) -> bytes:
    """128 bits of the words in their order: equal ones have equal sets."""
    return xxhash.xxh128_digest(b" ".join(tokens(text)))


def sketch(hashes: np.ndarray) -> bytes:
    """One byte of the least hash under each of SKETCH orders; zeros for an empty set."""
    least = np.full(SKETCH, ~np.uint64(0) if len(hashes) else 0, np.uint64)
    for at in range(0, len(hashes), TILE // SKETCH):
        least = np.minimum(least, (hashes[at : at + TILE // SKETCH, None] * _TURNS).min(axis=0))
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, fp, sketch) of rows with a doc_id; the sketch is of runs of ``words`` words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            fps = np.array([simhash.fingerprint(t, PRINT_WORDS) for t in texts], np.uint64).view(np.int64)
            made = [b.column(0), pa.array(map(key_of, texts), pa.binary()), pa.array(fps), pa.array([sketch(shingles(t, words)) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "key", "fp", "sketch"])

    return pick(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(each, "doc_id long, key binary, fp long, sketch binary")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """(key, hashes), ``hashes`` being the set of shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(0)]
            found = pa.array([shingles(t, words).view(np.int64) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, texts), pa.binary()), found], names=["key", "hashes"])

    return docs.select("text").mapInArrow(each, "key binary, hashes array<long>")


def _alike(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of ids whose sets have an index of ``percent`` hundredths or more."""
    left = known.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    right = known.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    met = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("ha", "hb"))
    met = met.select("a", "b", both.alias("both"), (F.size("ha") + F.size("hb")).alias("all"))
    return met.where(F.col("both") * 100 >= (F.col("all") - F.col("both")) * percent).select("a", "b")


def links(texts: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of ids that connect all candidates among ``texts`` (id, fp, sketch)."""
    rows = texts.select("id", "fp", "sketch", F.inline(simhash.probes(texts, k)))
    sizes = rows.groupBy("part", "value").count().where("count > 1")
    met = rows.join(sizes.select("part", "value", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb")), ["part", "value"])
    own, other = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    met = met.select("part", "value", "id", "fp", "sketch", own, other)
    keys = ["part", "value", "x", "y"]
    met = met.select("part", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.expr("own > other"), "id", "fp", "sketch")
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(k), "a long, b long").distinct()


def _compare(k: int):
    """Streams rows sorted by bucket; holds one bucket's pair of blocks (some 2 * BLOCK rows) and a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, _MET)
        for b in batches:
            if not b.num_rows:
                continue
            now = np.zeros(b.num_rows, _MET)
            for i in range(4):
                now["key"][:, i] = b.column(i).to_numpy()
            now["second"] = b.column(4).to_numpy(zero_copy_only=False)
            now["id"], now["fp"] = b.column(5).to_numpy(), b.column(6).to_numpy().view(np.uint64)
            now["sketch"] = _marks(b.column(7))
            if len(held) and (held["key"][-1] == now["key"][-1]).all():
                held = np.concatenate((held, now))
                continue
            rows = np.concatenate((held, now))
            cut = int(np.flatnonzero((rows["key"] != rows["key"][-1]).any(axis=1)).max(initial=-1)) + 1
            yield from _emit(rows[:cut], k)
            held = rows[cut:]
        yield from _emit(held, k)

    return run


def _emit(rows: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    if len(rows) < 2:
        return
    key, fp = np.ascontiguousarray(rows["key"]), np.ascontiguousarray(rows["fp"])
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
    size = np.diff(np.append(starts, len(rows)))
    bucket = np.repeat(np.arange(len(starts)), size)
    flags = np.zeros(len(rows), bool)
    # Small buckets at once, each text against those after it; large ones by themselves.
    at = np.flatnonzero(size[bucket] <= 64)
    f, g = fp[at], bucket[at]
    for d in range(1, int(size[size <= 64].max(initial=1))):
        near = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= k))
        flags[at[near]] = flags[at[near + d]] = True
    for i in np.flatnonzero(size > 64):
        span = slice(starts[i], starts[i] + size[i])
        second = rows["second"][span] if key[starts[i], 2] != key[starts[i], 3] else None
        flags[span] = _partnered(fp[span], second, k)
    left = np.flatnonzero(flags)
    left = left[np.lexsort((rows["id"][left], bucket[left]))]
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for members in np.split(left, np.flatnonzero(np.diff(bucket[left])) + 1):
        if len(members) > 1:
            m = rows[members]
            for x, found in _forests(np.ascontiguousarray(m["fp"]), np.ascontiguousarray(m["sketch"]), np.arange(len(m)), k, LEVELS):
                src.append(np.full(len(found), m["id"][x]))
                dst.append(m["id"][found])
    a, b = np.concatenate(src), np.concatenate(dst)
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _partnered(fp: np.ndarray, second: np.ndarray | None, k: int) -> np.ndarray:
    """Which fingerprints have another within k bits: any other, or one of the other block."""
    if second is not None:
        flags, one, two = np.zeros(len(fp), bool), np.flatnonzero(~second), np.flatnonzero(second)
        step = max(1, TILE // max(1, len(two)))
        for at in range(0, len(one), step):
            hit = np.bitwise_count(fp[one[at : at + step], None] ^ fp[two]) <= k
            flags[one[at : at + step]] |= hit.any(axis=1)
            flags[two] |= hit.any(axis=0)
        return flags
    flags, step = np.zeros(len(fp), bool), max(1, TILE // len(fp))
    for at in range(0, len(fp), step):
        hit = np.bitwise_count(fp[at : at + step, None] ^ fp[at:]) <= k
        np.fill_diagonal(hit, False)
        flags[at : at + step] |= hit.any(axis=1)
        flags[at:] |= hit.any(axis=0)
    return flags


def _forests(fp: np.ndarray, marks: np.ndarray, members: np.ndarray, k: int, levels: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the candidates at levels[0], and of each of its trees those of the further levels."""
    while len(members) > 1:
        tree, todo, members = [members[:1]], [int(members[0])], members[1:]
        while todo and len(members):
            x = todo.pop()
            near = np.flatnonzero(np.bitwise_count(fp[members] ^ fp[x]) <= k)
            near = near[(marks[members[near]] == marks[x]).sum(axis=1) >= levels[0]]
            if len(near):
                found, members = members[near], np.delete(members, near)
                tree.append(found)
                todo += found.tolist()
                yield x, found
        if len(tree) > 1 and levels[1:]:
            yield from _forests(fp, marks, np.sort(np.concatenate(tree)), k, levels[1:])


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those pairs (a, b) whose sketches make them candidates."""
    for b in batches:
        yes = pa.array((_marks(b.column(2)) == _marks(b.column(3))).sum(axis=1) >= LEVELS[0])
        yield pa.RecordBatch.from_arrays([b.column(0).filter(yes), b.column(1).filter(yes)], names=["a", "b"])


def components(spark: SparkSession, edges: DataFrame, known: DataFrame, percent: int, k: int) -> DataFrame:
    """(id, component) of the ends of ``edges`` (a, b): the least id that near copies among those that
    edges connect lead to; ``known`` holds (id, fp, sketch, hashes)."""
    sure = materialize(spark, _alike(edges, known, percent), "near-sure")
    of = lambda pairs, name: connected_components(spark, pairs, "a", "b").select(F.col("node").alias("id"), F.col("component").alias(name))
    label = of(edges, "grp").join(of(sure, "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    label = label.join(known.select("id", "fp", "sketch", F.size("hashes").cast("long").alias("n")), "id")
    label = materialize(spark, label.select("grp", "id", "n", "fp", "sketch", "component"), "near-labelled")
    mixed = label.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).where("low != high")
    some = label.join(mixed.select("grp", F.ceil(F.col("members") / GROUP_BLOCK).cast("int").alias("nb")), "grp")
    own = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    x = some.select("grp", own.alias("p"), others.alias("q"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("fp").alias("fa"), F.col("sketch").alias("sa"), F.col("component").alias("ca"))
    y = some.select("grp", others.alias("p"), own.alias("q"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("fp").alias("fb"), F.col("sketch").alias("sb"), F.col("component").alias("cb"))
    # Sizes too far apart can't be similar.
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    near = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= k)
    rest = x.join(y, ["grp", "p", "q"]).where(near).select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long")
    rest = rest.distinct().join(edges, ["a", "b"], "left_anti")
    rest = materialize(spark, _alike(rest, known, percent), "near-rest")
    both = label.select("id", "component")
    rest = rest.join(both.select(F.col("id").alias("a"), F.col("component").alias("u")), "a").join(both.select(F.col("id").alias("b"), F.col("component").alias("v")), "b")
    found = connected_components(spark, rest.select("u", "v").distinct(), "u", "v").select(F.col("node").alias("component"), F.col("component").alias("root"))
    return both.join(found, "component", "left").select("id", F.coalesce("root", "component").alias("component"))


def near_copies(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, words: int = WORDS, k: int = DISTANCE) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id of each row's group of near copies, itself included.

    ``doc_id`` is an integer; rows without one aren't in the result. Null and empty texts are copies of
    one another. Repeated rows give repeated rows; an empty table gives none. Texts may be of any length.
    """
    rows = materialize(spark, prints(docs, words), "near")
    texts = rows.groupBy("key", "fp", "sketch").agg(F.min("doc_id").alias("first")).withColumn("id", F.monotonically_increasing_id())
    texts = materialize(spark, texts, "near-texts")  # written once, so an id stays
    edges = materialize(spark, links(texts, k), "near-links")
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    members = materialize(spark, texts.join(ends, "id", "left_semi").select("id", "key", "fp", "sketch", "first"), "near-members")
    own = pick(docs, "doc_id", "text").join(members.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    known = sets(own, words).join(members.select("id", "key", "fp", "sketch"), "key").select("id", "fp", "sketch", "hashes").dropDuplicates(["id"])
    known = materialize(spark, known, "near-sets")
    found = components(spark, edges, known, percent, k)
    labelled = texts.join(found, "id", "left").select("key", "first", F.coalesce("component", "id").alias("root"))
    labelled = materialize(spark, labelled, "near-found")
    firsts = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    keyed = labelled.join(firsts, "root").select("key", "component_id")
    return rows.select("doc_id", "key").join(keyed, "key").select("doc_id", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, words: int = WORDS, k: int = DISTANCE) -> DataFrame:
    """Documents without near copies: of each group the row with the smallest doc_id stays.

    Rows that repeat the smallest doc_id all stay; rows with a null doc_id stay and send none away. The
    other cases are those of ``near_copies``; further columns stay as they are, whatever their names.
    """
    found = materialize(spark, near_copies(spark, docs, percent, words, k), "near-copies")
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    gone = gone.join(found.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    gone = materialize(spark, gone.select(F.struct("doc_id").alias("gone_row")), "near-gone")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = own.join(gone, F.col("row").getField("doc_id") == F.col("gone_row.doc_id"), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
