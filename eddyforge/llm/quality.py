"""Quality rules: counts of words, symbols and repeats, then n-gram perplexity bands per language.

The model is an interpolated modified Kneser-Ney model of character 4-grams, one for each language (a
null language is one too) and half of the corpus. Documents are dealt into two halves by the hash of
their text and each is scored by the model of the other half, so that no text predicts itself, and
neither does an exact copy of it. Executors count their share, Spark sums the counts and derives the
lower orders' continuation counts; counts cover every character of every text and grow with the corpus.

A symbol is a code point. Only ASCII capitals, digits, spaces, stops and commas, the rules' symbols and
other ASCII marks share one symbol for each kind, which tells marked-up noise from prose better than the
marks themselves do; letters of every script stay themselves. A model is kept as sorted arrays of n-gram
hashes (64 bits: four symbols of 16, which is exact but for code points from 2**16 on, which share 6400
private numbers) beside their probabilities, and looked up by binary search. Arrays of at most SHARD_ROWS n-grams are broadcast
at once. A larger model is cut by the hash of an n-gram's two middle symbols and the texts are scored
part by part; the sums are the same.

A document is kept if the rules pass and its log-perplexity lies inside its language's band. The
lower and the upper half of a band each have their own width, a multiple of the median distance from
the median of the scores on that side, over all documents that pass the rules.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small

ORDER = 4
#: Symbols are 16 bits each.
SYMBOL = 16
SPACE = 1 << SYMBOL
#: A side of a band: WIDTH * 1.4826 * the median distance of that side's scores from the median.
WIDTH = 5.0
#: Groups of fewer documents have no spread of their own to go by: at least that of all groups together.
FEW = 20
#: Steps in which log-perplexity is compared.
STEP = 1e-3
SYMBOLS = "#*$%&|<>"
_TRIM = str.maketrans("", "", SYMBOLS)
#: Characters taken at once from a long text; n-grams held before they are counted or looked up;
#: distinct ones before they are passed on. All bound memory.
CHUNK = 1 << 18
HELD = 1 << 20
DISTINCT = 1 << 20
#: n-grams of one broadcast.
SHARD_ROWS = 4_000_000


def _fold() -> np.ndarray:
    """Symbol of each ASCII code point: kinds are named by one of their own."""
    out = np.arange(128, dtype=np.uint64)
    for c in range(128):
        ch = chr(c)
        if ch.isupper():
            out[c] = ord("A")
        elif ch.isdigit():
            out[c] = ord("0")
        elif c == 32 or 9 <= c <= 13:
            out[c] = ord(" ")
        elif ch in ".,":
            out[c] = ord(".")
        elif ch in SYMBOLS:
            out[c] = ord("#")
        elif not ch.isalpha():
            out[c] = ord("!")
    return out


_ASCII = _fold()


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the text's n-grams, one for each character, in bounded pieces; 0 pads the start."""
    tail = np.zeros(ORDER - 1, np.uint64)
    for at in range(0, len(text), CHUNK):
        cp = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        cp = np.where(cp < 128, _ASCII[np.minimum(cp, 127).astype(np.int64)], cp)
        s = np.concatenate((tail, np.where(cp < SPACE, cp, 0xE000 + cp % 6400)))
        tail, n = s[-(ORDER - 1) :], len(cp)
        out = s[:n]
        for k in range(1, ORDER):
            out = (out << np.uint64(SYMBOL)) | s[k : n + k]
        yield out


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.split()
    n = len(tokens)
    spaces = len(raw) - sum(map(len, tokens))  # single bytes, so also code points
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.encode("utf-8", "surrogatepass").split())
        else:
            seen.add(line)
    repeat = 0
    if n >= 3:
        number: dict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, tokens), np.int64, n)
        k = len(number)
        if k < 2_000_000:
            codes = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
            by = np.argsort(codes, kind="stable")
            ordered = codes[by]
            same = ordered[1:] == ordered[:-1]
            hit = np.zeros(n - 2, bool)
            hit[by[1:][same]] = hit[by[:-1][same]] = True
        else:
            rows = np.stack((ids[:-2], ids[1:-1], ids[2:]), axis=1)
            _, inverse, found = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            hit = found[inverse.ravel()] > 1
        cover = np.zeros(n, bool)
        cover[:-2] |= hit
        cover[1:-1] |= hit
        cover[2:] |= hit
        repeat = int(cover.sum())
    return n, len(text) - spaces, len(text) - len(text.translate(_TRIM)), dup, repeat


def _group() -> Column:
    """A language's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def _half() -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")


def _rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row, grp, half, text), ``row`` holding the columns to keep, whatever their names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _group().alias("grp"), _half().alias("half"), "text")


def count_ngrams(docs: DataFrame) -> DataFrame:
    """Rows (grp, half, gram, n) over all characters of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = defaultdict(list)
        done: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def fold() -> None:
            for k, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                if k in done:
                    g, n = np.concatenate((done[k][0], g)), np.concatenate((done[k][1], n))
                    g, back = np.unique(g, return_inverse=True)
                    n = np.bincount(back.ravel(), n).astype(np.int64)
                done[k] = g, n
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for (grp, half), (g, n) in done.items():
                names = pa.DictionaryArray.from_arrays(np.zeros(len(g), np.int32), pa.array([grp])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(g), half, np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["grp", "half", "gram", "n"])
            done.clear()

        for b in batches:
            for grp, half, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for grams in ngrams(text.as_py() or ""):
                    held[grp, half].append(grams)
                    size += len(grams)
                    if size > HELD:
                        fold()
                        size = 0
                        if sum(len(g) for g, _ in done.values()) > DISTINCT:
                            yield from flush()
        fold()
        yield from flush()

    parts = docs.select(_group().alias("grp"), _half().alias("half"), "text").mapInArrow(run, "grp string, half int, gram long, n long")
    return parts.groupBy("grp", "half", "gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more (Chen and Goodman 1999)."""
    n1, n2, n3, n4 = (max(1, x) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.1, 0.2, 0.3], [0, 1, 2, 3])


@dataclass
class Model:
    """By order from 1: sorted n-gram hashes with their discounted share, sorted contexts with the
    weight that goes to the lower order."""

    grams: list[np.ndarray]
    shares: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    @classmethod
    def of(cls, levels: dict[int, tuple[np.ndarray, np.ndarray]], by_count: dict[int, np.ndarray]) -> Model:
        """``levels``: by order, n-gram hashes and (continuation) counts; ``by_count``: discounts."""
        out = cls([], [], [], [])
        for order in range(1, ORDER + 1):
            g, c = levels.get(order, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            by = np.argsort(g)
            g, c = g[by], c[by].astype(np.float64)
            d = by_count[order][np.minimum(c, 3).astype(np.int64)] if len(g) else c
            context, first = np.unique(g >> np.uint64(SYMBOL), return_index=True)
            total = np.add.reduceat(c, first) if len(g) else c
            size = np.diff(np.append(first, len(g)))
            out.grams.append(g)
            out.shares.append((np.maximum(c - d, 0) / np.repeat(total, size)).astype(np.float32))
            out.contexts.append(context)
            out.weights.append((np.add.reduceat(d, first) / total if len(g) else c).astype(np.float32))
        return out

    def probability(self, tokens: np.ndarray) -> np.ndarray:
        """P of the last symbol of each (sorted) n-gram hash after the others."""
        p = np.full(len(tokens), 1.0 / SPACE)
        for order in range(1, ORDER + 1):
            own = tokens & np.uint64((1 << SYMBOL * order) - 1) if order < ORDER else tokens
            share = _look_up(self.grams[order - 1], self.shares[order - 1], own, 0.0)
            p = share + _look_up(self.contexts[order - 1], self.weights[order - 1], own >> np.uint64(SYMBOL), 1.0) * p
        return p


def _look_up(keys: np.ndarray, values: np.ndarray, want: np.ndarray, absent: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(want), absent)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], absent).astype(np.float64)


def shard_of(middle: np.ndarray, shards: int) -> np.ndarray:
    """Part of a model by the two middle symbols as a 32-bit number; ``_shard_column`` says the same."""
    return ((middle * np.uint64(40503)) >> np.uint64(12)) % np.uint64(shards)


def _shard_column(middle: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(middle * 40503, 12), F.lit(shards))


@dataclass
class Trained:
    """The counts of all orders as a table, the discounts, and the number of parts to score in."""

    table: DataFrame
    by_count: dict[tuple[str, int], dict[int, np.ndarray]]
    shards: int

    def part(self, shard: int) -> dict[tuple[str, int], Model]:
        """Models by (language key, half of the documents they score); bounded by SHARD_ROWS and the
        lowest two orders, whose n-grams every part has."""
        t = self.table
        if self.shards > 1:
            middle = F.shiftright("gram", SYMBOL).bitwiseAND(F.lit((1 << 2 * SYMBOL) - 1))
            t = t.where((F.col("ord") <= 2) | (_shard_column(middle, self.shards) == shard))
        rows = t.select("grp", "half", "ord", "gram", "n").toArrow()
        if not rows.num_rows:
            return {}
        keys = rows.column("grp").combine_chunks().dictionary_encode()
        names, code = keys.dictionary.to_pylist(), keys.indices.to_numpy()
        half, order, gram, n = (rows.column(c).to_numpy() for c in ("half", "ord", "gram", "n"))
        label = (code.astype(np.int64) * 2 + half) * (ORDER + 1) + order
        by = np.argsort(label, kind="stable")
        found, first = np.unique(label[by], return_index=True)
        levels: dict[tuple[str, int], dict[int, tuple[np.ndarray, np.ndarray]]] = defaultdict(dict)
        for x, at in zip(found.tolist(), np.split(by, first[1:])):
            levels[names[x // (2 * (ORDER + 1))], x // (ORDER + 1) % 2][x % (ORDER + 1)] = gram[at].view(np.uint64), n[at]
        return {(grp, 1 - h): Model.of(own, self.by_count[grp, h]) for (grp, h), own in levels.items()}


def train(spark: SparkSession, docs: DataFrame, shard_rows: int = SHARD_ROWS) -> Trained:
    """Counts of the n-grams, and for each lower order the distinct symbols to the left, all by Spark."""
    level = materialize(spark, count_ngrams(docs), "quality-counts").select("grp", "half", F.lit(ORDER).alias("ord"), "gram", "n")
    table = level
    for order in range(ORDER - 1, 0, -1):
        level = level.groupBy("grp", "half", F.col("gram").bitwiseAND(F.lit((1 << SYMBOL * order) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        level = materialize(spark, level.select("grp", "half", F.lit(order).alias("ord"), "gram", "n"), "quality-counts")
        table = table.unionByName(level)
    sizes = table.groupBy("grp", "half", "ord").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("n") == c).alias(f"n{c}") for c in (1, 2, 3, 4)]).collect()  # eight rows a language
    by_count: dict[tuple[str, int], dict[int, np.ndarray]] = defaultdict(dict)
    for r in sizes:
        by_count[r["grp"], r["half"]][r["ord"]] = discounts(r["n1"], r["n2"], r["n3"], r["n4"])
    rows = sum(r["rows"] for r in sizes)
    return Trained(table, dict(by_count), max(1, -(-rows // shard_rows)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _score_part(spark: SparkSession, rows: DataFrame, trained: Trained, shard: int, base: bool) -> DataFrame:
    """(row, grp, counts if ``base``, total, n_chars): total -ln P of the part's n-grams; null without a model."""
    shared, shards = spark.sparkContext.broadcast(trained.part(shard)), trained.shards
    counts = COUNTS if base else ()
    schema = f"row {rows.schema['row'].dataType.simpleString()}, grp string, {''.join(f'{c} long, ' for c in counts)}total double, n_chars long"
    names = ["row", "grp", *counts, "total", "n_chars"]

    def add(totals: np.ndarray, key: tuple[str, int], pieces: list[tuple[int, np.ndarray]]) -> None:
        model = shared.value.get(key)
        if model is None:
            return
        tokens, back = np.unique(np.concatenate([g for _, g in pieces]), return_inverse=True)
        minus = -np.log(model.probability(tokens))
        if shards > 1:
            minus[shard_of((tokens >> np.uint64(SYMBOL)) & np.uint64((1 << 2 * SYMBOL) - 1), shards) != shard] = 0
        edges = np.concatenate(([0], np.cumsum([len(g) for _, g in pieces])[:-1]))
        np.add.at(totals, [i for i, _ in pieces], np.add.reduceat(minus[back.ravel()], edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals, sizes = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            known, found = np.zeros(b.num_rows, bool), []
            held: dict[tuple[str, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
            size: dict[tuple[str, int], int] = defaultdict(int)
            for i, (grp, half, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3))):
                text, key = text.as_py() or "", (grp, half)
                sizes[i], known[i] = len(text), key in shared.value
                if base:
                    found.append(base_counts(text))
                for grams in ngrams(text):
                    held[key].append((i, grams))
                    size[key] += len(grams)
                    if size[key] > HELD:
                        add(totals, key, held.pop(key))
                        size[key] = 0
            for key, pieces in held.items():
                add(totals, key, pieces)
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64()) for _ in counts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array(totals, mask=~known), pa.array(sizes)], names=names)

    return rows.mapInArrow(run, schema)


def score(spark: SparkSession, docs: DataFrame, trained: Trained, keep: list[str]) -> DataFrame:
    """(row, grp, rule counts, log_ppl): the mean -ln P a character of every whole text, null for a text
    without characters or one whose language has no model in the other half."""
    rows = _rows(docs, keep)
    if trained.shards > 1:  # rows get a number that stays, and each part's sums are added up by it
        rows = rows.select(F.struct("row", F.monotonically_increasing_id().alias("number")).alias("row"), "grp", "half", "text")
        rows = materialize(spark, rows, "quality-rows")
    out = _score_part(spark, rows, trained, 0, True)
    if trained.shards > 1:
        out = materialize(spark, out, "quality-part")
        narrow = rows.select(F.struct("row.number").alias("row"), "grp", "half", "text")
        sums = out.select("row.number", "total")
        for shard in range(1, trained.shards):
            part = materialize(spark, _score_part(spark, narrow, trained, shard, False), "quality-part")
            sums = sums.unionByName(part.select("row.number", "total"))
        sums = sums.groupBy("number").agg(F.sum("total").alias("total"))
        out = out.drop("total").withColumn("number", F.col("row.number")).join(sums, "number").withColumn("row", F.col("row.row"))
    return out.select("row", "grp", *COUNTS, F.when(F.col("n_chars") > 0, F.col("total") / F.col("n_chars")).alias("log_ppl"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(scored: DataFrame, width: float = WIDTH) -> DataFrame:
    """(grp, lower, upper): log-perplexity limits of each language, from all scores that pass the rules."""
    ok = scored.where("log_ppl is not null").where(~base_failed()).select("grp", F.round(F.col("log_ppl") / STEP).cast("int").alias("bin"))
    # Bins are whole numbers below 28 / STEP, so an exact median holds that many counts at most.
    middle = lambda x: F.expr(f"percentile_disc(0.5) within group (order by {x})")
    mid = ok.groupBy("grp").agg(middle("bin").alias("mid"), F.count(F.lit(1)).alias("docs"))
    off = ok.join(small(materialize(scored.sparkSession, mid, "quality-middles")), "grp").withColumn("off", F.col("bin") - F.col("mid"))
    low, high = middle("case when off <= 0 then -off end"), middle("case when off >= 0 then off end")
    pooled = off.agg(low.alias("all_low"), high.alias("all_high"))
    sides = off.groupBy("grp").agg(low.alias("low"), high.alias("high"), F.first("mid").alias("mid"), F.first("docs").alias("docs")).crossJoin(F.broadcast(pooled))  # one row
    half = lambda own, all_: F.greatest(width * 1.4826 * F.greatest(own, F.when(F.col("docs") < FEW, F.col(all_)).otherwise(0)), F.lit(1.0)) * STEP
    return sides.select("grp", (F.col("mid") * STEP - half("low", "all_low")).alias("lower"), (F.col("mid") * STEP + half("high", "all_high")).alias("upper"))


def judged(spark: SparkSession, scored: DataFrame, width: float) -> DataFrame:
    """Scored rows with base_failed, kept, lower, upper. ``scored`` should be a table that is written."""
    limits = small(materialize(spark, bands(scored, width), "quality-bands"))
    out = scored.join(limits, "grp", "left").withColumn("base_failed", base_failed())
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def assess(spark: SparkSession, docs: DataFrame, width: float = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, log_ppl, lower, upper.

    Null and empty texts have no words and fail. Each value of lang has its own model and band, null
    too; a text whose language has no other texts has a null log_ppl, and the rules alone decide. A
    score on a limit is inside it. Texts may be of any length. Repeated rows give repeated result rows;
    an empty table gives none. Further columns are not read.
    """
    trained = train(spark, docs, shard_rows)
    scored = materialize(spark, score(spark, docs, trained, ["doc_id"]), "quality")
    out = judged(spark, scored, width)
    return out.select("row.doc_id", *COUNTS, "base_failed", "kept", "log_ppl", "lower", "upper")


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that ``assess`` keeps, all columns, whatever their names; its cases hold. Rows are written
    once with their scores and then filtered, so that no text is shuffled."""
    trained = train(spark, docs)
    scored = materialize(spark, score(spark, docs, trained, docs.columns), "quality-docs")
    return judged(spark, scored, WIDTH).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
