"""Language identification with a string kernel.

The kernel of two texts blends the spectra of n-gram lengths 1 to 3: for each length, the number of
n-grams present in both over the geometric mean of the numbers present in each. Nyström landmarks
give every text a short feature vector, and kernel ridge regression fits one scorer per language
against the rest. The n-grams are hashed to a fixed number of cells, so the landmarks' side of the
product folds into one weight matrix (cells x languages), and a batch of texts is scored by one
matrix product.

The classifier is fitted on a documented sample of labelled rows: a language's rows whose hash lies in
the share that makes PER_LANG of them expected (all, if it has fewer). Counting rows by language is all
that this needs, so no language's rows meet in one task. The sample stays with the executors: the driver gets the landmarks'
n-grams and, for the regression, sums of products of features with one another and for each language.
Prediction reads every whole text and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, small

#: Training rows expected of a language, landmarks of all languages.
PER_LANG = 400
LANDMARKS = 256
RIDGE = 1e-3
#: Hash cells of n-grams of length 1, 2, 3.
CELLS = (1024, 8192, 32768)
WIDTH = sum(CELLS)
#: Texts scored by one product; characters taken at once from a long text.
BATCH = 128
CHUNK = 1 << 20
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def presence(text: str) -> np.ndarray:
    """The numbers of the cells that the text's lower-cased n-grams fall in, ascending."""
    mark = np.zeros(WIDTH, bool)
    tail = ""
    for at in range(0, len(text), CHUNK):
        piece = tail + text[at : at + CHUNK].lower()
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        mark[c % CELLS[0]] = True
        if len(c) > 1:
            mark[CELLS[0] + _cell(c[:-1] * 1114112 + c[1:], CELLS[1])] = True
        if len(c) > 2:
            mark[CELLS[0] + CELLS[1] + _cell((c[:-2] * 2097169 + c[1:-1]) * 2097169 + c[2:], CELLS[2])] = True
        tail = piece[-2:]
    return np.flatnonzero(mark)


def _cell(code: np.ndarray, cells: int) -> np.ndarray:
    mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(cells)).astype(np.int64)


def features(rows: list[np.ndarray]) -> np.ndarray:
    """Rows whose dot products are the kernel's values."""
    x = np.zeros((len(rows), WIDTH), np.float32)
    edge = np.cumsum((0, *CELLS))
    for i, at in enumerate(rows):
        cut = np.searchsorted(at, edge)
        for a, b in zip(cut, cut[1:]):
            if b > a:
                x[i, at[a:b]] = 1 / np.sqrt(len(CELLS) * (b - a))
    return x


def whitening(z: np.ndarray) -> np.ndarray:
    """Landmarks' kernel to the power of -1/2, on the part that isn't null."""
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-8 * values.max()
    return vectors[:, good] / np.sqrt(values[good])


def embed(rows: list[np.ndarray], z: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    """Nyström features of texts, and a one for the offset."""
    phi = (features(rows) @ z.T).astype(np.float64) @ whiten
    return np.hstack([phi, np.ones((len(phi), 1))])


def solve(gram: np.ndarray, sums: np.ndarray, n: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights (features x languages) of one-versus-rest ridge regression on targets 1 and -1.

    ``gram``: features' products summed over the rows; ``sums``: features summed over each language's
    rows. The offset isn't shrunk.
    """
    size = len(gram)
    target = 2 * sums.T - gram[:, -1:]  # the offset's column of the products is the sum over all rows
    return np.linalg.solve(gram + ridge * n * np.diag([1.0] * (size - 1) + [0.0]) + 1e-9 * np.eye(size), target)


def fit(spark: SparkSession, sample: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray] | None:
    """Names and weights (cells x languages) from rows (lang, k, cells); None without rows."""
    # ``k`` is a row's expected rank in its language, so the first ones are of all languages alike.
    chosen = sample.orderBy("k", "lang").limit(landmarks).collect()
    if not chosen:
        return None
    z = features([np.array(r["cells"]) for r in chosen])
    whiten = whitening(z)
    shared = spark.sparkContext.broadcast((z, whiten))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, whiten = shared.value
        size = whiten.shape[1] + 1
        gram, sums, n = np.zeros((size, size)), {}, 0
        for b in batches:
            langs = b.column(0).to_pylist()
            for at in range(0, b.num_rows, BATCH):
                phi = embed([np.array(c.as_py()) for c in b.column(1)[at : at + BATCH]], z, whiten)
                gram, n = gram + phi.T @ phi, n + len(phi)
                for lang, x in zip(langs[at:], phi):
                    sums[lang] = sums.get(lang, 0) + x
        rows = [(None, gram.ravel())] + list(sums.items()) if n else []
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float64()))], names=["lang", "x"])

    parts = sample.select("lang", "cells").mapInArrow(products, "lang string, x array<double>")
    cells = parts.select("lang", F.posexplode("x").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    cells = cells.collect()  # (landmarks + 1) squared, and landmarks + 1 for each language
    size = whiten.shape[1] + 1
    gram, names = np.zeros(size * size), sorted({r["lang"] for r in cells if r["lang"] is not None})
    number, sums = {k: i for i, k in enumerate(names)}, np.zeros((len(names), size))
    for r in cells:
        if r["lang"] is None:
            gram[r["i"]] = r["x"]
        else:
            sums[number[r["lang"]], r["i"]] = r["x"]
    weights = solve(gram.reshape(size, size), sums, round(gram[-1]), ridge)
    return names, np.vstack([z.T @ (whiten @ weights[:-1]), weights[-1:]]).astype(np.float32)


def held_out() -> Column:
    """crc32(doc_id as text) mod 3 = 1; rows without an id are held out too, so never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Rows (lang, k, cells) to learn from, ``per_lang`` expected of a language; rows of one doc_id and
    text go together. ``k`` is a row's hash in the unit interval times the rows of its language."""
    rows = pick(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40))
    sizes = small(materialize(docs.sparkSession, rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "language-sizes"))
    few = rows.join(sizes, "lang").withColumn("k", F.col("u") * F.col("size")).where(F.col("k") < per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [presence(t.as_py()).tolist() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cells, pa.list_(pa.int32()))], names=["lang", "k", "cells"])

    return few.select("lang", "text", "k").mapInArrow(run, "lang string, k double, cells array<int>")


def identify(spark: SparkSession, docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    ``doc_id`` is an integer. Null texts and texts without a letter are ``und`` with score 0, and so is
    every text if there is nothing to learn from. Of languages with the same score the first by name is
    taken. Texts may be of any length. Repeated rows give repeated result rows, and equal texts equal
    predictions; an empty table gives no rows. Further columns are not read.
    """
    model = fit(spark, materialize(spark, training_sample(docs, per_lang), "language-sample"), landmarks)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, best = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for at in range(0, b.num_rows, BATCH):
                texts = [t.as_py() for t in b.column(2)[at : at + BATCH]]
                some = [i for i, t in enumerate(texts) if has_letter(t)]
                if shared.value is None or not some:
                    continue
                names, weights = shared.value
                f = features([presence(texts[i]) for i in some]) @ weights[:-1] + weights[-1]
                top = f.argmax(axis=1)
                for i, k, v in zip(some, top, f.max(axis=1)):
                    pred[at + i], best[at + i] = names[k], min(1.0, max(0.0, (float(v) + 1) / 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred), pa.array(best)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
