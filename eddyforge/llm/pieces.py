"""SentencePiece encoding and decoding over a relational lattice.

Words (a run of the space mark and what follows up to the next one; pieces never reach across) become
a lattice: every substring of bounded length, equi-joined to the piece table, gives an edge, and the
edges of a word are grouped and folded with a higher-order aggregate. The fold depends on the model:

* unigram: Viterbi, the path of greatest total score;
* BPE: the edges in order of score (then position) each join two symbols that lie exactly in it. For
  a vocabulary made by merges this one pass gives what merging pair by pair gives, where Viterbi over
  the merge ranks would not.

The most frequent words of the corpus (a bounded number) are encoded once by that relational plan and
their table is broadcast. The long tail of other words is encoded where its document is read, by the
same lattice and fold over one word (``Encoder``), so no text is shuffled; sending the tail through
the relational plan gave the same ids at several times the limits for time and disk. Which words
count as frequent changes the cost and no result.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick

#: Words that are encoded once for all documents.
FREQUENT = 1 << 18
#: Words a task counts before it passes its counts on; bounds its memory.
HELD_WORDS = 300_000
#: Other words that a task remembers; when full, it starts anew.
REMEMBERED = 200_000
#: Documents of a batch taken at once.
SLICE = 200
#: Words of up to so many code points are folded in one machine word.
SHORT = 62
MARK, NUL = "▁", "\0"
NEWLINE = NUL + "\n"
UNIGRAM, BPE = 1, 2
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


@dataclass(frozen=True)
class Model:
    """Pieces by id: text, score, and whether it is matched in text; byte ids; kind of model."""

    kind: int
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    prefix: bool

    @property
    def longest(self) -> int:
        return max(len(p) for p, n in zip(self.pieces, self.normal) if n)


def load(path: str) -> Model:
    """A model file whose normaliser is the identity (as that of piece_bpe_32k.model is)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with an identity normaliser are supported")
    by = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 6}
    bytes_ = tuple(by.get(f"<0x{b:02X}>", -1) for b in range(256)) if by else ()
    unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
    return Model(m.trainer_spec.model_type, tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(p.type in (1, 4) for p in m.pieces), bytes_, unknown, m.normalizer_spec.add_dummy_prefix)


def split_words(text: str, prefix: bool) -> list[str]:
    """Words with their space marks; a newline is a word by itself."""
    return [word_of(k) for k in split_keys(text, prefix)]


def key_of(word: str) -> str:
    """Nearly every word has one space mark in front; its key is the word without it. Keys of all other
    words begin with a NUL, so no two words share a key."""
    return word[1:] if len(word) > 1 and word[0] == MARK and word[1] not in (MARK, NUL) else NUL + word


def word_of(key: str) -> str:
    return key[1:] if key[0] == NUL else MARK + key


def split_keys(text: str, prefix: bool) -> list[str]:
    """Keys of the text's words, in order."""
    out: list[str] = []
    if not text:
        return out
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append(NEWLINE)
        lead = prefix and not k
        if "  " in line or MARK in line or NUL in line or line.endswith(" ") or (lead and line[:1] in ("", " ")):
            out += map(key_of, _WORD.findall((MARK if lead else "") + line.replace(" ", MARK)))
        elif lead:
            out += line.split(" ")
        elif line:
            first, *rest = line.split(" ")
            if first:
                out.append(NUL + first)
            out += rest
    return out


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, score): as many rows as the vocabulary, whatever the corpus."""
    rows = [(p, i, float(s)) for i, (p, s, n) in enumerate(zip(model.pieces, model.scores, model.normal)) if n]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def _bytes(c: Column, model: Model) -> Column:
    """Ids of a character without a piece: its bytes, or the unknown id."""
    if not model.byte_ids:
        return F.array(F.lit(model.unknown))
    table = F.array(*[F.lit(i) for i in model.byte_ids])
    h = F.hex(F.encode(c, "UTF-8"))
    two = F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda k: F.get(table, F.conv(F.substring(h, k, F.lit(2)), 16, 10).cast("int")))
    return two


def encode_words(spark: SparkSession, words: DataFrame, model: Model, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, word, ids) for distinct rows (*by, word), which should be partitioned by ``by`` or word.

    The vocabulary's table is broadcast: its size is the model's, not the corpus's. The edges of a
    word stay in its partition, so grouping them needs no further shuffle.
    """
    n = F.char_length("word")
    starts = F.explode(F.sequence(F.lit(0), n - 1))
    w = words.where(n > 0).select(*by, "word", n.alias("n"), starts.alias("s"))
    most = F.least(F.lit(model.longest), F.col("n") - F.col("s"))
    w = w.select(*by, "word", "n", "s", F.explode(F.sequence(F.lit(1), most)).alias("len"))
    w = w.withColumn("piece", F.substring(F.col("word"), F.col("s") + 1, F.col("len")))
    w = w.join(F.broadcast(piece_table(spark, model)), "piece", "left").where("id is not null or len = 1")
    # What sorts first is taken first: for BPE by score, then start; a word's single characters are no merges.
    edge = F.struct(
        (-F.coalesce("score", F.lit(-1e12))).alias("cost"), F.col("s").alias("s"), (F.col("s") + F.col("len")).alias("e"), F.coalesce("id", F.lit(-1)).alias("id"),
    )
    g = w.groupBy(*by, "word").agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.first("n").alias("n"))
    fold = _viterbi if model.kind == UNIGRAM else _merge
    chosen = fold(F.col("edges"), F.col("n"))
    g = g.select(*by, "word", F.sort_array(F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["id"].alias("id")))).alias("path"))
    ids = F.flatten(F.transform("path", lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(_bytes(F.substring(F.col("word"), x["s"] + 1, x["e"] - x["s"]), model))))
    return g.select(*by, "word", ids.alias("ids"))


def _shift(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _merge(edges: Column, n: Column) -> Column:
    """Symbols of the BPE pass: bit p of the state says that a symbol starts or ends at p."""
    ends = lambda x: _shift(x["s"]).bitwiseOR(_shift(x["e"]))
    inner = lambda x: _shift(x["e"]) - _shift(x["s"] + 1)
    long_ = lambda x: x["e"] - x["s"] > 1
    one = F.lit(1).cast("long")
    bits = F.aggregate(
        F.filter(edges, long_),
        _shift(n + 1) - one,
        lambda a, x: F.when((F.bit_count(a.bitwiseAND(inner(x))) == 1) & (a.bitwiseAND(ends(x)) == ends(x)), a.bitwiseAND(inner(x).bitwiseXOR(F.lit(-1).cast("long")))).otherwise(a),
    )
    short = F.flatten(F.transform(F.array(bits), lambda m: F.filter(edges, lambda x: (m.bitwiseAND(ends(x)) == ends(x)) & (m.bitwiseAND(inner(x)) == 0))))

    # The same with a string of 0 and 1 for words too long for a machine word.
    at = lambda a, p: F.substring(a, p + 1, F.lit(1))
    ones = lambda a, x: F.char_length(F.replace(F.substring(a, x["s"] + 2, x["e"] - x["s"] - 1), F.lit("0")))
    both = lambda a, x: (at(a, x["s"]) == "1") & (at(a, x["e"]) == "1")
    line = F.aggregate(
        F.filter(edges, long_),
        F.repeat(F.lit("1"), n + 1),
        lambda a, x: F.when(both(a, x) & (ones(a, x) == 1), F.concat(F.substring(a, F.lit(1), x["s"] + 1), F.repeat(F.lit("0"), x["e"] - x["s"] - 1), F.substring(a, x["e"] + 1, n + 1))).otherwise(a),
    )
    longer = F.flatten(F.transform(F.array(line), lambda a: F.filter(edges, lambda x: both(a, x) & (ones(a, x) == 0))))
    return F.when(n <= SHORT, short).otherwise(longer)


def _viterbi(edges: Column, n: Column) -> Column:
    """The path of least cost; edges are taken by end, ties go to the first start."""
    kind = "array<struct<cost:double,from:int,id:int>>"
    none = F.struct(F.lit(float("inf")).alias("cost"), F.lit(-1).alias("from"), F.lit(-1).alias("id"))
    begin = F.struct(F.lit(0.0).alias("cost"), F.lit(-1).alias("from"), F.lit(-1).alias("id"))
    first = F.concat(F.array(begin), F.array_repeat(none, n)).cast(kind)
    ordered = F.array_sort(F.transform(edges, lambda x: F.struct(x["e"].alias("e"), x["s"].alias("s"), F.least(x["cost"], F.lit(1e9)).alias("cost"), x["id"].alias("id"))))

    def step(a: Column, x: Column) -> Column:
        cost = F.get(a, x["s"])["cost"] + x["cost"]
        better = F.struct(cost.alias("cost"), x["s"].alias("from"), x["id"].alias("id"))
        return F.when(cost < F.get(a, x["e"])["cost"], F.transform(a, lambda y, i: F.when(i == x["e"], better).otherwise(y))).otherwise(a)

    best = F.aggregate(ordered, first, step)

    def back(a: Column, _: Column) -> Column:
        here = F.get(a["best"], a["at"])
        edge = F.struct(here["from"].alias("s"), a["at"].alias("e"), here["id"].alias("id"))
        on = a["at"] > 0
        return F.struct(a["best"].alias("best"), F.when(on, here["from"]).otherwise(a["at"]).alias("at"), F.when(on, F.concat(a["out"], F.array(edge))).otherwise(a["out"]).alias("out"))

    start = F.struct(best.alias("best"), n.alias("at"), F.array().cast("array<struct<s:int,e:int,id:int>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), n), start, back, lambda a: a["out"])


class Encoder:
    """The lattice and fold of one word, for words that aren't in the broadcast table."""

    def __init__(self, model: Model) -> None:
        self.model, self.longest = model, model.longest
        self.edges = {p: (-sc, i) for i, (p, sc, n) in enumerate(zip(model.pieces, model.scores, model.normal)) if n}
        rank = {c: k for k, c in enumerate(sorted({c for c, _ in self.edges.values()}))}
        #: Pieces as a tree: a node is [children by character, rank or None, id].
        self.tree: list = [{}, None, -1]
        for p, (c, i) in self.edges.items():
            node = self.tree
            for ch in p:
                node = node[0].setdefault(ch, [{}, None, -1])
            node[1:] = rank[c], i
        self.seen: dict[str, bytes] = {}

    def __call__(self, key: str) -> bytes:
        """Ids of the word of a key, as little-endian 32-bit bytes."""
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            word = word_of(key)
            found = self.seen[key] = array("i", self._unigram(word) if self.model.kind == UNIGRAM else self._merge(word)).tobytes()
        return found

    def lattice(self, word: str) -> list[tuple[int, int, int, int]]:
        """(rank, start, end, id) of every substring that is a piece."""
        out, top, longest = [], self.tree[0], self.longest
        for s in range(len(word)):
            below, e = top, s
            for ch in word[s : s + longest]:
                node = below.get(ch)
                if node is None:
                    break
                below, rank, i = node
                e += 1
                if rank is not None:
                    out.append((rank, s, e, i))
        return out

    def _character(self, ch: str) -> list[int]:
        """A character that is no piece: its bytes, or the unknown id."""
        if self.model.byte_ids:
            return [self.model.byte_ids[b] for b in ch.encode("utf-8", "surrogatepass")]
        return [self.model.unknown]

    def _merge(self, word: str) -> list[int]:
        n, longest, top = len(word), self.longest, self.tree[0]
        ids, edges = [-1] * n, []
        for s in range(n):  # the lattice, with single characters set apart: they are no merges
            below, e = top, s
            for ch in word[s : s + longest]:
                node = below.get(ch)
                if node is None:
                    break
                below, rank, i = node
                e += 1
                if rank is not None:
                    if e - s > 1:
                        edges.append((rank, s, e, i))
                    else:
                        ids[s] = i
        edges.sort()
        after = list(range(1, n + 1))  # where the symbol that starts here ends; 0 if none starts
        for _, s, e, i in edges:
            m = after[s]
            if 0 < m < e and after[m] == e:
                after[s], after[m], ids[s] = e, 0, i
        out, at = [], 0
        while at < n:
            if ids[at] >= 0:
                out.append(ids[at])
            else:
                out += self._character(word[at])
            at = after[at]
        return out

    def _unigram(self, word: str) -> list[int]:
        n = len(word)
        best: list[tuple[float, int, int]] = [(0.0, -1, -1)] + [(float("inf"), -1, -1)] * n
        edges = {(e, s): (min(self.edges[word[s:e]][0], 1e9), i) for _, s, e, i in self.lattice(word)}
        for s in range(n):
            edges.setdefault((s + 1, s), (1e9, -1))
        for (e, s), (c, i) in sorted(edges.items()):
            if best[s][0] + c < best[e][0]:
                best[e] = (best[s][0] + c, s, i)
        path, at = [], n
        while at > 0:
            _, s, i = best[at]
            path.append([i] if i >= 0 else self._character(word[s]))
            at = s
        return [i for ids in reversed(path) for i in ids]


def word_counts(docs: DataFrame, prefix: bool) -> DataFrame:
    """(word, n) for words that occur more than once in what some task counted together.

    Counts are lower bounds: a task keeps what it saw once to itself. They choose the broadcast
    table and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = [k for k, n in held.items() if n > 1]
            out = pa.RecordBatch.from_arrays([pa.array(map(word_of, keys), pa.string()), pa.array([held[k] for k in keys], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for t in b.column(0):
                held.update(split_keys(t.as_py() or "", prefix))
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    return pick(docs, "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(spark: SparkSession, docs: DataFrame, model: Model, most: int) -> dict[str, bytes]:
    """Keys of the ``most`` commonest words (ties by word) and their ids as little-endian 32-bit bytes."""
    top = word_counts(docs, model.prefix).orderBy(F.desc("n"), "word").limit(most).select("word")
    top = materialize(spark, top, "frequent")
    table = encode_words(spark, top.repartition("word"), model).toArrow()
    words, lists = table.column("word").combine_chunks(), table.column("ids").combine_chunks()
    ids = np.asarray(lists.values, "<i4").tobytes()
    edge = np.asarray(lists.offsets).tolist()
    return {key_of(w): ids[4 * a : 4 * b] for w, a, b in zip(words.to_pylist(), edge, edge[1:])}


def decode_ids(ids: np.ndarray, table: list[bytes], prefix: bool) -> str:
    text = b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if prefix and text.startswith(" ") else text


def byte_table(model: Model) -> list[bytes]:
    """The bytes that each id stands for; control ids stand for none."""
    out = [p.encode("utf-8") if n else b"" for p, n in zip(model.pieces, model.normal)]
    for b, i in enumerate(model.byte_ids):
        if i >= 0:
            out[i] = bytes([b])
    return out


OUT = "doc_id long, ids array<int>, n_tokens long, n_words long, round_trip boolean"


def encode(spark: SparkSession, docs: DataFrame, model: Model, frequent: int = FREQUENT) -> DataFrame:
    """Per document: doc_id, ids, n_tokens, n_words, round_trip (decoding the ids gives the text).

    A null or empty text has no ids. ``round_trip`` is false only for texts that hold the space mark
    itself, which a decoder can't tell from a space. Repeated rows give repeated result rows.
    """
    common = spark.sparkContext.broadcast(frequent_words(spark, docs, model, frequent))
    table = byte_table(model)
    prefix = model.prefix
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, other = common.value.get, Encoder(model)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                out, n_words, same = [], [], []
                for t in b.column(1):
                    text = t.as_py() or ""
                    tokens = split_keys(text, prefix)
                    ids = np.frombuffer(b"".join([get(k) or other(k) for k in tokens]), "<i4")
                    out.append(ids)
                    n_words.append(len(tokens))
                    same.append(decode_ids(ids, table, prefix) == text)
                sizes = np.array([len(x) for x in out], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(sizes), pa.array(n_words, pa.int64()), pa.array(same, pa.bool_())], names=names)

    return pick(docs, "doc_id", "text").mapInArrow(run, OUT)


def decode(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    table, prefix = byte_table(model), model.prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(np.array(x.as_py(), np.int64), table, prefix) if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pick(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
