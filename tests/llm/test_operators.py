"""Text operators against plain Python on awkward rows, and on generated ones."""

from __future__ import annotations

import base64
import dataclasses
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyforge.llm import chat, decontaminate, language, licenses, lines, near, pieces, quality, secrets, simhash, warc
from eddyforge.llm.common import materialize
from eddyforge.llm.components import connected_components
from eddyforge.llm.license_texts import KNOWN, MIT

from . import brute


def table(df):
    return df.toArrow().to_pylist()


def bag(rows):
    return Counter(map(repr, rows))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# ---- components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(None, 1), (3, 3)]
    got = {r["node"]: r["component"] for r in table(connected_components(spark, spark.createDataFrame(edges, "src long, dst long")))}
    own = {}
    def root(x):
        while own.setdefault(x, x) != x:
            x = own[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = sorted((root(a), root(b)))
            own[rb] = ra
    assert got == {x: root(x) for x in own}


def test_no_edges(spark):
    assert connected_components(spark, spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- simhash


def test_fingerprints_and_components(spark):
    rows = [(r[0], r[1]) for r in brute.NASTY]
    fps = [brute.simhash(t) for _, t in rows]
    comp = brute.components([i for i, _ in rows], fps)
    got = bag((r["doc_id"], r["fingerprint"], r["component_id"]) for r in table(simhash.near_duplicates(spark, brute.docs(spark))))
    assert got == bag((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp))


def test_generated_clusters_lose_no_link(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = list(base)
    for b in base[:10]:
        for _ in range(30):
            x = b
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for block in (2048, 16):
        old, simhash.BLOCK = simhash.BLOCK, block
        try:
            edges = {(r["src"] & (1 << 64) - 1, r["dst"] & (1 << 64) - 1) for r in table(simhash.links(spark, df))}
        finally:
            simhash.BLOCK = old
        assert all((a ^ b).bit_count() <= 3 for a, b in edges)
        at = {x: i for i, x in enumerate(fps)}
        own = list(range(len(fps)))
        def root(i):
            while own[i] != i:
                i = own[i]
            return i
        for a, b in edges:
            own[root(at[a])] = root(at[b])
        want = brute.components(list(range(len(fps))), fps)
        groups = {}
        for i, c in enumerate(want):
            groups.setdefault(c, set()).add(root(i))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({root(i) for i in range(len(fps))})


def test_thresholds_obey_the_pigeonhole():
    rng = np.random.default_rng(0)
    for n in (100, 10**6, 10**11):
        sample = rng.integers(-(1 << 63), (1 << 63) - 1, 300, dtype=np.int64)
        for k in (3, 10):
            for m in range(2, k + 2):
                groups = simhash.group_bits(sample, m)
                assert sorted(b for g in groups for b in g) == list(range(64))
                c, ts = simhash.allocate(n, sample, groups, k)
                assert not ts or sum(ts) == k - m + 1
            assert sum(len(g) for g, _ in simhash.plan_partitions(n, sample, k)) <= 64
    assert simhash.plan_partitions(0, np.zeros(0, np.int64))


@pytest.mark.parametrize("t", [0, 1, 2, 3])
def test_estimated_candidates_are_near_the_true_number(t):
    """Bits that copy one another: the estimate has to come from the groups as they are."""
    rng = np.random.default_rng(1)
    bits = rng.random((4000, 64)) < 0.5
    for b in range(0, 64, 4):
        bits[:, b + 1 : b + 4] = bits[:, b : b + 1] ^ (rng.random((4000, 3)) < 0.05)
    fps = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()
    for group in simhash.group_bits(fps[:1024], 4):
        shares = simhash.distances(fps[:1024], group)
        mask = simhash._signed(sum(1 << b for b in group))
        r, met = simhash.radius(t), Counter()
        flips = [sum(1 << b for b in c) for d in range(r + 1) for c in itertools.combinations(group, d)]
        for x in (fps & mask).tolist():
            met.update(x ^ simhash._signed(f) for f in flips)
        true = sum(c * (c - 1) // 2 for c in met.values())
        assert true / 1.5 < simhash.candidate_pairs(len(fps), len(group), shares, t) < true * 1.5


def test_keep_one(spark):
    kept = table(near.keep_one(spark, brute.docs(spark).withColumn("row", F.lit(1)).withColumn("gone_row", F.lit(2))))
    assert set(kept[0]) >= {"doc_id", "text", "fp", "component_id", "node", "row", "gone_row"}
    ids = Counter(r["doc_id"] for r in kept)
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 0 and ids[4] == 2 and ids[None] == 1


def test_near_copies_catch_planted_ones(spark):
    """Pairs at 0.8 or more, found by comparing all, end in one group for nine of ten at least; nothing else is joined."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts = []
    for _ in range(150):
        w = rng.choices(vocabulary, k=rng.randrange(100, 500))
        v = list(w)
        for _ in range(max(1, round(len(w) * rng.uniform(0.002, 0.025)))):
            v[rng.randrange(len(v))] = rng.choice(vocabulary)
        texts += [" ".join(w), " ".join(v)]
    found = {r["doc_id"]: r["component_id"] for r in table(near.near_copies(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    sets = [set(near.shingles(t).tolist()) for t in texts]
    alike = [len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, 300, 2)]
    caught = [found[i + 1] == i for i in range(0, 300, 2)]
    assert sum(alike) > 80 and sum(c for c, a in zip(caught, alike) if a) >= 0.9 * sum(alike)
    assert not any(c for c, a in zip(caught, alike) if not a) and all(found[i] == i for i in range(0, 300, 2))


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(spark, empty).count() == 0
    assert lines.dedup_lines(spark, empty).count() == 0
    assert decontaminate.decontaminate(spark, empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert quality.assess(spark, empty).count() == 0
    assert secrets.scan(spark, empty).count() == 0
    assert licenses.scan(spark, empty).count() == 0
    assert language.identify(spark, empty).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- lines


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    rng = random.Random(tau)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abé𝒳") for _ in range(rng.randrange(0, 30)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(0, 2)] = rng.choice(["", "c", "é"])
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in table(df.select("a", "b", lines.edit_distance(F.col("a"), F.col("b"), tau).alias("d"))):
        want = brute.edit_distance(r["a"], r["b"])
        assert r["d"] == want if want <= tau else r["d"] > tau


def mutate(rng, line, n):
    x = list(line)
    for _ in range(n):
        i = rng.randrange(len(x))
        x[i : i + rng.randrange(0, 2)] = [rng.choice("qzé")][: rng.randrange(0, 2)]
    return "".join(x)


@pytest.mark.parametrize("tau", [1, 2])
def test_line_dedup_equals_brute_force(spark, tau):
    rng = random.Random(tau)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(41, 70))) for _ in range(15)] + ["short one", "exactly ten", "x" * 39]
    rows = [(i, "\n".join(mutate(rng, rng.choice(base), rng.randrange(0, 4)) if rng.random() < 0.7 else rng.choice(base) for _ in range(4))) for i in range(40)]
    rows += [(r[0], r[1]) for r in brute.NASTY]
    df = brute.docs(spark, [(i, t, None, None, None) for i, t in rows])
    got = bag((r["doc_id"], r["text"]) for r in table(lines.dedup_lines(spark, df, tau)))
    assert got == bag(zip([i for i, _ in rows], brute.line_dedup(rows, tau)))


def linked(spark, df, tau):
    """Components and counts of links by text, found by ``line_links``."""
    all_lines = materialize(spark, lines.distinct_lines(df, tau).withColumn("id", F.monotonically_increasing_id()), "t")
    edges, counts = lines.line_links(spark, df, all_lines, tau)
    of = {r["h1"]: r["line"] for r in table(lines.line_rows(df, 1))}
    return {frozenset((of[r["a"]["h1"]], of[r["b"]["h1"]])) for r in table(edges)}, {of[r["node"]["h1"]]: r["n_links"] for r in table(counts)}


@pytest.mark.parametrize(("tau", "hot"), [(1, 256), (1, 1), (2, 256), (2, 1)])
def test_line_links_equal_brute_force(spark, tau, hot, monkeypatch):
    """Edges are links and connect what all links do, counts are exact, also where each key counts as hot."""
    monkeypatch.setattr(lines, "HOT", hot)
    monkeypatch.setattr(lines, "BLOCK", 512 if hot > 1 else 3)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh") for _ in range(45)) for _ in range(6)] + ["a" * 44]
    texts = sorted({mutate(rng, rng.choice(base), rng.randrange(0, 3)) for _ in range(80)} | {"a" * n for n in (40, 41, 43)})
    texts = [t for t in texts if len(t) >= 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    edges, counts = linked(spark, df, tau)
    near = {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[:i] if brute.edit_distance(a, b) <= tau}
    assert near and edges <= near
    assert counts == Counter(t for pair in near for t in pair)

    def classes(pairs):
        own = {t: {t} for t in texts}
        for a, b in map(tuple, pairs):
            if own[a] is not own[b]:
                own[a] |= own[b]
                for t in own[b]:
                    own[t] = own[a]
        return {frozenset(x) for x in own.values()}

    assert classes(edges) == classes(near)


def test_numbered_lines_make_linear_rows(spark):
    """20 000 lines of one template: links as counted, and no table of more than a few rows a line and character."""
    n = 20000
    texts = [f"2024-01-01 12:00:00 worker finished the job number {i * 7919 % 10**8:08d} without any error at all" for i in range(n)]
    df = spark.createDataFrame([(i // 50, "\n".join(texts[i : i + 50])) for i in range(0, n, 50)], "doc_id long, text string")
    known = table(lines.line_classes(spark, df, 1))
    numbers = {t[51:59] for t in texts}
    want = Counter()
    for x in numbers:
        want[sum(x[:i] + c + x[i + 1 :] in numbers for i in range(8) for c in "0123456789" if c != x[i])] += 1
    del want[0]
    assert Counter(r["n_links"] for r in known) == want


def test_removal_is_linear_in_lines(spark):
    import time

    text = "\n".join(f"{i:06d} {'word ' * 3}" for i in range(100000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    t = time.time()
    got = {r["doc_id"]: r["text"] for r in table(lines.dedup_lines(spark, df))}
    assert got == {1: text, 2: ""} and time.time() - t < 60


def test_line_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline

    line = "a line that is long enough to count"
    df = spark.createDataFrame([(1, line, "x"), (2, line, "y")], "doc_id long, text string, `a.b` string")
    for name in ("__id", "__gone", "__th", "row", "doc", "th", "gone", "own_id", "own_th", "n_links", "__n_dropped", "first_class", "h1", "lines"):
        df = df.withColumn(name, F.lit(7))
    out = corpus_pipeline.line_dedup(spark, df.withColumn("n_chars", F.lit(1)), sf_dir)
    rows = {r["doc_id"]: r for r in table(out)}
    assert out.columns == [*df.columns, "n_chars"] and rows[1]["text"] == line and rows[2]["text"] == "" and rows[2]["a.b"] == "y" and rows[2]["__gone"] == 7
    assert {r["__n_dropped"] for r in table(lines.dedup_lines(spark, df))} == {0, 1}


def test_pipeline_links_lines_two_edits_apart(spark, sf_dir):
    import corpus_pipeline

    line = "The quick brown fox jumps over the lazy dog and runs off into the wood."
    texts = [line, "first\n" + line.replace("quick", "quack").replace("wood", "food"), line.replace("fox", "ox").replace("dog", "dogs"), line.replace("quick brown fox", "slow red hen")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in table(corpus_pipeline.line_dedup(spark, docs, sf_dir))}
    assert got == {0: line, 1: "first", 2: "", 3: texts[3]}


# ---- warc


def test_warc_round_trip(spark):
    rows = [(1, "http://a/x", "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>"), (2, "http://a/y", None), (3, None, ""), (4, "http://b/\nz", "same"), (5, "http://b/z", "same"), (9, "http://c", "same"), (9, "http://c", "same"), (None, "http://d", "same"), (7, "http://e", "y" * 300000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit("clash")).withColumn("id", F.lit(0))
    got = table(warc.round_trip(spark, df, keep_payload=True))
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {}
    for i, _, h in rows:
        last[digest(h)] = max(last.get(digest(h), -1), -1 if i is None else i)
    want = bag((i, len((h or "").encode()), digest(h), "response" if (-1 if i is None else i) == last[digest(h)] else "revisit") for i, _, h in rows)
    assert got and bag((r["metadata"]["page_id"], r["capture"]["payload_bytes"], r["capture"]["payload_digest"], r["capture"]["type"]) for r in got) == want
    for r in got:
        assert r["request"] is not None
        if r["capture"]["type"] == "revisit":
            assert r["refers_page_id"] == last[r["capture"]["payload_digest"]] and r["capture"]["payload"] is None
        else:
            assert digest(r["capture"]["payload"].decode()) == r["capture"]["payload_digest"] == r["capture"]["stated_digest"]


def test_warc_threshold_keeps_small_payloads(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx")], "page_id long, url string, html string")
    path = warc.write_archives(spark, df, warc.new_path(spark, "t"), min_bytes=3)
    assert {r["type"] for r in table(warc.read_records(spark, path).where("type in ('response', 'revisit')"))} == {"response"}


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    monkeypatch.setattr(warc, "LEAST_CLASS", 1000)
    rng = random.Random(1)
    rows = [(i, f"http://a/{i}", f"{i} " + "x" * rng.choice([10, 900, 1100, 5000, 60_000, 250_000])) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = warc.write_archives(spark, df, warc.new_path(spark, "t"))
    files = table(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content"))
    for f in files:
        payloads = [len(bytes(r["block"])) for r in warc.parse_archive(f["content"]) if r["head"]["warc-type"] == "response"]
        assert len(payloads) == 1 or sum(payloads) <= 100_000 + 200 * len(payloads)
    assert 20 < len(files) < 300
    got = {r["metadata"]["page_id"]: r for r in table(warc.round_trip(spark, df))}
    assert all(got[i]["capture"]["payload_bytes"] == len(h) and got[i]["verified"] for i, _, h in rows)


def test_revisits_are_checked_against_their_response(spark):
    df = spark.createDataFrame([(1, "a", "same"), (2, "b", "same"), (3, "c", "other")], "page_id long, url string, html string")
    records = table(warc.read_records(spark, warc.write_archives(spark, df, warc.new_path(spark, "t"))))
    for r in records:
        if r["type"] == "revisit":
            r["payload_bytes"] = 999
    got = {r["metadata"]["page_id"]: r for r in table(warc.assemble(spark.createDataFrame(records, warc.FIELDS)))}
    assert not got[1]["verified"] and got[1]["capture"]["payload_bytes"] == 4 and got[1]["refers_page_id"] == 2
    assert got[2]["verified"] and got[3]["verified"]
    alone = [r for r in records if r["type"] != "response"]
    (r,) = table(warc.assemble(spark.createDataFrame(alone, warc.FIELDS)))
    assert not r["verified"] and r["refers_page_id"] is None and r["capture"]["payload_bytes"] == 999


def test_parse_plain_archive_with_other_records():
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na: b\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 8\r\n\r\nH\r\n\r\nabc\r\n\r\n"
    assert [r["head"]["warc-type"] for r in warc.parse_archive(raw)] == ["warcinfo", "response"]
    assert list(warc.parse_archive(b"")) == []


def test_pipeline_near_copies_equal_brute_force(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(words))
        for _ in range(8):  # chains of edits: some within the limit of one another, some only by way of others
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(5000)}"
            texts.append(" ".join(words))
    texts += ["", None, "one two", "one  TWO", "one three"]
    sets = [set(near.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in table(corpus_pipeline.near_dedup(spark, docs, sf_dir))}
    # SimHash finds candidates: what goes is what brute force sends away, but for a tenth that it may miss.
    assert kept >= set(root) and len(kept) - len(set(root)) <= 0.1 * (len(texts) - len(set(root)))
    both = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    ids = Counter(r["doc_id"] for r in table(corpus_pipeline.near_dedup(spark, both, sf_dir)))
    assert ids[0] == 2 and ids[None] == 1 and corpus_pipeline.near_dedup(spark, docs.limit(0), sf_dir).count() == 0


# ---- licences


def test_license_scan(spark):
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + MIT.upper()), (2, MIT.replace("sublicense", "sub-license").replace(",", " ,")), (3, MIT[:-5]), (4, "Text.\nReleased under the MIT licence.\nLicensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, "z\nz" * 50000)]
    got = {r["doc_id"]: r for r in table(licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))))}
    assert [got[i]["license_id"] for i in (1, 2, 3, 5, 6)] == ["MIT", "MIT", None, None, None]
    assert got[4]["notices"] == "CC-BY-NC-4.0,MIT" and got[4]["n_notices"] == 2 and got[5]["notices"] == ""


def test_every_known_notice_is_found(spark):
    notices = [(i, t) for i, t, whole in KNOWN if not whole]
    rows = [(2 * n + k, f"Text.\n{form}\nMore.") for n, (_, t) in enumerate(notices) for k, form in enumerate((t, f"/{'*' * 200} {t.replace(' ', ' - ')} {'*' * 200}/"))]
    got = {r["doc_id"]: r for r in table(licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")))}
    assert all(got[d]["n_notices"] == 1 and got[d]["notices"] == notices[d // 2][0] for d, _ in rows)


def test_entire_licences_and_their_lines(spark):
    """Each known text, reflowed and recased, gives its id; lines are what each by itself would be."""
    whole = [(i, t) for i, t, entire in KNOWN if entire]
    rows = [(n, "  \r\n" + t.replace("\n", " \n * ").upper()) for n, (_, t) in enumerate(whole)]
    got = {r["doc_id"]: r["license_id"] for r in table(licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {n: i for n, (i, _) in enumerate(whole)}
    assert {i for i, _ in whole} >= {"GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "Apache-2.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"}
    rng = random.Random(3)
    bits = ["sub", "licence", " ", "\n", "-", "http", "https", "programme", "per", "cent", "é", "MIT License", "copyright", "=" * 90, "Owner", "\r"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 20))) for _ in range(300)] + ["=" * 400 + " MIT License " + "=" * 400]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in table(df.select(licenses.canonical_lines(F.col("text")).alias("a"), F.transform(F.split("text", "\n", -1), lambda x: licenses.canonical(x, False)).alias("b"))):
        assert r["a"] == r["b"]
    rows = [(1, texts[-1]), (1, texts[-1]), (None, "MIT License\n" * 3)]
    got = table(licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(r["n_notices"] for r in got) == [1, 1, 3]


# ---- pieces


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


SPACES = ["  two  spaces ", "\n\n x\n y", " ", "a\tb\r\nc", "日本語 𝒳é " + "ab" * 60, "▁ mark", "x", "  \n  "]


@pytest.mark.parametrize("frequent", [1, 500, 10**6])
def test_encoding_equals_the_library(spark, model, library, sf_dir, frequent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*SPACES, None, "", "z" * 5000])], "doc_id long, text string")
    docs = docs.unionByName(odd)
    texts = {r["doc_id"]: r["text"] for r in table(docs)}
    got = table(pieces.encode(spark, docs.withColumn("ids", F.lit(1)).withColumn("word", F.lit(2)), model, frequent))
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == library.encode(texts[r["doc_id"]] or "")
        assert r["round_trip"] == ("▁" not in (texts[r["doc_id"]] or ""))
    back = {r["doc_id"]: r["text"] for r in table(pieces.decode(spark.createDataFrame([(1, got[0]["ids"]), (2, None), (3, [])], "doc_id long, ids array<int>"), model))}
    assert back == {1: texts[got[0]["doc_id"]], 2: None, 3: ""}


def test_relational_lattice_equals_the_library_and_the_encoder(spark, model, library, sf_dir):
    texts = [r["text"] for r in table(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60))] + SPACES + ["q" * 200 + "the" * 80]
    words = sorted({w for t in texts for w in pieces.split_words(t, True)})
    got = {r["word"]: r["ids"] for r in table(pieces.encode_words(spark, spark.createDataFrame([(w,) for w in words], "word string"), model))}
    own = pieces.Encoder(model)
    assert set(got) == set(words)
    for w in words:
        assert got[w] == np.frombuffer(own(pieces.key_of(w)), "<i4").tolist()
        if w[0] == "▁" and "▁" not in w[1:] and len(w) > 1:
            assert got[w] == library.encode(w[1:])


def test_viterbi_finds_the_cheapest_path(spark, model):
    """Unigram model with the same pieces: no path costs less, the library's included."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    uni = dataclasses.replace(model, kind=pieces.UNIGRAM)
    words = ["▁" + w for w in "the of internationalisation über naïve Straße tokenization qzx antidisestablishmentarianism".split()]
    own = pieces.Encoder(uni)
    cost = lambda ids: sum(model.scores[i] for i in ids)

    def best(word):
        top = [0.0] + [-1e18] * len(word)
        for e in range(1, len(word) + 1):
            top[e] = max(top[s] + -own.edges[word[s:e]][0] for s in range(e) if word[s:e] in own.edges and top[s] > -1e18)
        return top[-1]

    for r in table(pieces.encode_words(spark, spark.createDataFrame([(w,) for w in words], "word string"), uni)):
        assert "".join(model.pieces[i] for i in r["ids"]) == r["word"]
        assert cost(r["ids"]) == pytest.approx(best(r["word"])) == pytest.approx(cost(np.frombuffer(own(pieces.key_of(r["word"])), "<i4").tolist()))
        assert cost(r["ids"]) >= cost(sp.encode(r["word"][1:])) - 1e-6


# ---- decontamination


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Four FIVE"), (3, None), (4, "..."), (None, "the lazy dog near"), (5, "word word word word word word word word word word word"), (5, "second line that"), (10, "quick brown fox")]


@pytest.mark.parametrize("block", [200000, 3])
def test_contamination_equals_brute_force(spark, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit(1))
    got = bag((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in table(decontaminate.decontaminate(spark, brute.docs(spark), bench, block_words=block)))
    assert got == bag(brute.contamination([(r[0], r[1]) for r in brute.NASTY], ITEMS))


def test_contamination_across_small_shards(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    old, decontaminate.SHARD_WORDS = decontaminate.SHARD_WORDS, 5000
    try:
        got = bag((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in table(decontaminate.decontaminate(spark, docs, bench)))
    finally:
        decontaminate.SHARD_WORDS = old
    want = brute.contamination([(r["doc_id"], r["text"]) for r in table(docs)], [(r["item_id"], r["text"]) for r in table(bench)])
    assert got == bag(want) and any(w[2] for w in want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma far away from alpha and beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    hit = lambda slop: sorted(r["doc_id"] for r in table(decontaminate.decontaminate(spark, docs, bench, slop=slop)) if r["n_near_items"])
    assert hit(0) == [2] and hit(1) == [1, 2]
    exact = table(decontaminate.decontaminate(spark, docs, bench))
    assert sorted(r["doc_id"] for r in exact if r["contaminated"]) == [2]


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity_equals_brute_force(spark, slop):
    rng = random.Random(slop)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14)))) for i in range(25)]
    want = {}
    for i, text in rows:
        w, near_items = text.split(), set()
        for k, item in items:
            t = item.split()
            for b in range(max(1, len(t) - 9)):
                win = t[b : b + 10]
                if any(all(any(0 <= s + j + o < len(w) and w[s + j + o] == x for o in range(-slop, slop + 1)) for j, x in enumerate(win)) for s in range(-slop - 10, len(w) + slop)):
                    near_items.add(k)
        want[i] = len(near_items)
    got = table(decontaminate.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slop=slop))
    assert {r["doc_id"]: r["n_near_items"] for r in got} == want and sum(want.values()) > 60


def test_empty_benchmark(spark):
    r = table(decontaminate.decontaminate(spark, brute.docs(spark), spark.createDataFrame([], "item_id long, text string")))
    assert len(r) == len(brute.NASTY) and not any(x["contaminated"] for x in r)
    kept = decontaminate.keep_clean(spark, brute.docs(spark).withColumn("row", F.lit(1)).withColumn("bad_row", F.lit(1)).withColumn("__bad", F.lit(1)), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert "line" in kept.columns and {r["doc_id"] for r in table(kept)} == {1, 2, 3, 6, 8}


# ---- quality


def test_base_counts_equal_brute_force(spark, sf_dir):
    texts = [r["text"] for r in table(spark.read.parquet(f"{sf_dir}/documents.parquet"))] + [r[1] for r in brute.NASTY if r[1] is None or len(r[1]) < 1000]
    for t in texts:
        assert quality.base_counts(t) == brute.quality(t)


def test_model_is_a_distribution(monkeypatch):
    """P of all symbols after a context sums to 1 - up to the share of symbols beyond those tried."""
    rng = np.random.default_rng(1)
    text = "".join(chr(97 + x) for x in (rng.zipf(1.5, 5000) % 20))
    halves = brute.kneser_ney([(None, 1, text)])
    model = quality.Model.of(*halves[None, 1])
    for context in ("aaa", "abc", "zzz", "qab"):
        head = np.uint64(0)
        for ch in context:
            head = (head | np.uint64(ord(ch))) << np.uint64(16)
        p = model.probability(head | np.arange(1 << 16, dtype=np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("shard_rows", [10**6, 40])
def test_log_perplexity_equals_brute_force(spark, shard_rows):
    """Modified Kneser-Ney over dictionaries, each text by the counts of the other half, in one part or many."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcde ,.Z9é日𝒳") for _ in range(rng.randrange(0, 60))), rng.choice(["en", "xx", None])) for i in range(40)]
    rows += [(50, None, "en"), (51, "", "en"), (52, "only one of its language", "yy"), (1, "a repeated row", "en"), (1, "a repeated row", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("row", F.lit(1)).withColumn("grp", F.lit(1)).withColumn("log_ppl", F.lit("x"))
    half = {r["doc_id"]: r["half"] for r in table(df.select("doc_id", quality._half().alias("half")))}
    got = sorted(((r["doc_id"], r["log_ppl"]) for r in table(quality.assess(spark, df, shard_rows=shard_rows))), key=str)
    want = sorted(zip([r[0] for r in rows], brute.log_perplexities([(r[2], half[r[0]], r[1] or "") for r in rows])), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    for (_, g), (_, w) in zip(got, want):
        assert (g is None) == (w is None) and (w is None or g == pytest.approx(w, rel=1e-4))


def test_kept_equals_brute_force(spark, sf_dir):
    """The bands from all scores, computed again in Python, give the same verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = table(quality.assess(spark, docs).join(docs.select("doc_id", "lang"), "doc_id"))
    by = {}
    for r in rows:
        if not r["base_failed"] and r["log_ppl"] is not None:
            by.setdefault(r["lang"], []).append(round(r["log_ppl"] / quality.STEP + 1e-9))
    low = lambda x: sorted(x)[(len(x) - 1) // 2]
    mids = {k: low(v) for k, v in by.items()}
    sides = {k: ([mids[k] - x for x in v if x <= mids[k]], [x - mids[k] for x in v if x >= mids[k]]) for k, v in by.items()}
    pooled = [low([x for s in sides.values() for x in s[i]]) for i in (0, 1)]
    limits = {}
    for k, s in sides.items():
        own = [max(low(x), p if len(by[k]) < quality.FEW else 0) for x, p in zip(s, pooled)]
        half = [max(quality.WIDTH * 1.4826 * x, 1) * quality.STEP for x in own]
        limits[k] = mids[k] * quality.STEP - half[0], mids[k] * quality.STEP + half[1]
    for r in rows:
        low_, high = limits.get(r["lang"], (-1, 99))
        if r["log_ppl"] is None or min(abs(r["log_ppl"] - low_), abs(r["log_ppl"] - high)) > 2 * quality.STEP:
            assert r["kept"] == (not r["base_failed"] and (r["log_ppl"] is None or low_ <= r["log_ppl"] <= high))


def test_quality_of_awkward_rows(spark):
    """Nulls, very long texts, repeated rows, clashing names; every language has a model of its own."""
    many = [(100 + i, f"text number {i} in a language with two texts " * 8, f"l{i // 2}", "s", 1) for i in range(60)]
    df = brute.docs(spark, brute.NASTY + many).withColumn("row", F.lit(1)).withColumn("grp", F.lit(2)).withColumn("kept", F.lit("x")).withColumn("__q_n_words", F.lit(3))
    got = table(quality.assess(spark, df))
    assert bag(r["doc_id"] for r in got) == bag([r[0] for r in brute.NASTY + many])
    long_ = [r for r in got if r["doc_id"] == 7][0]
    assert long_["n_words"] == 30000 and long_["n_repeat_words"] == 30000 and long_["base_failed"]
    kept = quality.keep_good(spark, df)
    assert kept.columns == df.columns and bag(r["doc_id"] for r in table(kept)) == bag(r["doc_id"] for r in got if r["kept"])


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    text = "Héllo, wörld! 12 #x\n" * 20
    whole = np.concatenate(list(quality.ngrams(text)))
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert np.array_equal(whole, np.concatenate(list(quality.ngrams(text)))) and len(whole) == len(text)


def test_assess_and_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    noise = random.Random(1)
    text = " ".join("".join(noise.choice("qxzjkvwQXZ79#~éß日") for _ in range(9)) for _ in range(60))
    junk = spark.createDataFrame([(10**6, text, "en", "s", 1), (10**6 + 1, None, "en", "s", 1), (None, "a b " * 200, "xx", "s", 1)], docs.schema)
    both = docs.unionByName(junk)
    got = {r["doc_id"]: r for r in table(quality.assess(spark, both))}
    assert not got[10**6]["kept"] and not got[10**6]["base_failed"] and got[10**6]["log_ppl"] > got[10**6]["upper"]
    assert got[10**6 + 1]["base_failed"] and got[None]["base_failed"]
    kept = {r["doc_id"] for r in table(quality.keep_good(spark, both))}
    assert kept == {i for i, r in got.items() if r["kept"]}
    good = {r["doc_id"] for r in table(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"))}
    clean = [i for i in good if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] for i in clean) >= 0.97 * len(clean) > 0  # what goes mixes languages, like doc 52


def test_bands_reject_labelled_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in table(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))}
    judged = [r for r in table(quality.assess(spark, docs)) if not r["base_failed"] and r["doc_id"] in labels]
    junk = [r["kept"] for r in judged if labels[r["doc_id"]] == 0]
    clean = [r["kept"] for r in judged if labels[r["doc_id"]] == 1]
    assert junk.count(False) >= 0.6 * len(junk) > 0 and clean.count(False) <= 0.03 * len(clean)


def test_band_sides_have_their_own_spread(spark):
    sides = [("a", x) for x in (*np.linspace(1.9, 2, 50), *np.linspace(2, 3, 50))]
    few = [("b", x) for x in (1.0, 1.001, 1.002, 1.3)]
    df = spark.createDataFrame([(k, float(x), 100, 0) for k, x in sides + few], "grp string, log_ppl double, n_words long, n_repeat_words long")
    got = {r["grp"]: (r["lower"], r["upper"]) for r in table(quality.bands(df, 5.0))}
    assert 2 - got["a"][0] == pytest.approx(5 * 1.4826 * 0.05, rel=0.1) and got["a"][1] - 2 == pytest.approx(5 * 1.4826 * 0.5, rel=0.1)
    assert got["b"][1] > 1.3  # four documents: the spread of all groups holds


# ---- secrets


def test_secret_spans_equal_brute_force(spark):
    texts = [r[1] for r in brute.NASTY] + ['token: secret: abcdefghijklmnop "API_KEY" = \'Zz0/abc.def-123\' AKIA AKIAABCDEFGH1234567', "PASSWORD=short passwd = aaaaaaaaaaaa token=password=abcdefghijkl", "é𝒳 secret:abcdefghijkl" * 3, "deadbeef" * 50]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumn("hash", F.lit(1)).withColumn("rank", F.lit(1))
    for r in table(secrets.scan(spark, df)):
        t, spans = texts[r["doc_id"]] or "", []
        for k, (name, pattern, group, least) in enumerate(secrets.BASE):
            flags = re.I | re.A if name == "assign" else 0
            spans += [(m.start(), k, m.end(), name) for m in re.finditer(pattern.replace("(?i)", ""), t, flags) if len(m[group]) >= least]
        text = ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_ownership_separates_examples_from_live_secrets(spark):
    shared, own = "ghp_" + "Xy" * 12, "ghp_" + "Zw" * 12
    rows = [(i, f"key {shared} end", f"owner{i % 5}") for i in range(5)] + [(100, f"key {own} end", "owner1"), (101, None, None)]
    got = {r["doc_id"]: r for r in table(secrets.scan(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    # Owners alone decide: five of them, in fewer repositories than the other limit.
    assert got[0]["n_example"] == 1 and got[0]["spans"] == "" and got[0]["n_owners"] == 5 == got[0]["n_repositories"]
    assert got[100]["n_live"] == 1 and got[100]["spans"] == "vendor:4:32" and got[101]["spans"] == ""


def test_repositories_of_one_owner_make_an_example(spark):
    copied, live = "ghp_" + "Ab" * 12, "ghp_" + "Cd" * 12
    rows = [(i, f"key {copied} end", "hot") for i in range(8)] + [(50 + i, f"key {live} end", "hot") for i in range(7)] + [(50, f"key {live} end", "hot")] * 3
    got = {r["doc_id"]: r for r in table(secrets.scan(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    assert got[0]["n_example"] == 1 and got[0]["spans"] == "" and (got[0]["n_owners"], got[0]["n_repositories"]) == (1, 8)
    assert got[50]["n_live"] == 1 and got[50]["n_repositories"] == 7  # repeated rows are one repository


def test_repeated_rows_and_null_owners(spark):
    value = "ghp_" + "Ef" * 12
    rows = [(1, value, None), (1, value, None), (1, value, ""), (None, value, "s")]
    got = table(secrets.scan(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert len(got) == 4 and all((r["n_owners"], r["n_repositories"], r["spans"]) == (3, 3, "vendor:0:28") for r in got)


def test_no_span_of_any_kind_is_lost(spark):
    """Every match that counts is found, whatever its prefix; least lengths on and off by one."""
    texts = ["sk_live_123456789012", "xoxb-123456789012345", "x sk_live_12345678901", "xoxb-12345678901234", "eyJ" + "a" * 17, "eyJ" + "a" * 16, "AKIA" + "B" * 14, "AKIA" + "B" * 13, "0" * 16, "0" * 15]
    rng = random.Random(8)
    bits = ["AKIA", "ghp_", "xoxb-", "sk_live_", "eyJ", "token", "=", '"', " ", "a1b2c3", "ABCDEF0", ".", "_", "-", "\n", "é"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(3, 25))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {r["doc_id"]: r["spans"] for r in table(secrets.scan(spark, df, example_owners=10**9, example_repositories=10**9))}
    assert got[0] == "vendor:0:20" and got[1] == "vendor:0:20" and got[2] == got[3] == ""
    for i, t in enumerate(texts):
        spans = []
        for k, (name, pattern, group, least) in enumerate(secrets.KINDS):
            flags = re.I | re.A if name == "assign" else 0
            spans += [(m.start(), k, m.end(), name) for m in re.finditer(pattern.replace("(?i)", ""), t, flags) if len(m[group]) >= least]
        assert got[i] == ",".join(f"{n}:{x}:{y}" for x, _, y, n in sorted(spans))


# ---- chat


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|", "<|", "|>", "\n", "assistant", "é𝒳", " ", "%0A", "<", "\\"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "<|im_start|>", "%", None]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(None, None, None, None), (70, 1, "user", "a"), (70, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("k", F.lit(1))
    got = table(chat.read_back(chat.format_conversations(df)))
    assert len(got) == len({r[0] for r in rows})
    for g in got:
        assert g["identical"]
        own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == g["conv_id"])
        assert [(t["role"], t["text"]) for t in g["turns"]] == [(r, x) for _, r, x in own]
        assert g["loss_text"] == "".join(x for _, r, x in own if r == "assistant")


def test_formatting_is_linear_in_a_conversation(spark):
    import time

    def seconds(n):
        df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" é word<|im_end|>"), 12)).alias("text"))
        t = time.time()
        (r,) = table(chat.read_back(chat.format_conversations(df)).select(F.size("turns").alias("n"), F.char_length("loss_text").alias("loss"), "identical"))
        assert r["identical"] and r["n"] == n and r["loss"] == sum(len(str(i)) + 12 * 17 for i in range(1, n, 2))
        return time.time() - t

    seconds(1000)
    assert seconds(50000) < 40  # fifty thousand turns, some 11 million characters


def test_clean_text_is_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b | c \\ d <b>"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    assert table(chat.format_conversations(df))[0]["formatted"] == "<|im_start|>user\na < b | c \\ d <b><|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"


# ---- language


def test_language(spark, sf_dir):
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 !?", "en", None, None), (10**6 + 2, "", None, None, None), (None, "the and of that", None, None, None)], docs.schema)
    both = docs.unionByName(odd)
    lang = {r["doc_id"]: r["lang"] for r in table(both)}
    got = {r["doc_id"]: r for r in table(language.identify(spark, both))}
    held = [i for i, r in got.items() if r["held_out"] and i is not None]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    scored = [i for i in held if i < 10**6]
    assert sum(got[i]["lang_pred"] == lang[i] for i in scored) >= 0.9 * len(scored)
    assert [got[10**6 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_scores_equal_a_kernel_regression(spark):
    """Nyström features and ridge weights, computed again from n-gram cells with plain kernels."""
    rng = random.Random(6)
    words = {"aa": "the and of house water", "bb": "der und von haus wasser", "cc": "le et de maison eau"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randrange(3, 9))), k) for i in range(90) for k in [rng.choice(list(words))]]
    rows += [(200, rows[0][1], None), (201, rows[0][1], None), (7, rows[7][1], rows[7][2]), (300, "water " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("k", F.lit(1)).withColumn("cells", F.lit("x")).withColumn("at", F.lit(2))
    got = table(language.identify(spark, df, landmarks=20))
    sample = sorted(table(language.training_sample(df)), key=lambda r: (r["lang"], r["k"]))

    def kernel(x, y):
        return sum(len(a & b) / (len(a) * len(b)) ** 0.5 for a, b in zip(x, y) if a and b) / 3

    split = lambda cells: [{c for c in cells if sum(language.CELLS[: n - 1]) <= c < sum(language.CELLS[:n])} for n in (1, 2, 3)]
    spectra, langs = [split(r["cells"]) for r in sample], [r["lang"] for r in sample]
    marks = [spectra[i] for _, _, i in sorted((r["k"], r["lang"], i) for i, r in enumerate(sample))[:20]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-8 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])
    phi = lambda x: np.append(np.array([kernel(x, m) for m in marks]) @ white, 1)
    a = np.array([phi(x) for x in spectra])
    names = sorted(words)
    y = np.array([[1.0 if k == n else -1.0 for n in names] for k in langs])
    shrink = language.RIDGE * len(a) * np.diag([1.0] * (a.shape[1] - 1) + [0.0])
    weights = np.linalg.solve(a.T @ a + shrink + 1e-9 * np.eye(a.shape[1]), a.T @ y)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, text, _ in rows:
        f = phi(split(language.presence(text).tolist())) @ weights
        assert by[i]["score"] == pytest.approx(min(1, max(0, (f.max() + 1) / 2)), abs=2e-3)
        top = np.sort(f)
        if top[-1] - top[-2] > 0.01:
            assert by[i]["lang_pred"] == names[int(f.argmax())]
    assert by[200]["lang_pred"] == by[201]["lang_pred"] == by[0]["lang_pred"] and by[200]["score"] == by[0]["score"]


def test_training_sample_has_the_expected_size(spark):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 10 < 7, "aa").when(F.col("id") % 10 < 9, "bb").otherwise(F.when(F.col("id") % 100 == 9, "cc")).alias("lang"))
    n = Counter(r["lang"] for r in table(language.training_sample(df).select("lang")))
    assert 320 < n["aa"] < 480 and 320 < n["bb"] < 480 and n["cc"] == df.where("lang = 'cc'").where(~language.held_out()).count() < 400


def test_many_languages_are_learned(spark):
    """No cap: a hundred languages, each of an alphabet's two letters."""
    rows = [(100 * k + j, " ".join([chr(0x4E00 + 2 * k) * 3, chr(0x4E00 + 2 * k + 1) * 2] * (j + 1)), f"l{k:03d}") for k in range(100) for j in range(6)]
    got = table(language.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    right = {r[0]: r[2] for r in rows}
    assert sum(r["lang_pred"] == right[r["doc_id"]] for r in got) >= 0.95 * len(rows)


def test_language_with_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in table(language.identify(spark, df))] == [("und", 0.0)]


def test_presence_does_not_depend_on_pieces(monkeypatch):
    text = "Ünïcode täxt 𝒳 " * 30
    whole = language.presence(text)
    monkeypatch.setattr(language, "CHUNK", 5)
    assert np.array_equal(whole, language.presence(text))


def test_wanted_lines_are_not_broadcast(spark, monkeypatch):
    plans = {}
    write = lines.materialize

    def seen(session, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(session, df, name)

    monkeypatch.setattr(lines, "materialize", seen)
    df = spark.createDataFrame([(i, f"{'one line of a text that is long enough to be near another '}{i % 7}") for i in range(50)], "doc_id long, text string")
    assert lines.dedup_lines(spark, df).count() == 50
    assert "SortMergeJoin" in plans["line-texts"] and "BroadcastHashJoin" not in plans["line-texts"]


# ---- tables written to the shared folder


def test_a_table_collects_what_past_ones_left(spark):
    full = lambda: sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    for k in range(3):
        assert materialize(spark, spark.range(100).groupBy((F.col("id") % (k + 2)).alias("k")).count(), "past").count() == k + 2
    assert full() >= before + 3
