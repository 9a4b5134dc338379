"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every whole text is searched for credential-like spans. The hash of each candidate is then counted
over the corpus by distinct owners and distinct repositories: a value that many owners hold, or that is
in many repositories of however few owners, is a copied example; one that few hold looks live.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Kinds in order with pattern, group that must be long enough, its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The method's own kind: vendor prefixes; such a span is added only where its value looks live.
VENDOR = ("vendor", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|eyJ)[A-Za-z0-9_.-]+", 0, 20)
KINDS = (*BASE, VENDOR)
#: A value held by this many distinct owners or more, or in this many distinct repositories or more
#: whatever their owners, is a copied example.
EXAMPLE_OWNERS = 4
EXAMPLE_REPOSITORIES = 8


def maybe(pattern: str, group: int, least: int) -> str:
    """A cheaper pattern that is found wherever ``pattern`` has a match that counts.

    Where the whole match counts, a pattern is a head and a run of one class that holds the head's
    characters too, so a long enough match has ``least`` characters of the class from its head on.
    Elsewhere it is what stands in front of the values.
    """
    if group:
        return "(?i)" + re.match(r"(?:\(\?i\))?\(([^()]*)\)", pattern)[0].removeprefix("(?i)")
    head, run = re.fullmatch(r"(.*?)(\[[^]]*\])\+", pattern).groups()
    return f"(?={run}{{{least}}}){head}{run}"


SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def find(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of one kind, leftmost and not overlapping, in code points: what lies between matches
    and the matches themselves add up to the positions."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    start = lambda a, x: a["at"] + F.char_length(x["gap"])
    end = lambda a, x: start(a, x) + F.char_length(x["whole"])
    span = lambda a, x: F.struct(start(a, x).alias("start"), F.lit(rank).alias("rank"), end(a, x).alias("end"), x["value"].alias("value"))
    folded = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, x: F.struct(
            F.coalesce(end(a, x), a["at"]).alias("at"),
            F.when(F.char_length(x["value"]) >= least, F.concat(a["out"], F.array(span(a, x)))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(maybe(pattern, group, least)), folded).otherwise(F.array().cast(SPAN))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))))


def _name(c: str) -> Column:
    """A name that a null keeps apart from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def scan(spark: SparkSession, docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_owners,
    n_repositories.

    ``n_example`` counts the candidates held by ``example_owners`` owners or more, or found in
    ``example_repositories`` repositories (each of one owner) or more; ``n_live`` counts the others.
    ``n_owners`` and ``n_repositories`` are the largest numbers for one of them. A null text is empty; a
    null owner or repository is one more owner or repository. Texts may be of any length. Repeated rows
    are one repository and give repeated result rows; spans of one start are in the order of the kinds.
    An empty table gives no rows. Further columns are not read.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", _name(owner).alias("owner"), _name(repository).alias("repository"), t.alias("text"))
    found = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repository", *[find(F.col("text"), *k[1:], i).alias(k[0]) for i, k in enumerate(KINDS)])
    base = F.array_sort(F.concat(*[F.col(k[0]) for k in BASE]))
    found = materialize(spark, found.select("rid", "doc_id", "owner", "repository", *[F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in BASE], F.sha2(_named(base), 256).alias("base_sha256"), F.array_sort(F.concat(*[F.col(k[0]) for k in KINDS])).alias("all")), "secrets")
    held = found.where(F.size("all") > 0).select("rid", "owner", "repository", F.inline("all")).withColumn("hash", F.md5("value"))
    # Distinct first, then counts: a value in a third of all rows is one row per owner before it meets.
    pairs = held.select("hash", "owner", "repository").distinct()
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    frequency = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    marked = held.join(frequency, "hash").select("rid", "start", "rank", "end", "owners", "repositories", live.alias("live"))
    keep = (F.col("rank") < len(BASE)) | F.col("live")
    per = marked.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(keep, F.struct("start", "rank", "end")))).alias("kept"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.max("owners").alias("n_owners"),
        F.max("repositories").alias("n_repositories"),
    )
    zero = F.lit(0).cast("long")
    return found.join(per, "rid", "left").select(
        "doc_id",
        *[f"n_{k[0]}" for k in BASE],
        "base_sha256",
        F.coalesce(_named(F.col("kept")), F.lit("")).alias("spans"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example", "n_owners", "n_repositories")],
    )
