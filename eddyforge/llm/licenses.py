"""License scans by canonical digest: texts are normalised and hash-joined to known licences.

Canonical form: lower case, copyright lines dropped, equivalent spellings made one, every run of
anything but letters and digits one space. The SHA-256 of a canonical text, entire, is looked up;
so are, within a text, its single lines, for the one-line notices by which texts name a licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import KNOWN

#: Equivalent spellings, as plain substrings of the canonical text.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme ", "program "), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("per cent", "percent"), ("http ", "https "),
)
COPYRIGHT = r"(?:^|\n)[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"
NOT_WORD_IN_LINE = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column, whole: bool = True) -> Column:
    """Canonical form; a line by itself (``whole`` false) keeps what a copyright line would lose."""
    t = F.lower(text)
    if whole:
        t = F.when(F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©")), F.regexp_replace(t, COPYRIGHT, "")).otherwise(t)
    t = F.trim(F.regexp_replace(t, NOT_WORD, " "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, each by itself, made by one pass over the text: no
    spelling holds a newline, and none of a line's ends is a space."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), NOT_WORD_IN_LINE, " "), "(?m)^ | $", "")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.split(t, "\n", -1)


def known_digests(spark: SparkSession, whole: bool) -> DataFrame:
    """(digest, license_id) of the texts of a fixed list, notices (one line) or entire licences."""
    rows = [(i, t, w) for i, t, w in KNOWN if w == whole]
    df = spark.createDataFrame(rows, "license_id string, text string, whole boolean")
    return df.select(F.sha2(canonical(F.col("text"), whole), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, digest (of the canonical text), license_id (or null), n_notices,
    notices (distinct ids of the notices in it, sorted and comma-joined; empty if none).

    Every line of a text, of any length, is looked up by the digest of its canonical form. A digest of
    several licences counts for the first id. A null text is empty; an empty canonical text is no
    licence. Repeated rows give repeated rows; an empty table gives none. Further columns are not read.
    """
    known = known_digests(spark, True)
    notice = known_digests(spark, False).collect()  # a fixed list, whatever the corpus
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = F.filter(F.transform(canonical_lines(text), lambda x: F.sha2(x, 256)), lambda d: d.isin([r["digest"] for r in notice]))
    names = F.create_map(*[F.lit(x) for r in notice for x in (r["digest"], r["license_id"])])
    d = docs.select("doc_id", text.alias("text"))
    d = d.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), digests.alias("hits"))
    d = d.join(F.broadcast(known), "digest", "left")
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.element_at(names, h))))
    return d.select("doc_id", "digest", "license_id", F.size("hits").cast("long").alias("n_notices"), F.array_join(ids, ",").alias("notices"))
