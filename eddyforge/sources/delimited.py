"""Delimited logger files as samples.

Files are read as lines in parallel, however large. A line's number comes from a small table of line
counts per file block, so no shuffle puts raw lines in order. Everything is declared: columns by
header text, types, units, missing tokens; whatever doesn't fit is an error row with its place.
"""

from __future__ import annotations

import codecs
import csv
import glob
import io
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SERIES, Config
from ..constants import MICROS, RATE_TOLERANCE
from ..errors import ReadError
from ..plans.cut import cut_periods, late_rows
from .timestamps import parse_timestamp

#: Files that are named in warnings about their rate.
RATE_WARNINGS = 20
NUMBER = r"(?i)^[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity|nan)$"


def paths(cfg: Config) -> list[str]:
    """The files, in no order; a pattern with a scheme is left to Spark's own store."""
    pattern = cfg.files.input_glob
    if "://" in pattern:
        return [pattern]
    found = sorted(glob.glob(pattern))
    if not found:
        raise ReadError(f"no file matches {pattern!r}")
    return found


def lines(spark: SparkSession, cfg: Config, quoted_newlines: bool = False) -> DataFrame:
    """(file, lineno, value) of every line; a byte-order mark is taken off line 1.

    With ``quoted_newlines`` a cell in quotes may hold line breaks; then a file can't be split, is read
    by one task and has to be UTF-8. A record's number is that of its first line.
    """
    try:
        codecs.lookup(cfg.files.encoding)
    except LookupError:
        raise ReadError(f"files.encoding {cfg.files.encoding!r} is not a known encoding") from None
    if quoted_newlines:
        return _records(spark, cfg)
    plain = cfg.files.encoding.lower().replace("_", "-") in ("utf-8", "utf8", "utf-8-sig", "ascii", "us-ascii")
    if plain:
        raw = spark.read.text(paths(cfg))
    else:
        raw = spark.read.schema("value string").csv(paths(cfg), encoding=cfg.files.encoding, sep="\x01", quote="", escape="\x02", lineSep="\n")
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.rtrim(F.coalesce("value", F.lit("")), F.lit("\r")).alias("value"))
    blocks = raw.groupBy("file", "block").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = raw.join(blocks, ["file", "block"]).select("file", (F.col("m") - F.col("first") + F.col("offset") + 1).alias("lineno"), "value")
    return out.withColumn("value", F.when(F.col("lineno") == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))


def _records(spark: SparkSession, cfg: Config) -> DataFrame:
    q = _literal(cfg.files.quotechar)
    record = f"((?:[^{q}\\n]++|{q}(?:[^{q}]++|{q}{q})*+{q})*+)(?:\\n|$)"
    whole = spark.read.text(paths(cfg), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    rows = whole.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(record), F.lit(1))).alias("k", "value"))
    before = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    broken = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit("\n")))
    lineno = F.col("k") + 1 + F.coalesce(F.sum(broken).over(before), F.lit(0))
    return rows.select("file", lineno.cast("long").alias("lineno"), F.rtrim("value", F.lit("\r")).alias("value"))


def split_line(value: Column, delimiter: str, quote: str) -> Column:
    """Cells of a line: a plain split, or for lines with quotes one that honours them."""
    d, q = _literal(delimiter), _literal(quote)
    plain = F.split(value, d, -1)
    cell = f"(?:{q}(?:[^{q}]|{q}{q})*{q}|[^{d}{q}]*){d}"
    cells = F.regexp_extract_all(F.concat(value, F.lit(delimiter)), F.lit(cell), F.lit(0))
    bare = lambda x: F.replace(F.regexp_replace(x, f"^{q}|{q}?{d}$", ""), F.lit(quote * 2), F.lit(quote))
    quoted = F.transform(cells, bare)
    return F.when(F.contains(value, F.lit(quote)), quoted).otherwise(plain)


def _literal(c: str) -> str:
    return {"\t": "\\t"}.get(c, "\\" + c if not c.isalnum() and c != " " else c)


def headers(rows: DataFrame, cfg: Config) -> dict[str, list[str]]:
    """The distinct header lines and their stripped cells: as many as there are layouts."""
    found = rows.where(F.col("lineno") == cfg.files.header_line).select("value").distinct().collect()
    if not found:
        raise ReadError(f"no line {cfg.files.header_line} to take the header from")
    reader = lambda t: next(csv.reader(io.StringIO(t), delimiter=cfg.files.delimiter, quotechar=cfg.files.quotechar), [])
    return {r["value"]: [c.strip() for c in reader(r["value"])] for r in found}


def parse(spark: SparkSession, cfg: Config, quoted_newlines: bool = False) -> DataFrame:
    """(file, lineno, key_us, declared series..., error) of every data line; error is NULL or says what."""
    rows = lines(spark, cfg, quoted_newlines)
    layouts = headers(rows, cfg)
    wanted = {n: getattr(cfg.variables, n) for n in SERIES if getattr(cfg.variables, n) is not None}
    tops = rows.where(F.col("lineno") == cfg.files.header_line).select("file", F.col("value").alias("header"))
    data = rows.where((F.col("lineno") >= cfg.files.first_data_line) & (F.trim("value") != "")).join(tops, "file")
    out = None
    for header, cells in layouts.items():
        at = {}
        for name, title in ({"__t": cfg.timestamp.column} | wanted).items():
            if title not in cells:
                raise ReadError(f"column {title!r} is not in the header: {', '.join(cells)}")
            at[name] = cells.index(title)
        one = data.where(F.col("header") == header).withColumn("cells", split_line(F.col("value"), cfg.files.delimiter, cfg.files.quotechar))
        part = typed(one, cfg, at, wanted)
        out = part if out is None else out.unionByName(part)
    return out


#: A line of this error is part of a record with line breaks in a quoted cell, or such a record's quote is never closed.
OPEN_QUOTE = "a quoted cell is not closed on this line"


def typed(df: DataFrame, cfg: Config, at: dict[str, int], wanted: dict[str, str]) -> DataFrame:
    """(file, lineno, key_us, series..., error) from rows (file, lineno, value, cells): missing tokens,
    strict numbers and unit maps. ``at`` has the place of each series' cell and of ``__t``, the timestamp."""
    short = F.size("cells") <= max(at.values())
    cell = lambda n: F.trim(F.get(F.col("cells"), F.lit(at[n])))
    stamp = parse_timestamp(cell("__t"), cfg.timestamp.format)
    df = df.withColumns({"key_us": stamp} | {f"__{n}": cell(n) for n in wanted})
    quotes = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit(cfg.files.quotechar)))
    error = F.when(~F.is_valid_utf8("value"), F.lit("the line is not text in the declared encoding")).when(quotes % 2 == 1, F.lit(OPEN_QUOTE))
    error = error.when(short, F.lit("the line has too few cells")).when(F.col("key_us").isNull(), F.concat(F.lit("not a timestamp: "), F.coalesce(cell("__t"), F.lit(""))))
    values = {}
    for n, title in wanted.items():
        token = F.col(f"__{n}")
        missing = token.isin(list(cfg.files.na_values))
        number = F.when(token.rlike(NUMBER), token.try_cast("double"))
        error = error.when(~missing & ~token.rlike(NUMBER), F.concat(F.lit(f"column {title}: not a number: "), token))
        a, b = cfg.maps.get(n, (1.0, 0.0))
        x = F.when(~missing, number) * F.lit(a) + F.lit(b)
        values[n] = F.when(F.abs(x) < F.lit(float("inf")), x)
    return df.select("file", "lineno", "key_us", *[v.alias(n) for n, v in values.items()], error.alias("error"))


def file_ranks(rows: DataFrame) -> DataFrame:
    """(file, file_rank): files in the order of their first sample, names break ties, empty ones first."""
    first = rows.groupBy("file").agg(F.min_by("key_us", "lineno").alias("first"))
    return first.select("file", F.row_number().over(Window.orderBy(F.col("first").asc_nulls_first(), "file")).alias("file_rank"))  # one row per file


def sample_errors(spark: SparkSession, cfg: Config) -> DataFrame:
    """Every line that can't be used: file, lineno, error."""
    return parse(spark, cfg).where("error is not null").select("file", "lineno", "error")


def observed_rates(rows: DataFrame, cfg: Config) -> DataFrame:
    """Per file: rows, observed rate, and whether it is off the declared one by over a hundredth."""
    g = rows.where("error is null").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("key_us", "lineno").alias("a"), F.max_by("key_us", "lineno").alias("b"))
    rate = F.when((F.col("n") > 1) & (F.col("b") > F.col("a")), (F.col("n") - 1) * MICROS / F.greatest(F.col("b") - F.col("a"), F.lit(1)))
    f = cfg.period.acquisition_frequency
    return g.select("file", "n", rate.alias("rate"), F.coalesce(F.abs(rate - f) > RATE_TOLERANCE * f, F.lit(False)).alias("off"))


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that several checks cost one parse."""
    from .roundtrip import shared_dir

    path = f"{shared_dir(spark)}/eddyforge-rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_samples(spark: SparkSession, cfg: Config, on_error: str = "raise", quoted_newlines: bool | None = None) -> DataFrame:
    """Cut samples of all files. ``raise`` stops at the first bad or late line, by file order and line
    number; ``quarantine`` leaves such lines to ``sample_errors`` and ``late_rows``.

    Files are parsed once, line by line in parallel, into a table that the checks and the result read.
    Only where a line leaves a quote open are they parsed again as records with line breaks in quoted
    cells; ``quoted_newlines`` true or false decides it beforehand. Files whose rate is off the declared
    one give a warning.
    """
    if on_error not in ("raise", "quarantine"):
        raise ValueError("on_error is 'raise' or 'quarantine'")
    try:
        rows = written(spark, parse(spark, cfg, bool(quoted_newlines)))
        again = quoted_newlines is None and not rows.where(F.col("error") == OPEN_QUOTE).isEmpty()
    except ReadError:  # a header may have line breaks too
        if quoted_newlines is not None:
            raise
        again = True
    if again:
        rows = written(spark, parse(spark, cfg, True))
    ranks = file_ranks(rows)
    good = rows.where("error is null").drop("error").join(ranks, "file")
    if on_error == "raise":
        bad = rows.where("error is not null").join(ranks, "file").orderBy("file_rank", "lineno").first()
        if bad is not None:
            raise ReadError(f"{bad['file']}, line {bad['lineno']}: {bad['error']}")
        late = late_rows(good, cfg).orderBy("file_rank", "lineno").first()
        if late is not None:
            raise ReadError(f"{late['file']}, line {late['lineno']}: the sample belongs to a period that is over")
    for r in observed_rates(rows, cfg).where("off").orderBy("file").limit(RATE_WARNINGS).collect():
        warnings.warn(f"{r['file']}: {r['rate']:.6g} samples a second, declared are {cfg.period.acquisition_frequency:.6g}", stacklevel=2)
    return cut_periods(good, cfg, ("file_rank", "lineno"))
