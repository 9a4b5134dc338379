"""The delimited reader: shapes it takes, places it names when it refuses."""

from __future__ import annotations

import csv
import datetime

import pytest
from pyspark.sql import functions as F

from eddyforge.__main__ import main
from eddyforge.config import default
from eddyforge.errors import ReadError
from eddyforge.plans import period_bounds
from eddyforge.sinks import render, write_csv
from eddyforge.sources import parse_timestamp, read_samples, sample_errors
from eddyforge.sources.delimited import observed_rates, parse

HEAD = "TIMESTAMP,Ux,Uy,Uz,Ts,CO2,H2O,Press"


def line(t, u=1.0, rest="0,0,300,400,10,99000"):
    return f"{t},{u},{rest}"


def write(tmp_path, name, lines, head=HEAD):
    (tmp_path / name).write_text("\n".join([head, *lines]) + "\n", encoding="utf-8")


def cfg_of(tmp_path, **changes):
    return default(files__input_glob=str(tmp_path / "*.dat"), period__averaging_minutes=1, period__acquisition_frequency=1, **changes)


def kept(spark, cfg):
    return [tuple(r) for r in read_samples(spark, cfg).orderBy("period_end_us", "i").select("i", "u", "n_in", "n_dup").collect()]


def us(text):
    t = datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc)
    return round(t.timestamp() * 1e6)


def test_plain_file(spark, tmp_path):
    write(tmp_path, "a.dat", [line("2025-01-01 00:00:01"), line("2025-01-01T00:00:02.5", 2.0), "", line('"2025-01-01 00:00:03"', 3.0)])
    rows = read_samples(spark, cfg_of(tmp_path)).orderBy("i").collect()
    assert [r["u"] for r in rows] == [1.0, 2.0, 3.0]
    assert rows[1]["key_us"] == us("2025-01-01 00:00:02.500000")
    assert rows[0]["co2"] == pytest.approx(400e-6) and rows[0]["h2o"] == pytest.approx(0.01) and rows[0]["ta"] is None


def test_duplicates_and_backward_samples_are_counted(spark, tmp_path):
    write(tmp_path, "a.dat", [line(f"2025-01-01 00:00:{s:02}", s) for s in (1, 2, 2, 5, 3, 4, 6)])
    assert kept(spark, cfg_of(tmp_path)) == [(0, 1.0, 4, 3), (1, 2.0, 4, 3), (2, 5.0, 4, 3), (3, 6.0, 4, 3)]


def test_files_go_by_first_sample_not_by_name(spark, tmp_path):
    write(tmp_path, "b.dat", [line("2025-01-01 00:00:01", 1), line("2025-01-01 00:00:02", 2)])
    write(tmp_path, "a.dat", [line("2025-01-01 00:00:03", 3)])
    assert [r[1] for r in kept(spark, cfg_of(tmp_path))] == [1.0, 2.0, 3.0]


def test_late_sample_is_refused_with_its_place(spark, tmp_path):
    write(tmp_path, "a.dat", [line("2025-01-01 00:05:01"), line("2025-01-01 00:01:01")])
    with pytest.raises(ReadError, match="a.dat, line 3: the sample belongs to a period that is over"):
        read_samples(spark, cfg_of(tmp_path))


def test_line_numbers_hold_across_splits(spark, tmp_path):
    for k in range(3):
        start = datetime.datetime(2025, 1, 1, k)
        lines = [line((start + datetime.timedelta(milliseconds=100 * i)).isoformat(" ", "milliseconds"), i) for i in range(20000)]
        lines[15000] = lines[15000].replace(",0,", ",bad,", 1)
        write(tmp_path, f"{k}.dat", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        bad = sample_errors(spark, cfg_of(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["file"][-5:], r["lineno"]) for r in bad) == [("0.dat", 15002), ("1.dat", 15002), ("2.dat", 15002)]


@pytest.mark.parametrize(
    "bad,says",
    [
        ("2025-01-01 00:00:02,1,0,0,300,400", "too few cells"),
        ("2025-01-01 00:00:02,1_0,0,0,300,400,10,99000", "column Ux: not a number: 1_0"),
        ("2025-01-01 00:00:02,1.0d,0,0,300,400,10,99000", "not a number"),
        ("2025-01-01 00:00:02.1234567,1,0,0,300,400,10,99000", "not a timestamp"),
        ("2025-13-01 00:00:02,1,0,0,300,400,10,99000", "not a timestamp"),
        ("2025-01-01 24:00:02,1,0,0,300,400,10,99000", "not a timestamp"),
        ("01/02/2025 00:00:02,1,0,0,300,400,10,99000", "not a timestamp"),
    ],
)
def test_refusals_name_file_and_line(spark, tmp_path, bad, says):
    write(tmp_path, "a.dat", [line("2025-01-01 00:00:01"), bad])
    with pytest.raises(ReadError, match=f"a.dat, line 3: .*{says}"):
        read_samples(spark, cfg_of(tmp_path))
    assert read_samples(spark, cfg_of(tmp_path), "quarantine").count() == 1


def test_missing_tokens_quotes_and_order_of_columns(spark, tmp_path):
    write(tmp_path, "a.dat", ['2025-01-01 00:00:01," 1.5 ",NAN,-9999,,nan,"10","99000"'])
    write(tmp_path, "b.dat", ['99000,2025-01-01 00:00:02,"x,""y""",2.5,0,0,300,400,10'], "Press,TIMESTAMP,Note,Ux,Uy,Uz,Ts,CO2,H2O")
    rows = read_samples(spark, cfg_of(tmp_path)).orderBy("i").collect()
    assert [r["u"] for r in rows] == [1.5, 2.5]
    assert rows[0]["v"] is None and rows[0]["w"] is None and rows[0]["ts"] is None and rows[0]["co2"] is None and rows[0]["p_air"] == 99000.0


def test_banner_lines_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.dat").write_text("﻿banner\n" + HEAD + "\nunits\n" + line("20250101000001.05") + "\n", encoding="utf-8")
    cfg = cfg_of(tmp_path, files__header_line=2, files__first_data_line=4, timestamp__format="numeric")
    assert read_samples(spark, cfg).first()["key_us"] == us("2025-01-01 00:00:01.050000")
    (tmp_path / "a.dat").write_text("﻿" + HEAD + "\n" + line("2025-01-01 00:00:01") + "\n", encoding="utf-8")
    assert read_samples(spark, cfg_of(tmp_path)).count() == 1


def test_newlines_in_quotes(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(b'\xef\xbb\xbf"TIMESTAMP","Note\nmore",Ux,Uy,Uz,Ts,CO2,H2O,Press\r\n2025-01-01 00:00:01,"a ""b""\nc",1.5,0,0,300,400,10,99000\r\n2025-01-01 00:00:02,x,bad,0,0,300,400,10,99000\r\n')
    cfg = cfg_of(tmp_path)
    assert [r["u"] for r in read_samples(spark, cfg, "quarantine", quoted_newlines=True).collect()] == [1.5]
    with pytest.raises(ReadError, match="line 5: column Ux"):
        read_samples(spark, cfg, quoted_newlines=True)
    with pytest.raises(ReadError, match="line 5: column Ux"):
        read_samples(spark, cfg)


def test_newlines_in_quoted_cells_need_no_argument(spark, tmp_path):
    write(tmp_path, "a.dat", ['2025-01-01 00:00:01,1.5,0,0,300,400,10,99000,"a', 'b"', '2025-01-01 00:00:02,2.5,0,0,300,400,10,99000,"c"'], HEAD + ",Note")
    assert [r["u"] for r in read_samples(spark, cfg_of(tmp_path)).orderBy("i").collect()] == [1.5, 2.5]
    with pytest.raises(ReadError, match="line 2: a quoted cell is not closed"):
        read_samples(spark, cfg_of(tmp_path), quoted_newlines=False)


def test_undecodable_bytes_and_unknown_encodings(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes((HEAD + "\n" + line("2025-01-01 00:00:01") + "\n").encode() + b"2025-01-01 00:00:02,1,0,0,300,400,10,99000,\xff\xfe\n")
    with pytest.raises(ReadError, match="a.dat, line 3: the line is not text"):
        read_samples(spark, cfg_of(tmp_path))
    assert read_samples(spark, cfg_of(tmp_path), "quarantine").count() == 1
    with pytest.raises(ReadError, match="not a known encoding"):
        read_samples(spark, cfg_of(tmp_path, files__encoding="utf-99"))


def test_a_rate_that_is_off_warns(spark, tmp_path):
    write(tmp_path, "a.dat", [line(f"2025-01-01 00:00:{s:02}") for s in range(1, 30, 2)])
    with pytest.warns(UserWarning, match="a.dat: 0.5 samples a second, declared are 1"):
        read_samples(spark, cfg_of(tmp_path))


@pytest.mark.parametrize("encoding", ["latin-1", "utf-16-le"])
def test_other_encodings(spark, tmp_path, encoding):
    text = HEAD.replace("Ux", "Vitesse é") + "\n" + line("2025-01-01 00:00:01", 1.5) + "\n" + line("2025-01-01 00:00:02", 2.5) + "\n"
    (tmp_path / "a.dat").write_bytes(text.encode(encoding))
    cfg = cfg_of(tmp_path, files__encoding={"latin-1": "ISO-8859-1", "utf-16-le": "UTF-16LE"}[encoding], variables__u="Vitesse é")
    assert [r["u"] for r in read_samples(spark, cfg).orderBy("i").collect()] == [1.5, 2.5]


def test_missing_column_and_no_file(spark, tmp_path):
    with pytest.raises(ReadError, match="no file matches"):
        read_samples(spark, cfg_of(tmp_path))
    write(tmp_path, "a.dat", [line("2025-01-01 00:00:01")], HEAD.replace("Uz", "Wz"))
    with pytest.raises(ReadError, match="column 'Uz' is not in the header: TIMESTAMP, Ux"):
        read_samples(spark, cfg_of(tmp_path))


def test_min_samples_and_rate(spark, tmp_path):
    write(tmp_path, "a.dat", [line(f"2025-01-01 00:{m:02}:{s:02}", s) for m, n in ((0, 30), (1, 5)) for s in range(1, n + 1)])
    assert {r[2] for r in kept(spark, cfg_of(tmp_path, period__min_samples=10))} == {30}
    assert [r["off"] for r in observed_rates(parse(spark, cfg_of(tmp_path)), cfg_of(tmp_path)).collect()] == [True]


@pytest.mark.parametrize("key,closed,want", [(0, "right", (-60, 0)), (1, "right", (0, 60)), (60_000_000, "right", (0, 60)), (60_000_000, "left", (60, 120)), (59_999_999, "left", (0, 60)), (-1, "left", (-60, 0)), (-60_000_000, "right", (-120, -60))])
def test_period_bounds(spark, key, closed, want):
    s, e = period_bounds(F.lit(key).cast("long"), 60_000_000, closed)
    assert tuple(x // 1_000_000 for x in spark.range(1).select(s, e).first()) == want


def test_timestamp_shapes(spark):
    t = ["2025-01-01 00:00:00", " 2025-01-01T00:00:00.1 ", "2025-02-29 00:00:00", "2024-02-29 00:00:00", "2025-01-01", None, "1969-12-31 23:59:59.999999"]
    df = spark.createDataFrame([(x,) for x in t], "t string")
    got = [r[0] for r in df.select(parse_timestamp(F.col("t"))).collect()]
    assert got == [us("2025-01-01"), us("2025-01-01") + 100_000, None, us("2024-02-29"), None, None, -1]


def test_render():
    assert [render(x, "-9999", "%.6g") for x in (None, float("nan"), float("inf"), 12.5, 3, True, 1234567.0)] == ["-9999", "-9999", "-9999", "12.5", "3", "1", "1.23457e+06"]


def test_command_line_end_to_end(spark, tmp_path, capsys):
    write(tmp_path, "a.dat", [line(f"2025-01-01 00:00:{s:02}", s % 7) for s in range(1, 60)] + [line("2025-01-01 00:01:00"), line("2025-01-01 00:01:01")])
    ini = tmp_path / "c.ini"
    ini.write_text(f"[files]\ninput_glob = {tmp_path}/*.dat\noutput_csv = {tmp_path}/out.csv\n[period]\naveraging_minutes = 1\nacquisition_frequency = 1\n")
    assert main(["check", str(ini)]) == 0 and "period.averaging_minutes = 1.0" in capsys.readouterr().out
    cfg = default(files__input_glob=str(tmp_path / "*.dat"), files__output_csv=str(tmp_path / "out.csv"), period__averaging_minutes=1, period__acquisition_frequency=1)
    from eddyforge.plans import publish, run

    assert write_csv(publish(run(read_samples(spark, cfg), cfg), cfg), cfg) == 2
    raw = (tmp_path / "out.csv").read_bytes()
    rows = list(csv.reader(raw.decode().splitlines()))
    assert raw.count(b"\r\n") == 3 and len(rows[0]) == 62 and rows[1][:3] == ["202501010000", "202501010001", "60"]
    units = list(csv.reader((tmp_path / "out_units.csv").read_text().splitlines()))
    assert units[0] == ["name", "unit"] and len(units) == 63
    ini.write_text("[files]\nx = 1\n")
    assert main(["check", str(ini)]) == 2
