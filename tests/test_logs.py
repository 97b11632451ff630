from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.errors import InvalidInput, ResourceLimit
from stratalith.functions.numbers import parse_number, ulp
from stratalith.operators import logs
from stratalith.options import LogOptions
from stratalith.plans.correlation import correlate, read_log
from stratalith.sources.csv_logs import read_curve, read_curves, resolve_names, well_names, write_one_csv


def raw(spark, rows):
    return spark.createDataFrame(rows, "log_id int, md double, value double")


def test_parse_number(spark):
    cases = {"1 234,5": 1234.5, "1 234,5": 1234.5, "1,234.5": None, "1d": None, "1.5f": None, "": None, " NA": None, "NA": None, "-2e3": -2000.0, ".5": 0.5, "5.": 5.0, "inf": float("inf"), "-Infinity": float("-inf"), "0x10": None, "1e": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases


def test_ulp(spark):
    xs = [1.0, 0.9999999999999999, 3.7, 1e6, 2.0**40, 123456.789, 2.0**-10]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ulp(F.col("x")).alias("u")).collect()
    assert all(r.u == np.spacing(r.x) for r in got)


def test_clean(spark):
    rows = [(0, 1.0, 2.0), (0, 1.0, None), (0, 2.0, -999.25), (0, 3.0, float("nan")), (0, None, 4.0), (0, -999.25, 5.0), (0, 4.0, 1.0), (0, 4.0, 2.0)]
    got = logs.clean(raw(spark, rows), (-999.25,)).orderBy("md").collect()
    assert [(r.md, r.value) for r in got] == [(-999.25, 5.0), (1.0, 2.0), (4.0, 1.5)]


@pytest.mark.parametrize("top, span, step", [(0, 1, 0.3), (0, 1, 0.25), (-3, 10, 0.7), (1e6, 12.5, 0.1), (0, 1, 2)])
def test_grid_and_interpolation(spark, top, span, step):
    md = top + np.array([0, 0.1, 0.35, 0.8, 1]) * span
    values = np.array([1.0, 5, 2, 2, 7])
    c = logs.clean(raw(spark, [(3, float(m), float(v)) for m, v in zip(md, values, strict=True)]), ())
    got = logs.interpolate(logs.regular_grid(logs.grid_plan(c, step), step), c).orderBy("idx").toPandas()
    assert got.md.iloc[0] == md[0] and got.md.iloc[-1] == md[-1]
    assert (np.diff(got.md) > 0).all() and np.allclose(np.diff(got.md)[:-1], step)
    assert np.allclose(got.value, np.interp(got.md, md, values), rtol=1e-14, atol=1e-12)


def test_golden_grid(spark):
    c = logs.clean(raw(spark, [(0, 0.0, 1.0), (0, 1.0, 2.0)]), ())
    assert [r.md for r in logs.regular_grid(logs.grid_plan(c, 0.3), 0.3).orderBy("idx").collect()] == pytest.approx([0, 0.3, 0.6, 0.9, 1.0])


def test_normalise(spark):
    x = np.random.default_rng(1).normal(size=50) * 3 + 1e9
    got = logs.normalise(raw(spark, [(0, float(k), float(v)) for k, v in enumerate(x)]), (5, 95)).orderBy("md").toPandas().z
    s = np.clip(x, *np.percentile(x, [5, 95]))
    assert np.allclose(got, (s - s.mean()) / s.std(), atol=1e-6)


def test_prepare_errors(spark):
    flat = [(0, float(k), 1.0) for k in range(5)]
    with pytest.raises(InvalidInput, match="constant"):
        logs.prepare(raw(spark, flat))
    with pytest.raises(InvalidInput, match="infinite"):
        logs.prepare(raw(spark, [*flat, (0, 9.0, float("inf"))]))
    with pytest.raises(InvalidInput, match="fewer than two"):
        logs.prepare(raw(spark, [(0, 1.0, 1.0), (0, 2.0, None)]))
    wide = [(0, 0.0, 1.0), (0, 1.0, 2.0), (0, 2.0, 1.0), (0, 50.0, 3.0)]
    with pytest.raises(InvalidInput, match="gap"):
        logs.prepare(raw(spark, wide))
    assert logs.prepare(raw(spark, wide), LogOptions(interpolate_all_gaps=True)).count() == 51
    with pytest.raises(ResourceLimit):
        logs.prepare(raw(spark, wide), LogOptions(interpolate_all_gaps=True, max_resampled_points=20))
    with pytest.raises(MemoryError):
        logs.prepare(raw(spark, wide), LogOptions(step=1e-9, interpolate_all_gaps=True))


@pytest.mark.parametrize("bad", [{"step": 0}, {"step": float("inf")}, {"missing_values": (float("nan"),)}, {"max_interpolation_gap": 1, "interpolate_all_gaps": True}, {"max_interpolation_gap": -1}, {"clip_percentiles": (5, 5)}, {"clip_percentiles": (5, 101)}, {"max_resampled_points": 1}])
def test_bad_log_options(bad):
    with pytest.raises(ValueError):
        LogOptions(**bad)


@pytest.mark.parametrize("encoding, sep", [("utf-8-sig", ","), ("utf-8", ";"), ("cp1251", ";"), ("latin1", "\t")])
def test_csv(spark, tmp_path, encoding, sep):
    note = "é" if encoding == "latin1" else "ГК"
    number = (lambda x: str(x)) if sep == "," else (lambda x: str(x).replace(".", ","))
    text = sep.join([" MD ", "GR", note]) + "\n" + "".join(sep.join([number(k / 2), number(v), note]) + "\n" for k, v in enumerate([1.5, -999.25, 2.5, 3.25]))
    f = tmp_path / "w.csv"
    f.write_bytes(text.encode(encoding))
    got = read_curve(spark, f).orderBy("md").collect()
    assert [(r.md, r.value) for r in got] == [(0.0, 1.5), (0.5, -999.25), (1.0, 2.5), (1.5, 3.25)]


def test_csv_errors(spark, tmp_path):
    f = tmp_path / "w.csv"
    f.write_text("MD,SP\n1,2\n")
    for bad in (lambda: read_curve(spark, f), lambda: read_curve(spark, f, "MD", "MD"), lambda: read_curve(spark, f, " "), lambda: read_curve(spark, tmp_path / "none.csv")):
        with pytest.raises(ValueError):
            bad()
    f.write_text("")
    with pytest.raises(ValueError):
        read_curve(spark, f)


def test_names(spark, tmp_path):
    assert well_names(["/a/B1/well_gis.csv", "/a/X.csv"]) == ["B1", "X"]
    assert well_names(["/a/p/X.csv", "/a/r/x.csv", "/a/Y.csv"]) == ["p", "r", "Y"]
    for files, names in ((["/a/X.csv", "/b/Y.csv"], ["only"]), (["/a/X.csv", "/b/Y.csv"], "XY"), (["/a/X.csv", "/b/Y.csv"], ["x", "X"]), (["/a/X.csv", "/a/x.csv"], None), (["/a/X.csv", "/b/Y.csv"], ["x", " "])):
        with pytest.raises(ValueError):
            well_names(files, names)
    paths = ["/a/B1/well_gis.csv", "/a/p/X.csv", "/a/r/x.csv", "/a/Y.v2.csv"]
    got = resolve_names(spark.createDataFrame(list(enumerate(paths)), "log_id int, path string"))
    assert [r.name for r in got.orderBy("log_id").collect()] == ["B1", "p", "r", "Y.v2"]


def make_wells(folder, n=3):
    rng = np.random.default_rng(0)
    base = np.cumsum(rng.normal(size=120))
    files = []
    for k in range(n):
        md = np.arange(120) * 0.5 + k
        f = folder / f"W{k}.csv"
        f.write_text("MD;GR\n" + "".join(f"{a:.2f};{b:.4f}\n".replace(".", ",") for a, b in zip(md, np.roll(base, k) + rng.normal(size=120) * 0.05, strict=True)))
        files.append(f)
    return files


def test_correlate_files(spark, tmp_path):
    said = []
    files = make_wells(tmp_path)
    t = correlate(spark, files, progress=said.append).toPandas()
    assert set(zip(t.left_well, t.right_well, strict=True)) == {("W0", "W1"), ("W1", "W2")} and len(said) == 2
    assert read_log(spark, files[0]).count() == 120
    for bad in (files[:1], str(files[0])):
        with pytest.raises(ValueError):
            correlate(spark, bad)


def test_cli(spark, tmp_path, capsys):
    from stratalith.cli import main

    files = [str(f) for f in make_wells(tmp_path, 2)]
    out = tmp_path / "deep" / "out.csv"
    assert main([*files, "-o", str(out), "--quiet"]) == 0
    lines = out.read_text().splitlines()
    assert lines[0].startswith("pair,left_well,right_well") and len(lines) > 100
    for bad in ([*files, "-o", str(out)], [files[0]], [*files, "-o", files[0]], [*files, "--window", "2", "-o", "x"], [*files, "--curve", "XX", "-o", str(tmp_path / "y.csv")], [*files, "--max-warp-run", "-1"], [*files, "--step", "0"], [*files, "--max-interpolation-gap", "3", "--interpolate-all-gaps"], [*files, "--max-dtw-cells", "10", "-o", str(tmp_path / "z.csv")]):
        with pytest.raises(SystemExit):
            main(bad)
    assert main([*files, "-o", str(out), "--overwrite", "--quiet"]) == 0
    assert [p.name for p in out.parent.iterdir()] == ["out.csv"]


def test_write_fails_cleanly(spark, tmp_path):
    frame = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        write_one_csv(frame, tmp_path / "o.csv")
    assert not list(tmp_path.iterdir())


def test_stream(spark, tmp_path):
    from stratalith.streaming.recorrelate import start

    rng = np.random.default_rng(2)
    rows = [(k, float(m), float(v)) for k in range(3) for m, v in enumerate(np.cumsum(rng.normal(size=60)))]
    wells = spark.createDataFrame([(k, k, f"w{k}") for k in range(3)], "log_id int, ord long, name string")
    src = str(tmp_path / "in")
    options = LogOptions(step=1.0)
    for part in (rows[:120], rows[120:]):
        spark.createDataFrame(part, "log_id int, md double, value double").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("log_id int, md double, value double").parquet(src)
        start(stream, wells, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "cp"), options).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.pair for r in got.select("pair").distinct().collect()} == {0, 1}


def test_encoding_is_that_of_the_whole_file(spark, tmp_path):
    """The first byte that is not ASCII may come after any number of rows; blanks of thousands in single-byte encodings are no unknown characters."""
    f = tmp_path / "late.csv"
    f.write_bytes("MD;GR\n".encode() + b"".join(b"%d;%d\n" % (k, k) for k in range(20_000)) + b"".join(b"%d;1\xa0234,5\n" % k for k in range(20_000, 20_010)))
    got = read_curve(spark, f)
    assert got.filter("value = 1234.5").count() == 10 and got.filter("value IS NULL").count() == 0
    f.write_bytes("MD;GR;комментарий\n".encode("cp1251") + b"1;2;\xe9\n")
    assert [tuple(r) for r in read_curve(spark, f).collect()] == [(0, 1.0, 2.0)]


def test_quoted_line_breaks_and_odd_rows(spark, tmp_path):
    f = tmp_path / "a b [1]{x}.csv"
    f.write_text('note,MD,GR\n"two\nlines, one field",1,"2.5"\n\nshort\n"a ""b""",2,3,\n', encoding="utf-8")
    assert [(r.md, r.value) for r in read_curve(spark, f).orderBy("md").collect()] == [(None, None), (1.0, 2.5), (2.0, 3.0)]
    f.write_text("MD,GR\n1,2\n1,2,3\n")
    with pytest.raises(InvalidInput, match="line 3"):
        read_curve(spark, f)


def test_many_files_are_one_scan(spark, tmp_path):
    files = make_wells(tmp_path, 5)
    got = read_curves(spark, [*files, files[0]])
    assert {r.log_id: r["count"] for r in got.groupBy("log_id").count().collect()} == dict.fromkeys(range(6), 120)
    (tmp_path / "bad.csv").write_text("MD,SP\n1,2\n")
    with pytest.raises(InvalidInput, match="bad.csv.*SP"):
        read_curves(spark, [*files, tmp_path / "bad.csv"])


def test_interpolation_is_linear_in_length(spark):
    """A log of 200,000 knots and as many depths: the most that options allow."""
    import time

    n = 200_000
    knots = spark.range(n).selectExpr("0 AS log_id", "id * 1.0D AS md", "CAST(id % 7 AS DOUBLE) AS value")
    grid = spark.range(n).selectExpr("0 AS log_id", "CAST(id AS INT) AS idx", "id * 0.9999D AS md")
    begin = time.perf_counter()
    got = logs.interpolate(grid, knots).toPandas().sort_values("idx")
    assert time.perf_counter() - begin < 60
    md = np.arange(n) * 0.9999
    assert np.allclose(got.value, np.interp(md, np.arange(n), np.arange(n) % 7.0), atol=1e-9)


def test_write_one_csv(spark, tmp_path):
    import csv

    rows = [(k, f'a "{k}",\n', k / 3 if k % 2 else None, k % 3 == 0) for k in range(50)]
    frame = spark.createDataFrame(rows, "k int, t string, x double, b boolean").repartition(7)
    out = tmp_path / "o.csv"
    write_one_csv(frame, out, order=("k",))
    with open(out, newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == ["k", "t", "x", "b"] and [(int(a), b, float(c) if c else None, d == "True") for a, b, c, d in got[1:]] == rows
    with pytest.raises(ValueError):
        write_one_csv(frame, out)
    write_one_csv(frame.limit(0), out, overwrite=True)
    assert out.read_text() == "k,t,x,b\n" and [p.name for p in tmp_path.iterdir()] == ["o.csv"]


def test_cli_options():
    from stratalith.cli import FLAGS, build_parser, read_options
    from stratalith.options import CORRELATE, STANDARD_MISSING

    parse = lambda *more: read_options(build_parser().parse_args(["a", "b", *more]))
    assert parse() == (LogOptions(), CORRELATE)
    log, warp = parse("--sampling-step", "2", "--missing-value", "-1", "--missing-value", "7", "--clip-percentiles", "1", "99", "--max-warp-run", "0", "--window-ratio", "0.5", "--max-resampled-points", "9")
    assert (log.step, log.missing_values, log.clip_percentiles, log.max_resampled_points) == (2.0, (*STANDARD_MISSING, -1.0, 7.0), (1.0, 99.0), 9)
    assert (warp.max_warp_run, warp.window) == (None, 0.5)
    assert parse("--no-standard-missing-values", "--interpolate-all-gaps")[0] == LogOptions(missing_values=(), interpolate_all_gaps=True)
    for bad in (["--step", "nan"], ["--step", "-1"], ["--window", "1.5"], ["--warp-penalty", "-1"], ["--max-warp-run", "-2"], ["--max-dtw-cells", "0"], ["--max-memory-mb", "inf"], ["--clip-percentiles", "9", "3"]):
        with pytest.raises(ValueError):
            parse(*bad)
    assert len(FLAGS) == 11
