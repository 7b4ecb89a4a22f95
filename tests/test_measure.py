import json

from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.plans import measure, stacks
from tessera.streaming import keyed as streamed

LINES = """goos: darwin
BenchmarkGrowthPlain/N1024-12   	 1000	  70.5 ns/op	  16 B/op	  1 allocs/op
BenchmarkGrowthPlain/N1024-12   	 1000	  71.5 ns/op	  18 B/op	  1 allocs/op
BenchmarkGrowthPlain/N2048-12   	 1000	  80 ns/op
BenchmarkGrowthConcurrent/N1024-12 	 10	  141 ns/op	  0 B/op
BenchmarkRadiusKD_Search/R10000-12 	 10	  7.5 ns/op	  0 B/op
PASS""".split("\n")


def test_lines_and_statistics(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    rows = measure.parse_lines(df)
    assert rows.count() == 5 and rows.where("kind = 'R'").first()["n"] == 10000
    s = {(r["name"], r["n"]): r for r in measure.band(measure.group_stats(rows, ["name", "n"], "ns")).collect()}
    a, b = s["GrowthPlain", 1024], s["GrowthPlain", 2048]
    assert a["mean"] == 71.0 and abs(a["sd"] - 0.5**0.5) < 1e-12 and b["sd"] == 0.0 and a["lo"] < a["mean"] < a["hi"]
    stats = measure.group_stats(rows, ["name", "n"], "ns")
    assert [tuple(r) for r in measure.joined(stats, "name", ["GrowthPlain", "GrowthConcurrent"]).collect()] == [(1024, 71.0, 141.0)]
    r = measure.last_ratio(stats, "name", "GrowthConcurrent", "GrowthPlain").first()
    assert (r["over_last"], r["under_last"], r["ratio"]) == (1024, 2048, 141.0 / 80.0)
    assert measure.routed(stats, "name", ["GrowthPlain", "GrowthConcurrent"]).count() == 3


def test_units(spark):
    df = spark.createDataFrame([("12.5ms",), ("3µs",), ("1s",), ("7ns",), ("2x",), ("",)], "t string")
    assert [r[0] for r in df.select(formats.nanoseconds(F.col("t"))).collect()] == [12.5e6, 3000.0, 1e9, 7.0, None, None]
    df = spark.createDataFrame([("1.5MB",), ("10B",), ("2kB",), ("1q",)], "t string")
    assert [r[0] for r in df.select(formats.bytes_of(F.col("t"))).collect()] == [1.5 * 1024**2, 10.0, 2048.0, None]
    df = spark.createDataFrame([(5.0,), (1500.0,), (2.5e6,), (3e9,)], "n double")
    assert [r[0] for r in df.select(formats.duration(F.col("n"))).collect()] == ["5.0 ns", "1.50 µs", "2.50 ms", "3.00 s"]
    df = spark.createDataFrame([(1000,), (2_000_000,), (1234,)], "n long")
    assert [tuple(r) for r in df.select(formats.short_count(F.col("n")), formats.grouped_number(F.col("n"))).collect()] == [("1k", "1 000"), ("2M", "2 000 000"), ("1234", "1 234")]


def test_profiles(spark):
    rows = ["File: x", "      flat  flat%   sum%        cum   cum%", "     0.38s 10.00% 10.00%      0.40s 12.00%  syscall.syscall", "     0.1s 1.00% 10.00%      0.5s 12.00%  runtime.mstart", "     0.1s 1.00% 10.00%      30ms 1.00%  lib/table.Flush (inline)", "     0.1s 1.00% 10.00%      20ms 1.00%  lib/table.Flush (inline)"]
    df = measure.parse_top(spark.createDataFrame([(x,) for x in rows], "value string"), formats.nanoseconds)
    top = measure.top_profile(df, ["runtime."], ["lib/"])
    assert [(r["place"], r["name"], r["cum"]) for r in top.orderBy("place").collect()] == [(1, "lib/table.Flush (inline)", 30e6), (2, "syscall.syscall", 0.4e9)]
    assert [r["label"] for r in measure.profile_table(top, 0.1, 5, 12).orderBy("place").collect()] == ["lib/table...", "syscall.s..."]


def test_reports(spark):
    rows = spark.createDataFrame([("LSH 32", 0.1, 2.0, 0.1, 10, 1.0), ("LSH 64", 0.3, 1.0, 0.2, 20, 1.0), ("HNSW 1", 0.3, 3.0, 0.3, 30, 1.0)], "name string, recall double, search_ms_per_q double, search_ms_stdev double, index_bytes long, build_s double")
    best = {r["family"]: r["name"] for r in measure.best_of(rows, F.split_part("name", F.lit(" "), F.lit(1))).collect()}
    assert best == {"LSH": "LSH 64", "HNSW": "HNSW 1"}
    assert measure.best_score(rows).first()["name"] == "LSH 64"
    assert [r["search"] for r in measure.ann_table(rows, "LSH").collect()] == ["2.0000 ± 0.3000", "1.0000 ± 0.6000"]
    assert [r[0] for r in measure.markdown(rows, ["name"], ["name", "recall"]).collect()] == ["| name | recall |", "| --- | --- |", "| HNSW 1 | 0.3 |", "| LSH 32 | 0.1 |", "| LSH 64 | 0.3 |"]
    text = spark.createDataFrame([("# T\nx\n## One\na\nb\n\n## Two\nc\n",)], "value string")
    assert [tuple(r) for r in measure.sections(text).orderBy("place").collect()] == [(1, "One", "a\nb"), (2, "Two", "c")]
    df = spark.createDataFrame([("p\n<!-- t:start -->\nold\n<!-- t:end -->\nq",)], "v string")
    assert df.select(measure.replace_block(F.col("v"), "t", "$new\\")).first()[0] == "p\n<!-- t:start -->\n$new\\\n<!-- t:end -->\nq"


def test_stacks(spark):
    data = {"Stacks": [{"Value": 5, "Sources": [0, 1, 2]}, {"Value": 3, "Sources": [0, 1]}, {"Value": 2, "Sources": [0, 3]}, {"Value": 0, "Sources": [0, 4]}], "Sources": [{"FullName": "}{", "Display": ["\"}"]}], "Scale": 1.0, "Unit": "ns"}
    pages = spark.createDataFrame([("<script>stackViewer({}); stackViewer(" + json.dumps(data) + ", x)</script>",), ("none",), (None,), ("stackViewer({broken",)], "html string")
    found = pages.select(stacks.embedded_json(F.col("html")).alias("data")).where("data is not null")
    assert found.count() == 1
    rows = stacks.paths(found)
    totals = stacks.prefix_totals(rows).cache()
    assert {tuple(r["prefix"]): r["total"] for r in totals.collect()} == {(1,): 8, (1, 2): 5, (3,): 2}
    assert stacks.height(rows).first()[0] == 2
    got = {tuple(r["prefix"]): (r["offset"], r["percent"]) for r in stacks.layout(totals).collect()}
    assert got == {(1,): (0, 80.0), (1, 2): (0, 50.0), (3,): (8, 20.0)}
    assert stacks.focus(totals, F.element_at("prefix", -1) >= 2).first()["prefix"] == [3]


def test_time_prefixes_and_names_without_size(spark):
    rows = ["BenchmarkX/N10-8 5 2.5 µs/op 1 B/op 2 allocs/op", "BenchmarkX/N10 5 3 us/op", "BenchmarkY 5 4 ms/op", "BenchmarkZ/R7-2 1 0.5 s/op 3 B/op", "  BenchmarkP/sub-4 1 7 ns/op", "Benchmark odd", "x\x01y\x01z\x01\x01\x01\x01"]
    got = measure.parse_lines(spark.createDataFrame([(x,) for x in rows], "value string")).collect()
    assert [tuple(r) for r in got] == [("X", "N", 10, 2500.0, 1.0, 2.0), ("X", "N", 10, 3000.0, None, None), ("Y", None, None, 4e6, None, None), ("Z", "R", 7, 5e8, 3.0, None), ("P/sub", None, None, 7.0, None, None)]


def test_report_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("LSH 32", 0.1, 2.0, 0.1, 10_000_000, 1.0), ("LSH 64", 0.3, 1.0, None, 20_000_000, 1.0)], "name string, recall double, search_ms_per_q double, search_ms_stdev double, index_bytes long, build_s double")
    family = F.split_part("name", F.lit(" "), F.lit(1))
    got = [r[0] for r in measure.report(rows, ["LSH", "IVF"], family, demo=True).collect()]
    best = "- `LSH 64`\n- recall: **0.3000**\n- search: **1.0000 ± 0.0000** ms/q\n- build: **1.00** s\n- size: **20.00** MB"
    assert got == ["*(generated vectors)*", f"## LSH\n\n{best}", "## IVF\n\n—", f"## Best by score\n\n{best}"]
    schema = "name string, recall double, index_bytes long"
    measure.write_metrics(rows, f"{tmp_path}/m", demo=True)
    want = sorted((r["name"], r["recall"], r["index_bytes"]) for r in rows.collect())
    assert sorted(map(tuple, measure.read_metrics(spark, f"{tmp_path}/m", schema).collect())) == want
    (tmp_path / "plain.json").write_text(json.dumps([{"name": n, "recall": x, "index_bytes": b} for n, x, b in want], indent=2))
    assert sorted(map(tuple, measure.read_metrics(spark, f"{tmp_path}/plain.json", schema).collect())) == want


def test_streams_of_many_batches(spark, tmp_path):
    rows = [(f"k{i % 7}", 2 if i % 5 == 0 else 1, i, i) for i in range(60)]
    for part in range(4):
        spark.createDataFrame(rows[part::4], "key string, op int, value long, seq long").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    schema = "key string, op int, value long, seq long"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state = {}
    for k, op, v, _ in rows:
        state.pop(k, None) if op == 2 else state.update({k: v})
    got = streamed.upserts(read().withColumnRenamed("seq", "order"), "key string, value long")
    assert {r["key"]: r["value"] for r in got.collect()} == state
    sums = {}
    for k, _, v, _ in rows:
        sums[k] = sums.get(k, 0) + v
    assert {r["key"]: r["value"] for r in streamed.merges(read(), "key", F.sum("value"), "key string, value long").collect()} == sums


def test_streams_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streamed, "COMPACT", 2)
    rows = [(f"k{i % 7}", 2 if i % 5 == 0 else 1, i, i) for i in range(60)]
    schema = "key string, op int, value long, order long"
    write = lambda part: spark.createDataFrame(rows[part::4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def state(parts):
        out = {}
        for k, op, v, _ in sorted((r for p in parts for r in rows[p::4]), key=lambda r: r[3]):
            out.pop(k, None) if op == 2 else out.update({k: v})
        return out

    def sums(parts):
        out = {}
        for k, _, v, _ in (r for p in parts for r in rows[p::4]):
            out[k] = out.get(k, 0) + v
        return out

    for done in ((0, 1), (0, 1, 2, 3)):
        for part in done[-2:]:
            write(part)
        got = streamed.upserts(read(), "key string, value long", f"file://{tmp_path}/state")
        assert {r["key"]: r["value"] for r in got.collect()} == state(done)
        got = streamed.merges(read(), "key", F.sum("value"), "key string, value long", f"file://{tmp_path}/sums")
        assert {r["key"]: r["value"] for r in got.collect()} == sums(done)
    assert (tmp_path / "state" / "upto=1").exists() and (tmp_path / "state" / "upto=3").exists()
    table = streamed.Changes(spark, f"file://{tmp_path}/state", "key string, value long")
    assert {r["key"]: r["value"] for r in table.read().where("there").collect()} == state(range(4))
