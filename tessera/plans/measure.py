"""Measurement text to tables: parsing, grouped statistics, bands, joins of families, rankings and text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import per_second

#: A benchmark line: name, size (N) or radius (R), repetitions, time and its unit, B/op, allocs/op.
LINE = r"^\s*Benchmark(\S+?)(?:/([NR])(\d+))?(?:-\d+)?\s+\d+\s+([\d.]+)\s+([nuµm]?)s/op(?:.*?\s([\d.]+)\s+B/op)?(?:\s+(\d+)\s+allocs/op)?[\s\S]*$"
#: Nanoseconds in the unit that stands before s/op.
PREFIXES = {"n": 1.0, "u": 1e3, "µ": 1e3, "m": 1e6, "": 1e9}


def parse_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """(name, kind, n, ns, b, allocs) of benchmark lines; others go. Parts that a line lacks are null. The pattern is matched once:
    a line becomes its parts between marks, and only what matched has seven. Lines that hold such a mark themselves go."""
    marked = F.when(~F.contains(F.col(text), F.lit("\x01")), F.regexp_replace(text, LINE, "\x01".join(f"${k}" for k in range(1, 8))))
    # Behind a generator, so that the parts are not worked out anew for each column that is taken from them.
    rows = lines.select(F.explode(F.array(F.split(marked, "\x01"))).alias("_p")).where(F.size("_p") == 7)
    part = lambda k: F.nullif(F.col("_p")[k - 1], F.lit(""))
    factor = F.lit(1.0)
    for unit, ns in PREFIXES.items():
        factor = F.when(F.col("_p")[4] == unit, F.lit(ns)).otherwise(factor)
    return rows.select(part(1).alias("name"), part(2).alias("kind"), part(3).cast("long").alias("n"), (part(4).cast("double") * factor).alias("ns"), part(6).cast("double").alias("b"), part(7).cast("double").alias("allocs"))


def group_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, samples, mean and sample deviation; 0 for one sample."""
    return rows.groupBy(*by).agg(F.count(value).alias("samples"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def band(stats: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """With lo and hi: the mean less and more sigmas deviations, lo not below 0."""
    return stats.withColumns({"lo": F.greatest(F.col("mean") - sigmas * F.col("sd"), F.lit(0.0)), "hi": F.col("mean") + sigmas * F.col("sd")})


def throughput(stats: DataFrame) -> DataFrame:
    return stats.withColumn("ops", per_second(F.col("mean")))


def routed(stats: DataFrame, family: str, families: list[str], on: str = "n") -> DataFrame:
    """A column of means for each family, by on."""
    return stats.groupBy(on).pivot(family, families).agg(F.first("mean"))


def joined(stats: DataFrame, family: str, names: list[str], on: str = "n", value: str = "mean") -> DataFrame:
    """Families side by side where all of them have the key."""
    out = None
    for name in names:
        side = stats.where(F.col(family) == name).select(on, F.col(value).alias(name))
        out = side if out is None else out.join(side, on)
    return out


def last_ratio(stats: DataFrame, family: str, over: str, under: str, on: str = "n", value: str = "mean") -> DataFrame:
    """(last, over, under, ratio) of two families at each one's largest key."""
    each = lambda name, a: stats.where(F.col(family) == name).agg(F.max(on).alias(f"{a}_last"), F.max_by(value, on).alias(a))
    both = each(over, "over").join(each(under, "under"))
    return both.withColumn("ratio", F.when(F.col("under") == 0, F.lit(None)).otherwise(F.col("over") / F.col("under")))


#: A row of a profile's top table: flat, flat%, sum%, cum, cum%, name.
TOP = r"^\s*(\S+)\s+([\d.]+)%\s+([\d.]+)%\s+(\S+)\s+([\d.]+)%\s+(.+?)\s*$"


def parse_top(lines: DataFrame, amount, text: str = "value") -> DataFrame:
    """(name, cum) of a profile's rows; amount turns text with a unit into a number. Header lines go."""
    kept = lines.where(F.col(text).rlike(TOP))
    return kept.select(F.regexp_extract(text, TOP, 6).alias("name"), amount(F.regexp_extract(text, TOP, 4)).alias("cum")).where("cum is not null")


def top_profile(rows: DataFrame, blocked: list[str], preferred: list[str], k: int = 8) -> DataFrame:
    """(place, name, cum): each name's largest value; no blocked prefixes; names with a preferred prefix first, then by value."""
    starts = lambda prefixes: F.lit(False) if not prefixes else F.greatest(*[F.startswith("name", F.lit(p)) for p in prefixes], F.lit(False))
    each = rows.where(~starts(blocked)).groupBy("name").agg(F.max("cum").alias("cum"))
    best = each.withColumn("first", starts(preferred).cast("int")).orderBy(F.desc("first"), F.desc("cum"), "name").limit(k)
    order = Window.orderBy(F.desc("first"), F.desc("cum"), "name")  # k rows
    return best.select(F.row_number().over(order).alias("place"), "name", "cum")


def profile_table(top: DataFrame, least: float = 0.01, k: int = 5, width: int = 48) -> DataFrame:
    """The first k rows of at least least, names cut to width with dots."""
    label = F.when(F.length("name") > width, F.concat(F.substring("name", 1, width - 3), F.lit("..."))).otherwise(F.col("name"))
    return top.where(F.col("cum") >= least).orderBy("place").limit(k).select("place", label.alias("label"), "cum")


def best_of(rows: DataFrame, family: Column) -> DataFrame:
    """Of each family the row of the highest recall, then the shortest search, then the fewest bytes, then the name."""
    order = Window.partitionBy("family").orderBy(F.desc("recall"), "search_ms_per_q", "index_bytes", "name")
    return rows.withColumn("family", family).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def score(recall: Column, ms: Column, size: Column, build: Column) -> Column:
    above = lambda c: c + F.lit(1e-6)
    return recall / F.pow(above(ms), F.lit(0.25)) / F.pow(above(size), F.lit(0.1)) / F.pow(above(build), F.lit(0.05))


def best_score(rows: DataFrame) -> DataFrame:
    """The one row of the highest score."""
    s = score(F.col("recall"), F.col("search_ms_per_q"), F.col("index_bytes"), F.col("build_s"))
    return rows.withColumn("score", s).orderBy(F.desc("score"), "name").limit(1)


def ann_table(rows: DataFrame, prefix: str, sigmas: float = 3.0) -> DataFrame:
    """Rows of a family as text, by recall, then time."""
    return rows.where(F.startswith("name", F.lit(prefix))).orderBy("recall", "search_ms_per_q").select(
        "name",
        F.format_string("%.4f", "recall").alias("recall"),
        F.format_string("%.4f ± %.4f", F.col("search_ms_per_q"), sigmas * F.col("search_ms_stdev")).alias("search"),
        F.format_string("%.2f", F.col("index_bytes") / 1e6).alias("mb"),
    )


def best_lines(rows: DataFrame, family: Column, sigmas: float = 3.0) -> DataFrame:
    """(family, line): the best row of each family as text: name, recall, search time, build time, size."""
    best = best_of(rows, family)
    text = F.format_string(
        "- `%s`\n- recall: **%.4f**\n- search: **%.4f ± %.4f** ms/q\n- build: **%.2f** s\n- size: **%.2f** MB",
        "name", "recall", "search_ms_per_q", sigmas * F.coalesce(F.col("search_ms_stdev"), F.lit(0.0)), "build_s", F.col("index_bytes") / 1e6,
    )
    return best.select("family", text.alias("line"))


def report(rows: DataFrame, families: list[str], family: Column, sigmas: float = 3.0, demo: bool = False) -> DataFrame:
    """(line): a report of a sweep: for each family its best row, or a dash, then the best of all by score."""
    spark = rows.sparkSession
    named = spark.createDataFrame([(k, f) for k, f in enumerate(families)], "at int, family string")
    each = named.join(best_lines(rows, family, sigmas), "family", "left").select("at", F.concat(F.lit("## "), "family", F.lit("\n\n"), F.coalesce("line", F.lit("—"))).alias("line"))
    last = best_lines(best_score(rows), F.lit("all"), sigmas).select(F.lit(len(families)).alias("at"), F.concat(F.lit("## Best by score\n\n"), "line").alias("line"))
    first = spark.createDataFrame([(-1, "*(generated vectors)*")] if demo else [], "at int, line string")
    return first.union(each).union(last).orderBy("at").select("line")


def write_metrics(rows: DataFrame, path: str, **facts) -> None:
    """A report's rows as one JSON object: facts, and "rows", an array. For tables of a report's size."""
    whole = rows.agg(F.collect_list(F.struct("*")).alias("rows"))
    whole.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in facts.items()], "rows")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold an array of objects, or an object whose "rows" is one."""
    text = spark.read.text(path, wholetext=True)
    kind = f"array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in schema.split(','))}>>"
    told = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(F.get_json_object("value", "$.rows"))
    return text.select(F.explode(F.from_json(told, kind)).alias("r")).select("r.*")


def markdown(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """(line): a table's lines in order, head first. Lines take ascending numbers from their sorted partitions."""
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "at long, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = rows.orderBy(*order).select((F.monotonically_increasing_id() + 2).alias("at"), line.alias("line"))
    return head.union(body).orderBy("at").select("line")


def sections(texts: DataFrame, text: str = "value") -> DataFrame:
    """(place, title, body) of a markdown text's second-level headings."""
    parts = texts.select(F.posexplode(F.split(text, r"(?m)^## ")).alias("place", "part")).where("place > 0")
    return parts.select("place", F.trim(F.substring_index("part", "\n", 1)).alias("title"), F.trim(F.expr("substring(part, length(substring_index(part, '\\n', 1)) + 2)"), F.lit(" \n")).alias("body"))


def replace_block(text: Column, name: str, content: str) -> Column:
    """What stands between <!-- name:start --> and <!-- name:end --> becomes content."""
    quoted = content.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, F.lit(rf"(?s)(<!-- {name}:start -->\n).*?(<!-- {name}:end -->)"), F.lit(f"$1{quoted}\n$2"))
