"""Registered queries of the core operators, each over whole tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats, hashing, sphere
from .operators import keyed, nearpairs, neighbours, radius, static
from .plans import measure, stacks
from .session import shared_path, written
from .sources import oplog
from .streaming import keyed as streamed

BUCKETS = 64
THRESHOLD = 0.5
TABLES = nearpairs.Tables.drawn(10, THRESHOLD)
K = 10
BITS = 64
#: Inverted lists, and how many of them a query probes. The tables' vectors are spread evenly, so few lists don't hold the nearest.
LISTS, PROBES = 16, 12
DIRECTIONS = np.round(np.random.default_rng(5).normal(size=(BITS, 64)), 6)
FAMILIES = ["A", "N", "R"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def operations(spark: SparkSession, sf: str) -> DataFrame:
    """events as an operation log: user_id is the key, an error deletes it."""
    op = F.when(F.col("event_type") == "error", oplog.DELETE).otherwise(oplog.SET)
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), op.alias("op"), "value", "ts", "event_id")


def cents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))


ORDER = ("ts", "event_id")
REPLAYED = """SELECT user_id AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"""


@query(REPLAYED)
def kv_replay_state(spark, sf):
    return keyed.replay(operations(spark, sf), order=ORDER)


@query(f"WITH s AS ({REPLAYED}) SELECT c_custkey AS key, s.value, s.key IS NOT NULL AS found FROM customer LEFT JOIN s ON c_custkey = s.key")
def kv_lookup(spark, sf):
    probes = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return keyed.lookup(keyed.replay(operations(spark, sf), order=ORDER), probes)


FNV32 = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex({0}), 2 * i - 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query(f"WITH h AS (SELECT {FNV32.format('c_name')} AS h FROM customer) SELECT CAST(h % 64 AS INTEGER) AS bucket, count(*) AS keys, CAST(min(h) AS BIGINT) AS least, CAST(max(h) AS BIGINT) AS most FROM h GROUP BY 1")
def kv_bucket_stats(spark, sf):
    rows = table(spark, sf, "customer").select(hashing.fnv32(F.col("c_name")).alias("h"))
    return rows.groupBy(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("keys"), F.min("h").alias("least"), F.max("h").alias("most"))


BUCKETED = f"""
    WITH e AS (SELECT user_id, count(*) AS n, max_by(event_type, (ts, event_id)) AS last FROM events GROUP BY 1),
    b AS (SELECT CAST({FNV32.format("CAST(user_id AS VARCHAR)")} % 64 AS INTEGER) AS bucket, n, CASE WHEN last = 'error' THEN 0 ELSE 1 END AS live FROM e)
    SELECT bucket, CAST(sum(n) AS BIGINT) AS records, CAST(sum(live) AS BIGINT) AS live, CAST(sum(n) - sum(live) AS BIGINT) AS stale FROM b GROUP BY 1
"""


@query(BUCKETED)
def kv_log_stats(spark, sf):
    return keyed.bucket_stats(operations(spark, sf), BUCKETS, order=ORDER)


@query(f"SELECT * FROM ({BUCKETED}) WHERE records >= 64 AND stale > live")
def kv_compaction_candidates(spark, sf):
    return keyed.compaction_candidates(keyed.bucket_stats(operations(spark, sf), BUCKETS, order=ORDER))


def logged(spark, sf) -> DataFrame:
    """The operations, written to a binary log and read back."""
    rows = operations(spark, sf).select(F.concat_ws(" ", F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("seq"), "op", F.col("key").cast("string").alias("key"), F.concat(F.lit("v"), F.col("event_id")).alias("value"))
    path = shared_path(spark, "oplog")
    oplog.append(rows, path, BUCKETS)
    return oplog.read(spark, path)


LAST_VALUE = "SELECT CAST(user_id AS VARCHAR) AS key, 'v' || event_id AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"


@query(LAST_VALUE)
def kv_binary_log(spark, sf):
    return keyed.replay(logged(spark, sf))


@query(f"SELECT CAST({FNV32.format('key')} % 64 AS INTEGER) AS bucket, count(*) AS records FROM ({LAST_VALUE}) GROUP BY 1")
def kv_compact(spark, sf):
    """Records in each bucket once the log is compacted and written anew."""
    path = shared_path(spark, "compacted")
    oplog.append(oplog.compacted(logged(spark, sf)), path, BUCKETS, "overwrite")
    return oplog.read(spark, path).groupBy("bucket").agg(F.count("*").alias("records"))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id AS key, value FROM c WHERE r = 1")
def cm_put_last(spark, sf):
    return keyed.put_last(table(spark, sf, "events"), "user_id", "value", ORDER)


CENTS = "SELECT user_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events"


@query(f"SELECT user_id AS key, CAST(sum(cents) AS BIGINT) AS value FROM ({CENTS}) GROUP BY 1")
def cm_merge_sum(spark, sf):
    return keyed.merge(cents(spark, sf), "user_id", F.sum("cents"))


@query(f"SELECT event_id, user_id, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS merged FROM ({CENTS})")
def cm_merge_running(spark, sf):
    return keyed.merge_running(cents(spark, sf), "user_id", "cents", ORDER, F.date_trunc("day", "ts")).select("event_id", "user_id", "merged")


@query(f"SELECT user_id AS key, max(cents) - min(cents) AS value FROM ({CENTS}) GROUP BY 1")
def cm_merge_spread(spark, sf):
    return keyed.merge(cents(spark, sf), "user_id", F.max("cents") - F.min("cents"))


@query("SELECT count(DISTINCT user_id) AS size FROM events")
def cm_size(spark, sf):
    return keyed.size(table(spark, sf, "events"), "user_id")


@query("SELECT o_orderkey, o_custkey, c_name AS value, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def phf_lookup(spark, sf):
    """Orders probe the perfect hash of the customers' keys."""
    index = static.build(table(spark, sf, "customer"), "c_custkey", ["c_name"])
    return static.get(index, table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def phf_missing(spark, sf):
    return static.missing(table(spark, sf, "orders").select("o_custkey").distinct(), table(spark, sf, "customer").select("c_custkey"), "o_custkey", "c_custkey")


FNV64 = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex({0}), 2 * i - 1, 2))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::HUGEINT)"


@query(f"SELECT size, count(*) AS buckets FROM (SELECT count(*) AS size FROM (SELECT {FNV64.format('c_name')} % 1024 AS b FROM customer) GROUP BY b) GROUP BY 1")
def phf_bucket_hist(spark, sf):
    return static.bucket_sizes(table(spark, sf, "customer"), "c_name", 1024)


@query("SELECT c_name AS key, TRUE AS own_slot FROM customer")
def phf_slots(spark, sf):
    """Every customer's name, its slot by probing the perfect hash, and whether the slot is its own and among as many as there are keys."""
    dim = table(spark, sf, "customer").select(F.col("c_name").alias("key"))
    index = static.perfect_hash(dim, "key")
    made = static.slots(index, dim, "key")
    shared = made.groupBy("_shard", "_slot").agg(F.count("*").alias("n"))
    whole = index.function.select(F.col("shard").alias("_shard"), "keys")
    fits = (F.col("n") == 1) & (F.col("_slot") >= 0) & (F.col("_slot") < F.col("keys"))
    return made.join(shared, ["_shard", "_slot"]).join(whole, "_shard").select("key", fits.alias("own_slot"))


@query("SELECT count(DISTINCT c_name) AS keys, count(DISTINCT c_name) / count(c_name) AS load_factor, TRUE AS compact FROM customer")
def phf_structure(spark, sf):
    """The perfect hash's keys, how full its slots are, and whether it takes under 8 bits a key (an array of 32-bit displacements takes 32)."""
    made = static.structure(static.perfect_hash(table(spark, sf, "customer"), "c_name"))
    return made.select("keys", "load_factor", (F.col("bits_per_key") < 8).alias("compact"))


def points(spark, sf) -> DataFrame:
    part = lambda k: (F.element_at("embedding", k).cast("double") * 10.0)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), part(1).alias("x"), part(2).alias("y"), part(3).alias("z"))


POINTS = "SELECT vec_id AS pos, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings"
D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
PAIRS = f"SELECT a.pos AS lo, b.pos AS hi FROM p a JOIN p b ON a.pos < b.pos AND {D2} < {THRESHOLD**2!r}"
CELLS = " UNION ALL ".join(
    f"SELECT pos, x, y, z, {t} AS t, " + ", ".join(f"floor((x*({d[0]!r}::DOUBLE)+y*({d[1]!r}::DOUBLE)+z*({d[2]!r}::DOUBLE)+({o!r}::DOUBLE))/{TABLES.width!r}::DOUBLE) AS c{j}" for j, (d, o) in enumerate(zip(TABLES.directions[t], TABLES.offsets[t]))) + " FROM p"
    for t in range(len(TABLES.directions))
)
CANDIDATES = f"SELECT DISTINCT a.pos AS lo, b.pos AS hi, {D2} AS d2 FROM c a JOIN c b USING (t, c0, c1, c2) WHERE a.pos < b.pos"


@query(f"WITH p AS ({POINTS}) {PAIRS}")
def lsh_naive_pairs(spark, sf):
    return nearpairs.naive_pairs(points(spark, sf), THRESHOLD)


@query(f"WITH p AS ({POINTS}) {PAIRS}")
def lsh_exact_grid_pairs(spark, sf):
    return nearpairs.grid_pairs(points(spark, sf), THRESHOLD)


@query(f"WITH p AS ({POINTS}), c AS ({CELLS}) SELECT lo, hi FROM ({CANDIDATES}) WHERE d2 < {THRESHOLD**2!r}")
def lsh_multi_table_pairs(spark, sf):
    return nearpairs.hashed_pairs(points(spark, sf), TABLES, THRESHOLD)


@query(f"WITH p AS ({POINTS}), c AS ({CELLS}) SELECT lo, hi FROM ({CANDIDATES}) WHERE d2 < {THRESHOLD**2!r}")
def lsh_added_pairs(spark, sf):
    """The same pairs from an index that the points are added to in three batches."""
    p = points(spark, sf)
    index, out = nearpairs.stored(spark, TABLES, THRESHOLD), None
    for batch in range(3):
        pairs = nearpairs.add(index, p.where(F.col("pos") % 3 == batch), batch)
        out = pairs if out is None else out.union(pairs)
    return out


@query(f"WITH p AS ({POINTS}), c AS ({CELLS}), n AS (SELECT count(*) AS n FROM c GROUP BY t, c0, c1, c2) SELECT (SELECT count(*) FROM ({CANDIDATES})) AS unique_candidates, (SELECT CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) FROM p) AS all_pairs, round((SELECT count(*) FROM ({CANDIDATES})) / (SELECT count(*) * (count(*) - 1) // 2 FROM p), 9) AS candidate_ratio")
def lsh_candidate_ratio(spark, sf):
    return nearpairs.candidate_ratio(points(spark, sf), TABLES).withColumn("candidate_ratio", F.round("candidate_ratio", 9))


@query(f"WITH p AS ({POINTS}), c AS ({CELLS}), n AS (SELECT count(*) AS n FROM c GROUP BY t, c0, c1, c2) SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM n) AS total_candidates, (SELECT count(*) FROM ({CANDIDATES})) AS unique_candidates")
def lsh_candidate_stats(spark, sf):
    return nearpairs.candidate_stats(points(spark, sf), TABLES)


@query(f"WITH p AS ({POINTS}), c AS ({CELLS}), t AS ({PAIRS}), f AS (SELECT lo, hi FROM ({CANDIDATES}) WHERE d2 < {THRESHOLD**2!r}), h AS (SELECT count(*) AS n FROM f JOIN t USING (lo, hi)) SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM t) AS true, n AS hits, round(n / (SELECT count(*) FROM t), 9) AS recall, round(n / (SELECT count(*) FROM f), 9) AS precision FROM h")
def lsh_quality(spark, sf):
    p = points(spark, sf)
    got = nearpairs.quality(nearpairs.hashed_pairs(p, TABLES, THRESHOLD), nearpairs.grid_pairs(p, THRESHOLD))
    return got.withColumns({"recall": F.round("recall", 9), "precision": F.round("precision", 9)})


def places(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), ((k * 7919) % 17000 / 100.0 - 85.0).alias("lat"), ((k * 104729) % 36000 / 100.0 - 180.0).alias("lng"))


def centres(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("qid"), ((k * 6271) % 17800 / 100.0 - 89.0).alias("lat"), ((k * 15013) % 36000 / 100.0 - 180.0).alias("lng"), (200_000.0 + (k % 9) * 250_000.0).alias("radius_m"))


PLACES = "SELECT c_custkey AS id, ((c_custkey * 7919) % 17000) / 100.0::DOUBLE - 85 AS lat, ((c_custkey * 104729) % 36000) / 100.0::DOUBLE - 180 AS lng FROM customer"
CENTRES = "SELECT s_suppkey AS qid, ((s_suppkey * 6271) % 17800) / 100.0::DOUBLE - 89 AS lat, ((s_suppkey * 15013) % 36000) / 100.0::DOUBLE - 180 AS lng, 200000.0::DOUBLE + (s_suppkey % 9) * 250000.0::DOUBLE AS radius_m FROM supplier"
EDGES = [(1, 0.0, 179.99, 400_000.0), (2, 10.0, -179.95, 900_000.0), (3, 84.9, 30.0, 700_000.0), (4, -85.0, -120.0, 1_500_000.0), (5, 0.0, 10.0, 19_990_000.0), (6, 45.0, 540.0, 500_000.0), (7, 95.0, 0.0, 600_000.0)]
TERM = "power(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lng - q.lng) / 2), 2)"
WITHIN = f"SELECT q.qid, p.id FROM q JOIN p ON {TERM} <= power(sin(q.radius_m / (2 * 6371000.0::DOUBLE)), 2)"
RADIUS = f"WITH p AS ({PLACES}), q AS ({CENTRES}) {WITHIN}"


@query(RADIUS)
def geo_radius_naive(spark, sf):
    return radius.naive(places(spark, sf), centres(spark, sf))


@query(RADIUS)
def geo_radius_grid(spark, sf):
    return radius.over_cells(places(spark, sf), centres(spark, sf))


@query(RADIUS)
def geo_bbox_prune(spark, sf):
    return radius.over_bands(places(spark, sf), centres(spark, sf))


@query(RADIUS)
def geo_kd_tree(spark, sf):
    return radius.over_tree(places(spark, sf), centres(spark, sf))


@query(RADIUS)
def geo_kd_add(spark, sf):
    """A tree of half the places that the other half is added to."""
    p = places(spark, sf)
    tree = radius.planted(p.where("id % 2 = 0"))
    radius.plant(tree, p.where("id % 2 = 1"), 1)
    return radius.found(tree, centres(spark, sf))


@query(RADIUS)
def geo_grid_add(spark, sf):
    """A grid that the places are added to in two batches."""
    grid, p = radius.stored(spark), places(spark, sf)
    for batch in (0, 1):
        radius.add(grid, p.where(F.col("id") % 2 == batch), batch)
    return radius.find(grid, centres(spark, sf))


@query(f"WITH p AS ({PLACES}), q AS (SELECT qid, least(greatest(lat, -90), 90) AS lat, CASE WHEN lng >= 180 THEN lng - 360 * ceil((lng - 179.999999) / 360) ELSE lng END AS lng, radius_m FROM (VALUES {', '.join(f'({a}::BIGINT, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)' for a, b, c, d in EDGES)}) AS t(qid, lat, lng, radius_m)) {WITHIN}")
def geo_dateline(spark, sf):
    """Caps over the date line, over the poles and of nearly the whole sphere; centres out of range are brought to it."""
    return radius.over_cells(places(spark, sf), spark.createDataFrame(EDGES, "qid long, lat double, lng double, radius_m double"), 7.0)


@query(f"WITH p AS ({PLACES}) SELECT p.id, round(2 * 6371000.0::DOUBLE * asin(sqrt({TERM})), 2) AS metres FROM p, (SELECT 55.75::DOUBLE AS lat, 37.62::DOUBLE AS lng) q")
def geo_distance(spark, sf):
    d = sphere.distance_m(F.lit(55.75), F.lit(37.62), F.col("lat"), F.col("lng"))
    return radius.normal(places(spark, sf)).select("id", F.round(d, 2).alias("metres"))


@query(f"WITH p AS ({PLACES}) SELECT id, lat FROM p ORDER BY lat, id LIMIT 1 OFFSET (SELECT count(*) // 2 FROM p)")
def geo_median_split(spark, sf):
    """The point that splits the points in halves by latitude."""
    p = places(spark, sf)
    return radius.kth(p, "lat", p.count() // 2).select("id", "lat")


def base(spark, sf) -> DataFrame:
    return neighbours.vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")


EXACT = f"""
    SELECT qid, CAST(rank AS INTEGER) AS rank, id FROM (
        SELECT a.vec_id AS qid, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.vec_id) AS rank FROM v a, v b
    ) WHERE rank <= {K}
"""
VECTORS = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query(f"{VECTORS} {EXACT}")
def knn_exact(spark, sf):
    """The nearest of every vector among all, itself included."""
    b = base(spark, sf)
    return neighbours.exact(b, b, K).select("qid", "rank", "id")


CODED = ", s AS (SELECT vec_id, [" + ", ".join(f"CASE WHEN list_inner_product(v, {d.tolist()}::DOUBLE[]) >= 0 THEN 1 ELSE 0 END" for d in DIRECTIONS) + "] AS bits FROM v)"
HAMMING = f"""
    SELECT qid, CAST(rank AS INTEGER) AS rank, id, CAST(d AS BIGINT) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {BITS} - list_inner_product(a.bits, b.bits) - list_inner_product(list_transform(a.bits, lambda x: 1 - x), list_transform(b.bits, lambda x: 1 - x)) AS d FROM s a, s b)
    ) WHERE rank <= {K}
"""


@query(f"{VECTORS} {CODED} {HAMMING}")
def knn_sign_lsh(spark, sf):
    b = base(spark, sf)
    return neighbours.by_signs(b, b, K, DIRECTIONS).select("qid", "rank", "id", F.col("distance").cast("long").alias("distance"))


@query(f"{VECTORS} {CODED}, e AS ({EXACT}), h AS ({HAMMING}), n AS (SELECT count(*) AS hits FROM e JOIN h USING (qid, id)) SELECT hits, (SELECT count(*) FROM e) AS wanted, round(hits / (SELECT count(*) FROM e), 9) AS recall FROM n")
def knn_recall(spark, sf):
    b = base(spark, sf)
    got = neighbours.recall(neighbours.by_signs(b, b, K, DIRECTIONS), neighbours.exact(b, b, K), K)
    return got.withColumn("recall", F.round("recall", 9))


def neighbours_by_lists(spark, sf, parts: int) -> DataFrame:
    """An index of LISTS lists, probed by every vector."""
    b = written(base(spark, sf), "vectors")
    return neighbours.by_lists(b, b, K, neighbours.trained(b, LISTS, parts), PROBES).select("qid", "rank", "id")


@query()
def knn_ivf(spark, sf):
    return neighbours_by_lists(spark, sf, 0)


@query()
def knn_ivfpq(spark, sf):
    return neighbours_by_lists(spark, sf, 8)


@query(f"{VECTORS} SELECT method, count(*) * {K} AS wanted, TRUE AS enough FROM v, (VALUES ('ivf'), ('ivfpq')) AS m(method) GROUP BY 1")
def knn_lists_recall(spark, sf):
    """How many neighbours the searches by inverted lists should find, and whether they find at least nine in ten of those that exact
    search finds."""
    b = base(spark, sf)
    true = written(neighbours.exact(b, b, K), "true")
    each = [neighbours.recall(f(spark, sf), true, K).withColumn("method", F.lit(m)) for m, f in (("ivf", knn_ivf), ("ivfpq", knn_ivfpq))]
    return each[0].union(each[1]).select("method", "wanted", (F.col("recall") >= 0.9).alias("enough"))


SWEPT = "SELECT p_name || '-' || p_partkey AS name, split_part(p_type, ' ', 1) AS family, (p_partkey * 37 % 1000) / 1000.0::DOUBLE AS recall, p_retailprice AS search_ms_per_q, CAST(p_size AS BIGINT) * 1000 AS index_bytes, CAST(p_partkey % 11 AS DOUBLE) AS build_s FROM part"


def swept(spark, sf) -> DataFrame:
    """parts as rows of a parameter sweep."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(F.concat_ws("-", "p_name", k).alias("name"), F.col("p_type"), (k * 37 % 1000 / 1000.0).alias("recall"), F.col("p_retailprice").alias("search_ms_per_q"), (F.col("p_size").cast("long") * 1000).alias("index_bytes"), (k % 11).cast("double").alias("build_s"))


@query(f"SELECT family, name, recall, search_ms_per_q, index_bytes FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY recall DESC, search_ms_per_q, index_bytes, name) AS r FROM ({SWEPT})) WHERE r = 1")
def ann_best_per_family(spark, sf):
    return measure.best_of(swept(spark, sf), F.split_part("p_type", F.lit(" "), F.lit(1))).select("family", "name", "recall", "search_ms_per_q", "index_bytes")


@query(f"SELECT name, round(score, 9) AS score FROM (SELECT name, recall / power(search_ms_per_q + 1e-6, 0.25) / power(index_bytes + 1e-6, 0.1) / power(build_s + 1e-6, 0.05) AS score FROM ({SWEPT})) ORDER BY score DESC, name LIMIT 1")
def ann_score_argmax(spark, sf):
    return measure.best_score(swept(spark, sf)).select("name", F.round("score", 9).alias("score"))


@query(f"SELECT family, count(*) AS configs, round(avg(recall), 9) AS mean_recall FROM ({SWEPT}) GROUP BY 1")
def ann_split_rows(spark, sf):
    rows = swept(spark, sf).withColumn("family", F.split_part("p_type", F.lit(" "), F.lit(1)))
    return rows.groupBy("family").agg(F.count("*").alias("configs"), F.round(F.avg("recall"), 9).alias("mean_recall"))


def lines(spark, sf) -> DataFrame:
    """Line items as benchmark lines: the flag is the name, the quantity the size, the price the time."""
    text = F.concat(F.lit("BenchmarkGrowth"), F.col("l_returnflag"), F.lit("/N"), F.col("l_quantity").cast("int"), F.lit("-12 \t "), F.col("l_linenumber"), F.lit("\t"), F.col("l_extendedprice").cast("decimal(18,2)"), F.lit(" ns/op\t"), (F.col("l_discount") * 100).cast("decimal(18,0)"), F.lit(" B/op\t"), F.col("l_linenumber"), F.lit(" allocs/op"))
    return table(spark, sf, "lineitem").select(F.when(F.col("l_tax") == 0, F.lit("PASS")).otherwise(text).alias("value"))


STATS = "SELECT 'Growth' || l_returnflag AS name, CAST(l_quantity AS BIGINT) AS n, count(*) AS samples, avg(l_extendedprice) AS mean, coalesce(stddev_samp(l_extendedprice), 0) AS sd FROM lineitem WHERE l_tax <> 0 GROUP BY 1, 2"


def stats(spark, sf) -> DataFrame:
    return measure.group_stats(measure.parse_lines(lines(spark, sf)), ["name", "n"], "ns")


def tidy(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("SELECT 'Growth' || l_returnflag AS name, 'N' AS kind, CAST(l_quantity AS BIGINT) AS n, count(*) AS rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS ns, CAST(sum(l_linenumber) AS BIGINT) AS allocs FROM lineitem WHERE l_tax <> 0 GROUP BY 1, 3")
def bench_parse_text(spark, sf):
    rows = measure.parse_lines(lines(spark, sf))
    return rows.groupBy("name", "kind", "n").agg(F.count("*").alias("rows"), F.sum(F.col("ns").cast("decimal(18,2)")).cast("decimal(18,2)").alias("ns"), F.sum(F.col("allocs").cast("long")).alias("allocs"))


@query(f"SELECT name, n, samples, round(mean, 4) AS mean, round(sd, 4) AS sd FROM ({STATS})")
def bench_group_stats(spark, sf):
    return tidy(stats(spark, sf), "mean", "sd")


@query(f"SELECT name, n, round(greatest(mean - 3 * sd, 0), 4) AS lo, round(mean + 3 * sd, 4) AS hi FROM ({STATS})")
def bench_band(spark, sf):
    return tidy(measure.band(stats(spark, sf)).select("name", "n", "lo", "hi"), "lo", "hi")


@query(f"SELECT name, n, round(CASE WHEN mean = 0 THEN 0 ELSE 1e9 / mean END, 4) AS ops FROM ({STATS})")
def bench_throughput(spark, sf):
    return tidy(measure.throughput(stats(spark, sf)).select("name", "n", "ops"), "ops")


@query(f"WITH s AS ({STATS}) SELECT n, round(max(CASE WHEN name = 'GrowthA' THEN mean END), 4) AS GrowthA, round(max(CASE WHEN name = 'GrowthN' THEN mean END), 4) AS GrowthN, round(max(CASE WHEN name = 'GrowthR' THEN mean END), 4) AS GrowthR FROM s GROUP BY n")
def bench_pivot(spark, sf):
    names = [f"Growth{f}" for f in FAMILIES]
    return tidy(measure.routed(stats(spark, sf), "name", names), *names)


THREE = f"WITH s AS ({STATS}) SELECT a.n, round(a.mean, 4) AS a, round(b.mean, 4) AS b, round(c.mean, 4) AS c, round(a.mean / b.mean, 6) AS ratio FROM s a JOIN s b ON a.n = b.n AND a.name = 'GrowthA' AND b.name = 'GrowthN' JOIN s c ON a.n = c.n AND c.name = 'GrowthR'"


@query(THREE)
def bench_overhead_join(spark, sf):
    got = measure.joined(stats(spark, sf), "name", [f"Growth{f}" for f in FAMILIES])
    ratio = F.round(F.col("GrowthA") / F.col("GrowthN"), 6).alias("ratio")
    return got.select("n", F.round("GrowthA", 4).alias("a"), F.round("GrowthN", 4).alias("b"), F.round("GrowthR", 4).alias("c"), ratio)


@query(f"WITH s AS ({STATS}) SELECT max(n) FILTER (name = 'GrowthA') AS over_last, round(max_by(mean, n) FILTER (name = 'GrowthA') / max_by(mean, n) FILTER (name = 'GrowthR'), 6) AS ratio FROM s")
def bench_last_ratio(spark, sf):
    got = measure.last_ratio(stats(spark, sf), "name", "GrowthA", "GrowthR")
    return got.select("over_last", F.round("ratio", 6).alias("ratio"))


TOPPED = "SELECT replace(p_type, ' ', '.') AS name, max(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE)) * 1e6 AS cum FROM part GROUP BY 1"


def profile(spark, sf) -> DataFrame:
    """parts as rows of a profile's top table."""
    text = F.concat(F.lit("  0.1s  1.00%  2.00%  "), F.col("p_retailprice").cast("decimal(18,2)"), F.lit("ms  3.00%  "), F.replace("p_type", F.lit(" "), F.lit(".")))
    rows = table(spark, sf, "part").select(text.alias("value"))
    head = spark.range(1).select(F.lit("      flat  flat%   sum%        cum   cum%").alias("value"))
    return measure.parse_top(rows.union(head), formats.nanoseconds)


TOP8 = f"SELECT row_number() OVER (ORDER BY first DESC, cum DESC, name) AS place, name, round(cum, 2) AS cum FROM (SELECT *, CASE WHEN starts_with(name, 'ECONOMY') THEN 1 ELSE 0 END AS first FROM ({TOPPED}) WHERE NOT starts_with(name, 'SMALL')) ORDER BY first DESC, cum DESC, name LIMIT 8"


@query(f"SELECT CAST(place AS INTEGER) AS place, name, cum FROM ({TOP8})")
def bench_topk_profile(spark, sf):
    return tidy(measure.top_profile(profile(spark, sf), ["SMALL"], ["ECONOMY"]), "cum", places=2)


@query(f"SELECT CAST(place AS INTEGER) AS place, CASE WHEN length(name) > 12 THEN left(name, 9) || '...' ELSE name END AS label, cum FROM ({TOP8}) WHERE cum >= 0.01 ORDER BY place LIMIT 5")
def bench_profile_table(spark, sf):
    return tidy(measure.profile_table(measure.top_profile(profile(spark, sf), ["SMALL"], ["ECONOMY"]), width=12), "cum", places=2)


@query("SELECT c_custkey AS id, CAST(round(abs(c_acctbal) * 1000) AS BIGINT) AS us, CAST(abs(c_custkey) * 1536 AS BIGINT) AS bytes, CASE WHEN c_custkey >= 1000 AND c_custkey % 1000 = 0 THEN (c_custkey // 1000) || 'k' ELSE CAST(c_custkey AS VARCHAR) END AS short FROM customer")
def bench_units(spark, sf):
    """Amounts written with units and read back, and counts in short."""
    c = table(spark, sf, "customer")
    ns = formats.nanoseconds(F.concat(F.abs("c_acctbal").cast("decimal(18,2)"), F.lit("ms")))
    size = formats.bytes_of(F.concat((F.col("c_custkey") * 1.5).cast("decimal(18,1)"), F.lit("kB")))
    return c.select(F.col("c_custkey").alias("id"), F.round(ns / 1e3).cast("long").alias("us"), size.cast("long").alias("bytes"), formats.short_count(F.col("c_custkey")).alias("short"))


@query(f"WITH s AS ({STATS}), b AS (SELECT row_number() OVER (ORDER BY name, n) + 1 AS at, '| ' || name || ' | ' || n || ' | ' || samples || ' |' AS line FROM s) SELECT line FROM (SELECT 0 AS at, '| name | n | samples |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT * FROM b)")
def bench_markdown(spark, sf):
    return measure.markdown(stats(spark, sf), ["name", "n"], ["name", "n", "samples"])


PATHS = "SELECT list_filter(string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/'), lambda x: x <> '') AS path, CAST(strlen(html) AS BIGINT) AS value FROM pages"
TOTALS = f"SELECT array_to_string(prefix, '/') AS prefix, CAST(len(prefix) AS INTEGER) AS depth, CAST(sum(value) AS BIGINT) AS total FROM (SELECT list_slice(path, 1, k) AS prefix, value FROM (SELECT path, value, unnest(range(1, len(path) + 1)) AS k FROM ({PATHS}) WHERE value > 0)) GROUP BY prefix"


def page_paths(spark, sf) -> DataFrame:
    """Pages as stacks: host and path parts, the page's bytes as value."""
    path = F.filter(F.split(F.regexp_extract("url", "^https?://([^?#]*)", 1), "/"), lambda x: x != "")
    return table(spark, sf, "pages").select(path.alias("path"), F.octet_length("html").cast("long").alias("value"))


def totals(spark, sf) -> DataFrame:
    return stacks.prefix_totals(page_paths(spark, sf))


@query(TOTALS)
def stack_prefix_totals(spark, sf):
    return totals(spark, sf).select(F.concat_ws("/", "prefix").alias("prefix"), "depth", "total")


@query(f"WITH t AS (SELECT prefix, CAST(len(prefix) AS INTEGER) AS depth, CAST(sum(value) AS BIGINT) AS total FROM (SELECT list_slice(path, 1, k) AS prefix, value FROM (SELECT path, value, unnest(range(1, len(path) + 1)) AS k FROM ({PATHS}) WHERE value > 0)) GROUP BY prefix) SELECT array_to_string(prefix, '/') AS prefix, depth, total, CAST(coalesce(sum(total) OVER (PARTITION BY list_slice(prefix, 1, depth - 1) ORDER BY prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", round(100.0 * total / (SELECT sum(total) FROM t WHERE depth = 1), 6) AS percent FROM t")
def stack_sibling_offsets(spark, sf):
    got = stacks.layout(totals(spark, sf), F.substring(F.element_at("prefix", -1), 1, 2))
    return got.select(F.concat_ws("/", "prefix").alias("prefix"), "depth", "total", "offset", F.round("percent", 6).alias("percent"))


LAID = f"WITH t AS (SELECT prefix, CAST(len(prefix) AS INTEGER) AS depth, CAST(sum(value) AS BIGINT) AS total FROM (SELECT list_slice(path, 1, k) AS prefix, value FROM (SELECT path, value, unnest(range(1, len(path) + 1)) AS k FROM ({PATHS}) WHERE value > 0)) GROUP BY prefix), o AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY list_slice(prefix, 1, depth - 1) ORDER BY prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM t)"


@query(f"{LAID} SELECT array_to_string(a.prefix, '/') AS prefix, any_value(a.depth) AS depth, CAST(sum(b.o) AS BIGINT) AS x, any_value(a.total) AS width FROM o a JOIN o b ON a.depth >= b.depth AND list_slice(a.prefix, 1, b.depth) = b.prefix GROUP BY a.prefix")
def stack_boxes(spark, sf):
    got = stacks.placed(stacks.layout(totals(spark, sf), F.substring(F.element_at("prefix", -1), 1, 2)))
    return got.select(F.concat_ws("/", "prefix").alias("prefix"), "depth", "x", "width")


@query(f"SELECT CAST(max(len(path)) AS INTEGER) AS depth FROM ({PATHS})")
def stack_depth(spark, sf):
    return stacks.height(page_paths(spark, sf))


@query(f"SELECT * FROM ({TOTALS}) WHERE starts_with(split_part(prefix, '/', -1), 'm.') ORDER BY depth, total DESC, prefix LIMIT 1")
def stack_focus(spark, sf):
    got = stacks.focus(totals(spark, sf), F.startswith(F.element_at("prefix", -1), F.lit("m.")))
    return got.select(F.concat_ws("/", "prefix").alias("prefix"), "depth", "total")


def events_stream(spark, sf) -> DataFrame:
    whole = table(spark, sf, "events")
    return spark.readStream.schema(whole.schema).parquet(f"{sf}/{{events}}.parquet")  # a pattern, so a single file will do


@query(REPLAYED)
def stream_kv_upsert(spark, sf):
    op = F.when(F.col("event_type") == "error", oplog.DELETE).otherwise(oplog.SET)
    rows = events_stream(spark, sf).select(F.col("user_id").alias("key"), op.alias("op"), "value", F.struct("ts", "event_id").alias("order"))
    return streamed.upserts(rows, "key long, value double")


@query(f"SELECT user_id AS key, CAST(sum(cents) AS BIGINT) AS value FROM ({CENTS}) GROUP BY 1")
def stream_merge(spark, sf):
    rows = events_stream(spark, sf).select("user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return streamed.merges(rows, "user_id", F.sum("cents"), "key long, value long")
