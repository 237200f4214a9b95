"""Queries over lineitem as ordered traces: gathers, sorting, spacing, bins and grids."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import geometry as G
from strataflow.operators import binning as B
from strataflow.operators import ensembles as E
from strataflow.operators import grids as R
from strataflow.plans.headers import AZIMUTH_SQL, OFFSET_SQL, headers
from strataflow.plans.headers import SQL as HEADERS
from strataflow.plans.stacks import traces

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"]
BY = ", ".join(ORDER)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER, "l_linestatus")


def _block():
    return F.floor(F.col("l_orderkey") / 2048).cast("long")


def _runs_sql(keys: str) -> str:
    same = " AND ".join(f"lag({k}) OVER w IS NOT DISTINCT FROM {k}" for k in keys.split(", "))
    return f"""WITH r AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN row_number() OVER w > 1 AND {same} THEN 0 ELSE 1 END AS new FROM lineitem WINDOW w AS (ORDER BY {BY})),
g AS (SELECT *, sum(new) OVER (ORDER BY i) - 1 AS e FROM r)"""


def islands(*keys: str):
    return lambda s, d: E.ensemble_index(lines(s, d), list(keys), ORDER, _block()).select(*[F.col(c).cast("long").alias(c) if c not in keys else F.col(c) for c in ("ensemble_id", *keys, "start_trace", "end_trace", "n_traces")])


def islands_sql(keys: str) -> str:
    return _runs_sql(keys) + f" SELECT CAST(e AS BIGINT) AS ensemble_id, {keys}, CAST(min(i) AS BIGINT) AS start_trace, CAST(max(i) AS BIGINT) AS end_trace, count(*) AS n_traces FROM g GROUP BY e, {keys}"


def sub(s, d):
    return E.sub_gathers(lines(s, d), "l_suppkey", "l_returnflag", ORDER, 4).withColumn("sub_id", F.col("sub_id").cast("long"))


_SUB_SQL = f"""WITH r AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN row_number() OVER w > 1 AND lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS new FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {BY})),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY i) - 1 AS e FROM r)
SELECT l_suppkey, CAST(e AS BIGINT) AS sub_id, any_value(l_returnflag) AS l_returnflag, min(i) AS start_trace, max(i) AS end_trace, count(*) AS n_traces, count(*) >= 4 AS enough FROM g GROUP BY l_suppkey, e"""


def vectors(s, d):
    return traces(s, d).select("trace_index", "gather", (F.col("trace_index") * 7 % 13).alias("a"), (F.col("trace_index") % 5).alias("b"))


def sorted_(keys):
    return lambda s, d: E.sort_in_gathers(vectors(s, d), "gather", keys, ["trace_index"]).select("gather", "trace_index", "new_index")


def mapping(s, d):
    sorted_headers = E.sort_in_gathers(vectors(s, d), "gather", [("a", False), ("missing", True)], ["trace_index"])
    return E.sort_mapping(sorted_headers, "gather", "trace_index")


_VECTORS = "WITH v AS (SELECT vec_id AS trace_index, label AS gather, vec_id * 7 % 13 AS a, vec_id % 5 AS b FROM embeddings)"


def partitions(s, d):
    gathers = traces(s, d).groupBy(F.col("gather").alias("ensemble_id")).agg(F.count("*").alias("n_traces"))
    return E.gather_partitions(gathers, 4)


def spacing(s, d):
    return E.spacing(headers(s, d), "sx", ["k", "n", "part"], "supp").select("supp", *[F.round(c, 6).alias(c) for c in ("median", "mean", "std", "least", "most", "spacing")], "n_steps")


_STEPS = HEADERS + ", s AS (SELECT supp, abs(sx - lag(sx) OVER (PARTITION BY supp ORDER BY k, n, part)) AS step FROM h)"


def uniformity(s, d):
    return E.step_uniformity(headers(s, d), "sx", ["k", "n", "part"], "supp").select("supp", *[F.round(c, 6).alias(c) for c in ("median", "cv")], "n_steps", "n_gaps")


def sort_order(s, d):
    return E.sort_order(lines(s, d), ["l_orderkey", "l_suppkey", "l_returnflag"], ORDER, _block()).withColumn("score", F.round("score", 9))


def _continuity(k: str, place: int) -> str:
    return f"SELECT '{k}' AS key, {place} AS place, count(DISTINCT {k}) AS n_unique, CAST(sum(CASE WHEN i > 1 AND before IS NOT DISTINCT FROM {k} THEN 0 ELSE 1 END) AS BIGINT) AS n_runs FROM (SELECT {k}, row_number() OVER w AS i, lag({k}) OVER w AS before FROM lineitem WINDOW w AS (ORDER BY {BY}))"


_SORT_SQL = "WITH t AS (SELECT count(*) AS total FROM lineitem), c AS (" + " UNION ALL ".join(_continuity(k, i) for i, k in enumerate(["l_orderkey", "l_suppkey", "l_returnflag"])) + ") SELECT key, n_unique, n_runs, round(n_unique / CAST(n_runs AS DOUBLE) * CASE WHEN total / CAST(n_unique AS DOUBLE) < 2 THEN 0.7 WHEN total / CAST(n_unique AS DOUBLE) > total / 2.0 THEN 0.9 ELSE 1.0 END, 9) AS score FROM c, t"


def available(s, d):
    return E.available_headers(lines(s, d).drop("l_quantity", "l_extendedprice"), 2, 100000)


def indexed(s, d):
    four = [F.col(c) for c in ("sx", "sy", "rx", "ry")]
    return headers(s, d).select("k", "n", "part", "supp", "sx", "sy", "rx", "ry", F.round(G.offset(*four), 3).alias("offset"), F.round(G.azimuth(*four), 3).alias("azimuth"))


_INDEX = HEADERS + f', i AS (SELECT *, round({OFFSET_SQL}, 3) AS o, round({AZIMUTH_SQL}, 3) AS a FROM h)'
BINS = [*B.uniform_offset(0, 16000, 8), B.Bin("north", 0, 30000, 315.0, 45.0), *B.ovt([(0, 8000), (8000, 20000)], 4), B.Bin("off", 0, 90000, enabled=False)]


def _bins_sql(bins: list[B.Bin]) -> str:
    rows = ", ".join(f"('{b.bin_name}', {b.offset_min}::DOUBLE, {b.offset_max}::DOUBLE, {b.azimuth_min}::DOUBLE, {b.azimuth_max}::DOUBLE)" for b in bins if b.enabled)
    return f"b(bin_name, o1, o2, a1, a2) AS (VALUES {rows})"


_HOLDS = "o >= o1 AND o < o2 AND CASE WHEN a2 < a1 THEN a >= a1 OR a < a2 ELSE a >= a1 AND a < a2 END"


def assigned(s, d):
    return B.assign(indexed(s, d), BINS).select("k", "n", "part", "supp", "bin_name")


def coverage(s, d):
    return B.coverage(indexed(s, d), BINS).withColumn("coverage_percent", F.round("coverage_percent", 6))


def suggested(s, d):
    return B.suggest(indexed(s, d), target=9000).select(F.col("bin_index").cast("long").alias("bin_index"), *[F.round(c, 6).alias(c) for c in ("offset_min", "offset_max")])


def bounds(s, d):
    return indexed(s, d).agg(F.min(F.least("sx", "rx")).alias("x_min"), F.max(F.greatest("sx", "rx")).alias("x_max"), F.min(F.least("sy", "ry")).alias("y_min"), F.max(F.greatest("sy", "ry")).alias("y_max"), F.min("offset").alias("offset_min"), F.max("offset").alias("offset_max"))


def statistics(s, d):
    df = indexed(s, d).withColumn("inline", F.when(F.col("n") != 3, F.col("n"))).withColumn("xline", F.col("k"))
    return B.index_statistics(df).select("*").withColumn("offset_mean", F.round("offset_mean", 6)).withColumn("offset_std", F.round("offset_std", 6))


def shots(s, d):
    return indexed(s, d).groupBy(B.shot_id(F.col("sx"), F.col("sy")).alias("shot")).agg(F.count("*").alias("n_traces"), F.min("offset").alias("nearest"))


def binned(s, d):
    ix, iy, far = G.world_to_bin(F.col("rx"), F.col("ry"), (0.0, 0.0), (500.0, 60.0))
    return indexed(s, d).select(ix.alias("ix"), iy.alias("iy"), F.round(far, 6).alias("distance"))


def cells(s, d):
    t = F.col("trace_index")
    return traces(s, d).select((t % 10).alias("ix"), (t % 7).alias("iy"), (t * 31 % 17).cast("double").alias("distance"), "trace_index", "samples")


_CELLS = "WITH c AS (SELECT vec_id % 10 AS ix, vec_id % 7 AS iy, CAST(vec_id * 31 % 17 AS DOUBLE) AS distance, vec_id AS trace_index, embedding AS samples FROM embeddings)"


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("samples").alias("s", "a")).select(*keys, F.col("s").cast("long").alias("s"), (F.round(F.col("a").cast("double"), 6) + 0.0).alias("a"))


def represented(method: str):
    return lambda s, d: _flat(R.representatives(cells(s, d), method, 2), "ix", "iy", "fold")


def _represented_sql(pick: str) -> str:
    return _CELLS + f" SELECT ix, iy, fold, CAST(unnest(range(len(samples))) AS BIGINT) AS s, round(CAST(unnest(samples) AS DOUBLE), 6) + 0.0 AS a FROM (SELECT ix, iy, count(*) AS fold, {pick} AS samples FROM c GROUP BY ix, iy HAVING count(*) >= 2)"


def _by_sample_sql(value: str) -> str:
    return _CELLS + f", e AS (SELECT ix, iy, CAST(unnest(range(len(samples))) AS BIGINT) AS s, CAST(unnest(samples) AS DOUBLE) AS a FROM c) SELECT ix, iy, count(*) AS fold, s, round({value}, 6) + 0.0 AS a FROM e GROUP BY ix, iy, s HAVING count(*) >= 2"


def last_wins(s, d):
    return _flat(R.volume(cells(s, d), "ix", "iy"), "ix", "iy")


def rebuilt(s, d):
    """The filter halves each representative, so a trace loses half of it."""
    c = cells(s, d)
    rep = R.representatives(c, "mean")
    half = rep.select("ix", "iy", F.transform("samples", lambda x: x / 2).alias("samples"))
    return _flat(R.reconstruct(c, rep, half), "trace_index")


_REBUILT_SQL = _CELLS + """, e AS (SELECT ix, iy, trace_index, CAST(unnest(range(len(samples))) AS BIGINT) AS s, CAST(unnest(samples) AS DOUBLE) AS a FROM c)
SELECT trace_index, s, round(a - m / 2, 6) + 0.0 AS a FROM (SELECT trace_index, s, a, avg(a) OVER (PARTITION BY ix, iy, s) AS m FROM e)"""


def numbered(s, d):
    return R.passes(cells(s, d)).select("ix", "iy", "trace_index", "pass")


def distances(s, d):
    grid = indexed(s, d).select(F.floor(F.col("rx") / 500).cast("long").alias("il"), F.col("n").cast("long").alias("xl"), "rx", "ry")
    return R.spatial_distances(grid, "il", "xl", "rx", "ry").select(F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


_DISTANCES_SQL = HEADERS + """, g AS (SELECT CAST(floor(rx / 500) AS BIGINT) AS il, CAST(n AS BIGINT) AS xl, rx, ry FROM h),
p AS (SELECT il, rx, ry FROM (SELECT *, row_number() OVER (PARTITION BY il ORDER BY rx, ry) AS i FROM g WHERE xl = (SELECT min(xl) FROM g)) WHERE i = 1),
q AS (SELECT xl, rx, ry FROM (SELECT *, row_number() OVER (PARTITION BY xl ORDER BY rx, ry) AS i FROM g WHERE il = (SELECT min(il) FROM g)) WHERE i = 1),
u AS (SELECT sqrt((rx - lag(rx) OVER w) ** 2 + (ry - lag(ry) OVER w) ** 2) AS d FROM p WINDOW w AS (ORDER BY il)), v AS (SELECT sqrt((rx - lag(rx) OVER w) ** 2 + (ry - lag(ry) OVER w) ** 2) AS d FROM q WINDOW w AS (ORDER BY xl))
SELECT round(coalesce((SELECT quantile_cont(d, 0.5) FROM u WHERE d > 0.01), 25.0), 6) AS dx, round(coalesce((SELECT quantile_cont(d, 0.5) FROM v WHERE d > 0.01), 25.0), 6) AS dy"""


def sized(s, d):
    return R.volume_size(cells(s, d), "ix", "iy", 64)


def near(s, d):
    points = s.range(40).select(F.col("id").alias("point"), (F.col("id") % 8 * 3000.0).alias("x"), (F.floor(F.col("id") / 8) * 80.0).alias("y"))
    t = headers(s, d).select("k", "n", "part", F.col("rx").alias("tx"), F.col("ry").alias("ty"))
    return R.within(points, t, 150.0).select("point", "k", "n", "part", F.round("distance", 6).alias("distance"))


def window_(s, d):
    from strataflow.operators.traces import window

    return _flat(traces(s, d).where("trace_index BETWEEN 10 AND 59").select("trace_index", window(F.col("samples"), 20, 60, 2).alias("samples")), "trace_index")


def between(s, d):
    return headers(s, d).where(F.col("n").between(2, 4)).where("sx < 5000 AND scalar <> 0").select("k", "n", "part")


def of_list(s, d):
    wanted = s.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("k"))
    return headers(s, d).join(wanted, "k", "left_semi").select("k", "n", "part")


NAMES = ("land_3d", "marine", "wide_azimuth_ovt", "narrow_azimuth", "full_stack")


def presets(s, d):
    """How many traces each bin of the presets holds."""
    bins = [(n, b) for n in NAMES for b in B.preset(n)]
    held = [F.struct(F.lit(n).alias("preset"), *[F.lit(x).alias(c) for c, x in b._asdict().items() if c != "enabled"], F.count_if(B.contains(F.col("offset"), F.col("azimuth"), b)).alias("n_traces")) for n, b in bins]
    rows = indexed(s, d).agg(F.array(*held).alias("held")).select(F.explode("held").alias("x"))
    return rows.select("x.preset", "x.bin_name", *[F.col(f"x.{c}").cast("double").alias(c) for c in ("offset_min", "offset_max", "azimuth_min", "azimuth_max")], "x.n_traces")


def supplied(s, d) -> DataFrame:
    """A bin for each supplier: offsets from its key, azimuths from its nation, some across north, some off."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    low = (k * 37 % 101 * 150).cast("double")
    return s.read.parquet(f"{d}/supplier.parquet").select(
        F.concat(F.lit("b"), F.lpad(k.cast("string"), 8, "0")).alias("bin_name"), low.alias("offset_min"), (low + 20 + n * 11.0).alias("offset_max"), (n * 14.0).alias("azimuth_min"), ((n * 14 + 50) % 360).cast("double").alias("azimuth_max"), (k % 5 != 0).alias("enabled")
    )


_SUPPLIED = """WITH k AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier WHERE s_suppkey % 5 <> 0),
b AS (SELECT 'b' || lpad(CAST(k AS VARCHAR), 8, '0') AS bin_name, (k * 37 % 101 * 150)::DOUBLE AS o1, k * 37 % 101 * 150 + 20 + n * 11.0::DOUBLE AS o2, n * 14.0::DOUBLE AS a1, ((n * 14 + 50) % 360)::DOUBLE AS a2 FROM k)"""


_PRESETS_SQL = """
WITH edges AS (
  SELECT 'land_3d' AS preset, 'land3d' AS prefix, [0, 200, 400, 600, 800, 1000, 1500, 2000, 2500, 3000, 5000] AS e
  UNION ALL SELECT 'marine', 'marine', [0, 500, 1000, 2000, 3000, 4500, 8000]
  UNION ALL SELECT 'wide_azimuth_ovt', NULL, [0, 1000, 2000, 3500, 6000]),
ranges AS (SELECT preset, prefix, unnest(e[:-2]) AS a, unnest(e[2:]) AS b FROM edges)
SELECT preset, format('{}_{:04d}_{:04d}', prefix, a, b) AS bin_name, a::DOUBLE AS offset_min, b::DOUBLE AS offset_max, 0.0::DOUBLE AS azimuth_min, 360.0::DOUBLE AS azimuth_max
FROM ranges WHERE prefix IS NOT NULL
UNION ALL SELECT preset, format('ovt_off{:04d}_az{:03d}', a, k * 90), a, b, k * 90, k * 90 + 90 FROM ranges, range(4) t(k) WHERE prefix IS NULL
UNION ALL VALUES ('narrow_azimuth', 'inline_pos', 0, 8000, 345, 15), ('narrow_azimuth', 'inline_neg', 0, 8000, 165, 195),
  ('narrow_azimuth', 'xline_pos', 0, 8000, 75, 105), ('narrow_azimuth', 'xline_neg', 0, 8000, 255, 285), ('full_stack', 'full_stack', 0, 10000, 0, 360)"""
_ON = [b for b in BINS if b.enabled]

QUERIES = {
    "ensemble_index": (islands("l_returnflag"), islands_sql("l_returnflag")),
    "ensemble_index_keys": (islands("l_returnflag", "l_linestatus"), islands_sql("l_returnflag, l_linestatus")),
    "sub_gathers": (sub, _SUB_SQL),
    "sort_in_gathers": (sorted_([("a", True)]), _VECTORS + " SELECT gather, trace_index, row_number() OVER (PARTITION BY gather ORDER BY a, trace_index) - 1 AS new_index FROM v"),
    "sort_in_gathers_two_keys": (sorted_([("b", False), ("a", True)]), _VECTORS + " SELECT gather, trace_index, row_number() OVER (PARTITION BY gather ORDER BY b DESC, a, trace_index) - 1 AS new_index FROM v"),
    "sort_mapping": (mapping, _VECTORS + " SELECT min(trace_index) OVER (PARTITION BY gather) + row_number() OVER (PARTITION BY gather ORDER BY a DESC, trace_index) - 1 AS new_trace_index, trace_index AS original_trace_index FROM v"),
    "gather_partitions": (partitions, "WITH g AS (SELECT label AS ensemble_id, count(*) AS n_traces FROM embeddings GROUP BY 1) SELECT ensemble_id, n_traces, CAST(least(3, floor(coalesce(sum(n_traces) OVER (ORDER BY ensemble_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 / sum(n_traces) OVER ())) AS BIGINT) AS segment FROM g"),
    "trace_spacing": (spacing, _STEPS + " SELECT supp, round(quantile_cont(step, 0.5) FILTER (WHERE step > 0), 6) AS median, round(avg(step) FILTER (WHERE step > 0), 6) AS mean, round(stddev_pop(step) FILTER (WHERE step > 0), 6) AS std, round(min(step) FILTER (WHERE step > 0), 6) AS least, round(max(step) FILTER (WHERE step > 0), 6) AS most, round(CASE WHEN quantile_cont(step, 0.5) FILTER (WHERE step > 0) BETWEEN 0.1 AND 1000 THEN quantile_cont(step, 0.5) FILTER (WHERE step > 0) ELSE 25.0 END, 6) AS spacing, count(*) FILTER (WHERE step > 0) AS n_steps FROM s GROUP BY supp"),
    "step_uniformity": (uniformity, _STEPS + ", m AS (SELECT supp, quantile_cont(step, 0.5) AS med FROM s GROUP BY supp) SELECT supp, round(any_value(med), 6) AS median, round(100 * stddev_pop(step) / avg(step), 6) AS cv, count(step) AS n_steps, count(*) FILTER (WHERE step > 3 * med) AS n_gaps FROM s JOIN m USING (supp) WHERE step IS NOT NULL GROUP BY supp"),
    "sort_order": (sort_order, _SORT_SQL),
    "available_headers": (available, "WITH c AS (SELECT 'l_orderkey' AS header, count(DISTINCT l_orderkey) AS n_unique FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem) SELECT * FROM c WHERE n_unique BETWEEN 2 AND 100000"),
    "offset_range": (lambda s, d: indexed(s, d).where("offset >= 1000 AND offset < 5000").select("k", "n", "part", "offset"), _INDEX + ' SELECT k, n, part, o AS "offset" FROM i WHERE o >= 1000 AND o < 5000'),
    "azimuth_sector": (lambda s, d: indexed(s, d).where(B.contains(F.col("offset"), F.col("azimuth"), B.Bin("x", 0, 9000, 350.0, 20.0))).select("k", "n", "part", "azimuth"), _INDEX + " SELECT k, n, part, a AS azimuth FROM i WHERE o < 9000 AND (a >= 350 OR a < 20)"),
    "bin_assign": (assigned, _INDEX + f", {_bins_sql(BINS)} SELECT k, n, part, supp, bin_name FROM i JOIN b ON {_HOLDS}"),
    "bin_presets": (presets, _INDEX + f""", b AS ({_PRESETS_SQL})
SELECT preset, bin_name, offset_min, offset_max, azimuth_min, azimuth_max, count(o) AS n_traces FROM b LEFT JOIN i ON {_HOLDS.replace("o1", "offset_min").replace("o2", "offset_max").replace("a1", "azimuth_min").replace("a2", "azimuth_max")} GROUP BY ALL"""),
    "bin_summary": (lambda s, d: B.summary(indexed(s, d), BINS), _INDEX + f", {_bins_sql(BINS)} SELECT bin_name, count(o) AS n_traces FROM b LEFT JOIN i ON {_HOLDS} GROUP BY bin_name"),
    "bin_coverage": (coverage, _INDEX + f", {_bins_sql(BINS)}, c AS (SELECT i.k, i.n, i.part, i.supp, i.o, i.a, r, count(bin_name) AS m FROM (SELECT *, row_number() OVER () AS r FROM i) i LEFT JOIN b ON {_HOLDS} GROUP BY ALL) SELECT count(*) AS n_traces, count(*) FILTER (WHERE m = 0) AS n_unassigned, count(*) FILTER (WHERE m > 1) AS n_multiple, round(100.0 * count(*) FILTER (WHERE m > 0) / count(*), 6) AS coverage_percent FROM c"),
    "bin_overlaps": (lambda s, d: B.overlaps(supplied(s, d)), _SUPPLIED + " SELECT x.bin_name AS bin_a, y.bin_name AS bin_b FROM b x JOIN b y ON x.bin_name < y.bin_name AND x.o1 < y.o2 AND y.o1 < x.o2 AND (CASE WHEN y.a2 < y.a1 THEN x.a1 >= y.a1 OR x.a1 < y.a2 ELSE x.a1 >= y.a1 AND x.a1 < y.a2 END OR CASE WHEN x.a2 < x.a1 THEN y.a1 >= x.a1 OR y.a1 < x.a2 ELSE y.a1 >= x.a1 AND y.a1 < x.a2 END)"),
    "bin_gaps": (
        lambda s, d: B.gaps(supplied(s, d), 25.0),
        _SUPPLIED + """, r AS (SELECT min(o1) AS low, max(o2) AS high FROM b), e AS (SELECT low, unnest(range(CAST(ceil((high - low) / 25) AS BIGINT))) AS k FROM r),
f AS (SELECT low, k, k - row_number() OVER (ORDER BY k) AS run FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE o1 <= low + k * 25 AND low + k * 25 < o2))
SELECT min(low + k * 25.0::DOUBLE) AS gap_start, max(low + (k + 1) * 25.0::DOUBLE) AS gap_end FROM f GROUP BY run""",
    ),
    "bin_suggest": (suggested, _INDEX + ", n AS (SELECT greatest(1, count(*) // 9000) AS n, count(*) - 1 AS top FROM i), r AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS r FROM i), k AS (SELECT unnest(range(n + 1)) AS k, unnest(range(n + 1)) / CAST(n AS DOUBLE) * top AS pos FROM n), e AS (SELECT k, x.o + (y.o - x.o) * (pos - floor(pos)) AS e FROM k JOIN r x ON x.r = floor(pos) JOIN r y ON y.r = ceil(pos)) SELECT x.k AS bin_index, round(x.e, 6) AS offset_min, round(y.e, 6) AS offset_max FROM e x JOIN e y ON y.k = x.k + 1"),
    "survey_bounds": (bounds, _INDEX + " SELECT min(least(sx, rx)) AS x_min, max(greatest(sx, rx)) AS x_max, min(least(sy, ry)) AS y_min, max(greatest(sy, ry)) AS y_max, min(o) AS offset_min, max(o) AS offset_max FROM i"),
    "index_statistics": (statistics, _INDEX + ' SELECT count(*) AS n_traces, min(o) AS offset_min, max(o) AS offset_max, round(avg(o), 6) AS offset_mean, round(stddev_pop(o), 6) AS offset_std, min(a) AS azimuth_min, max(a) AS azimuth_max, count(*) FILTER (WHERE n = 3) = 0 AS has_inline, count(k) = count(*) AS has_xline FROM i'),
    "index_validate": (lambda s, d: B.validate_index(indexed(s, d)), _INDEX + ", c AS (SELECT count(*) AS n_traces, count(*) FILTER (WHERE o = 0) AS n_zero, count(*) FILTER (WHERE o > 50000) AS n_far, count(*) FILTER (WHERE a < 0 OR a >= 360) AS n_azimuth FROM i) SELECT *, n_zero > 0.1 * n_traces AS many_zero_offsets, n_traces > 0 AND n_zero <= 0.1 * n_traces AND n_far = 0 AND n_azimuth = 0 AS valid FROM c"),
    "unique_sources": (lambda s, d: indexed(s, d).select("sx", "sy").distinct(), HEADERS + " SELECT DISTINCT sx, sy FROM h"),
    "shot_gathers": (shots, _INDEX + " SELECT concat(CAST(trunc(sx) AS BIGINT), '_', CAST(trunc(sy) AS BIGINT)) AS shot, count(*) AS n_traces, min(o) AS nearest FROM i GROUP BY 1"),
    "grid_fold": (lambda s, d: R.fold(binned(s, d)), HEADERS + " SELECT CAST(floor(rx / 500) AS BIGINT) AS ix, CAST(floor(ry / 60) AS BIGINT) AS iy, count(*) AS fold FROM h GROUP BY 1, 2"),
    "grid_fold_statistics": (lambda s, d: R.fold_statistics(binned(s, d), 60, 10).withColumn("mean_fold", F.round("mean_fold", 6)).withColumn("populated_share", F.round("populated_share", 6)), HEADERS + ", f AS (SELECT floor(rx / 500), floor(ry / 60), count(*) AS fold FROM h GROUP BY 1, 2) SELECT max(fold) AS max_fold, round(avg(fold), 6) AS mean_fold, count(*) AS populated, round(count(*) / 600.0, 6) AS populated_share FROM f"),
    "grid_median": (represented("median"), _by_sample_sql("quantile_cont(a, 0.5)")),
    "grid_mean": (represented("mean"), _by_sample_sql("avg(a)")),
    "grid_first": (represented("first"), _represented_sql("arg_min(samples, trace_index)")),
    "grid_nearest": (represented("nearest"), _represented_sql("arg_min(samples, distance * 1000000 + trace_index)")),
    "volume_last_wins": (last_wins, _CELLS + " SELECT ix, iy, CAST(unnest(range(len(x))) AS BIGINT) AS s, round(CAST(unnest(x) AS DOUBLE), 6) + 0.0 AS a FROM (SELECT ix, iy, arg_max(samples, trace_index) AS x FROM c GROUP BY ix, iy)"),
    "volume_reconstruct": (rebuilt, _REBUILT_SQL),
    "volume_passes": (numbered, _CELLS + " SELECT ix, iy, trace_index, row_number() OVER (PARTITION BY ix, iy ORDER BY distance, trace_index) - 1 AS pass FROM c"),
    "volume_size": (sized, _CELLS + " SELECT count(DISTINCT ix) AS n_il, count(DISTINCT iy) AS n_xl, count(DISTINCT ix) * count(DISTINCT iy) * 256 AS n_bytes FROM c"),
    "spatial_distances": (distances, _DISTANCES_SQL),
    "spatial_join": (near, HEADERS + ", p AS (SELECT range AS point, range % 8 * 3000.0 AS x, floor(range / 8.0) * 80.0 AS y FROM range(40)) SELECT point, k, n, part, round(sqrt((x - rx) ** 2 + (y - ry) ** 2), 6) AS distance FROM p JOIN h ON (x - rx) ** 2 + (y - ry) ** 2 <= 22500"),
    "window_read": (window_, "SELECT vec_id AS trace_index, CAST(unnest(range(20)) AS BIGINT) AS s, round(CAST(unnest(embedding[11:30]) AS DOUBLE), 6) + 0.0 AS a FROM embeddings WHERE vec_id BETWEEN 10 AND 59"),
    "header_query": (between, HEADERS + " SELECT k, n, part FROM h WHERE n BETWEEN 2 AND 4 AND sx < 5000 AND scalar <> 0"),
    "header_subset": (of_list, HEADERS + " SELECT k, n, part FROM h WHERE k IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)"),
}
