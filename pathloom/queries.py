"""A query per operator over the commerce tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import commerce
from pathloom.commerce import BUYS, SHIPS, purchases, table
from pathloom.functions import columns as C
from pathloom.functions.timeutil import TimeWindow, WindowGroup, reformat, time_map
from pathloom.operators import aggregate as A
from pathloom.operators import features as V
from pathloom.operators import metrics as M
from pathloom.operators import sampling as W
from pathloom.plans import collect, dataset, pairs, paths, tokens
from pathloom.plans.hops import Tokens, hop_table
from pathloom.sources.publications import publication_tables, read_records
from pathloom.sources.shared import shared_folder, written
from pathloom.sources.tables import clean_source, compute_missing, file_counts, read_table, save_table
from pathloom.spec import HopSpec, NodeLimit, PathSpec, PathStep, Sample, linear_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

YEARS = [("1998",), ("1999",)]
YEAR = [("1999",)]
C0, P1, S2 = "Node_0_Customer_Col_0", "Node_1_Part_Col_0", "Node_2_Supplier_Col_0"
QTY = "buys__agg_-9_to_1_year_sum_quantity"

SQL_BUYS = """buys AS (SELECT CAST(o_custkey AS VARCHAR) AS custkey, CAST(l_partkey AS VARCHAR) AS partkey, CAST(l_suppkey AS VARCHAR) AS suppkey,
  strftime(o_orderdate, '%Y') AS year, l_quantity AS quantity, l_extendedprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
#: One row per customer, part and year: the least quantity, as cleaning keeps it.
SQL_CP = SQL_BUYS + ", cp AS (SELECT custkey, partkey, year, min(quantity) AS quantity FROM buys GROUP BY ALL), ps AS (SELECT DISTINCT partkey, suppkey, year FROM buys)"
SQL_EDGES = SQL_CP + """, e AS (SELECT custkey AS c, partkey AS p, count(*) AS n, sum(quantity) AS q FROM cp WHERE year BETWEEN '1990' AND '1999' GROUP BY ALL),
f AS (SELECT DISTINCT partkey AS p, suppkey AS s FROM ps WHERE year BETWEEN '1990' AND '1999')"""
SQL_NEW = """new AS (SELECT DISTINCT custkey, partkey FROM buys b WHERE year > '1999' AND year < '2002'
  AND custkey IN (SELECT custkey FROM buys WHERE year <= '1999') AND partkey IN (SELECT partkey FROM buys WHERE year <= '1999')
  AND NOT EXISTS (SELECT 1 FROM buys o WHERE o.year <= '1999' AND o.custkey = b.custkey AND o.partkey = b.partkey))"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _md5(seed: str, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


def _u(seed: str, *cols: str) -> str:
    return f"(CAST(('0x' || substr({_md5(seed, *cols)}, 1, 8)) AS BIGINT) / 4294967296.0)"


@lru_cache(maxsize=8)
def _graph(sf_dir: str):
    return commerce.commerce_graph(sf_dir)


def _tokens(spark: SparkSession, sf_dir: str, years=YEAR) -> Tokens:
    return Tokens(spark, _graph(sf_dir), years)


def _new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.new_links(purchases(spark, sf_dir), "custkey", "partkey", "year", "1999", "2002")


# --- sources --------------------------------------------------------------------


@query(f"WITH {SQL_BUYS}, r AS (SELECT *, row_number() OVER (PARTITION BY custkey, partkey, year ORDER BY quantity, price) AS n FROM buys) SELECT custkey, partkey, year, quantity, price, 1 AS null_mark_of_quantity, 1 AS null_mark_of_price FROM r WHERE n = 1")
def src_clean_dedup(spark, sf_dir):
    return clean_source(purchases(spark, sf_dir), ["custkey", "partkey"], ["quantity", "price"], ["year"])


@query(f"WITH {SQL_BUYS}, r AS (SELECT custkey, year, CASE WHEN quantity < 10 THEN NULL ELSE quantity END AS quantity FROM buys), s AS (SELECT *, row_number() OVER (PARTITION BY custkey, year ORDER BY quantity NULLS FIRST) AS n FROM r WHERE custkey NOT IN ('', 'NaN', '___')) SELECT custkey, year, coalesce(quantity, 0) AS quantity, CASE WHEN quantity IS NULL THEN 0 ELSE 1 END AS null_mark_of_quantity FROM s WHERE n = 1")
def presence_marks(spark, sf_dir):
    return clean_source(purchases(spark, sf_dir).withColumn("quantity", F.when(F.col("quantity") >= 10, F.col("quantity"))), ["custkey"], ["quantity"], ["year"])


@query("SELECT event_id, coalesce(TRY_CAST(event_type AS FLOAT), -1.0) AS event_type, coalesce(value, -1.0) AS value FROM events")
def ensure_numeric(spark, sf_dir):
    return C.ensure_numeric(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type", "value"]).withColumns({"event_type": F.col("event_type").cast("double")})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_F, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_O FROM orders WHERE strftime(o_orderdate, '%Y') IN ('1996', '1998')")
def one_hot_partitions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy"))
    return orders.where(C.in_partitions(["year"], [("1996",), ("1998",)])).select(F.col("o_orderkey").cast("string").alias("o_orderkey"), *C.one_hot("o_orderstatus", ["F", "O"], "is_"))


@query(f"WITH {SQL_BUYS}, b AS (SELECT year, count(*) AS rows, CAST(count(custkey) * 50 + count(partkey) * 50 + count(quantity) * 8 AS BIGINT) AS bytes FROM buys GROUP BY year), f AS (SELECT *, greatest(1, CAST(ceil(bytes / 262144) AS BIGINT)) AS files FROM b) SELECT year, rows, bytes, files, CAST(sum(files) OVER (ORDER BY year) - files AS BIGINT) AS files_before FROM f")
def partition_file_counts(spark, sf_dir):
    return file_counts(purchases(spark, sf_dir).select("year", "custkey", "partkey", "quantity"), ["year"], 262144)


# --- time windows -----------------------------------------------------------------

_W = WindowGroup(("count_*", "sum", "mean"), (TimeWindow(0, 1, "year"), TimeWindow(-1, 1, "year"), TimeWindow(-4, 5, "year")))


def _window_sql(prefix: str, where: str) -> list[str]:
    hit = f"CASE WHEN {where} THEN {{}} END"
    return [f'CAST(count({hit.format("1")}) AS DOUBLE) AS "{prefix}_count_all"', f'coalesce(sum({hit.format("quantity")}), 0) AS "{prefix}_sum_quantity"', f'coalesce(avg({hit.format("quantity")}), 0) AS "{prefix}_mean_quantity"']


_YEAR_WINDOWS = ", ".join(x for w in _W.windows for x in _window_sql(w.name, f"CAST(year AS INT) - CAST(g AS INT) BETWEEN {w.start} AND {w.start + w.length - 1}"))


@query(f"WITH {SQL_BUYS}, s AS (SELECT custkey, year, min(quantity) AS quantity FROM buys GROUP BY ALL) SELECT custkey, g AS graph_year, {_YEAR_WINDOWS} FROM s, (VALUES ('1998'), ('1999')) t(g) WHERE CAST(year AS INT) BETWEEN CAST(g AS INT) - 4 AND CAST(g AS INT) GROUP BY ALL")
def time_agg_year(spark, sf_dir):
    source = clean_source(purchases(spark, sf_dir), ["custkey"], ["quantity"], ["year"])
    return tokens.time_aggregate(spark, source, ["custkey"], ["quantity"], ["year"], ["%Y"], [_W], ["graph_year"], ["%Y"], YEARS)


_DAYS = WindowGroup(("count_*", "max"), (TimeWindow(-6, 7, "day"), TimeWindow(0, 1, "month")))


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(ts AS DATE) AS d, min(value) AS value FROM events GROUP BY ALL),
t AS (SELECT unnest([DATE '2024-01-10', DATE '2024-01-25']) AS g)
SELECT user_id, event_type, strftime(g, '%Y-%m-%d') AS graph_day, CAST(count(CASE WHEN d BETWEEN g - 6 AND g THEN 1 END) AS DOUBLE) AS "agg_-6_to_1_day_count_all",
  coalesce(max(CASE WHEN d BETWEEN g - 6 AND g THEN value END), 0) AS "agg_-6_to_1_day_max_value", CAST(count(CASE WHEN d = g THEN 1 END) AS DOUBLE) AS agg_0_to_1_month_count_all,
  coalesce(max(CASE WHEN d = g THEN value END), 0) AS agg_0_to_1_month_max_value FROM s, t WHERE d BETWEEN g - 6 AND g GROUP BY ALL""")
def time_agg_day_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    source = clean_source(events, ["user_id", "event_type"], ["value"], ["day"])
    return tokens.time_aggregate(spark, source, ["user_id", "event_type"], ["value"], ["day"], ["%Y-%m-%d"], [_DAYS], ["graph_day"], ["%Y-%m-%d"], [("2024-01-10",), ("2024-01-25",)])


@query(f"WITH {SQL_BUYS} SELECT DISTINCT custkey, g AS graph_year FROM buys, (VALUES ('1998'), ('1999')) t(g) WHERE CAST(year AS INT) BETWEEN CAST(g AS INT) - 1 AND CAST(g AS INT)")
def time_agg_featureless(spark, sf_dir):
    source = clean_source(purchases(spark, sf_dir), ["custkey"], [], ["year"])
    return tokens.time_aggregate(spark, source, ["custkey"], [], ["year"], ["%Y"], [WindowGroup(("first",), (TimeWindow(-1, 2, "year"),))], ["graph_year"], ["%Y"], YEARS)


@query("SELECT CAST(y AS VARCHAR) AS source, CAST(g AS VARCHAR) AS target, CAST(k AS INT) AS window_number FROM (SELECT unnest([1998, 1999]) AS g), (VALUES (0, 0, 0), (1, -1, -1), (2, -4, 0)) w(k, a, b), range(1980, 2010) r(y) WHERE y BETWEEN g + a AND g + b")
def window_time_map(spark, sf_dir):
    rows = [(s[0], t[0], k) for s, t, k in time_map(YEARS, ["%Y"], ["%Y"], _W.windows)]
    return spark.createDataFrame(rows, "source string, target string, window_number int")


@query("SELECT CAST(p_partkey AS VARCHAR) AS partkey, g AS graph_year, CAST(p_size AS DOUBLE) AS size, 1.0 AS null_mark_of_size, p_retailprice AS retailprice, 1.0 AS null_mark_of_retailprice FROM part, (VALUES ('1998'), ('1999')) t(g)")
def static_table_times(spark, sf_dir):
    graph = _graph(sf_dir)
    return tokens.table_features(spark, graph, graph.nodes["Part"].tables[1], YEARS)


@query(f"""WITH {SQL_BUYS}, s AS (SELECT custkey, year, min(quantity) AS quantity FROM buys GROUP BY ALL), t(g) AS (VALUES ('1998'), ('1999')),
x AS (SELECT custkey, g, CAST(year AS INT) - CAST(g AS INT) AS i, quantity FROM s, t WHERE CAST(year AS INT) BETWEEN CAST(g AS INT) - 9 AND CAST(g AS INT))
SELECT custkey AS node_Customer_col_0, g AS graph_year, CAST(count(*) AS DOUBLE) AS s0, sum(quantity) AS s1, CAST(count(*) AS DOUBLE) AS s2,
  CAST(count(CASE WHEN i = 0 THEN 1 END) AS DOUBLE) AS s3, coalesce(max(CASE WHEN i = 0 THEN quantity END), 0) AS s4, CAST(count(CASE WHEN i = 0 THEN 1 END) > 0 AS DOUBLE) AS s5,
  CAST(count(CASE WHEN i = -1 THEN 1 END) AS DOUBLE) AS s6, coalesce(max(CASE WHEN i = -1 THEN quantity END), 0) AS s7, CAST(count(CASE WHEN i = -1 THEN 1 END) > 0 AS DOUBLE) AS s8, 1.0 AS s9
FROM x GROUP BY ALL""")
def token_node_customer(spark, sf_dir):
    graph = _graph(sf_dir)
    slots = graph.nodes["Customer"].slots
    return tokens.token_table(spark, graph, "node", "Customer", YEARS).select("node_Customer_col_0", "graph_year", *[F.col(f"Customer_feat_col.`{s}`").alias(f"s{i}") for i, s in enumerate(slots)])


@query(f"""WITH {SQL_BUYS}, s AS (SELECT partkey, year, min(quantity) AS quantity FROM buys GROUP BY ALL), x AS (SELECT partkey, count(*) AS n, sum(quantity) AS q FROM s WHERE year BETWEEN '1990' AND '1999' GROUP BY ALL)
SELECT CAST(p_partkey AS VARCHAR) AS node_Part_col_0, '1999' AS graph_year, coalesce(n, 0) + 0.0 AS s0, coalesce(q, 0) AS s1, coalesce(n, 0) + 0.0 AS s2, CASE WHEN n IS NULL THEN 0.0 ELSE 1.0 END AS s3,
  CAST(p_size AS DOUBLE) AS s4, 1.0 AS s5, p_retailprice AS s6, 1.0 AS s7, 1.0 AS s8 FROM part LEFT JOIN x ON CAST(p_partkey AS VARCHAR) = partkey""")
def token_node_part_merged(spark, sf_dir):
    graph = _graph(sf_dir)
    return tokens.token_table(spark, graph, "node", "Part", YEAR).select("node_Part_col_0", "graph_year", *[F.col(f"Part_feat_col.`{s}`").alias(f"s{i}") for i, s in enumerate(graph.nodes["Part"].slots)])


@query(f"WITH {SQL_EDGES} SELECT c AS index_0_node_Customer_col_0, p AS index_1_node_Part_col_0, '1999' AS graph_year, n + 0.0 AS s0, q AS s1, n + 0.0 AS s2, 1.0 AS s3 FROM e")
def token_edge_cust_part(spark, sf_dir):
    graph = _graph(sf_dir)
    df = tokens.token_table(spark, graph, "edge", BUYS, YEAR)
    return df.select("index_0_node_Customer_col_0", "index_1_node_Part_col_0", "graph_year", *[F.col(f"`{BUYS}_feat_col`.`{s}`").alias(f"s{i}") for i, s in enumerate(graph.edges[BUYS].slots)])


# --- aggregates ---------------------------------------------------------------------


@query(f"WITH {SQL_BUYS} SELECT custkey, count(*) AS n, avg(quantity) AS mean_q, sum(quantity) AS sum_q, max(price) AS max_p, min(price) AS min_p, min(partkey) AS first_part FROM buys GROUP BY custkey")
def agg_scalar(spark, sf_dir):
    return A.aggregate(purchases(spark, sf_dir), ["custkey"], [("*", "count", "n"), ("quantity", "mean", "mean_q"), ("quantity", "sum", "sum_q"), ("price", "max", "max_p"), ("price", "min", "min_p"), ("partkey", "first", "first_part")])


@query("SELECT l_suppkey, " + ", ".join(f"count(CASE WHEN l_returnflag = '{v}' THEN 1 END) AS \"{v}_n\", sum(CASE WHEN l_returnflag = '{v}' THEN l_quantity END) AS \"{v}_q\"" for v in "ANR") + " FROM lineitem GROUP BY l_suppkey")
def agg_pivot(spark, sf_dir):
    return A.aggregate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [("*", "count", "n"), ("l_quantity", "sum", "q")], "l_returnflag")


_STATS = {"mean": "avg({0})", "sum": "sum({0})", "variance": "coalesce(var_samp({0}), 0)", "std": "coalesce(stddev_samp({0}), 0)", "count": "count({0})", "numNonzeros": "count(CASE WHEN {0} <> 0 THEN 1 END)", "max": "max({0})", "min": "min({0})", "normL2": "sqrt(sum({0} * {0}))", "normL1": "sum(abs({0}))"}


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("SELECT l_partkey, " + ", ".join((f"{e.format(c)} AS {f}_{c}" if f in ("count", "numNonzeros") else f"round({e.format(c)}, 4) AS {f}_{c}") for f, e in _STATS.items() for c in ("l_quantity", "l_tax")) + " FROM lineitem GROUP BY l_partkey")
def agg_vector_stats(spark, sf_dir):
    return _rounded(A.vector_aggregate(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_quantity", "l_tax"], list(_STATS)))


@query("SELECT l_suppkey, " + ", ".join(f"max(CASE WHEN l_linestatus = '{v}' THEN l_quantity END) AS \"{v}_max_l_quantity\"" for v in "FO") + " FROM lineitem GROUP BY l_suppkey")
def agg_vector_pivot(spark, sf_dir):
    return A.vector_aggregate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity"], ["max"], "l_linestatus", ["F", "O"])


@query("SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS event_type_click, count(CASE WHEN event_type = 'view' THEN 1 END) AS event_type_view, count(CASE WHEN event_type NOT IN ('click', 'view') OR event_type IS NULL THEN 1 END) AS \"event_type_Extra\" FROM events GROUP BY user_id")
def pivot_extra(spark, sf_dir):
    return A.pivot_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "view"])


@query("SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS rows FROM orders GROUP BY o_custkey")
def collect_lists(spark, sf_dir):
    rows = A.collect_rows(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], "rows")
    return rows.select("o_custkey", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["o_orderkey"].cast("string"), r["o_orderstatus"])), ",").alias("rows"))


@query("SELECT * FROM (SELECT event_type, count(*) AS rows, (SELECT count(DISTINCT event_type) FROM events) AS distinct_values FROM events GROUP BY event_type ORDER BY rows DESC, event_type LIMIT 3)")
def enum_profile(spark, sf_dir):
    return A.top_values(table(spark, sf_dir, "events"), "event_type", 3)


@query("SELECT 'l_linenumber' AS \"column\", CAST(min(l_linenumber) AS VARCHAR) AS least, CAST(max(l_linenumber) AS VARCHAR) AS greatest, min(l_linenumber) = max(l_linenumber) AS uniform FROM lineitem UNION ALL SELECT 'l_linestatus', min(l_linestatus), max(l_linestatus), min(l_linestatus) = max(l_linestatus) FROM lineitem")
def uniform_columns(spark, sf_dir):
    return A.uniform_columns(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_linestatus"])


@query("WITH k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM k WHERE n > 1) AS duplicate_keys, '' AS constant_features")
def table_quality(spark, sf_dir):
    return A.table_quality(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_totalprice", "o_orderstatus"])


@query("""WITH q AS (SELECT unnest(quantile_disc(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edge FROM orders),
b AS (SELECT row_number() OVER (ORDER BY edge) - 1 AS bin, edge AS lower, lead(edge) OVER (ORDER BY edge) AS upper FROM (SELECT DISTINCT edge FROM q))
SELECT CAST(bin AS INT) AS bin, lower, upper, count(*) AS rows FROM orders JOIN b ON o_totalprice >= lower AND (o_totalprice < upper OR (o_totalprice = upper AND upper = (SELECT max(edge) FROM q))) WHERE upper IS NOT NULL GROUP BY ALL""")
def quantile_histogram(spark, sf_dir):
    return A.quantile_histogram(table(spark, sf_dir, "orders"), "o_totalprice", 10, 10_000_000)


# --- sampling ------------------------------------------------------------------------


@query(f"SELECT * EXCLUDE n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_md5('random', 'o_orderkey')}, o_orderkey) AS n FROM orders) WHERE n <= 3")
def sample_random_n(spark, sf_dir):
    return W.random_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 3, ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <= 8)")
def sample_threshold(spark, sf_dir):
    return W.threshold_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 8)


@query(f"SELECT * EXCLUDE n FROM (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC NULLS LAST, {_md5('top', 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 2")
def sample_top_n(spark, sf_dir):
    return W.top_n(table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_partkey"], 2, ["l_quantity"], ["l_orderkey", "l_linenumber"])


@query(f"SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY floor({_u('quota', 'o_orderkey')} * 64), {_md5('quota', 'o_orderkey')}) AS n FROM orders) WHERE (o_orderstatus = 'F' AND n <= 100) OR (o_orderstatus = 'O' AND n <= 37)")
def sample_quota(spark, sf_dir):
    return W.quota_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 100, "O": 37}, ["o_orderkey"])


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, b, row_number() OVER (PARTITION BY b ORDER BY {_md5('bucket-rank', 'o_orderkey')}, o_orderkey) AS n FROM (SELECT o_orderkey, floor({_u('bucket', 'o_orderkey')} * 40) AS b FROM orders)) WHERE n <= 25 + CASE WHEN b = 39 THEN 7 ELSE 0 END")
def sample_bucketed(spark, sf_dir):
    return W.bucket_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 1007, ["o_orderkey"], 40)


@query(f"SELECT o_orderkey FROM orders WHERE {_u('fraction', 'o_orderkey')} < 0.25")
def sample_fraction(spark, sf_dir):
    return W.fraction_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 0.25, ["o_orderkey"])


@query(f"SELECT o_orderkey, CASE WHEN {_u('split', 'o_orderkey')} < 0.6 THEN 'train' WHEN {_u('split', 'o_orderkey')} < 0.8 THEN 'valid' ELSE 'test' END AS sample_type FROM orders")
def split_hash(spark, sf_dir):
    return W.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), [("train", 0.6), ("valid", 0.2), ("test", 0.2)], ["o_orderkey"])


@query(f"SELECT o_orderkey, CAST(floor({_u('batch', 'o_orderkey')} * 7) AS INT) + 3 AS batch_id FROM orders")
def batch_ids(spark, sf_dir):
    return W.batch_ids(table(spark, sf_dir, "orders").select("o_orderkey"), 7, ["o_orderkey"], offset=3)


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_md5('dense', 'c_custkey')}, c_custkey) - 1 AS index FROM customer")
def dense_ids(spark, sf_dir):
    return W.dense_ids(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])


# --- hops and paths --------------------------------------------------------------------

_EDGE = f"`{QTY}` > 40"


def _endpoints(df: DataFrame) -> DataFrame:
    return df.select("index_0_node_Customer_col_0", "index_1_node_Part_col_0", "graph_year")


_AS_EDGE = "c AS index_0_node_Customer_col_0, p AS index_1_node_Part_col_0, '1999' AS graph_year"


@query(f"WITH {SQL_EDGES} SELECT {_AS_EDGE} FROM e WHERE q > 40")
def edge_limit(spark, sf_dir):
    return _endpoints(hop_table(_tokens(spark, sf_dir), HopSpec(BUYS, edge_limit=_EDGE)))


@query(f"WITH {SQL_EDGES} SELECT {_AS_EDGE} FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {_md5(f'forward_{BUYS}-edge-0', 'c', 'p', chr(39) + '1999' + chr(39))}) AS k FROM e) WHERE k <= 5")
def edge_samples(spark, sf_dir):
    return _endpoints(hop_table(_tokens(spark, sf_dir), HopSpec(BUYS, edge_samples=(Sample("random", (0,), 5),))))


@query(f"WITH {SQL_EDGES} SELECT {_AS_EDGE} FROM e WHERE p IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 30)")
def node_limit(spark, sf_dir):
    return _endpoints(hop_table(_tokens(spark, sf_dir), HopSpec(BUYS, node_limits=(NodeLimit(1, "attributes__size > 30"),))))


@query(f"WITH {SQL_EDGES}, k AS (SELECT c AS who, count(*) AS years FROM (SELECT DISTINCT custkey AS c, year FROM buys WHERE year BETWEEN '1990' AND '1999') GROUP BY 1) SELECT {_AS_EDGE} FROM e JOIN k ON who = c JOIN part ON CAST(p_partkey AS VARCHAR) = p WHERE years >= 4 AND p_retailprice > q * 30")
def join_edge_limit(spark, sf_dir):
    where = f"src.`bought__agg_-9_to_1_year_count_all` >= 4 AND dst.attributes__retailprice > edge.`{QTY}` * 30"
    return _endpoints(hop_table(_tokens(spark, sf_dir), HopSpec(BUYS, hop_limit=where)))


@query(f"WITH {SQL_EDGES} SELECT c AS {C0}, p AS {P1}, '1999' AS graph_year FROM e")
def path_1hop(spark, sf_dir):
    return paths.PathPlanner(_tokens(spark, sf_dir)).prefix(linear_path("cp", [HopSpec(BUYS)]))


def _cps(n: int | None) -> PathSpec:
    return linear_path("cps", [HopSpec(BUYS, edge_samples=(Sample("random", (0,), n),) if n else ()), HopSpec(SHIPS, edge_samples=(Sample("random", (0,), n),) if n else ())])


def _sampled(source: str, key: str, cols: str, seed: str, n: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {_md5(seed, *cols.split(', '), chr(39) + '1999' + chr(39))}) AS rk FROM {source}) WHERE rk <= {n})"


_E5 = _sampled("e", "c", "c, p", f"forward_{BUYS}-edge-0", 5)
_F5 = _sampled("f", "p", "p, s", f"forward_{SHIPS}-edge-0", 5)


@query(f"WITH {SQL_EDGES} SELECT x.c AS {C0}, x.p AS {P1}, y.s AS {S2}, '1999' AS graph_year FROM {_E5} x JOIN {_F5} y ON x.p = y.p")
def path_2hop_sampled(spark, sf_dir):
    return paths.PathPlanner(_tokens(spark, sf_dir)).prefix(_cps(5))


def _named(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("c_custkey").cast("string").alias("c"), F.lit("1999").alias("graph_year"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers."""
    return _named(table(spark, sf_dir, "customer"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads that a search is asked from: customers whose key is divisible by 100, against all rows."""
    return _named(table(spark, sf_dir, "customer").where("c_custkey % 100 = 0"))


@query(f"WITH {SQL_EDGES} SELECT c AS {C0}, p AS {P1}, '1999' AS graph_year FROM e WHERE c IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')")
def target_semi_join(spark, sf_dir):
    """Targets: the customers of one market segment."""
    targets = _named(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"))
    return paths.PathPlanner(_tokens(spark, sf_dir), targets).prefix(linear_path("cp", [HopSpec(BUYS)]))


_CPCP = [HopSpec(BUYS), HopSpec(BUYS, 1, 0), HopSpec(BUYS)]


def _count_pairs(df: DataFrame, head: str, tail: str) -> DataFrame:
    return df.groupBy(F.col(head).alias("head"), F.col(tail).alias("tail")).agg(F.count(F.lit(1)).alias("instances"))


@query(f"WITH {SQL_EDGES} SELECT a.c AS head, d.p AS tail, count(*) AS instances FROM e a JOIN e b ON a.p = b.p JOIN e d ON b.c = d.c WHERE CAST(a.c AS INT) % 100 = 0 GROUP BY ALL")
def path_3hop_bidir(spark, sf_dir):
    tk = _tokens(spark, sf_dir)
    spec = paths.bipath(_CPCP)
    heads = _asked(spark, sf_dir)
    df = paths.bipath_instances(spec, tk.graph, paths.PathPlanner(tk, heads), paths.PathPlanner(tk))
    return _count_pairs(df, C0, "Node_3_Part_Col_0")


@query(f"WITH {SQL_EDGES} SELECT a.c AS head, g.s AS tail, count(*) AS instances FROM e a JOIN e b ON a.p = b.p JOIN e d ON b.c = d.c JOIN f g ON d.p = g.p WHERE CAST(a.c AS INT) % 100 = 0 GROUP BY ALL")
def path_4hop_bidir(spark, sf_dir):
    """All four-hop instances from given heads to all suppliers, counted by pair."""
    tails = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s"), F.lit("1999").alias("graph_year"))
    df = paths.chain_counts(_tokens(spark, sf_dir), paths.chain([*_CPCP, HopSpec(SHIPS)]), _asked(spark, sf_dir), tails)
    return df.select(F.col(C0).alias("head"), F.col("Node_4_Supplier_Col_0").alias("tail"), "instances")


@query(f"WITH {SQL_EDGES} SELECT e.c AS {C0}, e.p AS {P1}, f.s AS {S2}, '1999' AS graph_year FROM e JOIN f ON e.p = f.p JOIN part ON CAST(p_partkey AS VARCHAR) = e.p WHERE e.q > 60 AND p_size < 10")
def path_limit(spark, sf_dir):
    spec = PathSpec("cps", (PathStep(HopSpec(BUYS), 0, 1), PathStep(HopSpec(SHIPS), 1, 2, f"edge_0.`{QTY}` > 60 AND node_1.attributes__size < 10")))
    return paths.PathPlanner(_tokens(spark, sf_dir)).prefix(spec)


def _path_seed(number: int, k: int) -> str:
    return "/".join([f"forward_{BUYS}", f"forward_{SHIPS}"][: number + 1]) + f"-{number}-{k}"


@query(f"WITH {SQL_EDGES} SELECT {C0}, {P1}, {S2}, graph_year FROM (SELECT *, row_number() OVER (PARTITION BY {C0}, {S2} ORDER BY {_md5(_path_seed(1, 0), C0, P1, S2, 'graph_year')}) AS rk FROM (SELECT e.c AS {C0}, e.p AS {P1}, f.s AS {S2}, '1999' AS graph_year FROM e JOIN f ON e.p = f.p)) WHERE rk <= 1")
def path_samples(spark, sf_dir):
    spec = PathSpec("cps", (PathStep(HopSpec(BUYS), 0, 1), PathStep(HopSpec(SHIPS), 1, 2, None, (Sample("random", (0, 2), 1),))))
    planner = paths.PathPlanner(_tokens(spark, sf_dir))
    return planner.prefix(spec).select(C0, P1, S2, "graph_year")


_EDGE_FEAT = f"edge_{BUYS}_index_0_feat"


@query(f"WITH {SQL_EDGES} SELECT x.c AS {C0}, x.p AS {P1}, y.s AS {S2}, CAST(p_size AS DOUBLE) AS part_size, x.q AS edge_quantity FROM {_E5} x JOIN {_F5} y ON x.p = y.p JOIN part ON CAST(p_partkey AS VARCHAR) = x.p")
def path_feature_add(spark, sf_dir):
    tk = _tokens(spark, sf_dir)
    spec = _cps(5)
    df = paths.attach_features(tk, spec, paths.PathPlanner(tk).prefix(spec), positions=[1], edges=[0])
    return df.select(C0, P1, S2, F.col("node_Part_index_1_feat.attributes__size").alias("part_size"), F.col(f"`{_EDGE_FEAT}`.`{QTY}`").alias("edge_quantity"))


@query(f"WITH {SQL_EDGES} SELECT x.c AS {C0}, avg(CAST(p_size AS DOUBLE)) AS mean_size, max(CAST(p_size AS DOUBLE)) AS max_size FROM {_E5} x JOIN {_F5} y ON x.p = y.p JOIN part ON CAST(p_partkey AS VARCHAR) = x.p GROUP BY ALL")
def path_agg(spark, sf_dir):
    tk = _tokens(spark, sf_dir)
    spec = _cps(5)
    df = paths.attach_features(tk, spec, paths.PathPlanner(tk).prefix(spec), positions=[1], edges=[])
    name = "node_Part_index_1_feat"
    out = paths.aggregate_paths(df, [C0], [name], {name: ["attributes__size"]}, ["mean", "max"])
    return out.select(C0, F.col(f"mean_{name}.attributes__size").alias("mean_size"), F.col(f"max_{name}.attributes__size").alias("max_size"))


@query(f"WITH {SQL_EDGES} SELECT DISTINCT e.c AS {C0}, f.s AS {S2}, '1999' AS graph_year FROM e JOIN f ON e.p = f.p")
def khop_neighbors(spark, sf_dir):
    return paths.k_hop_neighbours(paths.PathPlanner(_tokens(spark, sf_dir)), _cps(None))


_HOPS = [HopSpec(BUYS), HopSpec(BUYS, 1, 0), HopSpec(SHIPS), HopSpec(SHIPS, 1, 0)]


@query(f"""WITH RECURSIVE h(name, a, b) AS (VALUES ('forward_{BUYS}', 'Customer', 'Part'), ('backward_{BUYS}', 'Part', 'Customer'), ('forward_{SHIPS}', 'Part', 'Supplier'), ('backward_{SHIPS}', 'Supplier', 'Part')),
r(k, name, b) AS (SELECT 1, name, b FROM h WHERE a = 'Customer' UNION ALL SELECT k + 1, r.name || '__' || h.name, h.b FROM r JOIN h ON r.b = h.a WHERE k < 5) SELECT k AS hops, name AS path FROM r WHERE b = 'Part'""")
def path_type_enum(spark, sf_dir):
    found = paths.path_types(_graph(sf_dir), _HOPS, "Customer", "Part", 5)
    return spark.createDataFrame([(k, p.name) for k, ps in found.items() for p in ps], "hops int, path string")


_METRIC = """SELECT '{0}' AS path, CAST(coalesce(sum(n), 0) AS BIGINT) AS path_count, CAST(coalesce(sum(CASE WHEN known THEN n END), 0) AS BIGINT) AS matched_path_count,
  coalesce(CAST(sum(CASE WHEN known THEN n END) AS DOUBLE) / sum(n), 0) AS match_rate, count(*) AS distinct_edge_count, count(CASE WHEN known THEN 1 END) AS matched_distinct_edge_count,
  coalesce(count(CASE WHEN known THEN 1 END) / nullif(CAST(count(*) AS DOUBLE), 0), 0) AS distinct_match_rate
FROM (SELECT head, tail, n, EXISTS (SELECT 1 FROM new WHERE custkey = head AND partkey = tail) AS known FROM {1})"""
_N1 = f"forward_{BUYS}"
_N3 = f"forward_{BUYS}__backward_{BUYS}__forward_{BUYS}"
_N3S = f"forward_{BUYS}__forward_{SHIPS}__backward_{SHIPS}"


@query(f"""WITH {SQL_EDGES}, {SQL_NEW}, t AS (SELECT * FROM new WHERE CAST(custkey AS INT) % 100 = 0), hs AS (SELECT DISTINCT custkey FROM t), ts AS (SELECT DISTINCT partkey FROM t),
m1 AS (SELECT c AS head, p AS tail, count(*) AS n FROM e WHERE c IN (SELECT custkey FROM hs) GROUP BY ALL),
m2 AS (SELECT a.c AS head, d.p AS tail, count(*) AS n FROM e a JOIN e b ON a.p = b.p JOIN e d ON b.c = d.c WHERE a.c IN (SELECT custkey FROM hs) AND d.p IN (SELECT partkey FROM ts) GROUP BY ALL),
m3 AS (SELECT a.c AS head, d.p AS tail, count(*) AS n FROM e a JOIN f b ON a.p = b.p JOIN f d ON b.s = d.s WHERE a.c IN (SELECT custkey FROM hs) AND d.p IN (SELECT partkey FROM ts) GROUP BY ALL)
{_METRIC.format(_N1, "m1")} UNION ALL {_METRIC.format(_N3, "m2")} UNION ALL {_METRIC.format(_N3S, "m3")}""")
def match_metrics(spark, sf_dir):
    """Path types up to three hops, searched from both ends for the new links of given heads."""
    links = _new_links(spark, sf_dir).where("cast(custkey as int) % 100 = 0").withColumn("graph_year", F.lit("1999"))
    return paths.find_paths(_tokens(spark, sf_dir), links, _HOPS, "Customer", "Part", 3, n=None)


# --- pairs and labels ----------------------------------------------------------------------


@query(f"WITH {SQL_BUYS}, {SQL_NEW} SELECT custkey, partkey FROM new")
def label_new_links(spark, sf_dir):
    return _new_links(spark, sf_dir)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.split_links(_new_links(spark, sf_dir), ["custkey", "partkey"], "year", "1999")


_SPLIT = f"CASE WHEN {_u('label-split', 'custkey', 'partkey')} < 0.6 THEN 'train' WHEN {_u('label-split', 'custkey', 'partkey')} < 0.8 THEN 'valid' ELSE 'test' END"
SQL_LABELS = f"{SQL_NEW}, labels_ AS (SELECT custkey, partkey, {_SPLIT} AS sample_type FROM new)"


@query(f"WITH {SQL_BUYS}, {SQL_LABELS} SELECT custkey AS head, partkey AS tail, '1999-01' AS graph_month, sample_type FROM labels_ WHERE sample_type IN ('train', 'test')")
def labeled_samples(spark, sf_dir):
    return pairs.labeled_samples(_labels(spark, sf_dir), [("custkey", "head"), ("partkey", "tail")], {"train": [("sample_type = 'train'", None)], "test": [("sample_type = 'test'", None)]}, ("year", "%Y"), ("graph_month", "%Y-%m"), "year = '1999'")


@query(f"WITH {SQL_BUYS} SELECT DISTINCT id, '1999' AS graph_year FROM (SELECT custkey AS id FROM buys UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer)")
def unlabeled_samples(spark, sf_dir):
    return pairs.unlabeled_samples([(purchases(spark, sf_dir), ["custkey"]), (table(spark, sf_dir, "customer"), ["c_custkey"])], ["id"], ("graph_year", "1999"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by two paths from all customers: parts of the same supplier, and parts bought by buyers of the same part."""
    planner = paths.PathPlanner(_tokens(spark, sf_dir), _heads(spark, sf_dir))
    return pairs.union_pairs([planner.prefix(p) for p in _candidate_paths()], [[C0, "Node_3_Part_Col_0", "graph_year"]] * 2, ["custkey", "partkey", "graph_year"])


def _candidate_paths() -> tuple[PathSpec, PathSpec]:
    one = linear_path("s", [HopSpec(BUYS, edge_samples=(Sample("random", (0,), 5),)), HopSpec(SHIPS, edge_samples=(Sample("random", (0,), 5),)), HopSpec(SHIPS, 1, 0, edge_samples=(Sample("random", (1,), 5),))])
    two = linear_path("c", [HopSpec(BUYS, edge_samples=(Sample("random", (0,), 5),)), HopSpec(BUYS, 1, 0, edge_samples=(Sample("random", (1,), 5),)), HopSpec(BUYS, edge_samples=(Sample("random", (0,), 5),))])
    return one, two


_F5B = _sampled("f", "s", "p, s", f"backward_{SHIPS}-edge-0", 5)
_E5B = _sampled("e", "p", "c, p", f"backward_{BUYS}-edge-0", 5)
SQL_CANDIDATES = f"""e5 AS {_E5}, f5 AS {_F5}, f5b AS {_F5B}, e5b AS {_E5B},
cand AS (SELECT DISTINCT custkey, partkey FROM (SELECT a.c AS custkey, d.p AS partkey FROM e5 a JOIN f5 b ON a.p = b.p JOIN f5b d ON b.s = d.s
  UNION ALL SELECT a.c, d.p FROM e5 a JOIN e5b b ON a.p = b.p JOIN e5 d ON b.c = d.c))"""


@query(f"WITH {SQL_EDGES}, {SQL_CANDIDATES} SELECT custkey, partkey, '1999' AS graph_year FROM cand")
def candidate_union(spark, sf_dir):
    return _candidates(spark, sf_dir)


def _labelled_pairs(spark: SparkSession, sf_dir: str, infer: bool) -> DataFrame:
    labels = _labels(spark, sf_dir).withColumnRenamed("year", "graph_year")
    known = purchases(spark, sf_dir).where("year <= '1999'").select("custkey", "partkey")
    return pairs.label_pairs(_candidates(spark, sf_dir), labels, ["custkey"], ["partkey"], ["graph_year"], [known], infer)


SQL_LABELLED = f"""left_ AS (SELECT custkey, partkey FROM cand k WHERE NOT EXISTS (SELECT 1 FROM buys o WHERE o.year <= '1999' AND o.custkey = k.custkey AND o.partkey = k.partkey)),
pos AS (SELECT custkey, partkey, sample_type FROM left_ JOIN labels_ USING (custkey, partkey)),
unknown AS (SELECT * FROM left_ l WHERE NOT EXISTS (SELECT 1 FROM labels_ x WHERE x.custkey = l.custkey AND x.partkey = l.partkey)),
both_ AS (SELECT u.custkey, u.partkey, x.sample_type FROM unknown u JOIN (SELECT DISTINCT custkey, sample_type FROM labels_) x USING (custkey)
  UNION ALL SELECT u.custkey, u.partkey, x.sample_type FROM unknown u JOIN (SELECT DISTINCT partkey, sample_type FROM labels_) x USING (partkey)),
neg AS (SELECT custkey, partkey, arg_min(sample_type, {_md5('negative', 'custkey', 'partkey', chr(39) + '1999' + chr(39), 'sample_type')}) AS sample_type FROM both_ GROUP BY ALL),
labelled AS (SELECT *, 1 AS label FROM pos UNION ALL SELECT *, 0 FROM neg)"""


@query(f"WITH {SQL_EDGES}, {SQL_CANDIDATES}, {SQL_LABELS}, {SQL_LABELLED} SELECT custkey, partkey, '1999' AS graph_year, sample_type, CAST(label AS VARCHAR) AS label FROM labelled UNION ALL SELECT custkey, partkey, '1999', 'infer', NULL FROM unknown")
def pairs_labeled(spark, sf_dir):
    return _labelled_pairs(spark, sf_dir, True).withColumn("label", F.col("label").cast("string"))


@query(f"""WITH {SQL_EDGES}, {SQL_CANDIDATES}, {SQL_LABELS}, {SQL_LABELLED}, quota AS (SELECT sample_type, count(*) * CASE sample_type WHEN 'train' THEN 3 ELSE 5 END AS total FROM pos GROUP BY sample_type),
b AS (SELECT n.*, floor(CAST(('0x' || substr(md5(concat_ws('|', 'neg-' || sample_type, custkey, partkey)), 1, 8)) AS BIGINT) / 4294967296.0 * 10) AS bucket FROM neg n),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_type, bucket ORDER BY md5(concat_ws('|', 'neg-' || sample_type || '-rank', custkey, partkey)), custkey, partkey) AS rk FROM b)
SELECT custkey, partkey, '1999' AS graph_year, sample_type, label FROM labelled WHERE label = 1
UNION ALL SELECT custkey, partkey, '1999', sample_type, 0 FROM k JOIN quota USING (sample_type) WHERE rk <= total // 10 + CASE WHEN bucket = 9 THEN total % 10 ELSE 0 END""")
def neg_sampling(spark, sf_dir):
    return pairs.sample_negatives(_labelled_pairs(spark, sf_dir, False), {"train": 3, "valid": 5, "test": 5}, ["custkey", "partkey"], 10)


def _collection(spark: SparkSession, sf_dir: str) -> collect.Collection:
    instances = paths.PathPlanner(_tokens(spark, sf_dir), _heads(spark, sf_dir)).prefix(_cps(None))
    return collect.Collection("cps", instances, (C0, "graph_year"), ("custkey", "graph_year"), (P1, S2))


SQL_COLLECT = f"""caps AS (SELECT * FROM (SELECT e.c AS custkey, e.p, f.s, row_number() OVER (PARTITION BY e.c ORDER BY {_md5('collect-cps', 'e.c', chr(39) + '1999' + chr(39), 'e.p', 'f.s')}) AS rk
  FROM e JOIN f ON e.p = f.p) WHERE rk <= 6)"""


@query(f"WITH {SQL_EDGES}, {SQL_COLLECT} SELECT CAST(c_custkey AS VARCHAR) AS custkey, '1999' AS graph_year, CAST(n AS INT) AS cps_collect_count, ps AS parts, ss AS suppliers FROM customer LEFT JOIN (SELECT custkey, count(*) AS n, string_agg(p, ',' ORDER BY p, s) AS ps, string_agg(s, ',' ORDER BY p, s) AS ss FROM caps GROUP BY ALL) ON custkey = CAST(c_custkey AS VARCHAR)")
def pair_collection(spark, sf_dir):
    heads = _heads(spark, sf_dir).withColumnRenamed("c", "custkey")
    out = collect.collect_pairs(heads, [_collection(spark, sf_dir)], 6)
    return out.select("custkey", "graph_year", "cps_collect_count", F.array_join(f"cps_clt_{P1}", ",").alias("parts"), F.array_join(f"cps_clt_{S2}", ",").alias("suppliers"))


@query(f"WITH {SQL_EDGES}, {SQL_COLLECT}, r AS (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY p, s) AS i, count(*) OVER (PARTITION BY custkey) AS n FROM caps) SELECT custkey, '1999' AS graph_year, CAST(n AS INT) AS cps_collect_count, max(CASE WHEN i = 1 THEN p END) AS first_part, max(CASE WHEN i = 2 THEN s END) AS second_supplier FROM r GROUP BY ALL")
def collect_slots(spark, sf_dir):
    c = _collection(spark, sf_dir)
    out = collect.as_slots(collect.collect(c, 6), c, 2)
    return out.select("custkey", "graph_year", "cps_collect_count", F.col(f"cps_id_0_{P1}").alias("first_part"), F.col(f"cps_id_1_{S2}").alias("second_supplier"))


_NODES = f"""nodes AS (SELECT node_type, node_id, row_number() OVER (ORDER BY {_md5('node', 'node_type', 'node_id')}, node_type, node_id) - 1 AS index FROM (SELECT 'Customer' AS node_type, c AS node_id FROM e UNION SELECT 'Part', p FROM e))"""


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = path_1hop(spark, sf_dir)
    return e, dataset.subgraph_nodes([(e, "Customer", [C0]), (e, "Part", [P1])])


@query(f"WITH {SQL_EDGES}, {_NODES} SELECT * FROM nodes")
def subgraph_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)[1]


@query(f"WITH {SQL_EDGES}, {_NODES} SELECT a.index AS head_index, b.index AS tail_index, '1999' AS graph_year FROM e JOIN nodes a ON a.node_type = 'Customer' AND a.node_id = c JOIN nodes b ON b.node_type = 'Part' AND b.node_id = p")
def subgraph_edges_indexed(spark, sf_dir):
    e, nodes = _nodes(spark, sf_dir)
    return dataset.subgraph_edges(e, nodes, ("Customer", C0), ("Part", P1), ["graph_year"])


@query(f"""WITH {SQL_EDGES}, {SQL_COLLECT}, n AS (SELECT custkey, count(*) AS n FROM caps GROUP BY ALL), r AS (SELECT custkey, CAST(unnest(range(n)) AS INT) AS instance FROM n)
SELECT custkey, CAST(row_number() OVER (PARTITION BY custkey ORDER BY instance) + 1 AS INT) AS slot, 0 AS path, instance, row_number() OVER (ORDER BY {_md5('token', 'custkey', '0', 'instance')}, custkey, instance) + 1 AS path_index FROM r""")
def token_index_encoding(spark, sf_dir):
    return dataset.token_index(collect.collect(_collection(spark, sf_dir), 6), ["custkey"], ["cps"], ["custkey"])


# --- scores -----------------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a made-up score of 100 steps (so there are ties) and a label."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    u = W.hash_fraction("score", ["o_orderkey"])
    return orders.withColumn("score", F.floor((u + F.col("label") * 0.3) / 1.3 * 100) / 100)


_S = f"s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, floor(({_u('score', 'o_orderkey')} + CASE WHEN o_orderstatus = 'F' THEN 0.3 ELSE 0 END) / 1.3 * 100) / 100 AS score FROM orders)"
_T = f"{_S}, g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM s GROUP BY score), c AS (SELECT *, sum(n) OVER w - n AS nb, sum(pos) OVER w - pos AS pb, (SELECT count(*) FROM s) AS total, (SELECT sum(label) FROM s) AS positives FROM g WINDOW w AS (ORDER BY score DESC))"


@query(f"""WITH {_T} SELECT (SELECT round(avg(-CASE WHEN label = 1 THEN ln(greatest(least(score, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)) END), 9) FROM s) AS log_loss,
  round(sum((n - pos) * (pb + pos / 2)) / (max(positives) * (max(total) - max(positives))), 9) AS roc_auc,
  round(sum(pos / positives * ((pb + pos) / (nb + n) + CASE WHEN nb > 0 THEN pb / nb ELSE (pb + pos) / (nb + n) END) / 2), 9) AS pr_auc, CAST(max(total) AS BIGINT) AS rows, CAST(max(positives) AS BIGINT) AS positives FROM c""")
def binary_metrics(spark, sf_dir):
    return _rounded(M.binary_metrics(_scored(spark, sf_dir)), 9)


@query(f"""WITH {_T} SELECT cut, k, round(sum(pos * greatest(0, least(n, k - nb)) / n) / k, 9) AS precision FROM c,
(SELECT 'top_10' AS cut, 10 AS k UNION ALL SELECT 'top_500', 500 UNION ALL SELECT 'top_1%', CAST(floor(count(*) * 0.01) AS BIGINT) FROM s) GROUP BY cut, k""")
def topk_precision(spark, sf_dir):
    return _rounded(M.top_k_precision(_scored(spark, sf_dir), [10, 500], [0.01]), 9)


@query(f"WITH {_T} SELECT k, round(sum(pos * greatest(0, least(n, k - nb)) / n), 9) AS hits, round(sum(pos) / sum(n), 9) AS base_rate, round(sum(pos * greatest(0, least(n, k - nb)) / n) / k / (sum(pos) / sum(n)), 9) AS lift FROM c, (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) AS k FROM s) GROUP BY k")
def rank_lift(spark, sf_dir):
    return _rounded(M.lift(_scored(spark, sf_dir), 0.05), 9)


@query("""WITH d AS (SELECT abs(l_quantity - (l_tax * 500)) AS e, abs(l_quantity) + abs(l_tax * 500) AS s FROM lineitem)
SELECT round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS mae, round(avg(CASE WHEN s = 0 THEN 0 ELSE 2 * e / s END), 6) AS smape,
  round(avg(CAST(e <= 0.5 AS DOUBLE)), 6) AS within_0_5, round(avg(CAST(e <= 3 AS DOUBLE)), 6) AS within_3, round(avg(CAST(e <= 5 AS DOUBLE)), 6) AS within_5 FROM d""")
def regression_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("predicted"), (F.col("l_tax") * 500).alias("actual"))
    return _rounded(M.regression_metrics(df), 6)


@query("""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_samp(o_totalprice) AS sd FROM orders)
SELECT o_orderkey, o_totalprice AS raw, round((o_totalprice - lo) / (hi - lo), 9) AS norm, round(o_totalprice / sd, 9) AS std FROM orders, s""")
def minmax_std_scale(spark, sf_dir):
    out = V.scale(table(spark, sf_dir, "orders"), ["o_totalprice"], ["raw", "norm", "std"], ["o_orderkey"])
    return out.select("o_orderkey", F.col("features_raw")[0].alias("raw"), F.round(F.col("features_norm")[0], 9).alias("norm"), F.round(F.col("features_std")[0], 9).alias("std"))


@query()
def lr_scorer(spark, sf_dir):
    """Pairs scored by the default scorer from path counts: (custkey, partkey, sample_type, label, score)."""
    tk = paths.ends_written(_tokens(spark, sf_dir), [HopSpec(BUYS), HopSpec(SHIPS)])
    planner = paths.PathPlanner(tk, _heads(spark, sf_dir))
    c = collect.Collection("cps", planner.prefix(_cps(None)), (C0, "graph_year"), ("custkey", "graph_year"), (P1, S2))
    counts = written(collect.collect_counts(c, 20), "counts")
    first, onward = paths.onward_pairs(planner, _candidate_paths())
    labels = _labels(spark, sf_dir).withColumnRenamed("year", "graph_year")
    known = purchases(spark, sf_dir).where("year <= '1999'").select("custkey", "partkey")
    # written, as each step of the fit reads it
    met = pairs.label_pairs_by_head(first.toDF("custkey", "middle", "graph_year"), onward.toDF("middle", "partkey", "graph_year"), labels, ["custkey"], ["middle"], ["partkey"], ["graph_year"], [known], counts)
    features = dataset.pair_features(met, ["cps"]).withColumn("f_1", W.hash_fraction("noise", ["custkey", "partkey"]))
    scorer = dataset.LogisticScorer(["f_0", "f_1"]).fit(features.where("sample_type = 'train'"))
    return scorer.score(features).select("custkey", "partkey", "sample_type", "label", "score")


@query(f"""WITH {SQL_EDGES}, {SQL_NEW}, t AS (SELECT * FROM new WHERE CAST(custkey AS INT) % 100 = 0), hs AS (SELECT DISTINCT custkey FROM t),
m1 AS (SELECT c AS head, p AS tail, count(*) AS n FROM e WHERE c IN (SELECT custkey FROM hs) GROUP BY ALL),
m2 AS (SELECT a.c AS head, d.p AS tail, count(*) AS n FROM e a JOIN e b ON a.p = b.p JOIN e d ON b.c = d.c WHERE a.c IN (SELECT custkey FROM hs) GROUP BY ALL),
m3 AS (SELECT a.c AS head, d.p AS tail, count(*) AS n FROM e a JOIN f b ON a.p = b.p JOIN f d ON b.s = d.s WHERE a.c IN (SELECT custkey FROM hs) GROUP BY ALL)
{_METRIC.format(_N1, "m1")} UNION ALL {_METRIC.format(_N3, "m2")} UNION ALL {_METRIC.format(_N3S, "m3")}""")
def match_metrics_one_end(spark, sf_dir):
    """The same search from the heads alone."""
    links = _new_links(spark, sf_dir).where("cast(custkey as int) % 100 = 0").withColumn("graph_year", F.lit("1999"))
    return paths.find_paths(_tokens(spark, sf_dir), links, _HOPS, "Customer", "Part", 3, n=None, both_ends=False)


@query(f"WITH {SQL_BUYS}, s AS (SELECT custkey, year, min(quantity) AS quantity FROM buys GROUP BY ALL) SELECT custkey, '1998' AS graph_year, sum(quantity) AS label, CASE WHEN {_u('instances', 'custkey')} < 0.8 THEN 'train' ELSE 'test' END AS sample_type FROM s WHERE year IN ('1999', '2000') GROUP BY ALL")
def train_instances(spark, sf_dir):
    """Labels from a window after the graph time, split by hash."""
    source = clean_source(purchases(spark, sf_dir), ["custkey"], ["quantity"], ["year"])
    ahead = WindowGroup(("sum",), (TimeWindow(1, 2, "year"),))
    labels = tokens.time_aggregate(spark, source, ["custkey"], ["quantity"], ["year"], ["%Y"], [ahead], ["graph_year"], ["%Y"], [("1998",)])
    return W.random_split(labels.withColumnRenamed("agg_1_to_3_year_sum_quantity", "label"), [("train", 0.8), ("test", 0.2)], ["custkey"], "instances")


@query(f"""WITH {SQL_EDGES}, {SQL_CANDIDATES}, {SQL_LABELS}, {SQL_LABELLED}, quota AS (SELECT sample_type, 2 * count(*) AS total FROM pos GROUP BY sample_type),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_type ORDER BY floor({_u('batch', 'custkey', 'partkey')} * 64), {_md5('batch', 'custkey', 'partkey')}) AS rk FROM neg)
SELECT custkey, partkey, '1999' AS graph_year, sample_type, label FROM labelled WHERE label = 1 UNION ALL SELECT custkey, partkey, '1999', sample_type, 0 FROM k JOIN quota USING (sample_type) WHERE rk <= total""")
def training_batch(spark, sf_dir):
    return pairs.training_batch(_labelled_pairs(spark, sf_dir, False), ["custkey", "partkey"], 2)


@query(f"""WITH {SQL_EDGES}, a AS (SELECT c, CAST(least(6, count(*)) AS INT) AS n FROM e GROUP BY c), b AS (SELECT e.c, CAST(least(6, count(*)) AS INT) AS n FROM e JOIN f ON e.p = f.p GROUP BY e.c)
SELECT CAST(c_custkey AS VARCHAR) AS custkey, coalesce(b.n, 0) AS cps_collect_count, coalesce(a.n, 0) AS cp_collect_count FROM customer LEFT JOIN a ON a.c = CAST(c_custkey AS VARCHAR) LEFT JOIN b ON b.c = CAST(c_custkey AS VARCHAR)""")
def multi_path_collection(spark, sf_dir):
    heads = _heads(spark, sf_dir)
    short = paths.PathPlanner(_tokens(spark, sf_dir), heads).prefix(linear_path("cp", [HopSpec(BUYS)]))
    one = collect.Collection("cp", short, (C0, "graph_year"), ("custkey", "graph_year"), (P1,))
    out = collect.collect_pairs(heads.withColumnRenamed("c", "custkey"), [_collection(spark, sf_dir), one], 6)
    return collect.fill_counts(out, ["cps", "cp"]).select("custkey", "cps_collect_count", "cp_collect_count")


@query("SELECT o_orderkey, concat_ws(',', CAST(o_totalprice > 200000 AS INT), CAST(o_orderstatus = 'F' AS INT), CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS vector FROM orders")
def merged_vectors(spark, sf_dir):
    """Vectors put together, null ones as zeros."""
    orders = table(spark, sf_dir, "orders")
    a = F.array((F.col("o_totalprice") > 200000).cast("double"), (F.col("o_orderstatus") == "F").cast("double"))
    b = V.fill_null_vector(F.when(F.col("o_orderstatus") == "O", F.array(F.lit(1.0))), 1)
    return orders.select("o_orderkey", F.array_join(F.transform(V.merge_vectors(a, b), lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query(f"WITH {_S} SELECT o_orderkey, score, row_number() OVER (ORDER BY score DESC, o_orderkey) AS rank FROM s")
def ranked_predictions(spark, sf_dir):
    return M.rank_predictions(_scored(spark, sf_dir).select("o_orderkey", "score"), ["o_orderkey"])


# --- saved tables, validation, exports ------------------------------------------------------


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/queries/{label}-{uuid.uuid4().hex}"


@query(f"WITH {SQL_BUYS} SELECT custkey AS who, partkey AS what, year, quantity FROM buys WHERE year IN ('1996', '1998')")
def saved_partitions(spark, sf_dir):
    """A table saved by year, and two of its partitions read by name with an aliased projection."""
    path = _folder(spark, "purchases")
    save_table(purchases(spark, sf_dir).select("custkey", "partkey", "quantity", "year"), path, ["year"])
    cols = [("custkey", "who"), ("partkey", "what"), ("year", "year"), ("quantity", "quantity")]
    return read_table(spark, path, partitions=(["year"], [("1996",), ("1998",)]), select=cols).withColumn("year", F.col("year").cast("string"))


@query(f"WITH {SQL_BUYS} SELECT year, custkey, count(*) AS n FROM buys WHERE year IN ('1995', '1996', '1997') GROUP BY ALL")
def missing_partitions_computed(spark, sf_dir):
    """Partitions that are complete are read, the missing ones computed and saved."""
    path = _folder(spark, "counts")
    counts = lambda years: purchases(spark, sf_dir).where(F.col("year").isin([y for (y,) in years])).groupBy("year", "custkey").agg(F.count(F.lit(1)).alias("n"))
    compute_missing(spark, path, ["year"], [("1995",), ("1996",)], counts)
    done = compute_missing(spark, path, ["year"], [("1995",), ("1996",), ("1997",)], counts)
    return done.select(F.col("year").cast("string").alias("year"), "custkey", "n")


@query(f"WITH {SQL_CP} SELECT custkey AS c, partkey AS p, g AS graph_year, count(*) + 0.0 AS n, sum(quantity) AS q FROM cp, (VALUES ('1998'), ('1999')) t(g) WHERE CAST(year AS INT) BETWEEN CAST(g AS INT) - 9 AND CAST(g AS INT) GROUP BY ALL")
def tokens_saved(spark, sf_dir):
    """Tokens of one graph time are saved; a second use reads them and computes the other time only."""
    folder = _folder(spark, "tokens")
    Tokens(spark, _graph(sf_dir), YEAR, folder=folder)("edge", BUYS)
    df = Tokens(spark, _graph(sf_dir), YEARS, folder=folder)("edge", BUYS)
    slots = _graph(sf_dir).edges[BUYS].slots
    return df.select(F.col("index_0_node_Customer_col_0").alias("c"), F.col("index_1_node_Part_col_0").alias("p"), F.col("graph_year").cast("string").alias("graph_year"), F.col(f"{BUYS}_feat_col.`{slots[0]}`").alias("n"), F.col(f"{BUYS}_feat_col.`{slots[1]}`").alias("q"))


@query(f"""WITH {SQL_BUYS}, a AS (SELECT 'purchases' AS "table", year AS period, custkey || '|' || partkey AS k FROM buys UNION ALL SELECT 'orders', '', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'items', '', CAST(l_orderkey AS VARCHAR) FROM lineitem),
n AS (SELECT "table", period, k, count(*) AS n FROM a GROUP BY ALL) SELECT "table", period, CAST(sum(n) AS BIGINT) AS rows, count(CASE WHEN n > 1 THEN 1 END) AS duplicate_keys FROM n GROUP BY ALL""")
def tables_validated(spark, sf_dir):
    """Every table and partition: rows and repeated keys."""
    return A.validate_tables([("purchases", purchases(spark, sf_dir), ["custkey", "partkey"], ["year"]), ("orders", table(spark, sf_dir, "orders"), ["o_orderkey"], []), ("items", table(spark, sf_dir, "lineitem"), ["l_orderkey"], [])])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS rows FROM orders GROUP BY ALL")
def status_counts(spark, sf_dir):
    return A.group_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_custkey, " + ", ".join(f"coalesce(string_agg(CASE WHEN o_orderstatus = '{v}' THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY o_orderkey), '') AS \"{v}_orders\"" for v in "FO") + " FROM orders GROUP BY o_custkey")
def collect_pivot(spark, sf_dir):
    rows = A.collect_rows(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "orders", "o_orderstatus", ["F", "O"])
    return rows.select("o_custkey", *[F.array_join(F.transform(f"{v}_orders", lambda r: r["o_orderkey"].cast("string")), ",").alias(f"{v}_orders") for v in "FO"])


@query("SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d, '%Y-%m') AS month, strftime(d, '%Y') AS year FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)")
def times_reformatted(spark, sf_dir):
    """Calendar values in other formats, for the (few) periods of a table."""
    days = [r[0] for r in table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd")).distinct().collect()]
    rows = [(d, *reformat([d], ["%Y-%m-%d"], ["%Y-%m", "%Y"])) for d in days]
    return spark.createDataFrame(rows, "day string, month string, year string")


@query(f"WITH {SQL_EDGES} SELECT {_AS_EDGE} FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {_md5(f'forward_{BUYS}-hop-0', 'c', 'p', chr(39) + '1999' + chr(39))}) AS k FROM e WHERE p IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 30)) WHERE k <= 2")
def hop_samples(spark, sf_dir):
    """Sampled after the limit on nodes."""
    return _endpoints(hop_table(_tokens(spark, sf_dir), HopSpec(BUYS, node_limits=(NodeLimit(1, "attributes__size > 30"),), hop_samples=(Sample("random", (0,), 2),))))


@query(f"WITH {SQL_EDGES} SELECT e.c AS {C0}, e.p AS {P1}, y.s AS {S2}, '1999' AS graph_year FROM e LEFT JOIN {_sampled('f', 's', 'p, s', f'forward_{SHIPS}-edge-0', 3)} y ON e.p = y.p")
def path_left_join(spark, sf_dir):
    """A hop that keeps instances without a partner."""
    ships = HopSpec(SHIPS, edge_samples=(Sample("random", (1,), 3),), how="left")
    return paths.PathPlanner(_tokens(spark, sf_dir)).prefix(PathSpec("cps", (PathStep(HopSpec(BUYS), 0, 1), PathStep(ships, 1, 2)))).select(C0, P1, S2, "graph_year")


@query(f"WITH {SQL_EDGES} SELECT e.c AS {C0}, e.p AS {P1}, f.s AS {S2}, '1999' AS graph_year FROM e JOIN f ON e.p = f.p WHERE f.s IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey < 5)")
def targets_at_the_end(spark, sf_dir):
    """Targets on the path's last node; the last hop is cut to them before it is joined."""
    ends = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").cast("string").alias("s"), F.lit("1999").alias("graph_year"))
    return paths.PathPlanner(_tokens(spark, sf_dir), ends, target_position=2).prefix(_cps(None)).select(C0, P1, S2, "graph_year")


@query(f"SELECT * FROM ({ORACLE_SQL['match_metrics_one_end']}) ORDER BY matched_distinct_edge_count DESC, path LIMIT 2")
def top_paths(spark, sf_dir):
    """The two best path types."""
    return paths.rank_paths(match_metrics_one_end(spark, sf_dir), top=2)


_CUSTOMER_CAPS = f"WITH {SQL_EDGES}, {SQL_COLLECT}"


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collection(spark, sf_dir)
    return collect.instances_of(collect.collect(c, 6), c)


@query(f"{_CUSTOMER_CAPS} SELECT DISTINCT 'Customer' AS node_type, custkey AS node_id FROM caps UNION SELECT 'Part', p FROM caps UNION SELECT 'Supplier', s FROM caps")
def export_nodes(spark, sf_dir):
    """Nodes of the sub-graph that collected instances span."""
    return dataset.instance_nodes(_collected(spark, sf_dir), [("Customer", "custkey"), ("Part", P1), ("Supplier", S2)])


@query(f"{_CUSTOMER_CAPS} SELECT DISTINCT '{BUYS}' AS edge_type, custkey AS head, p AS tail, '1999' AS graph_year FROM caps UNION SELECT '{SHIPS}', p, s, '1999' FROM caps")
def export_edges(spark, sf_dir):
    """Its edges, by type."""
    return dataset.instance_edges(_collected(spark, sf_dir), [(BUYS, "custkey", P1), (SHIPS, P1, S2)], ["graph_year"])


@query(f"{_CUSTOMER_CAPS} SELECT custkey, 0 AS path, CAST(row_number() OVER (PARTITION BY custkey ORDER BY p, s) - 1 AS INT) AS instance, '2,3,4,0' AS types, custkey || '|' || p || ',' || p || ',' || p || '|' || s || ',' AS tokens FROM caps")
def token_sequences(spark, sf_dir):
    """Collected instances as padded sequences of type numbers, with the tokens' identifiers."""
    offsets = dataset.token_offsets({"paths": {"cps": [["edge", BUYS, 0], ["node", "Part", 1], ["edge", SHIPS, 1]]}})
    out = dataset.encode_instances(_collected(spark, sf_dir), ["custkey"], 0, [("edge", BUYS, f"custkey|{P1}"), ("node", "Part", P1), ("edge", SHIPS, f"{P1}|{S2}")], offsets, 4)
    return out.select("custkey", "path", "instance", F.array_join(F.transform("types", lambda t: t.cast("string")), ",").alias("types"), F.array_join("tokens", ",", "").alias("tokens"))


@query("""WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y') AS year, c_name AS org, CAST(o_custkey AS VARCHAR) AS author FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT author AS author_id, org, year, count(*) AS author_paper_count FROM r GROUP BY ALL""")
def publication_records(spark, sf_dir):
    """Nested records written as JSON lines, read with the declared schema and normalised (orders stand for papers, customers for authors)."""
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    person = F.struct(F.col("o_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_name").alias("org"))
    path = _folder(spark, "records")
    met.select(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy").alias("year"), F.array(person).alias("authors")).write.json(path)
    return publication_tables(read_records(spark, path))["author_to_org"]
