"""Registered queries for the relational constructs, vectors, texts and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import text, vectors
from ..sources import market as src
from ..sources import sinks
from ..streaming import events as ev
from .sql import NEAREST

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return src.table(spark, d, name)


@register("""SELECT o_orderkey, o_custkey, coalesce(c_mktsegment, 'NEUTRAL') AS segment, coalesce(c_acctbal, 0) AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def c1_c14_left_join_default(spark: SparkSession, d: str) -> DataFrame:
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "o_custkey", F.coalesce("c_mktsegment", F.lit("NEUTRAL")).alias("segment"), F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"))


@register("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, round(sum(coalesce(o_totalprice, 0)), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey
JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""")
def c2_inner_and_left_joins(spark: SparkSession, d: str) -> DataFrame:
    r, n, c, o = (t(spark, d, x) for x in ("region", "nation", "customer", "orders"))
    rows = c.join(n.join(r, n.n_regionkey == r.r_regionkey), c.c_nationkey == n.n_nationkey).join(o, o.o_custkey == c.c_custkey, "left")
    return rows.groupBy("r_name", "n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.round(F.sum(F.coalesce("o_totalprice", F.lit(0.0))), 2).alias("total"))


@register("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')""")
def c9_semi_join(spark: SparkSession, d: str) -> DataFrame:
    o, c = t(spark, d, "orders").where("o_orderdate >= '2001-01-01'"), t(spark, d, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left_semi").select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def c10_anti_join(spark: SparkSession, d: str) -> DataFrame:
    o, c = t(spark, d, "orders"), t(spark, d, "customer").where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.join(o, o.o_custkey == c.c_custkey, "left_anti").select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1993-01-01') AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def c10_anti_join_early(spark: SparkSession, d: str) -> DataFrame:
    """Customers of other segments without an order in the first year."""
    o, c = t(spark, d, "orders").where("o_orderdate < '1993-01-01'"), t(spark, d, "customer").where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.join(o, o.o_custkey == c.c_custkey, "left_anti").select("c_custkey")


@register("""WITH e AS (SELECT event_id, user_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events), n AS (SELECT user_id, list(event_type) AS types FROM e WHERE k > 50 GROUP BY user_id)
SELECT a.event_id, a.k, list_contains(coalesce(types, []), a.event_type) AS recommended FROM e a LEFT JOIN n USING (user_id) WHERE a.event_type = 'purchase'""")
def c12_h28_array_membership(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    n = e.where("k > 50").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    has = F.coalesce(F.array_contains("types", F.col("event_type")), F.lit(False))
    return e.where("event_type = 'purchase'").join(n, "user_id", "left").select("event_id", "k", has.alias("recommended"))


@register("""WITH a AS (SELECT p_partkey AS k, p_brand AS v, CASE WHEN p_size > 25 THEN p_size END AS s FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, p_type AS v, p_size AS s FROM part WHERE p_partkey % 3 <> 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, coalesce(a.s, b.s) AS s FROM a FULL JOIN b ON a.k = b.k""")
def c18_full_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    a = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("s"))
    b = p.where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v"), F.col("p_size").alias("s"))
    return text.merge_preferring(a, b, "k")


@register("""SELECT p_brand, count(*) AS raw_n, count(*) FILTER (WHERE p_size > 10) AS effective_n, count(*) / nullif(count(*) FILTER (WHERE p_size > 10), 0) > 1.5 AS warn FROM part GROUP BY p_brand HAVING count(*) FILTER (WHERE p_size > 10) > 0""")
def d4_d5_l21_filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("raw_n"), F.count_if(F.col("p_size") > 10).alias("effective_n")).where("effective_n > 0")
    return rows.withColumn("warn", F.try_divide("raw_n", "effective_n") > 1.5)


@register("""SELECT p_type AS category, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(median(p_retailprice), 4) AS median, round(avg(CASE WHEN p_retailprice > 1200 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM part GROUP BY p_type""")
def d7_base_rates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_retailprice")
    return t(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.percentile(p, F.lit(0.5)), 4).alias("median"), F.round(F.avg(F.when(p > 1200, 1.0).otherwise(0.0)), 6).alias("win_rate")
    )


@register("""SELECT c_mktsegment AS segment, round(avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 0), 4) AS recommended, round(avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 1), 4) AS control,
 round(avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 0) - avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 1), 4) AS alpha FROM customer GROUP BY c_mktsegment""")
def d9_g5_alpha(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: F.avg(F.when(F.col("c_custkey") % 2 == k, F.col("c_acctbal")))
    return t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(side(0), 4).alias("recommended"), F.round(side(1), 4).alias("control"), F.round(side(0) - side(1), 4).alias("alpha"))


@register("""WITH g AS (SELECT o_orderpriority AS version, o_orderstatus AS list, avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END) AS wr, count(*) AS n FROM orders GROUP BY ALL)
SELECT version, CAST(sum(CAST(trunc(wr * n + 1e-9) AS BIGINT)) AS BIGINT) AS wins, CAST(sum(n) AS BIGINT) AS picks FROM g GROUP BY version""")
def d19_pooled_proportions(spark: SparkSession, d: str) -> DataFrame:
    """Wins pooled from stored rates; the product truncates."""
    g = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("version"), F.col("o_orderstatus").alias("list")).agg(F.avg(F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0)).alias("wr"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("version").agg(F.sum((F.col("wr") * F.col("n") + 1e-9).cast("long")).alias("wins"), F.sum("n").alias("picks"))


@register("SELECT p_brand, round(avg(p_size), 6) AS mean, round(stddev_pop(p_size), 6) AS std, round(median(p_size), 6) AS median, count(*) FILTER (WHERE p_size < 25) / nullif(count(*) FILTER (WHERE p_size >= 25), 0) AS class_weight FROM part GROUP BY p_brand")
def d20_d21_fold_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return t(spark, d, "part").groupBy("p_brand").agg(
        F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_pop(s), 6).alias("std"), F.round(F.percentile(s, F.lit(0.5)), 6).alias("median"), F.try_divide(F.count_if(s < 25), F.count_if(s >= 25)).alias("class_weight")
    )


@register(NEAREST + "SELECT query_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS k FROM m) WHERE k <= 10")
def f8_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The ten labelled vectors nearest to each query vector, by exact cosine distance."""
    e = t(spark, d, "embeddings")
    return vectors.nearest(e.where("vec_id % 50 = 0"), e.where("label is not null"), 10).select("query_id", "vec_id", "distance")


@register("""WITH u AS (SELECT p_brand AS symbol, 1 AS src, p_partkey AS k FROM part WHERE p_size > 40 UNION ALL SELECT p_brand, 2, p_partkey FROM part WHERE p_size < 5 UNION ALL SELECT p_type, 3, p_partkey FROM part)
SELECT symbol, src AS source, k AS first_key FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY src, k) AS n FROM u) WHERE n = 1""")
def g1_union_keep_first(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    take = lambda rows, c, s: rows.select(F.col(c).alias("symbol"), F.lit(s).alias("source"), F.col("p_partkey").alias("first_key"))
    u = take(p.where("p_size > 40"), "p_brand", 1).unionByName(take(p.where("p_size < 5"), "p_brand", 2)).unionByName(take(p, "p_type", 3))
    return u.groupBy("symbol").agg(F.min(F.struct("source", "first_key")).alias("x")).select("symbol", "x.source", "x.first_key")


@register("SELECT p_brand AS symbol FROM part UNION SELECT p_type FROM part UNION SELECT n_name FROM nation")
def g2_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    p, n = t(spark, d, "part"), t(spark, d, "nation")
    return p.select(F.col("p_brand").alias("symbol")).union(p.select("p_type")).union(n.select("n_name")).distinct()


@register("SELECT s_suppkey AS k, 1 AS priority FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_suppkey, 2 FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def g3_f10_queue(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    first = s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"), F.lit(1).alias("priority"))
    return sinks.insert_if_absent(first, s.select(F.col("s_suppkey").alias("k"), F.lit(2).alias("priority")), ["k"])


@register("""SELECT c_custkey, CASE WHEN c_acctbal >= 1e3 THEN printf('%.0fK', round_even(c_acctbal / 1e3, 0)) ELSE printf('%.0f', round(c_acctbal)) END AS shown,
 CASE WHEN v >= 1e12 THEN printf('$%.1fT', round_even(v / 1e12, 1)) WHEN v >= 1e9 THEN printf('$%.1fB', round_even(v / 1e9, 1)) WHEN v >= 1e6 THEN printf('$%.0fM', round_even(v / 1e6, 0)) ELSE printf('$%.0f', round(v)) END AS cap,
 CASE WHEN v >= 1e9 THEN printf('$%.1fB', round_even(v / 1e9, 1)) WHEN v >= 1e6 THEN printf('$%.0fM', round_even(v / 1e6, 0)) ELSE printf('$%.0f', round(v)) END AS revenue
FROM (SELECT *, c_acctbal * c_acctbal * 16384 AS v FROM customer) c""")
def h30_human_numbers(spark: SparkSession, d: str) -> DataFrame:
    large = F.col("c_acctbal") * F.col("c_acctbal") * 16384
    return t(spark, d, "customer").select("c_custkey", fn.human_number(F.col("c_acctbal")).alias("shown"), fn.market_cap(large).alias("cap"), fn.revenue(large).alias("revenue"))


@register("""WITH p AS (SELECT p_partkey, '$' || CAST(CAST(p_size AS DECIMAL(10,2)) AS VARCHAR) || ' – $' || CAST(CAST(p_size + 5 AS DECIMAL(10,2)) AS VARCHAR) AS zone FROM part)
SELECT p_partkey, CAST(regexp_extract(split_part(zone, '–', 1), '([0-9,]+\\.?[0-9]*)', 1) AS DOUBLE) AS low, CAST(regexp_extract(split_part(zone, '–', 2), '([0-9,]+\\.?[0-9]*)', 1) AS DOUBLE) AS high FROM p""")
def h22_price_zones(spark: SparkSession, d: str) -> DataFrame:
    money = lambda c: F.concat(F.lit("$"), F.format_string("%d.00", c))
    p = t(spark, d, "part").select("p_partkey", F.concat(money(F.col("p_size")), F.lit(" – "), money(F.col("p_size") + 5)).alias("zone"))
    low, high = fn.entry_zone(F.col("zone"))
    return p.select("p_partkey", low.alias("low"), high.alias("high"))


@register("SELECT doc_id, 'v7-' || substr(sha256(coalesce(source, '') || coalesce(text, '')), 1, 8) AS version FROM documents")
def h18_version_hash(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", text.version_hash("v7", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("version"))


@register("""WITH RECURSIVE n AS (SELECT s_suppkey, s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS left_over FROM supplier),
 l AS (SELECT s_suppkey, s_name, left_over, '' AS alias FROM n UNION ALL SELECT s_suppkey, s_name, (left_over - 1) // 26, chr(CAST(65 + (left_over - 1) % 26 AS INT)) || alias FROM l WHERE left_over > 0)
SELECT s_suppkey, alias, 'buy ' || s_name || '.' AS restored FROM l WHERE left_over = 0""")
def h29_anonymous_names(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's suppliers get letters in key order; a text that uses them is turned back."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = t(spark, d, "supplier").select("s_suppkey", "s_name", text.anonymous_name(F.row_number().over(w) - 1).alias("alias"))
    # a longer alias, which is not in the text, is tried before its own
    names = F.array(F.struct("alias", F.col("s_name").alias("name")), F.struct(F.concat("alias", F.lit("A")).alias("alias"), F.lit("another").alias("name")))
    said = F.concat(F.lit("buy "), F.col("alias"), F.lit("."))
    return s.select("s_suppkey", "alias", text.put_back(said, names).alias("restored"))


@register("""WITH m AS (SELECT doc_id, '| Ticker | Price |\n|---|---|\n| D' || doc_id || ' | $' || n_chars || ' |' AS body, n_chars FROM documents) SELECT doc_id, 'D' || doc_id AS ticker, CAST(n_chars AS DOUBLE) AS price FROM m""")
def h23_markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("text\n| Ticker | Price |\n|---|---|\n| **D"), F.col("doc_id").cast("string"), F.lit("** | $"), F.col("n_chars").cast("string"), F.lit(" |\nmore"))
    rows = t(spark, d, "documents").select("doc_id", F.explode(text.table_rows(body)).alias("r"))
    return rows.select("doc_id", F.regexp_replace(F.col("r")["ticker"], r"^\**", "").alias("ticker"), fn.parse_price(F.col("r")["price"]).alias("price"))


@register("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def h25_h26_json_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Fenced and bare JSON found in a text and parsed with a schema."""
    e = t(spark, d, "events")
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("so\n```json\n"), F.col("props"), F.lit("\n```\n"))).otherwise(F.concat(F.lit("ANSWER: "), F.col("props"), F.lit(" done }")))
    block = F.coalesce(text.fenced_json(said), text.braced_json(said))
    return e.select("event_id", F.from_json(block, "k long")["k"].alias("k"))


@register("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'insufficient_data' WHEN s_suppkey % 3 = 1 THEN 'verified' ELSE 'pending' END AS status FROM supplier""")
def j4_status_machine(spark: SparkSession, d: str) -> DataFrame:
    """Pending until a week and five bars; given up after thirty days."""
    age = F.when(F.col("s_suppkey") % 3 == 0, 31).when(F.col("s_suppkey") % 3 == 1, 8).otherwise(6)
    days = F.when(F.col("s_suppkey") % 3 == 0, 2).otherwise(5)
    return t(spark, d, "supplier").select("s_suppkey", memory_status(age, days).alias("status"))


def memory_status(age_days, evaluated_days):
    return F.when((age_days >= 7) & (evaluated_days >= 5), "verified").when(age_days > 30, "insufficient_data").otherwise("pending")


@register("""WITH o AS (SELECT c_custkey AS k, c_mktsegment AS label, c_acctbal AS v, c_custkey % 4 = 0 AS curated FROM customer), n AS (SELECT c_custkey AS k, 'new' AS label, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 END AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT o.k, CASE WHEN n.k IS NOT NULL AND NOT curated THEN n.label ELSE o.label END AS label, coalesce(n.v, o.v) AS v FROM o LEFT JOIN n ON o.k = n.k""")
def a15_precedence_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 4 == 0).alias("curated"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("label"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).alias("v"), F.lit(False).alias("curated"))
    return sinks.precedence_upsert(old, new, ["k"], ["label"], F.col("o_curated"), ["v"]).select("k", "label", "v")


@register("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, c_mktsegment) AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def a16_a17_update_from(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("label"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label"))
    return sinks.update_from(o, c, ["k"], ["label"], only_missing=True).select("o_orderkey", "label")


@register("SELECT p_partkey, p_size = 7 AS active FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part)")
def a18_a19_delete_and_activate(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").alias("version"))
    least = p.agg(F.min("p_brand").alias("p_brand"))
    return sinks.activate(sinks.delete_keys(p, least, ["p_brand"]), 7).select("p_partkey", "active")


@register("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, w.name AS name FROM orders, (VALUES ('1997', DATE '1997-01-01', DATE '1997-12-31'), ('1997Q4', DATE '1997-10-01', DATE '1997-12-31'), ('2000', DATE '2000-01-01', DATE '2000-12-31')) w(name, a, b) WHERE CAST(o_orderdate AS DATE) BETWEEN a AND b""")
def h13_stress_windows(spark: SparkSession, d: str) -> DataFrame:
    """Named, overlapping date ranges: each row gets every window it lies in."""
    windows = [("1997", "1997-01-01", "1997-12-31"), ("1997Q4", "1997-10-01", "1997-12-31"), ("2000", "2000-01-01", "2000-12-31")]
    date = F.to_date("o_orderdate")
    names = F.array_compact(F.array(*(F.when(date.between(a, b), name) for name, a, b in windows)))
    return t(spark, d, "orders").select("o_orderkey", date.alias("date"), F.explode(names).alias("name"))


@register("""SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1.15 WHEN '2-HIGH' THEN 1.05 WHEN '4-NOT SPECIFIED' THEN 0.85 WHEN '5-LOW' THEN 0.7 ELSE 1.0 END AS DOUBLE) AS mult, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'risk_on' WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') THEN 'risk_off' ELSE 'unknown' END AS segment FROM orders""")
def h6_h12_multipliers(spark: SparkSession, d: str) -> DataFrame:
    label = fn.lookup(F.col("o_orderpriority"), {"1-URGENT": "strong_bull", "2-HIGH": "bull", "3-MEDIUM": "neutral", "4-NOT SPECIFIED": "correction", "5-LOW": "bear"}, None)
    return t(spark, d, "orders").select("o_orderkey", fn.regime_multiplier(label).alias("mult"), fn.regime_segment(label).alias("segment"))


@register("SELECT p_brand, arg_max(p_partkey, row(CASE WHEN p_size > 40 THEN 1.0 WHEN p_size > 25 THEN 0.6 WHEN p_size > 10 THEN 0.3 ELSE 0.0 END, -p_partkey)) AS card FROM part GROUP BY p_brand")
def f7_h36_best_card(spark: SparkSession, d: str) -> DataFrame:
    score = fn.ladder(F.col("p_size"), [(40, 1.0), (25, 0.6), (10, 0.3)], 0.0, strict=True)
    return t(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(score, -F.col("p_partkey"))).alias("card"))


@register("SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, isodow(o_orderdate) < 6 AS weekday, count(*) AS n FROM orders GROUP BY ALL")
def h19_b21_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t(spark, d, "orders").groupBy(F.date_format(day, "yyyy-MM-dd").alias("day"), (F.weekday(day) < 5).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@register(f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED}")
def j_stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Closed windows only: those that end before the watermark."""
    rows = ev.finished(ev.tumbling(ev.event_stream(spark, f"{d}/events.parquet")))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(f"""WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, event_type FROM events, (VALUES (0), (1)) o(k))
SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL HAVING start + INTERVAL 2 HOUR <= {_CLOSED}""")
def j_stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.finished(ev.sliding(ev.event_stream(spark, f"{d}/events.parquet")))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= {_CLOSED}""")
def j_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.finished(ev.sessions(ev.event_stream(spark, f"{d}/events.parquet")))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def j_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.finished(ev.deduplicated(ev.event_stream(spark, f"{d}/events.parquet")).select("event_id", "event_type"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


