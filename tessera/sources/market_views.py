"""Domain views over the star-schema tables.

The engine works on four inputs: an asset master, dated price observations, benchmark closes and comparable
sales. Here they are declared as projections of `part`, `lineitem` and `orders`, so that every filter and column
selection reaches the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.columns import quarter_end

# The order in which rows of a source were authored; the tie-break of every "keep the last row".
SOURCE_ORDER = ["observed_at", "s1", "s2", "s3"]


class Market:
    """Lazily declared inputs of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def assets(self) -> DataFrame:
        key = F.col("p_partkey")
        words = F.split("p_name", " ")
        return self.table("part").select(
            key.alias("asset_id"),
            F.concat(F.lit("#T"), key.cast("string")).alias("ticker"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            words.getItem(1).alias("model"),
            words.getItem(0).alias("color"),
            F.col("p_size").alias("size"),
            (1995 + key % 7).cast("int").alias("year"),
            F.when(key % 3 == 0, "A").when(key % 3 == 1, "N").otherwise("R").alias("hardware"),
            F.when(key % 20 == 0, "exited").when(key % 20 == 1, "buyout_pending").otherwise("trading").alias("status"),
            (F.col("p_size") * 100).cast("double").alias("share_count"),
            F.col("p_retailprice").alias("offering_price_usd"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 500).cast("int")).alias("offering_date"),
            F.when(key % 20 == 0, F.lit("2000-06-30").cast("date")).alias("exit_date"),
            F.when(key % 40 == 0, F.col("p_retailprice") * 1.25).alias("exit_price_per_share"),
        )

    @property
    def observations(self) -> DataFrame:
        price = F.col("p_retailprice") * (1 + F.col("l_discount") - F.col("l_tax"))
        observed = F.col("l_shipdate").cast("date")
        event = (
            F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") < 5), "offering_price")
            .when((F.col("l_linenumber") == 6) & (F.col("l_quantity") > 45), "distribution")
            .when(F.col("l_returnflag") == "A", "executed_trade")
            .when(F.col("l_returnflag") == "N", "daily_close")
            .otherwise("chart_observation")
        )
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("p_partkey") == F.col("l_partkey"))
            .select(
                F.col("l_partkey").alias("asset_id"),
                F.col("p_type").alias("category"),
                observed.alias("observed_at"),
                quarter_end(observed).alias("period_end"),
                price.alias("price_per_share"),
                F.when(F.col("l_linenumber") != 7, price * F.col("p_size") * 100).alias("market_cap"),
                event.alias("event_type"),
                F.when(F.col("l_linestatus") == "F", "exact").otherwise("rounded").alias("precision_status"),
                F.col("l_quantity").alias("volume"),
                (price * (1 - F.col("l_tax") / 10)).alias("bid"),
                (price * (1 + F.col("l_discount") / 10)).alias("ask"),
                F.col("l_orderkey").alias("s1"),
                F.col("l_linenumber").alias("s2"),
                F.col("l_suppkey").alias("s3"),
            )
        )

    @property
    def benchmarks(self) -> DataFrame:
        return (
            self.table("orders")
            .groupBy(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.avg("o_totalprice").alias("adjusted_close"))
        )

    @property
    def comps(self) -> DataFrame:
        words = F.split("p_name", " ")
        price = F.col("p_retailprice") * F.col("p_size") * 100 * (1 + F.col("l_discount") - F.col("l_tax"))
        sold = F.col("l_shipdate").cast("date")
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("p_partkey") == F.col("l_partkey"))
            .select(
                F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.date_format(sold, "yyyyMMdd"))
                .alias("comp_id"),
                F.col("l_partkey").alias("asset_id"),
                F.col("p_type").alias("category"),
                sold.alias("sale_date"),
                F.col("p_brand").alias("brand"),
                words.getItem(1).alias("model"),
                words.getItem(0).alias("color"),
                F.col("p_size").alias("size"),
                F.col("p_type").alias("material"),
                F.col("l_returnflag").alias("hardware"),
                F.year(sold).alias("year"),
                price.alias("realized_price_usd"),
                (F.col("p_retailprice") * F.col("p_size") * 80).alias("estimate_low_usd"),
                (F.col("p_retailprice") * F.col("p_size") * 120).alias("estimate_high_usd"),
                (1 - F.col("l_discount")).alias("exactness_score"),
                (1 - F.col("l_tax")).alias("source_confidence"),
                F.when(F.col("l_linestatus") == "F", "excellent").otherwise("good").alias("condition"),
            )
        )

    @property
    def exits(self) -> DataFrame:
        """Authored exit rows: settled, pending settlement, and cancelled offers; some assets have two."""
        key = F.col("asset_id")
        pending = key % 60 == 0
        left = self.assets.filter(F.col("status").isin("exited", "buyout_pending"))
        first = left.select(
            "asset_id", F.concat(F.lit("Series "), "ticker").alias("series_name"),
            F.when(F.col("status") == "exited", "sale").otherwise("buyout_offer").alias("type"),
            F.when(F.col("status") == "buyout_pending", "cancelled_exit")
            .when(pending, "pending_settlement").otherwise("settled").alias("status"),
            F.coalesce("exit_date", F.lit("2001-03-31").cast("date")).alias("sale_date"),
            F.when(pending, F.date_add(F.col("exit_date"), 45)).alias("settlement_date"),
            "exit_price_per_share",
            F.when(key % 100 == 20, F.col("offering_price_usd") * F.col("share_count") * 1.1).alias("exit_total_value"),
            F.lit(None).cast("string").alias("is_confirmed"),
        )
        later = left.filter((key % 80 == 0) | (key % 120 == 1)).select(
            "asset_id", F.concat(F.lit("Series "), "ticker").alias("series_name"),
            F.when(key % 80 == 0, "auction_sale").otherwise("Redemption").alias("type"), F.when(key % 160 == 0, "pending_settlement").otherwise("settled").alias("status"),
            F.date_add(F.coalesce("exit_date", F.lit("2001-03-31").cast("date")), 100).alias("sale_date"), F.lit(None).cast("date").alias("settlement_date"),
            (F.col("offering_price_usd") * 1.4).alias("exit_price_per_share"), F.lit(None).cast("double").alias("exit_total_value"),
            F.when(key % 240 == 0, "no").alias("is_confirmed"),
        )
        day = F.col("sale_date")
        return first.unionByName(later).select(
            "*", F.when(key % 3 == 0, F.date_sub(day, 40)).alias("announcement_date"), F.when(key % 4 == 0, F.date_sub(day, 10)).alias("last_trading_date"),
            F.when(key % 5 == 0, F.date_sub(day, 5)).alias("valuation_date"), F.concat(F.lit("notice/"), key.cast("string")).alias("source_url"))


MARKET_SQL = {
    "assets": """
        SELECT p_partkey AS asset_id, '#T' || p_partkey AS ticker, p_name AS name, p_type AS category, p_brand AS brand,
               split_part(p_name, ' ', 2) AS model, split_part(p_name, ' ', 1) AS color, p_size AS size,
               CAST(1995 + p_partkey % 7 AS INT) AS year,
               CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS hardware,
               CASE p_partkey % 20 WHEN 0 THEN 'exited' WHEN 1 THEN 'buyout_pending' ELSE 'trading' END AS status,
               CAST(p_size * 100 AS DOUBLE) AS share_count, p_retailprice AS offering_price_usd,
               DATE '1995-01-01' + CAST(p_partkey % 500 AS INT) AS offering_date,
               CASE WHEN p_partkey % 20 = 0 THEN DATE '2000-06-30' END AS exit_date,
               CASE WHEN p_partkey % 40 = 0 THEN p_retailprice * 1.25 END AS exit_price_per_share
        FROM part""",
    "observations": """
        SELECT l_partkey AS asset_id, p_type AS category, CAST(l_shipdate AS DATE) AS observed_at,
               last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS period_end,
               p_retailprice * (1 + l_discount - l_tax) AS price_per_share,
               CASE WHEN l_linenumber <> 7
                    THEN p_retailprice * (1 + l_discount - l_tax) * p_size * 100 END AS market_cap,
               CASE WHEN l_linenumber = 1 AND l_quantity < 5 THEN 'offering_price'
                    WHEN l_linenumber = 6 AND l_quantity > 45 THEN 'distribution'
                    WHEN l_returnflag = 'A' THEN 'executed_trade' WHEN l_returnflag = 'N' THEN 'daily_close'
                    ELSE 'chart_observation' END AS event_type,
               CASE l_linestatus WHEN 'F' THEN 'exact' ELSE 'rounded' END AS precision_status,
               l_quantity AS volume,
               p_retailprice * (1 + l_discount - l_tax) * (1 - l_tax / 10) AS bid,
               p_retailprice * (1 + l_discount - l_tax) * (1 + l_discount / 10) AS ask,
               l_orderkey AS s1, l_linenumber AS s2, l_suppkey AS s3
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "benchmarks": """
        SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS adjusted_close
        FROM orders GROUP BY ALL""",
    "comps": """
        SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber || '-' || l_suppkey || '-'
                 || strftime(l_shipdate, '%Y%m%d') AS comp_id,
               l_partkey AS asset_id, p_type AS category, CAST(l_shipdate AS DATE) AS sale_date, p_brand AS brand,
               split_part(p_name, ' ', 2) AS model, split_part(p_name, ' ', 1) AS color, p_size AS size,
               p_type AS material, l_returnflag AS hardware, CAST(year(l_shipdate) AS INT) AS year,
               p_retailprice * p_size * 100 * (1 + l_discount - l_tax) AS realized_price_usd,
               p_retailprice * p_size * 80 AS estimate_low_usd, p_retailprice * p_size * 120 AS estimate_high_usd,
               1 - l_discount AS exactness_score, 1 - l_tax AS source_confidence,
               CASE l_linestatus WHEN 'F' THEN 'excellent' ELSE 'good' END AS condition
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "exits": """
        WITH f AS (
          SELECT asset_id, 'Series ' || ticker AS series_name, CASE status WHEN 'exited' THEN 'sale' ELSE 'buyout_offer' END AS type,
                 CASE WHEN status = 'buyout_pending' THEN 'cancelled_exit'
                      WHEN asset_id % 60 = 0 THEN 'pending_settlement' ELSE 'settled' END AS status,
                 coalesce(exit_date, DATE '2001-03-31') AS sale_date,
                 CASE WHEN asset_id % 60 = 0 THEN exit_date + 45 END AS settlement_date, exit_price_per_share,
                 CASE WHEN asset_id % 100 = 20 THEN offering_price_usd * share_count * 1.1 END AS exit_total_value, NULL::VARCHAR AS is_confirmed
          FROM assets WHERE status IN ('exited', 'buyout_pending')
          UNION ALL
          SELECT asset_id, 'Series ' || ticker, CASE WHEN asset_id % 80 = 0 THEN 'auction_sale' ELSE 'Redemption' END, CASE WHEN asset_id % 160 = 0 THEN 'pending_settlement' ELSE 'settled' END,
                 coalesce(exit_date, DATE '2001-03-31') + 100, NULL, offering_price_usd * 1.4, NULL, CASE WHEN asset_id % 240 = 0 THEN 'no' END
          FROM assets WHERE status IN ('exited', 'buyout_pending') AND (asset_id % 80 = 0 OR asset_id % 120 = 1))
        SELECT *, CASE WHEN asset_id % 3 = 0 THEN sale_date - 40 END AS announcement_date, CASE WHEN asset_id % 4 = 0 THEN sale_date - 10 END AS last_trading_date,
               CASE WHEN asset_id % 5 = 0 THEN sale_date - 5 END AS valuation_date, 'notice/' || asset_id AS source_url FROM f""",
}
