"""Customer reports: locations, counts, and recency-frequency-monetary segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.dates import whole_days
from storelens.operators.densify import densify
from storelens.functions.text import money_text
from storelens.operators.quantiles import qcut_value, rank_bin
from storelens.operators.ranking import class_rank, range_tagged
from storelens.plans.common import known_stores, order_value, store_filter, with_item_sums
from storelens.sources.tables import ShopTables

# Fixed value: number of score bins and segments.
RFM_BINS = 4


def customer_locations(t: ShopTables) -> DataFrame:
    """Q4: every customer's coordinates, sorted (nulls last)."""
    return t.customers.select("latitude", "longitude") \
        .orderBy(F.asc_nulls_last("latitude"), F.asc_nulls_last("longitude"))


def kpi_total_customers(t: ShopTables) -> DataFrame:
    """Q8: number of customers."""
    return t.customers.agg(F.count(F.lit(1)).alias("total_customers"))


def rfm_orders(t: ShopTables, year: int = 2022, mode: str = "reference") -> DataFrame:
    """Q30: orders of ``year`` at known stores that have items of known products,
    with their item value → storeid, customerid, orderid, orderdate, total_amount."""
    orders = known_stores(t, t.orders_in([year])
                          .select("storeid", "customerid", "orderid", "orderdate", "nitems"))
    joined = with_item_sums(t, orders)
    return joined.select("storeid", "customerid", "orderid", "orderdate",
                         order_value(mode).alias("total_amount"))


def customer_values(t: ShopTables, year: int = 2022, mode: str = "reference") -> DataFrame:
    """Per store and customer (null included): last order, number of orders, Σ order value (0 if all are null)."""
    return (rfm_orders(t, year, mode).groupBy("storeid", "customerid")
            .agg(F.max("orderdate").alias("last_order"), F.count("orderid").alias("frequency"),
                 F.coalesce(F.sum("total_amount"), F.lit(0)).alias("monetary")))


def rfm_scores(t: ShopTables, year: int = 2022, duplicates: str = "skip",
               mode: str = "reference", store=None) -> DataFrame:
    """Q31: recency, frequency, monetary and their scores per store and customer.

    Per store, ``current`` is one day after the store's last order (orders of
    unknown customers included). Per customer: recency = whole days from the
    last order to ``current``; frequency = orders; monetary = Σ order value.
    Scores 1…4, 1 the best: r_score bins recency by its quartiles, m_score
    bins monetary by its quartiles (reversed), f_score bins the rank of
    frequency (ties by customer id, reversed). ``rfm_score`` is the three
    digits as text; ``segment`` bins the rank of that text (ties by customer
    id), 1 the best quarter.

    Every statistic is per store, so ``store`` can filter the orders. The
    join of orders and items runs once, into the small per-customer table
    that everything else reads. That table is checkpointed in ranges of
    (store, customer), which gives the ranks of frequency and rfm_score from
    counts (few distinct values, :func:`class_rank`); recency quartiles use
    Spark's exact ``percentile`` (a day-count domain), monetary quartiles a
    sketch that brackets them and a second pass inside the brackets. No step puts
    a store in one task.
    """
    return score_values(customer_values(t if store is None else t.with_orders(store_filter(t.orders, store)), year, mode),
                        duplicates)


def score_values(values: DataFrame, duplicates: str = "skip") -> DataFrame:
    """The scores of :func:`rfm_scores` from the per-customer table of :func:`customer_values`."""
    values = range_tagged(values, [F.col("storeid"), F.col("customerid")])
    current = values.groupBy("storeid").agg((F.max("last_order") + F.expr("INTERVAL 1 DAY")).alias("current_date"))
    s = (values.where(F.col("customerid").isNotNull()).join(current, "storeid")
         .withColumn("recency", whole_days("last_order", "current_date")).drop("last_order", "current_date"))
    s = qcut_value(s, ["storeid"], "recency", "r_score", RFM_BINS, duplicates=duplicates)
    s = qcut_value(s, ["storeid"], "monetary", "m_score", RFM_BINS, reverse=True, method="bracket",
                   duplicates=duplicates)
    s = _binned_rank(s, "frequency", "f_score", reverse=True)
    s = s.withColumn("rfm_score", F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]))
    s = _binned_rank(s, "rfm_score", "segment")
    return s.select("storeid", "customerid", "recency", "frequency", "monetary",
                    "r_score", "f_score", "m_score", "rfm_score", "segment")


def _binned_rank(s: DataFrame, value: str, out: str, reverse: bool = False) -> DataFrame:
    """Quarter of the in-store rank of ``value`` (ties by customer id)."""
    ranked = class_rank(s, ["storeid"], value, "customerid", rank="_r", size="_N")
    b = rank_bin("_r", "_N", RFM_BINS)
    return ranked.withColumn(out, (F.lit(RFM_BINS + 1) - b if reverse else b).cast("int")).drop("_r", "_N")


def _segments(t: ShopTables, year: int, store, duplicates: str, mode: str) -> DataFrame:
    """Customers and mean values per store and segment, all four segments of a store; unsorted."""
    return segment_scores(rfm_scores(t, year, duplicates, mode, store))


def segment_scores(s: DataFrame) -> DataFrame:
    """Customers and mean values per store and segment from the scores; unsorted."""
    agg = s.groupBy("storeid", "segment").agg(
        F.count("customerid").alias("customer_count"), F.sum("recency").alias("_r"),
        F.sum("frequency").alias("_f"), F.sum("monetary").alias("_m"))
    filled = densify(agg, ["storeid"], "segment", F.sequence(F.lit(1), F.lit(RFM_BINS)),
                     {"customer_count": F.lit(0).cast("long")})
    n = F.col("customer_count").cast("double")
    return filled.select(
        "storeid", "segment", "customer_count",
        F.try_divide(F.col("_r").cast("double"), n).alias("avg_recency"),
        F.try_divide(F.col("_f").cast("double"), n).alias("avg_frequency"),
        F.try_divide(F.col("_m").cast("double"), n).alias("avg_monetary"))


def rfm_segments(t: ShopTables, year: int = 2022, store=None, duplicates: str = "skip",
                 mode: str = "reference") -> DataFrame:
    """Q32: per store and segment 1…4: customers and mean recency, frequency, monetary.

    All four segments of a store appear; an empty one has 0 customers and
    null means.
    """
    return _segments(t, year, store, duplicates, mode).orderBy("storeid", "segment")


def rfm_segments_nested(t: ShopTables, year: int = 2022, store=None, duplicates: str = "skip",
                        mode: str = "reference") -> DataFrame:
    """Q33: Q32 as one row per store with the array ``rfm_data`` of segment records."""
    seg = _segments(t, year, store, duplicates, mode)
    rec = F.struct("segment", "customer_count", "avg_recency", "avg_frequency", "avg_monetary")
    return seg.groupBy("storeid").agg(F.sort_array(F.collect_list(rec)).alias("rfm_data")).orderBy("storeid")


def rfm_monetary_table(t: ShopTables, year: int = 2022, store=None, duplicates: str = "skip",
                       mode: str = "reference") -> DataFrame:
    """Q34: Σ of the mean monetary value per store and segment (0 for an empty segment), with its money text."""
    seg = _segments(t, year, store, duplicates, mode)
    return (seg.groupBy("storeid", "segment")
            .agg(F.coalesce(F.sum("avg_monetary"), F.lit(0.0)).alias("avg_monetary"))
            .withColumn("monetary_label", money_text("avg_monetary"))
            .orderBy("storeid", "segment"))
