"""storelens — retail store analytics as lazy PySpark DataFrame functions.

Five logical tables (stores, customers, orders, orderitems, products) go in
as a :class:`~storelens.sources.tables.ShopTables` bundle; every report is a
function ``report(t, **params) -> DataFrame`` built from Spark's own
DataFrame operators, so Catalyst plans and AQE re-plans each of them.

Layout
------
``sources``    load the five tables (Parquet layout or the TPC-H style test
               tables), schema checks, report sink.
``functions``  Column-level helpers: year ranges, weekday, local hour,
               display text.
``operators``  reusable DataFrame operators: size-checked dimension joins,
               distributed in-group ranks, quantile bins, box-plot
               statistics, top-k, densify, percent change.
``plans``      the report queries, their registry and oracle SQL.
``streaming``  periodic refresh of materialised reports.
``cli``        run a report by name; ``check`` compares reports with the oracle.
"""

from storelens.sources.tables import ShopTables, read_tables  # noqa: F401

__all__ = ["ShopTables", "read_tables"]
