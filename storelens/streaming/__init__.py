"""Streaming: materialised reports refreshed as orders arrive (the reference's
only freshness mechanism was a 300 s response cache; it has no stream
processing of its own)."""

from storelens.streaming.refresh import REFRESH_EVERY, refresh_reports, refresh_sales  # noqa: F401
from storelens.streaming.customers import CustomerFigures, refresh_customers, valued_orders  # noqa: F401
