"""Column-level helpers: dates and display text."""

from storelens.functions.dates import (  # noqa: F401
    in_years, local_hour, month_key, month_name, weekday, weekday_name, whole_days, year_start)
from storelens.functions.text import fixed, millions_text, money_text, percent_text, short_money  # noqa: F401
