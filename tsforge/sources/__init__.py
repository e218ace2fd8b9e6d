from tsforge.sources.tables import read_table, clean_scan
from tsforge.sources.series import (
    observations, event_observations, hourly_all, hourly_by_type, daily_orders,
    daily_lineitem, load_series, weather_series, WEATHER_COLUMNS,
)

__all__ = [
    "read_table", "clean_scan", "observations", "event_observations", "hourly_all",
    "hourly_by_type", "daily_orders", "daily_lineitem", "load_series", "weather_series",
    "WEATHER_COLUMNS",
]
