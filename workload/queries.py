"""Importing this module registers all queries."""

from workload import (  # noqa: F401
    alert_queries,
    climatology_queries,
    landing_queries,
    mart_queries,
    planning_queries,
    quality_queries,
    risk_queries,
    statistics_queries,
    stream_queries,
    weather_queries,
)
