"""Registered queries: each module holds ``Q`` (Spark) and ``SQL`` (the same in SQL)."""
from importlib import import_module

MODULES = ["panel_queries", "gap_queries", "feature_queries", "forecast_queries", "scoring_queries", "recurrence_queries",
           "weather_queries", "association_queries", "latent_queries", "model_queries", "sink_queries"]


def registry():
    queries, texts = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries.update(module.Q)
        texts.update(module.SQL)
    return queries, texts
