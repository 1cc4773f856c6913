"""All registered queries."""

from importlib import import_module

from kgspark.plans.registry import ORACLES, QUERIES

MODULES = [
    "scalar_queries", "text_queries", "question_queries", "triple_queries", "ontology_queries",
    "hierarchy_queries", "graph_queries", "view_queries", "model_queries",
    "io_queries", "stream_queries",
]


def _load() -> None:
    for module in MODULES:
        import_module(f"kgspark.plans.{module}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
