"""Query builders, one module per family; each registers itself on import."""

from importlib import import_module

MODULES = ("text", "threads", "metrics", "decisions", "retrieval", "relational", "models")


def load() -> None:
    for name in MODULES:
        import_module(f"parlance.plans.{name}")
