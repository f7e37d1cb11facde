"""All registered queries."""

import importlib

MODULES = ("standins", "linkage", "serving", "history", "scalars", "merging", "quality", "streams")


def load_all() -> None:
    for name in MODULES:
        try:
            importlib.import_module(f"offerlens.registry.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"offerlens.registry.{name}":
                raise
