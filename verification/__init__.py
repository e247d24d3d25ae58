"""Queries over the driver tables, each with the SQL that checks it."""

import importlib

MODULES = ("preprocessing", "splitting", "modelling", "trust", "records", "kinds", "choice", "wide")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"verification.{name}")
