"""Imports every plan module so that its queries register."""

import importlib
import pkgutil

import stintflow.plans as plans
from stintflow.plans.registry import QUERIES, SQL

for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
    importlib.import_module(f"stintflow.plans.{module}")

__all__ = ["QUERIES", "SQL"]
