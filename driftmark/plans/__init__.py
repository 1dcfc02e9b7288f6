"""All registered queries, one module per family."""

import importlib

from .registry import QUERIES, SQL

FAMILIES = ["scans", "text", "styles", "models", "evaluation", "learned"]
for _name in FAMILIES:
    importlib.import_module(f"{__name__}.{_name}")
