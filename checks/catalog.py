"""All registered queries."""

import importlib

from checks.registry import ORACLES, QUERIES

for module in ("q_sources", "q_events", "q_labs", "q_terms", "q_labels", "q_sequences", "q_meds", "q_pipelines", "q_blocks", "q_layout"):
    importlib.import_module(f"checks.{module}")

__all__ = ["ORACLES", "QUERIES"]
