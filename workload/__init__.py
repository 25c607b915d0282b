"""The registered queries: Spark callables over the given tables and their SQL twins."""
import sys
from importlib import import_module

from pyspark import cloudpickle

from .registry import ORACLES, QUERIES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECTIONS = ("q_catalogue", "q_dashboard", "q_scalars", "q_entity", "q_tables", "q_io", "q_classify")
for _section in SECTIONS:
    import_module(f"{__name__}.{_section}")

__all__ = ["ORACLES", "QUERIES"]
