"""Inputs: schemas, loaders, the driver-table fixtures and the price book."""

from idlecost.sources.tables import Inputs, load_inputs, read_table

__all__ = ["Inputs", "load_inputs", "read_table"]
