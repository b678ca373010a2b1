"""Loading the logical inputs from storage.

Nothing is opened before an operator asks for it: each input is a catalog name, a path
or a function, and becomes a DataFrame at its first use.  Files are read with declared
schemas, so opening one runs no job; Catalyst pushes the operators' filters and column
pruning into the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from idlecost.sources.layout import Layout, layout_of
from idlecost.sources.schemas import OPTIONAL, SCHEMAS, declared, require_columns


class Inputs:
    """The logical inputs of an analysis run, each opened and checked when first used.

    ``sources`` maps a logical name (the keys of ``SCHEMAS`` and ``OPTIONAL``) to a
    DataFrame or to a function that opens one.  An analysis needs only the inputs that
    it reads; a missing one is reported when it is asked for.  ``id_type`` is the type of
    cluster ids (default: that of ``endpoints``, which is then opened); ``layout`` tells how the
    statements are bucketed, if they are.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, DataFrame | Callable[[], DataFrame]], id_type: str | None = None,
                 layout: Callable[[], Layout | None] | None = None):
        unknown = [n for n in sources if n not in SCHEMAS and n not in OPTIONAL]
        if unknown:
            raise ValueError(f"unknown input(s) {unknown}; known are {[*SCHEMAS, *OPTIONAL]}")
        self.spark = spark
        self._sources = dict(sources)
        self._id_type = id_type
        self.opened: dict[str, DataFrame] = {}
        self._layout = layout

    @cached_property
    def layout(self) -> Layout | None:
        return self._layout() if self._layout else None

    def __contains__(self, name: str) -> bool:
        return name in self._sources

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            if name not in self._sources:
                raise ValueError(f"this analysis reads {name!r}; no location for it was given")
            source = self._sources[name]
            self.opened[name] = require_columns(source() if callable(source) else source, name)
        return self.opened[name]

    @property
    def id_type(self) -> str:
        return self._id_type or self.endpoints.schema["cluster_id"].dataType.simpleString()

    statements = property(lambda self: self.table("statements"))
    endpoints = property(lambda self: self.table("endpoints"))
    cluster_events = property(lambda self: self.table("cluster_events"))
    workspaces = property(lambda self: self.table("workspaces"))
    workloads = property(lambda self: self.table("workloads"))
    billing = property(lambda self: self.table("billing"))
    #: Optional price tables (None: the price book of the code).
    vm_prices = property(lambda self: self.table("vm_prices") if "vm_prices" in self else None)
    dbu_prices = property(lambda self: self.table("dbu_prices") if "dbu_prices" in self else None)


def read_table(spark: SparkSession, name_or_path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A catalog table name, or a path in ``fmt`` (anything containing '/').

    With ``schema`` a path is opened without reading a file; a catalog table has its own.
    """
    if "/" not in name_or_path:
        return spark.read.table(name_or_path)
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(name_or_path)


def load_inputs(spark: SparkSession, locations: dict[str, str], fmt: str = "parquet", id_type: str = "bigint",
                schemas: dict[str, T.StructType | None] | None = None) -> Inputs:
    """Inputs from a catalog name or path each: ``{'statements': 'db.stmts', ...}``.

    Only the inputs that the analysis reads need a location.  Files are read with the
    declared schemas of ``sources.schemas`` (ids of ``id_type``); ``schemas`` replaces
    single ones, where a file's types differ, and None there infers from the files.  A
    statement table of ``sources.layout`` is attributed bucket by bucket.
    """
    schemas = schemas or {}

    def opener(name: str) -> Callable[[], DataFrame]:
        return lambda: read_table(spark, locations[name], fmt, schemas[name] if name in schemas else declared(name, id_type))

    catalog = "/" not in locations.get("endpoints", "/")
    log = locations.get("statements", "/")
    return Inputs(spark, {name: opener(name) for name in locations}, None if catalog or "endpoints" in schemas else id_type,
                  None if "/" in log else lambda: layout_of(spark, log))


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small literal table as a ``LocalRelation``.

    Built from pandas (Arrow), so the optimizer knows its exact size: joins
    against it are planned as broadcasts from statistics, unlike an RDD-backed
    ``createDataFrame(list)`` whose size is unknown.  Only for data whose size is
    fixed by code or by a parameter (price book, a top-k list).
    """
    pdf = pd.DataFrame.from_records(rows, columns=schema.fieldNames())
    for f in schema.fields:
        if isinstance(f.dataType, T.StringType):
            pdf[f.name] = pdf[f.name].astype(object)
    return spark.createDataFrame(pdf, schema)
