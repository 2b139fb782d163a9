"""Routines (R1-R4): SQL scalar functions, SQL table functions, stored
scripts and Python (pandas) scalar functions.

SQL functions are created with Spark's ``CREATE TEMPORARY FUNCTION ...
RETURN``; the analyzer inlines their bodies, so they run JVM-side inside
whole-stage codegen like any built-in expression.  Python functions are
Arrow-batched pandas UDFs (one call per batch, never per row).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUTINE_TYPES = ("SCALAR_FUNCTION", "TABLE_VALUED_FUNCTION", "PROCEDURE")
LANGUAGES = ("SQL", "PYTHON")
DETERMINISM = ("DETERMINISTIC", "NOT_DETERMINISTIC")

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class RoutineError(ValueError):
    pass


def _ident(name: str) -> str:
    if not _IDENT.match(name):
        raise RoutineError(f"invalid routine or argument name {name!r}")
    return name


def _args(arguments: list[tuple[str, str]]) -> str:
    return ", ".join(f"{_ident(n)} {t}" for n, t in arguments)


def create_sql_function(spark: SparkSession, name: str, arguments: list[tuple[str, str]],
                        return_type: str, body: str) -> None:
    """A scalar SQL function with typed arguments and return type."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_ident(name)}({_args(arguments)}) "
              f"RETURNS {return_type} RETURN {body}")


def create_table_function(spark: SparkSession, name: str, arguments: list[tuple[str, str]],
                          columns: list[tuple[str, str]], query: str) -> None:
    """R2: a table-valued SQL function; call it as ``SELECT * FROM name(...)``."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_ident(name)}({_args(arguments)}) "
              f"RETURNS TABLE ({_args(columns)}) RETURN {query}")


@dataclass
class Procedure:
    """A named SQL script (``BEGIN ... END``).  Spark runs SQL scripts
    but has no CREATE PROCEDURE, so the name lives here; ``call`` binds
    arguments as named parameters and returns the last statement's rows."""
    name: str
    script: str

    def __post_init__(self):
        _ident(self.name)
        s = self.script.strip()
        if not (s.upper().startswith("BEGIN") and s.upper().rstrip(";").endswith("END")):
            raise RoutineError("a procedure body must be a BEGIN ... END script")

    def call(self, spark: SparkSession, **args) -> DataFrame:
        return spark.sql(self.script, args=args or None)


def python_function(fn: Callable, return_type: str,
                    determinism: str = "DETERMINISTIC") -> Callable[..., Column]:
    """A vectorized scalar function (pandas Series in, Series out).

    ``NOT_DETERMINISTIC`` marks it so the optimizer neither reorders nor
    deduplicates its calls."""
    if determinism not in DETERMINISM:
        raise RoutineError(f"determinism must be one of {DETERMINISM}")
    udf = F.pandas_udf(fn, return_type)
    if determinism == "NOT_DETERMINISTIC":
        udf = udf.asNondeterministic()
    return udf


def register_python_function(spark: SparkSession, name: str, fn: Callable, return_type: str,
                             determinism: str = "DETERMINISTIC"):
    """R4, callable from SQL as well."""
    udf = python_function(fn, return_type, determinism)
    spark.udf.register(_ident(name), udf)
    return udf
