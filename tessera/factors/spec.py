"""Factors as layers of expressions over the panel, and the registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dialect import Sql

Layers = list[dict[str, str]]


@dataclass(frozen=True)
class Factor:
    """A factor; ``build`` gives layers of columns, the last one with ``value``. ``needs``: what it reads besides the panel, ``annual`` (fiscal-year
    statistics) or ``ff3`` (the daily three factors)."""

    name: str
    family: str
    build: Callable[..., Layers]
    params: dict = field(default_factory=dict)
    needs: str = ""

    def layers(self, e: Sql, **params) -> Layers:
        return self.build(e, **{**self.params, **params})


REGISTRY: dict[str, Factor] = {}


def factor(family: str, name: str | None = None, annual: bool = False, needs: str = "", **params):
    """Registers a function that builds a factor's layers."""

    def add(f):
        REGISTRY[name or f.__name__] = Factor(name or f.__name__, family, f, params, needs or "annual" * annual)
        return f

    return add


def simple(family: str, formulas: dict[str, str]) -> None:
    """Registers factors of one row expression each."""
    for name, text in formulas.items():
        REGISTRY[name] = Factor(name, family, lambda e, text=text: [{"value": text}])


DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def doubles(sql: str) -> str:
    """Numbers with a point as doubles: as decimals they would lose digits in divisions."""
    return DECIMAL.sub(r"\1e0", sql)


#: A value cut to five digits at a point where neat fractions do not tie, so that two engines agree.
CUT = "CAST(floor(value * 100000e0 + 0.3713e0) AS DOUBLE) / 100000e0"


def compute(panel: DataFrame, name: str, keep: tuple[str, ...] = (), **params) -> DataFrame:
    """``ts_code, pos, value`` of a factor on every row of the panel, all days at once, and the panel's columns ``keep``."""
    df = panel
    for layer in REGISTRY[name].layers(Sql(), **params):
        df = df.withColumns({k: F.expr(doubles(v)) for k, v in layer.items()})
    return df.select("ts_code", "pos", "value", *keep)


def twin(panel_sql: str, name: str, **params) -> str:
    """The same factor as DuckDB SQL over a panel query."""
    sql = panel_sql
    for layer in REGISTRY[name].layers(Sql(duck=True), **params):
        sql = f"SELECT *, {', '.join(f'{doubles(v)} AS {k}' for k, v in layer.items())} FROM ({sql})"
    return f"SELECT ts_code, pos, value FROM ({sql})"
