"""User macros (F11): named Python functions from Columns to a Column.

A macro body may call other macros by name through the registry; calls are
checked for arity, and a macro that calls itself, directly or through others,
is an error instead of a stack overflow.  The result is one
ordinary Spark expression -- there is no text expansion.
"""

from __future__ import annotations

import inspect
from typing import Callable

from pyspark.sql import Column


class MacroError(ValueError):
    pass


class Macros:
    def __init__(self):
        self._defs: dict[str, Callable[..., Column]] = {}
        self._stack: list[str] = []

    def define(self, name: str, fn: Callable[..., Column]) -> "Macros":
        if name in self._defs:
            raise MacroError(f"macro {name!r} defined twice")
        self._defs[name] = fn
        return self

    def __call__(self, name: str, *args) -> Column:
        if name not in self._defs:
            raise MacroError(f"unknown macro {name!r}; defined: {sorted(self._defs)}")
        fn = self._defs[name]
        params = [p for p in inspect.signature(fn).parameters.values()
                  if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
        has_var = any(p.kind == p.VAR_POSITIONAL for p in inspect.signature(fn).parameters.values())
        required = [p for p in params if p.default is p.empty]
        if len(args) < len(required) or (not has_var and len(args) > len(params)):
            raise MacroError(f"macro {name!r} takes {len(required)}"
                             f"{'' if len(required) == len(params) else f'-{len(params)}'} "
                             f"arguments, got {len(args)}")
        if name in self._stack:
            raise MacroError(f"recursive macro call: {' -> '.join(self._stack + [name])}")
        self._stack.append(name)
        try:
            return fn(*args)
        finally:
            self._stack.pop()
