"""A book of queries: what a module registers by decorator."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        """Registers a function (spark, folder) -> DataFrame under its name, with the SQL that gives the same rows, if there is any."""

        def keep(function):
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return keep
