"""Incrementally maintained views of one table: project and filter, with bag semantics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass
class IncrementalView:
    """A materialised SELECT columns FROM table WHERE predicate, kept up by inserted and deleted rows."""

    columns: list[Column]
    predicate: Column

    def full(self, table: DataFrame) -> DataFrame:
        return table.where(self.predicate).select(*self.columns)

    def apply(self, view: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
        """The view after a change: only the changed rows are evaluated."""
        out = view
        if deleted is not None:
            out = out.exceptAll(self.full(deleted))
        if inserted is not None:
            out = out.unionAll(self.full(inserted))
        return out
