"""A snapshot: one row a record, one canonical JSON text column a field."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


@dataclass(frozen=True)
class Snapshot:
    """``df`` has ``idx`` (a unique ordinal: the record's order inside its side) and ``f0``, ``f1``, ... for ``fields``."""

    df: DataFrame
    fields: tuple[str, ...]
    #: Whether identity values may need Unicode or URL normalisation.
    normalise: bool = False
    #: Whether cells may hold objects, whose fields are compared one by one.
    nested: bool = False

    def col(self, field: str, of: str | None = None) -> Column:
        """The field's JSON text; NULL (absent) if this side has no such field."""
        if field not in self.fields:
            return F.lit(None).cast("string")
        name = f"f{self.fields.index(field)}"
        return F.col(f"{of}.{name}" if of else name)

    def identity(self, fields: Sequence[str], of: str | None = None) -> list[Column]:
        return [V.identity_value(self.col(f, of), self.normalise) for f in fields]

    def key(self, fields: Sequence[str], of: str | None = None) -> Column:
        return V.identity_key(self.identity(fields, of))

    def record(self) -> Column:
        """All fields as one struct, with the ordinal."""
        return F.struct("idx", *[f"f{i}" for i in range(len(self.fields))])

    def without(self, ignored: Sequence[str]) -> Snapshot:
        """S6."""
        keep = [f for f in self.fields if f not in ignored]
        return Snapshot(self.df.select("idx", *[self.col(f).alias(f"f{i}") for i, f in enumerate(keep)]), tuple(keep), self.normalise, self.nested)


def union_fields(*sides: Snapshot) -> list[str]:
    return sorted({f for s in sides for f in s.fields})


def from_table(df: DataFrame, order: str, fields: Sequence[str] | None = None, normalise: bool = False) -> Snapshot:
    """Table mode: columns are fields, SQL NULL is JSON null; ``order`` is a unique integral ordinal."""
    names = [c for c in (fields or df.columns) if c != order]
    kinds = dict(df.dtypes)
    cols = [V.json_of(F.col(f"`{c}`"), kinds[c].split("(")[0] in ("double", "float", "decimal")).alias(f"f{i}") for i, c in enumerate(names)]
    nested = any(kinds[c].startswith(("struct", "map", "variant")) for c in names)
    return Snapshot(settled(df.select(F.col(order).cast("long").alias("idx"), *cols)), tuple(names), normalise, nested)


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a one-element generator: later expressions then read finished columns, where the optimiser would else copy the JSON rendering into every use."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))
