"""Typed projection of semi-structured VARIANT records.

Null semantics follow the warehouse: ``raw:x IS NOT NULL`` is true for a
JSON ``null`` (only a missing path is SQL NULL), while the typed value of a
JSON null is SQL NULL. Records therefore land as VARIANT, never as strings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW = "raw_data"

# type-strict numeric extraction accepts only these VARIANT scalar types
_NUMERIC_VARIANT = r"^(DOUBLE|FLOAT|DECIMAL|BIGINT|INT|SMALLINT|TINYINT)"


def path(p: str) -> str:
    return p if p.startswith("$") else f"$.{p}"


def raw_path(p: str, raw: str = RAW) -> Column:
    """The VARIANT at a path (SQL NULL only when the path is missing)."""
    return F.variant_get(F.col(raw), path(p), "variant")


def extract(p: str, kind: str, raw: str = RAW, on_value: int = 1) -> Column:
    """Typed value of a path.

    kinds: int (rounded like the warehouse, not truncated), long, double,
    string, boolean, timestamp_ntz, try_double (lenient: non-numeric text →
    NULL), as_double (strict: only numeric VARIANT values), flag (``= on_value``).
    """
    v, pp = F.col(raw), path(p)
    if kind in ("int", "long"):
        return F.round(F.variant_get(v, pp, "double")).cast("int" if kind == "int" else "long")
    if kind in ("double", "string", "boolean", "timestamp_ntz"):
        return F.variant_get(v, pp, kind)
    if kind == "try_double":
        return F.try_variant_get(v, pp, "double")
    if kind == "as_double":
        t = F.schema_of_variant(F.variant_get(v, pp, "variant"))
        return F.when(t.rlike(_NUMERIC_VARIANT), F.try_variant_get(v, pp, "double"))
    if kind == "flag":
        return F.round(F.variant_get(v, pp, "double")).cast("int") == F.lit(on_value)
    raise ValueError(f"unknown kind {kind!r}")


@dataclass(frozen=True)
class Field:
    out: str
    path: str
    kind: str


@dataclass(frozen=True)
class Require:
    """Row filter evaluated on the raw record before dedupe.

    ``present``: path is not SQL NULL (a JSON null passes); ``typed``: the
    typed value is not NULL; ``nonempty``: the string value is not ''.
    """
    path: str
    present: bool = True
    typed: str | None = None
    nonempty: bool = False

    def column(self, raw: str = RAW) -> Column:
        c = F.lit(True)
        if self.present:
            c = c & raw_path(self.path, raw).isNotNull()
        if self.typed:
            c = c & extract(self.path, self.typed, raw).isNotNull()
        if self.nonempty:
            c = c & (extract(self.path, "string", raw) != F.lit(""))
        return c


@dataclass(frozen=True)
class VariantSpec:
    fields: Sequence[Field]
    require: Sequence[Require] = field(default_factory=tuple)


def project_variant(df: DataFrame, spec: VariantSpec, keep: Sequence[str] = ("loaded_at",),
                    raw: str = RAW) -> DataFrame:
    """Filter on raw paths, then project typed columns (plus ``keep``)."""
    # filters stay above the explode, so a record that is built by its reader is built once, not again for the filter
    out = df.withColumn(raw, F.explode(F.array(F.col(raw)))) if spec.require else df
    for r in spec.require:
        out = out.where(r.column(raw))
    return out.select(*[extract(f.path, f.kind, raw).alias(f.out) for f in spec.fields],
                      *[F.col(k) for k in keep])
