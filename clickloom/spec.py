"""Column roles of a click log: one label, some dense, some sparse columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    label: str
    dense: tuple[str, ...]
    sparse: tuple[str, ...]

    @classmethod
    def from_counts(cls, n_dense: int, n_sparse: int) -> FeatureSpec:
        """``col_0`` label, then the dense columns, then the sparse ones."""
        return cls(
            "col_0",
            tuple(f"col_{j}" for j in range(1, n_dense + 1)),
            tuple(f"col_{j}" for j in range(n_dense + 1, n_dense + n_sparse + 1)),
        )

    @classmethod
    def matrix_names(cls, n_dense: int = 13, n_sparse: int = 26) -> FeatureSpec:
        """``y``, ``X_int_0..``, ``X_cat_0..``."""
        return cls(
            "y",
            tuple(f"X_int_{j}" for j in range(n_dense)),
            tuple(f"X_cat_{j}" for j in range(n_sparse)),
        )

    @classmethod
    def dashed_names(cls, n_dense: int = 13, n_sparse: int = 26) -> FeatureSpec:
        """``clicked``, ``int-feature-1..``, ``categorical-feature-14..``."""
        return cls(
            "clicked",
            tuple(f"int-feature-{j}" for j in range(1, n_dense + 1)),
            tuple(
                f"categorical-feature-{j}"
                for j in range(n_dense + 1, n_dense + n_sparse + 1)
            ),
        )

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.label, *self.dense, *self.sparse)

    def struct(
        self,
        label: T.DataType | None = None,
        dense: T.DataType | None = None,
        sparse: T.DataType | None = None,
    ) -> T.StructType:
        """Schema of the click log; text columns unless told otherwise."""
        roles = [(self.label, label)]
        roles += [(c, dense) for c in self.dense]
        roles += [(c, sparse) for c in self.sparse]
        return T.StructType(
            [T.StructField(name, kind or T.StringType()) for name, kind in roles]
        )

    def rename_to(self, df: DataFrame, other: FeatureSpec) -> DataFrame:
        """Rename this profile's columns to another profile of the same width."""
        if (len(self.dense), len(self.sparse)) != (len(other.dense), len(other.sparse)):
            raise ValueError("the two profiles have different widths")
        return df.withColumnsRenamed(dict(zip(self.columns, other.columns)))


STANDARD = FeatureSpec.from_counts(13, 26)
WIDE = FeatureSpec.from_counts(504, 42)
