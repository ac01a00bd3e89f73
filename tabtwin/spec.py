"""Declared contracts: column groups, roles, split and generator settings.

Column kinds are taken from the declaration, never inferred from data. Every operator
is driven by these plain dataclasses, so the same job runs on any table.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnSpec:
    """Three semantic groups; each data column belongs to exactly one."""

    numeric: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("numeric", "binary", "categorical"):
            object.__setattr__(self, name, tuple(getattr(self, name) or ()))

    @property
    def continuous(self) -> list[str]:
        return list(self.numeric)

    @property
    def discrete(self) -> list[str]:
        # order of the reference's metric tables: categorical first, then binary
        return list(self.categorical) + list(self.binary)

    @property
    def all_columns(self) -> list[str]:
        return list(self.numeric) + list(self.binary) + list(self.categorical)

    def kind(self, column: str) -> str:
        return "continuous" if column in self.numeric else "discrete"

    def groups(self) -> list[tuple[str, str]]:
        """(column, group) pairs in declaration order; duplicates kept."""
        return ([(c, "numeric") for c in self.numeric] + [(c, "binary") for c in self.binary]
                + [(c, "categorical") for c in self.categorical])


@dataclass(frozen=True)
class RoleSpec:
    """Privacy roles: attacker knowledge (quasi-identifiers) and secrets."""

    quasi_identifiers: tuple[str, ...] = ()
    secrets: tuple[str, ...] = ()
    regression_secrets: tuple[str, ...] = ()
    target: str | None = None
    key: str = "rid"


@dataclass(frozen=True)
class SplitSpec:
    train_size: float = 0.8
    test_size: float = 0.2
    val_size: float | None = None
    stratify_col: str = "target"
    tolerance: float = 0.005

    def __post_init__(self):
        total = self.train_size + self.test_size + (self.val_size or 0.0)
        if not (0 < self.train_size < 1 and 0 < self.test_size < 1):
            raise ValueError("train_size and test_size must be in (0, 1)")
        if abs(total - 1.0) > 1e-9:
            raise ValueError(f"split sizes must sum to 1, got {total}")


@dataclass(frozen=True)
class PlausibilityRule:
    """A named SQL predicate that marks an impossible row; skipped if a column is absent."""

    name: str
    predicate: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class DPSpec:
    """Public knowledge a DP generator may use without spending budget."""

    bounds: dict = field(default_factory=dict)      # numeric column -> (low, high)
    domains: dict = field(default_factory=dict)     # discrete column -> list of levels
    bins: int = 10
    visit_order: tuple[str, ...] = ()
    nullable: tuple[str, ...] = ()


DP_EPSILONS = (0.5, 1.0, 3.0, 8.0)
