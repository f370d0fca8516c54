"""What describes a table and a run: column specs and options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

KINDS = ("numeric", "categorical", "boolean", "datetime", "text", "identifier", "constant", "empty")
ROLES = ("feature", "profile", "ignore")
TRANSFORMS = ("auto", "standard", "robust", "log", "quantile", "minmax")
ALGORITHMS = ("kmeans", "ward")
#: Kinds whose values are doubles; the others that are kept are strings.
DOUBLE_KINDS = ("numeric", "boolean", "datetime")
USABLE_KINDS = (*DOUBLE_KINDS, "categorical")
MAX_FEATURE_LEVELS = 50


def default_role(kind: str, distinct: int) -> str:
    if kind in DOUBLE_KINDS:
        return "feature"
    if kind == "categorical":
        return "feature" if distinct <= MAX_FEATURE_LEVELS else "profile"
    return "ignore"


@dataclass(frozen=True)
class ColumnSpec:
    index: int
    name: str
    kind: str
    inferred_kind: str
    role: str
    transform: str = "auto"
    weight: float = 1.0
    fill_rate: float = 1.0
    distinct_count: int = 0
    note: str = ""
    sample_values: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for value, allowed in ((self.kind, KINDS), (self.role, ROLES), (self.transform, TRANSFORMS)):
            if value not in allowed:
                raise ValueError(f"{self.name}: {value!r} is none of {', '.join(allowed)}")
        if not 0 <= self.weight <= 20:
            raise ValueError(f"{self.name}: a weight is within 0 and 20")

    def with_kind(self, kind: str) -> ColumnSpec:
        """Another kind, and the role that goes with it."""
        if kind not in USABLE_KINDS:
            return replace(self, kind=kind, role="ignore")
        return replace(self, kind=kind, role="feature" if self.role == "ignore" else self.role)

    def replace(self, **changes) -> ColumnSpec:
        return replace(self, **changes)


def all_features(specs: list[ColumnSpec]) -> list[ColumnSpec]:
    """Every usable column a feature."""
    return [s.replace(role="feature") if s.kind in USABLE_KINDS else s for s in specs]


def no_features(specs: list[ColumnSpec]) -> list[ColumnSpec]:
    return [s.replace(role="ignore") if s.role == "feature" else s for s in specs]


@dataclass(frozen=True)
class RunOptions:
    k: int | None = None
    k_min: int = 2
    k_max: int = 10
    algorithm: str = "kmeans"
    seed: int = 42
    auto_k_sample: int = 15_000
    pca_threshold: int = 60
    pca_components: int = 50
    #: Encoded values are always held within -6 and 6; the option is kept for callers that set it.
    winsorize: bool = True
    max_rows: int = 0

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm {self.algorithm!r} is none of {', '.join(ALGORITHMS)}")
        for name in ("k", "k_min", "k_max"):
            value = getattr(self, name)
            if value is not None and not 2 <= value <= 30:
                raise ValueError(f"{name} is within 2 and 30")
        if self.pca_threshold < 4 or self.max_rows < 0:
            raise ValueError("pca_threshold is 4 at least, max_rows 0 at least")

    def replace(self, **changes) -> RunOptions:
        return replace(self, **changes)
