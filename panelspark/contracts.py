"""Feature contracts: exact schemas, ordered allowlists, forbidden features and audit gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class ContractError(ValueError):
    pass


def assert_columns(df: DataFrame, expected: list[str], exact: bool = True) -> DataFrame:
    """Exact ordered columns, or a required subset."""
    missing = [c for c in expected if c not in df.columns]
    if missing or (exact and df.columns != list(expected)):
        raise ContractError(f"unexpected schema: missing {missing}, have {df.columns}, expected {list(expected)}")
    return df


@dataclass(frozen=True)
class Contract:
    version: str
    target: str
    predictors: tuple[str, ...]
    labels: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()
    forbidden: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        guard(self.predictors, {self.target, *self.labels, *self.metadata, *self.forbidden})
        if len(set(self.predictors)) != len(self.predictors):
            raise ContractError("predictors repeat")

    def features(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Ordered predictors, after the kept key columns."""
        return df.select(*(keep or []), *self.predictors)

    def split(self, df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(predictors, labels, metadata), each with the keys."""
        parts = (self.predictors, (self.target, *self.labels), self.metadata)
        return tuple(df.select(*dict.fromkeys([*keys, *part])) for part in parts)


def guard(features, forbidden) -> None:
    """Refuse a feature set that holds an outcome, label or metadata column."""
    leaked = sorted(set(features) & set(forbidden))
    if leaked:
        raise ContractError(f"forbidden features: {leaked}")


def gate(audit: DataFrame, version: str, checksum: str) -> None:
    """Refuse to train unless the one-row audit (status, version, checksum) passes and matches."""
    row = audit.select("status", "version", "checksum").first()
    if row is None or row["status"] != "PASS" or row["version"] != version or row["checksum"] != checksum:
        raise ContractError(f"audit does not allow training: {row}")

