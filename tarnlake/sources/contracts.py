"""Table contracts from YAML, the schemas they declare, and the classes of schema drift."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as t

_SIMPLE = {"string": t.StringType(), "int": t.IntegerType(), "bigint": t.LongType(), "double": t.DoubleType(), "boolean": t.BooleanType(), "date": t.DateType(), "timestamp": t.TimestampType()}
STRATEGIES = ("append_only", "upsert", "full_snapshot_overwrite")


def spark_type(name: str) -> t.DataType:
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", name.strip()):
        return t.DecimalType(int(m[1]), int(m[2]))
    return _SIMPLE[name.strip()]


@dataclass
class Contract:
    """What a source promises; ``renames`` maps names as they come to the contract's names."""

    table: str
    path: str
    columns: dict[str, str]
    natural_key: list[str]
    file_format: str = "csv"
    watermark: str | None = None
    strategy: str = "append_only"
    partition: str = "dt"
    allow_additive: bool = True
    retention_days: int | None = None
    freshness_days: int | None = None
    renames: dict[str, str] = field(default_factory=dict)

    def schema(self) -> t.StructType:
        return t.StructType([t.StructField(c, spark_type(k)) for c, k in self.columns.items()])


@dataclass
class Drift:
    """kind: none, additive, type or breaking. ``added``/``missing`` are what is left once renames are resolved."""

    kind: str
    added: list[str]
    missing: list[str]
    renamed: dict[str, str]
    retyped: list[str] = field(default_factory=list)


def load_contracts(text: str) -> dict[str, Contract]:
    import yaml

    out = {}
    for name, c in (yaml.safe_load(text) or {}).get("tables", {}).items():
        if c.get("strategy", "append_only") not in STRATEGIES:
            raise ValueError(f"{name}: unknown strategy {c['strategy']}")
        out[name] = Contract(name, **c)
    return out


def classify(contract: Contract, actual: list[str], types: dict[str, str] | None = None) -> Drift:
    """Compare names (and inferred types, where given) with the contract, documented renames first."""
    have = set(actual)
    renamed = {old: new for old, new in contract.renames.items() if old in have and new not in have and new in contract.columns}
    seen = {renamed.get(c, c) for c in actual}
    added, missing = sorted(seen - contract.columns.keys()), sorted(contract.columns.keys() - seen)
    retyped = sorted(c for c, k in (types or {}).items() if contract.columns.get(renamed.get(c, c), k) != k)
    kind = "breaking" if missing or (added and not contract.allow_additive) else "additive" if added else "type" if retyped else "none"
    return Drift(kind, added, missing, renamed, retyped)
