"""Node ids: XXH64 (seed 0) over graph type, repository, kind and qualified name."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAPH_TYPE = "code"


def repo_id(name: str) -> int:
    h = xxhash.xxh64_intdigest(name.encode())
    return h - (1 << 64) if h >> 63 else h


def node_id(repo: int, kind: int, qname: str, graph_type: str = GRAPH_TYPE) -> int:
    """Signed 64-bit id; parts are little-endian and set apart by 0xFF."""
    u = repo & ((1 << 64) - 1)
    h = xxhash.xxh64_intdigest(b"\xff".join((graph_type.encode(), u.to_bytes(8, "little"), kind.to_bytes(4, "little"), qname.encode("utf-8", "surrogatepass"))))
    return h - (1 << 64) if h >> 63 else h


def node_ids(repo: Column, kind: Column, qname: Column) -> Column:
    @F.pandas_udf("long")
    def make(r: pd.Series, k: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([node_id(int(a), int(b), c) for a, b, c in zip(r, k, q, strict=True)])

    return make(repo, kind, qname)


def unsigned(column: Column) -> Column:
    """An id as the unsigned number that other tools print."""
    wide = column.cast("decimal(20,0)")
    return F.when(column < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def hex_hash(text: Column) -> Column:
    """XXH64 (seed 0) of a text in 16 lower-case hex digits (null: null)."""

    @F.pandas_udf("string")
    def make(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else f"{xxhash.xxh64_intdigest(x.encode('utf-8', 'surrogatepass')):016x}")

    return make(text)
