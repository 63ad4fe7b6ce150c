"""Deterministic uniform numbers from ids, equal in Spark and DuckDB and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """In [0, 1): 32 bits of the MD5 of the parts joined by colons. Parts are columns, or plain values such as seeds."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_sql(*parts: str) -> str:
    """The same in DuckDB SQL; parts are SQL expressions."""
    joined = "||':'||".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x'||substr(md5({joined}),1,8))::BIGINT / 4294967296.0)"


def normal(*parts) -> Column:
    """Standard normal by Box-Muller from two uniforms."""
    return F.sqrt(-2 * F.log(1 - uniform(*parts, "a"))) * F.cos(uniform(*parts, "b") * 6.283185307179586)
