"""Engine-neutral seeded uniforms.

``rand()`` depends on partitioning; a hash of (seed, key) does not, so sampling
is reproducible under repartitioning, task retry and lost executors, and the
same numbers can be computed by an SQL oracle (md5 is standard in both engines).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def hash_uniform(seed: str, key: Column | str) -> Column:
    """Uniform in [0, 1) from the first 32 bits of md5(seed|key)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(_TWO_32)


def hash_uniform_sql(seed: str, key_sql: str) -> str:
    """DuckDB text of :func:`hash_uniform` for oracles."""
    return (f"(('0x' || substr(md5(concat('{seed}|', cast({key_sql} as varchar))), 1, 8))::BIGINT"
            f" / 4294967296.0::DOUBLE)")
