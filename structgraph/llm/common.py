"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.session import materialize, shared_dir  # noqa: F401

#: Words are runs of anything but ASCII white space (regular expression text).
SPACES = r"[\\x20\\x09-\\x0D]+"
#: Spark's own bound of 64 MB a batch is held several times over: in both
#: directions, by the JVM and by Python, for each task of an executor.
_BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: str, name: str, body: str) -> str:
    """SQL text that binds ``name`` to ``value`` once and evaluates ``body``.

    A plain extra column isn't enough: the optimizer may inline it into a
    lambda, which would evaluate it again for every element.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def running_totals(numbers: str, tag: str) -> str:
    """SQL text: for an array of longs, the sums of the elements before each.

    Sums go over blocks of about sqrt(n), so n elements cost n ** 1.5 steps at
    most and no array is copied once per element.
    """
    a, s, b, t = (f"{x}_{tag}" for x in "asbt")
    add = f"0L, ({t}, y_{tag}) -> {t} + y_{tag}"
    count = f"cast(ceil(size({a}) / {s}) as int)"
    inner = f"transform({a}, (x_{tag}, i_{tag}) -> element_at({b}, cast(i_{tag} div {s} as int) + 1) + aggregate(slice({a}, cast(i_{tag} - i_{tag} % {s} as int) + 1, cast(i_{tag} % {s} as int)), {add}))"
    sums = f"transform(sequence(0, {count} - 1), k_{tag} -> aggregate(slice({a}, k_{tag} * {s} + 1, {s}), {add}))"
    starts = let(sums, f"u_{tag}", f"transform(u_{tag}, (x_{tag}, k_{tag}) -> aggregate(slice(u_{tag}, 1, k_{tag}), {add}))")
    body = let(f"cast(ceil(sqrt(size({a}))) as int)", s, let(starts, b, inner))
    return let(numbers, a, f"if(size({a}) = 0, cast(array() as array<bigint>), {body})")


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` for whole texts, in batches as those of ``map_texts``."""
    _bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_texts(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInPandas`` for whole texts, in batches of about ``BATCH_BYTES`` and one row at least.

    The bound is a setting of the session, which is read when the plan runs;
    a session that has its own keeps it.
    """
    _bound_batches(df.sparkSession)
    return df.mapInPandas(function, schema)


def _bound_batches(spark: SparkSession) -> None:
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many ``_`` behind as it takes to differ from all ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hash of ``key``: the same each time."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


#: Bits of a ``bit_array``: half a MB, whatever the number of keys.
BITS = 1 << 22


def bit_array(keys: DataFrame, key: str, bits: int = BITS) -> Column:
    """A scalar array of longs with the bit of each key's hash set, to leave rows out before a join.

    Its size is fixed, so it can go to every task.  With very many keys all
    bits are set and nothing is left out; the join that follows is exact.
    """
    slots = keys.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("s"))
    words = slots.selectExpr("cast(s div 64 as int) AS w", "shiftleft(1L, cast(s % 64 as int)) AS v")
    words = words.groupBy("w").agg(F.bit_or("v").alias("v"))
    every = keys.sparkSession.range(0, bits // 64, 1, 1).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0)).alias("v")))), lambda x: x["v"])).scalar()


def may_be_in(array: Column, key: str, bits: int = BITS) -> Column:
    """Whether the bit of ``key`` is set; true for every key of the array."""
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.getbit(F.get(array, F.floor(slot / 64).cast("int")), (slot % 64).cast("int")) == 1
