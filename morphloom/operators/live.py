"""Live rows: of all rows with one id, the one with the latest time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _orderable(field: T.StructField) -> Column:
    """The column itself, or its JSON text where the type has no order."""
    simple = field.dataType.simpleString()
    if "map<" in simple or "variant" in simple:
        return F.to_json(F.struct(F.col(f"`{field.name}`")))
    return F.col(f"`{field.name}`")


#: Rows looked at to find values that very many rows have, and how often a value must be among them.
PROBE, HOT = 100_000, 50
#: Rows of one value that a task is given where its rows may be spread.
ROWS_A_TASK = 1_000_000
#: Neighbouring integer ids that stay together, as a power of two.
NEIGHBOURS = 12
#: Bytes of a file's columns that a task is given, and the size from which an estimate says that nothing is known.
BYTES_A_TASK, UNKNOWN_SIZE = 16 << 20, 1 << 60


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that ``df`` reads; 0 where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 0 if size >= UNKNOWN_SIZE else size


def tasks_for(df: DataFrame) -> int:
    """Partitions for an exchange of ``df``: those of the session, or more where that many would be too large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size_of(df) // BYTES_A_TASK))


def hot_values(df: DataFrame, *keys: str) -> list[dict]:
    """For each of ``keys``, its values that hold a large share of all rows, with the tasks to spread each over.

    Looks at one random sample of those columns, in one pass; at most PROBE / HOT
    values of a key are found, about. It only decides how rows are spread over
    tasks, never which rows are in a result. A small table has none.
    """
    found: list[dict] = [{} for _ in keys]
    total = df.select().count()
    if total <= PROBE:
        return found
    tagged = [F.struct(F.lit(i).alias("k"), F.col(key).cast("string").alias("v")) for i, key in enumerate(keys)]
    seen = df.select(*keys).sample(PROBE / total, seed=17).select(F.explode(F.array(*tagged)).alias("x")).filter("x.v is not null")
    for k, value, count in seen.groupBy("x.k", "x.v").count().filter(F.col("count") >= HOT).collect():
        kind = df.schema[keys[k]].dataType
        found[k][value if isinstance(kind, T.StringType) else int(value)] = max(1, -(-count * total // PROBE // ROWS_A_TASK))
    return found


def _spread(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with column ``name``, a hash subgroup of neighbouring ids, partitioned by it."""
    tasks, own = tasks_for(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    subgroup = F.pmod(F.xxhash64(F.shiftright(F.col(key), NEIGHBOURS)), F.lit(8 * tasks)).cast("int")
    numbered = df.withColumn(name, subgroup)
    return numbered.repartition(F.col(name)) if tasks == own else numbered.repartition(tasks, F.col(name))


def _apart(df: DataFrame, key: str, hot: dict | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ids with few versions, and those of ids with very many, if there are any."""
    values = list((hot_values(df, key)[0] if hot is None else hot).keys())
    return (df, None) if not values else (df.filter(F.col(key).isNull() | ~F.col(key).isin(values)), df.filter(F.col(key).isin(values)))


def live_subgroups(df: DataFrame, key: str, time: str, name: str = "subgroup", hot: dict | None = None) -> DataFrame:
    """``live_rows`` of a table with integer ids, spread over hash subgroups of the id.

    Adds column ``name`` (one of that name is replaced); rows are hash-partitioned by it, so what is grouped by
    it and anything else needs no further exchange. Neighbouring ids fall into
    one subgroup: rows written together stay together, which packs better and
    lets later aggregations combine more before they exchange. Ids with very many
    versions (``hot``, or what a sample finds) are reduced apart, before their exchange.
    """
    rest, many = _apart(df, key, hot)
    live = _first(_spread(rest, key, name), [name, key], time)
    return live if many is None else live.unionByName(live_rows(many, key, time).withColumn(name, F.lit(0)))


def version_subgroups(df: DataFrame, key: str, time: str, name: str = "subgroup", sides: str = "sides", hot: dict | None = None) -> DataFrame:
    """The first and the live version of each id, spread as ``live_subgroups`` spreads them.

    Column ``sides`` is 1 for a first version, 2 for a live one, 3 for an id's only
    one. The live version is that of ``live_rows``; the first is at the other end
    of the same order. One window finds both.
    """
    rest, many = _apart(df, key, hot)
    spread = _spread(rest, key, name)
    window = Window.partitionBy(name, key).orderBy(*_order(spread, [name, key], time, ascending=True))
    first, last = F.when(F.row_number().over(window) == 1, 1).otherwise(0), F.when(F.lead(F.lit(1)).over(window).isNull(), 2).otherwise(0)
    both = spread.withColumn(sides, first + last).filter(F.col(sides) > 0)
    if many is None:
        return both
    ends = [_first(many, [key], time, ascending=up).withColumn(name, F.lit(0)).withColumn(sides, F.lit(bit)) for up, bit in ((True, 1), (False, 2))]
    return both.unionByName(ends[0]).unionByName(ends[1])


def live_rows(df: DataFrame, key: str | list[str], time: str) -> DataFrame:
    """Keep per ``key`` the row with the greatest ``time``.

    Exact repeats count once. A null time is older than any other. Rows that
    share key and time but differ elsewhere: the one that is greatest over the
    remaining columns, in column order, stays, so the result does not depend on
    the input's order. A null key is a key like any other. An empty table gives
    an empty table; columns beside key and time are passed through.

    The filter on ``row_number() = 1`` becomes a group limit before the
    exchange, so an id with very many versions is reduced where it is read and
    never meets in one task.
    """
    return _first(df, [key] if isinstance(key, str) else list(key), time)


def _order(df: DataFrame, keys: list[str], time: str, ascending: bool = False) -> list[Column]:
    """By time and then all other columns, nulls at the old end."""
    columns = [F.col(f"`{time}`"), *[_orderable(f) for f in df.schema.fields if f.name not in (*keys, time)]]
    return [c.asc_nulls_first() if ascending else c.desc_nulls_last() for c in columns]


def _first(df: DataFrame, keys: list[str], time: str, ascending: bool = False) -> DataFrame:
    window = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*_order(df, keys, time, ascending))
    place = "__place"
    while place in df.columns:
        place += "_"
    return df.withColumn(place, F.row_number().over(window)).filter(F.col(place) == 1).drop(place)
