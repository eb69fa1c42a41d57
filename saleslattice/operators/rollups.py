"""Stored pre-aggregates of the fact, their choice for a pivot, and their re-aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, IntegralType, StringType, TimestampNTZType, TimestampType

from ..functions.exprs import null_if_blank
from ..sources.scratch import folder, released
from ..sources.stored import current, new_version, publish, remove
from .filters import not_total_pivot, where

#: Dimensions of each rollup.
ROLLUPS = {
    "state_month": ("state", "bill_month"),
    "branch_brand": ("branch", "brand"),
    "agent_party_month": ("agent_name", "to_party_name", "bill_month"),
    "party_grouped_brand": ("party_grouped", "brand"),
    "state_party_brand": ("state", "party_grouped", "brand"),
    "agent_final_branch": ("agent_name_final", "branch"),
    "party_agent_branch": ("to_party_name", "agent_name_final", "branch"),
    "state_branch_brand_month": ("state", "branch", "brand", "bill_month"),
}
SUMS = {"net_amount": "total_net", "amount_before_tax": "total_before_tax", "sl_qty": "total_qty"}


#: Measures that the rollup of all dimensions sums beside keeping them as dimensions.
ALL_SUMS = ("sl_qty", "gross_amount", "amount_before_tax", "net_amount")


#: So many hashes that repeat are broadcast at most; where more do, whole rows are shuffled.
MOST = 2_000_000
#: Types whose equal values have equal hashes; hashes of rows are made of columns of these and of plain strings.
HASHED = (BooleanType, IntegralType, DecimalType, DateType, TimestampType, TimestampNTZType)


def _alone(df: DataFrame, by: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """(alone, rest): rows of df that no other row equals by the columns, told by a hash that no other has, and all others. Only
    hashes are shuffled, and those that repeat are broadcast. df is read up to three times. All rows are the rest where too many
    hashes repeat, or those of half the rows."""
    spark = df.sparkSession
    hashed = df.withColumn("_h", F.xxhash64(*(c for c in by if isinstance(t := df.schema[c].dataType, HASHED) or t == StringType()), F.lit(0)))
    hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").write.parquet(at := folder(spark))
    often = spark.read.parquet(at)
    n, rows = often.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return df, None
    if n > MOST or 2 * rows > df.count():
        return None, df
    few = F.broadcast(often.select("_h"))
    return tuple(hashed.join(few, "_h", how).drop("_h") for how in ("left_anti", "left_semi"))


def _totals(df: DataFrame, by: list[str], sums: dict[str, str], rows: str | None = None) -> DataFrame:
    """Totals of df by columns; sums: column to name. rows: the column that holds how many rows of the fact a row stands for."""
    n = F.sum(rows) if rows else F.count(F.lit(1))
    return df.groupBy(*by).agg(*(F.sum(c).alias(to) for c, to in sums.items()), n.alias("fact_row_count"))


def grouped(df: DataFrame, by: list[str], sums: dict[str, str], rows: str | None = None) -> DataFrame:
    """_totals() of a df that comes from files, as it is read several times: a group of one row is that row and isn't shuffled."""
    alone, rest = _alone(df, by)
    if alone is None:
        return _totals(rest, by, sums, rows)
    kinds = _totals(df, by, sums, rows).schema
    one = alone.select(*by, *(F.col(c).cast(kinds[to].dataType).alias(to) for c, to in sums.items()), (F.col(rows) if rows else F.lit(1)).cast("bigint").alias("fact_row_count"))
    return one if rest is None else one.unionByName(_totals(rest, by, sums, rows))


def _times(c: str, kind: DecimalType) -> Column:
    """The sum of a column over the rows of a group that it is a key of, of the type of a sum; so it need not be shuffled."""
    return (F.col(c) * F.col("fact_row_count").cast("decimal(20,0)")).cast(DecimalType(min(38, kind.precision + 10), kind.scale))


def _all_dims(fact: DataFrame, at: str | None) -> DataFrame:
    """The rollup of all dimensions. at: a new folder where the fact's rows are stored before; None if they come from files."""
    by = [c for c in fact.columns if c != "id"]
    rows = fact.select(*by)
    if at:
        rows.write.option("compression", "zstd").parquet(at)
        released(fact.sparkSession)
        rows = fact.sparkSession.read.schema(rows.schema).parquet(at)
    kinds = {c: rows.schema[c].dataType for c in ALL_SUMS}
    exact = [c for c in ALL_SUMS if isinstance(kinds[c], DecimalType)]
    got = grouped(rows, by, {c: f"sum_{c}" for c in ALL_SUMS if c not in exact})
    return got.select(*by, *((_times(c, kinds[c]) if c in exact else F.col(f"sum_{c}")).alias(f"sum_{c}") for c in ALL_SUMS), "fact_row_count")


def rollup(fact: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Sums and row count by the rollup's dimensions, of the fact without total rows: see pivot_from_rollup. all_dims
    instead groups by every column but id, of all rows: the fact without exact repeats. For that its rows are stored first, unless
    they come from files as they are (kept)."""
    if name == "all_dims":
        return _all_dims(fact, None if kept else folder(fact.sparkSession))
    base = fact.where(not_total_pivot()).withColumn("bill_month", F.trunc("bill_date", "month"))
    dims = [d for d in ROLLUPS[name] if d in base.columns]
    return base.groupBy(*dims).agg(*(F.sum(c).alias(n) for c, n in SUMS.items()), F.count(F.lit(1)).alias("fact_row_count"))


#: Axes that a stored rollup by bill_month keeps as they are in the fact, so that its months answer pivots by time: texts of the
#: fact's rows that have their own, null for all others, whose time is that of bill_month.
TIMES = ("fy", "month", "mmm")
#: Dimensions that a pivot may ask for where a rollup has bill_month. No rollup of all dimensions for these.
DERIVED = {"bill_month": TIMES}


def dims(name: str) -> tuple[str, ...]:
    """Columns by which a stored rollup is grouped."""
    return ROLLUPS[name] + (TIMES if "bill_month" in ROLLUPS[name] else ())


def answers(name: str) -> set[str]:
    """Axes that a stored rollup can be asked for."""
    return {a for d in ROLLUPS[name] for a in (d, *DERIVED.get(d, ()))} - {"bill_month"}


def choose(axes: list[str], values: list[tuple[str, str]], filter_fields: list[str], stored: set[str] | None = None) -> str | None:
    """The rollup that answers a pivot, of those stored (all, if not given): one that has its axes and no others if there is one,
    then of the fewest further dimensions, then by name. Several time axes are one dimension."""
    if any(a not in ("sum", "avg", "count") or (a != "count" and f not in SUMS) for f, a in values):
        return None
    asked = {"bill_month" if a in TIMES else a for a in axes}
    if {*TIMES, "to_party_name"} & set(filter_fields):
        return None
    fit = [(n, len(set(d) - asked)) for n, d in ROLLUPS.items() if {*axes, *filter_fields} <= answers(n) and (stored is None or n in stored)]
    return min(fit, key=lambda x: (x[1] > 0, x[1], x[0]))[0] if fit else None


def reaggregate(stored: DataFrame, axes: list[str], values: list[tuple[str, str]], filters=()) -> DataFrame:
    """A pivot over a stored rollup. Time axes are those of the fact's rows: the rollup keeps their texts, and a month stands for
    its days."""
    from ..functions import exprs as X

    rows = F.sum(F.coalesce("fact_row_count", F.lit(1)))

    def value(f, a):
        total = None if a == "count" else F.coalesce(F.sum(SUMS[f]), F.lit(0))
        return rows if a == "count" else total if a == "sum" else total.cast("double") / rows

    if "bill_month" in stored.columns:
        stored = stored.withColumn("bill_date", F.col("bill_month"))
    base = stored.where(where(list(filters), exclude_totals="branch" in stored.columns))
    return base.groupBy(*(X.dim_axis(d).alias(f"d_{d}") for d in axes)).agg(*(value(f, a).alias(f"{a}_{f}") for f, a in values))


def pivot_from_rollup(fact: DataFrame, path: str, axes: list[str], values: list[tuple[str, str]], filters=()) -> DataFrame:
    """A pivot from the best of the current rollups at path; from the fact where none answers it. Both have the columns of
    reaggregate()."""
    spark, at = fact.sparkSession, current(fact.sparkSession, path)
    have = stored_names(spark, at)
    name = choose(axes, values, [f["field"] for f in filters], have) if at else None
    if name is not None:
        return reaggregate(spark.read.parquet(f"{at}/{name}"), axes, values, filters)
    from ..plans import pivot as P

    return P.pivot_groupby(fact, P.config(axes, [], values, filters)).drop("row_count")


def stored_names(spark, at: str | None) -> set[str]:
    """Rollups of a version, by its list."""
    return {r.name for r in spark.read.parquet(f"{at}/names").collect()} if at else set()


def refresh(fact: DataFrame, path: str, only: tuple[str, ...] | None = None, wide: bool = True, kept: bool = False) -> str:
    """Build the rollups whose columns the fact has (all nine, or only those named) as a new version at path and make it the
    current one; returns its folder. Readers of the version before are not disturbed, and none sees a part.

    The fact is read once: for the rollup of all dimensions if that is among them, from which one base of all others'
    dimensions comes; else for the base. Each rollup then comes from the smallest, by its files' row counts, of those already
    written that have its dimensions. wide: whether to build the rollup of all dimensions, which is about as large as the fact.
    kept: the fact comes from files as it is, so that it needn't be stored before it is read for that rollup."""
    spark = fact.sparkSession
    version, at = new_version(path)
    # as the fact's columns are known, missing ones are known too
    have = [n for n in ROLLUPS if (only is None or n in only) and all(d == "bill_month" or d in fact.columns for d in ROLLUPS[n])]
    every = list(dict.fromkeys(d for n in have for d in dims(n) if d in fact.columns or d == "bill_month"))
    times = {c: null_if_blank(F.col(c)) for c in TIMES if c in fact.columns}
    source, sums, rows = fact, dict(SUMS), None
    if wide and (only is None or "all_dims" in only):
        _all_dims(fact, None if kept else f"{at}/rows").write.option("compression", "zstd").parquet(f"{at}/all_dims")
        remove(spark, f"{at}/rows")
        source, sums, rows = spark.read.parquet(f"{at}/all_dims"), {f"sum_{c}": n for c, n in SUMS.items()}, "fact_row_count"
    written: dict[str, tuple[set[str], int]] = {}
    if have:
        base = source.where(not_total_pivot()).withColumns({"bill_month": F.trunc("bill_date", "month"), **times})
        (grouped if rows else _totals)(base, every, sums, rows).write.option("compression", "zstd").parquet(f"{at}/base")
        released(spark)
        written["base"] = set(every), _rows(spark, f"{at}/base")
    again = {n: n for n in SUMS.values()}
    for name in sorted(have, key=lambda n: -len(dims(n))):
        by = [d for d in dims(name) if d in every]
        parent = min((n for n, (d, _) in written.items() if set(by) <= d), key=lambda n: (written[n][1], n))
        grouped(spark.read.parquet(f"{at}/{parent}"), by, again, "fact_row_count").write.option("compression", "zstd").parquet(f"{at}/{name}")
        released(spark)
        written[name] = set(by), _rows(spark, f"{at}/{name}")
    names = [(n, n) for n in [*have, *(["all_dims"] if rows else [])]]
    spark.createDataFrame(names, "name string, folder string").coalesce(1).write.parquet(f"{at}/names")
    publish(spark, path, version)
    return at


def _rows(spark, path: str) -> int:
    return spark.read.parquet(path).count()  # by footers


def freshness(fact: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: the fact's latest fiscal year (fy, by its first year), its rows there (src_rows), those that stored (the rollup of
    all dimensions) has of it, a row each (mv_rows), and whether there are none (stale). No row where no year is named."""
    named = F.trim(F.coalesce("fy", F.lit(""))) != ""
    years = fact.where(named).groupBy("fy").agg(F.count(F.lit(1)).alias("src_rows"))
    first = F.split("fy", "-")[0].try_cast("int")
    last = years.agg(F.max_by(F.struct("fy", "src_rows"), F.struct(first, "fy")).alias("x")).where("x is not null").select("x.*")
    seen = stored.where(named).groupBy("fy").agg(F.count(F.lit(1)).alias("mv_rows"))
    return last.join(seen, "fy", "left").select("fy", "src_rows", F.coalesce("mv_rows", F.lit(0)).alias("mv_rows"), F.col("mv_rows").isNull().alias("stale"))


def check_fresh(fact: DataFrame, path: str) -> DataFrame:
    """freshness() of the current rollup of all dimensions at path, with skipped, true where there is none."""
    spark, at = fact.sparkSession, current(fact.sparkSession, path)
    if "all_dims" not in stored_names(spark, at):
        return freshness(fact, fact.where(F.lit(False))).withColumn("skipped", F.lit(True))
    return freshness(fact, spark.read.parquet(f"{at}/all_dims")).withColumn("skipped", F.lit(False))


#: Fields whose list of values must be fresh, so that it comes from the fact.
FRESH = TIMES


def distinct_source(fact: DataFrame, path: str, field: str) -> tuple[DataFrame, str]:
    """(df, name): where a field's distinct values are read: the current rollup at path that has the field, the one of the fewest
    dimensions; the fact for fields of time, and where none has it."""
    spark, at = fact.sparkSession, current(fact.sparkSession, path)
    fit = [] if field in FRESH else sorted((len(ROLLUPS[n]), n) for n in stored_names(spark, at) - {"all_dims"} if field in ROLLUPS[n])
    return (spark.read.parquet(f"{at}/{fit[0][1]}"), fit[0][1]) if fit else (fact, "fact")
