"""Sessions over captured images, and the registry of forensic operators.

A session holds *object tables*: one DataFrame per kind of kernel object, with rows of any number of images (``image``).
``coredust.plans.extract`` makes them from raw memory; tests and callers may bring their own. An operator is a function
from a session and options to a DataFrame, built lazily, so Catalyst plans operators and what is done with them together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational

Operator = Callable[..., DataFrame]
OPERATORS: dict[str, Operator] = {}
ALIASES: dict[str, str] = {}
#: Kind of object -> columns (DDL), filled by the modules that need them.
SCHEMAS: dict[str, str] = {}

MODULE_BUCKET = 1 << 22


class Session:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark, self.tables = spark, dict(tables)

    def table(self, kind: str) -> DataFrame:
        """The object table of a kind; an empty one with its schema where the session has none."""
        if kind not in self.tables:
            self.tables[kind] = self.spark.createDataFrame([], SCHEMAS[kind])
        return self.tables[kind]

    def run(self, name: str, **options) -> DataFrame:
        return OPERATORS[ALIASES.get(name, name)](self, **options)


def operator(name: str) -> Callable[[Operator], Operator]:
    def add(f: Operator) -> Operator:
        OPERATORS[name] = f
        return f

    return add


def alias(old: str, new: str) -> None:
    ALIASES[old] = new


def schemas(**kinds: str) -> None:
    SCHEMAS.update({k: f"image string, {v}" for k, v in kinds.items()})


def only(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose column is one of the values; all rows where no values are given."""
    if values is None:
        return df
    values = values if isinstance(values, (list, tuple, set)) else [values]
    return df.filter(F.col(column).isin(*values))


def resolve(s: Session, df: DataFrame, at: str, modules: str, inclusive: bool = False) -> DataFrame:
    """Adds ``module`` (first that holds the address) and ``symbol`` (exactly there, the least name).

    Both are joins on the image and an address or address bucket; a module touches few buckets whatever its size says.
    """
    # A forged size may go beyond any address; it ends at the last one.
    end = F.coalesce(F.try_add("base", "size"), F.lit((1 << 63) - 1))
    mods = s.table(modules).select("image", F.col("name").alias("module"), "base", end.alias("_end"), "ord")
    keyed = df.select("image", F.col(at).alias("_at")).filter("_at IS NOT NULL").distinct()
    first = relational.lookup_first(keyed, "_at", mods, "base", "_end", "ord", "module", MODULE_BUCKET, ["image"], inclusive)
    names = s.table("symbols").groupBy(F.col("image"), F.col("address").alias("_at")).agg(F.min("name").alias("symbol"))
    found = first.join(names, ["image", "_at"], "left").withColumnRenamed("_at", at)
    return df.join(found, ["image", at], "left")


def containing(points: DataFrame, at: str, ranges: DataFrame, by: list[str], lo: str, hi: str, carry: list[str], inclusive: bool = True) -> DataFrame:
    """Adds ``carry`` of the range that holds each point, null if none; ranges of one owner do not overlap.

    The range with the greatest start at or before the point is the only candidate (as-of), so one sort by (owner,
    address) does, however long the ranges are.
    """
    r = ranges.select(*by, F.col(lo).alias("_at"), F.lit(0).alias("_k"), F.struct(F.col(hi).alias("_hi"), *carry).alias("_r"))
    p = points.withColumns({"_at": F.col(at), "_k": F.lit(1)})
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(r, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).filter("_k = 1")
    inside = (F.col("_at") <= F.col("_r._hi")) if inclusive else (F.col("_at") < F.col("_r._hi"))
    return both.withColumns({c: F.when(inside, F.col(f"_r.{c}")) for c in carry}).drop("_at", "_k", "_r")


__all__ = ["Session", "operator", "alias", "schemas", "only", "resolve", "containing", "OPERATORS", "ALIASES", "SCHEMAS", "relational"]
