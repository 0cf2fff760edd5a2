"""Column functions that several operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructType

#: Modulus and half of the integer mix; all products stay below 2**63.
PRIME, HALF = 2147483647, 1073741823
EPS = 1e-12


def mixed(id_: Column, j: Column | int = 0, seed: int = 0) -> Column:
    """A pseudo-random integer below PRIME for (id, j, seed), the same in any SQL engine."""
    j = F.lit(j) if isinstance(j, int) else j
    j = j.cast("long")
    h1 = (id_ * F.lit(48271).cast("long") + j * F.lit(69621).cast("long") + F.lit(seed)) % F.lit(PRIME).cast("long")
    h2 = (h1 * h1 + j * F.lit(7919).cast("long") + F.lit(seed)) % F.lit(PRIME).cast("long")
    return (h2 * h2 + h1) % F.lit(PRIME).cast("long")


def sign(id_: Column, j: Column | int = 0, seed: int = 0) -> Column:
    """A Rademacher probe: 1.0 or -1.0."""
    return F.when(mixed(id_, j, seed) < HALF + 1, 1.0).otherwise(-1.0)


def uniform(id_: Column, j: Column | int = 0, seed: int = 0) -> Column:
    return (mixed(id_, j, seed) + 0.5) / float(PRIME)


def gaussian(id_: Column, j: Column | int = 0, seed: int = 0) -> Column:
    """Box-Muller from two mixes."""
    return F.sqrt(-2.0 * F.log(uniform(id_, j, seed))) * F.cos(2.0 * F.pi() * uniform(id_, j, seed + 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def rounded(c: Column, digits: int = 6) -> Column:
    """For results that another engine sums in another order; never -0.0."""
    return F.round(c, digits) + F.lit(0.0)


def one_of(column: str, n: int, k: int) -> Column:
    """Whether a row is in slice k of n, by a hash of a column."""
    return F.lit(True) if n == 1 else F.pmod(F.xxhash64(column), F.lit(n)) == k


def union(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts. What is settled in parts is given back in parts: `_settled` names all of them."""
    out = functools.reduce(DataFrame.unionByName, parts)
    out._settled = [p for d in parts for p in _paths(d)]
    return out


def _paths(df: DataFrame) -> list[str]:
    at = getattr(df, "_settled", None) or []
    return [at] if isinstance(at, str) else at


def xlogx_ratio(p: Column, m: Column) -> Column:
    """p ln(p / m), 0 where p is 0."""
    return F.when(p > 0, p * F.log(p / m)).otherwise(0.0)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own where none is set, but never on a cluster, whose machines would
    not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, as compressed columns of which later reads take those that they need.

    Names or types that Parquet does not have are kept as rows. What the work shuffled is given back: the driver's collection lets
    go of plans that are done, and Spark then removes their files."""
    spark = df.sparkSession
    folder = checkpoint_folder(spark)
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or _has_null_type(df.schema):
        return df.checkpoint()
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = _sized(spark, path, df.schema)
    out._settled = path
    return out


def _sized(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table at path, which the optimizer takes to be as large as its rows, not as its compressed files: 12 MB of these
    can hold ten million rows, which a join would then broadcast through the driver.

    The estimate is the files' size times a factor that the session has which reads them: here a clone, for this table alone."""
    df = spark.read.schema(schema).parquet(path)
    files = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    held = df.count() * (8 + df._jdf.schema().defaultSize())
    if held <= files:
        return df
    own = spark._jsparkSession.cloneSession()
    own.conf().set("spark.sql.sources.fileCompressionFactor", str(held / max(files, 1)))
    plan = own.read().schema(df._jdf.schema()).parquet(path).queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of settled tables that nothing reads any more, as a loop's last step but one."""
    for df, path in [(df, path) for df in tables for path in _paths(df)]:
        jvm = df.sparkSession.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def _has_null_type(t) -> bool:
    if isinstance(t, NullType):
        return True
    inner = [f.dataType for f in getattr(t, "fields", [])] + [getattr(t, n) for n in ("elementType", "keyType", "valueType") if hasattr(t, n)]
    return any(_has_null_type(x) for x in inner)
