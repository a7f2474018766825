"""Tables stored by tenant: a scan of one tenant reads one shard's files, and in them its row groups.

A folder for each tenant would be as many folders as there are tenants, so tenants share SHARDS
of them, by their id; inside a file rows are sorted by tenant, which the Parquet statistics
make use of. A large tenant's rows are dealt to several files of its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

SHARDS, FILES = 64, 8


def shard(tenant: str = "prospect_id") -> Column:
    return F.pmod(F.col(tenant).cast("long"), F.lit(SHARDS)).cast("int").alias("shard")


def write(rows: DataFrame, path: str, tenant: str = "prospect_id", spread: str = "id") -> None:
    dealt = rows.withColumn("shard", shard(tenant)).repartition("shard", F.pmod(F.xxhash64(spread), F.lit(FILES)))
    dealt.sortWithinPartitions("shard", tenant).write.partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, schema: StructType, tenant: int | None = None, column: str = "prospect_id") -> DataFrame:
    """The stored rows, or one tenant's."""
    found = spark.read.schema(StructType([*schema.fields]).add("shard", IntegerType())).parquet(path)
    if tenant is not None:
        found = found.filter((F.col("shard") == tenant % SHARDS) & (F.col(column) == tenant))
    return found.select(*schema.names)
