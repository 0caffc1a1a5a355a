"""Session helpers: table access and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The characters that count as white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a private one only on one machine whose session names none. On a cluster without the setting it raises."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "millrace-checkpoints")
    os.makedirs(own, exist_ok=True)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: smaller than a checkpoint, and later steps read just the columns they need."""
    path = path or f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utrim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null, empty after trimming, or MISSING in any case."""
    return c.isNull() | F.upper(utrim(c)).isin("", "MISSING")
