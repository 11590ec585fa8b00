"""A crawl snapshot: one directory of Parquet tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.schema import DEFAULTS, SCHEMAS


def conform(df: DataFrame, name: str) -> DataFrame:
    """Bring a table to its schema: columns in order, absent ones NULL or their default."""
    have, defaults = set(df.columns), DEFAULTS.get(name, {})
    out = []
    for f in SCHEMAS[name].fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


@dataclass(frozen=True)
class Crawl:
    """The tables by name; ``crawl.urls`` is ``crawl.tables['urls']``."""

    spark: SparkSession
    tables: Mapping[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.tables[name]
        raise AttributeError(name)

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Crawl:
        """From DataFrames; tables not given are empty."""
        return cls(spark, {n: conform(tables[n], n) if n in tables else spark.createDataFrame([], s) for n, s in SCHEMAS.items()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Crawl:
        """Read a snapshot. A table that is not there is empty, but without urls it is no crawl."""
        found = {}
        for name in SCHEMAS:
            try:
                found[name] = spark.read.parquet(f"{path}/{name}.parquet")
            except AnalysisException:
                if name == "urls":
                    raise ValueError(f"{path} is not a crawl snapshot") from None
        return cls.of(spark, **found)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        for name, df in self.tables.items():
            df.write.mode(mode).parquet(f"{path}/{name}.parquet")

    @property
    def seed_url(self) -> str | None:
        row = self.crawl_meta.where("id = 1").select("seed_url").first()
        return row[0] if row else None
