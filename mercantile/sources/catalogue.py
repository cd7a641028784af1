"""A made-up catalogue: 22 groups, 430 categories, 3,870 products, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GROUPS, CATEGORIES, PRODUCTS = 22, 430, 3_870

#: Arithmetic only, so that any SQL engine makes the same rows from a column ``id``.
CATALOGUE_SQL = f"""
select cast(id as bigint) product_id,
       cast(id % {CATEGORIES} as int) category_id,
       cast((id % {CATEGORIES}) % {GROUPS} as int) group_id,
       concat('product ', cast(id as varchar(20))) title,
       cast((id * 7919) % 9973 + 100 as bigint) price_cents
from {{source}}
"""


def catalogue(spark: SparkSession, products: int = PRODUCTS) -> DataFrame:
    return spark.sql(CATALOGUE_SQL, source=spark.range(products))
