"""Rights by path prefix for any number of clients and prefixes, as an equi-join.

A path lies below a listed prefix if one of its own ancestors is the prefix. Rights are
first brought to their least form, in which no prefix of a client lies below another one
of theirs; a path then meets one right at most, so its ancestors join with the rights
without making rows twice, and nothing has to be collected or told apart afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import column, fresh

ROOT = "/"


def ancestors(path: Column, itself: bool = True) -> Column:
    """'/', then the path's leading parts from the shortest on, up to the path itself."""
    parts = F.split(path, "/")
    depths = F.sequence(F.lit(1), F.size(parts) - F.lit(0 if itself else 1))
    some = F.size(parts) > F.lit(0 if itself else 1)
    return F.concat(F.array(F.lit(ROOT)), F.when(some, F.transform(depths, lambda d: F.array_join(F.slice(parts, 1, d), "/"))).otherwise(F.array().cast("array<string>")))


def least(rights: DataFrame, client: str = "client_id", prefix: str = "prefix") -> DataFrame:
    """(client, prefix) without repeats, nulls, and prefixes that lie below another one of the same client."""
    own = rights.select(column(client).alias("client"), column(prefix).alias("prefix")).filter("client IS NOT NULL AND prefix IS NOT NULL").distinct()
    above = own.filter(F.col("prefix") != ROOT).select("client", "prefix", F.explode(ancestors(F.col("prefix"), itself=False)).alias("above"))
    covered = above.join(own.select(F.col("client"), F.col("prefix").alias("above")), ["client", "above"], "left_semi").select("client", "prefix")
    return own.join(covered, ["client", "prefix"], "left_anti")


def permitted(rows: DataFrame, rights: DataFrame, path: str = "relative_path", client: str = "client_id", prefix: str = "prefix") -> DataFrame:
    """The rows whose client may see their path: a listed prefix is the path or one of its ancestors; '/' allows all.

    A null path or client is not permitted. Columns of ``rows`` stay as they are; a prefix that very many paths lie below is a skewed
    join key, which adaptive execution splits."""
    c, p = fresh(rows, "right_client", "right_prefix")
    side = least(rights, client, prefix).toDF(c, p)
    keys = [column(x) for x in rows.columns]
    (a,) = fresh([*rows.columns, c, p], "ancestor")
    spread = rows.filter(column(path).isNotNull()).select("*", F.explode(ancestors(column(path))).alias(a))
    return spread.join(side, (column(client) == column(c)) & (column(a) == column(p)), "left_semi").select(*keys)
