"""Small, fixed dimension tables (#7). Their size is fixed by the fixed value
lists, so broadcasting them is always safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake import constants as K


def channel_dim(spark: SparkSession) -> DataFrame:
    """The 8 discovery channels with their order, label, kind, domain, reliability, note."""
    schema = T.StructType([
        T.StructField("channel_ord", T.IntegerType()), T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()), T.StructField("domain", T.StringType()),
        T.StructField("kind", T.StringType()), T.StructField("reliability", T.StringType()),
        T.StructField("note", T.StringType()),
    ])
    rows = [(i, *c) for i, c in enumerate(K.CHANNELS)]
    return F.broadcast(spark.createDataFrame(rows, schema))


def channel_links(spark: SparkSession) -> DataFrame:
    """Per channel: the search URL prefix used by research links."""
    schema = "channel string, link_label string, url_prefix string"
    return F.broadcast(spark.createDataFrame(list(K.CHANNEL_SEARCH_URLS), schema))


def blocklist(spark: SparkSession, kind: str = "aggregator") -> DataFrame:
    """Blocklist as a one-column table (for the join form of the host filters)."""
    src = K.AGGREGATORS if kind == "aggregator" else K.MICROSITES
    return spark.createDataFrame([(d,) for d in dict.fromkeys(src)], "domain string")
