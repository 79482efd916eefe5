"""Who sent a request."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.regex import char_class
from ..session import broadcast_if_small

_PREFIX = "Bearer "
_SPACE = char_class(V.UNICODE_SPACE)
_EDGE_SPACE = rf"\A{_SPACE}+|{_SPACE}+\z"


def api_key(header: Column) -> Column:
    """Key named by an authorization header, null if there is none."""
    key = F.regexp_replace(F.substring(header, len(_PREFIX) + 1, 2**31 - 1), _EDGE_SPACE, "")
    return F.when(header.startswith(_PREFIX) & (key != ""), key)


def one_tenant_per_key(tenants: DataFrame) -> DataFrame:
    """(_key, tenant_id, tenant_name); of several tenants with one key the least counts."""
    least = F.min(F.struct("tenant_id", "tenant_name"))
    return tenants.groupBy(F.col("api_key").alias("_key")).agg(least.alias("_t")).select(
        "_key", "_t.tenant_id", "_t.tenant_name"
    )


def authenticate(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Add tenant_id, tenant_name and auth_status (401 or null).

    A key that occurs twice does not double a request.  A tenant table proven small is broadcast, so the requests stay where they are;
    a larger one is joined by shuffle, where Spark splits a hot key's partition.
    """
    keyed = requests.withColumn("_key", api_key(F.col("auth_header")))
    known = one_tenant_per_key(tenants)
    open_route = F.col("path").isin(*V.OPEN_ROUTES)
    return (
        keyed.join(broadcast_if_small(known), "_key", "left")
        .withColumn("auth_status", F.when(F.col("tenant_id").isNull() & ~open_route, 401))
        .drop("_key")
    )


def unauthorized(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Requests to guarded routes that no tenant's key opens."""
    keyed = requests.filter(~F.col("path").isin(*V.OPEN_ROUTES)).withColumn(
        "_key", api_key(F.col("auth_header"))
    )
    known = tenants.select(F.col("api_key").alias("_key"))
    return keyed.join(broadcast_if_small(known), "_key", "left_anti").drop("_key")
