"""Queries over the supplied tables that exercise the core operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import delivery
from ..session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries to be dropped: all but the first of each message."""
    messages = read_table(spark, d, "fetched_messages")
    store = delivery.replay(delivery.DeliveryStore(spark), messages)
    return delivery.repeated_deliveries(store, messages)


QUERIES: dict[str, Query] = {"p6_found": p6_found}

SQL: dict[str, str] = {
    "p6_found": r"""
with named as (
  select delivery_id, url,
         case when coalesce(blob, '') = '' then 't:' || coalesce(epoch_us(fetched_at)::varchar, '-')
              else 'b:' || coalesce(nullif(regexp_extract(blob, '([0-9]{4}/[0-9]{2}/[0-9]{2}/.*)$', 1), ''), blob) end as what
  from fetched_messages where url is not null)
select delivery_id from named
qualify delivery_id > min(delivery_id) over (partition by url, what)""",
}
