"""Alerts into an HBase table, put by the executors.

Needs the ``happybase`` client on the executors; it is imported there only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

from pyspark.sql import DataFrame, Row

from riskflow import schema as S

PUTS_PER_SEND = 1000


def alert_put(row: Row) -> tuple[bytes, dict[bytes, bytes]]:
    """Row key and cells of one alert; a null has no cell."""
    cells = {
        f"{S.ALERT_FAMILY}:{name}".encode(): row[name].encode()
        for name in S.ALERT_COLUMNS
        if row[name] is not None
    }
    return row["alert_key"].encode(), cells


def put_alerts(rows: Iterable[Row], host: str, table: str) -> None:
    """Put the alerts of one partition over one connection, in bounded sends."""
    import happybase

    rows = iter(rows)
    first = next(rows, None)
    if first is None:
        return
    connection = happybase.Connection(host)
    try:
        with connection.table(table).batch(batch_size=PUTS_PER_SEND) as batch:
            for row in chain([first], rows):
                batch.put(*alert_put(row))
    finally:
        connection.close()


def hbase_store(host: str, table: str) -> Callable[[DataFrame, int], None]:
    """A store for ``streaming.store_alerts``.

    Keys are deterministic, so a replayed batch puts the same cells again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.foreachPartition(lambda rows: put_alerts(rows, host, table))

    return store
