"""SQL twins of ``bindings.streams``."""

from __future__ import annotations

from bindings.oracles import RAW_ID, SCORES, TXN, kpis


def stream_oracles() -> dict[str, str]:
    sqls = {
        "stream_kpis": f"""WITH {SCORES},
closed AS (SELECT * FROM scores WHERE date_trunc('hour', event_timestamp)::TIMESTAMP + INTERVAL 1 HOUR
  <= (SELECT max(event_timestamp) FROM scores) - INTERVAL 2 HOUR)
{kpis('hour', 'closed')}""",
        "stream_once": f"""WITH {TXN}
SELECT transaction_id, event_time, "Time", user_id, k, "Amount", "Class",
  TIMESTAMP '2024-02-01 00:00:00' AS ingestion_timestamp, 'transactions.raw' AS kafka_topic,
  part AS kafka_partition, off AS kafka_offset, 'events.parquet' AS source_file, {RAW_ID} AS raw_event_id
FROM txn""",
        "stream_progress": f"""WITH {TXN}, whole AS (SELECT * FROM txn WHERE off % 5 <> 0)
SELECT CAST(2 AS BIGINT) AS batches, CAST(count(*) AS BIGINT) AS reported_rows,
  CAST(count(*) FILTER (off % 5 = 0) AS BIGINT) AS reported_unparsed, CAST(count(DISTINCT part) AS BIGINT) AS partitions,
  min(off) AS first_offset, max(off) AS last_offset, (SELECT max(ts) FROM whole) AS newest_event,
  CAST(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us((SELECT max(ts) FROM whole)) AS DOUBLE) / 1000000.0::DOUBLE AS least_lag,
  count(*) AS stored_rows, count(*) FILTER (off % 5 = 0) AS stored_empty FROM txn""",
    }
    return {name: sql.strip() for name, sql in sqls.items()}
