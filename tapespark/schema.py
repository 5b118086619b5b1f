"""Schemas of the engine's tables."""

from __future__ import annotations

#: The columns of a raw event record, all nullable.
RECORD = (
    "exchange string, market string, symbol string, channel string, event_type string, event_id bigint, row_idx int, local_ts_ns bigint, exchange_ts_ns bigint, engine_ts_ns bigint, "
    "sequence string, sequence_start string, prev_sequence string, is_snapshot boolean, side string, price double, quantity double, action string, order_count double, order_id string, "
    "checksum bigint, trade_id string, taker_side string, mark_price double, index_price double, oracle_price double, open_interest double, funding_rate double, next_funding_ts_ns bigint, "
    "liquidation_side string, raw_message string"
)
COLUMNS = tuple(c.strip().split()[0] for c in RECORD.split(","))
