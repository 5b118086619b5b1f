"""Messages of every venue and channel, made from the sample ticks, as records: one query per venue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import feeds
from .base import TICK, Plans, ticks

P = Plans()
QUERIES, SQL = P.QUERIES, P.SQL

#: What is compared of a record.
COLUMNS = {
    "event_id": "BIGINT", "row_idx": "INTEGER", "symbol": "VARCHAR", "event_type": "VARCHAR", "exchange_ts_ns": "BIGINT", "engine_ts_ns": "BIGINT", "sequence": "VARCHAR", "prev_sequence": "VARCHAR", "is_snapshot": "BOOLEAN",
    "side": "VARCHAR", "price": "DOUBLE", "quantity": "DOUBLE", "action": "VARCHAR", "order_count": "DOUBLE", "order_id": "VARCHAR", "trade_id": "VARCHAR", "taker_side": "VARCHAR", "liquidation_side": "VARCHAR",
    "mark_price": "DOUBLE", "index_price": "DOUBLE", "oracle_price": "DOUBLE", "open_interest": "DOUBLE", "funding_rate": "DOUBLE",
}


def fed(spark: SparkSession, sf: str, venue: str, channels: dict[str, Column]) -> DataFrame:
    """The records of several channels of a venue, each from one message per tick."""
    out = None
    for channel, message in channels.items():
        rows = ticks(spark, sf).select((F.col("ts") * 1000).alias("local_ts_ns"), F.col("seq").alias("message_id"), F.to_json(message).alias("raw"))
        rows = feeds.normalise(rows, venue, channel, "X").select(F.lit(channel).alias("feed"), *COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


def expected(*parts: tuple[str, dict[str, str]]) -> str:
    """SQL for the records: for each (channel, columns) a row per tick; times are those of the message unless given."""
    always = {"event_id": "seq * 65536", "row_idx": "0", "exchange_ts_ns": "ts // 1000 * 1000000", "engine_ts_ns": "ts // 1000 * 1000000"}
    one = lambda feed, given: f"SELECT '{feed}' AS feed, " + ", ".join(f"CAST({(always | given).get(c, 'NULL')} AS {kind}) AS {c}" for c, kind in COLUMNS.items()) + " FROM tick"
    return f"WITH {TICK} " + " UNION ALL ".join(one(*p) for p in parts)


def book(feed: str, **given: str) -> list[tuple[str, dict[str, str]]]:
    """A bid of k at the price, then an ask of 99 - k one cent higher; no quantity deletes unless the action is given."""
    kind = lambda q: given.get("action", f"CASE WHEN {q} = 0 THEN 'delete' ELSE 'set' END")
    bid = {"side": "'bid'", "price": PX, "quantity": "k", "action": kind("k")}
    ask = {"side": "'ask'", "row_idx": "1", "price": NEXT_PX, "quantity": "99 - k", "action": kind("(99 - k)")}
    return [(feed, given | bid), (feed, given | ask)]


PX, NEXT_PX = "px / 100.0::DOUBLE", "(px + 1) / 100.0::DOUBLE"
ID, TAKER, EXACT = "CAST(seq + 1 AS VARCHAR)", "CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END", "ts * 1000"
SNAPSHOT = "k % 10 = 0"
c, lit = F.col, F.lit


def price(more: int = 0) -> Column:
    return (c("px") + more) / 100.0


def string(x: str | Column) -> Column:
    return (c(x) if isinstance(x, str) else x).cast("string")


def obj(**fields: Column | str | int) -> Column:
    """A JSON object; plain values stand for themselves."""
    return F.struct(*[(v if isinstance(v, Column) else lit(v)).alias(k) for k, v in fields.items()])


def levels(*cells: Column) -> Column:
    return F.array(F.array(*cells))


def parts() -> dict[str, Column]:
    """What messages are made of."""
    even = F.pmod("k", lit(2)) == 0
    return {"ms": F.floor(c("ts") / 1000), "id": c("seq") + 1, "side": F.when(even, "buy").otherwise("sell"), "iso": F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "left": 99 - c("k"), "even": even, "snap": F.pmod("k", lit(10)) == 0}


@P.add(expected(
    *book("books", event_type=f"CASE WHEN {SNAPSHOT} THEN 'snapshot' ELSE 'update' END", is_snapshot=SNAPSHOT, symbol="'X'", sequence=ID, prev_sequence="CAST(seq + 8 AS VARCHAR)", order_count="4"),
    ("trades", {"event_type": "'trade'", "symbol": "'X'", "sequence": ID, "trade_id": ID, "price": PX, "quantity": "k", "taker_side": TAKER}),
))
def normalise_okx(spark: SparkSession, sf: str) -> DataFrame:
    """Books with sequence chains and order counts, and trades."""
    p = parts()
    data = obj(ts=string(p["ms"]), seqId=p["id"], prevSeqId=c("seq") + 8, bids=levels(string(price()), string("k"), lit("0"), lit("4")), asks=levels(string(price(1)), string(p["left"]), lit("0"), lit("4")))
    trade = obj(tradeId=string(p["id"]), px=string(price()), sz=string("k"), side=p["side"], ts=string(p["ms"]))
    return fed(spark, sf, "okx_perpetual", {"books": obj(arg=obj(channel="books"), action=F.when(p["snap"], "snapshot").otherwise("update"), data=F.array(data)), "trades": obj(arg=obj(channel="trades"), data=F.array(trade))})


@P.add(expected(
    ("level2", {"event_type": f"CASE WHEN {SNAPSHOT} THEN 'snapshot' ELSE 'update' END", "is_snapshot": SNAPSHOT, "symbol": "'X'", "sequence": ID, "exchange_ts_ns": EXACT, "engine_ts_ns": EXACT, "side": "CASE WHEN k % 2 = 0 THEN 'bid' ELSE 'offer' END", "price": PX, "quantity": "k", "action": "CASE WHEN k = 0 THEN 'delete' ELSE 'set' END"}),
    ("market_trades", {"event_type": "'update'", "symbol": "'BTC-USD'", "sequence": ID, "trade_id": ID, "exchange_ts_ns": EXACT, "engine_ts_ns": EXACT, "side": TAKER, "price": PX, "quantity": "k"}),
))
def normalise_coinbase(spark: SparkSession, sf: str) -> DataFrame:
    """Updates with sides bid and offer, and trades that name the maker's side only."""
    p = parts()
    update = obj(side=F.when(p["even"], "bid").otherwise("offer"), event_time=p["iso"], price_level=string(price()), new_quantity=string("k"))
    trade = obj(trade_id=string(p["id"]), product_id="BTC-USD", price=string(price()), size=string("k"), side=F.upper(p["side"]), time=p["iso"])
    head = {"timestamp": p["iso"], "sequence_num": p["id"]}
    return fed(spark, sf, "coinbase_spot", {
        "level2": obj(channel="l2_data", **head, events=F.array(obj(type=F.when(p["snap"], "snapshot").otherwise("update"), updates=F.array(update)))),
        "market_trades": obj(channel="market_trades", **head, events=F.array(obj(type="update", trades=F.array(trade)))),
    })


L3_ACTION = "CASE k % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'add' ELSE 'modify' END"


@P.add(expected(
    *book("book", event_type="'update'", is_snapshot="false", symbol="'BTC/USD'", sequence=ID, exchange_ts_ns=EXACT, engine_ts_ns=EXACT),
    ("trade", {"event_type": "'trade'", "symbol": "'BTC/USD'", "sequence": ID, "trade_id": ID, "exchange_ts_ns": EXACT, "engine_ts_ns": EXACT, "price": PX, "quantity": "k", "taker_side": TAKER}),
    ("level3", {"event_type": "'update'", "is_snapshot": "false", "symbol": "'BTC/USD'", "sequence": ID, "exchange_ts_ns": EXACT, "engine_ts_ns": EXACT, "side": "'bid'", "price": PX, "quantity": "k", "action": L3_ACTION, "order_id": "'O' || k"}),
))
def normalise_kraken(spark: SparkSession, sf: str) -> DataFrame:
    """Books, trades, and single orders with their own actions."""
    p = parts()
    data = obj(symbol="BTC/USD", checksum=p["id"], timestamp=p["iso"], bids=F.array(obj(price=price(), qty=c("k"))), asks=F.array(obj(price=price(1), qty=p["left"])))
    trade = obj(symbol="BTC/USD", trade_id=p["id"], price=price(), qty=c("k"), side=p["side"], timestamp=p["iso"])
    third = F.pmod("k", lit(3))
    order = obj(event=F.when(third == 0, "delete").when(third == 1, "add").otherwise("modify"), order_id=F.concat(lit("O"), string("k")), limit_price=price(), order_qty=c("k"), timestamp=p["iso"])
    orders = obj(symbol="BTC/USD", checksum=p["id"], timestamp=p["iso"], bids=F.array(order), asks=F.array().cast("array<struct<event:string>>"))
    return fed(spark, sf, "kraken_spot", {"book": obj(channel="book", type="update", data=F.array(data)), "trade": obj(channel="trade", data=F.array(trade)), "level3": obj(channel="level3", type="update", data=F.array(orders))})


TWICE = {"event_type": "'trade'", "symbol": "'BTC-PERPETUAL'", "price": PX, "quantity": "k", "taker_side": TAKER}


@P.add(expected(
    *book("book", event_type="'change'", is_snapshot="false", symbol="'BTC-PERPETUAL'", sequence=ID, prev_sequence="CAST(seq AS VARCHAR)"),
    *[("trades", TWICE | {"row_idx": str(i), "sequence": f"seq || '{x}'", "trade_id": f"seq || '{x}'"}) for i, x in enumerate("ab")],
    ("ticker", {"event_type": "'derivative_context'", "symbol": "'BTC-PERPETUAL'", "sequence": "CAST(ts // 1000 AS VARCHAR)", "mark_price": PX, "index_price": NEXT_PX, "open_interest": "k", "funding_rate": "k / 1000.0::DOUBLE"}),
))
def normalise_deribit(spark: SparkSession, sf: str) -> DataFrame:
    """Books that chain by change id, two trades a message under one event, and tickers."""
    p = parts()
    message = lambda channel, data: obj(method="subscription", params=obj(channel=channel, data=data))
    kind = lambda q: F.when(q == 0, "delete").otherwise("change")
    levelled = obj(type="change", timestamp=p["ms"], instrument_name="BTC-PERPETUAL", change_id=p["id"], prev_change_id=c("seq"), bids=levels(kind(c("k")), string(price()), string("k")), asks=levels(kind(p["left"]), string(price(1)), string(p["left"])))
    trade = lambda x: obj(trade_id=F.concat(string("seq"), lit(x)), price=price(), amount=c("k"), direction=p["side"], timestamp=p["ms"], instrument_name="BTC-PERPETUAL")
    ticker = obj(timestamp=p["ms"], instrument_name="BTC-PERPETUAL", mark_price=price(), index_price=price(1), open_interest=c("k"), current_funding=c("k") / 1000.0)
    return fed(spark, sf, "deribit_perpetual", {"book": message("book.BTC.100ms", levelled), "trades": message("trades.BTC.100ms", F.array(trade("a"), trade("b"))), "ticker": message("ticker.BTC", ticker)})


@P.add(expected(
    *book("l2Book", event_type="'snapshot'", is_snapshot="true", symbol="'BTC'", sequence="CAST(ts // 1000 AS VARCHAR)", action="'set'", order_count="3"),
    ("trades", {"event_type": "'trade'", "symbol": "'BTC'", "sequence": ID, "trade_id": "(ts // 1000) || ':BTC:' || (seq + 1)", "price": PX, "quantity": "k", "taker_side": TAKER}),
    ("activeAssetCtx", {"event_type": "'derivative_context'", "symbol": "'BTC'", "exchange_ts_ns": "NULL", "engine_ts_ns": "NULL", "mark_price": PX, "oracle_price": NEXT_PX, "open_interest": "k", "funding_rate": "k / 1000.0::DOUBLE"}),
))
def normalise_hyperliquid(spark: SparkSession, sf: str) -> DataFrame:
    """Full snapshots in every message, trades by time, coin and number, and contexts without a time."""
    p = parts()
    side = lambda px, q: F.array(obj(px=string(px), sz=string(q), n=3))
    trade = obj(coin="BTC", side=F.when(p["even"], "B").otherwise("A"), px=string(price()), sz=string("k"), time=p["ms"], tid=p["id"])
    context = obj(markPx=string(price()), oraclePx=string(price(1)), openInterest=string("k"), funding=string(c("k") / 1000.0))
    return fed(spark, sf, "hyperliquid_perpetual", {
        "l2Book": obj(channel="l2Book", data=obj(coin="BTC", time=p["ms"], levels=F.array(side(price(), c("k")), side(price(1), p["left"])))),
        "trades": obj(channel="trades", data=F.array(trade)),
        "activeAssetCtx": obj(channel="activeAssetCtx", data=obj(coin="BTC", ctx=context)),
    })


@P.add(expected(
    *book("snapshot", event_type="'snapshot'", is_snapshot="true", symbol="'X'", sequence=ID, action="'set'", engine_ts_ns="NULL"),
    ("trades", {"event_type": "'trade'", "symbol": "'BTCUSDT'", "sequence": ID, "trade_id": ID, "price": PX, "quantity": "k", "taker_side": "CASE WHEN k % 2 = 0 THEN 'sell' ELSE 'buy' END"}),
    ("markPrice", {"event_type": "'derivative_context'", "symbol": "'BTCUSDT'", "sequence": "CAST(ts // 1000 AS VARCHAR)", "mark_price": PX, "index_price": NEXT_PX, "funding_rate": "k / 1000.0::DOUBLE"}),
    ("forceOrder", {"event_type": "'liquidation'", "symbol": "'BTCUSDT'", "sequence": "CAST(ts // 1000 AS VARCHAR)", "price": f"CASE WHEN k % 3 = 0 THEN {PX} ELSE {NEXT_PX} END", "quantity": "CASE WHEN k % 5 = 0 THEN k ELSE 7 END", "taker_side": "CASE WHEN k % 2 = 0 THEN 'sell' ELSE 'buy' END", "liquidation_side": "CASE WHEN k % 2 = 0 THEN 'long' ELSE 'short' END"}),
))
def normalise_binance_rest(spark: SparkSession, sf: str) -> DataFrame:
    """The channels beside depth: snapshots, trades, mark prices, liquidations whose average and filled amounts may be missing."""
    p = parts()
    order = obj(s="BTCUSDT", S=F.when(p["even"], "SELL").otherwise("BUY"), q=string("k"), p=string(price()), ap=F.when(F.pmod("k", lit(3)) == 0, "0").otherwise(string(price(1))), z=F.when(F.pmod("k", lit(5)) == 0, "0").otherwise("7"), T=p["ms"])
    return fed(spark, sf, "binance_perpetual", {
        "snapshot": obj(lastUpdateId=p["id"], E=p["ms"], bids=levels(string(price()), string("k")), asks=levels(string(price(1)), string(p["left"]))),
        "trades": obj(e="trade", E=p["ms"], T=p["ms"], s="BTCUSDT", t=p["id"], p=string(price()), q=string("k"), m=p["even"]),
        "markPrice": obj(e="markPriceUpdate", E=p["ms"], s="BTCUSDT", p=string(price()), i=string(price(1)), r=string(c("k") / 1000.0), T=p["ms"]),
        "forceOrder": obj(e="forceOrder", E=p["ms"], o=order),
    })


@P.add(expected(
    *book("orderbook", event_type=f"CASE WHEN {SNAPSHOT} THEN 'snapshot' ELSE 'delta' END", is_snapshot=SNAPSHOT, symbol="'X'", sequence=ID, prev_sequence="CAST(seq + 9 AS VARCHAR)"),
    ("trades", {"event_type": "'trade'", "symbol": "'X'", "sequence": ID, "trade_id": ID, "price": PX, "quantity": "k", "taker_side": TAKER}),
    ("tickers", {"event_type": "'derivative_context'", "symbol": "'BTCUSDT'", "sequence": ID, "mark_price": f"CASE WHEN k % 2 = 0 THEN {PX} END", "open_interest": "k"}),
))
def normalise_bybit_rest(spark: SparkSession, sf: str) -> DataFrame:
    """The channels beside liquidations: books, trades, and tickers whose updates leave fields out."""
    p = parts()
    data = obj(s="BTCUSDT", u=p["id"], seq=c("seq") + 9, cts=p["ms"], b=levels(string(price()), string("k")), a=levels(string(price(1)), string(p["left"])))
    return fed(spark, sf, "bybit_perpetual", {
        "orderbook": obj(topic="orderbook.1000.BTCUSDT", type=F.when(p["snap"], "snapshot").otherwise("delta"), ts=p["ms"], data=data),
        "trades": obj(topic="publicTrade.BTCUSDT", data=F.array(obj(T=p["ms"], s="BTCUSDT", S=F.initcap(p["side"]), v=string("k"), p=string(price()), i=string(p["id"])))),
        "tickers": obj(topic="tickers.BTCUSDT", ts=p["ms"], cs=p["id"], data=obj(symbol="BTCUSDT", markPrice=F.when(p["even"], string(price())), openInterest=string("k"))),
    })


@P.add(f"""WITH {TICK} SELECT seq * 65536 AS event_id, ts // 1000 * 1000000 AS exchange_ts_ns, CAST(seq + 1 AS VARCHAR) AS trade_id, {PX} AS price, CAST(k + 1 AS DOUBLE) AS quantity, CASE WHEN k % 3 = 0 THEN 'sell' ELSE 'buy' END AS taker_side FROM tick WHERE k % 4 <> 0""")
def normalise_bitfinex_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Bare arrays: only messages of the first kind count, the sign of the amount is the side."""
    kind = F.when(F.pmod("k", lit(4)) == 0, '"tu"').otherwise('"te"')
    amount = F.when(F.pmod("k", lit(3)) == 0, -1).otherwise(1) * (1 + c("k"))
    raw = F.concat(lit("[17,"), kind, lit(",["), string(c("seq") + 1), lit(","), string(F.floor(c("ts") / 1000)), lit(","), string(amount), lit(","), string(price()), lit("]]"))
    rows = ticks(spark, sf).select((c("ts") * 1000).alias("local_ts_ns"), c("seq").alias("message_id"), raw.alias("raw"))
    return feeds.normalise(rows, "bitfinex_spot", "trades", "X").select("event_id", "exchange_ts_ns", "trade_id", "price", "quantity", "taker_side")
