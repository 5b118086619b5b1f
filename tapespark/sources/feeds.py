"""Venue messages (JSON) to raw event records, as projections over a parsed variant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RECORD

Item = Callable[[Column, Column], Column]  # (message, item) -> value
#: Events of one message are numbered from message id times this.
EVENTS = 65_536


def text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def num(v: Column, path: str) -> Column:
    return text(v, path).try_cast("double")


def whole(v: Column, path: str) -> Column:
    return text(v, path).try_cast("bigint")


def ms(v: Column, path: str) -> Column:
    return whole(v, path) * 1_000_000


def iso(v: Column, *paths: str) -> Column:
    """Nanoseconds of the first ISO time that parses, to the microsecond."""
    return F.coalesce(*[F.unix_micros(F.try_to_timestamp(text(v, p))) * 1000 for p in paths])


def filled(*values: Column) -> Column:
    """The first value that is neither null, empty nor zero, else the empty text."""
    return F.coalesce(*[F.nullif(F.nullif(x, F.lit("")), F.lit("0")) for x in values], F.lit(""))


def some(v: Column, path: str) -> Column:
    """An array at the path, empty if there is none."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def sided(v: Column, bids: str, asks: str) -> Column:
    """Items of both sides with their side, bids first."""
    mark = lambda path, side: F.transform(some(v, path), lambda x: F.struct(F.lit(side).alias("side"), x.alias("x")))
    return F.concat(mark(bids, "bid"), mark(asks, "ask"))


def unsided(items: Column) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(None).cast("string").alias("side"), x.alias("x")))


@dataclass
class Feed:
    """One channel of a venue: which messages count, where their events and items are, and the columns of an item.

    events: the event variants of a message (each with its own event_id), items: the items of an event.
    fields get (event, item); message_fields get (message, event).
    """

    exchange: str
    market: str
    channel: str
    accepts: Callable[[Column], Column]
    items: Callable[[Column], Column]
    event_type: Callable[[Column, Column], Column]
    fields: dict[str, Item]
    message_fields: dict[str, Item] = field(default_factory=dict)
    events: Callable[[Column], Column] | None = None
    symbol: Item | None = None
    snapshot: bool = False


def one(v: Column) -> Column:
    return unsided(F.array(v))


def action(quantity: Column) -> Column:
    return F.when(quantity == 0, "delete").otherwise("set")


def level(price: str, quantity: str) -> dict[str, Item]:
    return {"price": lambda e, x: num(x, price), "quantity": lambda e, x: num(x, quantity), "action": lambda e, x: action(num(x, quantity))}


def body(v: Column) -> Column:
    """The data of a message, or the message itself."""
    return F.coalesce(F.try_variant_get(v, "$.data", "variant"), v)


def lit(value: str) -> Callable[[Column, Column], Column]:
    return lambda m, e: F.lit(value)


def kind(path: str, default: str) -> Callable[[Column, Column], Column]:
    return lambda m, e: F.coalesce(text(m, path), F.lit(default))


def _side_name(x: Column, path: str) -> Column:
    return F.nullif(F.lower(text(x, path)), F.lit(""))


def _binance(market: str) -> dict[str, Feed]:
    b = {"exchange": "binance", "market": market}
    own = lambda e, x: text(e, "$.s")
    whole_message = lambda v: F.array(body(v))
    times = {"exchange_ts_ns": lambda m, e: ms(e, "$.E"), "engine_ts_ns": lambda m, e: ms(e, "$.T")}
    return {
        "depth": Feed(**b, channel="depth", events=whole_message, accepts=lambda v: text(body(v), "$.e") == "depthUpdate", items=lambda e: sided(e, "$.b", "$.a"), event_type=lit("depth_update"), symbol=own,
                      fields=level("$[0]", "$[1]"), message_fields=times | {"sequence": lambda m, e: text(e, "$.u"), "sequence_start": lambda m, e: text(e, "$.U"), "prev_sequence": lambda m, e: text(e, "$.pu"), "is_snapshot": lambda m, e: F.lit(False)}),
        "snapshot": Feed(**b, channel="depth", accepts=lambda v: text(v, "$.lastUpdateId").isNotNull(), items=lambda e: sided(e, "$.bids", "$.asks"), event_type=lit("snapshot"),
                         fields=level("$[0]", "$[1]") | {"action": lambda e, x: F.lit("set")}, message_fields=times | {"sequence": lambda m, e: text(e, "$.lastUpdateId"), "is_snapshot": lambda m, e: F.lit(True)}),
        "trades": Feed(**b, channel="trades", events=whole_message, accepts=lambda v: text(body(v), "$.e") == "trade", items=one, event_type=lit("trade"), symbol=own,
                       fields={"sequence": lambda e, x: text(x, "$.t"), "trade_id": lambda e, x: text(x, "$.t"), "price": lambda e, x: num(x, "$.p"), "quantity": lambda e, x: num(x, "$.q"), "taker_side": lambda e, x: F.when(F.coalesce(text(x, "$.m"), F.lit("false")) == "true", "sell").otherwise("buy")}, message_fields=times),
        "markPrice": Feed(**b, channel="markPrice", events=whole_message, items=one, event_type=lit("derivative_context"), symbol=own,
                          accepts=lambda v: (F.coalesce(text(body(v), "$.e"), F.lit("markPriceUpdate")) == "markPriceUpdate") & F.coalesce(text(body(v), "$.p"), text(body(v), "$.markPrice")).isNotNull() & F.coalesce(text(body(v), "$.i"), text(body(v), "$.indexPrice")).isNotNull(),
                          fields={"sequence": lambda e, x: F.coalesce(text(x, "$.E"), text(x, "$.time")), "mark_price": lambda e, x: F.coalesce(num(x, "$.p"), num(x, "$.markPrice")), "index_price": lambda e, x: F.coalesce(num(x, "$.i"), num(x, "$.indexPrice")), "funding_rate": lambda e, x: F.coalesce(num(x, "$.r"), num(x, "$.lastFundingRate")), "next_funding_ts_ns": lambda e, x: F.coalesce(ms(x, "$.T"), ms(x, "$.nextFundingTime"))},
                          message_fields={k: (lambda m, e: F.coalesce(ms(e, "$.E"), ms(e, "$.time"))) for k in ("exchange_ts_ns", "engine_ts_ns")}),
        "forceOrder": Feed(**b, channel="forceOrder", events=whole_message, accepts=lambda v: (text(body(v), "$.e") == "forceOrder") & F.try_variant_get(body(v), "$.o", "variant").isNotNull(), items=lambda e: one(F.try_variant_get(e, "$.o", "variant")), event_type=lit("liquidation"), symbol=lambda e, x: text(e, "$.o.s"),
                           fields={"sequence": lambda e, x: text(x, "$.T"), "engine_ts_ns": lambda e, x: ms(x, "$.T"), "price": lambda e, x: F.when(num(x, "$.ap") > 0, num(x, "$.ap")).otherwise(F.coalesce(num(x, "$.p"), F.lit(0.0))), "quantity": lambda e, x: F.when(num(x, "$.z") > 0, num(x, "$.z")).otherwise(F.coalesce(num(x, "$.q"), F.lit(0.0))),
                                   "taker_side": lambda e, x: _side_name(x, "$.S"), "liquidation_side": lambda e, x: F.when(F.upper(text(x, "$.S")) == "SELL", "long").when(F.upper(text(x, "$.S")) == "BUY", "short")}, message_fields={"exchange_ts_ns": lambda m, e: ms(e, "$.E")}),
    }


def _bybit() -> dict[str, Feed]:
    b = {"exchange": "bybit", "market": "linear"}
    at = lambda path: {k: (lambda e, x: ms(x, path)) for k in ("exchange_ts_ns", "engine_ts_ns")}
    topic = lambda start: lambda v: text(v, "$.topic").startswith(start)
    flip = lambda x, a, c: F.when(F.upper(text(x, "$.S")) == "BUY", a).when(F.upper(text(x, "$.S")) == "SELL", c)
    return {
        "orderbook": Feed(**b, channel="orderbook", accepts=topic("orderbook."), items=lambda e: sided(e, "$.data.b", "$.data.a"), event_type=kind("$.type", "delta"), fields=level("$[0]", "$[1]"),
                          message_fields={"exchange_ts_ns": lambda m, e: ms(m, "$.ts"), "engine_ts_ns": lambda m, e: ms(m, "$.data.cts"), "sequence": lambda m, e: filled(text(m, "$.data.u"), text(m, "$.data.seq")), "prev_sequence": lambda m, e: filled(text(m, "$.data.seq")), "is_snapshot": lambda m, e: F.coalesce(text(m, "$.type") == "snapshot", F.lit(False))}),
        "trades": Feed(**b, channel="trades", accepts=topic("publicTrade."), events=lambda v: some(v, "$.data"), items=one, event_type=lit("trade"),
                       fields=at("$.T") | {"sequence": lambda e, x: filled(text(x, "$.i")), "trade_id": lambda e, x: filled(text(x, "$.i")), "price": lambda e, x: num(x, "$.p"), "quantity": lambda e, x: num(x, "$.v"), "taker_side": lambda e, x: F.lower(F.coalesce(text(x, "$.S"), F.lit("")))}),
        "tickers": Feed(**b, channel="tickers", accepts=topic("tickers."), items=one, event_type=lit("derivative_context"), symbol=lambda e, x: text(e, "$.data.symbol"),
                        fields=at("$.ts") | {"sequence": lambda e, x: text(x, "$.cs"), "mark_price": lambda e, x: num(x, "$.data.markPrice"), "index_price": lambda e, x: num(x, "$.data.indexPrice"), "open_interest": lambda e, x: num(x, "$.data.openInterest"), "funding_rate": lambda e, x: num(x, "$.data.fundingRate"), "next_funding_ts_ns": lambda e, x: ms(x, "$.data.nextFundingTime")}),
        "allLiquidation": Feed(**b, channel="allLiquidation", accepts=topic("allLiquidation."), items=lambda e: unsided(some(e, "$.data")), event_type=lit("liquidation"), symbol=lambda e, x: text(x, "$.s"),
                               fields={"engine_ts_ns": lambda e, x: ms(x, "$.T"), "sequence": lambda e, x: text(x, "$.T"), "price": lambda e, x: num(x, "$.p"), "quantity": lambda e, x: num(x, "$.v"), "taker_side": lambda e, x: flip(x, "sell", "buy"), "liquidation_side": lambda e, x: flip(x, "long", "short")}, message_fields={"exchange_ts_ns": lambda m, e: ms(m, "$.ts")}),
    }


def _okx() -> dict[str, Feed]:
    b = {"exchange": "okx", "market": "swap"}
    at = {k: (lambda e, x: ms(e, "$.ts")) for k in ("exchange_ts_ns", "engine_ts_ns")}
    listens = lambda name: lambda v: text(v, "$.event").isNull() & (text(v, "$.arg.channel") == name)
    return {
        "books": Feed(**b, channel="books", accepts=listens("books"), events=lambda v: some(v, "$.data"), items=lambda e: sided(e, "$.bids", "$.asks"), event_type=kind("$.action", "update"),
                      fields=at | level("$[0]", "$[1]") | {"order_count": lambda e, x: num(x, "$[3]"), "sequence": lambda e, x: filled(text(e, "$.seqId"), text(e, "$.checksum")), "sequence_start": lambda e, x: filled(text(e, "$.prevSeqId")), "prev_sequence": lambda e, x: filled(text(e, "$.prevSeqId"))},
                      message_fields={"is_snapshot": lambda m, e: F.coalesce(text(m, "$.action") == "snapshot", F.lit(False))}),
        "trades": Feed(**b, channel="trades", accepts=listens("trades"), events=lambda v: some(v, "$.data"), items=one, event_type=lit("trade"),
                       fields=at | {"sequence": lambda e, x: filled(text(x, "$.tradeId")), "trade_id": lambda e, x: filled(text(x, "$.tradeId")), "price": lambda e, x: num(x, "$.px"), "quantity": lambda e, x: num(x, "$.sz"), "taker_side": lambda e, x: text(x, "$.side")}),
    }


def _coinbase() -> dict[str, Feed]:
    b = {"exchange": "coinbase", "market": "spot"}
    both = lambda p: {"exchange_ts_ns": lambda m, e: iso(m, "$.timestamp"), "sequence": lambda m, e: filled(text(m, "$.sequence_num"))} | p
    return {
        "level2": Feed(**b, channel="level2", accepts=lambda v: text(v, "$.channel").isin("l2_data", "level2"), events=lambda v: some(v, "$.events"), items=lambda e: unsided(some(e, "$.updates")), event_type=lambda m, e: F.coalesce(text(e, "$.type"), F.lit("update")), symbol=lambda e, x: text(x, "$.product_id"),
                       fields={"exchange_ts_ns": lambda e, x: iso(x, "$.event_time"), "engine_ts_ns": lambda e, x: iso(x, "$.event_time"), "side": lambda e, x: text(x, "$.side"), "is_snapshot": lambda e, x: F.coalesce(text(e, "$.type") == "snapshot", F.lit(False)), "price": lambda e, x: num(x, "$.price_level"), "quantity": lambda e, x: F.coalesce(num(x, "$.new_quantity"), F.lit(0.0)), "action": lambda e, x: action(F.coalesce(num(x, "$.new_quantity"), F.lit(0.0)))}, message_fields=both({})),
        "market_trades": Feed(**b, channel="market_trades", accepts=lambda v: text(v, "$.channel") == "market_trades", events=lambda v: some(v, "$.events"), items=lambda e: unsided(some(e, "$.trades")), event_type=lambda m, e: F.coalesce(text(e, "$.type"), F.lit("update")), symbol=lambda e, x: text(x, "$.product_id"),
                              fields={"exchange_ts_ns": lambda e, x: iso(x, "$.time"), "engine_ts_ns": lambda e, x: iso(x, "$.time"), "trade_id": lambda e, x: filled(text(x, "$.trade_id")), "price": lambda e, x: num(x, "$.price"), "quantity": lambda e, x: num(x, "$.size"), "side": lambda e, x: F.lower(F.coalesce(text(x, "$.side"), F.lit("")))}, message_fields=both({})),
    }


def _kraken() -> dict[str, Feed]:
    b = {"exchange": "kraken", "market": "spot"}
    listens = lambda name: lambda v: text(v, "$.method").isNull() & (text(v, "$.channel") == name)
    snap = {"is_snapshot": lambda m, e: F.coalesce(text(m, "$.type") == "snapshot", F.lit(False))}
    at = lambda *paths: {k: (lambda e, x: F.coalesce(*[iso(x if p[0] == "x" else e, "$.timestamp") for p in paths])) for k in ("exchange_ts_ns", "engine_ts_ns")}
    qty = lambda x: F.coalesce(num(x, "$.qty"), num(x, "$.quantity"), F.lit(0.0))
    own = lambda e, x: text(e, "$.symbol")
    return {
        "book": Feed(**b, channel="book", accepts=listens("book"), events=lambda v: some(v, "$.data"), items=lambda e: sided(e, "$.bids", "$.asks"), event_type=kind("$.type", "update"), symbol=own, message_fields=snap,
                     fields=at("x", "e") | {"sequence": lambda e, x: filled(text(e, "$.checksum")), "price": lambda e, x: F.coalesce(num(x, "$.price"), F.lit(0.0)), "quantity": lambda e, x: qty(x), "action": lambda e, x: action(qty(x))}),
        "trade": Feed(**b, channel="trade", accepts=listens("trade"), events=lambda v: some(v, "$.data"), items=one, event_type=lit("trade"), symbol=own,
                      fields=at("e") | {"sequence": lambda e, x: filled(text(x, "$.trade_id")), "trade_id": lambda e, x: filled(text(x, "$.trade_id")), "price": lambda e, x: num(x, "$.price"), "quantity": lambda e, x: num(x, "$.qty"), "taker_side": lambda e, x: text(x, "$.side")}),
        "level3": Feed(**b, channel="level3", accepts=lambda v: listens("level3")(v) & text(v, "$.success").isNull() & text(v, "$.error").isNull(), event_type=kind("$.type", "update"), message_fields=snap,
                       items=lambda m: F.flatten(F.transform(some(m, "$.data"), lambda d: F.transform(sided(d, "$.bids", "$.asks"), lambda o: F.struct(o["side"].alias("side"), o["x"].alias("x"), d.alias("d"))))),
                       fields={}),
    }


def _deribit() -> dict[str, Feed]:
    b = {"exchange": "deribit", "market": "perpetual"}
    listens = lambda start: lambda v: (text(v, "$.method") == "subscription") & text(v, "$.params.channel").startswith(start)
    data = lambda v: F.array(F.try_variant_get(v, "$.params.data", "variant"))
    at = {k: (lambda e, x: ms(x, "$.timestamp")) for k in ("exchange_ts_ns", "engine_ts_ns")}
    gone = lambda x: (text(x, "$[0]") == "delete") | (num(x, "$[2]") == 0)
    return {
        "book": Feed(**b, channel="book", accepts=listens("book."), events=data, items=lambda e: sided(e, "$.bids", "$.asks"), event_type=lambda m, e: F.coalesce(text(e, "$.type"), F.lit("change")), symbol=lambda e, x: text(e, "$.instrument_name"),
                     fields={"exchange_ts_ns": lambda e, x: ms(e, "$.timestamp"), "engine_ts_ns": lambda e, x: ms(e, "$.timestamp"), "sequence": lambda e, x: text(e, "$.change_id"), "prev_sequence": lambda e, x: text(e, "$.prev_change_id"), "is_snapshot": lambda e, x: F.coalesce(text(e, "$.type") == "snapshot", F.lit(False)),
                             "price": lambda e, x: num(x, "$[1]"), "quantity": lambda e, x: F.when(gone(x), 0.0).otherwise(num(x, "$[2]")), "action": lambda e, x: F.when(gone(x), "delete").otherwise("set")}),
        "trades": Feed(**b, channel="trades", accepts=listens("trades."), items=lambda m: unsided(some(m, "$.params.data")), event_type=lit("trade"), symbol=lambda e, x: text(x, "$.instrument_name"),
                       fields=at | {"sequence": lambda e, x: text(x, "$.trade_id"), "trade_id": lambda e, x: text(x, "$.trade_id"), "price": lambda e, x: num(x, "$.price"), "quantity": lambda e, x: num(x, "$.amount"), "taker_side": lambda e, x: _side_name(x, "$.direction")}),
        "ticker": Feed(**b, channel="ticker", accepts=listens("ticker."), events=data, items=one, event_type=lit("derivative_context"), symbol=lambda e, x: text(e, "$.instrument_name"),
                       fields=at | {"sequence": lambda e, x: text(x, "$.timestamp"), "mark_price": lambda e, x: num(x, "$.mark_price"), "index_price": lambda e, x: num(x, "$.index_price"), "open_interest": lambda e, x: num(x, "$.open_interest"), "funding_rate": lambda e, x: num(x, "$.current_funding")}),
    }


def _bitfinex() -> dict[str, Feed]:
    b = {"exchange": "bitfinex", "market": "spot"}
    many = lambda v: F.try_variant_get(v, "$[1][0][0]", "variant").isNotNull()
    listed = lambda v: F.try_variant_get(v, "$[1][0]", "variant").isNotNull()
    gone = lambda x: whole(x, "$[1]") == 0
    at = {k: (lambda e, x: ms(x, "$[1]")) for k in ("exchange_ts_ns", "engine_ts_ns")}
    return {
        "book": Feed(**b, channel="book", accepts=listed, items=lambda m: unsided(F.filter(F.when(many(m), some(m, "$[1]")).otherwise(F.array(F.try_variant_get(m, "$[1]", "variant"))), lambda x: F.try_variant_get(x, "$[2]", "variant").isNotNull())), event_type=lambda m, e: F.when(many(m), "snapshot").otherwise("update"),
                     fields={"side": lambda e, x: F.when(num(x, "$[2]") > 0, "bid").otherwise("ask"), "price": lambda e, x: num(x, "$[0]"), "quantity": lambda e, x: F.when(gone(x), 0.0).otherwise(F.abs(num(x, "$[2]"))), "action": lambda e, x: F.when(gone(x), "delete").otherwise("set"), "order_count": lambda e, x: whole(x, "$[1]").cast("double")}, message_fields={"is_snapshot": lambda m, e: many(m)}),
        "trades": Feed(**b, channel="trades", accepts=lambda v: (text(v, "$[1]") == "te") & F.try_variant_get(v, "$[2][3]", "variant").isNotNull(), items=lambda m: one(F.try_variant_get(m, "$[2]", "variant")), event_type=lit("trade"),
                       fields=at | {"sequence": lambda e, x: text(x, "$[0]"), "trade_id": lambda e, x: text(x, "$[0]"), "price": lambda e, x: num(x, "$[3]"), "quantity": lambda e, x: F.abs(num(x, "$[2]")), "taker_side": lambda e, x: F.when(num(x, "$[2]") > 0, "buy").otherwise("sell")}),
    }


def _hyperliquid() -> dict[str, Feed]:
    b = {"exchange": "hyperliquid", "market": "perpetual"}
    listens = lambda name: lambda v: text(v, "$.channel") == name
    when = {k: (lambda e, x: ms(x, "$.time")) for k in ("exchange_ts_ns", "engine_ts_ns")}
    return {
        "l2Book": Feed(**b, channel="l2Book", accepts=listens("l2Book"), items=lambda m: sided(m, "$.data.levels[0]", "$.data.levels[1]"), event_type=lit("snapshot"), symbol=lambda e, x: text(e, "$.data.coin"),
                       fields=level("$.px", "$.sz") | {"action": lambda e, x: F.lit("set"), "order_count": lambda e, x: num(x, "$.n")}, message_fields={"exchange_ts_ns": lambda m, e: ms(m, "$.data.time"), "engine_ts_ns": lambda m, e: ms(m, "$.data.time"), "sequence": lambda m, e: text(m, "$.data.time"), "is_snapshot": lambda m, e: F.lit(True)}),
        "trades": Feed(**b, channel="trades", accepts=listens("trades"), items=lambda m: unsided(some(m, "$.data")), event_type=lit("trade"), symbol=lambda e, x: text(x, "$.coin"),
                       fields=when | {"sequence": lambda e, x: text(x, "$.tid"), "price": lambda e, x: num(x, "$.px"), "quantity": lambda e, x: num(x, "$.sz"), "taker_side": lambda e, x: F.when(F.upper(text(x, "$.side")) == "B", "buy").when(F.upper(text(x, "$.side")) == "A", "sell"),
                                      "trade_id": lambda e, x: F.concat_ws(":", F.coalesce(text(x, "$.time"), F.lit("None")), text(x, "$.coin"), F.coalesce(text(x, "$.tid"), F.lit("None")))}),
        "activeAssetCtx": Feed(**b, channel="activeAssetCtx", accepts=listens("activeAssetCtx"), items=one, event_type=lit("derivative_context"), symbol=lambda e, x: text(e, "$.data.coin"),
                               fields={"mark_price": lambda e, x: num(x, "$.data.ctx.markPx"), "oracle_price": lambda e, x: num(x, "$.data.ctx.oraclePx"), "open_interest": lambda e, x: num(x, "$.data.ctx.openInterest"), "funding_rate": lambda e, x: num(x, "$.data.ctx.funding")}),
    }


FEEDS = {
    **{("binance_spot", k): f for k, f in _binance("spot").items() if k not in ("markPrice", "forceOrder")},
    **{("binance_perpetual", k): f for k, f in _binance("um_futures").items()},
    **{(v, k): f for v, make in (("bybit_perpetual", _bybit), ("okx_perpetual", _okx), ("coinbase_spot", _coinbase), ("kraken_spot", _kraken), ("deribit_perpetual", _deribit), ("bitfinex_spot", _bitfinex), ("hyperliquid_perpetual", _hyperliquid)) for k, f in make().items()},
}


def normalise(messages: DataFrame, venue: str, channel: str, symbol: str, keep_raw: bool = False) -> DataFrame:
    """Records of one channel from messages (raw JSON text, local_ts_ns, message_id).

    Messages that aren't JSON or not of the channel give no rows, values that don't parse are null. row_idx
    counts the items of an event, bids first; the raw message is kept on the first row of an event if asked.
    """
    feed = FEEDS[venue, channel]
    # Exploded, so that the filters below don't parse the message again.
    rows = messages.select("local_ts_ns", "message_id", "raw", F.explode(F.array(F.try_parse_json("raw"))).alias("_m")).where(F.col("_m").isNotNull())
    rows = rows.where(F.coalesce(feed.accepts(F.col("_m")), F.lit(False)))
    rows = rows.withColumn("_events", feed.events(F.col("_m")) if feed.events else F.array("_m"))
    rows = rows.select("local_ts_ns", "message_id", "raw", "_m", F.posexplode("_events").alias("_place", "_e"))
    rows = rows.select("*", F.posexplode(feed.items(F.col("_e"))).alias("row_idx", "_item"))
    m, e, x = F.col("_m"), F.col("_e"), F.col("_item.x")
    cols: dict[str, Column] = {k: f(m, e) for k, f in feed.message_fields.items()}
    for k, f in feed.fields.items():
        value = f(e, x)
        cols[k] = F.coalesce(value, cols[k]) if k in cols and k.endswith("_ts_ns") else value
    if venue == "kraken_spot" and channel == "level3":
        d = F.col("_item.d")
        when = iso(d, "$.timestamp")
        cols |= {"exchange_ts_ns": when, "engine_ts_ns": when, "sequence": filled(text(d, "$.checksum")), "checksum": whole(d, "$.checksum"), "price": num(x, "$.limit_price"), "quantity": num(x, "$.order_qty"), "order_id": text(x, "$.order_id"), "symbol": text(d, "$.symbol"), "action": F.coalesce(text(x, "$.event"), F.when(text(m, "$.type") == "snapshot", "set"))}
    own = cols.pop("symbol", None)
    own = own if own is not None else feed.symbol(e, x) if feed.symbol else F.lit(None)
    cols |= {
        "exchange": F.lit(feed.exchange),
        "market": F.lit(feed.market),
        "symbol": F.coalesce(F.nullif(own.cast("string"), F.lit("")), F.lit(symbol)),
        "channel": F.lit(feed.channel),
        "event_type": feed.event_type(m, e),
        "event_id": F.col("message_id") * EVENTS + F.col("_place"),
        "row_idx": F.col("row_idx"),
        "local_ts_ns": F.col("local_ts_ns"),
        "side": F.coalesce(cols["side"], F.col("_item.side")) if "side" in cols else F.col("_item.side"),
        "raw_message": F.when((F.col("row_idx") == 0) & F.lit(keep_raw), F.col("raw")),
    }
    return rows.select(*[cols.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in (c.strip().split() for c in RECORD.split(","))])


def bridged(updates: DataFrame, keys: list[str], spot: bool, snapshot_id: str = "snapshot_id") -> DataFrame:
    """Adds state to depth diffs (first, last, previous per message) after a snapshot: stale, first, next or gap.

    Diffs that end before the snapshot are stale. The first diff must hold the snapshot's id (the one after it
    on spot); then each must follow the one before: previous equal to its last, on spot first not beyond
    last + 1.
    """
    from pyspark.sql import Window

    target = F.col(snapshot_id) + (1 if spot else 0)
    live = F.col("last") >= target
    w = Window.partitionBy(*keys).orderBy("local_ts_ns")
    rows = updates.withColumn("_live", live)
    before = F.lag(F.when(F.col("_live"), F.col("last"))).over(w)
    follows = (F.col("first") <= before + 1) if spot else (F.col("previous") == before)
    return rows.withColumn("state", F.when(~F.col("_live"), "stale").when(before.isNull(), F.when((F.col("first") <= target), "first").otherwise("gap")).when(F.coalesce(follows, F.lit(False)), "next").otherwise("gap")).drop("_live")
