"""Scalar expressions: vocabularies, quotes, ticks, time, rounding, executable profit."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of the venues' feeds.
BID_NAMES, ASK_NAMES = ("bid", "buy", "b"), ("ask", "offer", "sell", "a")
KINDS = {
    "book": ("depth", "orderbook", "books", "level2", "book", "l2book"),
    "l3": ("level3",),
    "trade": ("trades", "market_trades", "trade"),
    "context": ("markprice", "ticker", "tickers", "activeassetctx"),
    "liquidation": ("forceorder", "allliquidation"),
}
SPOT_ONLY, PERPETUAL_ONLY = ("coinbase", "kraken", "bitfinex"), ("bybit", "okx", "deribit", "hyperliquid")
VENUES = ("binance_spot", "binance_perpetual", "bybit_perpetual", "okx_perpetual", "coinbase_spot", "kraken_spot", "deribit_perpetual", "bitfinex_spot", "hyperliquid_perpetual")
#: File name prefix -> exchange, market, symbol.
FILES = {
    "binance_spot_btcusdt_": ("binance", "spot", "BTCUSDT"),
    "binance_um_futures_btcusdt_": ("binance", "um_futures", "BTCUSDT"),
    "bybit_linear_btcusdt_": ("bybit", "linear", "BTCUSDT"),
    "okx_swap_btc_usdt_swap_": ("okx", "swap", "BTC-USDT-SWAP"),
    "coinbase_spot_btc_usd_": ("coinbase", "spot", "BTC-USD"),
    "kraken_spot_btcusd_": ("kraken", "spot", "BTC/USD"),
    "deribit_perpetual_btc_perpetual_": ("deribit", "perpetual", "BTC-PERPETUAL"),
    "bitfinex_spot_tbtcusd_": ("bitfinex", "spot", "tBTCUSD"),
    "hyperliquid_perpetual_btc_": ("hyperliquid", "perpetual", "BTC"),
}


def side(value: Column) -> Column:
    """bid, ask or the empty text."""
    text = F.lower(F.coalesce(value, F.lit("")))
    return F.when(text.isin(*BID_NAMES), "bid").when(text.isin(*ASK_NAMES), "ask").otherwise("")


def stream_kind(channel: Column) -> Column:
    """The kind of a channel, null if it has none."""
    name, out = F.lower(channel), None
    for kind, names in KINDS.items():
        out = F.when(name.isin(*names), kind) if out is None else out.when(name.isin(*names), kind)
    return out


def venue(exchange: Column, market: Column) -> Column:
    """The venue of an exchange and market, null for exchanges that aren't known."""
    return (
        F.when(exchange == "binance", F.when(market == "spot", "binance_spot").otherwise("binance_perpetual"))
        .when(exchange.isin(*SPOT_ONLY), F.concat(exchange, F.lit("_spot")))
        .when(exchange.isin(*PERPETUAL_ONLY), F.concat(exchange, F.lit("_perpetual")))
    )


def market_kind(venue_: Column) -> Column:
    return F.when(venue_.endswith("_spot"), "spot").otherwise("derivative")


def stream_of_file(stem: Column) -> Column:
    """struct(exchange, market, symbol, channel) of a file name without its suffix, null if no prefix fits."""
    name, out = F.lower(stem), None
    for prefix, (exchange, market, symbol) in FILES.items():
        found = F.struct(F.lit(exchange).alias("exchange"), F.lit(market).alias("market"), F.lit(symbol).alias("symbol"), F.substr(name, F.lit(len(prefix) + 1)).alias("channel"))
        out = F.when(name.startswith(prefix), found) if out is None else out.when(name.startswith(prefix), found)
    return out


def clip(x: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """x within bounds, null if x is null (least and greatest alone would return a bound)."""
    out = x
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    return F.when(x.isNotNull(), out)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def quote_valid(bid: Column, ask: Column, strict: bool = False) -> Column:
    """Both finite and positive, and bid <= ask (strictly below where a book must not touch itself)."""
    order = bid < ask if strict else bid <= ask
    return F.coalesce((finite(bid) > 0) & (finite(ask) > 0) & order, F.lit(False))


def capacity(bid: Column, ask: Column, bid_qty: Column, ask_qty: Column, notional: float, stale_ms: Column, most_stale: float = 2000.0) -> Column:
    """Whether both sides of a fresh, uncrossed quote hold the quantity that a notional buys at the ask."""
    needed = F.lit(float(notional)) / F.greatest(ask, F.lit(1e-12))
    held = F.coalesce((bid_qty >= needed) & (ask_qty >= needed), F.lit(False))
    return quote_valid(bid, ask, strict=True) & held & F.coalesce(stale_ms <= most_stale, F.lit(False))


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) * 0.5


def microprice(bid: Column, ask: Column, bid_qty: Column, ask_qty: Column) -> Column:
    return F.try_divide(ask * bid_qty + bid * ask_qty, bid_qty + ask_qty)


def spread_ticks(bid: Column, ask: Column, tick: float) -> Column:
    return (ask - bid) / tick


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.try_divide((ask - bid) * 10_000.0, mid(bid, ask))


def imbalance(bid_qty: Column, ask_qty: Column) -> Column:
    return (bid_qty - ask_qty) / F.greatest(bid_qty + ask_qty, F.lit(1e-12))


def bucket(ts: Column, width: int) -> Column:
    """Start of the grid cell of a whole-number time."""
    return ts - F.pmod(ts, F.lit(width))


def ceil_grid(ts: Column, cadence: int) -> Column:
    return -bucket(-ts, cadence)


def cycle(ts: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of the place within a period."""
    angle = F.pmod(ts, F.lit(period)) * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def iso_to_ns(text: Column) -> Column:
    """Nanoseconds of an ISO time; digits beyond microseconds are cut."""
    return F.unix_micros(F.try_to_timestamp(text)) * 1000


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -30.0, 30.0)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def return_bps(entry: Column, exit_: Column, long: Column) -> Column:
    """Return of a position in basis points; a short's is entry / exit - 1."""
    return F.when(long, exit_ / entry - 1).otherwise(entry / exit_ - 1) * 10_000.0


def executable_pnl(entry_bid: Column, entry_ask: Column, exit_bid: Column, exit_ask: Column, tick: float, cost_ticks: float = 0.0) -> tuple[Column, Column]:
    """Ticks of a long (buy at ask, sell at bid) and of a short (sell at bid, buy at ask), after costs."""
    return (exit_bid - entry_ask) / tick - cost_ticks, (entry_bid - exit_ask) / tick - cost_ticks


def schedule(epoch: Column, warm_up: int, decay: int, high: float, low: float) -> Column:
    """high for the warm-up, then down to low in a straight line over the decay."""
    done = clip((epoch - warm_up) / float(max(decay, 1)), 0.0, 1.0)
    return F.lit(high) + (F.lit(low) - F.lit(high)) * done


def floored(hazard: Column, floor: float) -> Column:
    """A probability mixed with exploration: floor of the mass is spread evenly over two choices."""
    return (1 - floor) * hazard + floor * 0.5
