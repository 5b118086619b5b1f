"""Venue messages, the record log, archives, compaction and streams that go on."""

import io
import json
import os
import zipfile

import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from tapespark.operators import frames as R
from tapespark.schema import COLUMNS
from tapespark.sources import feeds, files, recordlog
from tapespark.streaming import streams

CASES = {
    ("binance_perpetual", "depth"): ({"data": {"e": "depthUpdate", "E": 1, "T": 2, "s": "BTCUSDT", "U": 5, "u": 7, "pu": 4, "b": [["10.5", "0"]], "a": [["11", "2"], ["12", "1"]]}}, 3, {"price": 10.5, "action": "delete", "side": "bid", "sequence": "7", "sequence_start": "5", "prev_sequence": "4", "exchange_ts_ns": 1_000_000, "engine_ts_ns": 2_000_000, "is_snapshot": False}),
    ("binance_spot", "snapshot"): ({"lastUpdateId": 9, "bids": [["1", "0"]], "asks": [["2", "3"]]}, 2, {"action": "set", "sequence": "9", "is_snapshot": True, "event_type": "snapshot"}),
    ("binance_spot", "trades"): ({"e": "trade", "E": 1, "s": "BTCUSDT", "t": 12, "p": "3.5", "q": "2", "m": True}, 1, {"taker_side": "sell", "trade_id": "12", "price": 3.5}),
    ("binance_perpetual", "markPrice"): ({"symbol": "x", "markPrice": "5", "indexPrice": "6", "lastFundingRate": "0.01", "nextFundingTime": 3, "time": 2}, 1, {"mark_price": 5.0, "index_price": 6.0, "funding_rate": 0.01, "next_funding_ts_ns": 3_000_000, "sequence": "2"}),
    ("binance_perpetual", "forceOrder"): ({"e": "forceOrder", "E": 1, "o": {"s": "BTCUSDT", "S": "SELL", "q": "3", "p": "10", "ap": "0", "z": "0", "T": 4}}, 1, {"price": 10.0, "quantity": 3.0, "taker_side": "sell", "liquidation_side": "long", "sequence": "4", "engine_ts_ns": 4_000_000}),
    ("bybit_perpetual", "orderbook"): ({"topic": "orderbook.1000.BTCUSDT", "type": "snapshot", "ts": 1, "data": {"u": 3, "seq": 8, "cts": 2, "b": [["1", "2"]], "a": []}}, 1, {"sequence": "3", "prev_sequence": "8", "is_snapshot": True, "engine_ts_ns": 2_000_000}),
    ("bybit_perpetual", "trades"): ({"topic": "publicTrade.BTCUSDT", "data": [{"T": 1, "S": "Buy", "v": "2", "p": "3", "i": "z"}, {"T": 2, "S": "Sell", "v": "2", "p": "3", "i": "y"}]}, 2, {"taker_side": "buy", "trade_id": "z"}),
    ("bybit_perpetual", "tickers"): ({"topic": "tickers.BTCUSDT", "ts": 1, "cs": 7, "data": {"symbol": "BTCUSDT", "openInterest": "4"}}, 1, {"open_interest": 4.0, "mark_price": None, "sequence": "7"}),
    ("bybit_perpetual", "allLiquidation"): ({"topic": "allLiquidation.BTCUSDT", "ts": 5, "data": [{"T": 4, "s": "BTCUSDT", "S": "Buy", "v": "1", "p": "2"}]}, 1, {"liquidation_side": "long", "taker_side": "sell", "exchange_ts_ns": 5_000_000}),
    ("okx_perpetual", "books"): ({"arg": {"channel": "books"}, "action": "update", "data": [{"ts": "3", "seqId": 6, "prevSeqId": 5, "bids": [["1", "0", "0", "4"]], "asks": []}]}, 1, {"action": "delete", "order_count": 4.0, "sequence": "6", "prev_sequence": "5", "event_type": "update"}),
    ("okx_perpetual", "trades"): ({"arg": {"channel": "trades"}, "data": [{"tradeId": "8", "px": "1", "sz": "2", "side": "buy", "ts": "3"}]}, 1, {"taker_side": "buy", "exchange_ts_ns": 3_000_000}),
    ("coinbase_spot", "level2"): ({"channel": "l2_data", "timestamp": "2024-01-01T00:00:01Z", "sequence_num": 3, "events": [{"type": "snapshot", "updates": [{"side": "offer", "event_time": "1970-01-01T00:00:02.000001Z", "price_level": "5", "new_quantity": "0"}]}]}, 1, {"side": "offer", "action": "delete", "exchange_ts_ns": 2_000_001_000, "is_snapshot": True, "event_type": "snapshot"}),
    ("coinbase_spot", "market_trades"): ({"channel": "market_trades", "events": [{"type": "update", "trades": [{"trade_id": "4", "price": "1", "size": "2", "side": "BUY", "time": "1970-01-01T00:00:01Z"}]}]}, 1, {"side": "buy", "taker_side": None, "exchange_ts_ns": 1_000_000_000}),
    ("kraken_spot", "book"): ({"channel": "book", "type": "update", "data": [{"symbol": "BTC/USD", "checksum": 55, "timestamp": "1970-01-01T00:00:01Z", "bids": [{"price": 1.5, "qty": 0}], "asks": []}]}, 1, {"price": 1.5, "action": "delete", "sequence": "55", "symbol": "BTC/USD"}),
    ("kraken_spot", "trade"): ({"channel": "trade", "data": [{"symbol": "BTC/USD", "trade_id": 4, "price": 1.0, "qty": 2.0, "side": "sell", "timestamp": "1970-01-01T00:00:01Z"}]}, 1, {"taker_side": "sell", "trade_id": "4"}),
    ("kraken_spot", "level3"): ({"channel": "level3", "type": "snapshot", "data": [{"symbol": "BTC/USD", "checksum": 9, "bids": [{"order_id": "A", "limit_price": 1.0, "order_qty": 2.0}], "asks": [{"event": "delete", "order_id": "B"}]}]}, 2, {"action": "set", "order_id": "A", "checksum": 9, "is_snapshot": True}),
    ("deribit_perpetual", "book"): ({"method": "subscription", "params": {"channel": "book.BTC.100ms", "data": {"type": "change", "timestamp": 1, "instrument_name": "BTC-PERPETUAL", "change_id": 6, "prev_change_id": 5, "bids": [["delete", 10.0, 3.0]], "asks": [["new", 11.0, 2.0]]}}}, 2, {"quantity": 0.0, "action": "delete", "sequence": "6", "prev_sequence": "5"}),
    ("deribit_perpetual", "trades"): ({"method": "subscription", "params": {"channel": "trades.BTC.100ms", "data": [{"trade_id": "1", "price": 2.0, "amount": 3.0, "direction": "buy", "timestamp": 1}, {"trade_id": "2", "price": 2.0, "amount": 3.0, "direction": "sell", "timestamp": 1}]}}, 2, {"taker_side": "buy", "trade_id": "1"}),
    ("deribit_perpetual", "ticker"): ({"method": "subscription", "params": {"channel": "ticker.BTC", "data": {"timestamp": 4, "mark_price": 1.0, "index_price": 2.0, "open_interest": 3.0, "current_funding": 0.1}}}, 1, {"mark_price": 1.0, "funding_rate": 0.1, "sequence": "4"}),
    ("bitfinex_spot", "book"): ([17, [[10.0, 2, 1.5], [11.0, 1, -0.5]]], 2, {"side": "bid", "quantity": 1.5, "order_count": 2.0, "is_snapshot": True}),
    ("bitfinex_spot", "trades"): ([17, "te", [5, 1, -2.0, 10.0]], 1, {"taker_side": "sell", "quantity": 2.0, "trade_id": "5"}),
    ("hyperliquid_perpetual", "l2Book"): ({"channel": "l2Book", "data": {"coin": "BTC", "time": 2, "levels": [[{"px": "1", "sz": "2", "n": 3}], [{"px": "2", "sz": "1", "n": 1}]]}}, 2, {"order_count": 3.0, "is_snapshot": True, "sequence": "2", "symbol": "BTC"}),
    ("hyperliquid_perpetual", "trades"): ({"channel": "trades", "data": [{"coin": "BTC", "side": "A", "px": "1", "sz": "2", "time": 3, "tid": 4}]}, 1, {"taker_side": "sell", "trade_id": "3:BTC:4"}),
    ("hyperliquid_perpetual", "activeAssetCtx"): ({"channel": "activeAssetCtx", "data": {"coin": "BTC", "ctx": {"markPx": "1", "oraclePx": "2", "openInterest": "3", "funding": "0.1"}}}, 1, {"oracle_price": 2.0, "open_interest": 3.0, "exchange_ts_ns": None}),
}


@pytest.mark.parametrize("venue,channel", CASES)
def test_feeds(spark, venue, channel):
    message, n, want = CASES[venue, channel]
    raw = [json.dumps(message), "not json", json.dumps({"channel": "other"}), json.dumps([1, "hb"]), None]
    rows = spark.createDataFrame([(9, i, r) for i, r in enumerate(raw)], "local_ts_ns long, message_id long, raw string")
    got = feeds.normalise(rows, venue, channel, "SYM", keep_raw=True).collect()
    assert len(got) == n and got[0].__fields__ == list(COLUMNS)
    first = got[0].asDict()
    assert {k: first[k] for k in want} == want
    assert first["local_ts_ns"] == 9 and first["raw_message"] == raw[0] and first["symbol"]
    assert len({(r.event_id, r.row_idx) for r in got}) == n


def test_every_feed_has_a_case():
    kind = lambda keys: {(venue.split("_")[0], channel) for venue, channel in keys}
    assert kind(feeds.FEEDS) == kind(CASES)


def records(n, start=0):
    rows = {name: pa.nulls(n, kind) for name, kind in ((f.name, f.type) for f in recordlog.SCHEMA)}
    rows |= {"event_id": pa.array(range(start, start + n), pa.int64()), "local_ts_ns": pa.array(range(start, start + n), pa.int64()), "exchange": pa.array(["x"] * n)}
    return pa.table(rows, schema=recordlog.SCHEMA)


def test_record_log_survives_a_cut_tail(tmp_path):
    path = str(tmp_path / "a.mrec")
    recordlog.append(path, records(3))
    whole = os.path.getsize(path)
    recordlog.append(path, records(2, 3))
    assert recordlog.check(path, payloads=True) == (2, 5, 0)
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 5)
    with pytest.raises(recordlog.Damaged, match="cut off"):
        recordlog.check(path)
    assert recordlog.copy_committed(path, str(tmp_path / "copy.mrec")) == (1, 3)
    frames, rows, lost = recordlog.check(path, repair=True)
    assert (frames, rows) == (1, 3) and lost > 0 and os.path.getsize(path) == whole
    recordlog.append(path, records(1, 9))
    assert recordlog.check(path, payloads=True) == (2, 4, 0)
    with open(path, "r+b") as f:
        f.seek(60)
        f.write(b"\xff\xff\xff")
    with pytest.raises(recordlog.Damaged, match="checksum"):
        recordlog.check(path, payloads=True)


def test_record_log_as_source_sink_and_stream(spark, tmp_path):
    spark.dataSource.register(recordlog.RecordLog)
    path = str(tmp_path / "log")
    spark.createDataFrame(records(50).to_pandas().astype(object).where(lambda d: d.notna(), None), recordlog.RECORD).repartition(3).write.format("recordlog").mode("append").save(path)
    assert not [f for f in os.listdir(path) if f.endswith(".part")]
    rows = spark.read.format("recordlog").load(path)
    assert sorted(r.event_id for r in rows.collect()) == list(range(50))
    assert recordlog.after(rows, 39).count() == 10
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    live = lambda: spark.readStream.format("recordlog").load(path).select("event_id")
    assert streams.run(live(), out, state).count() == 50
    recordlog.append(os.path.join(path, "more.mrec"), records(5, 100))
    assert streams.run(live(), out, state).count() == 55  # only the new frames are read


def test_record_log_prunes_columns_and_times(spark, tmp_path, monkeypatch):
    spark.dataSource.register(recordlog.RecordLog)
    path = str(tmp_path / "x.mrec")
    for k in range(6):
        recordlog.append(path, records(10, 10 * k))
    rows = spark.read.format("recordlog").option("columns", "local_ts_ns, event_id").load(path)
    assert rows.columns == ["local_ts_ns", "event_id"] and sorted(r.event_id for r in rows.collect()) == list(range(60))
    late = spark.read.format("recordlog").option("columns", "event_id").option("after", 34).load(path)
    assert sorted(r.event_id for r in late.collect()) == list(range(30, 60))  # frames that end before are left out
    with pytest.raises(Exception, match="no such"):
        spark.read.format("recordlog").option("columns", "such").load(path).collect()
    found = recordlog.frames(path)[0]
    for size in (1, 100, found[0].size, 10**9):  # however a file is cut, each frame is read once
        monkeypatch.setattr(recordlog, "STRETCH", size)
        parts = recordlog._Reader(path, ["event_id"], None).partitions()
        assert [f for p in parts for f in recordlog.stretch_frames(p)] == found
    assert recordlog.bounds([path]) == [(path, 60, 0, 59)]


def test_bounds_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).selectExpr("id + 5 AS id", "cast(null as long) AS none").repartition(3).write.parquet(path)
    assert files.statistics_bounds(spark, path, "id") == (5, 1004) and files.statistics_bounds(spark, path, "none") == (None, None)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_contracts(spark):
    rows = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y")], "a long, b double, c string")
    assert files.contract(rows, "a bigint, c string", ["a", "c"]).count() == 2
    for columns, filled, what in (("a int", [], "a is bigint"), ("d string", [], "missing"), ("c string, a bigint", [], "order"), ("b double", ["b"], "1 nulls")):
        with pytest.raises(ValueError, match=what):
            files.contract(rows, columns, filled)
    assert files.contract(rows, "c string, a bigint", ordered=False) is rows


def test_archives_are_verified(spark):
    import hashlib

    sums = spark.createDataFrame([("a", hashlib.sha256(b"one").hexdigest().upper()), ("b", "0" * 64)], "name string, sha256 string")
    got = files.verified(spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", b"three")], "name string, content binary"), sums)
    assert {r["name"]: r.ok for r in got.collect()} == {"a": True, "b": False, "c": False}


def test_recording_goes_on_in_files_by_key(spark, tmp_path):
    feed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    start = lambda **more: streams.record(spark.readStream.schema("k string, v long").parquet(feed), out, state, ["k"], rows=4, **more)
    spark.createDataFrame([("a", i) for i in range(10)] + [("b", 99)], "k string, v long").coalesce(1).write.parquet(feed)
    start().awaitTermination()
    assert len([f for f in os.listdir(f"{out}/k=a") if f.endswith(".parquet")]) == 3
    spark.createDataFrame([("b", 100)], "k string, v long").write.mode("append").parquet(feed)
    query = start(seconds=0.1)
    query.processAllAvailable()
    query.stop()
    assert sorted(r.v for r in spark.read.parquet(out).where("k = 'b'").collect()) == [99, 100] and spark.read.parquet(out).count() == 12


def test_manifest_digest_ignores_order(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id % 7 as string) AS s", "if(id % 3 = 0, null, id / 3) AS x")
    digest = files.sha256_of(rows)
    assert len(digest) == 64 and digest == files.sha256_of(rows.repartition(7).orderBy("x"))
    assert digest != files.sha256_of(rows.where("id < 4999")) and digest != files.sha256_of(rows.unionByName(rows.limit(1)))


def test_nearest_neighbours_in_blocks(spark):
    import numpy as np

    from tapespark.operators import metrics as M

    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    frame = lambda a: spark.createDataFrame([(i, v.tolist() if i % 50 else None) for i, v in enumerate(a)], "id long, embedding array<double>").repartition(3)
    q, ref = frame(x[:120]), frame(x)
    want = sorted(map(tuple, M.cosine_knn(q, ref, 5).select("query", "reference", "place").collect()))
    assert want == sorted(map(tuple, M.cosine_knn(q, ref, 5, block=25, reference_block=70).select("query", "reference", "place").collect()))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in (1, 7, 77):
        if x[i].any():
            order = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in range(300) if j % 50 and x[j].any())
            got = [r for a, r, _ in want if a == i]
            assert {round(float(unit[i] @ unit[j]), 9) for j in got} == {-s for s, _ in order[:5]}


def test_zip_archives_hold_one_csv(spark, tmp_path):
    for name, inside in (("a.zip", ["x.csv"]), ("b.zip", ["x.csv", "y.csv"])):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in inside:
                z.writestr(n, "id,price\n1,2.5\n2,3.5\n")
        (tmp_path / name).write_bytes(out.getvalue())
    rows = files.zipped_csv(spark, str(tmp_path / "a.zip"), "id bigint, price double")
    assert [(r.id, r.price) for r in rows.collect()] == [(1, 2.5), (2, 3.5)]
    with pytest.raises(Exception, match="exactly one CSV"):
        files.zipped_csv(spark, str(tmp_path / "b.zip"), "id bigint, price double").collect()


def test_compaction_keeps_rows_and_order(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, ids in (("a_20240101_000000", [1, 2]), ("a_20240101_000100_2", [3]), ("b", [9])):
        pa.parquet.write_table(pa.table({"id": ids}), source / f"{name}.parquet")
    got = {r["name"]: (r.sources, r.rows) for r in files.compact(spark, str(source), str(tmp_path / "out")).collect()}
    assert got == {"a": (2, 3), "b": (1, 1)}
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out/name=a")).collect()] == [1, 2, 3]


def test_manifests_notice_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    files.save_with_manifest(spark.range(5), path)
    assert files.load_verified(spark, path).count() == 5
    spark.range(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="manifest"):
        files.load_verified(spark, path)


def test_candles_keep_the_last_of_a_time(spark):
    rows = spark.createDataFrame([(60_000, 1.0, 1.0, 1.0, 1.0, 1.0), (60_000, 2.0, 2.0, 2.0, 2.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0), (120_000, None, 1.0, 1.0, 1.0, 1.0)], "timestamp long, open double, high double, low double, close double, volume double").coalesce(1)
    assert [r.open for r in files.candles(rows, least=1).collect()] == [2.0]
    with pytest.raises(ValueError, match="needed"):
        files.candles(rows, least=2)


def test_streamed_book_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "series long, ts long, seq long, side string, price long, quantity long, is_snapshot boolean"
    rows = [(0, 0, 0, None, None, 0, True)] + [(0, i, i, ("bid", "ask")[i % 2], 100 + i % 5 + 10 * (i % 2), i % 3, False) for i in range(1, 40)]
    feed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = lambda: streams.book(spark.readStream.schema(schema).parquet(feed))
    spark.createDataFrame(rows[:17], schema).coalesce(1).write.parquet(feed)
    streams.run(stream(), out, state)
    spark.createDataFrame(rows[17:], schema).coalesce(1).write.mode("append").parquet(feed)
    parts = streams.run(stream(), out, state).orderBy("seq").collect()
    whole = streams.run(stream(), str(tmp_path / "out2"), str(tmp_path / "state2")).orderBy("seq").collect()
    assert parts == whole and len(parts) == len(rows)


def test_extension_must_agree(spark):
    base = spark.createDataFrame([(i, i, i * 2) for i in range(5)], "k long, ts long, v long")
    more = spark.createDataFrame([(i, i, i * 2) for i in range(3, 8)], "k long, ts long, v long")
    assert R.extended(base, more, ["k"], "ts", ["v"]).count() == 8
    with pytest.raises(ValueError, match="frozen"):
        R.extended(base, more.withColumn("v", F.col("v") + 1), ["k"], "ts", ["v"])


def test_streamed_inference_equals_batch(spark, tmp_path):
    from tapespark.operators import models as M

    weights = M.lstm_weights(1, 4)
    schema = "series long, event long, at_us long, a double"
    rows = [(s, i // 7, i, (i * 37 % 11) / 11) for s in (0, 1) for i in range(30)]
    feed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = lambda: streams.recurrent(spark.readStream.schema(schema).parquet(feed), ["a"], weights)
    for part in ([r for r in rows if r[2] < 12], [r for r in rows if r[2] >= 12]):  # the cut is inside an event
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
        got = streams.run(stream(), out, state)
    want = M.lstm_scores(spark.createDataFrame(rows, schema), ["series", "event"], "at_us", ["a"], weights)
    key = lambda r: (r.series, r.event, r.at_us)
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and all(abs(x.probability - y.probability) < 1e-12 for x, y in zip(a, b, strict=True))
