"""Hand-worked cases, as plain values, and brute force for what SQL cannot express."""
import hashlib
import random
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgermill.functions import hashing as h
from ledgermill.operators import book, derivatives
from ledgermill.plans import sql
from ledgermill.sources import bbo, metrics, wal
from ledgermill.streaming import stream


@pytest.fixture(scope="module")
def spark():
    return (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate())


def fold(spark, legs):
    """The position fold over legs of (lots, price)."""
    values = ", ".join(f"(1L, 1L, {lots}L, {price}L, {i}L, 0L, 0L)" for i, (lots, price) in enumerate(legs))
    text = f"with legs as (select * from values {values} as t(account, market_id, lots, price_raw, at_us, order_id, line_no))" + derivatives._FOLD["spark"] + " select net_lots, entry_raw, realized_raw from positions"
    return tuple(spark.sql(sql.render(text, "spark")).first())


@pytest.mark.parametrize("legs, want", [
    ([(10, 100)], (10, 100, 0)),
    ([(10, 100), (10, 200)], (20, 150, 0)),
    ([(1, 100), (2, 101)], (3, 100, 0)),
    ([(10, 100), (-4, 150)], (6, 100, 200)),
    ([(10, 100), (-10, 90)], (0, 0, -100)),
    ([(10, 100), (-15, 120)], (-5, 120, 200)),
    ([(-10, 100), (4, 80)], (-6, 100, 80)),
    ([(-10, 100), (12, 130)], (2, 130, -300)),
    ([(10, 100), (-10, 110), (-5, 90), (-5, 70)], (-10, 80, 100)),
])
def test_position_fold(spark, legs, want):
    assert fold(spark, legs) == want


def place(order_id, account, side, price, lots, kind="limit", life="gtc", reduce_only=False, client_id=0):
    return {"action": "place", "order_id": order_id, "account": account, "side": side, "kind": kind, "life": life, "price_raw": price, "lots": lots, "reduce_only": reduce_only, "client_id": client_id}


def run(commands, policy="cancel_maker"):
    b = book.Book(policy)
    return b, [b.apply(c) for c in commands]


def test_price_then_time():
    b, out = run([place(1, 1, "ask", 101, 5), place(2, 2, "ask", 100, 5), place(3, 3, "ask", 100, 5), place(4, 9, "bid", 101, 12)])
    assert [(e[1], e[3], e[4]) for e in out[3] if e[0] == "fill"] == [(2, 100, 5), (3, 100, 5), (1, 101, 2)]
    assert out[3][-1][5] == "filled" and b.levels("ask") == [(101, 3, 1)]


def test_lives_and_kinds():
    base = [place(1, 1, "ask", 100, 5)]
    assert run([*base, place(2, 2, "bid", 100, 8, life="ioc")])[1][1][-1][4:] == (3, "partially_filled_cancelled")
    b, out = run([*base, place(2, 2, "bid", 100, 8, life="fok")])
    assert out[1] == [("report", None, None, 0, 0, "rejected")] and b.levels("ask") == [(100, 5, 1)]
    assert run([*base, place(2, 2, "bid", 100, 5, life="fok")])[1][1][-1][5] == "filled"
    assert run([*base, place(2, 2, "bid", 100, 5, kind="post_only")])[1][1][-1][5] == "rejected"
    assert run([*base, place(2, 2, "bid", 99, 5, kind="post_only")])[1][1][-1][5] == "resting"
    assert run([*base, place(2, 2, "bid", 0, 9, kind="market")])[1][1][-1][4:] == (4, "partially_filled_cancelled")
    assert run([*base, place(2, 2, "bid", 99, 9, kind="market")])[1][1][-1][5] == "rejected"
    assert run([*base, place(2, 2, "bid", 100, 8)])[1][1][-1][4:] == (3, "partially_filled_resting")
    assert run([place(1, 1, "ask", 0, 5)])[1][0][-1][5] == "non_positive_price" and run([place(1, 1, "ask", 5, 0)])[1][0][-1][5] == "non_positive_quantity"
    assert run([*base, place(1, 2, "ask", 101, 5)])[1][1][-1][5] == "duplicate_order_id"


@pytest.mark.parametrize("policy, left, outcome", [("cancel_maker", [], "filled"), ("cancel_taker", [(100, 5, 1), (101, 5, 1)], "rejected"), ("cancel_both", [(101, 5, 1)], "rejected")])
def test_self_trade(policy, left, outcome):
    b, out = run([place(1, 7, "ask", 100, 5), place(2, 8, "ask", 101, 5), place(3, 7, "bid", 101, 5)], policy)
    assert b.levels("ask") == left and out[2][-1][5] == outcome


def test_reduce_only_cancel_replace_and_repeats():
    position = {"action": "position", "account": 2, "lots": 3}
    b, out = run([place(1, 1, "bid", 100, 9), position, place(2, 2, "ask", 100, 8, reduce_only=True), place(3, 3, "ask", 100, 1, reduce_only=True)])
    assert out[2][0][4] == 3 and out[3][-1][5] == "rejected"
    b, out = run([place(1, 1, "bid", 100, 5), place(2, 2, "bid", 100, 5), {"action": "replace", "order_id": 1, "price_raw": 100, "lots": 5}, place(3, 3, "ask", 100, 5)])
    assert out[3][0][1] == 2
    b, out = run([place(1, 1, "bid", 100, 5), {"action": "cancel", "order_id": 1}, {"action": "cancel", "order_id": 1}])
    assert out[1][0][0] == "cancelled" and out[2][0][5] == "unknown_order" and not b.orders
    b, out = run([place(5, 1, "bid", 90, 5), place(2, 1, "ask", 100, 5), place(3, 2, "ask", 100, 5), {"action": "cancel_all", "account": 1}])
    assert [e[1] for e in out[3]] == [2, 5] and set(b.orders) == {3}
    b, out = run([place(1, 1, "bid", 100, 5, client_id=8), place(2, 1, "bid", 100, 5, client_id=8)])
    assert out[1][-1][5] == "replay:resting" and set(b.orders) == {1}


def test_basket_is_all_or_nothing():
    b = book.Book()
    b.apply(place(1, 1, "ask", 100, 5))
    assert [e[5] for _, e in b.basket([place(2, 2, "bid", 100, 3), place(3, 2, "bid", 50, 3, life="fok")])] == ["basket_rejected"] * 2
    assert b.levels("ask") == [(100, 5, 1)]
    assert [e[5] for _, e in b.basket([place(2, 2, "bid", 100, 3), place(3, 2, "bid", 50, 3)]) if e[0] == "report"] == ["filled", "resting"]


def test_a_deep_book_is_not_read_whole():
    class Deep(dict):
        def values(self):
            raise AssertionError("all orders read")
    b = book.Book()
    for i in range(40):
        b.apply(place(i, i % 4, "ask", 100 + i // 2, 5))
    b.orders = Deep(b.orders)
    assert [e[4] for e in b.apply(place(90, 9, "bid", 101, 12, life="fok")) if e[0] == "fill"] == [5, 5, 2]
    assert b.apply(place(91, 9, "bid", 101, 9, life="fok"))[0][5] == "rejected"
    # Orders 2 and 3 are left at 101; account 2 skips its own.
    assert b.apply(place(92, 2, "bid", 101, 6, life="fok"))[0][5] == "rejected"
    assert [e[1] for e in b.apply({"action": "cancel_all", "account": 1})] == list(range(5, 40, 4))
    b.orders = dict(b.orders)
    assert [x[0] for x in b.levels("ask")] == [-p for p in b.prices["ask"]][::-1] and set(b.owned) == {0, 2, 3}


def plain_match(commands):
    """The same rules over a plain list, for limit, market and the three lives."""
    resting, fills = [], []
    for c in commands:
        if c["action"] == "cancel":
            resting = [o for o in resting if o["order_id"] != c["order_id"]]
            continue
        if any(o["order_id"] == c["order_id"] for o in resting) or c["lots"] <= 0 or (c["kind"] != "market" and c["price_raw"] <= 0):
            continue
        sign = 1 if c["side"] == "bid" else -1
        can = [o for o in sorted(resting, key=lambda o: sign * o["price_raw"]) if o["side"] != c["side"] and ((c["kind"] == "market" and c["price_raw"] <= 0) or sign * (c["price_raw"] - o["price_raw"]) >= 0)]
        if c["life"] == "fok" and sum(o["left"] for o in can if o["account"] != c["account"]) < c["lots"]:
            continue
        left = c["lots"]
        for o in can:
            if not left:
                break
            if o["account"] == c["account"]:
                o["left"] = 0
                continue
            take = min(left, o["left"])
            fills.append((c["order_id"], o["order_id"], o["price_raw"], take))
            left, o["left"] = left - take, o["left"] - take
        resting = [o for o in resting if o["left"]]
        if left and c["kind"] == "limit" and c["life"] == "gtc":
            resting.append({**c, "left": left})
    return fills, sorted((o["order_id"], o["left"]) for o in resting)


def test_markets_against_plain_lists(spark):
    rng = random.Random(1)
    commands = []
    for market in range(3):
        for seq in range(400):
            c = place(seq, rng.randrange(6), rng.choice(["bid", "ask"]), rng.randrange(95, 106), rng.randrange(1, 9), rng.choice(["limit"] * 5 + ["market"]), rng.choice(["gtc"] * 4 + ["ioc", "fok"]))
            if rng.random() < 0.15:
                c = {**c, "action": "cancel", "order_id": rng.randrange(seq + 1)}
            commands.append({"market_id": market, "seq": seq, **c})
    rng.shuffle(commands)
    got = book.match(spark.createDataFrame(commands, "market_id long, seq long, action string, order_id long, account long, side string, kind string, life string, price_raw long, lots long, reduce_only boolean, client_id long")).collect()
    for market in range(3):
        fills, resting = plain_match(sorted((c for c in commands if c["market_id"] == market), key=lambda c: c["seq"]))
        mine = [r for r in got if r.market_id == market]
        assert [(r.order_id, r.maker_order, r.price_raw, r.lots) for r in mine if r.event == "fill"] == fills
        assert sorted((r.order_id, r.lots) for r in mine if r.event == "resting") == resting


def plain_domain(domain, data):
    tag = domain.encode()
    return hashlib.sha256(len(tag).to_bytes(8, "little") + tag + len(data).to_bytes(8, "little") + data).digest()


def test_merkle_against_plain_trees(spark):
    rng = random.Random(2)
    trees = {n: [rng.randbytes(32) for _ in range(n)] for n in (1, 2, 3, 5, 8, 13)}
    rows = spark.createDataFrame([(n, i, x.hex()) for n, xs in trees.items() for i, x in enumerate(xs)], "tree long, idx long, hash string")

    def root(xs):
        size = 1 << (len(xs) - 1).bit_length()
        xs = xs + [bytes(32)] * (size - len(xs))
        while len(xs) > 1:
            xs = [plain_domain(h.NODE, a + b) for a, b in zip(xs[::2], xs[1::2])]
        return xs[0].hex()

    want = {n: root(xs) for n, xs in trees.items()}
    assert {r.tree: r.root for r in h.merkle_roots(rows).collect()} == want
    proved = h.merkle_proofs(rows, rows.select("tree", "idx")).withColumn("root", h.proof_root("hash", "idx", "siblings")).collect()
    assert len(proved) == 32 and all(r.root == want[r.tree] and len(r.siblings) == (r.tree - 1).bit_length() for r in proved)


def test_hashes_against_plain_ones(spark):
    data = [b"", b"abc", bytes(range(256))]
    df = spark.createDataFrame([(i, bytearray(d), d.hex()) for i, d in enumerate(data)], "i long, raw binary, hex string")

    def fnv(d):
        x = 0xcbf29ce484222325
        for b in d:
            x = (x ^ b) * 0x100000001b3 % 2 ** 64
        return x
    for r in df.select("i", h.domain_hash("d", F.col("hex")).alias("d"), h.fnv1a(F.col("hex")).alias("f"), h.keccak(F.col("raw")).alias("k"), F.crc32("raw").alias("c")).collect():
        assert r.d == plain_domain("d", data[r.i]).hex() and int(r.f) == fnv(data[r.i]) and r.c == zlib.crc32(data[r.i])
    assert h.keccak256(b"") == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert h.keccak256(b"abc") == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    frames = spark.createDataFrame([(1, i, bytes([i]).hex()) for i in range(5)], "k long, o long, f string")
    tip = hashlib.sha256(h.CHAIN.encode()).digest()
    for i in range(5):
        tip = plain_domain(h.CHAIN, tip + bytes([i]))
    assert h.chain_tips(frames, "k", "o", "f").first().tip == tip.hex()
    hashes = [hashlib.sha256(bytes([i])).hexdigest() for i in range(9)]
    want = 0
    for x in hashes:
        want ^= int(x, 16)
    assert h.xor_root(spark.createDataFrame([(1, x) for x in hashes], "k long, x string"), ["k"], "x").first().root == f"{want:064x}"


def test_log_source(spark, tmp_path):
    frames = [wal.encode(1, i, 100 + i, 7, bytes([i]) * i) for i in range(1, 9)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "0001").write_bytes(b"".join(frames[:5]))
    (tmp_path / "log" / "0002").write_bytes(b"".join(frames[5:]) + frames[0][:9])
    wal.register(spark)
    log = spark.read.format("ledger_wal").load(str(tmp_path / "log"))
    assert sorted((r.sequence, r.timestamp, bytes(r.payload)) for r in log.collect()) == [(i, 100 + i, bytes([i]) * i) for i in range(1, 9)]
    assert wal.find(log, 4).count() == 1 and wal.find(log, 40).count() == 0 and wal.truncate_after(log, 3).count() == 3
    assert wal.replay(log, 0, lambda s, r: s + r.sequence, after=2) == (sum(range(3, 9)), 8, None)

    def fails(state, row):
        if row.sequence == 5:
            raise ValueError("no")
        return state + 1
    assert wal.replay(log, 0, fails) == (4, 4, (5, "no"))
    wal.append(log.drop("corrupt"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    with pytest.raises(ValueError):
        wal.append(log.drop("corrupt"), str(tmp_path / "out"), last=8)
    damaged = bytearray(b"".join(frames))
    damaged[40] ^= 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "0001").write_bytes(damaged)
    with pytest.raises(Exception, match="crc"):
        spark.read.format("ledger_wal").load(str(tmp_path / "bad")).collect()
    rows = spark.read.format("ledger_wal").option("mode", "permissive").load(str(tmp_path / "bad")).collect()
    assert [r.sequence for r in rows if r.corrupt is None] == [1] and any(r.corrupt for r in rows)


def test_quote_replay(spark, tmp_path):
    lines = ["# quotes", "", "timestamp_ns,market_id,best_bid,best_ask,bid_depth,ask_depth", "10,1,1000000,2000000,5,5", "9,1,1000000,2000000,5,5", "11,2,3000000,2000000,5,5",
             "12,2,1000000,2000001,5,5", "13,2,1,2", "14,3,-1000000,2000000,1,1", " 15 , 1 , 1000000 , 3000000 , 1 , 1 ", "16,x,1,1,1,1"]
    (tmp_path / "r.csv").write_text("\n".join(lines))
    got = [r.error for r in bbo.read(spark, str(tmp_path / "r.csv")).orderBy("line").collect()]
    assert got == [None, "order", "crossed", "tick", "fields", "negative", None, "fields"]


def test_metrics_round_trip(spark):
    rows = spark.createDataFrame([("a_total", Decimal(5)), ("b", Decimal(-7))], "name string, value decimal(38,0)")
    assert sorted(map(tuple, metrics.from_text(metrics.to_text(rows).union(spark.createDataFrame([("# c 1",), ("x y z",), ("",)], "line string"))).collect())) == sorted(map(tuple, rows.collect()))
    assert metrics.from_json(metrics.to_json(rows), "name string, value decimal(38,0)").collect() == rows.collect()


def test_streams_against_batches(spark):
    sf = "/root/testdata/sf0.001"
    got = stream.tracked(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 4).alias("t"), F.expr("event_id div 4").alias("s")).collect()
    want, last = [], {}
    for t, s in rows:
        verdict = "apply" if t not in last or s == last[t] + 1 else "duplicate" if s <= last[t] else "gap"
        if verdict == "apply":
            last[t] = s
        want.append((t, s, verdict))
    assert sorted(map(tuple, got)) == sorted(want)
    closed = stream.windowed(spark, sf)
    every = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01', ts) * 3600000000").alias("from_us"), "event_type").agg(F.count("*").alias("n"))
    assert closed.select("from_us", "event_type", "n").exceptAll(every).count() == 0 and 0 < closed.count() <= every.count()


def test_merkle_by_blocks(spark):
    rng = random.Random(3)
    trees = {n: [rng.randbytes(32) for _ in range(n)] for n in (1, 4, 5, 17, 64, 75)}
    rows = spark.createDataFrame([(n, i, x.hex()) for n, xs in trees.items() for i, x in enumerate(xs)], "tree long, idx long, hash string")
    whole = {r.tree: r.root for r in h.merkle_roots(rows).collect()}
    assert {r.tree: r.root for r in h.merkle_roots(rows, 2).collect()} == whole
    proved = h.merkle_proofs(rows, F.col("idx") % 3 == 0, 2)
    assert proved._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    got = proved.withColumn("folded", h.proof_root("hash", "idx", "siblings")).collect()
    assert sorted((r.tree, r.idx) for r in got) == [(n, i) for n in trees for i in range(0, n, 3)]
    assert all(r.folded == r.root == whole[r.tree] and r.hash == trees[r.tree][r.idx].hex() and len(r.siblings) == (r.tree - 1).bit_length() for r in got)


def test_verified_reads_over_few_joins(spark):
    """Every tip proof is verified, every proof of the older tree stale, and no level of a tree is a join of its own."""
    from ledgermill.operators import commitments
    got = commitments.verified_reads(spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 16
    rows = got.collect()
    sizes = {r.tree: r.n for r in commitments.leaves(spark, "/root/testdata/sf0.001").groupBy("tree").agg(F.count("*").alias("n")).collect()}
    assert sorted((r.market_id, r.idx) for r in rows if r.status == "verified" and r.n_siblings == (sizes[r.market_id] - 1).bit_length()) == sorted((t, i) for t, n in sizes.items() for i in range(0, n, 16))
    assert sorted((r.market_id, r.n_siblings) for r in rows if r.status == "stale") == sorted((t, 3) for t, n in sizes.items() if n > 8)
