"""Hand-worked cases and plain versions for ordered folds, packed orders and synthetic streams."""
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from ledgermill.operators import markets, packed, registry, simulation
from ledgermill.plans import sql
from ledgermill.sources import packets


@pytest.fixture(scope="module")
def spark():
    return (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate())


def market(*steps):
    m = registry.Market()
    verdicts = []
    for action, account, amount, at, detail in steps:
        verdicts.append(m.command({"action": action, "account": account, "amount": amount, "at": at, "detail": detail}))
        assert m.reconciles()
    return m, verdicts


OPENED = [("deposit", 0, 10_000, 0, None), ("create", 0, 500, 100, [2, 1000, 2]), ("stake", 0, 500, 1, None), ("activate", 0, 0, 2, None), ("bootstrap", 0, 1000, 3, None)]
PENDING = [*OPENED, ("mint", 0, 300, 4, None), ("commit_policy", 0, 10, 5, [1000]), ("close", 0, 0, 100, None), ("begin_resolution", 0, 0, 101, None)]


def test_market_opens_when_staked_and_bootstrapped():
    m, verdicts = market(*OPENED)
    assert verdicts == ["ok"] * 5 and m.state == "open" and m.free[0] == 8500
    m, verdicts = market(*OPENED[:2], ("stake", 0, 499, 1, None), ("activate", 0, 0, 2, None), ("stake", 0, 1, 3, None), ("stake", 7, 1, 3, None), ("stake", 1, 1, 3, None), ("bootstrap", 0, 1, 4, None))
    assert verdicts[2:] == ["ok", "illegal_transition", "ok", "unknown_sponsor", "unknown_account", "wrong_state"] and m.state == "staked"
    assert market(("mint", 0, 1, 0, None))[1] == ["unknown_market"] and market(OPENED[1], OPENED[1])[1] == ["ok", "duplicate_market"]


def test_halt_keeps_where_it_came_from():
    m, verdicts = market(*OPENED, ("halt", 0, 0, 5, None), ("mint", 0, 1, 6, None), ("resume", 0, 0, 7, None), ("oracle_health", 0, 1, 8, None), ("resume", 0, 0, 9, None))
    assert verdicts[5:] == ["ok", "wrong_state", "oracle_unhealthy", "ok", "ok"] and m.state == "open"
    m, verdicts = market(*OPENED[:4], ("halt", 0, 0, 5, None), ("resume", 0, 0, 6, None))
    assert verdicts[4:] == ["ok", "ok"] and m.state == "bootstrapping"
    m, verdicts = market(*OPENED, ("halt", 0, 0, 5, None), ("archive", 0, 0, 6, None))
    assert verdicts[-1] == "liabilities"


def test_complete_sets():
    m, verdicts = market(*OPENED, ("mint", 0, 300, 4, None), ("redeem", 5, 100, 5, None), ("redeem", 0, 201, 6, None), ("mint", 0, 0, 7, None), ("mint", 0, 9000, 8, None), ("close", 0, 0, 99, None))
    assert verdicts[5:] == ["ok", "ok", "insufficient_collateral", "units", "insufficient_available", "out_of_range"]
    assert m.locked == 200 and m.outstanding == [200, 200] and m.free == {0: 8200, 5: 100}


def test_unchallenged_resolution():
    m, verdicts = market(*PENDING, ("propose", 0, 110, 101, [1_000_000, 0]), ("propose", 0, 111, 101, [600_001, 400_000]), ("propose", 0, 111, 101, [1_000_000, 0]), ("propose", 0, 130, 102, [0, 1_000_000]),
                         ("finalize", 0, 0, 110, None), ("finalize", 0, 0, 111, None), ("settle", 0, 0, 112, None), ("settle", 0, 0, 113, None))
    assert verdicts[-8:] == ["window_too_short", "not_conserving", "ok", "proposal_exists", "window_open", "ok", "ok", "ok"]
    assert m.state == "settled" and (m.paid, m.dust, m.locked) == (300, 0, 0)


def test_disputed_resolution():
    m, verdicts = market(*PENDING, ("challenge", 3, 50, 101, None), ("propose", 0, 111, 101, [1_000_000, 0]), ("adjudicate", 0, 111, 111, [0, 1_000_000]), ("challenge", 3, 50, 110, None), ("challenge", 4, 50, 111, None),
                         ("finalize", 0, 0, 111, None), ("adjudicate", 0, 111, 110, [0, 1_000_000]), ("adjudicate", 0, 112, 111, [0, 1_000_000]), ("adjudicate", 0, 111, 111, [333_333, 666_667]), ("finalize", 0, 0, 112, None),
                         ("settle", 0, 0, 113, None))
    assert verdicts[-11:] == ["no_proposal", "ok", "wrong_state", "ok", "window_closed", "unresolved_challenge", "window_open", "round_mismatch", "ok", "ok", "ok"]
    assert (m.paid, m.dust) == (99 + 200, 1)


def test_invalid_market_refunds_and_full_queue():
    m, verdicts = market(*PENDING, ("invalidate", 0, 0, 102, None), ("settle", 0, 0, 103, None))
    assert verdicts[-2:] == ["ok", "ok"] and m.resolution == [500_000, 500_000] and m.paid == 300
    assert registry.refund(3) == [333_333, 333_333, 333_334]
    m, verdicts = market(*PENDING, ("propose", 0, 500, 101, [1_000_000, 0]), *[("challenge", i, 1, 102, None) for i in range(65)])
    assert verdicts[-1] == "queue_full" and verdicts[-2] == "ok" and m.state == "disputed"


def test_acknowledgements():
    c = registry.Conditional()
    steps = [("executed", 1), ("add", 1), ("executed", 1), ("fire", 1), ("executed", 2), ("retry", 1), ("retryable", 1), ("retry", 1), ("executed", 1), ("fire", 9), ("executed", 1), ("fire", 1)]
    got = [c.command(a, o, 2) for a, o in steps]
    assert got == ["unknown_id", "ok", "invalid_status", "ok", "owner_mismatch", "invalid_status", "ok", "ok", "ok", "ok", "ok", "unknown_id"]


def test_fold_keeps_keys_apart_and_in_order(spark):
    rows = [(k, s, "add" if s == 0 else "fire" if s % 2 else "retryable", 1, 1) for k in (1, 2, None) for s in range(40)]
    random.Random(1).shuffle(rows)
    got = registry.acknowledgements(spark.createDataFrame(rows, "conditional_id long, seq long, action string, owner long, slices long")).collect()
    for k in (1, 2, None):
        mine = [r for r in got if r.conditional_id == k]
        assert [r.seq for r in mine] == list(range(40)) and [r.verdict for r in mine][:4] == ["ok", "ok", "ok", "not_pending"]
    assert registry.acknowledgements(spark.createDataFrame([], "conditional_id long, seq long, action string, owner long, slices long")).count() == 0


def test_stream_words_against_a_walk():
    for seed in (0, 1, -1, 2**63 - 1):
        state, want = seed % 2**64, []
        for _ in range(300):
            state = (state * simulation.MULTIPLIER + simulation.INCREMENT) % 2**64
            want.append(state ^ state >> 29)
        assert simulation.words(seed, range(1, 301)).tolist() == want


def test_quotes_hold_their_rules():
    for regime in simulation.REGIMES:
        rows = list(simulation.walk(7, 5000, regime))
        assert rows == list(simulation.walk(7, 5000, regime, chunk=7)) and [r[0] for r in rows] == list(range(5000))
        for _, bid, ask, bid_depth, ask_depth, imbalance in rows:
            assert 0 < bid < ask and bid % simulation.TICK == ask % simulation.TICK == 0 and min(bid_depth, ask_depth) > 0 and abs(imbalance) <= 1_000_000


def sent(link):
    out = []
    while (left := link.send()) is not None:
        out.append(left[:2])
    return out


def test_schedule():
    link = simulation.Link()
    for frame, (kind, size) in enumerate([(8, 100), (0, 100), (1, 100), (0, 70_000), (8, 600), (1, 5000)]):
        assert link.admit(kind, frame, size)
    # Class 0 by its quantum, of which too little is left for its large frame; class 1 pays, which renews the quantum, and a full
    # one lets any frame pass. Then 8 pays 100 of 512, 1 pays 5000 of 3996 + 4096, and 8 pays 600 of 412 + 512.
    assert sent(link) == [(0, 1), (1, 2), (0, 3), (8, 0), (1, 5), (8, 4)]
    link = simulation.Link(frames=2, size=100)
    assert [link.admit(3, i, s) for i, s in enumerate([500, 1, 1])] == [True, False, False] and link.admit(4, 9, 60) and link.admit(4, 10, 40) and not link.admit(4, 11, 0)


def test_schedule_loses_nothing(spark):
    r = random.Random(5)
    rows = [(r.randrange(3), i, r.randrange(9), r.randrange(1, 9000)) for i in range(3000)]
    got = simulation.scheduled(spark.createDataFrame(rows, "link long, frame long, class int, size long")).collect()
    assert sorted((g.link, g.frame, g["class"], g.size) for g in got) == sorted(rows)
    for link in range(3):
        mine = [g for g in got if g.link == link and g.outcome == "sent"]
        assert sorted(g.place for g in mine) == list(range(1, len(mine) + 1))
        for kind in range(9):
            assert [g.frame for g in sorted(mine, key=lambda g: g.place) if g["class"] == kind] == sorted(g.frame for g in mine if g["class"] == kind)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=400), st.lists(st.sampled_from([b"abcd", b"\0\0\0\0\0", b"x"]), max_size=300).map(b"".join)))
def test_blocks_round_trip(data):
    block = packets.lz4_block(data)
    assert packets.lz4_plain(block, len(data)) == data
    assert not data or packets.lz4_plain(block, len(data) - 1) is None


def test_blocks_by_hand():
    # Five literals, then ten bytes from one back, then five literals; a distance beyond what is there; a length cut off.
    assert packets.lz4_plain(b"\x56abcde\x01\x00\x50vwxyz", 100) == b"abcde" + b"e" * 10 + b"vwxyz"
    assert packets.lz4_plain(b"\x10a\x05\x00\x00", 100) is None and packets.lz4_plain(b"\xf0\xff", 1000) is None and packets.lz4_plain(b"\x10a\x00\x00\x00", 100) is None
    assert len(packets.lz4_block(bytes(10_000))) < 60


def submit(qty=5, price=7, flags=0, **over):
    head = {"version": 1, "tag": 1, "size": 56} | over
    return struct.pack("<BBBBIQQIIqqq", head["version"], head["tag"], head["size"], flags, 3, 11, 12, 13, 14, price, qty, 1_000_000)


@pytest.mark.parametrize("data, want", [
    (submit(), None), (submit(version=2), "version"), (submit(tag=4), "tag"), (submit(size=40), "length"), (submit(flags=1 << 5), "reserved"), (submit(flags=3 << 3), "value"), (submit(qty=0), "value"),
    (submit(price=0), "value"), (submit(price=0, flags=1 << 1), None), (submit()[:55], "truncated"), (b"\x01", "truncated"),
    (struct.pack("<BBBBIQQIIQ", 1, 2, 40, 0, 3, 11, 12, 13, 14, 0), "value"), (struct.pack("<BBBBIQQIIQ", 1, 2, 40, 1, 3, 11, 12, 13, 14, 9), "reserved"),
    (struct.pack("<BBBBIQQIIQqq", 1, 3, 56, 0, 3, 11, 12, 13, 14, 9, 1, 0), "value"),
])
def test_records(data, want):
    assert packets.read_record(data, 0)[0] == want


def test_batches_and_envelopes():
    data = submit() * 40
    assert packets.read_batch(data, 40)[0] is None and packets.read_batch(data, 39)[0] == "trailing" and packets.read_batch(data, 41)[0] == "truncated"
    assert packets.read_batch(submit() * 31, 31)[0] == "size" and packets.read_batch(submit() * 129, 129)[0] == "size"
    good = packets.seal(data, 40)
    assert len(good) < len(data) and packets.unseal(good) == packets.read_batch(data, 40) and packets.unseal(packets.seal(submit() * 3, 3))[0] is None
    change = lambda at, value: good[:at] + bytes([value]) + good[at + 1:]
    assert [packets.unseal(change(at, v))[0] for at, v in ((0, 0), (2, 9), (3, 8), (4, 7), (6, 1), (5, 20), (16, good[16] ^ 1))] == ["magic", "version", "flags", "backend", "reserved", "count", "crc"]
    assert packets.unseal(good + b"x")[0] == "trailing" and packets.unseal(good[:-1])[0] == "truncated" and packets.unseal(good[:10])[0] == "truncated"
    noise = random.Random(2).randbytes(56)
    raw = packets.HEAD.pack(packets.MAGIC, 1, packets.RAW | packets.PARTIAL, 0, 1, 0, 56, 56, zlib.crc32(noise)) + noise
    assert packets.unseal(raw)[0] in ("version", "tag", "length") and packets.unseal(raw[:8] + b"\x01" + raw[9:])[0] == "raw_length"


def test_conditional_records(spark):
    good = struct.pack("<IBBBBqqqQB", 7, 1, 2, 1, 0, -5, 6, 8, 9, 1)
    rows = [good, good[:-1], good + b"zz", good[:4] + b"\x02" + good[5:], good[:7] + b"\x02" + good[8:], good[:40] + b"\x02", struct.pack("<IBBBBqqqQB", 7, 1, 2, 1, 1, 5, 0, 8, 9, 0)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, d binary").select("i", packets.conditional(packed.F.col("d")).alias("r")).orderBy("i").collect()
    assert [g.r.verdict for g in got] == ["ok", "malformed", "ok", "malformed", "malformed", "malformed", "quantity"]
    assert tuple(got[0].r)[1:] == (7, "ask", "post_only", "ioc", "above", -5, 6, 8, 9, True)


@pytest.mark.parametrize("name", ["stop_orders", "oco_orders"])
def test_conditional_orders_without_pairing_them_with_ticks(spark, tmp_path, name):
    """The same rows as the text, which joins each order with all ticks of its market; ids and prices may be null."""
    rng = random.Random(5)
    events = [(i if i % 41 else None, rng.choice([1, 2, 17, 33, 50, 66, 470, 902, -14, None]), "trade", rng.choice([None, *[rng.randrange(1, 490) * 1.0] * 9])) for i in range(600)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double")
    frame.selectExpr("*", "timestamp_ntz'2024-01-01' as ts", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    got = markets.QUERIES[name](spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = sql.run(spark, str(tmp_path), markets.TEXT["spark"][name])
    assert got.schema.simpleString() == want.schema.simpleString() and want.count() > 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_conditional_orders_at_one_event():
    def fed(machine, rows):
        out = [x for r in rows for x in machine.apply(dict(zip(("market_id", "event_id", "tick", "user_id", "side", "price_raw", "low_raw", "high_raw"), r)))]
        return out + list(machine.close())
    rows = [(1, 1, 1, None, None, 5, None, None), (1, 1, 0, 7, "sell", None, 10, 90), (1, 1, 0, 8, "buy", None, 10, 90), (1, 2, 1, None, None, 95, None, None), (1, 2, 1, None, None, 9, None, None), (1, 3, 1, None, None, 99, None, None)]
    assert fed(markets.Trigger(), rows) == [(7, 1, "sell", 2, 9), (8, 1, "buy", 2, 95)]
    assert sorted(fed(markets.Trigger(True), rows)) == [(7, 1, 2, "a"), (8, 1, 2, "a")]
