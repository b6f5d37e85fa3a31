"""Synthetic quotes and orders from a linear congruential stream, and frames sent by class under a deficit round robin."""
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.derivatives import TICKS
from ledgermill.operators.fold import folded
from ledgermill.plans import sql

# Fixed values of the stream.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407
REGIMES = ("steady", "mean_reverting", "trending", "volatility_clustering", "jump_shock")
TICK, MID, VOLATILITY, SPREAD, DEPTH, REVERSION, TREND, SHOCK_EVERY, SHOCK = 1_000_000, 100_000_000, 3, 2, 5, 8, 1, 10, 20


def words(seeds, steps):
    """The word at each step (from 1) of each seed's stream, without walking to it.

    A step is x -> a x + c modulo 2^64; k steps are a map of the same form, found by doubling, so any row of a stream
    is made where it is needed and streams need no order.
    """
    k = np.asarray(steps, np.uint64).copy()
    state = np.broadcast_to(np.asarray(seeds).astype(np.int64).view(np.uint64), k.shape).copy()
    times, plus = np.uint64(MULTIPLIER), np.uint64(INCREMENT)
    with np.errstate(over="ignore"):
        while k.any():
            state = np.where(k & np.uint64(1), state * times + plus, state)
            times, plus = times * times, (times + np.uint64(1)) * plus
            k >>= np.uint64(1)
    return state ^ (state >> np.uint64(29))


def toward_zero(a: int, b: int) -> int:
    return abs(a) // b if a >= 0 else -(abs(a) // b)


def walk(seed: int, n: int, regime: str, chunk=4096):
    """n quotes of a market: (step, bid, ask, bid depth, ask depth, imbalance). Two words a step."""
    mid, volatility, last, base = MID, VOLATILITY, 0, DEPTH * 10_000_000
    half = (SPREAD + 1) // 2 * TICK
    for start in range(0, n, chunk):
        size = min(chunk, n - start)
        drawn = words(seed, np.arange(2 * start + 1, 2 * (start + size) + 1)).tolist()
        for i in range(size):
            step = start + i
            move = drawn[2 * i] % (2 * volatility + 1) - volatility
            if regime == "mean_reverting":
                move += toward_zero(toward_zero(MID - mid, TICK), REVERSION)
            elif regime == "trending":
                move += TREND
            elif regime == "volatility_clustering":
                volatility = min(max((3 * volatility + max(abs(last), 1)) // 4, 1), 16 * VOLATILITY)
            elif regime == "jump_shock" and step and step % SHOCK_EVERY == 0:
                move += SHOCK if step // SHOCK_EVERY % 2 == 0 else -SHOCK
            last = move
            mid = max(mid + move * TICK, TICK * (SPREAD + 2)) // TICK * TICK
            bid = max(mid - half, TICK) // TICK * TICK
            ask = max(-(-(mid + half) // TICK) * TICK, bid + TICK)
            imbalance = drawn[2 * i + 1] % 2_000_001 - 1_000_000
            tilt = toward_zero(base * imbalance, 2_000_000)
            yield step, bid, ask, max(base + tilt, 1), max(base - tilt, 1), imbalance


QUOTES = "market_id long, step long, bid_raw long, ask_raw long, bid_depth_raw long, ask_depth_raw long, imbalance_raw long"


def quotes(markets: DataFrame) -> DataFrame:
    """QUOTES for rows of market_id, seed, n, regime; quotes leave in chunks, so a market of any length fits."""
    names = [f.split()[0] for f in QUOTES.split(", ")]

    def run(batches):
        for batch in batches:
            for market, seed, n, regime in zip(*[batch.column(c).to_pylist() for c in ("market_id", "seed", "n", "regime")]):
                out = []
                for quote in walk(seed, n, regime):
                    out.append((market, *quote))
                    if len(out) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return markets.select("market_id", "seed", "n", "regime").mapInArrow(run, QUOTES)


# Weights of an order's draws: side, distance from the touch, life; the range of lots; weights of four markets.
SIDES, TOUCH, LIVES, LOTS, MARKETS = (5, 5), (6, 3, 1), (8, 1, 1), (1_000_000, 50_000_000), (4, 3, 2, 1)
DRAWS = 6


def drawn(rows: DataFrame) -> DataFrame:
    """Orders of streams: rows (seed, k) with bid_raw and ask_raw become orders by six words each, in order side,
    place, distance, life, quantity, market; a weighted draw is the first cumulative weight above the word."""
    schema = "seed long, k long, market long, side string, life string, price_raw long, qty_raw long"

    def pick(word, weights):
        return np.searchsorted(np.cumsum(np.array(weights, np.uint64)), word % np.uint64(sum(weights)), "right")

    def run(batches):
        for batch in batches:
            seed, k, bid, ask = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seed", "k", "bid_raw", "ask_raw")]
            word = [words(seed, (k * DRAWS + 1 + i).astype(np.uint64)) for i in range(DRAWS)]
            side, place = pick(word[0], SIDES), pick(word[1], TOUCH)
            away = (word[2] % np.uint64(DEPTH)).astype(np.int64) * TICK + TICK
            # A bid rests below the bid, joins it or crosses above the ask; an ask is its mirror image.
            for_bid = np.select([place == 0, place == 1], [bid - away, bid], ask + away)
            for_ask = np.select([place == 0, place == 1], [ask + away, ask], bid - away)
            price = np.maximum(np.where(side == 0, for_bid, for_ask), TICK) // TICK * TICK
            lots = LOTS[0] + (word[4] % np.uint64(LOTS[1] - LOTS[0] + 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(k), pa.array(pick(word[5], MARKETS).astype(np.int64)), pa.array(np.array(["bid", "ask"])[side], pa.string()),
                                              pa.array(np.array(["gtc", "ioc", "fok"])[pick(word[3], LIVES)], pa.string()), pa.array(price), pa.array(lots)],
                                             ["seed", "k", "market", "side", "life", "price_raw", "qty_raw"])

    return rows.select("seed", "k", "bid_raw", "ask_raw").mapInArrow(run, schema)


class Link:
    """Queues of nine classes. Class 0 goes first while its quantum lasts; else classes take turns, each visit to a
    waiting class adds 256 bytes of credit for each unit of its weight, and a frame leaves when its class can pay."""

    # Weights by class and the quantum of class 0.
    WEIGHTS, QUANTUM, CREDIT = (32, 16, 12, 12, 8, 8, 6, 4, 2), 64 * 1024, 256

    def __init__(self, frames=64, size=1 << 20, burst=48, served=24):
        self.frames, self.size, self.burst, self.served = frames, size, burst, served
        self.queues, self.bytes = [deque() for _ in self.WEIGHTS], [0] * len(self.WEIGHTS)
        self.credit, self.turn, self.quantum, self.sent, self.seen = [0] * len(self.WEIGHTS), 0, self.QUANTUM, 0, 0

    def admit(self, kind, frame, size):
        queue = self.queues[kind]
        if len(queue) >= self.frames or (queue and self.bytes[kind] + size > self.size):
            return False
        queue.append((frame, size))
        self.bytes[kind] += size
        return True

    def _leave(self, kind):
        frame, size = self.queues[kind].popleft()
        self.bytes[kind] -= size
        return kind, frame, size

    def send(self):
        """(class, frame, size) that leaves next; None if nothing waits."""
        if not any(self.queues):
            return None
        if self.queues[0] and self.quantum > 0 and (self.queues[0][0][1] <= self.quantum or self.quantum == self.QUANTUM):
            out = self._leave(0)
            self.quantum = max(self.quantum - out[2], 0)
            return out
        n = len(self.WEIGHTS)
        for kind in [(self.turn + i) % n for i in range(n)]:
            if not self.queues[kind]:
                continue
            self.credit[kind] += self.WEIGHTS[kind] * self.CREDIT
            if self.queues[kind][0][1] <= self.credit[kind]:
                out = self._leave(kind)
                self.credit[kind] -= out[2]
                self.turn = (kind + 1) % n
                if kind:
                    self.quantum = self.QUANTUM
                return out
        # Nobody can pay: a waiting class 0 gets a new quantum, else the first that waits goes.
        kind = next(k for k in range(n) if self.queues[k])
        if kind == 0:
            self.quantum = self.QUANTUM
        return self._leave(kind)

    def _out(self, link, rounds):
        for _ in range(rounds):
            left = self.send()
            if left is None:
                return
            self.sent += 1
            yield link, left[1], left[0], left[2], "sent", self.sent

    def apply(self, row):
        self.link = row["link"]
        if not self.admit(row["class"], row["frame"], row["size"]):
            yield row["link"], row["frame"], row["class"], row["size"], "backpressure", None
        self.seen += 1
        if self.seen % self.burst == 0:
            yield from self._out(row["link"], self.served)

    def close(self):
        yield from self._out(self.link, 1 << 62)


def scheduled(frames: DataFrame, machine=Link) -> DataFrame:
    """What becomes of each frame (link, frame, class, size), and the place at which it was sent; in order of frame."""
    return folded(frames, "link", ["frame"], machine, "link long, frame long, class int, size long, outcome string, place long")


_MARKETS = f"with {TICKS}, picked as (select market_id, count(*) as n from ticks group by market_id) select cast(market_id as bigint) as market_id, cast(market_id * 7919 as bigint) as seed, cast(n as bigint) as n, cast(market_id % 5 as bigint) as regime from picked"
_ORDERS = f"with {TICKS} select cast(user_id as bigint) as seed, cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) as k, cast(price_raw @/ {TICK} * {TICK} + {TICK} as bigint) as bid_raw, cast(price_raw @/ {TICK} * {TICK} + 3 * {TICK} as bigint) as ask_raw from ticks"


def _quotes(spark, sf_dir):
    return quotes(sql.run(spark, sf_dir, _MARKETS).withColumn("regime", F.get(F.array(*[F.lit(r) for r in REGIMES]), F.col("regime").cast("int"))))


def _frames(spark, sf_dir):
    rows = sql.run(spark, sf_dir, f"with {TICKS} select cast(user_id % 16 as bigint) as link, cast(event_id as bigint) as frame, cast(event_id * 7 % 9 as int) as class, cast(price_raw % 9000 + 40 as bigint) as size from ticks")
    return scheduled(rows)


QUERIES = {"synthetic_quotes": _quotes, "order_draws": lambda spark, sf_dir: drawn(sql.run(spark, sf_dir, _ORDERS)), "class_schedule": _frames}

# The oracles walk the stream word by word, with 128-bit integers.
_STEP = f"({{}} * {MULTIPLIER}::hugeint + {INCREMENT}::hugeint) % 18446744073709551616::hugeint"
_WORD = "xor({0}, {0} // 536870912::hugeint)"


def _cases(word, weights, names):
    total, out, upto = sum(weights), "case", 0
    for weight, name in zip(weights, names):
        upto += weight
        out += f" when {word} % {total} < {upto} then {name}"
    return out + " end"


def _quote_oracle():
    moved = f"""w % (2 * volatility + 1) - volatility + case regime when 1 then ({MID} - mid) // {TICK} // {REVERSION} when 2 then {TREND}
      when 4 then case when step > 0 and step % {SHOCK_EVERY} = 0 then case when step // {SHOCK_EVERY} % 2 = 0 then {SHOCK} else -{SHOCK} end else 0 end else 0 end"""
    base, half = DEPTH * 10_000_000, (SPREAD + 1) // 2 * TICK
    return sql.render("with recursive m as (" + _MARKETS + ")", "oracle") + f""", drawn as (select market_id, regime, n, 0 as step, {_STEP.format('seed::hugeint')} as a from m
  union all select market_id, regime, n, step + 1, {_STEP.format('a')} from drawn where step + 1 < 2 * n),
pairs as materialized (select market_id, regime, step // 2 as step, max(case when step % 2 = 0 then {_WORD.format('a')} end) as w, max(case when step % 2 = 1 then {_WORD.format('a')} end) as v from drawn group by 1, 2, 3),
walk as (select market_id, -1 as stage, {MID}::hugeint as mid, {VOLATILITY}::hugeint as volatility, 0::hugeint as last, 0::hugeint as v from m
  union all select market_id, step, greatest(mid + move * {TICK}, {TICK * (SPREAD + 2)}), case when regime = 3 then least(greatest((3 * volatility + greatest(abs(last), 1)) // 4, 1), {16 * VOLATILITY}) else volatility end, move, drawn_v
    from (select k.market_id, p.step, p.regime, k.mid, k.volatility, k.last, p.v as drawn_v, {moved} as move from walk k join pairs p on p.market_id = k.market_id and p.step = k.stage + 1) s)
select market_id, cast(stage as bigint) as step, cast(greatest(mid - {half}, {TICK}) as bigint) as bid_raw, cast(greatest(mid + {half}, greatest(mid - {half}, {TICK}) + {TICK}) as bigint) as ask_raw,
  cast(greatest({base} + {base} * (v % 2000001 - 1000000) // 2000000, 1) as bigint) as bid_depth_raw, cast(greatest({base} - {base} * (v % 2000001 - 1000000) // 2000000, 1) as bigint) as ask_depth_raw,
  cast(v % 2000001 - 1000000 as bigint) as imbalance_raw from walk where stage >= 0"""


def _order_oracle():
    words_of = ", ".join(f"max(case when step % {DRAWS} = {i} then {_WORD.format('a')} end) as w{i}" for i in range(DRAWS))
    away = f"(w2 % {DEPTH} + 1) * {TICK}"
    price = (f"case when w0 % {sum(SIDES)} < {SIDES[0]} then {_cases('w1', TOUCH, (f'bid_raw - {away}', 'bid_raw', f'ask_raw + {away}'))} else {_cases('w1', TOUCH, (f'ask_raw + {away}', 'ask_raw', f'bid_raw - {away}'))} end")
    return sql.render("with recursive o as (" + _ORDERS + ")", "oracle") + f""", ends as (select seed, {DRAWS} * count(*) as n from o group by 1),
drawn as (select seed, n, 0 as step, {_STEP.format('seed::hugeint')} as a from ends union all select seed, n, step + 1, {_STEP.format('a')} from drawn where step + 1 < n),
wide as (select seed, step // {DRAWS} as k, {words_of} from drawn group by 1, 2)
select seed, k, cast({_cases('w5', MARKETS, range(len(MARKETS)))} as bigint) as market, {_cases('w0', SIDES, ("'bid'", "'ask'"))} as side, {_cases('w3', LIVES, ("'gtc'", "'ioc'", "'fok'"))} as life,
  cast(greatest({price}, {TICK}) as bigint) as price_raw, cast({LOTS[0]} + w4 % {LOTS[1] - LOTS[0] + 1} as bigint) as qty_raw from o join wide using (seed, k)"""


SQL = {"synthetic_quotes": _quote_oracle(), "order_draws": _order_oracle()}
