"""Price-time matching of a market's ordered commands.

Commands of one market depend on all before them, so a market is one ordered stream: commands are dealt by
market, sorted by sequence and folded batch by batch, holding only the live book. A hot market is bound to one
task by its meaning; markets run side by side.

Commands: place, cancel, cancel_all, replace, basket (legs under one basket id and sequence: all are done or none),
position (sets the account's position for reduce-only orders). Kinds: limit, market, post_only, reduce_only; lives:
gtc, ioc, fok. An account does not trade with itself: policy cancel_maker, cancel_taker or cancel_both.
"""
import copy
from bisect import bisect_left, insort
from collections import OrderedDict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgermill.operators.derivatives import FILLS
from ledgermill.plans import sql

COMMANDS = ["market_id", "seq", "action", "order_id", "account", "side", "kind", "life", "price_raw", "lots", "reduce_only", "client_id"]
EVENTS = "market_id long, seq long, event string, order_id long, maker_order long, account long, maker_account long, side string, price_raw long, lots long, outcome string"


@dataclass
class Resting:
    order_id: int
    account: int
    side: str
    price: int
    lots: int
    arrival: int
    client_id: int = 0


@dataclass
class Book:
    policy: str = "cancel_maker"
    remember: int = 1024
    orders: dict = field(default_factory=dict)
    # Of each side, the orders of a price in time, and the prices in order, the best last (ask prices are negated).
    queues: dict = field(default_factory=lambda: {"bid": {}, "ask": {}})
    prices: dict = field(default_factory=lambda: {"bid": [], "ask": []})
    owned: dict = field(default_factory=dict)
    positions: dict = field(default_factory=dict)
    done: dict = field(default_factory=dict)
    arrivals: int = 0

    def best(self, side):
        """The order that is first in price and time on a side, or None."""
        prices = self.prices[side]
        return next(iter(self.queues[side][prices[-1]].values())) if prices else None

    def rest(self, c, lots):
        self.arrivals += 1
        order = Resting(c["order_id"], c["account"], c["side"], c["price_raw"], lots, self.arrivals, c.get("client_id") or 0)
        self.orders[order.order_id] = order
        self.owned.setdefault(order.account, set()).add(order.order_id)
        place = order.price if order.side == "bid" else -order.price
        queue = self.queues[order.side].get(place)
        if queue is None:
            queue = self.queues[order.side][place] = OrderedDict()
            insort(self.prices[order.side], place)
        queue[order.order_id] = order

    def remove(self, order):
        del self.orders[order.order_id]
        owned = self.owned[order.account]
        owned.remove(order.order_id)
        if not owned:
            del self.owned[order.account]
        place, queues, prices = order.price if order.side == "bid" else -order.price, self.queues[order.side], self.prices[order.side]
        del queues[place][order.order_id]
        if not queues[place]:
            del queues[place], prices[bisect_left(prices, place)]

    def walk(self, side):
        """The orders of a side by price and time."""
        for place in reversed(self.prices[side]):
            yield from self.queues[side][place].values()

    def crosses(self, c, price):
        if c["kind"] == "market" and c["price_raw"] <= 0:
            return True
        return c["price_raw"] >= price if c["side"] == "bid" else c["price_raw"] <= price

    def crossable(self, c, need):
        """Lots that the order could take, in order, up to its need."""
        total = 0
        for order in self.walk("ask" if c["side"] == "bid" else "bid"):
            if total >= need or not self.crosses(c, order.price):
                break
            if order.account == c["account"]:
                if self.policy == "cancel_maker":
                    continue
                break
            total += order.lots
        return total

    def place(self, c):
        """Events of one order; the last is its report."""
        if c["lots"] <= 0:
            return [("report", None, None, 0, 0, "non_positive_quantity")]
        if c["kind"] != "market" and c["price_raw"] <= 0:
            return [("report", None, None, 0, 0, "non_positive_price")]
        if c["order_id"] in self.orders:
            return [("report", None, None, 0, 0, "duplicate_order_id")]
        lots = c["lots"]
        if c["reduce_only"] or c["kind"] == "reduce_only":
            held = self.positions.get(c["account"], 0)
            lots = min(lots, max(0, held if c["side"] == "ask" else -held))
            if not lots:
                return [("report", None, None, 0, 0, "rejected")]
        other = "ask" if c["side"] == "bid" else "bid"
        if c["kind"] == "post_only":
            best = self.best(other)
            if best and self.crosses(c, best.price):
                return [("report", None, None, 0, 0, "rejected")]
            self.rest(c, lots)
            return [("report", None, None, 0, lots, "resting")]
        if c["life"] == "fok" and self.crossable(c, lots) < lots:
            return [("report", None, None, 0, 0, "rejected")]
        events, left, stopped = [], lots, False
        while left and not stopped:
            maker = self.best(other)
            if not maker or not self.crosses(c, maker.price):
                break
            if maker.account == c["account"]:
                stopped = self.policy != "cancel_maker"
                if self.policy != "cancel_taker":
                    self.remove(maker)
                    events.append(("self_trade_cancel", maker.order_id, maker.account, maker.price, maker.lots, None))
                continue
            take = min(left, maker.lots)
            events.append(("fill", maker.order_id, maker.account, maker.price, take, None))
            left -= take
            maker.lots -= take
            if not maker.lots:
                self.remove(maker)
        if not left:
            outcome, left = "filled", 0
        elif c["kind"] != "market" and not stopped and c["life"] == "gtc":
            self.rest(c, left)
            outcome = "partially_filled_resting" if left < lots else "resting"
        else:
            outcome = "partially_filled_cancelled" if left < lots else "rejected"
        return [*events, ("report", None, None, 0, left, outcome)]

    def submit(self, c):
        """Place once for each client id of an account; a repeat gets the first report again."""
        key = (c["account"], c["client_id"])
        if c["client_id"] and key in self.done:
            return [("report", None, None, 0, self.done[key][0], f"replay:{self.done[key][1]}")]
        events = self.place(c)
        if c["client_id"] and events[-1][5] not in ("non_positive_quantity", "non_positive_price", "duplicate_order_id"):
            self.done[key] = events[-1][4:]
            if len(self.done) > self.remember:
                del self.done[next(iter(self.done))]
        return events

    def cancel(self, order_id):
        order = self.orders.get(order_id)
        if not order:
            return [("report", order_id, None, 0, 0, "unknown_order")]
        self.remove(order)
        return [("cancelled", order_id, order.account, order.price, order.lots, None)]

    def cancel_all(self, account):
        return [e for i in sorted(self.owned.get(account, ())) for e in self.cancel(i)]

    def replace(self, c):
        order = self.orders.get(c["order_id"])
        if c["lots"] <= 0 or c["price_raw"] <= 0 or not order:
            return [("report", None, None, 0, 0, "non_positive_quantity" if c["lots"] <= 0 else "non_positive_price" if c["price_raw"] <= 0 else "unknown_order")]
        self.remove(order)
        return self.place({**c, "account": order.account, "side": order.side, "kind": "limit", "life": "gtc", "reduce_only": False, "client_id": order.client_id})

    def basket(self, legs):
        """All legs or none."""
        kept = copy.deepcopy((self.orders, self.queues, self.prices, self.owned, self.done, self.arrivals))
        out = []
        for c in legs:
            events = self.submit({**c, "action": "place"})
            out += [(c, e) for e in events]
            if events[-1][5] not in ("filled", "resting", "partially_filled_resting"):
                self.orders, self.queues, self.prices, self.owned, self.done, self.arrivals = kept
                return [(c, ("report", None, None, 0, 0, "basket_rejected")) for c in legs]
        return out

    def apply(self, c):
        if c["action"] == "cancel":
            return self.cancel(c["order_id"])
        if c["action"] == "cancel_all":
            return self.cancel_all(c["account"])
        if c["action"] == "replace":
            return self.replace(c)
        if c["action"] == "position":
            self.positions[c["account"]] = c["lots"]
            return []
        return self.submit(c)

    def levels(self, side):
        """(price, lots, orders) of a side, best first."""
        out = {}
        for o in self.orders.values():
            if o.side == side:
                lots, n = out.get(o.price, (0, 0))
                out[o.price] = lots + o.lots, n + 1
        return [(p, *out[p]) for p in sorted(out, reverse=side == "bid")]


def match(commands: DataFrame, policy="cancel_maker", only=None) -> DataFrame:
    """Events of all markets, and at the end of each its resting orders; `only` names the events to put out, so that no others are made into rows."""
    fields = [f.split() for f in EVENTS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, types[t]) for n, t in fields])

    def rows(market, seq, c, events):
        return [(market, seq, e, c["order_id"], maker, c["account"], maker_account, c["side"], price, lots, outcome) for e, maker, maker_account, price, lots, outcome in events if not only or e in only]

    def values(column):
        if pa.types.is_string(column.type):
            coded = column.dictionary_encode()
            names = [*coded.dictionary.to_pylist(), None]
            return [names[i] for i in coded.indices.fill_null(-1).to_numpy().tolist()]
        return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def closing(market, book):
        return [(market, None, "resting", o.order_id, None, o.account, None, o.side, o.price, o.lots, None) for o in sorted(book.orders.values(), key=lambda o: o.order_id) if not only or "resting" in only]

    def flush(book, market, legs):
        return [r for c, e in book.basket(legs) for r in rows(market, c["seq"], c, [e])]

    def run(batches):
        market, book, legs = None, None, []
        for b in batches:
            out = []
            for c in (dict(zip(COMMANDS, r)) for r in zip(*map(values, b.columns))):
                if legs and (c["market_id"] != market or c["action"] != "basket" or c["seq"] != legs[0]["seq"]):
                    out += flush(book, market, legs)
                    legs = []
                if c["market_id"] != market:
                    if book:
                        out += closing(market, book)
                    market, book = c["market_id"], Book(policy)
                if c["action"] == "basket":
                    legs.append(c)
                else:
                    out += rows(market, c["seq"], c, book.apply(c))
            if out:
                yield batch(out)
        if book:
            out = (flush(book, market, legs) if legs else []) + closing(market, book)
            if out:
                yield batch(out)

    ordered = commands.select(*COMMANDS).repartition("market_id").sortWithinPartitions("market_id", "seq", "order_id")
    return ordered.mapInArrow(run, EVENTS)


# Each fill of the star schema as a command on its market's book: mostly limit orders around the price, some of every other kind.
STREAM = f"""with {FILLS}, ordered as (select market_id, taker as account, taker_side as side, 1000000 * (900 + (price_raw @/ 1000000) % 40) as price_raw, lots,
  row_number() over (partition by market_id order by at_us, order_id, line_no, price_raw, lots, maker) as seq from fills)
select market_id, cast(seq as bigint) as seq, case when seq % 11 = 0 then 'cancel' when seq % 13 = 0 then 'replace' when seq % 97 = 0 then 'cancel_all' when seq % 17 = 0 then 'position' else 'place' end as action,
  cast(case when seq % 11 = 0 then seq - 7 when seq % 13 = 0 then seq - 9 else seq end as bigint) as order_id, account, side,
  case seq % 10 when 0 then 'market' when 1 then 'post_only' else 'limit' end as kind, case seq % 7 when 0 then 'ioc' when 1 then 'fok' else 'gtc' end as life,
  case when seq % 20 = 0 then 0 else price_raw end as price_raw, lots, seq % 29 = 0 as reduce_only, cast(case when seq % 31 = 0 then account else 0 end as bigint) as client_id from ordered"""


def stream(spark, sf_dir):
    return sql.run(spark, sf_dir, STREAM)


REPORTS = ("report", "cancelled", "self_trade_cancel")
QUERIES = {
    "book_fills": lambda s, d: match(stream(s, d), only=("fill",)).select("market_id", "seq", "order_id", "maker_order", "account", "maker_account", "side", "price_raw", "lots"),
    "book_reports": lambda s, d: match(stream(s, d), only=REPORTS).select("market_id", "seq", "event", "order_id", "maker_order", "lots", "outcome"),
    "book_resting": lambda s, d: match(stream(s, d), only=("resting",)).select("market_id", "order_id", "account", "side", "price_raw", "lots"),
    "book_levels": lambda s, d: match(stream(s, d), "cancel_both", ("resting",)).groupBy("market_id", "side", "price_raw").agg({"lots": "sum", "order_id": "count"})
    .selectExpr("market_id", "side", "price_raw", "`sum(lots)` as lots", "`count(order_id)` as n_orders"),
}
SQL: dict = {}
