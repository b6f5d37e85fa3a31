"""Risk commands, ledgers, payouts, settlement, conditional orders and reads; each text serves both engines."""
import heapq

from ledgermill.operators.aggregates import LOCAL, VECTORS
from ledgermill.operators.derivatives import ACCOUNTS, CLAIMS, FILLS, RESTING, TICKS, _FOLD
from ledgermill.operators.fold import folded
from ledgermill.plans import sql

# Orders that wait for a price: a stop or take-profit of each user, from its first event on.
WAITING = TICKS + """, waiting as (select user_id, market_id, min(event_id) as placed, case when user_id % 2 = 0 then 'sell' else 'buy' end as side, 60000000 + user_id * 1000000 as low_raw, 480000000 - user_id * 1000000 as high_raw,
  30 + user_id % 50 as quantity, 1 + user_id % 7 as slices from ticks group by user_id, market_id)"""
# Signed movements on each account's collateral.
MOVES = FILLS + """, moves as (select taker as account, 'credit' as kind, price_raw * lots as delta_raw, at_us, order_id, line_no from fills where flag = 'A' union all select taker, 'debit', -price_raw * lots, at_us, order_id, line_no from fills where flag = 'R'
  union all select taker, 'fee', -((price_raw * lots * 5 + 9999) @/ 10000), at_us, order_id, line_no from fills union all select maker, 'funding', price_raw % 1000 - 500, at_us, order_id, line_no from fills where flag = 'N')"""
# Complete sets: minted and redeemed over all outcomes alike, transferred one outcome at a time.
SETS = TICKS + """, commands as (select event_id, user_id, market_id, case event_id % 4 when 0 then 'redeem' when 1 then 'transfer' else 'mint' end as kind, 1 + price_raw % 50 as units, user_id % 3 as outcome, (user_id * 7) % 150 as receiver from ticks),
postings as (select event_id, user_id as holder, market_id, k as outcome, case when kind = 'mint' then units when kind = 'redeem' then -units @/ 2 else 0 end as delta, case when kind = 'mint' then units when kind = 'redeem' then -units @/ 2 else 0 end as locked from commands cross join (select 0 as k union all select 1 union all select 2) o where kind <> 'transfer'
  union all select event_id, user_id, market_id, outcome, -units, 0 from commands where kind = 'transfer' and user_id <> receiver union all select event_id, receiver, market_id, outcome, units, 0 from commands where kind = 'transfer' and user_id <> receiver)"""
RESOLVED = VECTORS + ", weights as (select market_id, outcome, n, payout_raw, sum(payout_raw) over (partition by market_id) as total from vectors)"

_SQL = {
    "accounts_table": f"WITHFOLD {ACCOUNTS} select account, collateral_raw - realized_raw as deposited_raw, case when account % 2 = 0 then 'cross' else 'isolated' end as margin_mode, collateral_raw > 0 as open from risk",
    "collateral_moves": f"with {MOVES} select account, kind, cast(sum(delta_raw) as bigint) as delta_raw, count(*) as n from moves group by account, kind",
    "market_settings": f"with {TICKS} select market_id, price_raw as mark_raw, event_id % 8 as risk_group, 1000000000 + price_raw as cap_raw from (select *, row_number() over (partition by market_id order by at_us desc, event_id desc) as r from ticks) t where r = 1",
    "pre_trade_check": f"WITHFOLD {ACCOUNTS}, asks as (select order_id, line_no, taker, market_id, price_raw * lots as notional_raw, row_number() over (partition by order_id, line_no, taker, market_id order by price_raw, lots) as r from fills where flag = 'R') select a.order_id, a.line_no, a.r, a.market_id, case when exposure_raw + notional_raw > 3000000000000 then 'portfolio_cap' when (exposure_raw + notional_raw + 9) @/ 10 > collateral_raw + unrealized_raw then 'margin' when exposure_raw + notional_raw > 20 * (collateral_raw + unrealized_raw) then 'leverage' when notional_raw > 2500000000 then 'market_cap' else 'ok' end as verdict from asks a join risk k on k.account = a.taker",
    "order_priority": f"WITHFOLD {ACCOUNTS} select account, case when account % 10 = 0 or collateral_raw + unrealized_raw <= (exposure_raw + 19) @/ 20 then 'risk_reducing' else 'normal' end as priority, collateral_raw + unrealized_raw < (exposure_raw + 19) @/ 20 as liquidatable from risk",
    "pre_trade_notional": f"with {FILLS} select order_id, line_no, market_id, price_raw, lots, price_raw * (qty_raw + 1) @/ 1000000 + case when (price_raw * (qty_raw + 1)) % 1000000 > 0 then 1 else 0 end as reserve_raw from fills",
    "resting_reserve": f"with {RESTING} select account, cast(sum(price_raw * lots) as bigint) as reserved_raw, cast(sum((price_raw * lots + 9) @/ 10) as bigint) as margin_raw, count(*) as n_orders from resting group by account",
    "resting_release": f"with {RESTING} select account, order_id, line_no, market_id, price_raw, lots, cast(sum(price_raw * lots) over (partition by account order by order_id, line_no, market_id, price_raw, lots, at_us rows unbounded preceding) as bigint) as reserved_raw from resting",
    "payout_positions": f"with {VECTORS}, {CLAIMS} select c.account, c.market_id, c.units, min(v.payout_raw * c.units) as worst_raw, max(v.payout_raw * c.units) as best_raw, count(*) as n_outcomes from claims c join vectors v on c.market_id = v.market_id group by c.account, c.market_id, c.units",
    "auto_deleverage": f"WITHFOLD {ACCOUNTS}, victims as (select v.market_id, v.account, net_lots from valued v join risk r on r.account = v.account where r.collateral_raw + r.unrealized_raw < (r.exposure_raw + 19) @/ 20 and net_lots <> 0), first_victim as (select * from (select *, row_number() over (partition by market_id order by account) as r from victims) t where r = 1), others as (select v.market_id, v.account, f.account as victim, abs(f.net_lots) as need, abs(v.net_lots) as have, v.net_lots * (v.mark_raw - v.entry_raw) as profit_raw from valued v join first_victim f on v.market_id = f.market_id and v.net_lots * f.net_lots < 0), queued as (select *, coalesce(sum(have) over (partition by market_id order by profit_raw desc, account rows between unbounded preceding and 1 preceding), 0) as before from others) select market_id, victim, account, cast(least(have, greatest(0, need - before)) as bigint) as closed_lots from queued where need > before",
    "insurance_cover": f"WITHFOLD {ACCOUNTS}, short as (select account, -(collateral_raw + unrealized_raw) as shortfall_raw from risk where collateral_raw + unrealized_raw < 0), queued as (select account, shortfall_raw, cast(coalesce(sum(shortfall_raw) over (order by account rows between unbounded preceding and 1 preceding), 0) as bigint) as before_raw from short) select account, shortfall_raw, least(shortfall_raw, greatest(0, 50000000000 - before_raw)) as drawn_raw from queued",
    "liquidate": f"WITHFOLD {ACCOUNTS}, due as (select account, collateral_raw + unrealized_raw as equity_raw from risk where collateral_raw + unrealized_raw < (exposure_raw + 19) @/ 20), short as (select account, greatest(0, -equity_raw) as shortfall_raw, equity_raw from due), queued as (select *, cast(coalesce(sum(shortfall_raw) over (order by account rows between unbounded preceding and 1 preceding), 0) as bigint) as before_raw from short) select account, equity_raw, least(shortfall_raw, greatest(0, 50000000000 - before_raw)) as insured_raw, shortfall_raw - least(shortfall_raw, greatest(0, 50000000000 - before_raw)) as socialized_raw from queued",
    "ledger_moves": f"with {MOVES}, books as (select account, case kind when 'credit' then 'available' when 'debit' then 'reserved' when 'fee' then 'escrowed' else 'locked' end as bucket, delta_raw from moves) select account, cast(sum(case when bucket = 'available' then delta_raw else 0 end) as bigint) as available_raw, cast(sum(case when bucket = 'reserved' then -delta_raw else 0 end) as bigint) as reserved_raw, cast(sum(case when bucket = 'escrowed' then -delta_raw else 0 end) as bigint) as escrowed_raw, cast(sum(case when bucket = 'locked' then delta_raw else 0 end) as bigint) as locked_raw, sum(case when bucket = 'available' then delta_raw else 0 end) >= sum(case when bucket = 'reserved' then -delta_raw else 0 end) as sufficient from books group by account",
    "escrow_balances": f"with {TICKS} select market_id, event_id % 7 as bucket, cast(sum(case when event_type = 'error' then -price_raw @/ 10 else price_raw end) as bigint) as balance_raw, count(*) as n_postings from ticks group by market_id, event_id % 7",
    "derive_mark": f"with {LOCAL}, quotes as (select l_partkey % 64 as market_id, max(case when l_linestatus = 'O' then cast(floor(l_extendedprice * 100 + 0.5) as bigint) end) as bid, min(case when l_linestatus = 'F' then cast(floor(l_extendedprice * 100 + 0.5) as bigint) end) as ask from lineitem where l_returnflag = 'N' group by l_partkey % 64) select j.market_id, health, case when health = 'halted' then null when health = 'normal' and bid is not null and ask is not null then (price_raw + (bid + ask) @/ 2) @/ 2 else price_raw end as mark_raw from judged j left join quotes q on j.market_id = q.market_id",
    "funding_payments": f"WITHFOLD {ACCOUNTS} select account, market_id, net_lots * mark_raw * (market_id % 7 - 3) @/ 10000 as payment_raw from valued",
    "realized_pnl": f"WITHFOLD {ACCOUNTS} select account, market_id, realized_raw from positions where realized_raw <> 0",
    "payout_winner": f"with {VECTORS} select market_id, outcome, case when outcome = market_id % n then 1000000 else 0 end as winner_raw, case when outcome < 2 then 1000000 @/ least(n, 2) + case when outcome = least(n, 2) - 1 then 1000000 - least(n, 2) * (1000000 @/ least(n, 2)) else 0 end else 0 end as dead_heat_raw, 1000000 @/ n + case when outcome = n - 1 then 1000000 % n else 0 end as refund_raw from vectors",
    "scalar_payout": f"with {TICKS}, settled as (select event_id, 50000000 as lo, 350000000 as hi, price_raw as v from ticks) select event_id, (least(greatest(v, lo), hi) - lo) * 1000000 @/ (hi - lo) as long_raw, 1000000 - (least(greatest(v, lo), hi) - lo) * 1000000 @/ (hi - lo) as short_raw from settled",
    "resolution_fractions": f"with {VECTORS} select market_id, outcome, 1000000 @/ n + case when outcome < 1000000 % n then 1 else 0 end as fraction_raw from vectors",
    "largest_remainder_claims": f"with {RESOLVED}, {CLAIMS}, owed as (select c.market_id, c.account, cast(sum(cast(c.units * 1000000 as bigint) * w.payout_raw @/ w.total) as bigint) as base_raw, cast(sum((cast(c.units * 1000000 as bigint) * w.payout_raw) % w.total) as bigint) as rest from claims c join weights w on c.market_id = w.market_id and c.outcome = w.outcome group by c.market_id, c.account), pots as (select market_id, cast(sum(base_raw) as bigint) + 7 as pot_raw from owed group by market_id) select o.market_id, o.account, base_raw + case when row_number() over (partition by o.market_id order by rest desc, o.account) <= 7 then 1 else 0 end as paid_raw from owed o join pots p on o.market_id = p.market_id",
    "complete_sets": f"with {SETS} select holder, market_id, outcome, cast(sum(delta) as bigint) as units from postings group by holder, market_id, outcome",
    "outstanding_sets": f"with {SETS} select market_id, outcome, cast(sum(delta) as bigint) as outstanding, cast(sum(locked) as bigint) as locked, sum(delta) = sum(locked) as balanced from postings group by market_id, outcome",
    "claim_fills": f"with {FILLS}, postings as (select taker as account, market_id, 'claims' as asset, lots as delta from fills union all select maker, market_id, 'claims', -lots from fills union all select taker, market_id, 'premium', -(price_raw * lots) from fills union all select maker, market_id, 'premium', price_raw * lots from fills) select account, market_id, asset, cast(sum(delta) as bigint) as delta from postings group by account, market_id, asset",
    "settle_market": f"with {RESOLVED}, {CLAIMS}, paid as (select c.market_id, c.account, case when w.outcome = c.market_id % w.n then c.units * 1000000 else 0 end as paid_raw from claims c join weights w on c.market_id = w.market_id and c.outcome = w.outcome) select market_id, account, cast(sum(paid_raw) as bigint) as paid_raw from paid group by market_id, account",
    "market_registry": f"with {FILLS}, listed as (select p_partkey as market_id, p_type as kind, p_size as size from part where p_partkey < 64) select l.market_id, l.kind, l.size, count(f.market_id) as n_fills, cast(coalesce(sum(f.lots), 0) as bigint) as volume_lots from listed l left join fills f on f.market_id = l.market_id group by l.market_id, l.kind, l.size",
    "archive_gate": f"with {CLAIMS}, {RESTING.removeprefix(FILLS)[2:]}, open_orders as (select market_id, count(*) as n from resting group by market_id), owed as (select market_id, cast(sum(units) as bigint) as units from claims group by market_id), seen as (select distinct market_id from fills) select s.market_id, case when coalesce(o.n, 0) > 40 then 'open_orders' when s.market_id % 5 = 0 then 'locked_collateral' when coalesce(w.units, 0) > 4000 then 'outstanding_claims' when s.market_id % 7 = 0 then 'challenges' else 'ok' end as verdict from seen s left join open_orders o on o.market_id = s.market_id left join owed w on w.market_id = s.market_id",
    "slash_amounts": f"with stakes as (select s_suppkey as sponsor, s_nationkey as market_id, greatest(0, cast(floor(s_acctbal * 100 + 0.5) as bigint)) * 10000 as stake_raw, least(10000, greatest(1000, s_suppkey * 730 % 12000)) as penalty_bps from supplier), cut as (select *, least(stake_raw, stake_raw * penalty_bps @/ 10000) as slash_raw from stakes) select sponsor, market_id, slash_raw, stake_raw - slash_raw as left_raw, sum(stake_raw - slash_raw) over (partition by market_id) < 30000000000 as halted from cut",
    "decision_selection": f"with {TICKS}, steps as (select market_id, source as action, price_raw, at_us, lead(at_us) over (partition by market_id, source order by at_us, price_raw, event_id) - at_us as held_us from ticks), twaps as (select market_id, action, cast(cast(sum(cast(cast(price_raw as WIDE) * held_us as WIDE)) as WIDE) @/ cast(sum(held_us) as bigint) as bigint) as twap_raw from steps where held_us > 0 group by market_id, action), utilities as (select market_id, action, twap_raw * (1000000 + action * 1000) @/ 1000000 as utility_raw from twaps) select market_id, action, utility_raw from (select *, row_number() over (partition by market_id order by utility_raw desc, action) as r from utilities) t where r = 1",
    "decision_settlement": f"with {SETS}, held as (select market_id, holder, outcome, cast(sum(delta) as bigint) as units from postings group by market_id, holder, outcome having sum(delta) > 0), chosen as (select distinct market_id, market_id % 3 as outcome from ticks) select h.market_id, h.holder, h.outcome, case when h.outcome = c.outcome then 'paid' when h.holder % 2 = 0 then 'refund' else 'void' end as kind, case when h.outcome = c.outcome or h.holder % 2 = 0 then h.units * 1000000 else 0 end as paid_raw from held h join chosen c on h.market_id = c.market_id",
    "instrument_ids": f"with {VECTORS} select market_id, outcome, n, market_id * 256 + outcome as instrument, (market_id * 256 + outcome) @/ 256 as action_back, (market_id * 256 + outcome) % 256 as outcome_back from vectors",
    "stop_orders": f"with {WAITING}, hits as (select w.user_id, w.market_id, w.side, t.event_id, t.price_raw from waiting w join ticks t on t.market_id = w.market_id and t.event_id > w.placed where (w.side = 'sell' and t.price_raw <= w.low_raw) or (w.side = 'buy' and t.price_raw >= w.high_raw)) select user_id, market_id, side, event_id as fired_at, price_raw from (select *, row_number() over (partition by user_id, market_id order by event_id) as r from hits) h where r = 1",
    "oco_orders": f"with {WAITING}, hits as (select w.user_id, w.market_id, t.event_id, case when t.price_raw <= w.low_raw then 'a' else 'b' end as leg from waiting w join ticks t on t.market_id = w.market_id and t.event_id > w.placed where t.price_raw <= w.low_raw or t.price_raw >= w.high_raw) select user_id, market_id, event_id as fired_at, leg from (select *, row_number() over (partition by user_id, market_id order by event_id, leg) as r from hits) h where r = 1",
    "twap_slices": f"with {WAITING}, ordinals as (select 0 as i union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) select user_id, market_id, i, quantity @/ slices + case when i < quantity % slices then 1 else 0 end as slice from waiting join ordinals on i < slices where quantity >= slices",
    "mark_evaluation": f"with {WAITING}, last as (select market_id, price_raw from (select *, row_number() over (partition by market_id order by event_id desc) as r from ticks) t where r = 1) select w.user_id, w.market_id, case when price_raw <= low_raw or price_raw >= high_raw then 'pending_execution' else 'waiting' end as state from waiting w join last l on l.market_id = w.market_id",
    "get_account": f"WITHFOLD {ACCOUNTS} select account, collateral_raw, collateral_raw + unrealized_raw as equity_raw, exposure_raw, case when collateral_raw + unrealized_raw < (exposure_raw + 19) @/ 20 then 'liquidatable' else 'healthy' end as status from risk where account = 7",
    "get_position": f"WITHFOLD {ACCOUNTS} select account, market_id, net_lots, entry_raw, net_lots * (mark_raw - entry_raw) as unrealized_raw from valued where account = 7",
    "get_orders": f"with {RESTING} select order_id, line_no, market_id, side, price_raw, lots from resting where account = 7",
    "get_markets": f"with {FILLS} select market_id, count(*) as n_fills, max(at_us) as last_us, cast(sum(lots) as bigint) as volume_lots from fills group by market_id",
    "get_market_status": f"WITHFOLD {ACCOUNTS} select p.market_id, max(m.mark_raw) as mark_raw, cast(sum(case when net_lots > 0 then net_lots else 0 end) as bigint) as open_interest_lots, count(*) as n_holders from positions p left join marks m on m.market_id = p.market_id where net_lots <> 0 group by p.market_id",
    "get_market_trades": f"with {FILLS} select order_id, line_no, taker, maker, price_raw, lots from (select *, row_number() over (order by at_us desc, order_id desc, line_no desc, price_raw, lots, maker) as r from fills where market_id = 5) t where r > 10 and r <= 10 + least(250, 100)",
    "get_oracle_status": f"with {LOCAL} select market_id, price_raw, n_sources, newest_age_us, health from judged",
    "get_latest_checkpoint": f"with {TICKS} select event_id @/ 50 as height, min(event_id) as first_sequence, max(event_id) as last_sequence, cast(sum(price_raw) as bigint) as digest from ticks where event_id @/ 50 = (select max(event_id @/ 50) from ticks) group by event_id @/ 50",
    "get_checkpoint": f"with {TICKS} select event_id @/ 50 as height, min(event_id) as first_sequence, max(event_id) as last_sequence, cast(sum(price_raw) as bigint) as digest from ticks where event_id @/ 50 = 3 group by event_id @/ 50",
    "get_execution_receipt": f"with {TICKS} select event_id, user_id, event_type, sha256hex(cast(event_id as string)) as receipt from ticks where sha256hex(cast(event_id as string)) = sha256hex(cast(17 as string))",
}
TEXT = {d: {n: t.replace("FOLDED", _FOLD[d]) for n, t in _SQL.items()} for d in _FOLD}
SQL = sql.oracles(TEXT["oracle"])
# Ticks of a market and, before them, the orders placed at the same event; an order fires at a later event only.
TAPE = f"""with {WAITING} select market_id, event_id, 1 as tick, cast(null as bigint) as user_id, cast(null as string) as side, price_raw, cast(null as bigint) as low_raw, cast(null as bigint) as high_raw
  from ticks where market_id is not null and event_id is not null and price_raw is not null
  union all select market_id, placed, 0, user_id, side, null, low_raw, high_raw from waiting where market_id is not null and placed is not null"""


class Trigger:
    """Orders of one market that wait for a price, each on a heap by its price, so that a tick meets only those it fires.

    With `both`, an order waits on both sides and its first leg cancels the other; at one event leg a goes first.
    """

    def __init__(self, both=False):
        self.both, self.event, self.lows, self.highs, self.new, self.gone = both, None, [], [], [], set()

    def wait(self):
        """Orders placed at an event that is over."""
        for r in self.new:
            if self.both or r["side"] == "sell":
                heapq.heappush(self.lows, (-r["low_raw"], r["user_id"], r["side"]))
            if self.both or r["side"] == "buy":
                heapq.heappush(self.highs, (r["high_raw"], r["user_id"], r["side"]))
        self.new = []

    def fire(self, heap, price):
        while heap and heap[0][0] <= price:
            _, user, side = heapq.heappop(heap)
            if user in self.gone:
                self.gone.remove(user)
                continue
            if self.both:
                self.gone.add(user)
            yield user, side

    def settle(self):
        """What fires at the event that is over: on its lowest and highest price."""
        if self.event is None or self.low is None:
            return
        for leg, heap, price, shown in (("a", self.lows, -self.low, self.low), ("b", self.highs, self.high, self.high)):
            for user, side in self.fire(heap, price):
                yield (user, self.market, self.event, leg) if self.both else (user, self.market, side, self.event, shown)

    def apply(self, r):
        if r["event_id"] != self.event:
            yield from self.close()
            self.wait()
            self.market, self.event, self.low, self.high = r["market_id"], r["event_id"], None, None
        if not r["tick"]:
            self.new.append(r)
        else:
            self.low = r["price_raw"] if self.low is None else min(self.low, r["price_raw"])
            self.high = r["price_raw"] if self.high is None else max(self.high, r["price_raw"])

    def close(self):
        yield from self.settle()


def stop_orders(spark, sf_dir):
    return folded(sql.run(spark, sf_dir, TAPE), "market_id", ["event_id"], Trigger, "user_id long, market_id long, side string, fired_at long, price_raw long")


def oco_orders(spark, sf_dir):
    return folded(sql.run(spark, sf_dir, TAPE), "market_id", ["event_id"], lambda: Trigger(True), "user_id long, market_id long, fired_at long, leg string")


QUERIES = sql.queries(TEXT["spark"]) | {"stop_orders": stop_orders, "oco_orders": oco_orders}


def query(name):
    return QUERIES[name]
