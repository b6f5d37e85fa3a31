"""Scalar functions, predicates and joins as queries; each text serves both engines.

MAXED is the largest 64-bit integer. Amounts are signed integers of micro-units, so every division that the
rules call "toward zero" is `@/`, and a rounding up adds one where a positive remainder is left.
"""
from ledgermill.operators.derivatives import FILLS, NEWEST, RESTING, TICKS
from ledgermill.plans import sql

MAXED = 9223372036854775807
# Amounts of both signs, a ratio and a large number from the event stream.
SIGNED = TICKS + """, signed as (select event_id, user_id, market_id, event_type, at_us, price_raw, case when event_id % 2 = 0 then price_raw else -price_raw end as amount_raw,
  (event_id % 7 - 3) * 150000 + 1 as ratio_raw, case when event_id % 3 = 0 then 9223372036854775000 when event_id % 3 = 1 then -9223372036854775000 else 5 end as big_raw from ticks)"""
# Strict decimals and near misses.
STRINGS = TICKS + """, strings as (select event_id, case event_id % 10 when 0 then concat(' ', cast(event_id as string), '.5 ') when 1 then concat('-', cast(event_id as string), '.000001') when 2 then '.25' when 3 then '+7'
  when 4 then '1.2345678' when 5 then '' when 6 then '-' when 7 then '1e5' when 8 then concat(cast(event_id as string), '.') else concat('1', cast(price_raw as string), '.', lpad(cast(event_id % 1000 as string), 6, '0')) end as s from events join (select event_id as e, price_raw from ticks) t on event_id = e)"""
# States as fixed values: the legal edges of the market lifecycle.
EDGES = """edges as (select * from (values ('draft', 'staked'), ('staked', 'bootstrapping'), ('bootstrapping', 'open'), ('bootstrapping', 'halted'), ('open', 'halted'), ('open', 'closed'), ('halted', 'open'),
  ('halted', 'bootstrapping'), ('halted', 'closed'), ('halted', 'archived'), ('closed', 'pending_resolution'), ('pending_resolution', 'disputed'), ('pending_resolution', 'resolved'), ('pending_resolution', 'invalid'),
  ('disputed', 'resolved'), ('disputed', 'invalid'), ('resolved', 'settled'), ('invalid', 'settled'), ('settled', 'archived')) as e(before, after))"""
STATES = """states as (select * from (values (0, 'draft'), (1, 'staked'), (2, 'bootstrapping'), (3, 'open'), (4, 'halted'), (5, 'closed'), (6, 'pending_resolution'), (7, 'disputed'), (8, 'resolved'), (9, 'invalid'),
  (10, 'settled'), (11, 'archived')) as s(code, state))"""
# Lifecycle moves: each event asks its market to go from one state to another.
MOVES = TICKS + f", {STATES}, {EDGES}, moves as (select event_id, market_id, a.state as before, b.state as after from ticks join states a on a.code = event_id % 12 join states b on b.code = (event_id * 5 + user_id) % 12)"
META = """meta as (select distinct user_id % 16 as market_id, case user_id % 16 when 3 then 'halted' when 5 then 'closed' else 'open' end as state,
  case user_id % 5 when 0 then 'normal' when 1 then 'degraded' when 2 then 'stale' else 'halted' end as health from events where user_id < 16)"""

_SQL = {
    "checked_add": f"with {SIGNED} select event_id, tryadd(big_raw, amount_raw) as sum_raw, trysub(big_raw, amount_raw) as difference_raw from signed",
    "saturating_add": f"with {SIGNED} select event_id, cast(least(greatest(cast(big_raw as WIDE) + amount_raw, -{MAXED} - 1), {MAXED}) as bigint) as sum_raw, cast(least(greatest(cast(big_raw as WIDE) - amount_raw, -{MAXED} - 1), {MAXED}) as bigint) as difference_raw from signed",
    "multiply_by_ratio": f"with {SIGNED} select event_id, amount_raw * ratio_raw @/ 1000000 as down_raw, amount_raw * ratio_raw @/ 1000000 + case when (amount_raw * ratio_raw) % 1000000 > 0 then 1 else 0 end as up_raw from signed",
    "scale_by_ratio": f"with {SIGNED} select event_id, cast(least(greatest(cast(cast(amount_raw as WIDE) * ratio_raw as WIDE), -{MAXED}), {MAXED}) @/ 1000000 as bigint) as scaled_raw from signed",
    "basis_points": f"with {TICKS} select event_id, (event_id % 20001 - 10000) * 100 as ratio_raw, (event_id % 200) * 1000000 as quantity_raw, cast((event_id % 200) * 1000000 as bigint) as amount_raw from ticks",
    "mul_div": f"with {SIGNED} select event_id, cast(cast(amount_raw as WIDE) * (user_id + 1) @/ (market_id + 3) as bigint) as quotient_raw from signed",
    "decimal_parse": f"with {STRINGS}, parsed as (select event_id, trim(s) as t from strings), cut as (select event_id, t, case when substr(t, 1, 1) in ('-', '+') then substr(t, 2) else t end as r from parsed), parts as (select event_id, t, case when instr(r, '.') > 0 then substr(r, 1, instr(r, '.') - 1) else r end as i, case when instr(r, '.') > 0 then substr(r, instr(r, '.') + 1) else '' end as f from cut) select event_id, case when i = '' and f = '' then 'malformed' when length(f) > 6 then 'too_precise' when not full_match(concat(i, f), '^[0-9]+$') then 'malformed' else 'ok' end as status, case when length(f) <= 6 and full_match(concat(i, f), '^[0-9]+$') then case when substr(t, 1, 1) = '-' then -1 else 1 end * (cast(concat('0', i) as bigint) * 1000000 + cast(rpad(f, 6, '0') as bigint)) end as amount_raw from parts",
    "decimal_format": f"with {SIGNED} select event_id, concat(case when amount_raw < 0 then '-' else '' end, cast(abs(amount_raw) @/ 1000000 as string), '.', lpad(cast(abs(amount_raw) % 1000000 as string), 6, '0')) as amount from signed",
    "ops_per_second": f"with {SIGNED} select market_id, count(*) as n, cast(sum(case when market_id % 4 = 0 then 0 else price_raw end) as bigint) as total_ns, case when sum(case when market_id % 4 = 0 then 0 else price_raw end) = 0 then 0 else count(*) * 1000000000 @/ cast(sum(case when market_id % 4 = 0 then 0 else price_raw end) as bigint) end as ops from signed group by market_id",
    "opposite_side": f"with {FILLS} select market_id, taker_side, case when taker_side = 'bid' then 'ask' else 'bid' end as maker_side, count(*) as n from fills group by market_id, taker_side",
    "sequence_follows": f"with {TICKS} select event_id, user_id, case when event_id < {MAXED} then event_id + 1 end as next_sequence, coalesce(event_id = before + 1, false) as follows from (select event_id, user_id, lag(event_id) over (partition by user_id order by event_id) as before from ticks) t",
    "sequence_lag": f"with {TICKS} select market_id, user_id, greatest(head - tail, 0) as lag, greatest(tail - head, 0) as other_way, greatest(newest_us - oldest_us, 0) as age_us from (select market_id, user_id, max(event_id) as head, min(event_id) + user_id as tail, max(at_us) as newest_us, min(at_us) as oldest_us from ticks group by market_id, user_id) t",
    "clock_corrected_delta": f"with {TICKS}, stages as (select event_id, k as stage, at_us * 1000 + k * (price_raw % 1000) + case when k = 5 then -2000 else 0 end as raw_ns, (user_id % 3) * k as offset_ns from ticks cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7) s) select a.event_id, a.stage, case when (b.raw_ns - b.offset_ns) - (a.raw_ns - a.offset_ns) >= 0 then (b.raw_ns - b.offset_ns) - (a.raw_ns - a.offset_ns) end as delta_ns from stages a join stages b on b.event_id = a.event_id and b.stage = a.stage + 1",
    "burst_rate": f"with {TICKS} select event_id, 1000 as steady, case when event_id % 15 < 5 then 4000 else 0 end as bursty, case when user_id <= 1 then 1000 else 1000 * (event_id % user_id) @/ (user_id - 1) end as ramp from ticks where user_id > 0",
    "crossing": f"with {RESTING}, best as (select market_id, max(case when side = 'bid' then price_raw end) as bid_raw, min(case when side = 'ask' then price_raw end) as ask_raw from resting group by market_id), takers as (select market_id, order_id, line_no, taker_side, price_raw, lots, case when line_no = 1 then 0 when line_no = 2 then price_raw else -1 end as market_price, line_no <= 2 as is_market from fills where flag <> 'N') select t.market_id, order_id, line_no, taker_side, price_raw, lots, case when is_market and market_price <= 0 then case when taker_side = 'bid' then ask_raw is not null else bid_raw is not null end when taker_side = 'bid' then coalesce(price_raw >= ask_raw, false) else coalesce(price_raw <= bid_raw, false) end as crosses from takers t join best b on t.market_id = b.market_id",
    "post_only_check": f"with {RESTING}, best as (select market_id, max(case when side = 'bid' then price_raw end) as bid_raw, min(case when side = 'ask' then price_raw end) as ask_raw from resting group by market_id), takers as (select market_id, order_id, line_no, taker_side, price_raw, lots, flag from fills where flag <> 'N') select t.market_id, order_id, line_no, price_raw, lots, taker_side, case when taker_side = 'bid' then coalesce(price_raw >= ask_raw, false) else coalesce(price_raw <= bid_raw, false) end as would_cross, flag = 'R' and not case when taker_side = 'bid' then coalesce(price_raw >= ask_raw, false) else coalesce(price_raw <= bid_raw, false) end as can_rest from takers t left join best b on t.market_id = b.market_id",
    "trigger_fires": f"with {TICKS} select event_id, price_raw, price_raw >= 250000000 as above, price_raw <= 100000000 as below, case when user_id % 2 = 0 then price_raw <= 100000000 else price_raw >= 250000000 end as stop_loss, case when user_id % 2 = 0 then price_raw >= 250000000 else price_raw <= 100000000 end as take_profit from ticks",
    "admission_gate": f"with {TICKS}, {META} select t.event_id, t.market_id, coalesce(m.state = 'open' and m.health in ('normal', 'degraded'), false) as admitted from ticks t left join meta m on t.market_id = m.market_id",
    "lifecycle_predicates": f"with {MOVES} select event_id, before, before = 'open' as accepts_orders, before = 'archived' as terminal from moves",
    "legal_transition": f"with {MOVES} select m.event_id, m.market_id, m.before, m.after, e.before is not null as legal from moves m left join edges e on m.before = e.before and m.after = e.after",
    "lifecycle_illegal": f"with {MOVES} select m.event_id, m.market_id, m.before, m.after from moves m left join edges e on m.before = e.before and m.after = e.after where e.before is null",
    "withdrawal_transition": f"with {TICKS}, kinds as (select * from (values (0, 'pending'), (1, 'confirming'), (2, 'finalized'), (3, 'failed')) as k(code, status)) select event_id, a.status as before, b.status as after, case a.status when 'pending' then true when 'confirming' then b.status <> 'pending' else a.status = b.status end as legal, a.status in ('finalized', 'failed') as terminal from ticks join kinds a on a.code = event_id % 4 join kinds b on b.code = user_id % 4",
    "finality_status": f"with {TICKS} select event_id, user_id % 20 as confirmations, user_id % 20 >= 12 as final, case when user_id % 20 = 0 then 'pending' when user_id % 20 < 12 then 'confirming' else 'finalized' end as status from ticks",
    "chain_policy": f"with {TICKS}, asked as (select event_id, user_id, price_raw, user_id % 20 as confirmations, sum(price_raw) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as pending_raw, count(*) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as n_pending from ticks) select event_id, case when price_raw < 0 or price_raw > 400000000 then 'amount' when confirmations < 6 then 'confirmations' when coalesce(pending_raw, 0) + price_raw > 5000000000 then 'pending' when n_pending + 1 > 20 then 'rate' else 'ok' end as verdict from asked",
    "observation_scope": f"with {TICKS}, producers as (select user_id, market_id as scope, user_id % 3 = 0 as every, user_id % 7 <> 0 as registered from (select distinct user_id, market_id from ticks) u) select t.event_id, t.market_id, t.user_id, p.registered and (p.every or p.scope = t.market_id) as authorized, t.at_us <= n.now_us + 1000000 as not_future, n.now_us - t.at_us <= 86400000000 as fresh from ticks t join (select max(at_us) - 3600000000 as now_us from ticks) n on true left join producers p on p.user_id = t.user_id",
    "window_contains": f"with {TICKS}, span as (select min(at_us) as lo_us, max(at_us) as hi_us from ticks) select event_id, at_us >= lo_us + (hi_us - lo_us) @/ 4 and at_us < lo_us + (hi_us - lo_us) @/ 2 as inside, event_id < 500 + user_id as challenge_open, event_id >= 500 + user_id as challenge_expired from ticks cross join span",
    "probability_vector": f"with {TICKS}, vectors as (select market_id, source, price_raw % 1000001 as p from ticks where event_id % 37 = 0), scaled as (select market_id, p, case when market_id % 2 = 0 then p * 1000000 @/ nullif(sum(p) over (partition by market_id), 0) else p end as q from vectors) select market_id, count(*) as n, min(case when q between 0 and 1000000 then 1 else 0 end) = 1 and abs(sum(q) - 1000000) <= count(*) as valid from scaled group by market_id",
    "payout_conservation": f"with {TICKS}, entries as (select user_id, event_id, case when user_id % 4 = 0 then 1000000 @/ n when user_id % 4 = 1 then price_raw % 100 - 5 when user_id % 4 = 2 then 0 else 600000 end + case when user_id % 4 = 0 and r = n then 1000000 - n * (1000000 @/ n) else 0 end as v from (select user_id, event_id, price_raw, row_number() over (partition by user_id order by event_id) as r, count(*) over (partition by user_id) as n from ticks where event_id % 9 = 0) t) select user_id, case when count(*) > 256 then 'too_many' when min(v) < 0 then 'negative' when sum(v) = 0 then 'zero_sum' when sum(v) > 1000000 then 'over_allocated' when sum(v) < 1000000 then 'under_allocated' else 'ok' end as verdict, cast(sum(v) as bigint) as total_raw from entries group by user_id",
    "session_authorize": f"with {TICKS}, sessions as (select user_id, min(at_us) + 500000000000 as expires_us, user_id % 16 as scope, 100 + user_id * 10 as last_nonce from ticks group by user_id), used as (select t.*, event_id % 2000 as nonce, row_number() over (partition by user_id, event_id % 2000 order by event_id) as r from ticks t) select u.event_id, case when s.user_id is null then 'unknown' when u.at_us > s.expires_us then 'expired' when u.market_id <> s.scope then 'scope' when u.price_raw > 300000000 then 'notional' when u.nonce > s.last_nonce then 'nonce_range' when u.r > 1 then 'nonce_used' else 'ok' end as verdict from used u left join sessions s on u.user_id = s.user_id",
    "slash_evidence": f"with {TICKS}, messages as (select event_id, market_id, user_id % 10 as sponsor, event_id @/ 100 as epoch, event_type as kind, price_raw @/ 1000000 as payload from ticks), conflicts as (select market_id, sponsor, epoch, kind, count(distinct payload) as n_payloads, min(payload) as least, max(payload) as most from messages group by market_id, sponsor, epoch, kind having count(distinct payload) > 1), beats as (select market_id, sponsor, epoch, epoch - lag(epoch) over (partition by market_id, sponsor order by epoch) as gap from (select distinct market_id, sponsor, epoch from messages) e) select 'double_sign' as fault, market_id, sponsor, epoch, n_payloads as measure from conflicts union all select 'absence', market_id, sponsor, epoch, gap from beats where gap > 3",
    "class_authorization": f"with {TICKS}, permits as (select * from (values ('view', 0), ('view', 1), ('click', 1), ('click', 2), ('signup', 0), ('purchase', 0), ('purchase', 1), ('purchase', 2), ('purchase', 3)) as p(role, class)) select event_id, event_type, user_id % 4 as class, exists (select 1 from permits p where p.role = t.event_type and p.class = t.user_id % 4) as permitted from ticks t",
    "market_lookup": f"with {FILLS}, meta as (select p_partkey as market_id, p_type, p_size from part where p_partkey < 64) select f.market_id, p_type, p_size, count(*) as n_fills from fills f join meta m on f.market_id = m.market_id group by f.market_id, p_type, p_size",
    "registered_signers": f"with {TICKS} select event_id, user_id from ticks t where user_id in (select c_custkey from customer where c_acctbal > 0)",
    "deposits_not_credited": f"with {TICKS}, credited as (select distinct user_id, price_raw from ticks where event_id % 5 = 0) select t.event_id, t.user_id, t.price_raw from ticks t left join credited c on t.user_id = c.user_id and t.price_raw = c.price_raw where c.user_id is null",
    "interval_overlap": f"with {TICKS}, steps as (select market_id, event_id, price_raw, at_us as lo, lead(at_us) over (partition by market_id order by at_us, price_raw, event_id) as hi from ticks), windows as (select market_id, min(at_us) + (max(at_us) - min(at_us)) @/ 3 as a, min(at_us) + 2 * ((max(at_us) - min(at_us)) @/ 3) as b from ticks group by market_id) select s.market_id, event_id, price_raw, greatest(lo, a) as from_us, least(hi, b) as to_us from steps s join windows w on s.market_id = w.market_id and lo < b and hi > a where least(hi, b) > greatest(lo, a)",
    "as_of_snapshot": f"with {TICKS} select market_id, event_id, last_snapshot, event_id - last_snapshot as n_behind from (select market_id, event_id, max(case when event_id % 50 < 3 then event_id end) over (partition by market_id order by event_id rows unbounded preceding) as last_snapshot from ticks) t where last_snapshot is not null",
    "counterparties": f"with {NEWEST}, sided as (select source as market_id, user_id, price_raw, case when user_id @/ 8 % 2 = 0 then 1 else -1 end as side from newest) select a.market_id, a.user_id as victim, count(*) as n_opposite, max(b.price_raw) as best_raw from sided a join sided b on a.market_id = b.market_id and a.side <> b.side group by a.market_id, a.user_id",
    "peers_by_market": f"with {TICKS}, regions as (select user_id, user_id % 5 as region from (select distinct user_id from ticks) u) select t.market_id, r.region, count(distinct t.user_id) as n_peers, min(t.user_id) as first_peer from ticks t join regions r on t.user_id = r.user_id group by t.market_id, r.region",
}
SQL = sql.oracles(_SQL)
QUERIES = sql.queries(_SQL)


def query(name):
    return QUERIES[name]
