"""Aggregations, ranked and ordered operators, set operations and oracle health; each text serves both engines."""
from ledgermill.operators.derivatives import ACCOUNTS, CLAIMS, FILLS, LEGS, RANKED, RESTING, TEXTS, TICKS, _FOLD
from ledgermill.plans import sql

# The whole local aggregation: scope, freshness, newest of a signer, centre, deviation, band, gates, price.
LOCAL = TICKS + """, clock as (select max(at_us) as now_us from ticks),
producers as (select user_id, user_id % 8 as source, 3 + user_id % 3 as cap from (select distinct user_id from ticks) u where user_id % 11 <> 0),
allowed as (select t.market_id, t.user_id, p.source, price_raw, least(greatest(weight, 0), cap) as weight, event_id as sequence, greatest(now_us - at_us, 0) as age_us
  from ticks t join producers p on t.user_id = p.user_id cross join clock where at_us <= now_us + 1000000 and now_us - at_us <= 864000000000),
records as (select * from (select *, row_number() over (partition by market_id, user_id order by sequence desc, price_raw desc, weight desc) as newest from allowed) t where newest = 1),
placed as (select market_id, price_raw, 2 * sum(weight) over (partition by market_id order by price_raw, weight, user_id rows unbounded preceding) as cum, sum(weight) over (partition by market_id) as total,
  row_number() over (partition by market_id order by price_raw, weight, user_id) as r, count(*) over (partition by market_id) as n from records),
centers as (select market_id, min(price_raw) as center_raw from placed where case when total > 0 then cum >= total else r = (n - 1) @/ 2 + 1 end group by market_id),
offs as (select r.*, center_raw, abs(price_raw - center_raw) as off_raw from records r join centers c on r.market_id = c.market_id),
mads as (select market_id, min(off_raw) as mad_raw from (select market_id, off_raw, row_number() over (partition by market_id order by off_raw, user_id) as r, count(*) over (partition by market_id) as n from offs) t where r = (n - 1) @/ 2 + 1 group by market_id),
survivors as (select o.*, mad_raw, mad_raw * 3000000 @/ 1000000 as band_raw from offs o join mads m on o.market_id = m.market_id where mad_raw = 0 or off_raw <= mad_raw * 3000000 @/ 1000000),
gates as (select market_id, bit_or(cast(power(2, source) as bigint)) as source_mask, count(distinct source) as n_sources, count(*) as n_observations, cast(sum(weight) as bigint) as confidence, min(age_us) as newest_age_us, max(band_raw) as band_raw, max(mad_raw) as mad_raw from survivors group by market_id),
last as (select market_id, price_raw, 2 * sum(weight) over (partition by market_id order by price_raw, weight, user_id rows unbounded preceding) as cum, sum(weight) over (partition by market_id) as total,
  row_number() over (partition by market_id order by price_raw, weight, user_id) as r, count(*) over (partition by market_id) as n from survivors),
prices as (select market_id, min(price_raw) as price_raw from last where case when total > 0 then cum >= total else r = (n - 1) @/ 2 + 1 end group by market_id),
local as (select g.*, p.price_raw, case when p.price_raw = 0 then 9223372036854775807 else mad_raw * 10000 @/ abs(p.price_raw) end as dispersion_bps from gates g join prices p on g.market_id = p.market_id),
judged as (select *, case when n_observations = 0 or n_sources < 1 or newest_age_us > 864000000000 then 'halted' when newest_age_us > 20000000000 then 'stale' when n_sources < 2 or dispersion_bps > 3000 then 'degraded' else 'normal' end as health from local)"""
VOTES = TICKS + ", ballots as (select market_id, user_id % 16 as bit, event_id @/ 64 as round, event_type as candidate, event_id, 1 + user_id % 5 as stake from ticks)"
SAMPLES = TICKS + ", buckets as (select event_type, case when price_raw = 0 then 0 else length(conv2(price_raw)) end as bucket, count(*) as n from ticks group by 1, 2), cums as (select event_type, bucket, sum(n) over (partition by event_type order by bucket rows unbounded preceding) as cum, sum(n) over (partition by event_type) as total from buckets)"
VECTORS = """vectors as (select p_partkey % 64 as market_id, row_number() over (partition by p_partkey % 64 order by p_partkey) - 1 as outcome, count(*) over (partition by p_partkey % 64) as n, p_size * 20000 as payout_raw from part where p_partkey < 256)"""
COUNTERS = TICKS + """, counters as (select user_id % 10 as agent, event_id @/ 100 as ordinal, count(*) as offered, count(*) - count(case when event_type = 'error' then 1 end) as written, count(case when event_type = 'error' then 1 end) as dropped,
  count(case when event_type in ('view', 'click') then 1 end) as accepted, count(case when event_type = 'purchase' then 1 end) as rejected, count(case when event_type = 'signup' then 1 end) as timeouts from ticks group by user_id % 10, event_id @/ 100)"""

_SQL = {
    "aggregate_local": f"with {LOCAL} select market_id, price_raw, price_raw - band_raw as lower_raw, price_raw + band_raw as upper_raw, confidence, source_mask, n_sources, n_observations, newest_age_us, dispersion_bps, case when n_sources < 1 then 'too_few_sources' when n_observations < 3 then 'too_few_observations' else 'ok' end as verdict from local",
    "oracle_health": f"with {LOCAL} select market_id, health, case health when 'normal' then 'trade_normally' when 'degraded' then 'trade_cautiously' when 'stale' then 'freeze_new_risk' else 'halt' end as action from judged",
    "default_health": f"with {LOCAL}, asked as (select distinct l_partkey % 64 as market_id from lineitem) select a.market_id, coalesce(j.health, 'halted') as health from asked a left join judged j on a.market_id = j.market_id",
    "apply_certificate": f"with {TICKS} select market_id, event_id, sequence, sequence > coalesce(before, -1) as accepted from (select market_id, event_id, event_id - event_id % 7 as sequence, max(event_id - event_id % 7) over (partition by market_id order by at_us, event_id rows between unbounded preceding and 1 preceding) as before from ticks) t",
    "lower_median": f"with {TICKS} select market_id, min(price_raw) as median_raw from (select market_id, price_raw, row_number() over (partition by market_id order by price_raw, event_id) as r, count(*) over (partition by market_id) as n from ticks) t where r = (n - 1) @/ 2 + 1 group by market_id",
    "cross_node_median": f"with {TICKS}, nodes as (select market_id, source as node, max(event_id) as sequence, cast(sum(price_raw) as bigint) @/ count(*) as price_raw, count(*) as confidence, min(at_us) as at_us, case when market_id = 7 then source else 1 end as version from ticks group by market_id, source), ranked as (select *, 2 * sum(confidence) over (partition by market_id order by price_raw, confidence, node rows unbounded preceding) as cum, sum(confidence) over (partition by market_id) as total from nodes) select market_id, min(case when cum >= total then price_raw end) as price_raw, cast(max(total) as bigint) as confidence, min(at_us) as at_us from ranked group by market_id having count(distinct version) = 1",
    "source_mask": f"with {TICKS} select market_id, bit_or(cast(power(2, user_id % 32) as bigint)) as mask, cast(bit_count(bit_or(cast(power(2, user_id % 32) as bigint))) as bigint) as n_sources from ticks group by market_id",
    "filled_quantity": f"with {FILLS} select order_id, taker, cast(sum(qty_raw) as bigint) as filled_raw, count(*) as n_fills from fills group by order_id, taker",
    "match_summary": f"with {RANKED}, taken as (select *, cast(sum(lots) over (partition by market_id order by price_raw, place rows between unbounded preceding and 1 preceding) as bigint) as before from ranked where side = 'ask'), fills2 as (select market_id, price_raw, least(lots, greatest(0, 300 - coalesce(before, 0))) as fill from taken) select market_id, cast(sum(fill) as bigint) as filled_lots, max(case when fill > 0 then price_raw end) as worst_raw, cast(sum(price_raw * fill @/ 7) as bigint) as notional_raw, cast(sum(price_raw * fill @/ 7 + case when (price_raw * fill) % 7 > 0 then 1 else 0 end) as bigint) as notional_ceil_raw from fills2 where fill > 0 group by market_id",
    "scenario_margin": f"with {VECTORS}, {LEGS}, held as (select account, market_id, cast(sum(lots) as bigint) as net from legs group by account, market_id), pnl as (select h.account, h.market_id, min(v.payout_raw * net) as worst_raw, max(v.payout_raw * net) as best_raw from held h join vectors v on h.market_id = v.market_id group by h.account, h.market_id) select account, cast(sum(worst_raw) as bigint) as worst_raw, cast(sum(best_raw) as bigint) as best_raw, cast(greatest(0, -sum(worst_raw)) as bigint) as required_raw from pnl group by account",
    "scenario_stats": f"with {VECTORS} select market_id, cast(sum(payout_raw) as bigint) as sum_raw, min(payout_raw) as min_raw, max(payout_raw) as max_raw, count(*) as n from vectors group by market_id",
    "worst_case_equity": f"WITHFOLD {ACCOUNTS}, {VECTORS}, worst as (select p.account, cast(sum(w) as bigint) as worst_raw from (select p.account, p.market_id, min(payout_raw * net_lots) as w from positions p join vectors v on p.market_id = v.market_id group by p.account, p.market_id) p group by p.account) select r.account, collateral_raw + unrealized_raw + coalesce(worst_raw, 0) as worst_equity_raw, greatest(0, -coalesce(worst_raw, 0)) as required_raw from risk r left join worst w on r.account = w.account",
    "free_collateral": f"WITHFOLD {ACCOUNTS}, reserved as (select taker as account, cast(sum(price_raw * lots) as bigint) as reserved_raw from fills where flag = 'R' group by taker) select r.account, collateral_raw + unrealized_raw - (exposure_raw + 9) @/ 10 - (coalesce(reserved_raw, 0) + 9) @/ 10 as free_raw, coalesce(reserved_raw, 0) as reserved_raw from risk r left join reserved v on r.account = v.account",
    "payout_settlement": f"with {VECTORS}, {CLAIMS}, held as (select market_id, account, outcome, units from claims), settled as (select h.market_id, cast(sum(h.units * v.payout_raw @/ 1000000) as bigint) as paid_units, cast(sum(h.units) as bigint) as locked_units from held h join vectors v on h.market_id = v.market_id and h.outcome = v.outcome group by h.market_id) select market_id, locked_units, paid_units, locked_units - paid_units as dust_units from settled",
    "payout_sum": f"with {VECTORS} select market_id, cast(sum(payout_raw) as bigint) as total_raw, cast(greatest(0, max(payout_raw * 3), -min(payout_raw * -3)) as bigint) as liability_raw from vectors group by market_id",
    "haircut": f"WITHFOLD {ACCOUNTS}, solvent as (select account % 16 as pool, account, collateral_raw from risk where collateral_raw > 0), shared as (select *, sum(collateral_raw) over (partition by pool) as total, least(5000000000, cast(sum(collateral_raw) over (partition by pool) as bigint)) as loss_raw from solvent), floors as (select pool, account, collateral_raw, loss_raw, cast(cast(loss_raw as WIDE) * collateral_raw @/ total as bigint) as base_raw from shared), slack as (select *, collateral_raw - base_raw as slack_raw, cast(loss_raw - sum(base_raw) over (partition by pool) as bigint) as rest_raw, cast(coalesce(sum(collateral_raw - base_raw) over (partition by pool order by account rows between unbounded preceding and 1 preceding), 0) as bigint) as before_raw from floors) select pool, account, base_raw + least(slack_raw, greatest(rest_raw - before_raw, 0)) as haircut_raw from slack",
    "sponsor_revenue": f"with sponsors as (select s_nationkey as market_id, s_suppkey as sponsor, 50 + s_suppkey * 37 % 400 as bps, cast(floor(s_acctbal * 100 + 0.5) as bigint) as stake from supplier), pools as (select market_id, cast(sum(stake) as bigint) as pool_raw, cast(sum(bps) as bigint) as total_bps, cast(sum(stake) as bigint) as total_stake from sponsors group by market_id) select s.market_id, sponsor, pool_raw * bps @/ 10000 as revenue_raw, total_stake, total_bps, cast(pool_raw - sum(pool_raw * bps @/ 10000) over (partition by s.market_id) as bigint) as remainder_raw from sponsors s join pools p on s.market_id = p.market_id",
    "bond_total": f"with {TICKS} select market_id, cast(sum(case when event_type = 'error' then price_raw else 0 end) as bigint) as bonds_raw, count(case when event_type = 'error' then 1 end) as n_challenges from ticks group by market_id",
    "quorum_weight": f"with {VOTES}, bitmaps as (select round, bit_or(cast(power(2, bit) as bigint)) as bitmap from ballots where candidate <> 'error' group by round), weights as (select w.bit, 1 + w.bit % 5 as stake from (select distinct bit from ballots) w) select b.round, bitmap, cast(sum(stake) as bigint) as weight, sum(stake) >= 30 as reached from bitmaps b join weights w on bitmap @/ cast(power(2, w.bit) as bigint) % 2 = 1 group by b.round, bitmap",
    "quorum_thresholds": f"with {TICKS} select event_id, total, byzantine, 2 * byzantine + 1 as m_threshold, total - byzantine as l_threshold, total >= 5 * byzantine + 1 as sized from (select event_id, user_id as total, event_id % 40 as byzantine from ticks) t",
    "witness_certification": f"with {VOTES}, receipts as (select distinct round, candidate, bit, stake from ballots), grouped as (select round, candidate, cast(sum(stake) as bigint) as weight, count(distinct bit) as n_witnesses from (select round, candidate, bit, max(stake) as stake from receipts group by round, candidate, bit) r group by round, candidate), roots as (select round, count(*) as n_roots from grouped group by round) select g.round, candidate, weight, n_witnesses, weight >= 20 as certified, n_roots > 1 as equivocation from grouped g join roots r on g.round = r.round",
    "ledger_conservation": f"with {LEGS}, postings as (select account % 8 as shard, case when lots > 0 then 'available' else 'reserved' end as bucket, lots * price_raw as delta from legs union all select account % 8, 'escrowed', -lots * price_raw from legs where lots < 0 union all select account % 8, 'locked', -lots * price_raw from legs where lots > 0) select shard, cast(sum(delta) as bigint) as total_raw, cast(sum(case when bucket = 'available' then delta else 0 end) as bigint) as available_raw, cast(sum(case when bucket = 'reserved' then delta else 0 end) as bigint) as reserved_raw, sum(delta) = 0 as conserved from postings group by shard",
    "registry_reconcile": f"with shares as (select s_nationkey as market_id, cast(sum(floor(s_acctbal + 0.5)) as bigint) as staked from supplier group by s_nationkey), buckets as (select n_nationkey as market_id, coalesce((select cast(sum(floor(s_acctbal + 0.5)) as bigint) from supplier where s_nationkey = n_nationkey), 0) + case when n_nationkey = 3 then 1 else 0 end as bucket from nation) select b.market_id, bucket, coalesce(staked, 0) as staked, bucket = coalesce(staked, 0) as reconciles from buckets b left join shares s on b.market_id = s.market_id",
    "counter_merge": f"with {COUNTERS} select ordinal, cast(sum(offered) as bigint) as offered, cast(sum(written) as bigint) as written, cast(sum(dropped) as bigint) as dropped, cast(sum(accepted) as bigint) as accepted, cast(sum(rejected) as bigint) as rejected, cast(sum(timeouts) as bigint) as timeouts, count(*) as n_agents from counters group by ordinal",
    "counter_conservation": f"with {COUNTERS} select agent, ordinal, case when offered <> written + dropped then 'offered' when written <> accepted + rejected + timeouts then 'written' else 'ok' end as verdict from counters",
    "histogram_quantile": f"with {SAMPLES} select event_type, cast(power(2, min(case when cum * 1000 >= total * 500 then bucket end)) as bigint) - 1 as p50, cast(power(2, min(case when cum * 1000 >= total * 990 then bucket end)) as bigint) - 1 as p99 from cums group by event_type",
    "log_linear_histogram": f"with {TICKS}, parts as (select event_type, user_id % 4 as agent, length(conv2(price_raw)) as bits, price_raw from ticks where price_raw > 0), cells as (select event_type, agent, bits, case when bits <= 6 then price_raw else price_raw @/ cast(power(2, bits - 6) as bigint) - 32 end as slot, count(*) as n from parts group by 1, 2, 3, 4) select event_type, bits, slot, cast(sum(n) as bigint) as n, count(*) as n_agents from cells group by event_type, bits, slot",
    "throughput_gate": f"with {TICKS}, runs as (select user_id % 6 as run, count(*) as accepted, count(case when event_type <> 'error' then 1 end) as executed, count(case when event_type not in ('error', 'signup') then 1 end) as finalized, max(at_us) - min(at_us) as span_us from ticks group by user_id % 6) select run, least(accepted, executed, finalized) * 1000000000 @/ span_us as per_1000_s, executed < accepted as lost_in_execution, finalized < executed as lost_in_finality from runs",
    "report_merge": f"with {TICKS}, agents as (select user_id % 5 as agent, case when price_raw = 0 then 0 else length(conv2(price_raw)) end as bucket, count(*) as n, sum(price_raw) as total, max(price_raw) as top from ticks group by 1, 2) select bucket, cast(sum(n) as bigint) as n, cast(sum(total) as bigint) as total_raw, max(top) as top_raw, count(*) as n_agents from agents group by bucket",
    "unique_count": f"with {FILLS} select market_id, count(distinct taker) as n_unique, count(*) - count(distinct taker) as n_duplicates from fills group by market_id",
    "approximate_quantiles": f"with {SAMPLES} select event_type, count(*) as n_buckets, cast(max(total) as bigint) as n, cast(power(2, max(bucket)) as bigint) - 1 as upper_bound from cums group by event_type",
    "liquidation_queue": f"WITHFOLD {ACCOUNTS}, due as (select account, account % 4 as scan from risk where collateral_raw + unrealized_raw < (exposure_raw + 19) @/ 20 union all select account, 4 from risk where collateral_raw + unrealized_raw < 0), firsts as (select account, min(scan) as first_scan from due group by account) select account, cast(row_number() over (order by first_scan, account) as bigint) as place from firsts",
    "twap_coverage": f"with {TICKS}, spans as (select market_id, min(at_us) + (max(at_us) - min(at_us)) @/ 4 as a, min(at_us) + 3 * ((max(at_us) - min(at_us)) @/ 4) as b from ticks group by market_id), steps as (select market_id, price_raw, at_us, lead(at_us) over (partition by market_id order by at_us, price_raw, event_id) as next_us from ticks), clipped as (select s.market_id, price_raw, a, b, greatest(at_us, a) as lo, least(coalesce(next_us, b), b) as hi, next_us from steps s join spans w on s.market_id = w.market_id) select market_id, cast(cast(sum(cast(cast(price_raw as WIDE) * (hi - lo) as WIDE)) as WIDE) @/ cast(sum(hi - lo) as bigint) as bigint) as twap_raw, cast(sum(case when next_us is not null then hi - lo else 0 end) as bigint) as covered_us, sum(case when next_us is not null then hi - lo else 0 end) * 1000000 >= (max(b) - max(a)) * 900000 as covered from clipped where hi > lo group by market_id",
    "chain_linkage": f"with {TICKS}, checkpoints as (select user_id % 8 as shard, event_id - event_id % 4 as first_sequence, event_id - event_id % 4 + 3 as last_sequence, max(price_raw) as new_root, count(*) as n from ticks group by user_id % 8, event_id - event_id % 4), linked as (select *, lag(new_root) over (partition by shard order by first_sequence) as previous_root, lag(last_sequence) over (partition by shard order by first_sequence) as previous_last from checkpoints) select shard, first_sequence, new_root, coalesce(previous_root, 0) as previous_root, coalesce(previous_last + 1 = first_sequence, true) as contiguous from linked",
    "fork_detection": f"with {TICKS}, roots as (select user_id % 8 as shard, event_id @/ 16 as first_sequence, price_raw @/ 100000000 as root from ticks) select shard, first_sequence, count(distinct root) as n_roots, min(root) as least_root, max(root) as most_root from roots group by shard, first_sequence having count(distinct root) > 1",
    "peer_ranking": f"with {TICKS}, peers as (select user_id as peer, user_id % 5 as region, case when user_id % 9 = 0 then null else min(price_raw) end as rtt, count(*) as reputation from ticks group by user_id), ranked as (select *, row_number() over (order by case when region = 2 then 0 else 1 end, rtt nulls last, reputation desc, peer) as r, row_number() over (partition by region = 2 order by rtt nulls last, reputation desc, peer) as r_side from peers) select peer, region, cast(r as bigint) as place from ranked where r <= 7 or (region <> 2 and r_side = 1)",
    "status_monotonicity": f"with {TICKS}, ranks as (select user_id, event_id, case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'purchase' then 3 else 4 end as rank from ticks) select user_id, event_id, rank, rank > coalesce(before, -1) as advances from (select user_id, event_id, rank, lag(rank) over (partition by user_id order by event_id) as before from ranks) t",
    "paged_list": f"with {FILLS}, listed as (select order_id, line_no, market_id, price_raw, row_number() over (order by order_id, line_no, market_id, price_raw, lots, maker) as r from fills) select order_id, line_no, market_id, price_raw from listed where r > 250 and r <= 250 + least(500, 100)",
    "resting_orders": f"with {RESTING} select order_id, line_no, market_id, side, price_raw, lots, account from resting",
    "bounded_retention": f"with {FILLS} select market_id, order_id, line_no, cast(r as bigint) as age from (select market_id, order_id, line_no, row_number() over (partition by market_id order by at_us desc, order_id desc, line_no desc, price_raw desc, lots desc, maker desc) as r from fills) t where r <= 16",
    "external_reference": f"with {TICKS} select market_id, price_raw, 'native' as origin from ticks where event_id % 2 = 0 union all select market_id, price_raw, 'reference' from ticks where event_id % 10 = 1",
    "role_sets": f"with {TICKS}, masks as (select user_id, bit_or(case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 4 when 'purchase' then 8 else 16 end) as roles from ticks group by user_id) select a.user_id, a.roles, a.roles | b.roles as joined, a.roles & b.roles as common, (a.roles & 9) = 9 as holds from masks a join masks b on b.user_id = a.user_id + 1",
    "complement_outcomes": f"with {VECTORS} select a.market_id, a.outcome, cast(sum(b.payout_raw) as bigint) as others_raw, count(*) as n_others from vectors a join vectors b on a.market_id = b.market_id and a.outcome <> b.outcome group by a.market_id, a.outcome",
    "distinct_markets": f"with {FILLS} select distinct market_id from fills",
    "intersect_markets": f"with {FILLS} select market_id, taker as account from fills where taker_side = 'bid' intersect select market_id, taker from fills where taker_side = 'ask'",
    "except_markets": f"with {FILLS} select market_id, taker as account from fills where taker_side = 'bid' except select market_id, taker from fills where taker_side = 'ask'",
    "sliding_windows": f"with {TICKS}, spans as (select 0 as k union all select 1 union all select 2), hops as (select event_id, price_raw, (at_us @/ 600000000 - k) * 600000000 as from_us from ticks cross join spans) select from_us, count(*) as n, cast(sum(price_raw) as bigint) as total_raw from hops group by from_us",
    "session_windows": f"with {TICKS}, gaps as (select user_id, event_id, at_us, case when at_us - lag(at_us) over (partition by user_id order by at_us, event_id) <= 7200000000 then 0 else 1 end as starts from ticks), numbered as (select user_id, at_us, sum(starts) over (partition by user_id order by at_us, event_id rows unbounded preceding) as session from gaps) select user_id, cast(session as bigint) as session, min(at_us) as from_us, max(at_us) as to_us, count(*) as n from numbered group by user_id, session",
    "sequence_tracker": f"with {TICKS}, arrivals as (select user_id % 4 as topic, at_us, event_id, event_id - event_id % 3 as sequence from ticks), seen as (select *, max(sequence) over (partition by topic order by at_us, event_id rows between unbounded preceding and 1 preceding) as top from arrivals) select topic, event_id, sequence, case when top is null then 'apply' when sequence <= top then 'duplicate' when sequence = top + 1 then 'apply' else 'gap' end as verdict from seen",
    "idempotency_window": f"with {TICKS}, calls as (select user_id as principal, event_id, event_id @/ 8 as key, price_raw @/ 100000000 as digest from ticks), marked as (select *, max(key) over (partition by principal order by event_id rows between unbounded preceding and 1 preceding) as high, first_value(digest) over (partition by principal, key order by event_id rows unbounded preceding) as first_digest, row_number() over (partition by principal, key order by event_id) as attempt from calls) select principal, event_id, key, case when attempt = 1 and key < coalesce(high, 0) - 10 then 'expired' when attempt = 1 then 'fresh' when digest = first_digest then 'replay' else 'conflict' end as verdict from marked",
    "monotonic_gate": f"with {TICKS} select market_id, event_id, price_raw > coalesce(top, -1) as admitted from (select market_id, event_id, price_raw, max(price_raw) over (partition by market_id order by event_id rows between unbounded preceding and 1 preceding) as top from ticks) t",
    "vote_tally": f"with {VOTES}, firsts as (select round, bit, candidate, stake, event_id, row_number() over (partition by round, bit order by event_id) as r, first_value(candidate) over (partition by round, bit order by event_id rows unbounded preceding) as first_candidate from ballots), kinds as (select *, case when r = 1 then 'vote' when candidate = first_candidate then 'duplicate' else 'equivocation' end as kind from firsts) select round, event_id, bit, candidate, kind, cast(sum(case when kind = 'vote' then stake else 0 end) over (partition by round, candidate order by event_id rows unbounded preceding) as bigint) as weight from kinds",
    "receipt_finality": f"with {TICKS}, checkpoints as (select event_id @/ 50 as height, min(event_id) as first_sequence, max(event_id) as last_sequence, max(case when event_type = 'error' then 0 else 1 end) as certified from ticks group by event_id @/ 50), receipts as (select event_id as first_sequence, event_id + user_id % 6 as last_sequence, lag(event_id + user_id % 6) over (order by event_id) as before from ticks where event_id % 5 = 0) select r.first_sequence, c.height, r.last_sequence <= c.last_sequence as contained, coalesce(before >= r.first_sequence, false) as overlaps, case when r.last_sequence > c.last_sequence then 'rejected' when c.certified = 1 then 'finalized' else 'consensus_final' end as status from receipts r join checkpoints c on r.first_sequence >= c.first_sequence and r.first_sequence <= c.last_sequence",
    "batch_receipts": f"with {TICKS}, effects as (select event_id @/ 20 as batch, event_id, event_type <> 'error' as ok from ticks where event_id % 97 <> 0) select batch, count(*) as processed, count(case when ok then 1 end) as executed, count(case when not ok then 1 end) as failed, count(*) = 20 and max(event_id) - min(event_id) = 19 as complete from effects group by batch",
    "late_ranges": f"with {TICKS}, ranges as (select user_id % 8 as shard, at_us, event_id, event_id @/ 4 as range_no, price_raw @/ 200000000 as root from ticks), seen as (select *, max(range_no) over (partition by shard order by at_us, event_id rows between unbounded preceding and 1 preceding) as top, first_value(root) over (partition by shard, range_no order by at_us, event_id rows unbounded preceding) as first_root, row_number() over (partition by shard, range_no order by at_us, event_id) as r from ranges) select shard, event_id, range_no, case when r > 1 and root <> first_root then 'equivocation' when r > 1 then 'duplicate' when range_no > coalesce(top, -1) + 1 then 'buffered' when range_no <= coalesce(top, -1) then 'old' else 'applied' end as verdict from seen",
    "watermark_prune": f"with {TICKS} select t.market_id, t.event_id, t.at_us from ticks t join (select market_id, max(at_us) - 3600000000 as low_us from ticks group by market_id) m on t.market_id = m.market_id where t.at_us >= m.low_us",
    "lifecycle_agents": f"with {TICKS}, last as (select user_id, max(at_us) as seen_us, max(event_id % 3) as epoch, max(case when event_type = 'purchase' then 1 else 0 end) as complete from ticks group by user_id), now as (select max(at_us) as now_us from ticks) select user_id, epoch, case when complete = 1 then 'complete' when now_us - seen_us > 7200000000 then 'missing' else 'alive' end as status from last cross join now",
    "topic_publish": f"with {TICKS} select event_type as topic, event_id, cast(row_number() over (partition by event_type order by at_us, event_id) as bigint) as sequence, case when (row_number() over (partition by event_type order by at_us, event_id) - 1) % 32 = 0 then 'snapshot' else 'delta' end as kind from ticks",
    "recovery_plan": f"with {TICKS}, published as (select event_type as topic, event_id, row_number() over (partition by event_type order by at_us, event_id) as sequence, count(*) over (partition by event_type) as n from ticks) select topic, cast(sequence as bigint) as sequence, case when sequence > n - 64 then 'delta' else 'snapshot_required' end as answer from published where sequence > n - 80",
    "outlier_nodes": f"with {TICKS}, roots as (select market_id, source as node, cast(sum(price_raw) as bigint) % 3 as root from ticks group by market_id, source), votes as (select market_id, root, count(*) as n from roots group by market_id, root), majority as (select market_id, root, n from (select *, row_number() over (partition by market_id order by n desc, root) as r from votes) v where r = 1) select r.market_id, r.node, r.root, m.root as majority_root, r.root <> m.root as outlier from roots r join majority m on r.market_id = m.market_id",
}
TEXT = {d: {n: t.replace("FOLDED", _FOLD[d]) for n, t in _SQL.items()} for d in TEXTS}
SQL = sql.oracles(TEXT["oracle"])
QUERIES = sql.queries(TEXT["spark"])


def query(name):
    return QUERIES[name]
