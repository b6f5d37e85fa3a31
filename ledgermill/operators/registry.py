"""Commands of markets and of conditional orders, folded in order: lifecycle, escrow, complete sets, resolution, acknowledgement.

A market is one key of the fold; its escrow holds the funds given to it. Every command answers with a verdict and
changes nothing unless it is `ok`.
"""
import re
from collections import defaultdict

from ledgermill.operators import rules
from ledgermill.operators.derivatives import TICKS
from ledgermill.operators.fold import folded
from ledgermill.plans import sql

UNIT, MOST_CHALLENGES = 1_000_000, 64
LEGAL = frozenset(re.findall(r"\('(\w+)', '(\w+)'\)", rules.EDGES))
IN_ROUND = ("pending_resolution", "disputed")
# A resolution policy may still change in these states.
OPEN_POLICY = ("draft", "staked", "bootstrapping", "open", "halted", "closed", "pending_resolution")


class Refused(Exception):
    """A command that breaks a rule; its text is the verdict."""


def need(holds, verdict):
    if not holds:
        raise Refused(verdict)


def refund(outcomes: int) -> list:
    """An equal split of one unit; the last outcome takes the dust."""
    share = UNIT // outcomes
    return [share] * (outcomes - 1) + [UNIT - share * (outcomes - 1)]


class Market:
    """One market and its escrow. Commands are rows with action, account, amount, at and detail."""

    def __init__(self):
        self.state, self.supply, self.free = None, 0, {}
        self.stakes, self.boot, self.locked, self.outstanding, self.paid, self.dust = defaultdict(int), 0, 0, [], 0, 0
        self.halt, self.health, self.orders, self.collateral = None, "halted", 0, 0
        self.policy = self.round = self.resolution = None
        self.settled = False

    def _move(self, to):
        need((self.state, to) in LEGAL, "illegal_transition")
        self.state = to

    def _lock(self, account, amount):
        """Takes funds that another part of the escrow is about to hold."""
        need(amount >= 0, "negative")
        need(account in self.free, "unknown_account")
        need(self.free[account] >= amount, "insufficient_available")
        self.free[account] -= amount

    def reconciles(self):
        """Nothing is made or lost, and complete sets are backed in full until they are settled."""
        total = sum(self.free.values()) + sum(self.stakes.values()) + self.boot + self.locked + self.paid + self.dust
        return total == self.supply and (self.settled or all(x == self.locked for x in self.outstanding))

    def deposit(self, c):
        need(c["amount"] >= 0, "negative")
        self.free[c["account"]] = self.free.get(c["account"], 0) + c["amount"]
        self.supply += c["amount"]

    def create(self, c):
        """amount: the stake required; at: the time from which trading may close; detail: outcomes, bootstrap threshold, sponsors."""
        need(self.state is None, "duplicate_market")
        need(c["amount"] >= 0, "out_of_range")
        outcomes, threshold, sponsors = c["detail"]
        need(outcomes >= 2, "out_of_range")
        self.required, self.close_at, self.threshold, self.sponsors = c["amount"], c["at"], threshold, sponsors
        self.outstanding, self.state = [0] * outcomes, "draft"

    def stake(self, c):
        need(c["account"] < self.sponsors, "unknown_sponsor")
        self._lock(c["account"], c["amount"])
        self.stakes[c["account"]] += c["amount"]
        if self.state == "draft" and sum(self.stakes.values()) >= self.required:
            self._move("staked")

    def activate(self, c):
        self._move("bootstrapping")

    def bootstrap(self, c):
        need(self.state == "bootstrapping", "wrong_state")
        self._lock(c["account"], c["amount"])
        self.boot += c["amount"]
        if self.boot >= self.threshold:
            self._move("open")

    def stop(self, c):
        need(self.state in ("open", "bootstrapping"), "illegal_transition")
        self.halt = self.state
        self._move("halted")

    def resume(self, c):
        need(self.state == "halted", "illegal_transition")
        need(self.halt and sum(self.stakes.values()) >= self.required, "prerequisites")
        if self.halt == "open":
            need(self.boot >= self.threshold, "prerequisites")
            need(self.health in ("normal", "degraded"), "oracle_unhealthy")
        self._move(self.halt)
        self.halt = None

    def shut(self, c):
        need(c["at"] >= self.close_at, "out_of_range")
        self._move("closed")

    def begin(self, c):
        self._move("pending_resolution")

    def set_health(self, c):
        self.health = ("normal", "degraded", "stale", "halted")[c["amount"]]

    def set_orders(self, c):
        self.orders = c["amount"]

    def set_collateral(self, c):
        need(c["amount"] >= 0, "out_of_range")
        self.collateral = c["amount"]

    def mint(self, c):
        need(self.state == "open", "wrong_state")
        need(c["amount"] > 0, "units")
        self._lock(c["account"], c["amount"])
        self.locked += c["amount"]
        self.outstanding = [x + c["amount"] for x in self.outstanding]

    def redeem(self, c):
        need(self.state == "open", "wrong_state")
        need(c["amount"] > 0, "units")
        need(self.locked >= c["amount"], "insufficient_collateral")
        need(min(self.outstanding) >= c["amount"], "insufficient_claims")
        self.locked -= c["amount"]
        self.outstanding = [x - c["amount"] for x in self.outstanding]
        self.free[c["account"]] = self.free.get(c["account"], 0) + c["amount"]

    def commit(self, c):
        """amount: the challenge window; detail: the expiry."""
        need(self.policy is None, "policy_committed")
        need(self.state in OPEN_POLICY, "wrong_state")
        self.policy = (c["amount"], c["detail"][0])

    def propose(self, c):
        """amount: the deadline for challenges; detail: the payout by outcome."""
        need(self.state == "pending_resolution", "wrong_state")
        need(self.round is None, "proposal_exists")
        need(self.policy, "policy_missing")
        window, expiry = self.policy
        need(c["at"] < expiry, "policy_expired")
        self._payout(c["detail"])
        need(c["amount"] >= c["at"] + window, "window_too_short")
        self.round = {"deadline": c["amount"], "payout": list(c["detail"]), "challenges": [], "adjudicated": False}

    def _payout(self, payout):
        need(payout is not None and len(payout) == len(self.outstanding), "outcome_mismatch")
        need(min(payout) >= 0 and sum(payout) == UNIT, "not_conserving")

    def challenge(self, c):
        need(self.state in IN_ROUND, "wrong_state")
        need(self.round, "no_proposal")
        need(c["at"] < self.round["deadline"], "window_closed")
        need(len(self.round["challenges"]) < MOST_CHALLENGES, "queue_full")
        self.round["challenges"].append((c["account"], c["amount"]))
        if self.state == "pending_resolution":
            self._move("disputed")

    def adjudicate(self, c):
        """amount: the deadline of the round that is judged; detail: the payout."""
        need(self.state == "disputed", "wrong_state")
        need(self.policy, "policy_missing")
        need(self.round, "no_proposal")
        need(c["at"] >= self.round["deadline"], "window_open")
        need(c["amount"] == self.round["deadline"], "round_mismatch")
        self._payout(c["detail"])
        self.round.update(payout=list(c["detail"]), adjudicated=True, challenges=[])

    def finalize(self, c):
        need(self.round, "no_proposal")
        need(c["at"] >= self.round["deadline"], "window_open")
        need(self.state in IN_ROUND, "wrong_state")
        need(self.state != "disputed" or self.round["adjudicated"], "unresolved_challenge")
        self._move("resolved")
        self.resolution = self.round["payout"]

    def invalidate(self, c):
        need(self.state in IN_ROUND, "wrong_state")
        self._move("invalid")
        self.resolution = refund(len(self.outstanding))

    def settle(self, c):
        if self.settled:
            return
        need(self.state in ("resolved", "invalid"), "wrong_state")
        credit = sum(claims * pay // UNIT for claims, pay in zip(self.outstanding, self.resolution))
        self.paid, self.dust, self.locked = credit, self.locked - credit, 0
        self.settled = True
        self._move("settled")

    def archive(self, c):
        waits = self.round and self.round["challenges"] and not self.round["adjudicated"]
        held = self.state == "halted" and (sum(self.stakes.values()) or self.boot)
        need(not (self.orders or self.collateral or any(self.outstanding) or waits or held), "liabilities")
        self._move("archived")
        self.halt = None

    ACTIONS = {"deposit": deposit, "create": create, "stake": stake, "activate": activate, "bootstrap": bootstrap, "halt": stop, "resume": resume, "close": shut, "begin_resolution": begin,
               "oracle_health": set_health, "open_orders": set_orders, "user_collateral": set_collateral, "mint": mint, "redeem": redeem, "commit_policy": commit, "propose": propose,
               "challenge": challenge, "adjudicate": adjudicate, "finalize": finalize, "invalidate": invalidate, "settle": settle, "archive": archive}

    def command(self, c) -> str:
        action = self.ACTIONS.get(c["action"])
        if action is None:
            return "unknown_action"
        if self.state is None and c["action"] not in ("create", "deposit"):
            return "unknown_market"
        try:
            action(self, c)
        except Refused as why:
            return str(why)
        return "ok"


class MarketFold(Market):
    """Market for rows of a fold: a row out for each command."""

    def apply(self, row):
        verdict = self.command(row)
        yield row["market_id"], row["seq"], row["action"], verdict, self.state, self.locked, sum(self.stakes.values()), sum(self.free.values()), self.paid, self.reconciles()

    def close(self):
        return ()


REPORT = "market_id long, seq long, action string, verdict string, state string, locked_raw long, staked_raw long, available_raw long, paid_raw long, reconciles boolean"


def market_commands(commands):
    """REPORT for each of the commands (market_id, seq, action, account, amount, at, detail array<long>)."""
    return folded(commands, "market_id", ["seq"], MarketFold, REPORT)


class Conditional:
    """A conditional order after its trigger: what its owner's answers do to it. A TWAP has more than one slice."""

    def __init__(self):
        self.status, self.owner, self.slices, self.emitted = None, None, 0, 0

    def command(self, action, owner, slices=1) -> str:
        if action == "add":
            if self.status is not None:
                return "duplicate"
            self.status, self.owner, self.slices, self.emitted = "pending", owner, slices, 0
            return "ok"
        if self.status is None:
            return "unknown_id"
        if action == "fire":
            if self.status != "pending":
                return "not_pending"
            self.status = "executing"
            return "ok"
        if owner != self.owner:
            return "owner_mismatch"
        if action == "retry":
            if self.status != "retryable":
                return "invalid_status"
            self.status = "executing"
            return "ok"
        if self.status not in ("executing", "retryable"):
            return "invalid_status"
        if action == "retryable":
            self.status = "retryable"
        elif action == "executed" and self.emitted + 1 < self.slices:
            self.emitted, self.status = self.emitted + 1, "pending"
        else:
            # Executed for the last time, or rejected: the entry is gone.
            self.status = None
        return "ok"

    def apply(self, row):
        verdict = self.command(row["action"], row["owner"], row["slices"])
        yield row["conditional_id"], row["seq"], row["action"], verdict, self.status, self.emitted

    def close(self):
        return ()


def acknowledgements(commands):
    return folded(commands, "conditional_id", ["seq"], Conditional, "conditional_id long, seq long, action string, verdict string, status string, emitted long")


# A market's commands: it is set up, trades, is halted and resumed at times, then closes and is resolved, with a challenge or without.
_COMMANDS = f"""with {TICKS}, numbered as (select market_id, user_id, price_raw, row_number() over (partition by market_id order by event_id) as seq, count(*) over (partition by market_id) as n from ticks),
placed as (select *, seq - (n - n @/ 4) as late from numbered)
select cast(market_id as bigint) as market_id, cast(seq as bigint) as seq, cast(case when seq in (2, 3, 5) then 0 when seq % 5 = 0 then 3 else user_id % 4 end as bigint) as account, cast(seq as bigint) as at,
  case when seq = 1 then 'create' when seq = 2 then 'deposit' when seq = 3 then 'stake' when seq = 4 then 'activate' when seq = 5 then 'bootstrap' when seq = 6 then 'oracle_health' when seq = 7 then 'commit_policy'
    when late = 1 then 'close' when late = 2 then 'begin_resolution' when late = 3 then 'propose' when late = 4 and market_id % 3 = 0 then 'challenge' when late = 14 then 'finalize' when late = 15 then 'adjudicate'
    when late = 16 then 'finalize' when late = 17 and market_id % 5 = 0 then 'invalidate' when late = 18 then 'settle' when late = 19 then 'archive' when seq % 23 = 0 then 'halt' when seq % 23 = 1 then 'resume'
    when seq % 4 = 0 then 'redeem' when seq % 4 = 1 then 'deposit' when seq % 41 = 2 then 'finalize' else 'mint' end as action,
  cast(case when seq = 1 then 500 when seq = 2 then 100000 when seq = 3 then 600 when seq = 5 then 2000 when seq = 6 then 0 when seq = 7 then 10 when late in (3, 15) then n - n @/ 4 + 13 else price_raw @/ 10000 % 500 end as bigint) as amount,
  case when seq = 1 then array(2 + market_id % 3, 1000, 3) when seq = 7 then array(1000000000000) when late = 3 and market_id % 3 = 0 then array(1000000, 0)
    when late in (3, 15) and market_id % 3 = 1 then array(300000, 300000, 400000) when late in (3, 15) and market_id % 3 = 2 then array(250000, 250000, 250000, 250000) when late = 15 then array(400000, 600000) end as detail from placed"""
_ACKS = f"""with {TICKS}, numbered as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as seq from ticks)
select cast(user_id as bigint) as conditional_id, cast(seq as bigint) as seq, case when seq % 17 = 1 then 'add' else (case event_id % 6 when 0 then 'fire' when 1 then 'fire' when 2 then 'executed' when 3 then 'retryable' when 4 then 'retry' else 'rejected' end) end as action,
  cast(case when seq % 7 = 0 then user_id + 1 else user_id end as bigint) as owner, cast(1 + user_id % 4 as bigint) as slices from numbered"""

QUERIES = {"market_commands": lambda spark, sf_dir: market_commands(sql.run(spark, sf_dir, _COMMANDS).selectExpr("* except (detail)", "cast(detail as array<bigint>) as detail")),
           "conditional_acks": lambda spark, sf_dir: acknowledgements(sql.run(spark, sf_dir, _ACKS))}
# The oracle goes from answer to answer by recursion; a status that is null is an order that is gone.
_NEXT = """case when action = 'add' then case when status is null then 'ok' else 'duplicate' end when status is null then 'unknown_id'
  when action = 'fire' then case when status = 'pending' then 'ok' else 'not_pending' end when owner <> holder then 'owner_mismatch'
  when action = 'retry' then case when status = 'retryable' then 'ok' else 'invalid_status' end when status in ('executing', 'retryable') then 'ok' else 'invalid_status' end"""
SQL = {"conditional_acks": sql.render("with recursive c as (" + _ACKS + ")", "oracle") + f""", walk as (select conditional_id, 0::bigint as seq, null::varchar as action, null::varchar as verdict, null::varchar as status, null::bigint as holder, 0::bigint as held, 0::bigint as emitted from c where seq = 1
  union all select conditional_id, seq, action, verdict, case when verdict <> 'ok' then status when action = 'add' then 'pending' when action in ('fire', 'retry') then 'executing' when action = 'retryable' then 'retryable'
      when action = 'executed' and emitted + 1 < held then 'pending' end, case when verdict = 'ok' and action = 'add' then owner else holder end, case when verdict = 'ok' and action = 'add' then slices else held end,
    case when verdict = 'ok' and action = 'add' then 0 when verdict = 'ok' and action = 'executed' and emitted + 1 < held then emitted + 1 else emitted end
    from (select c.conditional_id, c.seq, c.action, c.owner, c.slices, w.status, w.holder, w.held, w.emitted, {_NEXT} as verdict from (select conditional_id as id, seq as was, status, holder, held, emitted from walk) w join c on c.conditional_id = w.id and c.seq = w.was + 1) s)
select conditional_id, seq, action, verdict, status, emitted from walk where seq > 0"""}
