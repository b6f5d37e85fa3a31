"""Roots, proofs, chains and digests over the star schema."""
from pyspark.sql import functions as F

from ledgermill.functions import hashing as h
from ledgermill.operators.derivatives import FILLS, TICKS
from ledgermill.plans import sql

EVIDENCE = "ledgermill:evidence:v1"


def fills(spark, sf_dir):
    return sql.run(spark, sf_dir, f"with {FILLS} select * from fills")


def ticks(spark, sf_dir):
    return sql.run(spark, sf_dir, f"with {TICKS} select * from ticks")


def leaves(spark, sf_dir):
    """Leaf hashes of each market's fills in canonical order."""
    data = F.concat(h.little(F.col("taker"), 4), h.little(F.col("price_raw")), h.little(F.col("lots")), h.little(F.col("order_id")))
    rows = h.numbered(fills(spark, sf_dir), "market_id", "order_id", "line_no", "price_raw", "lots", "maker", "at_us")
    return rows.select("tree", "idx", h.domain_hash(h.LEAF, data).alias("hash"))


def evidence(spark, sf_dir):
    return ticks(spark, sf_dir).select("event_id", h.domain_hash(EVIDENCE, F.concat(h.little(F.col("event_id")), h.little(F.col("price_raw")))).alias("digest"))


def leaf_bytes(spark, sf_dir):
    return ticks(spark, sf_dir).select("event_id", F.concat(h.little(F.col("user_id"), 4), h.little(-F.col("price_raw")), h.little(F.length("event_type")), F.lower(F.hex(F.col("event_type").cast("binary")))).alias("leaf"))


def shard_roots(spark, sf_dir):
    """A shard's root over its markets' roots, sorted by market."""
    roots = h.merkle_roots(leaves(spark, sf_dir)).select((F.col("tree") % 4).alias("shard"), "tree", F.col("root").alias("hash")).withColumnRenamed("tree", "market_id")
    return h.merkle_roots(h.numbered(roots, "shard", "market_id").select("tree", "idx", "hash")).select(F.col("tree").alias("shard"), "root")


def proofs(spark, sf_dir):
    """Proofs of every tenth leaf, checked against the root."""
    proved = h.merkle_proofs(leaves(spark, sf_dir), F.col("idx") % 10 == 0).withColumn("folded", h.proof_root("hash", "idx", "siblings"))
    return proved.select(F.col("tree").alias("market_id"), "idx", F.size("siblings").alias("n_siblings"), (F.col("folded") == F.col("root")).alias("verified"))


def verified_reads(spark, sf_dir):
    """Reads against the tip's root and, where it is older, against the root without the last fills."""
    every = leaves(spark, sf_dir)
    older = every.filter("idx < 8")
    asked = F.col("idx") % 16 == 0
    tops, tops_then = h.merkle_tops(every), h.merkle_tops(older)
    roots = h.merkle_roots(every, tops=tops).select("tree", F.col("root").alias("tip")).join(h.merkle_roots(older, tops=tops_then).select("tree", F.col("root").alias("old")), "tree")
    both = h.merkle_proofs(every, asked, tops=tops).unionByName(h.merkle_proofs(older, asked, tops=tops_then))
    judged = both.withColumn("folded", h.proof_root("hash", "idx", "siblings")).join(F.broadcast(roots), "tree")
    return judged.select(F.col("tree").alias("market_id"), "idx", F.size("siblings").alias("n_siblings"),
                         F.when(F.col("folded") == F.col("tip"), "verified").when(F.col("folded") == F.col("old"), "stale").otherwise("unverified").alias("status"))


def book_root(spark, sf_dir):
    return h.xor_root(leaves(spark, sf_dir).withColumnRenamed("tree", "market_id"), ["market_id"], "hash")


def chain(spark, sf_dir):
    frames = ticks(spark, sf_dir).select("market_id", "event_id", F.concat(h.little(F.col("event_id")), h.little(F.col("at_us"))).alias("frame"))
    return h.chain_tips(frames, "market_id", "event_id", "frame")


def integrity(spark, sf_dir):
    """Check sum, order and gap of each record of a market's log."""
    from pyspark.sql import Window
    frame = F.concat_ws(":", "event_id", "event_type", "price_raw")
    before = F.lag("event_id").over(Window.partitionBy("market_id").orderBy("event_id"))
    return ticks(spark, sf_dir).select("market_id", "event_id", F.crc32(frame.cast("binary")).alias("crc"), (F.col("event_id") > F.coalesce(before, F.lit(-1))).alias("increasing"))


def content_hash(spark, sf_dir):
    return ticks(spark, sf_dir).select("event_id", h.fnv1a(F.concat(h.little(F.col("user_id")), h.little(F.col("price_raw")))).cast("string").alias("fnv"), h.keccak(F.unhex(h.little(F.col("event_id")))).alias("keccak"))


def execution_commitment(spark, sf_dir):
    rows = ticks(spark, sf_dir).groupBy(F.expr("event_id div 50").alias("height")).agg(F.min("event_id").alias("first"), F.sum("price_raw").alias("total"))
    data = F.concat(h.little(F.lit(1)), h.little(F.col("height")), h.little(F.col("first")), h.little(F.col("total")))
    return rows.select("height", h.domain_hash("ledgermill:execution:v1", data).alias("digest"))


QUERIES = {"evidence_hash": evidence, "leaf_encoding": leaf_bytes, "market_roots": lambda s, d: h.merkle_roots(leaves(s, d)).select(F.col("tree").alias("market_id"), "root"), "shard_roots": shard_roots,
           "merkle_proofs": proofs, "verified_reads": verified_reads, "book_root": book_root, "wal_chain": chain, "log_integrity": integrity, "content_hash": content_hash, "execution_commitment": execution_commitment}

_LE = "lower(array_to_string(list_reverse(regexp_extract_all(lpad(hex({}), 16, '0'), '..')), ''))"
_DOMAIN = lambda domain, data, size: f"sha256(unhex('{len(domain).to_bytes(8, 'little').hex()}{domain.encode().hex()}{size.to_bytes(8, 'little').hex()}' || {data}))"
_T = sql.render(f"with {TICKS}", "oracle")
# Leaf of a fill, then levels of pairs upward until one node is left; an odd end is paired with the empty root of its level.
_NODE = f"sha256(unhex('{len(h.NODE).to_bytes(8, 'little').hex()}{h.NODE.encode().hex()}{(64).to_bytes(8, 'little').hex()}' || a || coalesce(b, z)))"
_ZEROS = "zeros(k, z) as (values " + ", ".join(f"({k}, '{z}')" for k, z in enumerate(h.empty_roots(24))) + ")"
_ROOTS = sql.render(f"with recursive {FILLS}", "oracle") + f""", {_ZEROS}, leaves as (select market_id, row_number() over (partition by market_id order by order_id, line_no, price_raw, lots, maker, at_us) - 1 as idx,
  {_DOMAIN(h.LEAF, "left(" + _LE.format("taker") + ", 8) || " + _LE.format("price_raw") + " || " + _LE.format("lots") + " || " + _LE.format("order_id"), 28)} as hash from fills),
tree as (select market_id, 0 as k, idx, hash, count(*) over (partition by market_id) as n from leaves
  union all select market_id, k + 1, idx, {_NODE}, (n + 1) // 2 from (select t.market_id, t.k, t.idx // 2 as idx, max(case when t.idx % 2 = 0 then hash end) as a, max(case when t.idx % 2 = 1 then hash end) as b, max(n) as n, max(z) as z
    from tree t join zeros on zeros.k = t.k where t.n > 1 group by t.market_id, t.k, t.idx // 2) p)
select market_id, hash as root from tree where n = 1"""
SQL = {
    "evidence_hash": f"{_T} select event_id, {_DOMAIN(EVIDENCE, _LE.format('event_id') + ' || ' + _LE.format('price_raw'), 16)} as digest from ticks",
    "execution_commitment": f"{_T}, g as (select event_id // 50 as height, min(event_id) as first, cast(sum(price_raw) as bigint) as total from ticks group by 1) select height, {_DOMAIN('ledgermill:execution:v1', ' || '.join(_LE.format(x) for x in ('cast(1 as bigint)', 'height', 'first', 'total')), 32)} as digest from g",
    "leaf_encoding": f"{_T} select event_id, left({_LE.format('user_id')}, 8) || {_LE.format('-price_raw')} || {_LE.format('cast(length(event_type) as bigint)')} || lower(hex(event_type)) as leaf from ticks",
    "market_roots": _ROOTS,
}


def query(name):
    return QUERIES[name]
