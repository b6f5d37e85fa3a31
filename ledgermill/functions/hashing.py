"""Commitments as column expressions: length-prefixed hashes under a domain, Merkle trees, chains and multiset hashes.

Domains are parameters: two systems agree on a root only if they agree on the names. All hashes are lowercase hex.
"""
import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

LEAF, NODE, CHAIN = "ledgermill:leaf:v1", "ledgermill:node:v1", "ledgermill:wal:v1"
ZERO = "00" * 32
# Leaves of a block of a tree, as a power of two.
BITS = 16
_NODE_HEAD = len(NODE.encode()).to_bytes(8, "little") + NODE.encode() + (64).to_bytes(8, "little")


def little(x: Column, size: int = 8) -> Column:
    """Hex of the lowest bytes of an integer, little end first."""
    x = x.cast("long")
    bytes_ = [F.shiftleft(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)), 56 - 8 * i) for i in range(8)]
    turned = F.lpad(F.hex(functools.reduce(Column.bitwiseOR, bytes_)), 16, "0")
    return F.lower(F.substring(turned, 1, 2 * size))


def domain_hash(domain: str, data: Column) -> Column:
    """SHA-256 of the lengths and bytes of domain and data (hex)."""
    tag = domain.encode().hex()
    head = len(domain.encode()).to_bytes(8, "little").hex() + tag
    return F.sha2(F.unhex(F.concat(F.lit(head), little(F.length(data) / 2), data)), 256)


def node_hash(left: Column, right: Column) -> Column:
    """Of two hashes, so that the lengths are known."""
    return F.sha2(F.unhex(F.concat(F.lit(_NODE_HEAD.hex()), left, right)), 256)


def empty_roots(height: int) -> list:
    """Roots of empty trees by height, as literals made once."""
    out = [ZERO]
    for _ in range(height):
        out.append(hashlib.sha256(_NODE_HEAD + bytes.fromhex(out[-1] * 2)).hexdigest())
    return out


def _zeros(height):
    return [bytes.fromhex(z) for z in empty_roots(height)]


def _levels(hashes, low=0):
    """Levels of one tree over its hashes, up to its root; they stand on height `low`. None is no hash: on the right it
    counts as the empty root of its height, on the left the node above has none either."""
    zeros, out = _zeros(low + len(hashes).bit_length()), [hashes]
    while len(out[-1]) > 1:
        now, zero = out[-1], zeros[low + len(out) - 1]
        right = now[1::2] + [None] * (len(now) % 2)
        out.append([a and hashlib.sha256(_NODE_HEAD + a + (b or zero)).digest() for a, b in zip(now[::2], right)])
    return out


def _siblings(levels, at, zeros, low=0):
    """What stands beside a place on each level but the root's, as hex from the bottom up."""
    out = []
    for k, level in enumerate(levels[:-1], low):
        beside = at ^ 1
        found = level[beside] if beside < len(level) else None
        out.append((found or zeros[k]).hex())
        at >>= 1
    return out


def _placed(places, hashes):
    out = [None] * (max(places) + 1)
    for i, x in zip(places, hashes):
        out[i] = x
    return out


def _blocks(leaves: DataFrame, bits: int) -> DataFrame:
    """The root of each block of 2^bits leaves, at the lowest height that holds its leaves, and its last place."""
    def fold(key, table):
        tree, block = (x.as_py() for x in key)
        hashes = _placed([i & (1 << bits) - 1 for i in table["idx"].to_pylist()], table["hash"].to_pylist())
        return pa.table({"tree": pa.array([tree], key[0].type), "block": [block], "last": pa.array([len(hashes) - 1], pa.int64()), "hash": pa.array([_levels(hashes)[-1][0]], pa.binary())})

    return leaves.groupBy("tree", "block").applyInArrow(fold, f"tree {leaves.schema['tree'].dataType.simpleString()}, block long, last long, hash binary")


def _tops(blocks: DataFrame, bits: int) -> DataFrame:
    """tree, block, root of the tree and the siblings that a proof from this block has above the block's own levels."""
    def fold(key, table):
        places, last, found = (table[c].to_pylist() for c in ("block", "last", "hash"))
        zeros, alone = _zeros(bits), max(places) == 0
        heights = {p: n.bit_length() for p, n in zip(places, last)}
        if not alone:  # every block is lifted to the common height
            found = [functools.reduce(lambda x, k: x and hashlib.sha256(_NODE_HEAD + x + zeros[k]).digest(), range(heights[p], bits), x) for p, x in zip(places, found)]
        levels = _levels(_placed(places, found), bits)
        zeros = _zeros(bits + len(levels))
        above = [[] if alone else [z.hex() for z in zeros[heights[p]:bits]] + _siblings(levels, p, zeros, bits) for p in places]
        root = levels[-1][0]
        return pa.table({"tree": table["tree"], "block": table["block"], "root": pa.array([root and root.hex()] * len(places), pa.string()), "above": pa.array(above, pa.list_(pa.string()))})

    return blocks.groupBy("tree").applyInArrow(fold, f"tree {blocks.schema['tree'].dataType.simpleString()}, block long, root string, above array<string>")


def _dealt(leaves: DataFrame, bits: int, *more) -> DataFrame:
    return leaves.filter("tree is not null").select("tree", F.shiftright("idx", bits).alias("block"), "idx", F.unhex("hash").alias("hash"), *more)


def merkle_tops(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """What proofs and roots share: tree, block, root, above. Given to both, a plan finds it once."""
    return _tops(_blocks(_dealt(leaves, bits), bits), bits)


def merkle_roots(leaves: DataFrame, bits: int = BITS, tops: DataFrame = None) -> DataFrame:
    """tree, root of the leaves (tree, idx, hash).

    A block of 2^bits leaves is folded at once, then the roots of a tree's blocks: a task holds one block, or one hash for
    each block of a tree.
    """
    return (tops or merkle_tops(leaves, bits)).filter("block = 0").select("tree", "root")


def merkle_proofs(leaves: DataFrame, wanted, bits: int = BITS, tops: DataFrame = None) -> DataFrame:
    """tree, idx, hash, siblings (from the leaf up) and root for the wanted: rows (tree, idx), or a condition on the leaves,
    which spares a join (`tops`: merkle_tops of the leaves, if at hand). Siblings above a block are one small row for each block, sent to all."""
    tops = tops or merkle_tops(leaves, bits)
    if isinstance(wanted, DataFrame):
        leaves = leaves.join(wanted.select("tree", "idx").distinct().withColumn("asked", F.lit(True)), ["tree", "idx"], "left")
        wanted = F.col("asked").isNotNull()

    def prove(key, table):
        places = [i & (1 << bits) - 1 for i in table["idx"].to_pylist()]
        levels, zeros = _levels(_placed(places, table["hash"].to_pylist())), _zeros(bits)
        asked = table.filter(table["asked"])
        below = [_siblings(levels, i & (1 << bits) - 1, zeros) for i in asked["idx"].to_pylist()]
        hashes = [x and x.hex() for x in asked["hash"].to_pylist()]
        return pa.table({"tree": asked["tree"], "block": asked["block"], "idx": asked["idx"], "hash": pa.array(hashes, pa.string()), "below": pa.array(below, pa.list_(pa.string()))})

    kind = leaves.schema["tree"].dataType.simpleString()
    below = _dealt(leaves, bits, F.coalesce(wanted, F.lit(False)).alias("asked")).groupBy("tree", "block").applyInArrow(prove, f"tree {kind}, block long, idx long, hash string, below array<string>")
    return below.join(F.broadcast(tops), ["tree", "block"]).select("tree", "idx", "hash", F.concat("below", "above").alias("siblings"), "root")


def proof_root(leaf: str, idx: str, siblings: str) -> Column:
    """Root that a proof leads to; the lowest bit of the place chooses the side at each step."""
    step = lambda acc, s: F.struct(
        F.shiftright(acc["at"], 1).alias("at"),
        F.when(acc["at"].bitwiseAND(F.lit(1)) == 1, node_hash(s, acc["hash"])).otherwise(node_hash(acc["hash"], s)).alias("hash"))
    return F.aggregate(F.col(siblings), F.struct(F.col(idx).cast("long").alias("at"), F.col(leaf).alias("hash")), step, lambda acc: acc["hash"])


def xor_root(df: DataFrame, keys, hashed: str) -> DataFrame:
    """Hash of a multiset, whatever its order: the four quarters of the hashes, each XORed."""
    quarters = [F.bit_xor(F.conv(F.substring(hashed, 1 + 16 * i, 16), 16, -10).cast("long")).alias(f"q{i}") for i in range(4)]
    return df.groupBy(*keys).agg(*quarters).select(*keys, F.lower(F.concat(*[F.lpad(F.hex(f"q{i}"), 16, "0") for i in range(4)])).alias("root"))


def chain_tips(df: DataFrame, key: str, order: str, frame: str) -> DataFrame:
    """Tip of the hash chain over a key's frames in order, as an ordered aggregate; a key's chain is one task by its meaning."""
    frames = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(frame).alias("f")))).alias("frames"))
    genesis = F.sha2(F.lit(CHAIN), 256)
    return frames.select(key, F.aggregate("frames", genesis, lambda acc, x: domain_hash(CHAIN, F.concat(acc, x["f"]))).alias("tip"), F.size("frames").alias("n"))


def keccak256(data: bytes) -> str:
    """Keccak-256 with the padding of before the standard; lanes are 25 64-bit words."""
    mask, rate = (1 << 64) - 1, 136
    turn = lambda x, n: (x << n | x >> 64 - n) & mask if n else x
    block = bytearray(data + b"\x01")
    block += b"\0" * (-len(block) % rate)
    block[-1] |= 0x80
    lane = [[0] * 5 for _ in range(5)]
    for at in range(0, len(block), rate):
        for i in range(rate // 8):
            lane[i % 5][i // 5] ^= int.from_bytes(block[at + 8 * i:at + 8 * i + 8], "little")
        feed = 1
        for _ in range(24):
            column = [lane[x][0] ^ lane[x][1] ^ lane[x][2] ^ lane[x][3] ^ lane[x][4] for x in range(5)]
            shift = [column[x - 1] ^ turn(column[(x + 1) % 5], 1) for x in range(5)]
            lane = [[lane[x][y] ^ shift[x] for y in range(5)] for x in range(5)]
            x, y, now = 1, 0, lane[1][0]
            for t in range(24):
                x, y = y, (2 * x + 3 * y) % 5
                now, lane[x][y] = lane[x][y], turn(now, (t + 1) * (t + 2) // 2 % 64)
            for y in range(5):
                row = [lane[x][y] for x in range(5)]
                for x in range(5):
                    lane[x][y] = row[x] ^ (~row[(x + 1) % 5] & mask & row[(x + 2) % 5])
            # Round constants come from a shift register, one bit at each power-of-two place.
            for j in range(7):
                feed = (feed << 1 ^ (feed >> 7) * 0x71) % 256
                if feed & 2:
                    lane[0][0] ^= 1 << (1 << j) - 1
    return b"".join(lane[i % 5][i // 5].to_bytes(8, "little") for i in range(4)).hex()


@pandas_udf(StringType())
def keccak(data):
    return data.map(lambda d: None if d is None else keccak256(bytes(d)))


def fnv1a(data: Column) -> Column:
    """64-bit FNV-1a of the bytes of a hex string, as an unsigned decimal: an ordered fold, each product taken modulo 2^64."""
    wide = lambda x: x.cast("decimal(38,0)")
    two32 = F.lit(1 << 32)
    def step(acc, b):
        byte = F.conv(b, 16, 10).cast("long")
        low = acc["lo"].bitwiseXOR(byte)
        # 0x100000001b3 = 2^40 + 435, on two halves of 32 bits each.
        lo = low * 435
        hi = acc["hi"] * 435 + F.shiftright(lo, 32) + F.shiftleft(low.bitwiseAND(F.lit((1 << 24) - 1)), 8)
        return F.struct(hi.bitwiseAND(F.lit((1 << 32) - 1)).alias("hi"), lo.bitwiseAND(F.lit((1 << 32) - 1)).alias("lo"))
    start = F.struct(F.lit(0xcbf29ce4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(F.regexp_extract_all(data, F.lit("(..)"), 1), start, step, lambda a: wide(a["hi"]) * wide(two32) + wide(a["lo"]))


def numbered(df: DataFrame, tree: str, *order) -> DataFrame:
    """tree, idx and the other columns: rows in canonical order."""
    return df.withColumn("idx", (F.row_number().over(Window.partitionBy(tree).orderBy(*order)) - 1).cast("long")).withColumnRenamed(tree, "tree")
