"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint maps to the bit counts of its 32 two-bit segments, written in unary: a segment's
two bits, sorted. The Manhattan distance of two count vectors is then the number of differing
bits of their embeddings, and never exceeds the Hamming distance, so links (at most RADIUS
differing bits) lie within Manhattan distance RADIUS.

The grid range-join: segments are dealt into GROUPS groups; of these at most RADIUS can differ
between linked vectors, so some GROUPS - RADIUS groups agree in full. Each choice of that many
groups names a grid column by its counts. Within a column rows are sorted by their total count,
and only rows whose totals lie within RADIUS meet; of these the Manhattan distance of the whole
vectors drops what it can, and the exact distance decides. Large columns are dealt as pairs of
blocks. Only a spanning forest leaves a task. Equal fingerprints fold into one node first, so
copies never meet in pairs.

Null and empty texts have fingerprint zero and link like any other; repeated rows share a node, a
very long text is read whole. Components are named by their smallest doc_id (null if none of their
rows has one). Columns other than doc_id and text are not read; an empty table gives no rows.
"""
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_hot

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RADIUS, SHINGLE, GROUPS, CHUNK = 4, 4, 6, 1024
# Rows of one grid column that one task compares at a time; larger ones are dealt as pairs of blocks.
SALT_ROWS = 4096
# Rows of the grid that a task gets; columns of up to NARROW rows are compared together.
TASK_ROWS, NARROW = 200_000, 256
EVEN = 0x5555555555555555


def fingerprint(text) -> int:
    found = WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not found:
        return 0
    n = max(1, len(found) - SHINGLE + 1)
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(b" ".join(found[i:i + SHINGLE]), 42) for i in range(n)), dtype=np.uint64, count=n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = np.ascontiguousarray(hashes[at:at + 8192].astype(">u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint."""
    def run(batches):
        for pdf in batches:
            fps = np.array([fingerprint(t) for t in pdf.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pdf.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _segments(group: int) -> int:
    """Mask of the low bits of a group's segments."""
    return sum(1 << (2 * s) for s in range(32) if s % GROUPS == group)


def _cells(nodes: DataFrame) -> DataFrame:
    """choice, cell, fp: the grid columns of each node."""
    lows = F.col("fp").bitwiseAND(F.lit(EVEN))
    highs = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(EVEN))
    counts = lows.bitwiseOR(highs).bitwiseOR(F.shiftleft(lows.bitwiseAND(highs), 1))
    keys = []
    for i, chosen in enumerate(combinations(range(GROUPS), GROUPS - RADIUS)):
        bits = sum(3 * _segments(g) for g in chosen)
        bits = bits - (1 << 64) if bits >= 1 << 63 else bits
        keys.append(F.struct(F.lit(i).alias("choice"), F.col("counts").bitwiseAND(F.lit(bits)).alias("cell")))
    return (nodes.withColumn("counts", counts)
            .select("fp", F.explode(F.array(*keys)).alias("k")).select("k.choice", "k.cell", "fp"))


def embedded(fps):
    """Unary bit counts of two-bit segments; Manhattan distance is the number of differing bits."""
    even = np.uint64(EVEN)
    lows, highs = fps & even, (fps >> np.uint64(1)) & even
    return (lows | highs) | ((lows & highs) << np.uint64(1))


def _linked(a, b):
    """Whether pairs of fingerprints are linked: by the lower bound first, exactly where it passes."""
    near = np.bitwise_count(embedded(a) ^ embedded(b)) <= RADIUS
    at = np.nonzero(near)
    near[at] = np.bitwise_count((a ^ b)[at]) <= RADIUS
    return near


class Forest:
    """Keeps of a stream of links only those that join two trees."""

    def __init__(self):
        self.parent = {}

    def root(self, x):
        while self.parent.get(x, x) != x:
            self.parent[x] = self.parent.get(self.parent[x], self.parent[x])
            x = self.parent[x]
        return x

    def add(self, x, y):
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _narrow(cells, totals, fps):
    """Links within runs of equal cells, rows sorted by cell and total: row i meets i + gap while both hold."""
    out, at, gap = [], np.arange(len(fps)), 1
    while True:
        at = at[at + gap < len(fps)]
        at = at[(cells[at] == cells[at + gap]) & (totals[at + gap] - totals[at] <= RADIUS)]
        if not len(at):
            return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
        a, b = fps[at], fps[at + gap]
        hit = _linked(a, b)
        out.append(np.stack([a[hit], b[hit]], 1))
        gap += 1


def _wide(left, right, same):
    """Edges of a spanning forest of the links between two blocks of one column."""
    order = lambda x: x[np.argsort(np.bitwise_count(x), kind="stable")]
    left, right, forest = order(left), order(right), Forest()
    left_total, right_total = (np.bitwise_count(x).astype(np.int64) for x in (left, right))
    for at in range(0, len(left), CHUNK):
        a = left[at:at + CHUNK]
        low = at if same else int(np.searchsorted(right_total, left_total[at] - RADIUS, "left"))
        high = int(np.searchsorted(right_total, left_total[at + len(a) - 1] + RADIUS, "right"))
        for bt in range(low, high, CHUNK):
            b = right[bt:min(bt + CHUNK, high)]
            near = _linked(np.broadcast_to(a[:, None], (len(a), len(b))), np.broadcast_to(b[None, :], (len(a), len(b))))
            if same and bt == at:
                near = np.triu(near, 1)
            # Rows already in the tree of the row's first partner need no second look.
            for i in np.flatnonzero(near.any(1)):
                x, partners = int(a[i]), b[near[i]]
                for y in partners.tolist():
                    if forest.parent.get(y) != forest.parent.get(x, x) and forest.add(x, y):
                        yield x, y


def links(nodes: DataFrame) -> DataFrame:
    """src, dst: links that keep every connection between different fingerprints."""
    cells = _cells(nodes)
    sizes = cells.groupBy("choice", "cell").count().filter("count > 1")
    # Large columns: each row joins the block pairs it takes part in; small ones have one pair, 0-0.
    blocks = F.ceil(F.col("count") / SALT_ROWS).cast("int")
    dealt = (cells.join(sizes, ["choice", "cell"])
             .withColumn("blocks", blocks)
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("choice", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp"))
    keys = ["choice", "cell", "lo", "hi"]

    def flush(pdf):
        """Links of whole columns (or pairs of blocks) in order."""
        k = pdf[keys].to_numpy()
        fps, own = pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
        run = np.r_[0, np.cumsum((k[1:] != k[:-1]).any(1))] if len(k) else np.zeros(0, np.int64)
        sizes = np.bincount(run)
        small = sizes[run] <= NARROW
        small &= k[:, 2] == k[:, 3]
        totals = np.bitwise_count(fps).astype(np.int64)
        order = np.lexsort((totals[small], run[small]))
        found = _narrow(run[small][order], totals[small][order], fps[small][order])
        forest, at = Forest(), None
        kept = [(x, y) for x, y in found.tolist() if forest.add(x, y)]
        for at in np.unique(run[~small]):
            mine = run == at
            lo, hi = k[mine][0, 2:4]
            part, side = fps[mine], own[mine]
            kept += _wide(part, part, True) if lo == hi else _wide(part[side == lo], part[side == hi], False)
        return pd.DataFrame(np.array(kept, dtype=np.uint64).view(np.int64).reshape(-1, 2), columns=["src", "dst"])

    def run(batches):
        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pd.concat([*held, pdf], ignore_index=True)
            k = pdf[keys].to_numpy()
            # The last column of a batch may go on in the next one; a block pair has at most 2 * SALT_ROWS rows or so.
            last = int(np.flatnonzero((k != k[-1]).any(1)).max(initial=-1)) + 1
            if last:
                yield flush(pdf.iloc[:last])
            held = [pdf.iloc[last:]]
        if held:
            yield flush(held[0])

    # A count of tasks by rows, as a task's work follows its rows and not their few bytes.
    parts = max(8, -(-nodes.count() * len(list(combinations(range(GROUPS), RADIUS))) // TASK_ROWS))
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(run, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, root: nodes that have links, with the least fp of all they reach.

    Smallest-label rounds with a jump through the label's own label; linear in links a round. Hubs and
    the label of a giant component are joined by broadcast of the few heavy keys.
    """
    both = checkpointed(edges.union(edges.select("dst", "src")).distinct())
    total = both.count()
    label = checkpointed(both.groupBy(F.col("src").alias("fp")).agg(F.count("*").alias("n")).withColumn("root", F.col("fp")))
    while True:
        heard = (join_hot(both, label.select(F.col("fp").alias("dst"), "root", "n"), "dst", total)
                 .groupBy(F.col("src").alias("fp")).agg(F.min("root").alias("near")))
        step = label.join(heard, "fp").select("fp", "n", "root", F.least("root", "near").alias("low"))
        step = checkpointed(step)
        # Every node that shared the old label adopts the least label any of them heard.
        jump = step.groupBy("root").agg(F.min("low").alias("least"), F.count("*").alias("n"))
        new = checkpointed(join_hot(step.withColumnRenamed("n", "degree"), jump, "root", total)
                           .select("fp", F.col("degree").alias("n"), F.least("low", "least").alias("now"), "root"))
        changed = new.filter("now < root").limit(1).count()
        label = new.select("fp", "n", F.col("now").alias("root"))
        if not changed:
            return label.select("fp", "root")


def _named(fps: DataFrame, key: str):
    """fp, n, component (the least `key` of the component, nulls last) for each fingerprint."""
    nodes = checkpointed(fps.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")))
    label = components(links(nodes.select("fp")))
    linked = nodes.join(label, "fp").select("fp", "first", "n", "root")
    total = linked.count()
    least = linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n"))
    linked = join_hot(linked.withColumnRenamed("n", "rows"), least, "root", total).select("fp", F.col("rows").alias("n"), "component")
    alone = nodes.join(label, "fp", "left_anti").select("fp", "n", F.col("first").alias("component"))
    return checkpointed(linked.unionByName(alone))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    fps = checkpointed(fingerprints(docs))
    named = _named(fps, "doc_id").withColumnRenamed("component", "component_id")
    return (join_hot(fps, named, "fp", fps.count())
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (nulls last), then the smallest hashes of text and of the other columns.

    Rows that share an id are judged each by its own text. Of equal rows one stays. Columns of types that
    cannot be hashed (maps) pass through but do not take part in the choice.
    """
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString() and docs.schema[c].dataType.simpleString() != "variant"]
    # Rows without an id sort after all others.
    key = lambda i, text, h: F.struct(i.isNull().alias("none"), i.alias("id"), F.xxhash64(text).alias("t"), h.alias("h"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key(F.col("doc_id"), F.col("text"), F.xxhash64(*hashed)).alias("key"))
    fps = checkpointed(fingerprints(keyed.select(F.col("key").alias("doc_id"), "row.text")).withColumnRenamed("doc_id", "key"))
    chosen = _named(fps, "key").select("component").distinct().select(F.xxhash64("component").alias("k"))
    kept = keyed.withColumn("k", F.xxhash64("key")).join(chosen, "k", "left_semi")
    return kept.dropDuplicates(["k", "key"]).select("row.*")
