"""Nearest neighbours by inner product: NN-descent graphs and greedy graph search.

Equal vectors fold into one node that keeps its MOST + 1 smallest ids (no answer needs more).
Nodes are dealt by hash into shards of about SHARD nodes, so a shard's graph fits in a task at
every input size. NN-descent: starting from the best links within the groups of TREES random halvings of the shard, each round joins every
node's links (both directions) with the lists of the linked nodes and keeps the DEGREE best of
all candidates. The joins use the shard's partitioning, so only lists move between rounds.

A query walks the graph of each shard greedily: from ENTRIES nodes it opens the WIDTH best nodes
of its beam that are not yet open, scores those of their links (all of them, in both directions) that it has
not seen, and keeps the BEAM best, until every node of the beam is open. Memory follows what is
visited. The finalists are scored once more by one kernel, so that equal vectors tie exactly, and the
best of all shards are kept. The query set meets every shard in blocks of at most about PART queries,
so search work grows with queries times shards.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, as neither query nor candidate; only vectors of equal length are compared; a null id is no
query and no candidate; repeated ids stay separate rows, and no row with the query's id is its answer.
An empty table gives no rows. Extra columns are not read.
"""
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

MOST, EVERY, SHARD, DEGREE, ROUNDS, TREES, LEAF = 20, 20, 16_384, 20, 3, 6, 256
ENTRIES, BEAM, WIDTH, BATCH, PART = 32, 128, 4, 256, 20_000


@contextmanager
def copartitioned(spark, parts):
    """Let joins on more columns use a partitioning by the shard alone, however few shards there are."""
    new = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.shuffle.partitions": str(parts)}
    old = {name: spark.conf.get(name) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def usable(vectors: DataFrame) -> DataFrame:
    good = "size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(double(x)) = double('infinity')) and exists(embedding, x -> x <> 0)"
    return vectors.filter("vec_id is not null and embedding is not null").filter(good).selectExpr("cast(vec_id as long) as vec_id", "embedding")


def fold(rows: DataFrame) -> DataFrame:
    """embedding, ids: distinct vectors with their smallest ids. The rank limit also holds before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("r", rank).filter(F.col("r") <= MOST + 1)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _best(x, i, cand, degree):
    cand = cand[cand != i]
    if len(cand) > degree:
        cand = cand[np.argpartition(-(x[cand] @ x[i]), degree)[:degree]]
    return cand


def _unit(embeddings):
    # A shared norm keeps cosine and inner product in step for graph links.
    x = np.array(embeddings.tolist(), dtype=np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _leaves(x, rng):
    """Nodes of a shard in groups of at most LEAF, halved again and again by the difference of two of their vectors."""
    todo = [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            yield part
            continue
        a, b = rng.choice(part, 2, replace=False)
        order = np.argsort(x[part] @ (x[a] - x[b]), kind="stable")
        todo += [part[order[:len(part) // 2]], part[order[len(part) // 2:]]]


def _started(pdf: pd.DataFrame) -> pd.DataFrame:
    """First links of one shard: the best of each node's groups in TREES random halvings."""
    pdf = pdf.sort_values("idx")
    x, rng = _unit(pdf["embedding"]), np.random.default_rng(3)
    best, score = np.full((len(x), DEGREE), -1), np.full((len(x), DEGREE), -np.inf, np.float32)
    for _ in range(TREES):
        for leaf in _leaves(x, rng):
            near = x[leaf] @ x[leaf].T
            np.fill_diagonal(near, -np.inf)
            few = min(DEGREE, len(leaf))
            top = np.argpartition(-near, few - 1, axis=1)[:, :few]
            found, worth = leaf[top], np.take_along_axis(near, top, 1)
            worth[(found[:, :, None] == best[leaf][:, None, :]).any(2)] = -np.inf
            found, worth = np.c_[best[leaf], found], np.c_[score[leaf], worth]
            top = np.argpartition(-worth, DEGREE - 1, axis=1)[:, :DEGREE]
            best[leaf], score[leaf] = np.take_along_axis(found, top, 1), np.take_along_axis(worth, top, 1)
    out = pdf[["dim", "shard", "idx"]].copy()
    out["nbr"] = [b[np.isfinite(v)].tolist() for b, v in zip(best, score)]
    return out


def _kept(pdf: pd.DataFrame) -> pd.DataFrame:
    """The DEGREE best candidates of each node of one shard."""
    pdf = pdf.sort_values("idx")
    x = _unit(pdf["embedding"])
    out = pdf[["dim", "shard", "idx"]].copy()
    out["nbr"] = [_best(x, i, np.asarray(c, dtype=np.int32), DEGREE).tolist() for i, c in zip(pdf["idx"], pdf["cand"])]
    return out


def build(nodes: DataFrame, parts: int, rounds=ROUNDS) -> DataFrame:
    """dim, shard, idx, nbr: the neighbour graph of each shard."""
    spark, key = nodes.sparkSession, ["dim", "shard"]
    lists = nodes.repartition(parts, *key).groupBy(*key).applyInPandas(_started, "dim int, shard int, idx int, nbr array<int>")
    lists = checkpointed(lists)
    schema = "dim int, shard int, idx int, nbr array<int>"
    for _ in range(rounds):
        with copartitioned(spark, parts):
            held = lists.repartition(parts, *key)
            # Both directions come out of one explode, which keeps the partitioning.
            both = F.expr("explode(flatten(transform(nbr, x -> array(named_struct('a', idx, 'b', x), named_struct('a', x, 'b', idx))))) as link")
            links = held.select(*key, both).select(*key, F.col("link.a").alias("idx"), F.col("link.b").alias("to"))
            met = links.join(held.withColumnRenamed("idx", "to"), [*key, "to"])
            cand = met.groupBy(*key, "idx").agg(F.array_distinct(F.concat(F.flatten(F.collect_list("nbr")), F.collect_set("to"))).alias("cand"))
            whole = nodes.repartition(parts, *key).join(cand, [*key, "idx"], "left").select(
                *key, "idx", "embedding", F.coalesce("cand", F.array().cast("array<int>")).alias("cand"))
            lists = checkpointed(whole.groupBy(*key).applyInPandas(_kept, schema))
    return lists


def walk(x, links, queries, entries=ENTRIES):
    """Greedy walk of all queries over one graph: query, node and score of each beam, and how many nodes were scored in all.

    Rows are (query, node) pairs; `seen` holds query * n + node in order.
    """
    (offsets, targets), n, many = links, len(x), len(queries)
    first = np.unique(np.linspace(0, n - 1, min(n, entries)).astype(np.int64))
    r, c = np.repeat(np.arange(many), len(first)), np.tile(first, many)
    seen = r * n + c
    score = np.einsum("ij,ij->i", queries[r], x[c])
    opened = np.zeros(len(r), bool)
    while True:
        order = np.lexsort((c, -score, r))
        order = order[_place(r[order]) < max(BEAM, MOST + 1)]
        r, c, score, opened = r[order], c[order], score[order], opened[order]
        fresh = np.flatnonzero(~opened)
        fresh = fresh[_place(r[fresh]) < WIDTH]
        if not len(fresh):
            return r, c, score, len(seen)
        opened[fresh] = True
        begin, counts = offsets[c[fresh]], offsets[c[fresh] + 1] - offsets[c[fresh]]
        at = np.repeat(begin - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        keys = np.unique(np.repeat(r[fresh], counts) * n + targets[at])
        spot = np.searchsorted(seen, keys)
        new = (spot == len(seen)) | (seen[np.minimum(spot, len(seen) - 1)] != keys)
        keys = keys[new]
        seen = np.insert(seen, spot[new], keys)
        r, c = np.r_[r, keys // n], np.r_[c, keys % n]
        score = np.r_[score, np.einsum("ij,ij->i", queries[keys // n], x[keys % n])]
        opened = np.r_[opened, np.zeros(len(keys), bool)]


def _place(groups):
    """Place of each row in its group; groups are in order."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups)


def _links(lists, n):
    """All links in both directions: the targets of node i are targets[offsets[i]:offsets[i + 1]]."""
    src = np.repeat(np.arange(n), [len(v) for v in lists])
    dst = np.concatenate([np.asarray(v, dtype=np.int64) for v in lists]) if len(src) else np.zeros(0, np.int64)
    keys = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    return np.searchsorted(keys // n, np.arange(n + 1)), keys % n


def _search(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(graph) or not len(queries):
        return none
    graph = graph.sort_values("idx")
    x = np.array(graph["embedding"].tolist(), dtype=np.float64)
    ids, links = graph["ids"].tolist(), _links(graph["nbr"].tolist(), len(graph))
    out = []
    for at in range(0, len(queries), BATCH):
        part = queries.iloc[at:at + BATCH]
        q = np.array(part["asked"].tolist(), dtype=np.float64)
        r, c, _, _ = walk(x, links, q)
        score = np.add.reduce(q[r] * x[c], axis=1)
        cuts = np.searchsorted(r, np.arange(len(q) + 1))
        for i, own in enumerate(part["query_id"]):
            found = [(-s, v) for s, j in zip(score[cuts[i]:cuts[i + 1]].tolist(), c[cuts[i]:cuts[i + 1]].tolist()) for v in ids[j] if v != own]
            found.sort()
            out += [(own, v, -s) for s, v in found[:MOST]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else none


def search(vectors: DataFrame, shard=SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query."""
    rows = usable(vectors)
    folded = checkpointed(fold(rows).withColumn("dim", F.size("embedding")))
    shards = max(1, -(-folded.count() // shard))
    order = Window.partitionBy("dim", "shard").orderBy("node", "embedding")
    dealt = folded.withColumn("node", F.xxhash64("embedding")).withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    nodes = checkpointed(dealt.repartition(shards, "dim", "shard").select("dim", "shard", (F.row_number().over(order) - 1).alias("idx"), "embedding", "ids"))
    graph = nodes.join(build(nodes, shards), ["dim", "shard", "idx"])
    asked = rows.filter(F.col("vec_id") % EVERY == 0)
    parts = max(1, -(-asked.count() // PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = (asked.withColumn("dim", F.size("embedding")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
             .withColumn("shard", every(shards)).select("dim", "shard", "part", F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")))
    key, wide = ["dim", "shard", "part"], shards * parts
    found = (graph.withColumn("part", every(parts)).repartition(wide, *key).groupBy(*key)
             .cogroup(asked.repartition(wide, *key).groupBy(*key)).applyInPandas(_search, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= MOST)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
