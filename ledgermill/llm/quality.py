"""Quality classifier: random-indexing word vectors, mean-pooled, and a two-layer network.

Each hashed word has a sparse random vector; its word vector adds those of its neighbours in
all documents. Executors sum them (integers, so in any order alike) and pool the texts; the
driver holds the table and at most SAMPLE pooled rows. The network is fitted on at most SAMPLE
labelled rows chosen by hash, its temperature on a tenth of them kept aside.

Empty and null texts score the zero vector; very long texts are pooled whole, a piece at a time. Repeated
rows and ids get equal scores, a null id is never labelled and in a learning fold, labels other than 0 and 1
are not learned, and without labels every score is 0.5. Columns other than doc_id and text (labels: doc_id
and quality) are not read; an empty table gives no rows.
"""
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fold

TOKEN, BUCKETS, DIM, HIDDEN, SAMPLE, CUT = re.compile(r"\w+|[^\w\s]+"), 1 << 14, 64, 32, 3000, 0.3
# Words of a task whose pairs are counted at a time; pairs summed at a time; rows of the table in a slice.
TOKENS, PAIRS, SLICE = 1 << 20, 1 << 18, 256


def buckets(text):
    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for t in TOKEN.findall(text or "")], dtype=np.int64)


def index_vectors():
    rng = np.random.default_rng(11)
    return (rng.integers(0, 8, (BUCKETS, DIM)) == 0) * rng.choice([-1.0, 1.0], (BUCKETS, DIM))


def pool(vectors, ids, chunk=65536):
    if not len(ids):
        return np.zeros(DIM)
    return sum(vectors[ids[i:i + chunk]].sum(0) for i in range(0, len(ids), chunk)) / len(ids)


def entries(base):
    """Where each word's non-zero entries start, their columns and their values."""
    word, column = np.nonzero(base)
    return np.searchsorted(word, np.arange(BUCKETS + 1)), column, base[word, column].astype(np.float64)


def near(vectors, texts, sparse):
    """Adds to each word's row of vectors the random vectors of its neighbours in the texts."""
    starts, column, value = sparse
    # Pairs are counted first, so a pair costs its few entries however often it comes; sums of whole numbers are exact.
    keys = [np.minimum(a, b) * BUCKETS + np.maximum(a, b) for x in texts for a, b in ((x[:-1], x[1:]), (x[:-2], x[2:]))]
    pairs, counts = np.unique(np.concatenate(keys).astype(np.uint32), return_counts=True)
    low, high = pairs.astype(np.int64) // BUCKETS, pairs.astype(np.int64) % BUCKETS
    flat = vectors.reshape(-1)
    for a, b in ((low, high), (high, low)):
        for at in range(0, len(a), PAIRS):
            some = slice(at, at + PAIRS)
            first, size = starts[a[some]], starts[a[some] + 1] - starts[a[some]]
            place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            flat += np.bincount(np.repeat(b[some] * DIM, size) + column[place], np.repeat(counts[some], size) * value[place], BUCKETS * DIM).astype(np.int64)


def context(docs):
    """Word vectors from all documents: sums of each task by slices of the table, then of the slices."""
    def run(batches):
        base = entries(index_vectors())
        sums, held, size = np.zeros((BUCKETS, DIM), np.int64), [], 0
        for pdf in batches:
            for t in pdf["text"]:
                x = buckets(t)
                if len(x) > 1:
                    held.append(x)
                    size += len(x)
                if size > TOKENS:
                    near(sums, held, base)
                    held, size = [], 0
        if held:
            near(sums, held, base)
        for at in range(0, BUCKETS, SLICE):
            if sums[at:at + SLICE].any():
                yield pd.DataFrame({"slice": [at], "sums": [zlib.compress(sums[at:at + SLICE].tobytes(), 1)]})

    def add(batches):
        total = {}
        for pdf in batches:
            for at, part in zip(pdf["slice"], pdf["sums"]):
                total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(part), np.int64)
        for at, part in total.items():
            yield pd.DataFrame({"slice": [at], "sums": [part.tobytes()]})

    vectors = index_vectors()
    for r in docs.select("text").mapInPandas(run, "slice int, sums binary").repartition("slice").mapInPandas(add, "slice int, sums binary").collect():
        vectors[r.slice:r.slice + SLICE] += np.frombuffer(r.sums, np.int64).reshape(-1, DIM)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def train(docs, labels):
    some = (labels.filter(F.col("quality").isin(0, 1) & (fold("doc_id", 5) != 0)).select("doc_id", "quality").distinct()
            .orderBy(F.xxhash64("doc_id"), "quality").limit(SAMPLE))
    vectors = context(docs)
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "quality": pdf["quality"], "x": [pool(held.value, buckets(t)).astype(np.float64).tobytes() for t in pdf["text"]]})

    # Repeated ids cannot exceed the bound either.
    rows = (docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.xxhash64("doc_id").alias("h"), F.col("quality").cast("int").alias("quality"), "text")
            .mapInPandas(run, "h long, quality int, x binary").orderBy("h", "quality", "x").limit(SAMPLE).collect())
    x, y = np.array([np.frombuffer(r.x) for r in rows]).reshape(-1, DIM), np.array([float(r.quality) for r in rows])
    mean, dev = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(DIM), np.ones(DIM))
    x = (x - mean) / dev
    rng = np.random.default_rng(5)
    p = [rng.normal(0, 0.2, (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    aside = np.arange(len(y)) % 10 == 0
    xt, yt = x[~aside], y[~aside]
    for t in range(1, 401 if len(yt) else 1):
        h = np.tanh(xt @ p[0] + p[1])
        e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt) / len(yt)
        back = np.outer(e, p[2]) * (1 - h * h)
        for i, g in enumerate([xt.T @ back + 1e-3 * p[0], back.sum(0), h.T @ e + 1e-3 * p[2], e.sum(keepdims=True)]):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    z = (np.tanh(x[aside] @ p[0] + p[1]) @ p[2] + p[3]) if len(y) else np.zeros(0)
    loss = lambda t: np.logaddexp(0, np.where(y[aside] == 1, -z, z) / t).sum()
    return vectors, mean, dev, p, min((0.5, 0.75, 1, 1.5, 2, 3, 5), key=loss)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def judge(texts):
        vectors, mean, dev, p, temperature = held.value
        x = (np.array([pool(vectors, buckets(t)) for t in texts]).reshape(-1, DIM) - mean) / dev
        s = 1 / (1 + np.exp(-np.clip((np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]) / temperature, -30, 30)))
        return s, (s >= CUT).astype("int32")

    return add_columns(docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out")), ["doc_id", "held_out"], ["text"], "score double, predicted int", lambda: judge)
