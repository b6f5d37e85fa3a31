"""Language identification: family first, then one-versus-one linear SVMs within it.

Features are hashed character 1- to 3-gram shares of the whole text. The models are fitted by
averaged hinge-loss descent on at most SAMPLE labelled documents chosen by hash (a bound on
what the driver holds), in turn from each language, so that a rare one is in it as long as there are no
more than SAMPLE languages; every document is judged. A null text, or one without a letter, is `und` with score 0.

Texts of any length are read whole, in pieces of CHUNK characters. Repeated rows and ids get equal answers, a null
id is in a learning fold, columns other than doc_id, text and lang are not read, an empty table gives no rows, and a
table without any lang gives `und` throughout. Ties of votes go to the larger margin, then to the later code.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, columns_of, fold, keep_rows

BUCKETS, SAMPLE, CHUNK = 1 << 13, 3000, 1 << 18
# ISO 639-1 codes by family; a language not listed is a family of its own.
FAMILY = {"fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "en": "germanic", "de": "germanic", "nl": "germanic"}


def features(text: str) -> np.ndarray:
    counts = np.zeros(BUCKETS)
    low = text.lower()
    for at in range(0, len(low), CHUNK):
        c = np.frombuffer(low[max(0, at - 2):at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in (1, 2, 3):
            h = np.full(max(0, len(c) - n + 1), n, np.uint64)
            for i in range(n):
                h = (h * np.uint64(1000003) + c[i:len(c) - n + 1 + i]) & np.uint64(0xFFFFFFFF)
            counts += np.bincount(((h * np.uint64(2654435761)) >> np.uint64(13)) & np.uint64(BUCKETS - 1), minlength=BUCKETS)
    x = np.sqrt(counts)
    return x / (np.linalg.norm(x) or 1)


def _packed(x: np.ndarray) -> bytes:
    """Places and values of the features that are not zero, in four bytes each."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].astype(np.float16).tobytes()


def _unpacked(data: bytes):
    half = len(data) // 2
    return np.frombuffer(data[:half], np.uint16), np.frombuffer(data[half:], np.float16).astype(np.float32)


def _svm(rows, y, epochs=15, reg=1e-4):
    """Averaged hinge-loss descent over rows of (places, values)."""
    rng, w, total, b, t = np.random.default_rng(7), np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            t += 1
            w *= 1 - reg
            at, x = rows[i]
            if y[i] * (w[at] @ x + b) < 1:
                w[at] += 0.1 * y[i] * x
                b += 0.01 * y[i]
            total += w
    return total / max(1, t), b


def train(docs: DataFrame):
    """Fitted on the smallest hashes of each language in the learning folds; executors make the features, so no text reaches the driver."""
    open_rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2)).withColumn("h", F.xxhash64("doc_id", "text"))
    known = open_rows.select("h", "lang").distinct()
    # Of a large language only about 2 * SAMPLE rows, those of the smallest hashes, are ranked.
    share = F.when(F.col("n") > 4 * SAMPLE, 2 * SAMPLE / F.col("n")).otherwise(F.lit(2.0))
    few = (known.join(F.broadcast(known.groupBy("lang").agg(F.count("*").alias("n"))), "lang")
           .filter(F.col("h").cast("double") / 2.0 ** 64 + 0.5 <= share))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    some = few.select("h", "lang", place.alias("place")).orderBy("place", "h", "lang").limit(SAMPLE)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"place": pdf["place"], "h": pdf["h"], "lang": pdf["lang"], "x": [_packed(features(t)) for t in pdf["text"]]})

    # Repeated rows count once.
    rows = (open_rows.select("h", "lang", "text").join(F.broadcast(some), ["h", "lang"]).mapInPandas(run, "place int, h long, lang string, x binary")
            .dropDuplicates(["h", "lang"]).orderBy("place", "h", "lang", "x").limit(SAMPLE).collect())
    x = [_unpacked(r.x) for r in rows]
    lang = np.array([r.lang for r in rows])
    family = np.array([FAMILY.get(v, v) for v in lang])
    model = {"families": sorted(set(family)), "members": {}, "top": [], "pairs": {}}
    for f in model["families"]:
        model["top"].append(_svm(x, np.where(family == f, 1, -1)))
        m = model["members"][f] = sorted(set(lang[family == f]))
        for i, a in enumerate(m):
            for b in m[i + 1:]:
                at = (lang == a) | (lang == b)
                model["pairs"][a, b] = _svm([x[j] for j in np.flatnonzero(at)], np.where(lang[at] == a, 1, -1))
    return model


def predict(model, text):
    if not text or not model["families"] or not any(map(str.isalpha, text)):
        return "und", 0.0
    x = features(text)
    top = [w @ x + b for w, b in model["top"]]
    at = int(np.argmax(top))
    members = model["members"][model["families"][at]]
    votes, margin = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for i, a in enumerate(members):
        for c in members[i + 1:]:
            w, b = model["pairs"][a, c]
            m = w @ x + b
            votes[a if m >= 0 else c] += 1
            margin[a] += m
            margin[c] -= m
    best = max(members, key=lambda v: (votes[v], margin[v], v))
    sure = min(top[at], margin[best]) if len(members) > 1 else top[at]
    return best, float(1 / (1 + np.exp(-np.clip(3 * sure, -30, 30))))


def identify(docs: DataFrame, model=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    return add_columns(docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out")), ["doc_id", "held_out"], ["text"], "lang_pred string, score double",
                       lambda: lambda texts: columns_of((predict(held.value, t) for t in texts), 2))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents with a language, all columns as they were; only `und` goes.

    Rows are judged one by one, so repeated or null ids and extra columns change nothing. Where no language
    could be learned (no row has one), a text with a letter stays.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs))

    def judge():
        model = held.value
        return lambda t: predict(model, t)[0] != "und" or (not model["families"] and t and any(map(str.isalpha, t)))

    return keep_rows(docs, judge)
