"""Personal data: pattern spans plus a skip-chain conditional random field.

Nodes are candidate tokens of one document: base spans, whose label is known, and unconfirmed numbers and
spelt-out addresses. Neighbours in text order share a chain potential; occurrences of the same or a similar
token (equal last nine digits, equal folded address) share a skip potential. Occurrences of one key are
linked one to the next, so edges grow linearly with the tokens. Damped loopy sum-product passes beliefs over
both kinds of edge; a candidate whose marginal for a kind passes the threshold becomes a span unless it
overlaps a base span.

The weights of shape, chain and skip are fitted by pseudo-likelihood on the documents themselves. Base spans
are the labels, also of unconfirmed tokens of the same key; the cue by which the pattern found them (the plus sign,
the at sign) is taken from their shape first, numbers that no pattern confirmed are the counter-examples. The fit is held near PRIOR, which rules where
there is nothing to learn from. It sees the nodes of at most SAMPLE documents, the smallest hashes of doc_id, of
at most NODES nodes each; every document is judged, whole.

A null text is empty: no spans, the hash of the empty string. Rows are judged one by one, so ties, repeated
rows and repeated or null ids change nothing; columns other than doc_id and text are not read by find_pii and
pass through redact unchanged; an empty table gives no rows.
"""
import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, columns_of, sha

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# Possessive runs: a failing long run is scanned once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9][0-9().\x20-]*[0-9](?![0-9A-Za-z])")
SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})[\x20]?[(\[](?:at|AT)[)\]][\x20]?"
                   r"([A-Za-z0-9-]{1,63}(?:(?:\.|[\x20]?[(\[](?:dot|DOT)[)\]][\x20]?)[A-Za-z0-9-]{1,63}){1,8})")
DATE = re.compile(r"(?:19|20)[0-9]{2}([-./\x20])[01]?[0-9]\1[0-3]?[0-9](?![0-9])|[0-3]?[0-9]([-./\x20])[01]?[0-9]\2(?:19|20)[0-9]{2}(?![0-9])")
DIGITS = re.compile("[^0-9]")
ROUNDS, DAMPING, THRESHOLD = 12, 0.5, 0.6
CLAMP, SAMPLE, NODES, STEPS, PULL = 8.0, 4000, 256, 300, 2.0
# Shape of a candidate; labels are outside, then KINDS.
FEATURES = ("bias", "address", "digits_9_11", "digits_12", "digits_13_19", "luhn", "marks", "round_brackets", "dash", "space", "dots")
PRIOR = np.zeros((1 + len(KINDS), len(FEATURES)))
PRIOR[:, 0] = 1.2, -6.0, -4.0, -4.0, -1.5
PRIOR[1, 1], PRIOR[3, 4], PRIOR[3, 5], PRIOR[0, 4] = 9.0, 2.5, 2.0, 0.5
PRIOR[4, 2], PRIOR[4, 6], PRIOR[2, 10] = 1.9, 0.3, 0.5
#: Shape weights, chain strength, skip strength.
PRIOR_MODEL = (PRIOR, 0.15, 2.5)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text):
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        hit = DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            out.append((start, hit.end()))
            done = hit.end()
        else:
            done = at + 1 if not hit else done
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list:
    """(kind, start, end) in the order of KINDS, then start."""
    if not text:
        return []
    out = [("email", *s) for s in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _key(piece: str, kind: str) -> str:
    if kind == "email":
        return "e" + re.sub(r"\x20?[(\[]at[)\]]\x20?", "@", re.sub(r"\x20?[(\[]dot[)\]]\x20?", ".", piece.lower()))
    if kind == "ip":
        return "i" + piece
    return "n" + DIGITS.sub("", piece)[-9:]


def _shape(piece: str, kind: str) -> np.ndarray:
    """FEATURES of a candidate, without the cue by which a pattern knows it."""
    if kind == "email":
        return np.array([1.0, 1.0] + [0.0] * (len(FEATURES) - 2))
    piece = piece.removeprefix("+1").strip("+ ")
    digits = DIGITS.sub("", piece)
    n = len(digits)
    marks = sum(c in "().- " for c in piece)
    return np.array([1, 0, 9 <= n <= 11, n == 12, 13 <= n <= 19, 13 <= n <= 19 and luhn(digits), min(marks, 3), "(" in piece, "-" in piece, " " in piece, piece.count(".") == 3], dtype=float)


def nodes_of(text: str, base: list):
    """Nodes (start, end, kind, known label or None) in order, and edges by chain and by skip."""
    extra = [(m.start(), m.end(), "email") for m in SPELT.finditer(text)]
    extra += [(m.start(), m.end(), "number") for m in LOOSE.finditer(text)
              if 9 <= sum(c.isdigit() for c in m.group()) <= 19 and not DATE.match(m.group())]
    taken = sorted((s, e) for _, s, e in base)
    # Base spans of different kinds may nest: the furthest end so far shows what reaches over a place.
    reach, furthest = [], 0
    for s, e in taken:
        furthest = max(furthest, e)
        reach.append(furthest)
    starts = [s for s, _ in taken]
    free = []
    for s, e, k in extra:
        before = bisect_left(starts, e)
        if not before or reach[before - 1] <= s:
            free.append((s, e, k, None))
    nodes = sorted([(s, e, k, 1 + KINDS.index(k)) for k, s, e in base] + free, key=lambda x: x[:3])
    by_key = defaultdict(list)
    for i, (s, e, k, _) in enumerate(nodes):
        by_key[_key(text[s:e], k)].append(i)
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] < 80]
    skip = []
    for group in by_key.values():
        # A confirmed token speaks first within its group, so support reaches every repetition.
        group.sort(key=lambda i: (nodes[i][3] is None, i))
        skip += zip(group, group[1:])
    return nodes, chain, skip


def crf_spans(text: str, base: list, model=None, skips=True) -> list:
    """Spans that the field adds to the base ones."""
    if not text:
        return []
    nodes, chain, skip = nodes_of(text, base)
    if all(known for *_, known in nodes):
        return []
    weights, chained, skipped = model or PRIOR_MODEL
    unary = np.zeros((len(nodes), len(weights)))
    for i, (s, e, k, known) in enumerate(nodes):
        if known:
            unary[i, known] = CLAMP
        else:
            unary[i] = weights @ _shape(text[s:e], k)
    belief = _propagate(unary, [(a, b, chained) for a, b in chain] + [(a, b, skipped) for a, b in skip if skips])
    out = []
    for i, (s, e, _, known) in enumerate(nodes):
        label = int(belief[i, 1:].argmax()) + 1
        if not known and belief[i, label] >= THRESHOLD:
            out.append((KINDS[label - 1], s, e))
    return out


def evidence(text) -> np.ndarray:
    """Of each node of a text: label, shape, and how many chain and skip neighbours have each label."""
    if not text:
        return np.zeros((0, 0))
    nodes, chain, skip = nodes_of(text, base_spans(text))
    nodes = nodes[:NODES]
    labels = [known or 0 for *_, known in nodes]
    # The confirmed come first in a group, so their label goes down the links.
    for a, b in skip:
        if a < len(nodes) and b < len(nodes) and not labels[b]:
            labels[b] = labels[a]
    near = np.zeros((2, len(nodes), 1 + len(KINDS)))
    for kind, edges in enumerate((chain, skip)):
        for a, b in edges:
            if a < len(nodes) and b < len(nodes):
                near[kind, a, labels[b]] += 1
                near[kind, b, labels[a]] += 1
    rows = [[labels[i], *_shape(text[s:e], k), *near[0, i], *near[1, i]] for i, (s, e, k, _) in enumerate(nodes)]
    return np.array(rows, dtype=float)


def fit(rows: np.ndarray):
    """Weights of largest pseudo-likelihood: each node given its shape and its neighbours' labels, held near PRIOR_MODEL."""
    if not len(rows):
        return PRIOR_MODEL
    many, shapes = 1 + len(KINDS), len(FEATURES)
    y, x = rows[:, 0].astype(int), rows[:, 1:1 + shapes]
    near = rows[:, 1 + shapes:].reshape(-1, 2, many)
    w, e = PRIOR.copy(), np.array(PRIOR_MODEL[1:])
    start = w.copy(), e.copy()
    moment = [np.zeros_like(w), np.zeros_like(e)], [np.zeros_like(w), np.zeros_like(e)]
    for t in range(1, STEPS + 1):
        z = x @ w.T + np.einsum("k,nky->ny", e, near)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        grads = p.T @ x + PULL * (w - start[0]), np.einsum("ny,nky->k", p, near) + PULL * (e - start[1])
        for i, (now, g) in enumerate(zip((w, e), grads)):
            moment[0][i][:] = 0.9 * moment[0][i] + 0.1 * g
            moment[1][i][:] = 0.999 * moment[1][i] + 0.001 * g * g
            now -= 0.05 * (moment[0][i] / (1 - 0.9 ** t)) / (np.sqrt(moment[1][i] / (1 - 0.999 ** t)) + 1e-8)
    # Similar tokens attract; they never repel.
    return w, float(max(0.0, e[0])), float(max(0.0, e[1]))


def train(docs: DataFrame):
    """The field fitted on a sample of documents; executors make the nodes, so no text reaches the driver."""
    some = docs.select(F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(SAMPLE)

    def run(batches):
        for pdf in batches:
            found = [(h, e) for h, e in zip(pdf["h"], map(evidence, pdf["text"])) if len(e)]
            if found:
                yield pd.DataFrame({"h": [h for h, _ in found], "x": [e.tobytes() for _, e in found]})

    rows = (docs.select(F.xxhash64("doc_id").alias("h"), "text").join(F.broadcast(some), "h").mapInPandas(run, "h long, x binary")
            .orderBy("h", "x").limit(SAMPLE).collect())
    width = 1 + len(FEATURES) + 2 * (1 + len(KINDS))
    return fit(np.concatenate([np.frombuffer(r.x).reshape(-1, width) for r in rows]) if rows else np.zeros((0, width)))


def _propagate(unary, edges):
    n = len(unary)
    if not edges:
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    a, b = np.array([x[0] for x in edges]), np.array([x[1] for x in edges])
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    m = len(a)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    gain = np.expm1(np.tile([x[2] for x in edges], 2))[:, None]
    msg = np.zeros((2 * m, unary.shape[1]))
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, dst, msg)
        out = total[src] - msg[back]
        p = np.exp(out - out.max(1, keepdims=True))
        # Agreement weighs exp(strength), anything else 1.
        new = np.log(p.sum(1, keepdims=True) + gain * p)
        new -= new.mean(1, keepdims=True)
        msg = DAMPING * msg + (1 - DAMPING) * new
    total = unary.copy()
    np.add.at(total, dst, msg)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def spans_of(text, model=None) -> tuple:
    base = base_spans(text or "")
    return base, crf_spans(text or "", base, model)


def _digest(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind of the base spans, their hash, and all spans."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs))

    def judge(text):
        base, added = spans_of(text, held.value)
        kinds = [k for k, _, _ in base]
        return *[kinds.count(k) for k in KINDS], sha(_digest(base)), _digest(base + added)

    return add_columns(docs.select("doc_id", "text"), ["doc_id"], ["text"], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
                       lambda: lambda texts: columns_of(map(judge, texts), 6))


def mask(text, model=None):
    """The text with each span replaced by its kind; overlapping spans merge under the first one's kind."""
    if not text:
        return text
    base, added = spans_of(text, model)
    merged = []
    for k, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    out, at = [], 0
    for k, s, e in merged:
        out += [text[at:s], f"<{k.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """Documents with personal data masked; all other columns as they were, n_chars (if there) of the masked text."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [mask(t, held.value) for t in old]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            at = batch.schema.get_field_index("n_chars")
            if at >= 0:
                sizes = [len(b) if a != b else n for a, b, n in zip(old, new, batch.column(at).to_pylist())]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
