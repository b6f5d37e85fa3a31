"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the items (an item of fewer words is one window of its
own length). Per pattern length, a shift table over blocks of two words skips positions
where no pattern can end; a block that ends some pattern has shift zero, its bucket holds
the patterns with that suffix, and comparison of all words confirms.

Patterns are gathered in slices of at most SLICE words (a longer item is cut into pieces that
overlap by a window less one word), so what is sent to the executors has a fixed bound; more
words mean more slices, each one scan of the documents, whose hits are merged by row.

Null or wordless texts have no words, no hits and are clean; null or wordless items have no window.
Windows of an item without an id are hit like any other, but the item is neither counted nor hashed.
Rows are judged one by one: repeated rows and ids get a row each, a null id is kept, and other columns
are not read. Empty tables give no rows, or no hits.
"""
from collections import defaultdict
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, checkpointed, columns_of, keep_rows, sha, words

WINDOW, SLICE = 13, 200_000


class Matcher:
    def __init__(self, items):
        """items: (item_id, words) pairs."""
        owners = defaultdict(set)
        for item, found in items:
            for i in range(max(1, len(found) - WINDOW + 1) if found else 0):
                owners[tuple(found[i:i + WINDOW])].add(item)
        by_length = defaultdict(list)
        for pattern in owners:
            by_length[len(pattern)].append(pattern)
        self.tables = []
        for m, patterns in sorted(by_length.items()):
            block = min(2, m)
            shift, bucket = {}, defaultdict(set)
            for p in patterns:
                for end in range(block, m + 1):
                    key = p[end - block:end]
                    shift[key] = min(shift.get(key, m - block + 1), m - end)
                bucket[p[m - block:]].add(p)
            self.tables.append((m, block, m - block + 1, shift, dict(bucket)))
        # Windows of an item without an id count as hits; nobody owns them.
        self.owners = {p: {i for i in v if i is not None} for p, v in owners.items()}

    def search(self, found):
        """Intervals of hit words (merged, in order) and the items with a hit."""
        spans, items = [], set()
        n = len(found)
        for m, block, skip, shift, bucket in self.tables:
            at = m
            while at <= n:
                key = tuple(found[at - block:at])
                step = shift.get(key, skip)
                if step == 0:
                    window = tuple(found[at - m:at])
                    if window in bucket[key]:
                        spans.append((at - m, at))
                        items |= self.owners[window]
                    step = 1
                at += step
        return merge(spans), items


def merge(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def slices(benchmark: DataFrame):
    """Lists of (item_id, words), each of at most about SLICE words."""
    part, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        whole = words(row.text)
        for at in range(0, max(1, len(whole) - WINDOW + 1), SLICE):
            found = whole[at:at + SLICE + WINDOW - 1]
            if part and held + len(found) > SLICE:
                yield part
                part, held = [], 0
            part.append((row.item_id, found))
            held += len(found)
    if part:
        yield part


def _judged(spans, n):
    hit = sum(e - s for s, e in spans)
    return hit, hit > 0 and 20 * hit >= n


def _names(items):
    return sorted(str(i) for i in items)


def _answer(n, spans, names):
    hit, bad = _judged(spans, n)
    return n, hit, len(names), sha(",".join(names)), bad


TAIL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _scan_all(docs, part):
    """Answers when one slice holds every pattern."""
    held = docs.sparkSession.sparkContext.broadcast(Matcher(part))

    def judge(text):
        found = words(text)
        spans, items = held.value.search(found)
        return _answer(len(found), spans, _names(items))

    return add_columns(docs.select("doc_id", "text"), ["doc_id"], ["text"], TAIL, lambda: lambda texts: columns_of(map(judge, texts), 5))


def _scan_slice(marked, part):
    """Only the rows with hits of one slice."""
    held = marked.sparkSession.sparkContext.broadcast(Matcher(part))

    def judge(text):
        spans, items = held.value.search(words(text))
        return [x for s in spans for x in s], _names(items)

    return add_columns(marked.select("rid", "text"), ["rid"], ["text"], "spans array<int>, items array<string>",
                       lambda: lambda texts: columns_of(map(judge, texts), 2)).filter("size(spans) > 0")


def _scan_slices(marked, parts):
    """rid, doc_id and the answers, merged over the slices."""
    hits = None
    for part in parts:
        one = _scan_slice(marked, part)
        hits = one if hits is None else hits.unionByName(one)
    merged = hits.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    sized = add_columns(marked.select("rid", "doc_id", "text"), ["rid", "doc_id"], ["text"], "size long", lambda: lambda texts: [[len(words(t)) for t in texts]])

    def judge(n, spans, items):
        spans = spans or []
        return _answer(n, merge(list(zip(spans[::2], spans[1::2]))), sorted(items or []))

    return add_columns(sized.join(merged, "rid", "left"), ["rid", "doc_id"], ["size", "spans", "items"], TAIL, lambda: lambda *c: columns_of(map(judge, *c), 5))


def _marked(docs):
    """Rows with a number of their own, written down so that a lost executor's rows get the same ones again."""
    return checkpointed(docs.withColumn("rid", F.monotonically_increasing_id()))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    parts = slices(benchmark)
    first = next(parts, [])
    second = next(parts, None)
    if second is None:
        return _scan_all(docs, first)
    return _scan_slices(_marked(docs.select("doc_id", "text")), chain([first, second], parts)).drop("rid")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, row by row, all columns as they were."""
    parts = slices(benchmark)
    first = next(parts, [])
    second = next(parts, None)
    if second is None:
        held = docs.sparkSession.sparkContext.broadcast(Matcher(first))

        def judge():
            def clean(text):
                found = words(text)
                return not _judged(held.value.search(found)[0], len(found))[1]
            return clean

        return keep_rows(docs, judge)
    # A struct keeps the columns apart from the row's number, whatever their names.
    marked = checkpointed(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("row")))
    bad = _scan_slices(marked.select("rid", "row.doc_id", "row.text"), chain([first, second], parts)).filter("contaminated").select("rid")
    return marked.join(bad, "rid", "left_anti").select("row.*")
