"""Operators against brute force on small tables."""
import pytest
from pyspark.sql import SparkSession

from ledgermill.llm import decontam, langid, mixing, pii, simhash


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, count long")


def test_pii_spans():
    text = "Mail a.b@x.org or +1 (743) 555-3824, ip 10.0.0.255 not 1.2.3.256; again 743 555-3824."
    base, added = pii.spans_of(text)
    assert [(k, text[s:e]) for k, s, e in base] == [("email", "a.b@x.org"), ("ip", "10.0.0.255"), ("phone", "+1 (743) 555-3824")]
    assert [(k, text[s:e]) for k, s, e in added] == [("phone", "743 555-3824")]
    assert pii.base_spans("a@b a@b.c.d") == [("email", 4, 11)]
    assert pii.spans_of(None) == ([], [])
    assert pii.mask("x a@b.c y") == "x <EMAIL> y"


def test_matcher_against_windows():
    items = [(1, [b"w%d" % i for i in range(20)]), (2, [b"z", b"y"]), (3, []), (4, [b"w%d" % (i % 3) for i in range(15)])]
    text = [b"q"] + [b"w%d" % i for i in range(2, 18)] + [b"z", b"z", b"y"] + [b"w%d" % (i % 3) for i in range(40)]
    hit, owners = set(), set()
    for item, found in items:
        for i in range(max(1, len(found) - 12) if found else 0):
            w = found[i:i + 13]
            for at in range(len(text) - len(w) + 1):
                if text[at:at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
                    owners.add(item)
    spans, got = decontam.Matcher(items).search(text)
    assert {i for s, e in spans for i in range(s, e)} == hit and got == owners


def test_sliced_benchmark_agrees(spark, monkeypatch):
    d = docs(spark, [(1, " ".join(f"w{i}" for i in range(30)), None, None, 0, 0), (2, None, None, None, 0, 0), (2, None, None, None, 0, 0)])
    b = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 14))) for i in range(6)], "item_id long, text string")
    whole = sorted(decontam.contamination(d, b).collect())
    monkeypatch.setattr(decontam, "SLICE", 20)
    assert sorted(decontam.contamination(d, b).collect()) == whole


def test_near_duplicates_against_all_pairs(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one two")] + [(10 + k, " ".join([*base[:200], f"x{k // 2}", *base[201:]])) for k in range(30)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, [(i, t, None, None, 0, 0) for i, t in rows])).collect()}
    fps = {i: simhash.fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}
    for _ in fps:
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}


def test_mix_targets_and_words(spark):
    rows = [(i, "w " * (i % 37), None, None if i % 5 == 4 else f"s{i % 5}", 0, 0) for i in range(600)]
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    assert sorted(got) == sorted(mixing.mix(d).collect())
    total = sum(r.size for r in got)
    goals = {(r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in goals) - 1.5 * total) < 1e-3 and all(t <= 2 * s + 1e-6 for s, t in goals)
    for s, t in goals:
        assert abs(sum(r.taken for r in got if r.source_size == s) - t) <= 37
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)


def test_language_edges(spark):
    rows = [(i, ("der und nicht " if i % 2 else "the and of ") * 9, "de" if i % 2 else "en", None, 0, 0) for i in range(60)] + [(99, None, "en", None, 0, 0), (98, "12 !", "en", None, 0, 0)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, rows)).collect()}
    assert got[99] == got[98] == "und" and got[1] == "de" and got[2] == "en"


def test_empty_tables(spark):
    none = docs(spark, [])
    b = spark.createDataFrame([], "item_id long, text string")
    for out in (pii.find_pii(none), mixing.mix(none), langid.identify(none), decontam.contamination(none, b), simhash.near_duplicates(none)):
        assert out.count() == 0
