"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""
import html
import random
import re

import numpy as np
import pytest

from ledgermill.llm import decontam, htmltext, langid, licenses, mixing, neighbours, pii, quality, simhash, urlrules

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, copies int, row long, key string, rid long, k long, root long, n long, size long, props map<string,string>"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, 2, "k", 3, 4, 5, 6, 7, {"a": "b"}) for i, t, lang, s in rows], CLASHING)


LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
EDGES = [(None, None, None, None), (None, "", "en", "s"), (7, "the and of one", "en", "s"), (7, "the and of two", "en", "s"), (7, "the and of two", "en", "s"),
         (3, "  \t ", "en", None), (4, LONG, "en", "s"), (2 ** 60 + 1, "the and of three", None, "t")]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_every_operator_keeps_rows_and_names(spark):
    d, none = docs(spark, EDGES), docs(spark, [])
    labels = spark.createDataFrame([(7, 1, 0), (3, 0, 0)], "doc_id long, quality int, score int")
    items = spark.createDataFrame([(None, "the and of"), (5, "one"), (6, None)], "item_id long, text string")
    for f in (pii.find_pii, licenses.licenses, langid.identify, simhash.near_duplicates, mixing.mix, lambda x: decontam.contamination(x, items), lambda x: quality.score(x, labels)):
        got = [r.doc_id for r in f(d).collect()]
        assert sorted(got, key=str) == sorted([r[0] for r in EDGES], key=str)
        assert f(none).count() == 0
    for f in (langid.keep_identified, simhash.deduplicate, lambda x: decontam.decontaminate(x, items), pii.redact):
        assert f(d).columns == d.columns and f(none).count() == 0
        assert all(r.props == {"a": "b"} and r.copies == 1 for r in f(d).collect())


def test_decontamination_counts_alike_in_one_slice_and_many(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i % 37, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(60))), None, None) for i in range(60)] + EDGES
    items = [(None, "w1 w2"), (5, "w1 w2 w3"), (6, None), (7, " ".join(f"w{i % 9}" for i in range(40))), (8, "W1 w2")]
    b = spark.createDataFrame(items, "item_id long, text string")

    def plain(text):
        found, hit, owners = plain_words(text), set(), set()
        for item, t in items:
            w = plain_words(t)
            for i in range(max(1, len(w) - 12) if w else 0):
                p = w[i:i + 13]
                for at in range(len(found) - len(p) + 1):
                    if found[at:at + len(p)] == p:
                        hit |= set(range(at, at + len(p)))
                        owners |= {item} - {None}
        return len(found), len(hit), len(owners), bool(hit) and 20 * len(hit) >= len(found)

    want = sorted([(str(i), *plain(t)) for i, t, _, _ in rows if t != LONG])
    for size in (decontam.SLICE, 15):
        monkeypatch.setattr(decontam, "SLICE", size)
        d = docs(spark, [r for r in rows if r[1] != LONG])
        got = decontam.contamination(d, b).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == want
        kept = decontam.decontaminate(d, b).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(i), str(t)) for i, t, _, _ in rows if t != LONG and not plain(t)[3])


def test_dedup_keeps_different_texts_of_one_id(spark):
    texts = [" ".join(f"{a}{i}" for i in range(60)) for a in "abcd"]
    rows = [(7, texts[0], "en", "s"), (7, texts[1], "en", "s"), (None, texts[2], "en", "s"), (3, texts[3], "en", "s"), (9, texts[3], "en", "s"), (None, texts[3], "en", "s"), (3, texts[3], "en", "s")]
    got = simhash.deduplicate(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("7", texts[0]), ("7", texts[1]), ("None", texts[2]), ("3", texts[3])])


def test_chains_through_rows_without_an_id(spark):
    """Components reach through nodes whose rows have no id."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {}
    for b in base:
        for step in range(6):
            fps[b] = None if step % 2 else len(fps)
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
    rows = [(i, f - (1 << 64) if f >> 63 else f) for f, i in fps.items()]
    named = {r.fp: r.component for r in simhash._named(spark.createDataFrame(rows, "doc_id long, fp long"), "doc_id").collect()}
    nodes, root = list(fps), {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    for f in nodes:
        ids = [fps[g] for g in nodes if find(g) == find(f) and fps[g] is not None]
        assert named[f - (1 << 64) if f >> 63 else f] == min(ids, default=None)


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2 ** 63, (2, 500), dtype=np.uint64)
    count = lambda x: np.array([[(int(v) >> 2 * s & 3).bit_count() for s in range(32)] for v in x])
    manhattan = np.abs(count(a) - count(b)).sum(1)
    assert (np.bitwise_count(simhash.embedded(a) ^ simhash.embedded(b)) == manhattan).all() and (manhattan <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("narrow, salt", [(256, 4096), (4, 16)])
def test_links_against_all_pairs(spark, monkeypatch, narrow, salt):
    monkeypatch.setattr(simhash, "NARROW", narrow)
    monkeypatch.setattr(simhash, "SALT_ROWS", salt)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(3)
    fps = {0, 1, 3, 7, 15}
    while len(fps) < 300:
        f = rng.choice(list(fps))
        for bit in rng.sample(range(64), rng.choice([1, 3, 4, 5, 9])):
            f ^= 1 << bit
        fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    back = lambda f: f % (1 << 64)
    assert all((back(e.src) ^ back(e.dst)).bit_count() <= 4 for e in edges)
    forest, truth = simhash.Forest(), simhash.Forest()
    for e in edges:
        forest.add(back(e.src), back(e.dst))
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4:
                truth.add(a, b)
    assert {f: forest.root(f) for f in fps} == {f: truth.root(f) for f in fps}


def test_mix_with_equal_rows_and_one_large_document(spark):
    rows = [(5, "a b c", "en", "same")] * 20_000 + [(i, "w " * 40, "en", "big") for i in range(400)] + [(999, "w " * 5000, "en", "big"), (None, "x y", "en", None), (None, None, None, None)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == 60_000 + 16_000 + 5000 + 2
    for size in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(3, 0.01 * mine[0].target) and all(r.taken <= 2 * r.size for r in mine)
    mixed = mixing.mixed(docs(spark, rows))
    assert mixed.columns[-1] == "copies_" and mixed.filter("text = 'a b c'").count() == 1
    assert mixed.filter("text = 'a b c'").first()["copies_"] * 3 == sum(r.taken for r in got if r.size == 3)


def test_mix_expectation(spark):
    """Over many sources the pairing neither favours nor forgets documents."""
    rows = [(i, "w " * (1 + i % 9), None, f"s{i % 3}") for i in range(9000)]
    got = mixing.mix(docs(spark, rows)).collect()
    for part in range(9):
        mine = [r for r in got if r.size == part + 1]
        share = sum(r.taken for r in mine) / sum(r.size * r.target / r.source_size for r in mine)
        assert abs(share - 1) < 0.1


def test_url_rules_against_all_rules(spark):
    rng = random.Random(4)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rules = [(h, rng.choice(["/", "/x/", "/x/y/"]), rng.choice(["allow", "block"])) for h in dict.fromkeys(hosts[:25])]
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.c?q", "x://a.b#f", "x://y://a/x/", "http://a/\nb/", "http://a/" + "x/" * 5000]
    urls += [f"http://{h.upper() if i % 3 else h}{rng.choice(['', '/', '/x', '/x/', '/x/y/z', '?x', '#/x/'])}" for i, h in enumerate(hosts)] * 2

    def plain(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    rows = [(i % 50 if i else None, u, "h", "k", 1) for i, u in enumerate(urls)]
    got = urlrules.judge(spark.createDataFrame(rows, "page_id long, url string, host string, key string, rule int"), rules).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(str((i, *plain(u))) for i, u, *_ in rows)
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_pages(spark):
    body = "<body><nav>Menu</nav><article><h1>T</h1><p>One, two.</p></article></body>"
    rows = [(1, "u", body, "x", 1), (1, "u", body, "x", 1), (None, None, None, "x", 1), (2, "v", "", "x", 1), (3, "w", "<p>" + "Word, more. " * 50_000, "x", 1)]
    got = sorted(htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect(), key=str)
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted([("1", 11), ("1", 11), ("None", 0), ("2", 0), ("3", 12 * 50_000 - 1)])
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_with_omitted_tags_and_broken_markup():
    assert htmltext.extract("<html><head><title>x</title><body><p>Hello, reader of this page.</p></body></html>") == "Hello, reader of this page."
    assert htmltext.extract("<head><meta charset=x><p>Hello there.") == "Hello there."
    assert html.unescape("&lt;") == "<" and htmltext.extract("<p>1 < 2 &lt; 3</p>") == "1 < 2 < 3"
    assert htmltext.extract('<p title="a>b">One</p><p title="c>Two</p><p>Three</p>').startswith("One")
    import time
    for page in ("<a " * 40_000, "<div>t" * 10_000, "<div>t" * 8000 + "</p>" * 8000, '<a "' * 20_000, "<a '\">" * 20_000):
        began = time.time()
        htmltext.extract(page)
        assert time.time() - began < 5


def test_division_beside_the_best():
    text = "".join(f"<p>Long paragraph {i}, with commas, and words enough to weigh.</p>" for i in range(8))
    page = f"<body><div class=menu><a href=/>x</a></div><div class=lead>A lead of some words that tells what the text is about.</div><div>{text}</div><div><a href=/>Only a link of many words, and more of them here</a></div></body>"
    assert htmltext.extract(page).startswith("A lead of some words") and "Only a link" not in htmltext.extract(page)


def test_licences_against_plain_search(spark):
    rng = random.Random(6)
    vocabulary = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "é", "-"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80))), None, None) for i in range(120)] + EDGES
    got = sorted(licenses.licenses(docs(spark, rows)).collect(), key=str)
    want = []
    for i, t, _, _ in rows:
        found = plain_words(t)
        places = [(at, label) for phrase, label in licenses.PHRASES.items() for at in range(len(found)) if found[at:at + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places]
        want.append((i, len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)


def test_licence_automata():
    run = lambda t, text: licenses.Automaton(t).run([w.encode() for w in text.split()], 0)
    assert run("alpha [{2} beta] gamma", "alpha beta gamma")[0] and run("alpha [{2} beta] gamma", "alpha x y beta gamma")[0]
    assert run("alpha [{2} beta] gamma", "alpha gamma")[0] and not run("alpha [{2} beta] gamma", "alpha x gamma")[0]
    assert run("a [b [c]] [d] e", "a b d e")[0] and not run("a [b [c]] [d] e", "a c e")[0]
    assert run("a b c d", "a b c x") == (False, 0.75)
    for text, label in (("SPDX-License-Identifier: MIT", "mit"), ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
                        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                         "Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3"),
                        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                         "copyright notice and this permission notice appear in all copies.", "isc")):
        assert licenses.scan(text)[5:] == (label, 1.0)
    near = licenses.scan("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted to you")
    assert near[5] == "" and 0.25 <= near[6] < 0.5


def test_quality_on_held_out_documents(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        good = i % 2
        pool = ["reason", "because", "measured", "result", "study"] if good else ["buy", "click", "!!!", "cheap", "now"]
        rows.append((i, " ".join(rng.choice(pool + ["the", "of", "and"]) for _ in range(rng.randrange(5, 60))), None, None))
        labels.append((i, good))
    got = quality.score(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and np.mean([(r.predicted == r.doc_id % 2) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_language_on_held_out_documents(spark):
    rng = random.Random(8)
    pools = {"en": "the and of to in that with", "de": "der die und nicht auch mit sich", "fr": "les des que dans pour avec est", "es": "los las que para con por una"}
    rows = [(i, " ".join(rng.choice(pools[lang].split()) for _ in range(20)), lang, None) for i in range(400) for lang in [list(pools)[i % 4]]]
    got = {r.doc_id: r for r in langid.identify(docs(spark, rows)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 50 and sum(got[i].lang_pred == lang for i, _, lang, _ in held) >= 0.98 * len(held)


def test_field_learns_and_skips_matter(spark):
    rng = random.Random(9)
    # Phones are confirmed by a plus sign; bare runs of ten digits are order numbers.
    rows = [(i, f"call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} or order {rng.randrange(10 ** 9, 10 ** 10)}", None, None) for i in range(200)]
    # Some numbers come again without their marks.
    rows += [(i, f"call +1 ({i}) 555-1234 " + "word " * 50 + f"or {i}5551234", None, None) for i in range(300, 400)]
    model = pii.train(docs(spark, rows))
    assert not np.allclose(model[0], pii.PRIOR)
    assert [k for k, *_ in pii.spans_of("ring (743) 555-3824 today", model)[1]] == ["phone"]
    assert pii.spans_of("order 1234567890 today", model) == ([], [])
    # A distant repeat of a confirmed number changes the label; without skip edges it does not.
    text = "+1 (743) 555-3824 " + "word " * 200 + "order 7435553824 x"
    base = pii.base_spans(text)
    assert [text[s:e] for _, s, e in pii.crf_spans(text, base, model)] == ["7435553824"] and pii.crf_spans(text, base, model, skips=False) == []
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, [*rows, (900, text, None, None), (901, "Date 2024-01-15 10:30:00", None, None)])).collect()}
    assert got[900].spans.count("phone") == 2 and got[901].spans == ""


def test_base_spans_against_plain_patterns():
    rng = random.Random(10)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "+1 (743) 555-3824", "4111 1111 1111 1111", "4111", "-", " ", "x", "+", "(", "é", "a.b%c@d-e.f", "0000.1.1.1"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m.group())
            if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert pii.base_spans(text) == want, text


def test_graph_search_visits_few_nodes_and_needs_its_graph():
    import pandas as pd
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = pd.DataFrame({"dim": 32, "shard": 0, "idx": range(len(x)), "embedding": x.tolist()})
    lists = neighbours._started(frame)["nbr"].tolist()
    for _ in range(neighbours.ROUNDS):
        offsets, targets = neighbours._links(lists, len(x))
        cand = [np.unique(np.concatenate([targets[a:b], *[lists[j] for j in targets[a:b]]])) for a, b in zip(offsets, offsets[1:])]
        lists = neighbours._kept(frame.assign(cand=cand))["nbr"].tolist()
    queries = x[:200].astype(float)
    order = np.argsort(-(queries @ x.T.astype(float)), axis=1)[:, :20]
    drawn = rng.integers(0, len(x), (len(x), neighbours.DEGREE)).tolist()
    recall = {}
    for name, graph in (("built", lists), ("drawn", drawn)):
        r, c, s, visited = neighbours.walk(x.astype(float), neighbours._links(graph, len(x)), queries)
        recall[name] = np.mean([len(set(c[r == i][:20]) & set(order[i])) / 20 for i in range(200)])
        if name == "built":
            assert visited / 200 < 0.35 * len(x)
    assert recall["built"] >= 0.9 and recall["drawn"] < 0.7
