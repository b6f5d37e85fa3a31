"""The pipeline's stages, one after the other, against plain versions on a table with repeated and missing ids and clashing columns."""
import corpus_pipeline
from ledgermill.llm import langid, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, row string"


def test_stages_against_plain_versions(spark, tmp_path, monkeypatch):
    passage = " ".join(f"exam{i}" for i in range(13))
    texts = [" ".join(f"the{i}x{j}" for j in range(40)) for i in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), 1, "r") for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s0", 9, 1, "r"), (None, texts[1], "en", "s1", 9, 1, "r"), (5, "other text of the id five " + texts[2][::-1], "en", "s2", 9, 1, "r"),
             (None, "no id but a text of its own, mail me at a@b.org", "en", "s0", 47, 1, "r"), (60, passage + " and more", "en", "s1", 9, 1, "r"),
             (61, "12 34", "en", "s1", 9, 1, "r"), (62, None, "en", "s1", None, 1, "r"), (7, texts[7], "en", "s1", 9, 1, "r")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}

    def spied(name, stage):
        def spy(spark, docs, sf_dir):
            seen[name] = docs.collect()
            return stage(spark, docs, sf_dir)
        return name, spy

    monkeypatch.setattr(corpus_pipeline, "STAGES", [spied(*s) for s in corpus_pipeline.STAGES])
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()

    key = lambda r: (str(r.doc_id), str(r.text))
    names = [n for n, _ in corpus_pipeline.STAGES]
    outs = {n: seen[names[i + 1]] if i + 1 < len(names) else final for i, n in enumerate(names)}
    model = langid.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted(map(key, outs["language"])) == sorted(key(r) for r in seen["language"] if langid.predict(model, r.text)[0] != "und")
    # One row of each component: least id, nulls last.
    before = seen["near_dedup"]
    fps = [simhash.fingerprint(r.text) for r in before]
    forest = simhash.Forest()
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                forest.add(a, b)
    groups = {}
    for r, f in zip(before, fps):
        groups.setdefault(forest.root(f), []).append(r)
    kept = outs["near_dedup"]
    assert len(kept) == len(groups)
    for r in kept:
        ids = [x.doc_id for x in groups[forest.root(simhash.fingerprint(r.text))]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)
    assert sorted(map(key, outs["decontaminate"])) == sorted(key(r) for r in kept if r.doc_id != 60)
    field = pii.train(spark.createDataFrame(outs["decontaminate"], SCHEMA))
    assert sorted(map(key, outs["pii"])) == sorted((str(r.doc_id), str(pii.mask(r.text, field))) for r in outs["decontaminate"])
    assert any("<EMAIL>" in r.text and r.n_chars == len(r.text) for r in outs["pii"])
    # The mix takes 150 % of all words, to within a small document of each source, nobody more than twice.
    size = {key(r): len(r.text.split()) for r in outs["pii"]}
    assert set(map(key, final)) <= set(size) and all(1 <= r.copies_ <= 2 for r in final)
    taken = sum(r.copies_ * size[key(r)] for r in final)
    assert abs(taken - 1.5 * sum(size.values())) <= 3 * 41
    assert all(r.copies == 1 and r.row == "r" for r in final)
