"""The pipeline, stage by stage, against the operators' brute-force counterparts."""

import random

import corpus_pipeline
from test_brute_force import components, words_of

from cellweave.llm.common import materialize


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    r = random.Random(3)
    texts = []
    for i in range(60):
        words = [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice('aeiou')}" for _ in range(90)]
        texts.append("\n".join(" ".join(words[k : k + 30]) for k in (0, 30, 60)))
    texts[7] = texts[3]
    texts[8] = texts[4].replace("\n", " ")
    texts[9] = texts[5] + "\n" + "unseen words follow here " + " ".join(f"tail{k}" for k in range(4))
    rows = [(i, t, "en", r.choice("ab"), len(t or "")) for i, t in enumerate([*texts, None, "", "short"])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "test")
        made[name] = docs
    names = list(made)
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    for name in names[:-1]:
        assert made[name].columns == table.columns
    good = {d["doc_id"]: d["text"] for d in made["quality rules"].collect()}
    assert 62 not in good and len(good) >= 55
    seen, want = set(), {}
    for i in sorted(good):
        kept = [x for x in good[i].split("\n") if x not in seen]
        seen |= set(good[i].split("\n"))
        if kept:
            want[i] = "\n".join(kept)
    deduped = {d["doc_id"]: d["text"] for d in made["line dedup"].collect()}
    assert deduped == want
    ids = sorted(deduped)
    label = {c for _, _, c in components([deduped[i] for i in ids], 5, 80)}
    assert {d["doc_id"] for d in made["n-gram Jaccard join"].collect()} == {ids[c] for c in label}
    mixed = made["mixing"].collect()
    assert {d["doc_id"] for d in mixed} <= {ids[c] for c in label} and all(set(words_of(d["text"])) <= set(words_of(deduped[d["doc_id"]])) for d in mixed)
    packed = made["packing"].collect()
    assert all(p["length"] & (p["length"] - 1) == 0 and p["offset"] == 0 for p in packed) and {p["doc_id"] for p in packed} == {d["doc_id"] for d in mixed}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
