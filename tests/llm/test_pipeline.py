"""The stages over a small corpus, each against a plain version of its decision."""

import random
from collections import Counter

import corpus
from test_partenum import plain
from test_repeats import plain as plain_repeats

import corpus_pipeline
from foreshock.llm import neighbours, toxicity
from foreshock.llm.base import stored


def write(spark, folder):
    rng = random.Random(11)
    passage = corpus.prose(rng, 60)
    rows, labels = [], []
    for i in range(240):
        t = corpus.prose(rng, 45)
        if i % 8 == 0:
            words = t.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot", "loser"]))
            t = " ".join(words)
        elif i % 8 == 1:
            t = t.upper().replace(" ", "!! ")
        elif i % 8 == 2:
            t = t[:150] + " " + passage + " " + t[150:]
        elif i % 8 == 3 and i > 8:
            t = rows[i - 8 + (4 - i % 8)][1] + f" copy{i}"
        rows.append((i, t))
        labels.append((i, int(i % 8 != 1), int(i % 8 == 0)))
    rows += [(900, None), (901, "")]
    corpus.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    corpus.labels(spark, labels).write.parquet(f"{folder}/labels.parquet")


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    clean = stage["toxicity"](spark, docs, folder)
    lexicon = toxicity.learn_toxicity(docs, labels)
    assert clean.columns == docs.columns
    assert texts(clean) == {i: t for i, t in texts(docs).items() if lexicon.score(lexicon.strength(toxicity.fold(t))[0]) < 0.7}
    assert not any(i % 8 == 0 for i in texts(clean) if i < 900)

    good = stage["quality_classifier"](spark, clean, folder)
    voted = {r["doc_id"]: r["predicted"] for r in neighbours.classify(clean, neighbours.learn_quality(clean, labels)).collect()}
    assert texts(good) == {i: t for i, t in texts(clean).items() if voted[i]}
    assert not any(i % 8 == 1 for i in texts(good) if i < 900)

    single = stage["ngram_jaccard_join"](spark, good, folder)
    kept = {c for _, _, c in plain(sorted(texts(good).items()))}
    assert set(texts(single)) == kept and len(kept) < len(texts(good))

    cut = stage["suffix_array_dedup"](spark, single, folder)
    before = sorted(texts(single).items())
    expected = {i: None if t is None else k.decode(errors="ignore") for (i, t), (k, _) in zip(before, plain_repeats([t for _, t in before], 200), strict=True)}
    assert cut.columns == docs.columns and texts(cut) == expected
    assert any(len(expected[i] or "") < len(t or "") for i, t in before)

    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(expected)
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


def test_repeated_rows_and_null_ids_keep_one_text(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder)
    rng = random.Random(12)
    twice, nameless = corpus.prose(rng, 60), corpus.prose(rng, 60)
    rows = [(950, twice), (950, twice), (None, nameless), (None, nameless), (None, twice)]
    corpus.frame(spark, rows).write.mode("append").parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    docs = corpus.frame(spark, rows)
    cut = stage["suffix_array_dedup"](spark, stored(stage["ngram_jaccard_join"](spark, docs, folder), "single"), folder)
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in cut.collect())) == [(0, nameless), (950, twice)]
    got = [r for r in corpus_pipeline.run(spark, folder).collect() if r["doc_id"] in (950, None)]
    once = corpus_pipeline.pack(spark, corpus.frame(spark, [(950, twice), (None, nameless)]), folder).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter((r["doc_id"], r["length"]) for r in once)
