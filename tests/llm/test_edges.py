"""Every operator over awkward rows and over none."""

import corpus
import pytest

from foreshock.llm import fingerprints, host_rules, katz, language, neighbours, packing, partenum, periodic, pieces, queries, repeats, toxicity

LABELS = [(1, 1, 0), (2, 0, None), (4, None, 1), (5, 1, 0), (7, 0, 1), (7, 1, 0), (None, 1, 1), (99, 0, 0), (9, 1, 1)]

OPERATORS = {
    "packing": lambda d, y: packing.pack(d, queries.WORD_TOKENIZER),
    "encode": lambda d, y: pieces.encode(d, queries.PIECE_MODEL),
    "digests": lambda d, y: pieces.digests(d, queries.PIECE_MODEL),
    "toxicity": toxicity.score_held_out,
    "language": lambda d, y: language.identify_held_out(d),
    "repeats": lambda d, y: repeats.remove_repeats(d),
    "fingerprints": lambda d, y: fingerprints.compare(d),
    "rules": lambda d, y: host_rules.judge(d),
    "katz": lambda d, y: katz.score_held_out(d),
    "near": lambda d, y: partenum.near_duplicates(d),
    "periodic": lambda d, y: periodic.digests(d),
    "quality": neighbours.classify_held_out,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    d, y = corpus.awkward(spark), corpus.labels(spark, LABELS)
    got = OPERATORS[name](d, y).collect()
    per_row = [r for r in got if name != "packing" or r["piece"] == 0]
    assert len(per_row) == d.count()
    key = lambda v: (v is None, v or 0)
    assert sorted((r["doc_id"] for r in per_row), key=key) == sorted((r["doc_id"] for r in d.select("doc_id").collect()), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    d, y = corpus.awkward(spark).limit(0), corpus.labels(spark, [])
    assert OPERATORS[name](d, y).collect() == []
