"""Large ids beside missing ones."""

import corpus

from foreshock.llm import exchange, forest, katz, partenum, periodic

LARGE = (1 << 60) + 1
ROWS = [(LARGE, "one two three four five six"), (LARGE + 2, "one two three four five six"), (None, "one two three four five six"), (7, "seven eight nine"), (None, None)]


def test_packed_ids_keep_every_bit():
    ids = [None, LARGE, -LARGE, 0, None, (1 << 63) - 1, -1 << 63]
    assert [None if v is None or v != v else int(v) for v in exchange.unpack_ids(exchange.pack_ids(ids)).tolist()[1:4]] == ids[1:4]
    got = exchange.unpack_ids(exchange.pack_ids(ids))
    assert [None if m else int(v) for v, m in zip(got._data, got._mask, strict=True)] == ids
    assert len(exchange.unpack_ids(exchange.pack_ids([]))) == 0


def test_results_carry_the_ids(spark):
    key = lambda v: (v is None, v or 0)
    want = sorted((i for i, _ in ROWS), key=key)
    d = corpus.frame(spark, ROWS).coalesce(1)
    near = partenum.near_duplicates(d).collect()
    assert sorted((r["doc_id"] for r in near), key=key) == want
    assert {r["doc_id"]: r["component_id"] for r in near} == {LARGE: LARGE, LARGE + 2: LARGE, 7: 7, None: None}
    assert sorted((r["doc_id"] for r in katz.score_held_out(d).collect()), key=key) == want
    assert sorted((r["doc_id"] for r in periodic.digests(d).collect()), key=key) == want


def test_vector_ids(spark):
    rows = [(LARGE, [1.0, 0.5]), (LARGE + 2, [1.0, 0.5]), (None, [1.0, 0.5]), (None, None)]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(LARGE, 2, LARGE, True), (LARGE + 2, 2, LARGE, False), (None, 2, None, False), (None, 0, None, False)], key=repr)
