import random
from collections import Counter

import corpus
import numpy as np
import pytest
import zstandard

from foreshock.llm import base, repeats


def plain(texts, length):
    """(kept bytes, removed runs) of every text, from counts of all its strings."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, int)
        for p in range(len(r) - length + 1):
            if count[r[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(r) else 0
        out.append((bytes(np.frombuffer(r, np.uint8)[~gone]), runs))
    return out


@pytest.mark.parametrize("seed", [3, 8])
def test_removal_is_exact(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "RUN_ROWS", 90)
    monkeypatch.setattr(repeats, "MERGE_ROWS", 300)
    texts = corpus.texts(seed, 45)
    rows = [*enumerate(texts), (7, texts[7]), (8, corpus.prose(random.Random(1), 60)), (None, texts[9]), (None, texts[9])]
    got = repeats.remove_repeats(corpus.frame(spark, rows)).collect()
    expected = plain([t for _, t in rows], 200)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    mine = sorted([(r["doc_id"], r["text"], bytes(r["kept"]), r["n_spans"], r["n_removed"]) for r in got], key=key)
    other = sorted([(i, t, k, n, len((t or "").encode()) - len(k)) for (i, t), (k, n) in zip(rows, expected, strict=True)], key=key)
    assert mine == other


def test_long_text_in_several_rounds(monkeypatch):
    """Windows at the border of two rounds lose nothing."""
    rng = random.Random(4)
    text = corpus.prose(rng, 400).encode()
    buf, at = np.frombuffer(text * 2, np.uint8), np.array([0, 2 * len(text)])
    whole = repeats.anchors(buf, at, 200)
    monkeypatch.setattr(repeats, "ROUND", 777)
    cut = repeats.anchors(buf, at, 200)
    covered = lambda x: sorted((p, int(a)) for f, m, a in zip(x[1], x[2], x[4], strict=True) for p in range(f, f + m + 1))
    assert covered(whole) == covered(cut)
    assert [p for p, _ in covered(whole)] == list(range(len(buf) - 199))


@pytest.mark.parametrize("n_runs", [1, 2, 3, 7])
def test_loser_tree_merges_and_knows_shares(n_runs):
    rng = random.Random(n_runs)
    width = 24
    runs, every = [], []
    for _ in range(n_runs):
        entries = sorted({bytes(rng.choice(b"ab") for _ in range(width)) if rng.random() < 0.5 else bytes([97] * 20) + bytes(rng.choice(b"ab") for _ in range(4)) for _ in range(60)})
        rows = np.frombuffer(b"".join(entries), np.uint8).reshape(-1, width)
        share = np.array([0, *[next((k for k in range(width) if a[k] != b[k]), width) for a, b in zip(entries, entries[1:], strict=False)]])
        runs.append(repeats.front_code(rows, share))
        every.append(entries)
    got = [(every[r][e], k) for r, e, k in repeats.merge_runs(runs, width)]
    assert [x for x, _ in got] == sorted(x for e in every for x in e)
    for (a, _), (b, k) in zip(got, got[1:], strict=False):
        assert k == next((i for i in range(width) if a[i] != b[i]), width)


def test_cut_characters_are_dropped_from_text(spark):
    passage = "é" * 150
    rows = [(1, "x" + passage + "yz"), (2, passage + "end")]
    got = {r["doc_id"]: r["kept"] for r in repeats.remove_repeats(corpus.frame(spark, rows), 201, as_text=True).collect()}
    assert got[1] in ("xyz", "xéyz") and "end" in got[2]


def test_edges_of_one_passage_are_merged_by_several_tasks(spark, monkeypatch):
    """Every text has other bytes around the passage, so all suffixes across its ends belong to few anchors and blocks."""
    monkeypatch.setattr(repeats, "RUN_ROWS", 200)
    monkeypatch.setattr(repeats, "MERGE_ROWS", 100)
    rng = random.Random(6)
    passage = corpus.prose(rng, 40)
    texts = [corpus.prose(rng, 12) + passage + corpus.prose(rng, 12) for _ in range(120)]
    sizes, merge = Counter(), repeats._merge

    def watched(runs, length):
        for r in runs.where("share is not null").collect():
            sizes[r["part"]] += len(zstandard.ZstdDecompressor().decompress(r["share"]))
        return merge(runs, length)

    monkeypatch.setattr(repeats, "_merge", watched)
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(corpus.frame(spark, enumerate(texts))).collect()}
    assert got == {i: k for i, (k, _) in enumerate(plain(texts, 200))}
    assert max(sizes.values()) <= 4 * repeats.MERGE_ROWS < sum(sizes.values()) / 3, sizes


def test_rows_without_id_and_with_equal_short_hashes(spark):
    """Texts that a 32-bit hash takes for one stay apart, with and without an id; what occurs once stays."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(256))
    many = spark.createDataFrame([(text(),) for _ in range(200_000)], "text string").select("text", F.hash("text").alias("h"))
    pair = many.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()
    assert pair is not None
    a, b = pair["t"][:2]
    for ids in ((None, None, 1), (5, 5, 6), (5, 6, 7)):
        d = corpus.frame(spark, [(ids[0], a), (ids[1], b), (ids[2], a)])
        got = [(r["text"], r["n_removed"]) for r in repeats.remove_repeats(d).collect()]
        assert sorted(got) == sorted([(a, 256), (b, 0), (a, 256)])


def test_spans_of_equal_rows_do_not_add_up(spark):
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(80))[:256]
    d = corpus.frame(spark, [(None, text)] * 120 + [(3, text)])
    spans = repeats.repeated_spans(d).collect()
    assert len(spans) == 2 and all(len(r["spans"]) <= 256 for r in spans)
    few = {len(r["spans"]) for r in repeats.repeated_spans(corpus.frame(spark, [(None, text)] * 3 + [(3, text)])).collect()}
    assert {len(r["spans"]) for r in spans} == few


def test_what_many_documents_hold_is_looked_at_once(spark, monkeypatch):
    rng = random.Random(4)
    line, passage = corpus.prose(rng, 9) + "\n", corpus.prose(rng, 300)
    # A line written many times, differently often; a long passage at different distances from the text's start; equal rows.
    texts = [corpus.prose(rng, 5 + i % 7) + " " + line * (9 + i % 4) + corpus.prose(rng, 8) + " " + passage + corpus.prose(rng, 4) for i in range(40)]
    data = [*enumerate(texts), (3, texts[3]), (None, texts[5]), (None, texts[5])]
    kept = {}

    def stored(df, name):
        kept[name] = table = base.stored(df, name)
        return table

    monkeypatch.setattr(repeats, "stored", stored)
    got = {(r["doc_id"], r["text"]): (bytes(r["kept"]), r["n_spans"]) for r in repeats.remove_repeats(corpus.frame(spark, data)).collect()}
    for (i, t), expected in zip(data, plain([t for _, t in data], 200), strict=True):
        assert got[i, t] == expected
    mixed, single = kept["stretches"].where("mixed"), kept["unlike-stretches"]
    assert single.agg({"n": "sum"}).first()[0] == mixed.count()
    assert 2 * single.count() < mixed.count()
    most = [d.groupBy("anchor", "content").count().agg({"count": "max"}).first()[0] for d in (single, mixed)]
    assert 3 * most[0] < most[1], most
