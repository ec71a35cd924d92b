import math
import os
import random
import re
import zlib
from collections import Counter

import corpus
import numpy as np
from pyspark.sql import functions as F

from foreshock.llm import base, katz
from foreshock.llm.text import text_bytes, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def rows(n=160):
    rng = random.Random(1)
    names = [f"w{i}" for i in range(60)]
    out = [(0, None), (1, ""), (2, "Never_SEEN here")]
    for i in range(3, n):
        k, t = rng.randrange(60), []
        for _ in range(rng.randrange(1, 60)):
            k = (k * 7 + rng.randrange(4)) % 60
            t.append(names[min(k, rng.randrange(60))].upper() if rng.random() < 0.1 else names[k])
        out.append((i, " ".join(t) + (f" rare{i}" if i % 3 == 0 else "")))
    return out


def token_list(t):
    return [*WORD.findall((t or "").encode().translate(LOW)), None]


def word_hash(w):
    if w is None:
        return katz.END_HASH
    import pyarrow as pa

    return words(*text_bytes(pa.array([w.decode()])), True).hash[0]


def test_scores_match_a_plain_model_that_sums_to_one(spark, monkeypatch):
    monkeypatch.setattr(katz, "PART_BYTES", 3000)
    monkeypatch.setattr(katz, "HELD_KEYS", 200)
    data = rows()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data}
    train = [token_list(t) for i, t in data if not held[i]]
    count = Counter(w for t in train for w in t)
    total, distinct = sum(count.values()), len(count)
    least = min(c for c in count.values() if sum(x >= c for x in count.values()) <= 40)
    top = sorted((w for w in count if count[w] >= least), key=lambda w: (-count[w], int(np.uint64(word_hash(w)).view(np.int64))))
    number = {w: k for k, w in enumerate(top)}
    cls = lambda w: number.get(w, 40)
    pairs = Counter((p, cls(w)) for t in train for p, w in zip([41, *map(cls, t)], t, strict=False))

    often = lambda c: {r: sum(x == r for x in c.values()) for r in range(1, 7)}
    keep_w, keep_p = katz.discounts(often(count)), katz.discounts(often(pairs))
    less = lambda c, keep: c * (keep[c] if c <= 5 else 1)
    kept = sum(less(c, keep_w) for c in count.values())
    unknown = max(1 - kept / total, 1 / (total + distinct + 1))
    p_word = {w: (1 - unknown) * less(c, keep_w) / kept for w, c in count.items()}
    assert math.isclose(sum(p_word.values()) + unknown, 1)
    p_class = [p_word[w] for w in top]
    p_class += [0.0] * (40 - len(p_class))
    p_class.append(1 - sum(p_class))
    after = Counter()
    for (p, _), c in pairs.items():
        after[p] += c

    def chance(p, k):
        if not after[p]:
            return p_class[k]
        seen = {j: c for (q, j), c in pairs.items() if q == p}
        share = sum(less(c, keep_p) for c in seen.values()) / after[p]
        free = 1 - sum(p_class[j] for j in seen)
        scale = 1 / share if free < 1e-9 else min(1, after[p] / (after[p] + 1) / share)
        if k in seen:
            return scale * less(seen[k], keep_p) / after[p]
        return (1 - scale * share) / free * p_class[k]

    for p in range(42):
        assert math.isclose(sum(chance(p, k) for k in range(41)), 1, rel_tol=1e-9)
    got = {r["doc_id"]: r for r in katz.score_held_out(corpus.frame(spark, data), 40).collect()}
    for i, t in data:
        t = token_list(t)
        r = got[i]
        score = 0.0
        for p, w in zip([41, *map(cls, t)], t, strict=False):
            inside = 1 if cls(w) < 40 else p_word.get(w, unknown) / p_class[40]
            score += math.log10(chance(p, cls(w)) * inside)
        assert math.isclose(r["score"], score, rel_tol=1e-6), i
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(w in count for w in t), total)


def test_beats_single_words_on_texts_it_has_not_seen(spark):
    got = [r for r in katz.score_held_out(corpus.frame(spark, rows(400))).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_discounts_without_an_estimate():
    for n in ({}, {1: 5}, {1: 10, 2: 1}, {1: 3, 2: 9, 3: 20, 4: 1, 5: 2, 6: 90}):
        d = katz.discounts(n)
        assert ((d[1:] > 0) & (d[1:] < 1)).all()


def test_bigrams_of_more_words_than_a_shortlist_had_room_for(spark):
    """Nearly 100,000 words, each but the first hundred in one place of two texts alone: their bigrams count, too."""
    rng = random.Random(5)
    data = []
    for i in range(0, 1000, 2):
        t = [f"v{i * 1000 + k}" if k % 2 else f"v{rng.randrange(100)}" for k in range(400)]
        data += [(i, " ".join(t)), (i + 1, " ".join(t[rng.randrange(50) :]))]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data}
    train = [token_list(t) for i, t in data if not held[i]]
    count = Counter(w for t in train for w in t)
    total, distinct = sum(count.values()), len(count)
    assert distinct > 65_000
    pairs = Counter(p for t in train for p in zip([None, *t], t, strict=False))
    often = lambda c: Counter(c.values())
    keep_w, keep_p = katz.discounts(often(count)), katz.discounts(often(pairs))
    less = lambda c, keep: c * (keep[c] if c <= 5 else 1)
    kept = sum(less(c, keep_w) for c in count.values())
    unknown = max(1 - kept / total, 1 / (total + distinct + 1))
    p_word = {w: (1 - unknown) * less(c, keep_w) / kept for w, c in count.items()}
    after, seen, covered = Counter(), Counter(), Counter()
    for (p, w), c in pairs.items():
        after[p] += c
        seen[p] += less(c, keep_p)
        covered[p] += p_word[w]

    def chance(p, w):
        if not after[p]:
            return p_word.get(w, unknown)
        share = seen[p] / after[p]
        scale = min(1, after[p] / (after[p] + 1) / share)
        if (p, w) in pairs:
            return scale * less(pairs[p, w], keep_p) / after[p]
        return (1 - scale * share) / (1 - covered[p]) * p_word.get(w, unknown)

    for r in katz.score_held_out(corpus.frame(spark, data)).collect():
        t = token_list(data[r["doc_id"]][1])
        assert math.isclose(r["score"], sum(math.log10(chance(p, w)) for p, w in zip([None, *t], t, strict=False)), rel_tol=1e-6)


def test_tables_hold_no_keys_of_histories_nor_what_was_counted(spark, monkeypatch):
    kept = {}

    def stored(df, name):
        kept[name] = table = base.stored(df, name)
        return table

    monkeypatch.setattr(katz, "stored", stored)
    model = katz.fit(corpus.frame(spark, rows(60)).select("text"))
    histories = model.tables.where(F.col("kind") == katz.HISTORY)
    assert histories.count() and not histories.where("length(keys) > 0").count()
    assert not os.path.exists(kept["word-counts"]._stored_in.removeprefix("file:"))
    assert os.path.exists(kept["word-entries"]._stored_in.removeprefix("file:"))
