import random
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
from tokenizers import Tokenizer

from foreshock.llm import packing, queries




def lay_out(counts, capacity):
    runs = packing.plan(dict(counts), capacity)
    placed = defaultdict(list)
    for n, c in counts.items():
        mine = [r for r in runs if r[0] == n]
        for rank in range(c):
            r = [r for r in mine if r[1] <= rank][-1]
            ahead = rank - r[1]
            placed[r[2] + ahead // r[3]].append((r[4] + n * (ahead % r[3]), n))
    return placed


def test_plan_fills_without_gaps_or_overlaps():
    rng = random.Random(1)
    for _ in range(30):
        capacity = rng.choice([30, 100, 101])
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 200)))
        placed = lay_out(counts, capacity)
        assert Counter(n for s in placed.values() for _, n in s) == counts
        for s in placed.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= capacity


def test_long_pieces_make_as_many_pairs_as_can_be():
    def most_pairs(items, capacity):
        if len(items) < 2:
            return 0
        a, rest = items[0], items[1:]
        return max([most_pairs(rest, capacity), *(1 + most_pairs(rest[:i] + rest[i + 1 :], capacity) for i, b in enumerate(rest) if a + b <= capacity)])

    rng = random.Random(2)
    for _ in range(60):
        items = [rng.randrange(35, 101) for _ in range(rng.randrange(1, 9))]
        assert len(lay_out(Counter(items), 100)) == len(items) - most_pairs(items, 100)


def test_short_pieces_reach_the_bound():
    rng = random.Random(3)
    counts = Counter(rng.randrange(1, 600) for _ in range(5000))
    total = sum(n * c for n, c in counts.items())
    assert len(lay_out(counts, 2048)) <= -(-total // 2048) + 1


def test_pieces_match_the_tokenizer(spark):
    texts = ["Hello, world. İ x", "a" * 9000 + " b", None, "it's 12 l'été <|endoftext|> ... ,.", "x\ty z w\x1cv", *corpus.texts(n=8)]
    got = packing.pack(corpus.frame(spark, list(enumerate(texts))), queries.WORD_TOKENIZER, 64, with_ids=True).collect()
    tok = Tokenizer.from_file(queries.WORD_TOKENIZER)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), 64))
        assert b"".join(bytes(r["ids"]) for r in parts) == np.array(ids, "<u4").tobytes()
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 64


def test_words_with_marks_are_learned_with_others():
    class Spy:
        def __init__(self, inner):
            self.inner, self.calls = inner, []

        def encode_batch_fast(self, texts, **options):
            self.calls.append(list(texts))
            return self.inner.encode_batch_fast(texts, **options)

    tok = packing.WordTokenizer(queries.WORD_TOKENIZER)
    tok.tokenizer = spy = Spy(plain := tok.tokenizer)
    texts = ["alphen betous$$$ gammel!!", None, "betous gammel, alphen?", " ", "l'été. abc<|endoftext|>\nisn't é.. 日本。 ʰx!"]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tok.encode(texts[:4]) == want[:4]
    assert sorted(sum(spy.calls, [])) == sorted(["alphen betous gammel", "$$$", "!!", ",", "?"])
    assert tok.encode(texts) == want
    spy.calls.clear()
    assert tok.encode(texts) == want and not spy.calls
    tok.known, tok.before = {"": b""}, tok.known
    assert tok.encode(texts) == want and not spy.calls


def test_distinct_chunks_become_strings_in_one_call_and_are_encoded_in_short_ones(monkeypatch):
    class Whole:
        """An array that does not give its values one by one."""

        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            assert name not in ("to_pylist", "__iter__")
            found = getattr(self.inner, name)
            if name in ("flatten", "dictionary_encode"):
                return lambda: Whole(found())
            return Whole(found) if name == "dictionary" else found

    split = packing.pc.split_pattern
    monkeypatch.setattr(packing.pc, "split_pattern", lambda *a: Whole(split(*a)))
    tok = packing.WordTokenizer(queries.WORD_TOKENIZER)
    plain, calls = tok.tokenizer, []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            calls.append(texts)
            return plain.encode_batch_fast(texts, **options)

    tok.tokenizer = Spy()
    words = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in ("l", "mut", "n\u00e9", "rst", "\u00fc", "x", "z")]
    text = " ".join(words)
    assert tok.encode([text, None]) == [np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), b""]
    assert len(words) == 210 and sorted(len(t.split()) for call in calls for t in call) == [10, 100, 100]
