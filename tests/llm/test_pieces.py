import random
import struct

import corpus
import numpy as np
import sentencepiece

from foreshock.llm import pieces, queries

ALPHABET = "aB, .\n'éß▁<>|\t́ \x1c\x00İΣ漢😀1$s"


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_ids_spans_and_text_match_the_library():
    c = pieces.codec(queries.PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    texts = [*fuzz(1500), "", " ", "  a  b ", "▁▁", "<s> </s>", *(t or "" for t in corpus.texts())]
    for t, (ids, first, end), ref in zip(texts, c.encode(texts), library.encode(texts, num_threads=1), strict=True):
        assert ids.tolist() == ref
        raw = t.encode()
        assert len(ids) == 0 or (first[0] == 0 and end[-1] == len(raw) and (first[1:] == end[:-1]).all())
        for i, a, b in zip(ids.tolist(), first, end, strict=True):
            piece = c.library.id_to_piece(i)
            if not c.library.is_byte(i) and a > 0:
                assert raw[a:b].decode() == piece.replace("▁", " ") or "▁" in t
    assert c.decode([x.tolist() for x, _, _ in c.encode(texts)]) == library.decode(library.encode(texts))


def test_longest_prefix_through_a_compiled_map():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    spec = {n: v for n, v, _, _ in pieces._fields(normalizer.serialized_model_proto())}[pieces.NORMALIZER]
    blob = {n: v for n, v, _, _ in pieces._fields(spec)}[pieces.CHARS_MAP]
    c = pieces.PieceCodec(queries.PIECE_MODEL)
    c.chars, c.remove_spaces = pieces.CharsMap.parse(blob), True
    for t in [*fuzz(400, 5), "ﬁne Ａ１ ① ㍿ é", "  two  spaces ", "　x y"]:
        text, source = c.normalize(t)
        assert text == normalizer.normalize(t), t
        assert len(source) == len(text.encode()) + 1
        assert (np.diff(source) >= 0).all() and source[-1] <= len(t.encode())


def test_trie_of_one_key():
    """A hand-made double array that maps 'ab' to 'x'."""
    units = [0] * 512
    units[0] = 256 << 10  # children at 256 ^ byte
    a = 256 ^ ord("a")
    units[a] = (128 << 10) | ord("a")
    b = a ^ 128 ^ ord("b")
    units[b] = (3 << 10) | 0x100 | ord("b")
    units[b ^ 3] = 0x80000000
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0"
    m = pieces.CharsMap.parse(blob)
    assert m.longest(b"zab", 1) == (2, 0)
    assert m.replacement(0) == b"x"
    assert m.longest(b"aab", 0)[0] == 0


def test_round_trip_in_spark(spark):
    texts = corpus.texts(n=10)
    got = {r["doc_id"]: r for r in pieces.encode(corpus.frame(spark, list(enumerate(texts))), queries.PIECE_MODEL).collect()}
    for i, t in enumerate(texts):
        assert got[i]["decoded"] == (t or "")
        assert got[i]["ids"][0] == 1 and got[i]["ids"][-1] == 2
        assert len(got[i]["ids"]) == len(got[i]["span_start"]) == len(got[i]["span_end"])
