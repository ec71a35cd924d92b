import random
import zlib

import corpus
import numpy as np
import pyarrow as pa
import pytest

from foreshock.llm import fingerprints, host_rules, language, neighbours, toxicity

SYLLABLES = {"en": ["the", "ing", "sh", "wh", "and"], "de": ["sch", "ung", "ö", "der", "ich"], "fr": ["eau", "é", "ç", "les", "oui"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def held(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 7, 20):
        c = language.codewords(k)
        assert len(np.unique(c, axis=0)) == k and (abs(c.sum(0)) < k).all()
        gaps = [(a != b).sum() for i, a in enumerate(c) for b in c[:i]]
        assert min(gaps) >= (1 if k == 2 else 2)


def test_languages_held_out(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang := list(SYLLABLES)[i % 3], rng.randrange(5, 60)), lang if i % 11 else None, "s", 1) for i in range(300)]
    rows += [(900, None, "en", "s", 1), (901, "12 34", "en", "s", 1), (902, "", "fr", "s", 1)]
    got = {r["doc_id"]: r for r in language.identify_held_out(spark.createDataFrame(rows, corpus.DOCUMENTS)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["ambiguous"] for i in (900, 901, 902))
    tested = [i for i in range(300) if held(i, 3, 1)]
    assert all(got[i]["held_out"] == held(i, 3, 1) for i in range(300))
    assert np.mean([got[i]["lang_pred"] == list(SYLLABLES)[i % 3] for i in tested]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize(
    "text, folded",
    [("Idiot!", " idiot "), ("1d10t", " idiot "), ("іdіоt", " idiot "), ("$tupid a$$", " stupid a "), ("i​diot", " idiot "), ("ＩＤＩＯＴ", " idiot "), ("", " "), ("wow!! | 12", " wow 12 "), ("drein$$$ é", " drein é ")],
)
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_lexicon_hits_exceptions_and_length():
    lexicon = toxicity.Lexicon({"trash ": 3.0, "lowei": 2.0}, ["trash can"], 2.0, -2.0)
    assert lexicon.strength(toxicity.fold("a trash talk"))[1] == 1
    assert lexicon.strength(toxicity.fold("the trash can"))[1] == 0
    assert lexicon.strength(toxicity.fold("trashy"))[1] == 0
    assert lexicon.strength(toxicity.fold("Loweischaft und lowei"))[1] == 2
    short, long = (lexicon.strength(toxicity.fold("trash" + " word" * n))[0] for n in (1, 500))
    assert short > long > 0
    assert toxicity.Lexicon().score(0.0) < 0.1


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    bad = ["scum", "idiot", "l0ser"]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        t = prose(rng, "en", 40).split()
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    got = {r["doc_id"]: r for r in toxicity.score_held_out(corpus.frame(spark, [*rows, (900, None)]), corpus.labels(spark, labels)).collect()}
    tested = [i for i in range(500) if held(i, 3, 1)]
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in tested)
    assert got[900]["predicted"] == 0


def test_copies_of_one_text_make_no_entries(spark):
    rng = random.Random(4)
    copied = prose(rng, "de", 30)
    rows = [(i, copied if i % 2 else prose(rng, "en", 30)) for i in range(200)]
    lexicon = toxicity.learn(corpus.frame(spark, rows), corpus.labels(spark, [(i, 1, i % 2) for i in range(200)]).select("doc_id", "toxic"))
    assert not lexicon.weights


def test_quality_held_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        t = prose(rng, "en", 30)
        kind = i % 6
        rows.append((i, t.upper().replace(" ", "!! ") if kind == 0 else "the " * 80 if kind == 1 else t))
        labels.append((i, int(kind > 1), 0))
    got = {r["doc_id"]: r for r in neighbours.classify_held_out(corpus.frame(spark, [*rows, (900, None)]), corpus.labels(spark, labels)).collect()}
    tested = [i for i in range(300) if held(i, 5, 0)]
    assert np.mean([got[i]["predicted"] == int(i % 6 > 1) for i in tested]) >= 0.95
    assert 0 <= got[900]["score"] <= 1


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(1)
    x = rng.poisson(1.0, (80, neighbours.DIMS + 3)).astype(np.float32)
    x[:, neighbours.DIMS :] = 0
    m = neighbours.fit(x, (np.arange(80) % 3 > 0).astype(int), 0.6)
    q = m.project(x[:7])
    full = q @ m.vectors.T
    for i, s in enumerate(m.score(x[:7])):
        top = np.argsort(-full[i])[: neighbours.K]
        w = np.maximum(full[i][top], 0) ** 4
        assert np.isclose(s, (w * m.label[top]).sum() / w.sum(), atol=1e-5)


def shingle_set(t):
    w = [x.lower() for x in t.split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_fingerprints_estimate_likeness(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 7)
    rng = random.Random(6)
    ids = rng.sample(range(10_000), 60)
    rows = [(i, prose(rng, "en", rng.randrange(60, 300))) for i in ids] + [(10_001, ""), (10_002, None), (10_003, "two words")]
    got = {r["doc_id"]: r for r in fingerprints.compare(corpus.frame(spark, rows)).collect()}
    order = sorted(rows)
    errors = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b = shingle_set(t), shingle_set(edited)
        assert got[i]["n_chars"] == len(t)
        errors.append(got[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1))
    assert len(got) == len(rows) and abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.15


def test_bias_correction_without_overlap():
    rng = random.Random(7)
    a, b = ([prose(rng, lang, 400) for _ in range(20)] for lang in ("en", "de"))
    near = fingerprints.likeness(fingerprints.fingerprints(pa.array(a)), fingerprints.fingerprints(pa.array(b)))
    assert near.mean() < 0.01
    same = fingerprints.fingerprints(pa.array([a[0], a[0], "", None, "x"]))
    assert (same[0] == same[1]).all() and fingerprints.likeness(same[2:3], same[3:4])[0] == 1 and fingerprints.likeness(same[2:3], same[4:5])[0] == 0


def plain_rules(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p for s in seen.values() if len(s) > 1 for i in s for p in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_match_plain_counts(spark):
    texts = [*corpus.texts(5), "a\nb\na\n \n\nb", "# * $$ | <x>", "one two three four five " * 3, "x y z\x0bw\x1cv é😀"]
    got = {r["doc_id"]: r for r in host_rules.judge(corpus.frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        expected = plain_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "short" if i % 10 else good, "en", "bad", 1) for i in range(100)]
    rows += [(1000 + i, good if i % 20 else "short", "en", f"h{i % 7}", 1) for i in range(400)]
    rows += [(5000, "short", "en", "tiny", 1), (5001, good, "en", None, 1)]
    got = {r["doc_id"]: r for r in host_rules.judge(spark.createDataFrame(rows, corpus.DOCUMENTS)).collect()}
    assert not any(got[i]["kept"] for i in range(100))
    assert all(got[1000 + i]["kept"] == bool(i % 20) for i in range(400))
    assert got[5000]["host_rate"] < 1 and got[5001]["kept"]


def test_rules_run_no_python(spark):
    plan = host_rules.document_rules(corpus.frame(spark, [(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
