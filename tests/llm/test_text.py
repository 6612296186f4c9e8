"""Operators whose work is within a row or a process: tokenizers, signatures, filters, models."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelog.llm import ann, bag_minhash, bloom, byte_bpe, lang_crf, line_dedup, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def multi():
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.Codec(byte_bpe.serialise(ranks), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tabcdeé中🤦\x00\x1c\x85▁<>|")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_ids_are_tiktokens(multi, text):
    codec, reference = multi
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_and_special_texts(multi):
    codec, reference = multi
    for text in ("", "x" * 5000, "ab" * 20000, " " * 3000, "<unk> <s> ▁▁a", "日本語テキスト" * 50, "é\n\n\n  x\r\n"):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_memory_of_ids_is_bounded(multi, monkeypatch):
    codec, reference = multi
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    for i in range(20):
        text = f"word{i} other{i * 7} zz{i}"
        assert codec.encode(text) == reference.encode_ordinary(text)
        assert len(codec.known) <= 10 + 40


def test_serialise_wants_every_byte():
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0})


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_against_tokens_one_by_one(rule):
    ranks = token_counts.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("", "\n", "a\n\n\n b\nçé 中文\n", "one two\n\n\n\nthree", "x\n" * 50):
        raw = text.encode()
        starts = token_counts.line_starts(np.frombuffer(raw, np.uint8))
        sizes = [len(encoding.decode_single_token_bytes(i)) for i in encoding.encode_ordinary(text)]
        got = token_counts.attribute(np.cumsum(np.array(sizes, np.int64)), starts, len(raw), rule)
        expected, at, edges = [0.0] * len(starts), 0, [*starts, len(raw)]
        for n in sizes:
            for b in range(at, at + n):
                k = max(i for i in range(len(starts)) if edges[i] <= b)
                if rule == "share" or rule == "start" and b == at or rule == "end" and b == at + n - 1:
                    expected[k] += 1 / n if rule == "share" else 1
            at += n
        assert np.allclose(got, expected)
        assert math.isclose(sum(got), len(sizes), abs_tol=1e-9)


# BagMinHash


def weighted(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    keys = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    bags = [{int(k): int(rng.integers(1, 9)) for k in rng.choice(keys, 45, replace=False)} for _ in range(12)]
    doc = np.concatenate([[i] * len(b) for i, b in enumerate(bags)])
    value, weight = np.array([k for b in bags for k in b], np.uint64), np.array([w for b in bags for w in b.values()])
    m = 4096
    registers = bag_minhash.signatures(doc, value, weight, len(bags), m)
    errors = [(registers[i] == registers[j]).mean() - weighted(bags[i], bags[j]) for i in range(12) for j in range(i)]
    assert abs(np.mean(errors)) < 0.01 and max(map(abs, errors)) < 5 * 0.5 / math.sqrt(m)


def test_signature_of_a_row_does_not_depend_on_its_batch():
    texts = [" ".join(random.Random(i).choices("abcdefghij", k=n)) for i, n in enumerate((1, 3, 5, 40, 400))]
    whole = bag_minhash.signatures(*bag_minhash.shingles(texts), len(texts))
    for i, t in enumerate(texts):
        assert (bag_minhash.signatures(*bag_minhash.shingles([t]), 1)[0] == whole[i]).all()


def test_shingles_and_tags():
    doc, value, weight = bag_minhash.shingles(["a b c d e a b c d e", "", "x y", "a b c d e"])
    assert np.bincount(doc, weight, 4).tolist() == [6, 0, 1, 1]
    assert set(value[doc == 3]) < set(value[doc == 0])
    assert len(set(bag_minhash.tagged(value, weight).tolist())) == 7


# line filters


def test_twice_seen_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 400, 150).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(6)]
    filters = []
    for p in parts:
        f = line_dedup.Filters(1 << 14)
        f.add(np.unique(p))  # once a document
        filters.append((f.once.tobytes(), f.twice.tobytes()))
    _, twice = line_dedup.merge(iter(filters))
    every, counts = np.unique(np.concatenate([np.unique(p) for p in parts]), return_counts=True)
    seen = bloom.has(np.frombuffer(twice, np.uint8), bloom.positions(every, 1 << 14))
    assert seen[counts > 1].all() and seen[counts == 1].mean() < 0.2


# models


def test_toxicity_learns_words_from_documents_and_finds_sentences():
    rng = random.Random(0)
    plain = ["".join(rng.choices("aeioulmnrst", k=5)) for _ in range(300)]
    sentence = lambda: " ".join(rng.choices(plain, k=8)) + "."

    def document(toxic):
        parts = [sentence() for _ in range(10)]
        if toxic:
            parts[rng.randrange(10)] = f"{sentence()[:-1]} {rng.choice(['grobbly', 'snarfing', 'snarfed'])} end."
        return " ".join(parts)

    rows = [(document(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    scorer = toxicity.Scorer(toxicity.fit(rows[:300]))
    assert all((scorer.document(t)[0] >= 0.5) == y for t, y in rows[300:])
    text = f"{sentence()} You {plain[0]} grobbly {plain[1]}! {sentence()}"
    score, found = scorer.document(text)
    assert score >= 0.5 and [text[a:b].strip() for a, b, _ in found] == [f"You {plain[0]} grobbly {plain[1]}"]
    assert scorer.document("") == (0.0, []) and scorer.document("123 ...") == (0.0, [])
    assert toxicity.Scorer(toxicity.fit([("a", 0)])).document("a b")[0] < 1e-9
    assert toxicity.Scorer(toxicity.fit([])).document("a b")[0] < 1e-9


def test_toxicity_does_not_grow_with_clean_length():
    rng = random.Random(1)
    plain = ["".join(rng.choices("aeioulmnrst", k=5)) for _ in range(300)]
    text = lambda n, *more: ". ".join([" ".join(rng.choices(plain, k=8)) for _ in range(n)] + list(more))
    rows = [(text(10, *["a grobbly end"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(300)]
    scorer = toxicity.Scorer(toxicity.fit(rows))
    assert scorer.document(text(10_000))[0] < 0.5 <= scorer.document(text(10_000, "a grobbly end"))[0]
    assert scorer.document("abc. " * 1_000_000)[0] == 0


def test_forward_backward_against_all_sequences():
    rng = np.random.default_rng(2)
    emission, transition = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    word, pair, log_z = lang_crf.forward_backward(emission, transition, np.array([4]))
    paths = np.stack(np.meshgrid(*[range(3)] * 4, indexing="ij"), -1).reshape(-1, 4)
    score = np.array([sum(emission[0, i, y] for i, y in enumerate(p)) + sum(transition[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
    p = np.exp(score - np.logaddexp.reduce(score))
    assert np.allclose(word[0], [[p[paths[:, i] == y].sum() for y in range(3)] for i in range(4)])
    assert np.allclose(pair, [[sum(p[(paths[:, i] == a) & (paths[:, i + 1] == b)].sum() for i in range(3)) for b in range(3)] for a in range(3)])
    assert np.allclose(log_z, np.logaddexp.reduce(score))


def test_language_tags_words_in_mixed_text():
    rng = random.Random(0)
    alphabets = {"xx": "abcde", "yy": "klmno"}
    words = {y: ["".join(rng.choices(a, k=rng.randint(2, 6))) for _ in range(200)] for y, a in alphabets.items()}
    rows = [(" ".join(rng.choices(words[y], k=30)), y) for y in words for _ in range(40)]
    tagger = lang_crf.Tagger(lang_crf.fit(rows))
    mixed = [*rng.choices(words["xx"], k=10), *rng.choices(words["yy"], k=4)]
    ((_, posterior),) = tagger.words([" ".join(mixed)])
    assert [tagger.languages[i] for i in posterior.argmax(axis=1)] == ["xx"] * 10 + ["yy"] * 4
    assert tagger.documents([" ".join(mixed), "", "12 !", "Æ" * 100])[:3][0][0] == "xx"
    assert tagger.documents(["", "12 !"]) == [("und", 0.0)] * 2
    assert lang_crf.Tagger(lang_crf.fit([])).documents(["abc"]) == [("und", 0.0)]


def test_forest_search_reaches_every_leaf():
    x = np.random.default_rng(0).normal(size=(500, 8))
    forest = ann.Forest(x, trees=3, leaf=20)
    assert len(forest.search(x[0], 3.0)) == sum(len(t.share) for t in forest.trees)
    found = forest.search(x[7], 0.1)
    assert all((i, int(t.leaves(x[7:8])[0])) in found for i, t in enumerate(forest.trees))
    same = ann.Forest(np.ones((100, 4)), trees=2, leaf=10)
    assert len(same.search(np.ones(4), 1.0)) == 2


def test_pattern_of_lines():
    assert line_dedup.line_key(" \tAbcÉ\x0b", 4) == "abcÉ".encode() and line_dedup.line_key("abc", 4) is None
