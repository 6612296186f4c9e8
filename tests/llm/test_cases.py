"""Operators against direct computations, and cases that once went wrong or that they define themselves."""

import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelog.llm import ann, bag_minhash, bloom, byte_bpe, common, components, exact_dedup, lang_crf, line_dedup, mixing, queries, token_counts, toxicity, url_filter

tiktoken = pytest.importorskip("tiktoken")


# 1


def hosts_of(*counts):
    """(url, bad) rows: for (host, pages, bad pages)."""
    return [(f"http://{h}/p/{i}", int(i < b)) for h, n, b in counts for i in range(n)]


def test_hosts_worse_than_the_average_are_blocked(spark):
    seen = hosts_of(("bad.a.com", 60, 50), ("worse.a.com", 3, 3), ("fine.a.com", 60, 2), ("x.b.org", 200, 20), ("y.b.org", 200, 18), ("z.c.net", 80, 9))
    pages = [(i, u) for i, u in enumerate(["http://bad.a.com/1", "http://worse.a.com/2", "http://fine.a.com/3", "http://x.b.org/4", "http://unseen.b.org/5", "http://other.io/6", None])]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(seen, "url string, bad int")).collect()}
    assert [out[i].verdict for i in (0, 2, 3, 4, 5, 6)] == ["block", "allow", "allow", "allow", "allow", "allow"]
    assert out[0].bad_bound > out[0].bad_limit > out[2].bad_bound
    rate = sum(b for _, b in seen) + 0.5, len(seen) - sum(b for _, b in seen) + 0.5
    assert all(math.isclose(r.bad_limit, 1.25 * rate[0] / sum(rate)) for r in out.values())
    # few pages are pulled to the domain's rate, pages of no known host take the domain's, or all pages'
    mean = lambda r: r.bad_a / (r.bad_a + r.bad_b)
    assert mean(out[2]) < mean(out[1]) < 1 and math.isclose(mean(out[5]), rate[0] / sum(rate)) and mean(out[4]) < mean(out[5])
    # where hosts don't differ, none is blocked
    even = hosts_of(*((f"h{i}.d{i % 7}.com", 50, 25) for i in range(40)))
    judged = url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(even)], "page_id long, url string"), spark.createDataFrame(even, "url string, bad int"))
    assert {r.verdict for r in judged.collect()} == {"allow"}


def test_rules_as_a_table_decide_as_rules_in_an_expression(spark, monkeypatch):
    rng = random.Random(3)
    names, starts = ["com", "a.com", "b.a.com", "net", "c.net", "d.c.net"], ["/", "/x", "/x/", "/x/y", "/z"]
    rules = sorted({(rng.choice(["block", "allow"]), rng.choice(names) + rng.choice(starts)) for _ in range(20)}, key=lambda r: r[1])
    rules = list({text: (say, text) for say, text in rules}.values())
    urls = [f"http://{'q.' * rng.randrange(3)}{rng.choice(names)}{rng.choice(starts)}{rng.choice(['', 'x', '/y'])}" for _ in range(200)] + [None, "none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    seen = spark.createDataFrame([], "url string, bad int")
    shown = lambda: sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, seen, rules).fillna({"rule": "-"}).collect())
    by_expression = shown()
    monkeypatch.setattr(url_filter, "LITERAL_RULES", 0)
    assert shown() == by_expression and len({r[3] for r in by_expression}) > 5


def test_two_label_suffixes_are_a_parameter(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("a.b.gov.xx",), ("com",), ("",)], "h string")
    own = lambda two: [(r[0], r[1]) for r in df.select(url_filter.domain_of(F.col("h"), two), url_filter.suffix_of(F.col("h"), two)).collect()]
    assert own(["gov.xx"]) == [("co.uk", "uk"), ("b.gov.xx", "gov.xx"), ("com", "com"), ("", "")]
    assert own(url_filter.TWO_LABEL_SUFFIXES)[0] == ("b.co.uk", "co.uk")


# 2


SECTIONED = [(1, "one two\nthree 中文四\n\nlast"), (1, "one two\nthree 中文四\n\nlast"), (2, None), (3, ""), (4, "\n"), (None, "é" * 40 + "\n" + "x" * 5000), (5, "a b " * 3000 + "\nend")]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_spans_and_shares_over_a_table(spark, rule):
    path, pattern = queries.vocabulary("byte_bpe_50k.tiktoken")
    ranks = token_counts.load_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for key, text in SECTIONED:
        text = text or ""
        lines = re.split("(?<=\n)", text) if text else [""]
        counts, at, owner = [0.0] * len(lines), 0, [i for i, line in enumerate(lines) for _ in line.encode()]
        for token in encoding.encode_ordinary(text):
            size = len(encoding.decode_single_token_bytes(token))
            own = owner[at : at + size]
            if rule == "share":
                for i in own:
                    counts[i] += 1 / size
            else:
                counts[own[0 if rule == "start" else -1]] += 1
            at += size
        begin = 0
        for i, line in enumerate(lines):
            expected[(key, i, begin, begin + len(line), round(counts[i], 9))] += 1
            begin += len(line)
    table = spark.createDataFrame([(k, t, "clash") for k, t in SECTIONED], "doc_id long, text string, section string")
    out = token_counts.section_tokens(table, ranks, pattern, rule=rule)
    assert Counter((r.doc_id, r.section, r.char_start, r.char_end, round(r.n_tokens, 9)) for r in out.collect()) == expected
    assert token_counts.section_tokens(table.where("false"), ranks, pattern, rule=rule).count() == 0


# 3


@pytest.mark.parametrize("batches", [1, 7])
def test_batches_meet_the_index_in_order(spark, batches):
    rng = random.Random(batches)
    rows = [(rng.choice([None, *range(200)]), f"text\t{rng.randrange(60)}") for _ in range(400)]
    index = exact_dedup.DigestIndex(spark, f"index_{batches}", 2)
    try:
        out = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), index, batches=batches).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[t.replace("\t", " ")].append(i)
        least = {hashlib.sha256(t.encode()).hexdigest(): min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        assert len(out) == len(rows) and all(r.keep_id == least[r.text_sha256] and r.kept == (r.doc_id == r.keep_id) for r in out)
        assert {(r.digest, r.keep_id) for r in index.rows().collect()} == set(least.items()) and index.rows().count() == len(least)
        # the same data again, and after a compaction that was cut off: nothing is new
        spark.sql(f"ALTER TABLE index_{batches} RENAME TO index_{batches}_compacted")
        again = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), index, batches=batches).collect()
        assert sorted(map(str, again)) == sorted(map(str, out)) and index.rows().count() == len(least)
        index.compact()
        assert index.rows().count() == len(least)
    finally:
        index.drop()


def test_edges_of_text_keys(spark):
    light = spark.createDataFrame([(f"k{i:03}", "d") for i in range(300)] + [(None, "d")], "_key string, digest string")
    edges = exact_dedup.batch_edges(light, 3)
    assert edges == sorted(edges) and len(edges) == 2 and edges[0] > "k050" and edges[1] < "k250"


# 4


def mixed_table(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i % 5]), " ".join(f"w{i}x{k}" for k in range(rng.randrange(0, 60))), rng.choice(["a", "a", "a", "b", None]), "z", i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken string, runs long"), rows


def test_shards_are_drawn_and_blocks_are_laid_out(spark):
    table, rows = mixed_table(spark)
    out = mixing.mixed_blocks(table, queries.WEIGHTS, block=8, shard=32).collect()
    again = mixing.mixed_blocks(table, queries.WEIGHTS, block=8, shard=32).select("shard", "place", "source", "n_words").collect()
    assert {(r.shard, r.place, r.source, r.n_words) for r in out} == set(map(tuple, again))
    # every place of every shard is taken once
    slots = sorted(r.shard * 32 + r.place for r in out)
    assert slots == list(range(len(out)))
    assert all(r.n_words == len(r.text.split()) and 0 < r.n_words <= 8 for r in out) and sum(r.n_words < 8 for r in out) <= 12
    texts = defaultdict(set)
    for _, t, s, _, _ in rows:
        texts[s] |= set(t.split())
    assert all(set(r.text.split()) <= texts[r.source] for r in out)
    # shares of shards scatter about the target as draws do, neither fixed nor wild
    share = Counter(r.source for r in out)
    p = share["a"] / len(out)
    each = Counter(r.shard for r in out if r.source == "a")
    full = [each[s] for s in range(len(out) // 32)]
    assert len(set(full)) > 3 and abs(np.var(full) / (32 * p * (1 - p)) - 1) < 0.6


def test_draws_meet_every_quota(spark):
    plan = spark.createDataFrame([(0, 10_000, 2300), (1, 5, 15), (2, 900, 900), (3, 7, 0)], "rank int, source_size long, quota long")
    slots = mixing.slots(plan, block=4, shard=16, per_task=100).collect()
    words = Counter()
    for r in slots:
        words[r["rank"]] += r.slot_words
    assert words == {0: 2300, 1: 15, 2: 900}
    assert len({(r["rank"], r.epoch, r.block) for r in slots}) == len(slots) == max(r.shard * 16 + r.place for r in slots) + 1
    counts = mixing.drawn(mixing.quotas(plan, 4), 16).groupBy("shard").agg(F.sum("c").alias("c")).collect()
    assert sum(r.c for r in counts) == len(slots) and {r.c for r in counts if r.shard < len(slots) // 16} == {16}


def test_mix_of_clashing_columns_null_ids_and_nothing(spark):
    table, rows = mixed_table(spark, 150, 2)
    out = mixing.mixed_documents(table, queries.WEIGHTS, block=8)
    assert out.columns == table.columns
    sizes = Counter()
    for _, t, s, _, _ in rows:
        sizes[s] += len(t.split())
    taken, known = Counter(), {r[4]: r for r in rows}
    for r in out.collect():
        assert (r.doc_id, r.source, r.taken) == (known[r.runs][0], known[r.runs][2], "z") and set(r.text.split()) <= set(known[r.runs][1].split())
        taken[r.source] += len(r.text.split())
    totals = mixing.mixed_sizes(table, queries.WEIGHTS, block=8).collect()
    assert len(totals) == len(rows) and all((r.taken > 0) == (r.shard is not None) == (r.place is not None) for r in totals)
    assert taken == Counter({s: n for s, n in {s: sum(r.taken for r in totals if r.source_size == sizes[s]) for s in sizes}.items() if n})
    for make, n in ((mixing.mixed_documents, 0), (mixing.mixed_blocks, 0), (mixing.mixed_sizes, sum(not r[1] for r in rows))):
        # no row has words, and there is none
        assert make(table.where("text = ''"), queries.WEIGHTS).count() == n and make(table.where("false"), queries.WEIGHTS).count() == 0


# 5


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "a line that is said in many documents, word for word"
    names = ["_row", "_gone", "_k", "_r", "_digest", "row", "gone", "key", "k", "r", "digest", "c0", "c1", "n_lines"]
    rows = [(i, f"own {i}\n{line}\n", *[f"{n}{i}" for n in names]) for i in range(7)] + [(None, None, *names), (7, "alone", *names)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)))
    assert out.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_dropped"]
    found = {r.doc_id: r for r in out.collect()}
    assert [found[i].text for i in range(8)] == [f"own {i}\n" for i in range(6)] + [f"own 6\n{line}\n", "alone"]
    assert [(found[i].n_lines, found[i].n_dropped) for i in (0, 6, 7, None)] == [(3, 1), (3, 0), (1, 0), (1, 0)]
    assert found[None].text == "" and all(found[i][n] == f"{n}{i}" for i in range(7) for n in names[:-1])


def test_texts_that_lose_nothing_are_not_shuffled(spark):
    table = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    plan = line_dedup.dedup_lines(table)._jdf.queryExecution().optimizedPlan().toString()
    left, right = plan.split("Union", 1)[1], plan
    assert "Union" in right and left.count("Join") == 1


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_bloom_filters_hold_all_they_were_given(spark, n):
    bits = bloom.bits_for(n)
    table = bloom.of(spark.range(0, n, 1, 3).select(F.xxhash64("id")), bits)
    shared = spark.sparkContext.broadcast(table.tobytes())
    rows = spark.range(2 * n + 100).withColumn("h", F.xxhash64("id"))
    passed = [r.id for r in rows.where(bloom.known_in("h", shared, bits)).collect()]
    assert set(range(n)) <= set(passed) and len(passed) - n <= 0.1 * (n + 100)
    assert bloom.bits_for(10**12) == bloom.MOST_BITS


# 6


def direct(text, weights, bias):
    """Noisy-or, sentence by sentence, from the definition."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        words = {w for w in re.findall(r"[a-zäé]+", sentence)}
        s = sum(weights.get(f, 0.0) for w in words for f in [w, *(w[:n] + "*" for n in (4, 5) if len(w) > n)])
        not_toxic = (1 + math.exp(bias)) / (1 + math.exp(bias + s)) if s else 1.0
        clean *= not_toxic if 1 - not_toxic >= 0.1 else 1.0
    return 1 - clean


def test_chance_words_of_clean_sentences_never_add_up():
    scorer = toxicity.Scorer({"bias": -8.0, "weights": {"chance": 5.0, "grobbly": 12.0}})
    assert scorer.document("a chance word. " * 100_000) == (0.0, [])
    score, found = scorer.document("a chance word. " * 100_000 + "a grobbly end")
    assert score > 0.9 and len(found) == 1


def test_scores_are_noisy_or_of_sentences(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 9))) for _ in range(60)]
    weights = {w: rng.uniform(0, 6) for w in rng.sample(words, 25)} | {f"{w[:4]}*": rng.uniform(0, 4) for w in words[:20] if len(w) > 4}
    model = {"bias": -6.0, "weights": weights}
    texts = ["".join(rng.choice(words).title() + rng.choice([" ", ", ", ". ", "!\n", "?? "]) for _ in range(rng.randrange(0, 80))) for _ in range(150)] + [None, "", "12 !"]
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        assert math.isclose(out[i].score, direct(text or "", weights, -6.0), rel_tol=1e-9, abs_tol=1e-12) and out[i].predicted == (out[i].score >= 0.5)
        for span in out[i].offending:
            assert math.isclose(direct(text[span.start : span.end], weights, -6.0), span.p, rel_tol=1e-9) and span.p >= 0.5
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_fit_goes_down_the_loss():
    """The fitted weights leave no way down: the loss of the data, computed from the definition, grows to either side."""
    rng = random.Random(6)
    docs = [(int(i % 3 == 0), [((rng.randrange(4),), 1), ((rng.randrange(2), 2 + rng.randrange(2)), 2)] if i % 3 else [((4, rng.randrange(4)), 1), ((5,), 1)]) for i in range(90)]
    kept = [f"f{i}" for i in range(6)]

    def loss(w):
        total = 0.0
        for y, own in docs:
            clean = math.prod(((1 + math.exp(toxicity.BIAS)) / (1 + math.exp(toxicity.BIAS + sum(w[i] for i in found)))) ** n for found, n in own)
            total -= math.log(max(1e-300, 1 - clean if y else clean))
        return total / len(docs) + 0.5e-4 * sum(x * x for x in w)

    fitted = [toxicity.descend(kept, docs, steps=30_000, rate=0.02)["weights"][f] for f in kept]
    for i in range(6):
        for step in (-0.3, 0.3):
            if fitted[i] + step >= 0:
                assert loss([x + step * (j == i) for j, x in enumerate(fitted)]) >= loss(fitted) - 1e-5


def test_letters_are_letters(spark):
    assert common.letter_runs("½x² ①Ⅷ é_1 一二 ١ a½b") == ["x", "é", "一二", "a", "b"] and common.letter_runs("½ 1") == common.letter_runs("") == []
    assert common.letter_runs("".join(map(chr, range(0x3000)))) == "".join(c if (c := chr(i)).isalpha() else " " for i in range(0x3000)).split()
    assert toxicity.bags("½ ². Ⅷ! ok") == [{"ok"}]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("das haus und der hund", "de"), ("the house and the dog", "en")] * 30)]
    table = spark.createDataFrame([*rows, (100, "½ ² ①", None), (101, "Ⅷ", "de"), (102, "12.5 %", None), (103, "ª", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in lang_crf.predict(table, lang_crf.train(table)).collect()}
    assert [found[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and found[103].lang_pred in ("de", "en") and found[0].lang_pred == "de" and found[1].lang_pred == "en"
    assert lang_crf.predict(table.where("false"), lang_crf.train(table)).count() == 0


# 10


def test_samples_come_from_all_over_a_text():
    text = "\n".join(f"line {i} has words of its own" for i in range(5000))
    taken = lang_crf.sampled(text)
    assert 300 <= sum(map(len, taken)) < 300 + lang_crf.CHAIN and taken == lang_crf.sampled(text)
    assert lang_crf.sampled("one two\nthree") == [["one", "two"], ["three"]] and lang_crf.sampled("") == []


def test_document_scores_are_means_of_word_posteriors():
    rows = [(" ".join(random.Random(i).choices(["ab", "ba", "aab"] if i % 2 else ["yz", "zzy", "zy"], k=9)), "xx" if i % 2 else "yy") for i in range(40)]
    model = lang_crf.fit(rows)
    text = "ab zy ba\nzy yz zz ½ ab"
    sums, n = np.zeros(2), 0
    for line in text.split("\n"):
        words = re.findall("[a-z]+", line)
        owner, slots = lang_crf.hashed_features(words)
        emission = np.array([[sum(model["weights"][s, y] for s in [*slots[owner == i], *model["entries"].get(w, [])]) for y in (0, 1)] for i, w in enumerate(words)])
        # every labelling, weighed by its score
        total = np.zeros((len(words), 2))
        for labels in np.ndindex(*[2] * len(words)):
            score = sum(emission[i, y] for i, y in enumerate(labels)) + sum(model["transitions"][a, b] for a, b in zip(labels, labels[1:]))
            for i, y in enumerate(labels):
                total[i, y] += math.exp(score)
        sums += (total / total.sum(axis=1, keepdims=True)).sum(axis=0)
        n += len(words)
    language, score = lang_crf.Tagger(model).documents([text])[0]
    assert language == model["languages"][int(sums.argmax())] and math.isclose(score, sums.max() / n, rel_tol=1e-5)


# 7


def bags_of(texts):
    return [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]


def classes_of(texts, similar=0.8):
    bags, parent = bags_of(texts), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            both = sum((bags[x] & bags[y]).values())
            if both >= similar * (sum(bags[x].values()) + sum(bags[y].values()) - both):
                parent[root(x)] = root(y)
    least = {}
    for i in range(len(texts)):
        least.setdefault(root(i), i)
    return [least[root(i)] for i in range(len(texts))]


@pytest.mark.parametrize("seed", range(2))
def test_families_within_families(spark, seed):
    """Copies of a source, of a derivative of it, and of parts of it, with edits that some of them share."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    base = fresh(150)
    derived = base[:100] + fresh(50)
    patches, texts = [fresh(4) for _ in range(5)], []
    for i in range(130):
        text = list(rng.choice([base, base, derived, derived, base[: rng.randint(100, 140)], derived[rng.randrange(40) :]]))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(3)] = rng.choice(patches) if rng.random() < 0.5 else fresh(rng.randint(1, 3))
        texts.append(" ".join(text))
    found = bag_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.class_id for r in sorted(found, key=lambda r: r.doc_id)] == classes_of(texts)


def test_a_very_long_text(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50_000)]
    long = " ".join(rng.choices(words, k=1_800_000))
    near = long.split(" ")
    for k in rng.sample(range(len(near)), 9_000):
        near[k] = "edit"
    table = spark.createDataFrame([(1, long), (2, " ".join(near)), (3, long[: len(long) // 2]), (4, "short one of five words")], "doc_id long, text string")
    assert len(long) > 10_000_000
    assert sorted((r.doc_id, r.class_id) for r in bag_minhash.near_duplicates(table).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_components_are_found_and_leave_nothing(spark, tmp_path):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(400)] + [(2000, 2001 + i) for i in range(100)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    out = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out.keys() == parent.keys() and all(root(x) == root(y) for x, y in out.items())
    assert len(set(out.values())) == len({root(x) for x in parent})


# 8


def test_codec_over_a_table(spark):
    path, pattern = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    model, encoding = byte_bpe.serialise(ranks), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "né 中文 🤦"), (4, "word " * 30_000), (5, "<unk> \x00\n\r\n")]
    table = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, ids int, n_tokens string")
    ids = byte_bpe.encode(table, model, pattern)
    expected = Counter((k, tuple(encoding.encode_ordinary(t or ""))) for k, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == expected
    back = byte_bpe.decode(ids.unionByName(spark.createDataFrame([(9, None)], "doc_id long, ids array<int>")), model, pattern)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == Counter((k, (t or "").encode()) for k, t in [*rows, (9, "")])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    trip = byte_bpe.round_trip(table, model, pattern)
    assert Counter(tuple(r) for r in trip.collect()) == Counter((k, len(e := encoding.encode_ordinary(t or "")), sha(",".join(map(str, e)).encode()), sha((t or "").encode())) for k, t in rows)
    for make in (byte_bpe.encode, byte_bpe.round_trip):
        assert make(table.where("false"), model, pattern).count() == 0


# 9


def test_recall_over_many_queries(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2500, 24)).astype(np.float32)
    vectors = spark.createDataFrame([(int(i), v.tolist(), "h", "ids") for i, v in enumerate(x)], "vec_id long, embedding array<float>, h string, q string")
    found = defaultdict(set)
    for r in ann.nearest(vectors, vectors.where("vec_id % 10 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    hits = [len(found[q] & {int(i) for i in np.argsort(((x.astype(float) - x[q]) ** 2).sum(axis=1))[1:11]}) for q in range(0, 2500, 10)]
    assert np.mean(hits) >= 9.0


# where tables are kept


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_released_tables_are_gone(spark):
    kept = common.durable(spark.range(3), "kept")
    files = kept.inputFiles()
    common.release(kept, spark.range(2))
    with pytest.raises(Exception):
        spark.read.parquet(files[0]).count()


def test_the_whole_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        words = [*base[:-1], f"e{i}"] if i % 4 == 0 else [f"o{i}x{k}" for k in range(40)]
        rows.append((i, " ".join(words) + (". you grobbly thing" if i % 8 == 1 else "."), "en", rng.choice(["s0", "s1"]), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 1)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path), f"file://{tmp_path}/run").collect()
    ids = {r.doc_id for r in out}
    assert not any(i % 8 == 1 for i in ids), "toxic documents go"
    assert len([i for i in ids if i % 4 == 0]) <= 1, "one near copy stays"
    # a run that is taken up again goes on from what is there
    again = corpus_pipeline.run(spark, f"{tmp_path}", f"file://{tmp_path}/run")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out))
    assert all(r.n_tokens > 0 for r in out) and set(out[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


# memory


def held():
    """MB of this process's own memory."""
    with open("/proc/self/status") as status:
        return int(re.search(r"RssAnon:\s+(\d+)", status.read())[1]) // 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
@pytest.mark.parametrize("made", [lambda docs: toxicity.keep_clean(docs, {"bias": -8.0, "weights": {}}), lambda docs: byte_bpe.round_trip(docs, *queries.bpe_model()), lambda docs: byte_bpe.encode(docs, *queries.bpe_model())])
def test_workers_give_back_what_a_task_took(made):
    docs, kept = MagicMock(columns=["doc_id", "text"]), []
    docs.sparkSession.sparkContext.broadcast = lambda x: SimpleNamespace(value=x)
    docs.select.return_value = docs
    made(docs)

    def batches(n):
        texts = [f"{i} word " * 100 for i in range(n)]
        kept.append(texts.pop())  # so that the C library doesn't let the rest go by itself
        del texts
        yield pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one", None]})

    run = docs.mapInArrow.call_args[0][0]
    assert sum(b.num_rows for b in run(batches(2))) == 2
    before = held()
    assert sum(b.num_rows for b in run(batches(200_000))) == 2
    assert held() - before < 60


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_line_dedup_gives_memory_back_and_sends_small_batches(spark, monkeypatch):
    frame, made, kept = type(spark.range(0)), [], []
    original = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *a, **b: made.append(run) or original(self, run, *a, **b))
    line_dedup.dedup_lines(spark.createDataFrame([(1, "one")], "doc_id long, text string"))
    gone = pa.array([None] * 1200, pa.list_(pa.binary()))
    batch = pa.RecordBatch.from_pydict({"c0": list(range(1200)), "c1": [f"{i}\none" for i in range(1200)], "gone": gone})
    # the first makes filters of texts, the last rebuilds texts
    for run, own in ((made[0], batch.select(["c1"])), (made[-1], batch)):

        def batches(n, own=own):
            texts = [f"{i} word " * 100 for i in range(n)]
            kept.append(texts.pop())
            del texts
            yield own

        first = [b.num_rows for b in run(batches(2))]
        before = held()
        assert [b.num_rows for b in run(batches(200_000))] == first
        assert held() - before < 60
    assert first == [500, 500, 200]
