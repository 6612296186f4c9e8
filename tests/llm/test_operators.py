"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelog.llm import ann, bag_minhash, exact_dedup, lang_crf, line_dedup, mixing, queries, token_counts, toxicity, url_filter
from sievelog.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, digest string, size long, score double"
LONG = "a line that is long enough to be judged by itself, number {}"


def docs(spark, rows):
    """(doc_id, text, lang, source) rows, with columns whose names the operators use themselves."""
    full = [(i, t, lang, source, None if t is None else len(t), "x", "y", "z", 1, 0.5) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, "\n".join([sentence(12), LONG.format(rng.randrange(4)), sentence(9)]), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", None])) for i in range(60)]
    base = sentence(150).split(" ")
    for i in range(60, 90):  # near copies
        near = list(base)
        near[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(near), "en", "s2"))
    rows += [(100 + i, " ".join(base), "en", "s2") for i in range(5)]  # exact copies
    rows += [(105, "  " + "\t".join(base).upper() + "\n", "en", "s2")]
    rows += [(200, None, "en", "s0"), (201, "", "en", None), (202, " \n\t", None, "s0"), (203, "one", "en", "s3"), (204, "one", "en", "s3"), (-5, "ONE", "en", "s3"), (None, "null key text of some words", "en", "s1"), (None, None, None, None)]
    rows += [(300, sentence(20000), "en", "s1"), (rows[0]), (rows[0])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


def collected(df):
    return Counter(tuple(r) for r in df.collect())


# 1


def test_url_filter(spark):
    urls = ["https://WWW.Spam.example.com/en/5?x=1", "http://good.example.com/en/71#t", "https://a.example.net/de/8", "https://b.example.net/de/9", "https://x.org/es/", "ftp://h?u=http://x/y", "no scheme", None, "", "http://"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    bad = [("http://www.spam.example.com/", 1)] * 40 + [("http://good.example.com/", 0)] * 40 + [("http://q.example.info/", None), (None, 1)]
    out = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame(bad, "url string, bad int"), queries.RULES).collect()}
    assert [(out[i].host, out[i].path) for i in range(10)] == [("www.spam.example.com", "/en/5"), ("good.example.com", "/en/71"), ("a.example.net", "/de/8"), ("b.example.net", "/de/9"), ("x.org", "/es/"), ("h", ""), ("", ""), ("", ""), ("", ""), ("", "")]
    assert [out[i].rule for i in range(5)] == ["com/en/", "example.com/en/7", "example.net/de/8", "net/de/", "org/es/"]
    assert [out[i].verdict for i in range(5)] == ["block", "allow", "block", "allow", "block"]
    unruled = {r.host: r.verdict for r in url_filter.judge(pages, spark.createDataFrame(bad, "url string, bad int")).collect()}
    assert unruled["www.spam.example.com"] == "block" and unruled["good.example.com"] == "allow"
    nothing = spark.createDataFrame([], "url string, bad int")
    assert {r.verdict for r in url_filter.judge(pages, nothing).collect()} == {"allow"}
    assert url_filter.judge(pages.where("false"), nothing, queries.RULES).count() == 0


def test_posterior_shrinks_towards_parents(spark):
    seen = [("http://one.a.com/", 1)] + [(f"http://h{i % 20}.a.com/", int(i % 20 < 2)) for i in range(400)] + [("http://z.b.com/", i % 2) for i in range(100)]
    levels, (a, b) = url_filter.reputation(spark.createDataFrame(seen, "url string, bad int"))
    mean = {r.host: r.a / (r.a + r.b) for r in levels["host"].collect()}
    assert mean["h5.a.com"] < a / (a + b) < mean["one.a.com"] < 1 and mean["h0.a.com"] > 0.8


# 2


def test_token_counts(spark, rows):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.vocabulary("byte_bpe_50k.tiktoken")
    ranks = token_counts.load_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = token_counts.section_tokens(docs(spark, rows), ranks, pattern)
    total = Counter()
    for r in out.collect():
        total[r.doc_id] += r.n_tokens
    expected = Counter()
    for i, t, _, _ in rows:
        expected[i] += len(encoding.encode_ordinary(t or ""))
    assert total == expected and out.count() == sum((t or "").count("\n") + 1 for _, t, _, _ in rows)


# 3


def test_exact_dedup(spark, rows):
    import re

    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    expected = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected.update((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert collected(exact_dedup.dedup_once(docs(spark, rows))) == expected
    assert exact_dedup.dedup_once(docs(spark, [])).count() == 0


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, "kept_digests", 3)
    try:
        first = exact_dedup.dedup(docs(spark, [(5, "a b", None, None), (6, "c", None, None)]), index)
        assert {(r.doc_id, r.kept) for r in first.collect()} == {(5, True), (6, True)}
        second = exact_dedup.dedup(docs(spark, [(1, "a\tb", None, None), (2, "d", None, None)]), index)
        assert {(r.doc_id, r.keep_id, r.kept) for r in second.collect()} == {(1, 5, False), (2, 2, True)}
        index.compact()
        assert index.rows().count() == 3
        plan = index.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        index.drop()


# 4


def filled(sizes, weights):
    total, capped = sum(sizes.values()), set()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    while True:
        rest, share = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / share for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixed_sizes(spark, rows):
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    target = filled(sizes, queries.WEIGHTS)
    runs = [collected(mixing.mixed_sizes(docs(spark, rows), queries.WEIGHTS, block=16)) for _ in range(2)]
    assert runs[0] == runs[1]
    out = mixing.mixed_sizes(docs(spark, rows), queries.WEIGHTS, block=16).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in out)
    by = Counter()
    for r in out:
        by[(r.source_size, r.target)] += r.taken
    assert all(abs(t - n) <= 1 for (_, t), n in by.items())
    assert sorted(round(t, 6) for t in {r.target for r in out}) == sorted({round(t, 6) for t in target.values()})
    assert mixing.mixed_sizes(docs(spark, []), queries.WEIGHTS).count() == 0


def test_mixed_documents(spark, rows):
    out = mixing.mixed_documents(docs(spark, rows), queries.WEIGHTS, block=16)
    assert out.columns == docs(spark, []).columns
    texts = defaultdict(set)
    for i, t, _, _ in rows:
        texts[i].add(tuple(words(t)))
    taken, whole = Counter(), 0
    for r in out.collect():
        taken[r.source] += len(words(r.text))
        whole += tuple(words(r.text)) in texts[r.doc_id]
        assert any(set(words(r.text)) <= set(t) for t in texts[r.doc_id])
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    assert whole and all(abs(taken[s] - t) <= 1 for s, t in filled(sizes, queries.WEIGHTS).items())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation(spark, n):
    i, size = F.col("id"), F.lit(n).cast("long")
    found = spark.range(n).select(mixing.permuted(i, size, mixing.bits_of(size), F.lit(12345).cast("long")).alias("p")).collect()
    assert sorted(r.p for r in found) == list(range(n))


# 5


def brute_lines(rows, least_chars=40, least_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    held = defaultdict(list)
    for i, t, _, _ in rows:
        for k in {key(x) for x in (t or "").split("\n") if len(x.strip(" \t\n\x0b\x0c\r")) >= least_chars}:
            held[k].append(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least_docs}
    out = Counter()
    for i, t, _, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    return out


@pytest.mark.parametrize("bits", [1 << 10, 1 << 20])  # a filter far too small finds the same
def test_line_dedup(spark, rows, bits):
    more = [*rows, (1000, f"  {LONG.format(0).upper()}\t\n{LONG.format(0)}\nshort", "en", "s0")]
    out = line_dedup.dedup_lines(docs(spark, more), bits=bits).select("doc_id", "text", "n_lines", "n_dropped")
    assert collected(out) == brute_lines(more)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# 6, 10


def test_toxicity_learns_from_long_documents_as_they_are(spark):
    texts = [(i, f"fine words {i % 7}. " * 2000 + "a grobbly end" * (i % 4 == 0)) for i in range(60)]
    labels = [(i, int(i % 4 == 0)) for i in range(60)]
    model = toxicity.train(spark.createDataFrame([*texts, *texts], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    own = toxicity.fit([(t, y) for (_, t), (_, y) in zip(texts, labels)])
    assert set(model["weights"]) == set(own["weights"]) and "grobbly" in own["weights"]
    assert all(math.isclose(model["weights"][f], own["weights"][f], rel_tol=1e-6) for f in own["weights"])
    scorer = toxicity.Scorer(model)
    assert all((scorer.document(t)[0] >= 0.5) == y for (_, t), (_, y) in zip(texts, labels))


def test_models_over_tables(spark, rows):
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(table, toxicity.train(table, labels, learn_from=lambda key: fold(key, 5) != 0))
    assert scored.count() == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.collect())
    none = toxicity.train(table, labels.where("false"))
    assert {r.predicted for r in toxicity.score(table, none).collect()} == {0}
    assert toxicity.keep_clean(table, none).count() == len(rows) and toxicity.keep_clean(table, none).columns == table.columns
    model = lang_crf.train(table, learn_from=lambda key: fold(key, 3) != 1)
    found = {(r.doc_id, r.lang_pred, r.score) for r in lang_crf.predict(table, model).collect()}
    assert {(200, "und", 0.0), (201, "und", 0.0), (202, "und", 0.0)} <= found and {y for _, y, _ in found} <= {"en", "de", "und"}
    empty = lang_crf.train(table.where("false"))
    assert {r.lang_pred for r in lang_crf.predict(table, empty).collect()} == {"und"}


# 7


def brute_near(rows, similar=0.8):
    bags, parent = {}, {}
    for n, (_, t, _, _) in enumerate(rows):
        w = [x.lower() for x in words(t)]
        bags[n] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
        parent[n] = n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in bags:
        for y in range(x):
            if bags[x] and bags[y]:
                both = sum((bags[x] & bags[y]).values())
                if both >= similar * (sum(bags[x].values()) + sum(bags[y].values()) - both):
                    parent[root(x)] = root(y)
    classes = defaultdict(list)
    for n, (i, _, _, _) in enumerate(rows):
        classes[root(n) if bags[n] else ("alone", n)].append(i)
    return Counter((i, min((j for j in ids if j is not None), default=None)) for ids in classes.values() for i in ids)


def test_near_duplicates(spark, rows):
    assert collected(bag_minhash.near_duplicates(docs(spark, rows)).select("doc_id", "class_id")) == brute_near(rows)
    assert bag_minhash.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_on_the_edge_of_similarity(spark):
    """Chains and stragglers around one source, whose pairs lie on both sides of the threshold."""
    rng = random.Random(9)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(120)], []
    for i in range(70):
        text = list(base)
        for k in rng.sample(range(120), rng.randint(0, 6)):
            text[k] = f"e{i}x{k}" if rng.random() < 0.7 else f"shared{k}"
        rows.append((i, " ".join(text), None, None))
    out = collected(bag_minhash.near_duplicates(docs(spark, rows)).select("doc_id", "class_id"))
    assert out == brute_near(rows)


# 9


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:120] = x[7]  # a large group of equal vectors
    rows = [(int(i), v.tolist(), 1, 0.5) for i, v in enumerate(x)] + [(3, x[3].tolist(), 1, 0.5)]
    rows += [(900, None, 1, 0.5), (1000, [0.0] * 16, 1, 0.5), (1100, [float("nan")] * 16, 1, 0.5), (1200, [None] * 16, 1, 0.5), (1300, [1.0], 1, 0.5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")
    out = defaultdict(list)
    for r in ann.nearest(vectors, vectors.where("vec_id % 100 = 0 or vec_id = 7")).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    assert set(out) == {0, 7, 100, 200, 300}
    for q, found in out.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        expected = [int(i) for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        assert [i for i, _ in found] == expected and np.allclose([s for _, s in found], d[expected], rtol=1e-14)
    few = vectors.where("vec_id in (0, 1, 2)")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest(vectors.where("false"), vectors).count() == 0


@pytest.mark.parametrize("x", [np.eye(40), np.random.default_rng(3).integers(0, 2, (44, 6)).astype(float), 1e7 + np.random.default_rng(4).normal(size=(40, 8)) * 1e-2])
def test_nearest_orders_all_ties_by_id(spark, x):
    # one leaf holds them all, so the result is exact
    ids = np.random.default_rng(0).permutation(len(x))
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for r in ann.nearest(vectors, vectors, k=3).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.vec_id)
    for q, i in enumerate(ids):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert out[i] == [int(ids[n]) for n in np.lexsort((ids, d)) if n != q][:3]


# the pipeline


def test_pipeline_drops_near_duplicates_by_row(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(60)]
    near = lambda n: " ".join([*base[:-1], f"edit{n}"])
    other = lambda n: " ".join(f"o{n}x{i}" for i in range(20))
    table = [(1, near(1)), (1, near(2)), (2, near(3)), (2, other(2)), (None, near(4)), (None, other(3)), (None, other(3).upper()), (None, other(4)), (3, ""), (3, None), (4, other(5)), (4, other(5))]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(table, "doc_id long, text string"), "").collect()
    first = [r.text for r in kept if r.doc_id == 1]
    assert len(first) == 1 and first[0] in (near(1), near(2))
    assert sorted(str(r.text).lower() for r in kept if r.doc_id != 1) == sorted([other(2), other(3), other(4), "", "none", other(5), other(5)])


def test_pipeline_stages(spark, rows, monkeypatch, tmp_path):
    import corpus_pipeline

    table = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "source mix", "byte-level BPE"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(at)
        assert i == 4 or at.columns == table.columns
    tuples = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    lines = Counter()
    for (i, t, _, _), n in brute_lines(tuples(seen[0])).items():
        lines[(i, t)] += n
    assert Counter((i, t) for i, t, _, _ in tuples(seen[1])) == lines
    classes = brute_near(tuples(seen[1]))
    assert Counter(i for i, _, _, _ in tuples(seen[2])) == Counter({i: n for (i, c), n in classes.items() if i == c})
    assert at.count() == seen[3].count()
