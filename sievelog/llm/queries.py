"""The operators applied to the test tables with production parameters, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bag_minhash, byte_bpe, exact_dedup, lang_crf, line_dedup, mixing, token_counts, toxicity, url_filter
from .common import fold

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
WEIGHTS = (5.0, 2.0, 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> tuple[str, str]:
    """(path of a rank file, pattern of its pre-tokens). Where the files are is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: a page is bad if the document of its id is labelled as of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    outcomes = pages.select("page_id", "url").join(labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad")), "page_id").select("url", "bad")
    judged = url_filter.judge(pages, outcomes, RULES)
    # sums of doubles differ in their last digits with the order in which they are taken
    return judged.withColumns({c: F.round(c, 6) for c in judged.columns if c.startswith("bad_")})


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary("byte_bpe_50k.tiktoken")
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), token_counts.load_ranks(path), pattern, rule="start")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_once(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"), WEIGHTS)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> dict:
    return toxicity.train(docs, labels, learn_from=lambda key: fold(key, 5) != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def bpe_model() -> tuple[bytes, str]:
    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.serialise(byte_bpe.load_ranks(path)), pattern


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), *bpe_model())


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_crf.train(docs, learn_from=lambda key: fold(key, 3) != 1)
    return lang_crf.predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_token_counts, op3_exact_dedup, op4_source_mix, op5_line_dedup, op6_toxicity, op7_near_duplicates, op8_byte_bpe, op9_nearest, op10_language)}



#: The rules as CASE branches, tried from the longest on.
_RULE = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'" for h, p in (r[1].split("/", 1) for r in sorted(RULES, key=lambda r: -len(r[1]))))
_VERDICT = "\n".join(f"    WHEN '{text}' THEN '{say}'" for say, text in RULES)
_TWO = ", ".join(f"'{s}'" for s in url_filter.TWO_LABEL_SUFFIXES)


def _labels(n: int) -> str:
    return f"array_to_string(string_split(host, '.')[-{n}:], '.')"


def _level(name: str, source: str, keys: str, prior: str) -> str:
    """CTEs of one level: rows with their prior, the level's strength by the method of moments, and posteriors."""
    return f"""
{name}_rows AS ({source.format(prior=prior)}),
{name}_sums AS (SELECT sum((bad - n * prior) * (bad - n * prior) / n) AS dev, sum(prior * (1 - prior)) AS var, sum((n - 1) * prior * (1 - prior)) AS over FROM {name}_rows),
{name}_post AS (SELECT {keys}, k * prior + bad AS a, k * (1 - prior) + n - bad AS b FROM {name}_rows, (
  SELECT CASE WHEN coalesce(over, 0) = 0 OR dev <= var THEN 1e4 ELSE least(1e4, greatest(1.0, over / (dev - var) - 1)) END AS k FROM {name}_sums)),"""


_OP1 = f"""WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (SELECT *, CASE WHEN {_labels(2)} IN ({_TWO}) THEN {_labels(3)} ELSE {_labels(2)} END AS domain, CASE WHEN {_labels(2)} IN ({_TWO}) THEN {_labels(2)} ELSE {_labels(1)} END AS suffix FROM p),
seen AS (SELECT host, domain, suffix, CAST(1 - quality AS DOUBLE) AS bad FROM named JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL),
every AS (SELECT coalesce(sum(bad), 0) + 0.5 AS a, count(*) - coalesce(sum(bad), 0) + 0.5 AS b FROM seen),""" + _level("suffix", "SELECT suffix, count(*)::DOUBLE AS n, sum(bad) AS bad, any_value({prior}) AS prior FROM seen, every GROUP BY suffix", "suffix", "a / (a + b)") + _level(
    "domain", "SELECT domain, s.n, s.bad, {prior} AS prior FROM (SELECT domain, suffix, count(*)::DOUBLE AS n, sum(bad) AS bad FROM seen GROUP BY ALL) s JOIN suffix_post USING (suffix)", "domain", "a / (a + b)"
) + _level("host", "SELECT host, s.n, s.bad, {prior} AS prior FROM (SELECT host, domain, count(*)::DOUBLE AS n, sum(bad) AS bad FROM seen GROUP BY ALL) s JOIN domain_post USING (domain)", "host", "a / (a + b)") + f"""
judged AS (SELECT page_id, host, path, CASE
{_RULE} END AS rule, coalesce(h.a, d.a, s.a, e.a) AS bad_a, coalesce(h.b, d.b, s.b, e.b) AS bad_b, 1.25 * e.a / (e.a + e.b) AS bad_limit
  FROM named LEFT JOIN host_post h USING (host) LEFT JOIN domain_post d USING (domain) LEFT JOIN suffix_post s USING (suffix), every e),
bounds AS (SELECT *, bad_a / (bad_a + bad_b) AS m, bad_a + bad_b + 1 AS n1 FROM judged),
low AS (SELECT *, greatest(0, m - 1.645 * sqrt(m * (1 - m) / n1)) AS bad_bound FROM bounds)
SELECT page_id, host, path, rule, round(bad_a, 6) AS bad_a, round(bad_b, 6) AS bad_b, round(bad_bound, 6) AS bad_bound, round(bad_limit, 6) AS bad_limit, CASE rule
{_VERDICT}
    ELSE CASE WHEN bad_bound > bad_limit THEN 'block' ELSE 'allow' END END AS verdict FROM low"""

_WS = r"[\x20\x09-\x0D]"
_OP3 = f"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)"""

_OP5 = f"""WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{url_filter.UPPER}', '{url_filter.LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, i, line, keep IS NULL OR keep = doc_id AS stays FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def _permuted(i: str, n: str, bits: str, seed: str) -> tuple[str, str]:
    """Lateral columns v1 … and the last one's name: the permutation of ``mixing.permuted``."""
    columns, at = [], i
    for k in range(mixing.ROUNDS):
        times = f"CASE WHEN {n} % {mixing.PRIMES[k]} <> 0 THEN {mixing.PRIMES[k]} ELSE {mixing.PRIMES[(k + 1) % len(mixing.PRIMES)]} END"
        columns.append(f"({at} * ({times})::BIGINT + (({seed}) * {2 * k + 7919} + {104729 * (k + 1)}) % {n}) % {n} AS a{k}")
        columns.append(f"CASE WHEN a{k} < (1::BIGINT << ({bits})::INT) THEN xor(a{k}, a{k} >> (({bits} + 1) // 2)::INT) ELSE a{k} END AS v{k}")
        at = f"v{k}"
    return ", ".join(columns), at


def _hashed(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _op4() -> str:
    """Targets, stream, draws, slots and blocks as ``mixing`` makes them, with DuckDB's windows and lists."""
    b, h = mixing.BLOCK, mixing.SHARD
    log2 = lambda n: f"floor(log2(greatest({n}, 1)))::INT"
    chosen, block = _permuted("j", "greatest(full_blocks, 1)", "bits", "rank * 31 + epoch * 17 + 1")
    place, placed = _permuted("p", "inside", "bits", "shard + 40009")
    slot, v = _permuted("k", "got", "bits", "rank * 31 + 20011")
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""WITH d AS (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
c AS (SELECT greatest(16, CASE WHEN count(*) > 20000 THEN (1::BIGINT << ceil(log2(count(*) / 20000.0))::INT) ELSE 1 END) AS chunks FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS rank FROM s),
w AS (SELECT *, list_extract([{", ".join(map(str, WEIGHTS))}], rank % {len(WEIGHTS)} + 1)::DOUBLE AS weight FROM r),
f AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER cap, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER cap, 0)) AS level
  FROM w WINDOW cap AS (ORDER BY source_size / weight, rank {before})),
t AS (SELECT source, source_size, rank, least(coalesce((SELECT level FROM f WHERE level * weight <= 3 * source_size ORDER BY source_size / weight, rank LIMIT 1), 0) * weight, 3.0 * source_size) AS target FROM f),
q AS (SELECT *, round(target)::BIGINT AS quota, source_size // {b} AS full_blocks, source_size // {b} + (source_size % {b} > 0)::INT AS per_epoch FROM t),
n AS (SELECT *, quota // source_size AS epochs, {log2("full_blocks")} AS bits, (quota // source_size) * per_epoch + (quota % source_size + {b - 1}) // {b} AS n FROM q WHERE quota > 0),
o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY rank {before}), 0)::BIGINT AS first, (sum(n) OVER ())::BIGINT AS total FROM n),
u AS (SELECT g // {h} AS shard, {_hashed("g::VARCHAR")} % total AS x FROM (SELECT total, unnest(range(total)) AS g FROM (SELECT DISTINCT total FROM o))),
y AS (SELECT shard, rank, count(*)::BIGINT AS c FROM u JOIN o ON x >= first AND x < first + n GROUP BY ALL),
z AS (SELECT o.*, coalesce(got, 0)::BIGINT AS got, coalesce(sum(greatest(coalesce(got, 0) - n, 0)) OVER i, 0)::BIGINT AS over_before, coalesce(sum(greatest(n - coalesce(got, 0), 0)) OVER i, 0)::BIGINT AS short_before
  FROM o LEFT JOIN (SELECT rank, sum(c) AS got FROM y GROUP BY rank) USING (rank) WINDOW i AS (ORDER BY rank {before})),
e AS (SELECT shard, rank, c, coalesce(sum(c) OVER (PARTITION BY rank ORDER BY shard {before}), 0)::BIGINT AS k0, coalesce(sum(c) OVER (PARTITION BY shard ORDER BY rank {before}), 0)::BIGINT AS p0 FROM y),
a AS (SELECT shard, rank, n, got, over_before, least({h}, total - shard * {h}) AS inside, k0 + i AS k, p0 + i AS p FROM (SELECT *, unnest(range(c)) AS i FROM e) JOIN z USING (rank)),
pl AS (SELECT shard, rank, n, got, over_before, k, {placed} AS place FROM (SELECT *, {log2("inside")} AS bits, {place} FROM a)),
vs AS (SELECT shard, rank, n, over_before, place, {v} AS v FROM (SELECT *, {log2("got")} AS bits, {slot} FROM pl)),
gaps AS (SELECT rank, got + i AS k, short_before + i AS r FROM (SELECT *, unnest(range(n - got)) AS i FROM z WHERE n > got)),
dealt AS (SELECT shard, place, rank, v AS k FROM vs WHERE v < n UNION ALL SELECT shard, place, gaps.rank, gaps.k FROM vs JOIN gaps ON gaps.r = v - n + over_before WHERE v >= n),
ks AS (SELECT dealt.*, k // per_epoch AS epoch, k % per_epoch AS j, full_blocks, source_size, quota, bits FROM dealt JOIN n USING (rank)),
x AS (SELECT shard, place, rank, CASE WHEN j < full_blocks THEN v ELSE full_blocks END AS block, words FROM (
  SELECT *, {chosen}, {block} AS v, least({b}, source_size - j * {b}, quota - epoch * source_size - j * {b}) AS words FROM ks)),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY chunk, id NULLS LAST, size {before}) AS before, row_number() OVER () AS row
  FROM (SELECT d.*, {_hashed("concat_ws(':', id, size)")} % chunks AS chunk FROM d, c) d),
st AS (SELECT p.*, coalesce(before, 0)::BIGINT AS start, t.rank, t.source_size, t.target FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source),
m AS (SELECT *, unnest(range(start // {b}, (start + size - 1) // {b} + 1)) AS block FROM st WHERE size > 0),
g AS (SELECT row, sum(least(start + size, m.block * {b} + words) - greatest(start, m.block * {b}))::BIGINT AS taken, min(shard * {h} + place) AS slot
  FROM m JOIN x ON x.rank = m.rank AND x.block = m.block WHERE least(start + size, m.block * {b} + words) > greatest(start, m.block * {b}) GROUP BY row)
SELECT id AS doc_id, size, source_size, target, coalesce(taken, 0) AS taken, slot // {h} AS shard, slot % {h} AS place FROM st LEFT JOIN g USING (row)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1, "op3_exact_dedup": _OP3, "op4_source_mix": _op4(), "op5_line_dedup": _OP5}
