"""Every operator applied to the derived logs, and DuckDB SQL for the same results from the tables themselves."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import membership, ranges, stats
from ..operators.transform import before_failures
from ..sources import derived, parquet_log
from ..streaming import run as streaming
from .query import LogQuery

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_AMOUNT = "regexp_replace(CAST(value AS VARCHAR), '[.]0$', '')"
_EVENTS = f"""log AS (
  SELECT *, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN '{{"id":' || event_id
    ELSE '{{"id":' || event_id || ',"user":' || user_id || ',"type":"' || event_type || '","amount":' || {_AMOUNT} || ',"props":' || props || '}}' END AS val,
    event_id % 97 = 0 AS tomb, event_id % 97 <> 0 AND event_id % 101 = 0 AS bad, epoch_us(ts) // 1000 AS ms, {_AMOUNT} AS amount,
    CAST(user_id % 4 AS INT) AS part, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS off FROM events)"""
_PRICE = "regexp_replace(CAST(l_extendedprice AS VARCHAR), '[.]0$', '')"
_ORDERS = f"""log AS (
  SELECT o.*, i.*, '{{"order":' || o_orderkey || ',"status":"' || o_orderstatus || '","items":[' || items || ']}}' AS val, CAST(o_custkey % 3 AS INT) AS part,
    row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) - 1 AS off
  FROM orders o JOIN (SELECT l_orderkey, string_agg('{{"sku":' || l_partkey || ',"price":' || {_PRICE} || '}}', ',' ORDER BY l_linenumber, l_partkey, l_extendedprice) AS items,
    list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_extendedprice) AS prices, list(l_partkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS skus FROM lineitem GROUP BY l_orderkey) i ON l_orderkey = o_orderkey)"""
_TALKS = """log AS (SELECT *, CAST(conv_id % 2 AS INT) AS part, row_number() OVER (PARTITION BY conv_id % 2 ORDER BY conv_id, turn) - 1 AS off FROM conversations)"""
_DOCS = """log AS (SELECT *, CAST(doc_id % 2 AS INT) AS part, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS off,
  CASE WHEN doc_id % 5 = 0 THEN unhex('FF') || encode(text) ELSE encode(text) END AS val FROM documents)"""
_LOGS = {"events": (derived.events, _EVENTS), "orders": (derived.orders, _ORDERS), "conversations": (derived.conversations, _TALKS), "documents": (derived.documents, _DOCS)}
_JSON = "CASE WHEN tomb THEN 'tombstone' ELSE 'pass' END"
_START, _END = 1705000000000, 1706000000000


def add(name: str, sql: str, topic: str = "events", **options) -> None:
    """A query over a derived log: part, off, action, payload as text. ``sql`` selects from ``log``."""
    make, cte = _LOGS[topic]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(LogQuery(topic, **options).validate(brokers=False).run(make(spark, sf_dir)))

    QUERIES[name], ORACLES[name] = run, f"WITH {cte} {sql}"


def query(name: str, sql: str | None, topic: str = "events"):
    def register(f: Callable[[SparkSession, str, DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, _LOGS[topic][0](spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH {_LOGS[topic][1]} {sql}"
        return f

    return register


def shown(out: DataFrame) -> DataFrame:
    return out.select(F.col("partition").alias("part"), F.col("offset").alias("off"), "action", F.col("payload").cast("string").alias("payload"))


def printed(name: str, sql: str, topic: str = "events", hexadecimal: bool = False, **options) -> None:
    """A query whose rendered bytes are its result, as text or hexadecimal."""
    make, cte = _LOGS[topic]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = LogQuery(topic, **options).validate(brokers=False).run(make(spark, sf_dir))
        line = F.hex("rendered") if hexadecimal else F.col("rendered").cast("string")
        return out.select(F.col("partition").alias("part"), F.col("offset").alias("off"), line.alias("line"))

    QUERIES[name], ORACLES[name] = run, f"WITH {cte} {sql}"


# sources, ranges, counts

_ALL = f"SELECT part, off, {_JSON} AS action, val AS payload FROM log"
add("scan_identity", _ALL)
add("select_partitions", f"{_ALL} WHERE part IN (0, 2, 3)", partitions=("0,2-3",))
add("range_beginning", _ALL, offsets=("beginning",))
add("range_absolute", f"{_ALL} WHERE off >= 20 AND off < 50", offsets=("20",), end_offset=50)
add("range_relative_end", f"SELECT part, off, action, payload FROM ({_ALL.replace(' FROM log', ', max(off) OVER (PARTITION BY part) AS last FROM log')}) WHERE off > last - 15", offsets=("-15",), snapshot=True)
_FIRST = "(SELECT part AS p, coalesce(min(off) FILTER (WHERE ms >= {0}), max(off) + 1) AS edge FROM log GROUP BY part)"
add("range_timestamp_start", f"{_ALL} JOIN {_FIRST.format(_START)} ON p = part WHERE off >= edge", offsets=(f"s@{_START}",))
add("range_timestamp_end", f"{_ALL} JOIN {_FIRST.format(_END)} ON p = part WHERE off < edge", offsets=(f"e@{_END}",))
add("range_empty", f"{_ALL} WHERE false", offsets=("end",), snapshot=True)
add("snapshot", _ALL, snapshot=True)
add("count_global", f"{_ALL} ORDER BY part, off LIMIT 100", count=100)
add("count_before_drops", "SELECT part, off, 'pass' AS action, val AS payload FROM (SELECT * FROM log ORDER BY part, off LIMIT 100) WHERE false", count=100, drop_if=("true",), on_invalid_json="drop", drop_tombstones=True)
add("count_per_partition", f"{_ALL} WHERE off < 10", count_per_partition=10)


@query("watermarks", "SELECT part, min(off) AS low, max(off) + 1 AS high FROM log GROUP BY part")
def _watermarks(spark, sf_dir, log):
    found = ranges.boundaries(log, ranges.Position("beginning"), ranges.Position("snapshot"))
    return found.select(F.col("partition").alias("part"), "low", "high")


@query("shard_assignment", "SELECT part, CAST(part % 3 AS INT) AS shard, count(*) AS records FROM log GROUP BY part")
def _shards(spark, sf_dir, log):
    dealt = [(p, i) for i, own in enumerate(ranges.shards(range(4), 3)) for p in own]
    return log.groupBy("partition").agg(F.count("*").alias("records")).join(F.broadcast(spark.createDataFrame(dealt, "partition int, shard int")), "partition").select(F.col("partition").alias("part"), "shard", "records")


@query("ordered_sequence", "SELECT part, off, row_number() OVER (PARTITION BY part ORDER BY off) - 1 AS sequence FROM log WHERE off % 3 = 0")
def _sequence(spark, sf_dir, log):
    return ranges.sequenced(log.where(F.col("offset") % 3 == 0)).select(F.col("partition").alias("part"), F.col("offset").alias("off"), "sequence")


@query("ordered_sequence_whole", "SELECT part, off, row_number() OVER (PARTITION BY part ORDER BY off) - 1 AS sequence FROM log")
def _sequence_whole(spark, sf_dir, log):
    return ranges.sequenced(log).select(F.col("partition").alias("part"), F.col("offset").alias("off"), "sequence")


# predicates and policies

_GOOD = "NOT tomb AND NOT bad"
_KEEP = "SELECT part, off, CASE WHEN tomb THEN 'tombstone' ELSE 'pass' END AS action, val AS payload FROM log WHERE NOT bad AND (tomb OR NOT ({0}))"
add("drop_if", _KEEP.format("event_type = 'click'"), drop_if=('type = "click"',), on_invalid_json="drop")
add("drop_if_chain", _KEEP.format("event_type = 'click' OR value >= 250 OR user_id < 10"), drop_if=('type = "click"', "amount >= 250", "user < 10"), on_invalid_json="drop")
add("drop_if_boolean", _KEEP.format("(event_type = 'view' AND value < 100) OR event_type = 'error'"), drop_if=('type = "view" and amount < 100 or type = "error"',), on_invalid_json="drop")
_TOMB = "SELECT part, off, CASE WHEN {0} THEN 'tombstone' ELSE 'pass' END AS action, CASE WHEN {0} THEN NULL ELSE val END AS payload FROM log WHERE NOT bad"
add("tombstone_if", _TOMB.format("tomb OR event_type = 'error'"), tombstone_if=('type = "error"',), on_invalid_json="drop")
add("tombstone_if_interpreted", _TOMB.format("tomb OR event_type IN ('view', 'error')"), tombstone_if=('$contains(type, /^v|rr/)',), on_invalid_json="drop")
add("drop_tombstones", "SELECT part, off, 'pass' AS action, val AS payload FROM log WHERE NOT tomb AND NOT bad AND event_type <> 'error'", tombstone_if=('type = "error"',), drop_tombstones=True, on_invalid_json="drop")
add("invalid_json_drop", f"{_ALL} WHERE NOT bad", on_invalid_json="drop")
add("invalid_json_tombstone", "SELECT part, off, CASE WHEN tomb OR bad THEN 'tombstone' ELSE 'pass' END AS action, CASE WHEN bad THEN NULL ELSE val END AS payload FROM log", on_invalid_json="tombstone")
add("invalid_json_pass", _ALL, on_invalid_json="pass")
add("eval_error_drop", f"{_ALL} WHERE tomb OR (NOT bad AND event_type <> 'view')", drop_if=('type = "view" ? "not a Boolean" : false',), on_invalid_json="drop", on_eval_error="drop")
add("eval_error_tombstone", _TOMB.format("tomb OR event_type = 'view'"), drop_if=('type = "view" ? missing : false',), on_invalid_json="drop", on_eval_error="tombstone")
add("policy_tombstone_survives_drop", "SELECT part, off, CASE WHEN bad THEN 'tombstone' ELSE 'pass' END AS action, CASE WHEN bad THEN NULL ELSE val END AS payload FROM log WHERE NOT tomb", on_invalid_json="tombstone", drop_tombstones=True)
_VARS = '{"statuses":["click","error"],"cutoff":200,"policy":{"click":true,"view":false,"purchase":true}}'
add("vars_in", _KEEP.format("event_type IN ('click', 'error')"), vars=_VARS, drop_if=("type in $vars.statuses",), on_invalid_json="drop")
add("vars_compare", _KEEP.format("value < 200"), vars=_VARS, drop_if=("amount < $vars.cutoff",), on_invalid_json="drop")
add("lookup_policy", _KEEP.format("event_type IN ('click', 'purchase')"), vars=_VARS, drop_if=("$lookup($vars.policy, type) = true",), on_invalid_json="drop")


@query("lookup_join", _KEEP.format("event_type IN ('click', 'purchase')").replace("WHERE NOT bad AND (tomb OR", "WHERE NOT tomb AND NOT bad AND (false OR"))
def _lookup_join(spark, sf_dir, log):
    valid = LogQuery("events", on_invalid_json="drop", drop_tombstones=True).acted(log).where("action = 'pass'")
    kept = membership.members(valid, membership.json_key("type"), spark.createDataFrame([("click",), ("purchase",)], "t string"), keep=False)
    return shown(kept)


# projections

_MADE = "SELECT part, off, CASE WHEN tomb THEN 'tombstone' ELSE 'project' END AS action, CASE WHEN tomb THEN NULL ELSE {0} END AS payload FROM log WHERE NOT bad"
_PLAIN = "SELECT part, off, 'project' AS action, {0} AS payload FROM log"
add("project_object", _MADE.format("""'{"id":' || event_id || ',"kind":"' || event_type || '","amount":' || amount || '}'"""), project='{"id": id, "kind": type, "amount": amount, "none": missing}', on_invalid_json="drop")
add("project_field", _MADE.format("CAST(event_id AS VARCHAR)"), project="id", on_invalid_json="drop")
add("project_conditional", _MADE.format("""'{"id":' || event_id || ',"size":"' || CASE WHEN value >= 200 THEN 'large' ELSE 'small' END || '"}'"""), vars=_VARS, project='{"id": id, "size": amount >= $vars.cutoff ? "large" : "small"}', on_invalid_json="drop")
add("project_coalesce", _MADE.format("""'{"owner":' || user_id || ',"team":"none"}'"""), project='{"owner": owner.name ?? owner.id ?? user, "team": team ?? "none"}', on_invalid_json="drop")
add("project_nested", _MADE.format("""'{"k":' || CAST(regexp_extract(props, '[0-9]+') AS VARCHAR) || '}'"""), project='{"k": props.k}', on_invalid_json="drop")
_SUM = "regexp_replace(CAST(round(list_sum({0}), 2) AS VARCHAR), '[.]0$', '')"
add("project_sum_items", _PLAIN.format("""'{"order":' || o_orderkey || ',"total":' || """ + _SUM.format("prices") + " || '}'"), "orders", project='{"order": order, "total": $round($sum(items.price), 2)}')
_TEXTS = "list_transform({0}, lambda x: regexp_replace(CAST(x AS VARCHAR), '[.]0$', ''))"
add("project_filter_array", f"SELECT part, off, 'project' AS action, CASE len(found) WHEN 0 THEN '{{}}' WHEN 1 THEN '{{\"skus\":' || found[1] || '}}' ELSE '{{\"skus\":[' || array_to_string(found, ',') || ']}}' END AS payload FROM (SELECT *, list_transform(list_filter(list_zip(skus, prices), lambda x: x[2] >= 50000), lambda x: CAST(x[1] AS VARCHAR)) AS found FROM log)", "orders", project='{"skus": items[price >= 50000].sku}')
add("project_sequence", "SELECT part, off, 'project' AS action, CASE WHEN len(p) = 1 THEN p[1] ELSE '[' || array_to_string(p, ',') || ']' END AS payload FROM (SELECT *, " + _TEXTS.format("prices") + " AS p FROM log)", "orders", project="items.price")
add("project_keep_array", "SELECT part, off, 'project' AS action, '[' || array_to_string(p, ',') || ']' AS payload FROM (SELECT *, " + _TEXTS.format("prices") + " AS p FROM log)", "orders", project="items.price[]")
add("project_index", "SELECT part, off, 'project' AS action, CAST(skus[-1] AS VARCHAR) AS payload FROM log", "orders", project="items[-1].sku")

# functions, by group

add("fn_arithmetic", _MADE.format("""'{"sum":' || (event_id + user_id * 2) || ',"rest":' || (event_id % 7) || ',"negative":' || (-event_id) || ',"half":' || regexp_replace(CAST(event_id / 2 AS VARCHAR), '[.]0$', '') || '}'"""), project='{"sum": id + user * 2, "rest": id % 7, "negative": -id, "half": id / 2}', on_invalid_json="drop")
add("fn_strings", _MADE.format("""'{"up":"' || upper(event_type) || '","n":' || length(event_type) || ',"cut":"' || substring(event_type, 2, 3) || '","tail":"' || right(event_type, 2) || '","pad":"' || lpad(CAST(event_id AS VARCHAR), 8, '0') || '","joined":"' || event_type || '-' || user_id || '","has":' || CAST(contains(event_type, 'i') AS VARCHAR) || '}'"""),
    project='{"up": $uppercase(type), "n": $length(type), "cut": $substring(type, 1, 3), "tail": $substring(type, -2), "pad": $pad($string(id), -8, "0"), "joined": type & "-" & user, "has": $contains(type, "i")}', on_invalid_json="drop")
add("fn_replace_split", _MADE.format("""'{"vowels":"' || regexp_replace(event_type, '[aeiou]', '*', 'g') || '","parts":["' || array_to_string(string_split(event_type, 'r'), '","') || '"],"back":"' || array_to_string(string_split(event_type, 'r'), '+') || '"}'"""),
    project='{"vowels": $replace(type, /[aeiou]/, "*"), "parts": $split(type, "r"), "back": $join($split(type, "r"), "+")}', on_invalid_json="drop")
add("fn_base64", _MADE.format("""'"' || base64(encode(event_type)) || event_type || '"'"""), project="$base64encode(type) & $base64decode($base64encode(type))", on_invalid_json="drop")
add("fn_numeric", _MADE.format("""'{"floor":' || CAST(floor(value) AS BIGINT) || ',"ceil":' || CAST(ceil(value) AS BIGINT) || ',"abs":' || abs(event_id - 500) || ',"base":"' || bin(event_id) || '","root":' || CAST(floor(sqrt(event_id)) AS BIGINT) || '}'"""),
    project='{"floor": $floor(amount), "ceil": $ceil(amount), "abs": $abs(id - 500), "base": $formatBase(id, 2), "root": $floor($sqrt(id))}', on_invalid_json="drop")
add("fn_aggregates", "SELECT part, off, 'project' AS action, '{\"n\":' || len(prices) || ',\"max\":' || regexp_replace(CAST(list_max(prices) AS VARCHAR), '[.]0$', '') || ',\"min\":' || regexp_replace(CAST(list_min(prices) AS VARCHAR), '[.]0$', '') || ',\"skus\":' || CAST(list_sum(skus) AS BIGINT) || '}' AS payload FROM log", "orders",
    project='{"n": $count(items), "max": $max(items.price), "min": $min(items.price), "skus": $sum(items.sku)}')
add("fn_higher_order", "SELECT part, off, 'project' AS action, '{\"twice\":[' || array_to_string(list_transform(skus, lambda x: 2 * x), ',') || '],\"odd\":' || len(list_filter(skus, lambda x: x % 2 = 1)) || ',\"folded\":' || CAST(list_sum(skus) + 7 AS BIGINT) || '}' AS payload FROM log", "orders",
    project='{"twice": [$map(items.sku, function($x) { 2 * $x })], "odd": $count($filter(items.sku, function($x) { $x % 2 = 1 })), "folded": $reduce(items.sku, function($a, $b) { $a + $b }, 7)}')
add("fn_sort", "SELECT part, off, 'project' AS action, '[' || array_to_string(list_sort(skus, 'DESC'), ',') || ']' AS payload FROM log", "orders", project="[items^(>sku).sku]")
add("fn_arrays", "SELECT part, off, 'project' AS action, '{\"back\":[' || array_to_string(list_reverse(skus), ',') || '],\"distinct\":' || len(list_distinct(skus)) || ',\"more\":' || (len(skus) + 2) || '}' AS payload FROM log", "orders",
    project='{"back": [$reverse([items.sku])], "distinct": $count($distinct([items.sku])), "more": $count($append(items.sku, [1, 2]))}')
add("fn_group_by", "SELECT part, off, 'project' AS action, '{\"even\":' || (CAST(coalesce(list_sum(list_filter(skus, lambda x: x % 2 = 0)), 0) AS BIGINT)) || ',\"odd\":' || (CAST(coalesce(list_sum(list_filter(skus, lambda x: x % 2 = 1)), 0) AS BIGINT)) || '}' AS payload FROM log", "orders",
    project='($g := items{sku % 2 = 0 ? "even" : "odd": $sum(sku)}; {"even": $g.even ?? 0, "odd": $g.odd ?? 0})')
add("fn_objects", _MADE.format("""'{"keys":["id","user","type","amount","props"],"merged":{"id":' || event_id || ',"k":' || regexp_extract(props, '[0-9]+') || '},"kind":"number"}'"""), project='{"keys": $keys($), "merged": $merge([{"id": id}, props]), "kind": $type(amount)}', on_invalid_json="drop")
add("fn_lambda_chain", _MADE.format("'\"' || upper(substring(event_type, 1, 1)) || substring(event_type, 2) || '\"'"), project='($title := function($s) { $uppercase($substring($s, 0, 1)) & $substring($s, 1) }; type ~> $title)', on_invalid_json="drop")
add("fn_transform", _MADE.format("""'{"id":' || event_id || ',"user":' || user_id || ',"type":"' || event_type || '","props":{"k":' || regexp_extract(props, '[0-9]+') || ',"seen":true}}'"""), project='$ ~> |props|{"seen": true}| ~> |$|{}, "amount"|', on_invalid_json="drop")
add("fn_time", _MADE.format("'\"' || strftime(make_timestamp(event_id * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z\"'"), project="$fromMillis(id * 1000)", on_invalid_json="drop")
add("fn_parent", "SELECT part, off, 'project' AS action, '[' || array_to_string(list_transform(skus, lambda x: CAST(x + o_orderkey AS VARCHAR)), ',') || ']' AS payload FROM log", "orders", project="[items.(sku + %.order)]")
add("fn_range_boolean", _MADE.format("""'{"n":' || (event_id % 5) || ',"any":' || CAST(event_id % 5 <> 0 AS VARCHAR) || ',"in":' || CAST(event_type IN ('view', 'click') AS VARCHAR) || '}'"""), project='{"n": $count([1..id % 5]), "any": $boolean(id % 5), "in": type in ["view", "click"]}', on_invalid_json="drop")

add("fn_case_trim", _MADE.format("""'{"low":"' || lower(event_type) || '","trim":"' || event_type || ' x","before":"' || CASE WHEN contains(event_type, 'i') THEN split_part(event_type, 'i', 1) ELSE event_type END || '","after":"' || CASE WHEN contains(event_type, 'i') THEN substring(event_type, strpos(event_type, 'i') + 1) ELSE event_type END || '"}'"""),
    project='{"low": $lowercase($uppercase(type)), "trim": $trim("  " & type & "   x "), "before": $substringBefore(type, "i"), "after": $substringAfter(type, "i")}', on_invalid_json="drop")
add("fn_urls", _MADE.format("""'{"part":"' || event_type || '%20%26%2F' || user_id || '","whole":"http://x/' || event_type || '?q=a%20b","back":" ' || event_type || '","also":"a b/' || event_type || '"}'"""),
    project='{"part": $encodeUrlComponent(type & " &/" & user), "whole": $encodeUrl("http://x/" & type & "?q=a b"), "back": $decodeUrlComponent("%20" & type), "also": $decodeUrl("a%20b/" & type)}', on_invalid_json="drop")
add("fn_numbers", _MADE.format("""'{"n":' || event_id || ',"square":' || (event_id % 10) * (event_id % 10) || ',"i":' || event_id || ',"mean":' || regexp_replace(CAST((event_id + user_id) / 2 AS VARCHAR), '[.]0$', '') || '}'"""),
    project='{"n": $number($string(id)), "square": $power(id % 10, 2), "i": $parseInteger($string(id), "0"), "mean": $average([id, user])}', on_invalid_json="drop")
add("fn_pictures", _MADE.format("""'{"money":"' || format('{:,}', event_id) || '.00","wide":"' || printf('%04d', event_id) || '"}'"""), project='{"money": $formatNumber(id, "#,##0.00"), "wide": $formatInteger(id, "0000")}', on_invalid_json="drop")
_VOWELS = "regexp_extract_all(event_type, '[aeiou]')"
add("fn_match_exists", _MADE.format(f"""'{{' || CASE len({_VOWELS}) WHEN 0 THEN '' WHEN 1 THEN '"vowels":"' || {_VOWELS}[1] || '",' ELSE '"vowels":["' || array_to_string({_VOWELS}, '","') || '"],' END || '"there":true,"gone":false,"not":' || CAST(value <= 100 AS VARCHAR) || '}}'"""),
    project='{"vowels": $match(type, /[aeiou]/).match, "there": $exists(props.k), "gone": $exists(props.z), "not": $not(amount > 100)}', on_invalid_json="drop")
add("fn_object_parts", _MADE.format("""'{"sifted":{' || CASE WHEN event_id % 2 = 0 THEN '"a":' || event_id || ',' ELSE '' END || '"z":0},"each":["a:' || event_id || '"],"spread":[{"a":' || event_id || '},{"b":' || user_id || '}]}'"""),
    project='{"sifted": $sift({"a": id, "z": 0}, function($v) { $v % 2 = 0 }), "each": [$each({"a": id}, function($v, $k) { $k & ":" & $v })], "spread": $spread({"a": id, "b": user})}', on_invalid_json="drop")
add("fn_single_zip_sort", "SELECT part, off, 'project' AS action, '{\"one\":' || skus[1] || ',\"zip\":[[1,\"a\"],[2,\"b\"]],\"up\":[' || array_to_string(list_sort(skus), ',') || '],\"down\":[' || array_to_string(list_reverse_sort(skus), ',') || ']}' AS payload FROM log", "orders",
    project='{"one": $single(items, function($x, $i) { $i = 0 }).sku, "zip": $zip([1..2], ["a", "b"]), "up": [$sort(items.sku)], "down": [$sort(items.sku, function($l, $r) { $l < $r })]}')
add("fn_eval_random", _MADE.format("""'{"sum":' || (event_id + 1) || ',"unit":true,"n":5,"t":15,"now":true,"late":true}'"""),
    project='{"sum": $eval("id + 1"), "unit": $random() < 1 and $random() >= 0, "n": $count($shuffle([1..5])), "t": $sum($shuffle([1..5])), "now": $toMillis($now()) = $millis(), "late": $millis() > 1600000000000}', on_invalid_json="drop")
add("fn_to_millis", _MADE.format("CAST(event_id * 1000 AS VARCHAR)"), project="$toMillis($fromMillis(id * 1000))", on_invalid_json="drop")
add("fn_partial", _MADE.format("CAST(event_id + user_id AS VARCHAR)"), project="($add := function($a, $b) { $a + $b }; $plus := $add(?, user); $plus(id))", on_invalid_json="drop")
add("fn_error_assert", _MADE.format("CAST(event_id AS VARCHAR)") + " AND (tomb OR event_type NOT IN ('view', 'click'))", project='($assert(type != "view", "a view"); type = "click" ? $error("a click") : id)', on_invalid_json="drop", on_eval_error="drop")
add("nav_wildcards", "SELECT part, off, 'project' AS action, '{\"all\":[' || array_to_string(flatten(list_transform(list_zip(skus, prices), lambda x: [CAST(x[1] AS VARCHAR), regexp_replace(CAST(x[2] AS VARCHAR), '[.]0$', '')])), ',') || '],\"deep\":[' || array_to_string(skus, ',') || '],\"top\":' || o_orderkey || '}' AS payload FROM log", "orders", project='{"all": [items.*], "deep": [**.sku], "top": [*][0]}')
add("nav_position", "SELECT part, off, 'project' AS action, '[' || array_to_string(list_transform(skus, lambda x, i: CAST(x + i - 1 AS VARCHAR)), ',') || ']' AS payload FROM log", "orders", project="[items#$i.(sku + $i)]")
add("nav_focus", "SELECT part, off, 'project' AS action, '[' || array_to_string(list_transform(skus, lambda x: '{\"s\":' || x || ',\"o\":' || o_orderkey || '}'), ',') || ']' AS payload FROM log", "orders", project='[items@$x.{"s": $x.sku, "o": order}]')

# output

printed("format_lengths", "SELECT part, off, 'events ' || part || ' ' || off || ' ' || ms || ' ' || length(CAST(user_id AS VARCHAR)) || ':' || user_id || ' ' || CASE WHEN tomb THEN 'tombstone' ELSE 'pass' END || ' ' || coalesce(strlen(val), -1) || '/' || coalesce(strlen(val), -1) || ' ' || coalesce(val, '') || chr(10) AS line FROM log", format="%t %p %o %T %K:%k %a %S/%L %s\\n")
printed("format_projected", f"SELECT part, off, CASE WHEN tomb THEN 'tombstone -1 -1 ' ELSE 'project ' || length(CAST(event_id AS VARCHAR)) || ' ' || strlen(val) || ' ' || event_id END || '%' AS line FROM log WHERE NOT bad", format="%a %S %L %s%%", project="id", on_invalid_json="drop")
printed("format_binary_len", "SELECT part, off, CASE WHEN tomb THEN 'FFFFFFFF' ELSE lpad(hex(strlen(val)), 8, '0') || hex(encode(val)) END AS line FROM log", hexadecimal=True, format="%R%s")
printed("format_headers", "SELECT part, off, 'source=events,empty=,none=NULL' AS line FROM log", format="%h")
printed("format_documents", "SELECT part, off, CAST(octet_length(val) AS VARCHAR) AS line FROM log", "documents", format="%S")
_QUOTED = "'\"' || replace(replace(replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't'), chr(12), chr(92) || 'f'), chr(8), chr(92) || 'b') || '\"'"
_BYTES = ",\"payloadEncoding\":\"utf8\",\"payloadLength\":"
printed("envelope_string", "SELECT part, off, '{\"topic\":\"conversations\",\"partition\":' || part || ',\"offset\":' || off || ',\"timestamp\":null,\"timestampType\":null,\"key\":\"' || conv_id || ':' || turn || '\",\"keyEncoding\":\"utf8\",\"keyLength\":' || length(conv_id || ':' || turn) || ',\"headers\":[],\"action\":\"pass\",\"payload\":' || " + _QUOTED.format("text") + " || '" + _BYTES + "' || strlen(text) || '}' || chr(10) AS line FROM log", "conversations", json_envelope=True)
_HEADERS = '[{"name":"source","value":"events","valueEncoding":"utf8","valueLength":6},{"name":"empty","value":"","valueEncoding":"utf8","valueLength":0},{"name":"none","value":null,"valueEncoding":null,"valueLength":-1}]'
printed("envelope_value", "SELECT part, off, '{\"topic\":\"events\",\"partition\":' || part || ',\"offset\":' || off || ',\"timestamp\":' || ms || ',\"timestampType\":\"createTime\",\"key\":\"' || user_id || '\",\"keyEncoding\":\"utf8\",\"keyLength\":' || length(CAST(user_id AS VARCHAR)) || ',\"headers\":" + _HEADERS + ",\"action\":' || CASE WHEN tomb THEN '\"tombstone\",\"payload\":null,\"payloadEncoding\":null,\"payloadLength\":-1}' ELSE '\"pass\",\"payload\":' || replace(val, '\": ', '\":') || ',\"payloadEncoding\":\"json\",\"payloadLength\":' || strlen(val) || '}' END || chr(10) AS line FROM log WHERE NOT bad", json_envelope=True, envelope_payload="value", on_invalid_json="drop")


@query("envelope_base64", "SELECT part, off, '\"payload\":\"' || base64(val) || '\",\"payloadEncoding\":\"base64\",\"payloadLength\":' || octet_length(val) || '}' AS line FROM log WHERE doc_id % 5 = 0", "documents")
def _base64(spark, sf_dir, log):
    out = LogQuery("documents", json_envelope=True).run(log)
    line = F.regexp_extract(F.col("rendered").cast("string"), r'("payload":"[^"]*","payloadEncoding":"base64".*)\n$', 1)
    return out.select(F.col("partition").alias("part"), F.col("offset").alias("off"), line.alias("line")).where("line <> ''")


printed("format_default", "SELECT part, off, coalesce(val, '') || chr(10) AS line FROM log")
printed("format_empty", "SELECT part, off, '' AS line FROM log", format="")


@query("ordered_output", "SELECT part, count(*) AS records, CAST(0 AS BIGINT) AS astray FROM log WHERE NOT bad GROUP BY part")
def _ordered(spark, sf_dir, log):
    """How many records of each partition come after one of a greater offset in their task's output."""
    import pyarrow as pa

    def count(batches):
        last, found = {}, {}
        for batch in batches:
            for p, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records, astray = found.get(p, (0, 0))
                found[p], last[p] = (records + 1, astray + (offset < last.get(p, -1))), offset
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([x[i] for x in found.values()], pa.int64()) for i in (0, 1))], names=["part", "records", "astray"])

    out = LogQuery("events", on_invalid_json="drop").ordered(log).select("partition", "offset")
    return out.mapInArrow(count, "part int, records long, astray long").groupBy("part").agg(F.sum("records").alias("records"), F.sum("astray").alias("astray"))


_STATS = """SELECT count(*) AS admitted, count(*) FILTER (WHERE tomb) AS input_tombstones, CAST(sum(strlen(val)) AS BIGINT) AS input_bytes, count(*) FILTER (WHERE bad OR (NOT tomb AND event_type = 'click')) AS dropped,
  count(*) FILTER (WHERE NOT tomb AND NOT bad AND event_type = 'error') AS generated_tombstones, CAST(0 AS BIGINT) AS passed, count(*) FILTER (WHERE NOT tomb AND NOT bad AND event_type NOT IN ('click', 'error')) AS projected,
  count(*) FILTER (WHERE bad) AS invalid_json, CAST(0 AS BIGINT) AS evaluation_failures, count(*) FILTER (WHERE tomb OR (NOT bad AND event_type <> 'click')) AS output_records,
  CAST(sum(CASE WHEN tomb OR (NOT bad AND event_type = 'error') THEN 1 WHEN NOT bad AND event_type <> 'click' THEN length(CAST(event_id AS VARCHAR)) + 1 END) AS BIGINT) AS output_bytes FROM log"""


@query("stats", _STATS)
def _stats(spark, sf_dir, log):
    q = LogQuery("events", drop_if=('type = "click"',), tombstone_if=('type = "error"',), project="id", on_invalid_json="drop")
    return stats.statistics(q.acted(log).withColumn("rendered", q.rendered_column()))


@query("fatal_prefix", "SELECT part, off, " + _JSON + " AS action, val AS payload FROM (SELECT *, min(CASE WHEN bad THEN off END) OVER (PARTITION BY part) AS first FROM log) WHERE first IS NULL OR off < first")
def _fatal(spark, sf_dir, log):
    return shown(before_failures(LogQuery("events", on_invalid_json="fail").acted(log)))


# the same through a log on disk, its data source, and streams


def _folder(spark: SparkSession, log: DataFrame) -> str:
    """The log in a new folder that driver and executors share. It stays, as the query's result is read from it later."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(shared or tempfile.gettempdir()).removeprefix('file://').rstrip('/')}/log-{uuid.uuid4().hex}"
    parquet_log.write(log, f"file://{path}", "overwrite")
    return path


@query("source_parquet", f"{_ALL} WHERE part = 1 AND off >= 5 AND off < 25")
def _parquet(spark, sf_dir, log):
    stored = parquet_log.read(spark, f"file://{_folder(spark, log)}")
    return shown(LogQuery("events", partitions=("1",), offsets=("5",), end_offset=25).run(stored))


@query("source_datasource", f"{_ALL} WHERE part IN (0, 3) AND off >= 5 AND off < 25")
def _datasource(spark, sf_dir, log):
    parquet_log.register(spark)
    stored = spark.read.format("sievelog").options(path=_folder(spark, log), partitions="[0,3]", start="5", end="25").load()
    return shown(LogQuery("events").run(stored))


@query("source_parquet_whole", _ALL)
def _parquet_whole(spark, sf_dir, log):
    return shown(LogQuery("events").run(parquet_log.read(spark, f"file://{_folder(spark, log)}")))


@query("source_datasource_whole", _ALL)
def _datasource_whole(spark, sf_dir, log):
    parquet_log.register(spark)
    return shown(LogQuery("events").run(spark.read.format("sievelog").options(path=_folder(spark, log)).load()))


def _streamed(spark: SparkSession, q: LogQuery, log: DataFrame) -> DataFrame:
    """The records that a bounded streaming run writes, read back."""
    parquet_log.register(spark)
    path = _folder(spark, log)
    stream = spark.readStream.format("sievelog").options(path=path).load()

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"file://{path}-out/batch={number}")

    running = streaming.start(q, stream, write, f"file://{path}-state")
    running.awaitTermination()
    return shown(spark.read.parquet(f"file://{path}-out"))


@query("stream_available_now", _MADE.format("CAST(event_id AS VARCHAR)"))
def _available(spark, sf_dir, log):
    return _streamed(spark, LogQuery("events", exit_at_end=True, project="id", on_invalid_json="drop"), log)


@query("stream_count_per_partition", f"{_ALL} WHERE off < 7")
def _stream_count(spark, sf_dir, log):
    return _streamed(spark, LogQuery("events", exit_at_end=True, count_per_partition=7), log)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: a filter, a tombstone rule and a projection over the event log, rendered as lines."""
    q = LogQuery("events", vars=_VARS, drop_if=('type = "view" and amount < 100',), tombstone_if=('type = "error"',), project='{"id": id, "kind": type, "size": amount >= $vars.cutoff ? "large" : "small"}', format="%p\\t%o\\t%K\\t%L\\t%a\\t%s\\n", on_invalid_json="drop")
    out = q.validate(brokers=False).run(derived.events(spark, sf_dir))
    return out.select("partition", "offset", "action", F.col("rendered").cast("string").alias("line"))
