import io
import os
import signal
import threading
import time
from itertools import groupby

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievelog.operators import ranges, render, stats
from sievelog.operators.transform import PlanError, Policies, TransformPlan, Worker, before_failures, transform
from sievelog.plans.cli import main
from sievelog.plans.query import LogQuery, OptionError, parse_duration, parse_properties, parse_size
from sievelog.plans.sink import to_stream
from sievelog.schema import RECORD
from sievelog.sources import derived, kafka, parquet_log
from sievelog.streaming import run as streaming


SF = "/root/testdata/sf0.001"


def records(spark, *values, partition=0, topic="events"):
    from datetime import UTC, datetime

    rows = [(topic, partition, i, datetime.fromtimestamp((i + 1) / 10, UTC), 0, b"k", [("a", b"1"), ("empty", b""), ("none", None)], v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RECORD)


def run(payload, **plan):
    policies = Policies(plan.pop("invalid", "fail"), plan.pop("evaluation", "fail"))
    return Worker(TransformPlan(policies=policies, **plan)).execute(payload)


# transforms

SENSOR = b'{"sensor":"t-7","reading":{"celsius":21.50,"ok":true},"tags":["roof","north"]}'


def outcome(plan, payload=SENSOR):
    return run(payload, **plan)[:2]


class TestOrderOfActions:
    """A record takes the first action that holds: its own absence, then drops, tombstones, the projection."""

    def test_without_expressions_bytes_stay(self):
        assert outcome({}) == ("pass", SENSOR) and outcome({}, b"") == ("pass", b"") and outcome({}, b"\xfe\x00") == ("pass", b"\xfe\x00")

    def test_no_payload_is_never_read(self):
        everything = {"drops": ("$assert(false)",), "tombstones": ("1",), "projection": "nothing.here"}
        assert outcome(everything, None) == ("tombstone", None)
        assert outcome(everything | {"drop_tombstones": True}, None) == ("drop", None)

    @pytest.mark.parametrize("held", range(4))
    def test_first_predicate_that_holds_decides(self, held):
        # whatever stands behind it would fail
        tests = ["reading.ok" if i == held else "reading.celsius > 40" if i < held else "$error('read too far')" for i in range(4)]
        assert outcome({"drops": tuple(tests), "projection": "$error('read too far')"}) == ("drop", None)
        assert outcome({"tombstones": tuple(tests), "projection": "$error('read too far')"}) == ("tombstone", None)

    def test_drops_come_before_tombstones(self):
        both = {"drops": ('sensor = "t-7"',), "tombstones": ("reading.ok",)}
        assert outcome(both) == ("drop", None) and outcome(both | {"drops": ('sensor = "t-8"',)}) == ("tombstone", None)

    @pytest.mark.parametrize("cold", [True, False])
    def test_tombstones_can_be_dropped_and_the_rest_projected(self, cold):
        plan = {"tombstones": (f"reading.celsius {'<' if cold else '>'} 100",), "projection": "tags[0]"}
        assert outcome(plan) == (("tombstone", None) if cold else ("project", b'"roof"'))
        assert outcome(plan | {"drop_tombstones": True}) == (("drop", None) if cold else ("project", b'"roof"'))

    def test_projections(self):
        made = {"reading.celsius": b"21.5", "nothing ?? null": b"null", "tags": b'["roof","north"]', "[tags, nothing]": b'["roof","north"]', '{"n": $count(tags), "no": nothing}': b'{"n":2}', "36028797018963969": b"36028797018963970"}
        assert {source: outcome({"projection": source}) for source in made} == {source: ("project", text) for source, text in made.items()}

    def test_variables(self):
        plan = {"variables": '{"alarm":{"celsius":20},"site":"harbour"}', "drops": ("reading.celsius <= $vars.alarm.celsius",), "projection": '$vars.site & "/" & sensor & $vars.unset'}
        assert outcome(plan) == ("project", b'"harbour/t-7"')
        assert outcome(plan, b'{"reading":{"celsius":3}}') == ("drop", None)


@pytest.mark.parametrize(("source", "kind"), [("nothing", "Undefined"), ("tags", "array"), ("reading", "object"), ("sensor", "string"), ("reading.celsius", "number"), ("null", "null"), ("$count", "function")])
def test_predicates_are_booleans(source, kind):
    for place, number in (("drops", 1), ("tombstones", 2)):
        action, _, _, issue, error = run(SENSOR, **{place: ("false",) * (number - 1) + (source,)})
        assert (action, issue) == ("fail", "Evaluation")
        assert error == f"{place[:-1]} predicate #{number} evaluation error: result must be a Boolean, received {kind}"


@pytest.mark.parametrize("source", ["$count", "/no+rth/", "tags.($uppercase)", '{"deep": [{"f": $count}]}', "nothing", '$error("no reading")', "sensor * 2"])
def test_projections_are_json(source):
    assert run(SENSOR, projection=source)[4].startswith("projection evaluation error: ")
    for policy in ("drop", "tombstone"):
        assert run(SENSOR, projection=source, evaluation=policy, drop_tombstones=True)[0] == policy


@pytest.mark.parametrize("payload", [b'{"sensor":', b"\xc3\x28", b"'t-7'", b"", b"1 2"])
def test_invalid_json(payload):
    for policy in ("fail", "drop", "tombstone", "pass"):
        out = run(payload, force_json=True, invalid=policy, drop_tombstones=True)
        assert (out[0], out[1], out[3]) == (policy, payload if policy == "pass" else None, "InvalidJson")
        assert (out[4] or "invalid JSON: ").startswith("invalid JSON: ")


def test_compact_pass_keeps_source_length():
    spaced = SENSOR.replace(b":", b" : ")
    assert Worker(TransformPlan(force_json=True), embeds_json=True).execute(spaced)[:3] == ("pass", SENSOR.replace(b"21.50", b"21.5"), len(spaced))


def test_plan_validation():
    with pytest.raises(PlanError, match="tombstone predicate #2 JSONata parse error"):
        TransformPlan(tombstones=("reading.ok", "reading.ok ==")).validate()
    for bad in ("[1]", "7", "", "{'a':1}"):
        with pytest.raises(PlanError):
            TransformPlan(variables=bad).validate()


VALUES = [
    b'{"id":1,"type":"a","amount":2.5,"nested":{"k":1}}', b'{"id":2,"type":"b","amount":300}', b'{"id":3,"type":null}', b'{"id":"4","type":["a"],"amount":"x"}', b"{}", b'{"type":true,"amount":-1e300,"id":1e21}',
    b"[1]", b"", b"nope", b'{"id":1} x', b'{"id":1,"id":2}', None, b'{"type":"\\u00e9\\n\\u0001","id":0.1,"amount":7}', b' {"id":12345678901234567890,"type":"a"} ', b'{"id":0.00001,"type":""}', b'{"nested":[{"k":1},{"k":2}]}', b"\xff{}", b'"text"',
]


@pytest.mark.parametrize("plan", [
    {"drops": ('type = "a"',)}, {"drops": ('type != "a" and amount > 3 or id = 2',)}, {"drops": ("amount >= 3",)}, {"tombstones": ('type in ["a", "b", true]',)}, {"projection": "id"}, {"projection": "nested.k"}, {"projection": "type"},
    {"projection": '{"id": id, "kind": type ?? "none", "big": amount > 100 ? true : false, "k": nested.k}'}, {"drops": ("$exists(nested)", "$not(type)"), "projection": "amount"}, {"variables": '{"t":"a"}', "drops": ("type = $vars.t",), "projection": '{"t": $vars.t, "no": $vars.no}'},
])
def test_native_tier_equals_interpreter(spark, plan):
    log = records(spark, *VALUES)
    for policies in (Policies("drop", "tombstone"), Policies("fail", "fail")):
        both = [sorted(map(tuple, transform(log, TransformPlan(policies=policies, **plan), native=native).select("offset", "action", "payload", "payload_length", "issue", "error").collect()), key=lambda r: r[0]) for native in (True, False)]
        assert both[0] == both[1]


def test_identity_has_no_python(spark):
    plan = LogQuery("events").run(records(spark, b"x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    native = LogQuery("events", drop_if=('type = "a"',), on_invalid_json="drop")
    fast, _ = __import__("sievelog.functions.native", fromlist=["x"]).native_action(native.plan(), False, records(spark, b"{}"))[:2]
    assert fast is not None


def test_empty_log(spark):
    log = records(spark, b"{}").where("false")
    assert LogQuery("events", project="id", on_invalid_json="drop").run(log).count() == 0


# ranges


def offsets_of(query, log):
    return [r.offset for r in query.admitted(log).orderBy("offset").collect()]


@pytest.mark.parametrize(("options", "expected"), [
    ({"offsets": ("1",), "end_offset": 3}, [1, 2]), ({"offsets": ("-2",), "snapshot": True}, [2, 3]), ({"offsets": ("end",), "snapshot": True}, []), ({"offsets": ("s@9999",), "snapshot": True}, []),
    ({"offsets": ("e@9999",)}, [0, 1, 2, 3]), ({"offsets": ("s@200", "e@400")}, [1, 2]), ({"count": 2}, [0, 1]), ({"count_per_partition": 1}, [0]), ({"partitions": ("1",)}, []),
])
def test_ranges(spark, options, expected):
    assert offsets_of(LogQuery("events", **options), records(spark, b"a", b"b", b"c", b"d")) == expected


@pytest.mark.parametrize("start", ["0", "2", "8"])
def test_start_outside_of_the_log_fails(spark, start):
    log = records(spark, *[b"x"] * 7).where("offset >= 3")
    for edges in (None, spark.createDataFrame([(0, 3, 7)], "partition int, low long, high long")):
        with pytest.raises(Exception, match="offset error: partition 0 holds 3 to 7"):
            LogQuery("events", offsets=(start,), on_kafka_error="continue").admitted(log, edges).collect()
    assert offsets_of(LogQuery("events", offsets=("7",)), log) == [] and offsets_of(LogQuery("events", offsets=("3",)), log) == [3, 4, 5, 6]


def test_edges_spare_the_log(spark):
    log = records(spark, *[b"x"] * 7)
    unread = log.withColumn("offset", F.raise_error(F.lit("read")).cast("long"))
    edges = spark.createDataFrame([(0, 0, 7)], "partition int, low long, high long")
    found = ranges.boundaries(unread, ranges.Position("before_end", 2), ranges.Position("snapshot"), edges)
    assert [tuple(r) for r in found.collect()] == [(0, 0, 7, 5, 7)]
    assert offsets_of_edges(log, edges) == [5, 6]


def offsets_of_edges(log, edges):
    return sorted(r.offset for r in LogQuery("events", offsets=("-2",), snapshot=True).admitted(log, edges).collect())


def test_partition_selection():
    assert ranges.parse_partitions(["3-5 ,1", " 9", "+7"]) == [3, 4, 5, 1, 9, 7]
    for bad, said in (("5-3", "ascend"), ("1,,2", "neither"), ("4,2-6", "partition 4 is there twice"), ("7-200000", "can be read at once"), ("-3", "neither"), ("two", "neither"), ("", "neither"), ("4294967296", "ascend")):
        with pytest.raises(ValueError, match=said):
            ranges.parse_partitions([bad])
    with pytest.raises(ValueError, match="'a' .*'9-8' .*partition 1 is there twice"):
        ranges.parse_partitions(["a,9-8,1,1"])
    assert ranges.shards([4, 5, 6, 7, 8], 2) == [[4, 6, 8], [5, 7]] and ranges.shards([1, 2], 5) == [[1], [2]]


def test_positions():
    P = ranges.Position
    assert ranges.parse_positions([]) == (P("beginning"), None) and ranges.parse_positions(["end"], 9) == (P("end"), P("offset", 9))
    assert ranges.parse_positions(["e@20", "s@+10"]) == (P("timestamp", 10), P("timestamp", 20)) and ranges.parse_positions(["-0"]) == (P("offset", 0), None)
    with pytest.raises(ValueError, match="'soon' .*2 start positions.*2 end positions"):
        ranges.parse_positions(["soon", "4", "-4", "e@1"], 8)


def test_discovery(spark):
    log = records(spark, b"a").union(records(spark, b"b", partition=4)).union(records(spark, b"c", partition=9, topic="other"))
    assert ranges.discovered(log, "events") == [0, 4]
    with pytest.raises(ValueError, match="no partition of 'orders'"):
        ranges.discovered(log, "orders")


def test_counts_are_of_input(spark):
    assert LogQuery("events", count=1, drop_if=("true",)).run(records(spark, b"{}", b"{}")).count() == 0


def test_prefix_before_failure(spark):
    acted = LogQuery("events", on_invalid_json="fail").acted(records(spark, b"1", b"x", b"2"))
    assert [r.offset for r in before_failures(acted).collect()] == [0]
    with pytest.raises(Exception, match="events/0/1: invalid JSON"):
        LogQuery("events", on_invalid_json="fail").run(records(spark, b"1", b"x", b"2")).collect()


# rendering


def rendered(df, column):
    return [bytes(r[0]) for r in df.select(column).collect()]


def test_format(spark):
    log = records(spark, b"r", b"s\xff").withColumns({"action": F.lit("project"), "payload": F.concat("value", "value")})
    out = rendered(log.orderBy("offset"), render.format_column("\\x7b%o@%t-%p \\\\%k%K %s/%S/%L %T%%%h\\r\\n%a}"))
    assert out == [b"{0@events-0 \\k1 rr/2/1 100%a=1,empty=,none=NULL\r\nproject}", b"{1@events-0 \\k1 s\xffs\xff/4/2 200%a=1,empty=,none=NULL\r\nproject}"]
    assert rendered(log, render.format_column("")) == [b"", b""]


def test_lengths(spark):
    df = spark.createDataFrame([(0, None), (1, b""), (2, b"null")], "i int, payload binary").withColumn("value", F.col("payload"))
    assert rendered(df.orderBy("i"), render.format_column("%R%S%s")) == [b"\xff\xff\xff\xff-1", b"\0\0\0\x000", b"\0\0\0\x044null"]


@pytest.mark.parametrize("bad", ["%z", "%", "\\q", "\\x0g", "\\x0"])
def test_bad_formats(bad):
    with pytest.raises(render.FormatError):
        render.parse_format(bad)


def test_envelope(spark):
    log = records(spark, None).withColumns({"key": F.lit(b"\xff"), "action": F.lit("tombstone"), "payload": F.col("value"), "payload_length": F.lit(None).cast("long"), "headers": F.expr("array(struct('trace' as key, X'FF' as value))")})
    line = log.select(render.envelope_column()).first()[0]
    assert line == '{"topic":"events","partition":0,"offset":0,"timestamp":100,"timestampType":"createTime","key":"/w==","keyEncoding":"base64","keyLength":1,"headers":[{"name":"trace","value":"/w==","valueEncoding":"base64","valueLength":1}],"action":"tombstone","payload":null,"payloadEncoding":null,"payloadLength":-1}\n'
    q = LogQuery("events", project='{"id": id}', json_envelope=True, envelope_payload="value")
    assert b'"payload":{"id":1},"payloadEncoding":"json","payloadLength":8}' in rendered(q.run(records(spark, b'{"id":1, "x":2}')), "rendered")[0]


def test_json_string_column(spark):
    df = spark.createDataFrame([('"\\\n\t\r\b\f\x01\x1f\x7fé',)], "s string")
    assert df.select(render.json_string(F.col("s"))).first()[0] == '"\\"\\\\\\n\\t\\r\\b\\f\\u0001\\u001f\x7fé"'


def test_stats(spark):
    q = LogQuery("events", project="id", on_invalid_json="drop")
    row = stats.statistics(q.acted(records(spark, b'{"id":1}', None, b"x")).withColumn("rendered", q.rendered_column())).first().asDict()
    assert row == {"admitted": 3, "input_tombstones": 1, "input_bytes": 9, "dropped": 1, "generated_tombstones": 0, "passed": 0, "projected": 1, "invalid_json": 1, "evaluation_failures": 0, "output_records": 2, "output_bytes": 3}


# options


@pytest.mark.parametrize("options", [
    {"topic": ""}, {"count": 0}, {"count_per_partition": 0}, {"count": 1, "count_per_partition": 1}, {"jobs": 0}, {"jobs": 1025}, {"consumers": 0}, {"consumers": 129}, {"max_inflight_records": 0}, {"max_inflight_bytes": "0"}, {"max_inflight_per_partition": 9000},
    {"snapshot": True, "end_offset": 1}, {"end_offset": -1}, {"offsets": ("1", "2")}, {"offsets": ("e@1",), "end_offset": 1}, {"offsets": ("x",)}, {"offsets": ("s@-1",)}, {"json_envelope": True, "format": "%s"}, {"envelope_payload": "value"},
    {"json_envelope": True, "envelope_payload": "value", "on_invalid_json": "pass"}, {"vars": "{}", "vars_file": "x"}, {"format": "%z"}, {"project": "1 +"}, {"stats_interval": "0ms"}, {"brokers": None}, {"brokers": "a,,b"}, {"properties": ("enable.auto.commit=true",)}, {"properties": ("x",)},
])
def test_option_errors(options):
    with pytest.raises(ValueError):
        LogQuery(**{"topic": "t", "brokers": "localhost:9092"} | options).validate()


def test_option_parsing():
    assert parse_size("2MiB") == 2 << 20 and parse_duration("5s") == 5000
    with pytest.raises(OptionError):
        parse_size("1MB")
    assert parse_properties("# c\n\n a = b \n") == {"a": "b"}
    assert LogQuery("t", properties=("bootstrap.servers=x", "a= b ")).kafka_properties() == {"bootstrap.servers": "x", "a": " b "}


def test_problems_come_together():
    found = list(LogQuery("", count=0, consumers=200, offsets=("soon",), format="%z", max_inflight_bytes="3 apples", project="1 +", envelope_payload="value").problems(brokers=True))
    assert len(found) == 9 and all(any(word in line for line in found) for word in ("topic", "count is 0", "consumers is 200", "'soon'", "%z", "apples", "projection", "json_envelope", "brokers"))


def test_columns_fetched_for_the_output():
    wanted = lambda **options: kafka.options(LogQuery("t", brokers="b:1", **options))["includeHeaders"]
    assert [wanted(), wanted(format="%o %k"), wanted(format="%h"), wanted(json_envelope=True)] == ["false", "false", "true", "true"]
    assert kafka.options(LogQuery("t", brokers="b:1", offsets=("end",), snapshot=True))["startingOffsets"] == "earliest"
    assert kafka.options(LogQuery("t", brokers="b:1", offsets=("end",)), streaming=True)["startingOffsets"] == "latest"


def test_kafka_options():
    out = kafka.options(LogQuery("t", brokers="b:1", partitions=("0-1",), offsets=("5", "e@9")))
    assert out["assign"] == '{"t": [0, 1]}' and out["startingOffsets"] == '{"t": {"0": 5, "1": 5}}' and out["endingTimestamp"] == "9" and out["failOnDataLoss"] == "true"
    assert kafka.options(LogQuery("t", brokers="b:1", offsets=("s@7",), on_kafka_error="continue"))["failOnDataLoss"] == "false"


# sources and sinks


def test_command_line_writes_what_precedes_a_failure(spark, tmp_path, capsys):
    log = records(spark, b"1", b"x", b"2").union(records(spark, b"3", b"4", partition=1))
    parquet_log.write(log, f"file://{tmp_path}/log")
    out, argv = io.BytesIO(), ["-t", "events", "--log", f"file://{tmp_path}/log", "--project", "$ * 10", "-f", "%p:%s ", "-e", "--stats"]
    assert main(argv, out, spark) == 1 and out.getvalue() == b"0:10 1:30 1:40 "
    said = capsys.readouterr().err
    assert "events/0/1: invalid JSON" in said and "admitted=5 " in said and "invalid_json=1 " in said
    out = io.BytesIO()
    assert main([*argv, "--on-invalid-json", "drop", "-q"], out, spark) == 0 and out.getvalue() == b"0:10 0:20 1:30 1:40 " and capsys.readouterr().err == ""
    assert main(["-t", "unheard", "--log", f"file://{tmp_path}/log", "-e"], io.BytesIO(), spark) == 1 and "unheard" in capsys.readouterr().err
    # kept results go with the run
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [f for f in os.listdir(shared) if f.startswith("sievelog-")]


@pytest.mark.parametrize("n", [signal.SIGINT, signal.SIGTERM])
def test_signals_end_a_follower_after_its_batch(spark, tmp_path, n):
    parquet_log.write(records(spark, b"a", b"b"), f"file://{tmp_path}/log")
    out = io.BytesIO()

    def told():
        until = time.monotonic() + 60
        while out.getvalue() != b"a\nb\n" and time.monotonic() < until:
            time.sleep(0.1)
        os.kill(os.getpid(), n)

    threading.Thread(target=told, daemon=True).start()
    before = signal.getsignal(n)
    assert main(["-t", "events", "--log", f"{tmp_path}/log"], out, spark) == 128 + n and out.getvalue() == b"a\nb\n"
    assert signal.getsignal(n) == before


def test_signals_cancel_a_batch(spark, tmp_path):
    parquet_log.write(records(spark, *[b"{}"] * 200), f"file://{tmp_path}/log")
    threading.Timer(5, lambda: os.kill(os.getpid(), signal.SIGTERM)).start()
    slow, out = "$sum([1..2000].($sum([1..2000])))", io.BytesIO()
    assert main(["-t", "events", "--log", f"{tmp_path}/log", "--project", slow, "-e"], out, spark) == 143 and out.getvalue() == b""


def test_stored_log_and_command_line(spark, tmp_path):
    log = records(spark, b'{"id":1}', b'{"id":2}', None).union(records(spark, b'{"id":3}', partition=1))
    parquet_log.write(log, f"file://{tmp_path}/log")
    parquet_log.register(spark)
    read = spark.read.format("sievelog").options(path=f"{tmp_path}/log", partitions="[0]", start="1").load()
    assert sorted((r.offset, r.value and bytes(r.value), len(r.headers)) for r in read.collect()) == [(1, b'{"id":2}', 3), (2, None, 3)]
    out = io.BytesIO()
    assert main(["-t", "events", "--log", f"file://{tmp_path}/log", "--project", "id", "-f", "%p:%o:%S:%s\\n", "-o", "-2", "--snapshot"], out, spark) == 0
    assert out.getvalue() == b"0:1:1:2\n0:2:-1:\n1:0:1:3\n"
    assert main(["-t", "events", "--log", "x", "--project", "1 +"]) == 2
    assert main(["-t", "events", "--log", "x", "--check"]) == 0
    buffer = io.BytesIO()
    assert to_stream(LogQuery("events").ordered(records(spark, b"a", b"b")), buffer) == 4 and buffer.getvalue() == b"a\nb\n"


def test_sequence_is_dense_whatever_the_gaps(spark):
    log = records(spark, *[b"x"] * 6).where("offset in (1, 4, 5)").union(records(spark, b"y", partition=1))
    assert sorted((r.partition, r.offset, r.sequence) for r in ranges.sequenced(log).collect()) == [(0, 1, 0), (0, 4, 1), (0, 5, 2), (1, 0, 0)]


@pytest.mark.parametrize("span", [1, 2, 7])
def test_sequence_over_spans(spark, span):
    log = records(spark, *[b"x"] * 30).where("offset % 3 != 1 and offset > 4").union(records(spark, *[b"y"] * 5, partition=1))
    found = sorted((r.partition, r.offset, r.sequence) for r in ranges.sequenced(log, span).collect())
    places = [[o for o in range(30) if o % 3 != 1 and o > 4], list(range(5))]
    assert found == [(p, o, i) for p, own in enumerate(places) for i, o in enumerate(own)]


def test_large_counts_end_within_a_partition(spark, monkeypatch):
    log = records(spark, *[b"x"] * 4).union(records(spark, *[b"y"] * 5, partition=1)).union(records(spark, b"z", partition=2))
    for count in (1, 4, 6, 9, 10, 50):
        monkeypatch.setattr(ranges, "MOST_SORTED", 100)
        few = sorted((r.partition, r.offset) for r in ranges.first_records(log, count).collect())
        monkeypatch.setattr(ranges, "MOST_SORTED", 0)
        assert sorted((r.partition, r.offset) for r in ranges.first_records(log, count).collect()) == few and len(few) == min(count, 10)


# streams


def streamed(spark, path, state, **options):
    parquet_log.register(spark)
    found = []
    stream = spark.readStream.format("sievelog").options(path=path).load()
    query = LogQuery("events", **options)
    running = streaming.start(query, stream, lambda df, n: found.extend((r.partition, r.offset) for r in df.collect()), f"file://{state}", stored=parquet_log.read(spark, f"file://{path}"))
    running.processAllAvailable() if not query.bounded else running.awaitTermination()
    running.stop()
    return sorted(found)


@pytest.mark.parametrize(("options", "expected"), [
    ({"offsets": ("-2",), "snapshot": True}, [(0, 3), (0, 4), (1, 0)]), ({"offsets": ("-2",)}, [(0, 3), (0, 4), (1, 0)]), ({"offsets": ("end",)}, []),
    ({"offsets": ("s@250", "e@450")}, [(0, 2), (0, 3)]), ({"offsets": ("e@200",)}, [(0, 0), (1, 0)]), ({"offsets": ("s@9999",), "exit_at_end": True}, []), ({"offsets": ("3",), "end_offset": 4}, [(0, 3)]),
])
def test_stream_positions(spark, tmp_path, options, expected):
    parquet_log.write(records(spark, b"a", b"b", b"c", b"d", b"e").union(records(spark, b"f", partition=1)), f"file://{tmp_path}/log")
    assert streamed(spark, f"{tmp_path}/log", f"{tmp_path}/state", **options) == expected


def test_restart_keeps_the_first_boundaries(spark, tmp_path):
    log = records(spark, b"a", b"b", b"c", b"d", b"e")
    parquet_log.write(log.where("offset < 2"), f"file://{tmp_path}/log")
    assert streamed(spark, f"{tmp_path}/log", f"{tmp_path}/state", offsets=("-1",)) == [(0, 1)]
    parquet_log.write(log.where("offset >= 2"), f"file://{tmp_path}/log", "append")
    assert streamed(spark, f"{tmp_path}/log", f"{tmp_path}/state", offsets=("-1",)) == [(0, 2), (0, 3), (0, 4)]
    with pytest.raises(ValueError):
        streaming.start(LogQuery("events", offsets=("-1",)), None, None, "unused")


def test_command_line_follows(spark, tmp_path, capsys):
    log, out, codes = records(spark, b"a", b"b", b"c", b"d", b"e"), io.BytesIO(), []
    parquet_log.write(log.where("offset < 3"), f"file://{tmp_path}/log")
    argv = ["-t", "events", "--log", f"{tmp_path}/log", "-o", "-2", "-c", "3", "-f", "%o%s ", "--stats-interval", "200ms"]
    running = threading.Thread(target=lambda: codes.append(main(argv, out, spark)), daemon=True)
    running.start()
    until = time.monotonic() + 60
    while out.getvalue() != b"1b 2c " and time.monotonic() < until:
        time.sleep(0.1)
    assert out.getvalue() == b"1b 2c " and running.is_alive()
    time.sleep(1)
    parquet_log.write(log.where("offset >= 3"), f"file://{tmp_path}/log", "append")
    running.join(60)
    assert codes == [0] and out.getvalue() == b"1b 2c 3d "
    said = capsys.readouterr().err.splitlines()
    assert sum("admitted=2 " in line for line in said) >= 2 and "admitted=3 " in said[-1]


# larger logs: no task holds a partition of one


@pytest.fixture
def spread(spark, monkeypatch):
    """Small spans, and as many tasks as for large tables; gives the most records of a log in one task."""
    monkeypatch.setattr(ranges, "SPAN", 16, raising=False)
    options = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    yield lambda log: max(r.n for r in log.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("offset")).collect())
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("topic", ["events", "orders", "conversations", "documents"])
def test_derived_logs_are_numbered_by_many_tasks(spark, spread, topic):
    log = getattr(derived, topic)(spark, SF)
    held = {p: sorted(r.offset for r in rows) for p, rows in groupby(sorted(log.select("partition", "offset").collect(), key=lambda r: r.partition), lambda r: r.partition)}
    assert all(found == list(range(len(found))) for found in held.values())
    assert spread(log) < min(map(len, held.values()))


def test_numbers_of_any_order(spark):
    rows = [(0, 7, 2), (0, 7, 1), (0, -40, 5), (0, None, 0), (0, 7, None), (None, 3, 3), (None, -3, 3), (-1, 2**62, 0)]
    found = ranges.numbered(spark.createDataFrame(rows, "partition int, a long, b int"), ["a", "b"], "at", 4)
    assert {tuple(r)[:3]: r["at"] for r in found.collect()} == dict(zip(rows, [2, 1, 0, 4, 3, 1, 0, 0], strict=True))


def test_stored_logs_are_written_and_read_by_many_tasks(spark, spread, tmp_path, monkeypatch):
    log = derived.events(spark, SF)
    parquet_log.write(log, f"file://{tmp_path}/log")
    whole = {p: high for p, (low, high) in parquet_log._offsets(f"{tmp_path}/log").items()}
    assert sum(whole.values()) == log.count() and max(pq.read_metadata(f).num_rows for f in tmp_path.glob("log/*/*.parquet")) < min(whole.values())
    monkeypatch.setattr(parquet_log, "TASK_BYTES", 10_000)
    edges = {p: (20, high - 5) for p, high in whole.items()}
    options = {"path": f"{tmp_path}/log", "start": "20", "end": "60"}
    tasks = parquet_log.LogReader(options).partitions()
    stream = parquet_log.LogStreamReader(options).partitions({str(p): a for p, (a, _) in edges.items()}, {str(p): b for p, (_, b) in edges.items()})
    for made, wanted in ((tasks, dict.fromkeys(whole, (20, 60))), (stream, edges)):
        found = [(p, o) for t in made for b in parquet_log._batches(t) for p, o in zip(b["partition"].to_pylist(), b["offset"].to_pylist(), strict=True)]
        assert sorted(found) == [(p, o) for p, (a, b) in sorted(wanted.items()) for o in range(a, b)]
    assert len(stream) > 2 * len(whole) and all(sum(g.size for g in t.groups) <= 10_000 or len(t.groups) == 1 for t in stream)


def test_files_are_known_anew_when_they_change(spark, tmp_path):
    for values, high in (([b"a", b"b"], 2), ([b"c"] * 5, 5)):
        parquet_log.write(records(spark, *values), f"file://{tmp_path}/log", "overwrite")
        assert parquet_log._offsets(f"{tmp_path}/log") == {0: (0, high)}


@pytest.mark.parametrize("n", [1, 3, 40, 1000])
@pytest.mark.parametrize("ascending", [True, False])
def test_few_records_of_a_stream_reach_its_counts(n, ascending):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    parts = rng.integers(0, 3, 900)
    offsets = np.array([(parts[:i] == parts[i]).sum() for i in range(900)])
    order = np.arange(900) if ascending else rng.permutation(900)
    batch = pa.RecordBatch.from_arrays([pa.array(parts[order]), pa.array(offsets[order]), pa.array([b"v"] * 900)], names=["partition", "offset", "value"])
    made = pa.Table.from_batches(list(streaming._may_be_first(n)(batch.slice(i, 64) for i in range(0, 900, 64))), batch.schema)
    found = list(zip(made["partition"].to_pylist(), made["offset"].to_pylist(), strict=True))
    first = {(int(p), int(o)) for p, o in zip(parts, offsets, strict=True) if o < n}
    assert len(set(found)) == len(found) and first <= set(found)
    assert not ascending or set(found) == first


def test_counts_per_partition_go_on_after_a_restart(spark, tmp_path):
    log = records(spark, b"a", b"b", b"c", b"d", b"e").union(records(spark, b"f", partition=1))
    parquet_log.write(log.where("offset < 2"), f"file://{tmp_path}/log")
    options = {"exit_at_end": True, "count_per_partition": 3}
    assert streamed(spark, f"{tmp_path}/log", f"{tmp_path}/state", **options) == [(0, 0), (0, 1), (1, 0)]
    parquet_log.write(log.where("offset >= 2"), f"file://{tmp_path}/log", "append")
    assert streamed(spark, f"{tmp_path}/log", f"{tmp_path}/state", **options) == [(0, 2)]
    parquet_log.write(log.where("offset = 1").withColumn("offset", F.lit(9).cast("long")), f"file://{tmp_path}/log", "append")
    assert streamed(spark, f"{tmp_path}/log", f"{tmp_path}/state", **options) == []
