import pytest
from hypothesis import given
from hypothesis import strategies as st

from sievelog.functions.interpreter import Expression
from sievelog.functions.values import UNDEF, ExpressionError, ParseError, json_string, json_text, number_text, parse_json

DOCUMENT = parse_json(
    '{"items":[{"name":"a","price":4},{"name":"b","price":10},{"name":"c","price":12}],"a":{"b":[{"c":1},{"c":2}]},"s":"Hello","n":null,'
    '"Account":{"Order":[{"OrderID":"o1","Product":[{"d":"Hat","q":2},{"d":"Cap","q":1}]},{"OrderID":"o2","Product":[{"d":"Hat","q":4}]}]}}'
)


def evaluated(source, document=DOCUMENT, variables=UNDEF):
    out = Expression(source).evaluate(document, variables)
    return None if out is UNDEF else json_text(out)


@pytest.mark.parametrize(("source", "expected"), [
    ("{'cheap': $join(items[price < 11].name, '+'), 'spread': $max(items.price) - $min(items.price), 'dear': $count(items[price > 11])}", '{"cheap":"a+b","spread":8,"dear":1}'),
    ("items.price", "[4,10,12]"), ("a.b[0].c", "1"), ("items[-1].name", '"c"'), ("items[[0,2]].name", '["a","c"]'), ("items[price > 100]", None),
    ("items.name[0]", '["a","b","c"]'), ("(items.name)[0]", '"a"'), ("items^(>price).name", '["c","b","a"]'), ('items[name="a"][]', '[{"name":"a","price":4}]'),
    ("Account.Order.Product{d: $sum(q)}", '{"Hat":6,"Cap":1}'), ("Account.Order.Product[%.OrderID='o2'].d", '"Hat"'), ("Account.**.d", '["Hat","Cap","Hat"]'),
    ('Account.Order#$i.Product.{"d":d,"i":$i}', '[{"d":"Hat","i":0},{"d":"Cap","i":0},{"d":"Hat","i":1}]'), ("items.[name,price]", '[["a",4],["b",10],["c",12]]'),
    ('missing ?? "x"', '"x"'), ("n ?? 1", "null"), ("false ? 1", None), ("missing ?: 3", "3"), ("1 in missing", "false"), ("missing != 1", "false"), ("1 = '1'", "false"),
    ('s & 1 & true & missing', '"Hello1true"'), ("[missing,1]", "[1]"), ('{"kept":1,"m":missing}', '{"kept":1}'), ("[1..3]", "[1,2,3]"), ("[[1,2],3]", "[[1,2],3]"),
    ("($x := 1; $x + 1)", "2"), ("($f := function($a,$b){$a+$b}; $g := $f(1,?); $g(4))", "5"), ('"x" ~> $uppercase() ~> $length()', "1"),
    ("$ ~> |a.b|{'z':c*2},'c'| ~> $lookup('a')", '{"b":[{"z":2},{"z":4}]}'), ("-5 % 3", "-2"), ("$round(2.5)", "2"), ("$string(0.1+0.2)", '"0.3"'),
    ('$replace("abc",/b(.)/,"<$1>")', '"a<c>"'), ('$match("ababbabbcc",/a(b+)/).groups', '["b","bb","bb"]'), ('$formatNumber(12345.6,"#,###.00")', '"12,345.60"'),
    ('$formatInteger(2789,"w")', '"two thousand, seven hundred and eighty-nine"'), ('$formatInteger(1999,"I")', '"MCMXCIX"'), ("$fromMillis(1510067557121)", '"2017-11-07T15:12:37.121Z"'),
    ('$toMillis("2017-11-07T15:12:37.121Z")', "1510067557121"), ("$map([1,2],function($v,$i){$v*$i})", "[0,2]"), ("$max([])", None), ("$sum([])", "0"), ("$not(missing)", None),
    ("$pad('',5,'x')", '"xxxxx"'), ("$lookup(items,'name')", '["a","b","c"]'), ("$distinct([1,1,2])", "[1,2]"), ("$sift({'a':1,'b':2},function($v){$v>1})", '{"b":2}'),
])
def test_language(source, expected):
    assert evaluated(source) == expected


@pytest.mark.parametrize("source", ['s === "Hello"', '{"at": /l+/}', "1 +", "a[", '"x', "f(", "a == b", "", "(1", "$x := "])
def test_parse_errors(source):
    with pytest.raises(ParseError):
        Expression(source)


@pytest.mark.parametrize("source", ['$error("failure")', "$assert(false, 'no')", "1 + 'a'", "1 < 'a'", "$sqrt(-1)", "unknown(1)", "1/0", "s.x ~> 3", "{1: 2}"])
def test_evaluation_errors(source):
    with pytest.raises(ExpressionError):
        Expression(source).evaluate(DOCUMENT)


def test_isolation_and_variables():
    # a name bound in one evaluation isn't there in the next
    kept = Expression("($exists($last) ? $last : ($last := depth; $last * 2))")
    assert [kept.evaluate({"depth": float(i)}) for i in (4, 5)] == [8.0, 10.0]
    assert evaluated("$vars.site[1]", {}, {"site": ["quay", "harbour"]}) == '"harbour"'
    assert evaluated("$vars.site", {}) is None


@pytest.mark.parametrize(("x", "text"), [(22.0, "22"), (9007199254740993.0, "9007199254740992"), (1e21, "1e+21"), (1e-7, "1e-7"), (123456789012345680000.0, "123456789012345680000"), (0.1, "0.1"), (1e-5, "0.00001"), (-0.0, "0"), (1.5e300, "1.5e+300")])
def test_numbers(x, text):
    assert number_text(x) == text


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_text_gives_the_number_back(x):
    assert float(number_text(x)) == x


def test_json_string():
    assert json_string('"\\\n\x01') == '"\\"\\\\\\n\\u0001"'


@pytest.mark.parametrize("bad", [b"", b"{} x", b'{"a":1}{"b":2}', b"[1] // c", b"NaN", b"1e400", b'"\\ud800"', b"{ not json \xff", b"\xef\xbb\xbf1"])
def test_strict_json(bad):
    with pytest.raises(ValueError):
        parse_json(bad)


JSON = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(codec="utf-8")), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(st.characters(codec="utf-8")), x, max_size=3), max_leaves=8)


@given(JSON)
def test_json_round_trip(value):
    assert parse_json(json_text(value)) == value
