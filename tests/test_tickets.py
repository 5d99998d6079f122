import json
from datetime import datetime

import pytest

from morphloom.operators import shred, tickets

EDIT = lambda kind, **params: {"kind": kind, "params": params or None}
TICKETS = "id string, updated_at timestamp_ntz, impact struct<freq:bigint,score:bigint,priority:string>, hypotheses array<struct<id:string,edits:array<struct<kind:string,params:string>>>>, presentation_options array<struct<id:string,kind:string>>, node string"


def at(day):
    return datetime(2025, 1, day)


def typed(spark, rows):
    return spark.createDataFrame(rows, TICKETS)


def raw(spark, payloads):
    return spark.createDataFrame([(i, p, at(i)) for i, p in enumerate(payloads, 1)], "raw_id bigint, payload string, received_at timestamp_ntz")


def found(spark, rows=(), payloads=()):
    return {tuple(r) for r in tickets.ticket_entities(typed(spark, list(rows)), raw(spark, list(payloads))).collect()}


def test_positions_count_nulls_and_inner_edits_follow_the_outer_path(spark):
    inner = json.dumps({"edits": [{"kind": "x"}, None, {"kind": None, "params": {"edits": {"kind": "deep"}}}]})
    rows = [("t", at(1), (1, 0, None), [None, ("h", [(None, None), ("a", inner), ("b", "no json")])], [("o1", "k"), None, (None, "k")], "n")]
    assert found(spark, rows) == {
        ("t", "edit", 2, "2", "a"), ("t", "edit", 2, "3", "b"), ("t", "edit", 2, "2.1", "x"), ("t", "edit", 2, "2.3.1", "deep"),
        ("t", "option", 0, "1", "o1"), ("t", "impact", 0, "0", "0"),
    }


def test_live_version_counts_and_repeats_count_once(spark):
    old, new = ("t", at(1), (1, 5, None), [], [], "n"), ("t", at(2), None, None, [("o", None)], "n")
    assert found(spark, [new, old, new]) == {("t", "option", 0, "1", "o")}


def test_shapes_of_payloads(spark):
    base = {"pair": "q", "type": "pos"}
    plain = base | {"id": "a", "impact": json.dumps({"score": 12.0}), "hypotheses": {"h1": {"edits": {"kind": "k"}}, "h2": None}, "presentation_options": {"o1": {"kind": "c"}, "o2": {"id": "own"}}}
    wrapped = {"meta": {"id": "m", "kind": "batch"}, "payload": {"tickets": [base | {"id": "b", "impact": {"score": " 7 "}}, base | {"id": "c", "impact": {"score": "none"}}]}}
    single = base | {"id": "d", "hypotheses": json.dumps({"mechanism": "x", "edits": json.dumps([EDIT("s", edits=[EDIT("t")])])})}
    got = found(spark, payloads=[json.dumps(plain), "﻿ " + json.dumps(json.dumps([wrapped])), json.dumps(single), "export failed", None, '{"id": "a", "pair": "q", "impact": {"sc', ""])
    assert got == {
        ("a", "impact", 0, "0", "12"), ("a", "edit", 1, "1", "k"), ("a", "option", 0, "1", "o1"), ("a", "option", 0, "2", "own"),
        ("b", "impact", 0, "0", "7"), ("d", "edit", 1, "1", "s"), ("d", "edit", 1, "1.1", "t"),
    }


def test_latest_readable_payload_that_holds_the_ticket(spark):
    one = lambda score: json.dumps({"id": "a", "pair": "q", "impact": {"score": score}})
    assert found(spark, payloads=[one(1), one(2), one(3)[:-2]]) == {("a", "impact", 0, "0", "2")}


def test_empty_tables(spark):
    assert found(spark) == set()


def test_deep_and_long_records(spark):
    deep = json.dumps({"a": "x" * 300_000, "k": list(range(30_000))})
    df = spark.createDataFrame([(1, deep), (2, "[" * 100_000), (3, None), (4, "")], "id int, body string")
    nodes = shred.shred(df, ["id"], "body", rows_per_batch=1000)
    assert nodes.count() == 30_003
    assert nodes.filter("label = 'a'").selectExpr("length(scalar)").collect()[0][0] == 300_000


def test_nodes_keep_parent_label_and_order(spark):
    df = spark.createDataFrame([("r", '{"b": [true, null, 1.5], "a": {"c": "x"}}')], "id string, body string")
    got = [tuple(r) for r in shred.shred(df, ["id"], "body").select("node", "parent", "label", "ordinal", "place", "kind", "scalar").collect()]
    assert got == [
        ("", None, "", 0, "", "object", None), ("/1", "", "b", 1, "", "array", None), ("/1/1", "/1", "b", 1, "1", "boolean", "true"), ("/1/2", "/1", "b", 2, "2", "null", None),
        ("/1/3", "/1", "b", 3, "3", "number", "1.5"), ("/2", "", "a", 2, "", "object", None), ("/2/1", "/2", "c", 1, "", "string", "x"),
    ]


def brute(rows, payloads):
    """An independent reading of the same tables."""
    out = set()

    def value(text):
        while isinstance(text, str):
            try:
                text = json.loads(text.strip("﻿ \n\t\r"))
            except ValueError:
                return None
        return text

    def many(x, members):
        x = value(x) if isinstance(x, str) else x
        if isinstance(x, dict):
            return [x] if members & set(x) else [v and {"id": k, **v} for k, v in x.items()]
        return x or []

    def edits(name, h, items, outer):
        for i, e in enumerate(many(items, {"kind", "params"}), 1):
            if e:
                if e.get("kind") is not None:
                    out.add((name, "edit", h, f"{outer}{i}", e["kind"]))
                params = value(e["params"]) if isinstance(e.get("params"), str) else e.get("params")
                if isinstance(params, dict):
                    edits(name, h, params.get("edits"), f"{outer}{i}.")

    def one(name, t):
        for i, h in enumerate(many(t.get("hypotheses"), {"mechanism", "edits", "source"}), 1):
            if h:
                edits(name, i, h.get("edits"), "")
        for i, o in enumerate(many(t.get("presentation_options"), {"question_id"}), 1):
            if o and o.get("id") is not None:
                out.add((name, "option", 0, str(i), o["id"]))
        impact = many(t.get("impact"), {"freq", "score"})
        if impact and impact[0].get("score") is not None:
            out.add((name, "impact", 0, "0", str(int(float(impact[0]["score"])))))

    live = {}
    for t in rows:
        if t["id"] not in live or t["updated_at"] > live[t["id"]]["updated_at"]:
            live[t["id"]] = t
    for name, t in live.items():
        one(name, t)

    def inside(x):
        if isinstance(x, dict) and "id" in x and "pair" in x:
            return [x]
        return [y for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else []) for y in inside(v)]

    last = {}
    for p in payloads:
        for t in inside(value(p["payload"])):
            if t["id"] not in last or p["received_at"] > last[t["id"]][0]:
                last[t["id"]] = (p["received_at"], t)
    for name, (_, t) in last.items():
        one(name, t)
    return out


def test_query_equals_brute_force(spark, folder):
    import pyarrow.parquet as pq

    from morphloom.plans.tickets import p1_found

    rows, payloads = (pq.read_table(f"{folder}/{t}.parquet").to_pylist() for t in ("tickets", "raw_tickets"))
    got = [tuple(r) for r in p1_found(spark, folder).collect()]
    assert len(got) == len(set(got)) > 0 and set(got) == brute(rows, payloads)


def wrapped(value, times):
    for _ in range(times):
        value = json.dumps(value)
    return value


def test_json_text_in_json_text_of_any_depth():
    for times in (1, 8, 9, 12):
        assert shred.read_json(wrapped({"a": 1}, times)) == {"a": 1}
    assert shred.read_json(wrapped("no json", 4)) is None and shred.read_json('"') is None


@pytest.mark.parametrize("depth", [3, 3_000, 200_000])
def test_nesting_of_any_depth(depth):
    text = '{"a":[' * depth + '1, "x\\u00e9", {}, []' + "]}" * depth
    value = shred.read_json(text)
    again = shred.read_json(shred.write_json(value))
    for tree in (value, again):
        for _ in range(depth):
            assert list(tree) == ["a"]
            tree = tree["a"]
            inner, tree = tree, tree[0]
        assert inner == [1, "xé", {}, []]
    assert shred.read_json(text[:-1]) is None and shred.read_json(text + "]") is None


def test_the_reader_without_recursion_agrees_with_json():
    good = ['{"a": [1, -2.5e3, true, null, {"b": ""}], "c": {}}', " [ ] ", '"x"', "0", "[[[]]]", '{"a":1,"a":2}', "[NaN]"]
    for text in good:
        assert repr(shred._read_deep(text)) == repr(json.loads(text))
    for text in ("", "{", "[1,]", '{"a"}', '{"a":}', "[1 2]", "01", "tru", '{"a":1,}', "[]]", "{1:2}"):
        with pytest.raises(ValueError):
            shred._read_deep(text)


def test_a_deep_ticket_is_not_lost(spark):
    deep = '{"kind":"k","params":{"edits":[' * 400 + '{"kind":"last"}' + "]}}" * 400
    payload = f'{{"id":"T","type":"x","hypotheses":[{{"edits":[{deep}]}}]}}'
    raw = spark.createDataFrame([(1, "p", payload, None)], "raw_id bigint, pair string, payload string, received_at timestamp_ntz")
    typed = spark.read.parquet("/root/testdata/sf0.001/tickets.parquet").limit(0)
    got = {r.path: r.value for r in tickets.ticket_entities(typed, raw).collect()}
    assert len(got) == 401 and got[".".join(["1"] * 401)] == "last"


def test_unreadable_texts_are_told(spark):
    df = spark.createDataFrame([("{}",), ("[1",), (None,), ("7",)], "t string")
    assert [r.unreadable for r in shred.unreadable(df, "t").collect()] == [False, True, False, True]
