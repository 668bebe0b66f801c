"""Operators without SQL, against plain Python, and functions on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import scalars as s
from foliant.operators import caches, history, lane, layout, paint, reconcile, rules, views
from foliant.sources import markup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("n", "style", "text"), [(4, "lowerRoman", "iv"), (1994, "upperRoman", "MCMXCIV"), (0, "lowerRoman", ""), (4000, "lowerRoman", "mmmm"), (28, "lowerLetter", "ab"), (703, "lowerLetter", "aaa"), (5, "bullet", ""), (5, "ordinal", "5"), (26, "upperLetter", "Z"), (7, "decimal", "7")])
def test_numbers(spark, n, style, text):
    assert one(spark, s.format_number(F.lit(n), style)) == text


def test_functions(spark):
    assert one(spark, s.class_tokens(F.lit(" b a b\tc "))) == "a b c"
    assert one(spark, s.normal_style(F.lit("color:#111111;x:1; left:2px;color: #222222"))) == "left:2px; color:#222222; x:1"
    assert one(spark, s.code_fence(F.lit("a ```` b"))) == "`````"
    assert one(spark, s.valid_chunk_id(F.lit("a-1"))) and not one(spark, s.valid_chunk_id(F.lit("p-1"))) and not one(spark, s.valid_chunk_id(F.lit("a\n")))
    assert not one(spark, s.valid_chunk_id(F.lit("body")))
    assert one(spark, s.rgb(F.lit("rgb(300, 1,2)"))) == "#ff0102"
    assert one(spark, s.minted_id(F.lit("d"), F.lit("1"))) == one(spark, s.minted_id(F.lit("d"), F.lit("1")))
    assert one(spark, s.implements(F.lit("0.5"))) and not one(spark, s.implements(F.lit("0.10"))) and not one(spark, s.implements(F.lit("v1")))


def test_replay_matches_a_plain_list(spark):
    rng = random.Random(1)
    rows, right = [], {}
    for doc in range(20):
        order, held, ids = [], {}, 0
        for seq in range(1, 40):
            kind = rng.choice(["add", "add", "modify", "delete", "move"])
            if kind == "add" or not order:
                ids += 1
                after = rng.choice([None, *order])
                order.insert(0 if after is None else order.index(after) + 1, ids)
                held[ids] = f"v{seq}"
                rows.append((doc, seq, "direct_edit", "add", ids, f"v{seq}", after))
            else:
                x = rng.choice(order)
                after = None
                if kind == "modify":
                    held[x] = f"v{seq}"
                elif kind == "delete":
                    order.remove(x)
                else:
                    rest = [y for y in order if y != x]
                    after = rng.choice([None, *rest])
                    order.remove(x)
                    order.insert(0 if after is None else order.index(after) + 1, x)
                rows.append((doc, seq, "direct_edit", kind, x, f"v{seq}", after))
        right[doc] = [(x, held[x]) for x in order]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "doc_id long, seq long, kind string, action string, target long, payload string, after long").repartition(3)
    got = {}
    for r in history.replay(log).orderBy("doc_id", "ord").collect():
        assert r.problem is None
        got.setdefault(r.doc_id, []).append((r.target, r.payload))
    assert got == {k: x for k, x in right.items() if x}


def apply(units, script):
    order = [x for x, _ in units]
    held = dict(units)
    for action, x, after, payload in script:
        if action in ("delete", "move"):
            order.remove(x)
        if action in ("add", "move"):
            order.insert(0 if after is None else order.index(after) + 1, x)
        if action in ("add", "modify"):
            held[x] = payload
    return [(x, held[x]) for x in order]


def test_edit_scripts_lead_to_the_actual_units(spark):
    rng = random.Random(3)
    e, a, was, now = [], [], {}, {}
    for doc in range(60):
        x = rng.sample(range(12), rng.randint(0, 9))
        y = rng.sample(range(12), rng.randint(0, 9))
        was[doc] = [(i, f"{i}") for i in x]
        now[doc] = [(i, f"{i}{rng.choice(['', '!'])}") for i in y]
        e += [(doc, k, i, p) for k, (i, p) in enumerate(was[doc])]
        a += [(doc, k, i, p) for k, (i, p) in enumerate(now[doc])]
    schema = "doc_id long, ord long, id long, serial string"
    scripts = {}
    for r in reconcile.edit_script(spark.createDataFrame(e, schema), spark.createDataFrame(a, schema)).orderBy("doc_id", "step").collect():
        scripts.setdefault(r.doc_id, []).append((r.action, r.id, r.after, r.payload))
    for doc in was:
        assert apply(was[doc], scripts.get(doc, [])) == now[doc]


def test_creation_order_moves_only_chained_adds(spark):
    cards = [(1, "a", 0, "add", "c"), (1, "b", 1, "add", None), (1, "c", 2, "add", None), (1, "d", 3, "modify", None), (1, "x", 4, "add", "y"), (1, "y", 5, "add", "x")]
    got = lane.creation_order(spark.createDataFrame(cards, "doc_id long, id string, card_ord long, action string, after string"))
    # a waits for c; the cycle of x and y has no place
    assert [r.id for r in got.orderBy("nth").collect()] == ["b", "c", "a", "d"]


def test_chains(spark):
    cards = [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 99), (1, 5, 6), (1, 6, 5), (1, 7, 5), (1, 8, 8)]
    got = {r.id: (r["head"], r["depth"], r.in_cycle, r.leads_to_cycle) for r in lane.chains(spark.createDataFrame(cards, "doc_id long, id long, after long")).collect()}
    assert got[3] == (None, 3, False, False) and got[4] == (99, 1, False, False)
    assert got[5][2] and got[6][2] and got[8][2] and not got[7][2] and got[7][3]


def test_lane_is_all_or_nothing(spark):
    units = [(d, k, x, x.upper()) for d in (1, 2) for k, x in enumerate("abc")]
    cards = [
        (1, 1, "p1", "add", None, "a", "P1", "accepted"), (1, 2, "p2", "add", None, "p1", "P2", "accepted"), (1, 3, "p3", "add", None, "c", "P3", "rejected"),
        (1, 4, "p4", "add", None, "p3", "P4", "accepted"), (1, 5, "p5", "delete", "b", None, None, "accepted"), (1, 6, "p6", "move", "a", "c", None, "accepted"),
        (2, 1, "q1", "modify", "a", None, "Q", "accepted"), (2, 2, "q2", "modify", "gone", None, "Q", "accepted"),
    ]
    got = {1: [], 2: []}
    u = spark.createDataFrame(units, "doc_id long, ord long, id string, payload string")
    c = spark.createDataFrame(cards, "doc_id long, card_ord long, id string, action string, target string, after string, payload string, decision string")
    problems = {}
    for r in lane.resolve_lane(u, c).orderBy("doc_id", "ord").collect():
        got[r.doc_id].append((r.id, r.payload))
        problems[r.doc_id] = r.problem
    assert got[1] == [("p1", "P1"), ("p2", "P2"), ("c", "C"), ("p4", "P4"), ("a", "A")]
    assert got[2] == [("a", "A"), ("b", "B"), ("c", "C")] and problems == {1: None, 2: "modify q2"}


def test_siblings_keep_their_order(spark):
    units = [(1, 0, "a", "A"), (1, 1, "b", "B")]
    cards = [(1, k, f"p{k}", "add", None, after, f"P{k}", "accepted") for k, after in enumerate(["a", "a", None, "p0", "a", None])]
    u = spark.createDataFrame(units, "doc_id long, ord long, id string, payload string")
    c = spark.createDataFrame(cards, "doc_id long, card_ord long, id string, action string, target string, after string, payload string, decision string")
    got = [r.id for r in lane.resolve_lane(u, c).orderBy("ord").collect()]
    assert got == ["p2", "p5", "a", "p0", "p1", "p3", "p4", "b"]


DOC = """<!DOCTYPE html>
<html data-aim-version="0.5" lang="en">
<head>
<meta charset="utf-8">
<title>T &amp; x</title>
<style data-aim-theme>:root{--aim-brand-1:#123;--other:1;--aim-font-body:&lt}</style>
</head>
<body>
<h1 data-aim="h" class="b a" style="top:1px;left:2em">Head</h1>
<p data-aim="x" onclick="y()">One <a href="javascript:z">l</a></p>
<p>stray</p>
<ul data-aim-container="u"><li data-aim="i1">a</li><li>b</li></ul>
<div data-aim="x"/><iframe></iframe>
<aim-proposals><aim-proposal id="p-1" data-action="modify" data-for="x"><template><p>n</p></template></aim-proposal><aim-proposal id="bad" data-action="delete" data-for="nope"></aim-proposal><aim-proposal id="p-2" data-action="add" data-anchor-container="body" data-anchor-after="p-3"><template><p>n</p></template></aim-proposal><aim-proposal id="p-3" data-action="add" data-anchor-container="body" data-anchor-after="p-2"><template><p>n</p></template></aim-proposal><aim-proposal id="p-4" data-action="add" data-anchor-container="body" data-anchor-after="zz"><template><p>n</p></template></aim-proposal></aim-proposals>
<script type="application/aim-history+jsonl">
{"seq":2,"kind":"checkpoint","t":"2026-01-01T00:00:00Z","label":"a","doc_hash":"h"}
{"seq":true,"kind":"checkpoint","t":"2026-99-01T00:00:00Z","label":"a","doc_hash":"h"}
nonsense
</script>
</body>
</html>"""


def test_findings(spark):
    docs = spark.createDataFrame([(1, DOC), (2, "<html><p>"), (3, None)], "page_id long, html string")
    nodes = markup.nodes(docs).cache()
    found = {(r.doc_id, r.code) for r in rules.findings(nodes).collect()}
    codes = {c for d, c in found if d == 1}
    assert codes >= {"S011", "S017", "S023", "V008", "V009", "V011", "V012", "X001", "X002", "X003", "C002", "P002", "P008", "P011", "P015", "H005", "H002", "H003", "H004", "S005"}
    assert not codes & {"S000", "S001", "S002", "S003", "S004", "X004", "P009", "H001", "V004", "V007"}
    assert {c for d, c in found if d == 2} == {"S000"}
    own = {r.id: r for r in views.chunks(nodes).collect()}
    assert set(own) == {"h", "x", "i1"} and own["i1"].container == "u" and list(own["x"].tags) == ["p", "div"]
    assert [(r.tag, r.text) for r in views.constructs(nodes).where("doc_id = 1").orderBy("ord").collect()][:3] == [("h1", "Head"), ("p", "One l"), ("p", "stray")]
    nodes.unpersist()


def test_canonical_text():
    text = '<!DOCTYPE html><html lang="x" data-aim-version="0.5"><head><meta charset="utf-8"></head><body><p style="color:#111111;;left:1px" data-aim="a" class="b a b" href="q&quot;" data-aim="z">x &lt; y<br></p><svg viewbox="0 0 1 1"><path d="m"></path></svg></body></html>'
    once = markup.canonical_text(text)
    assert '<p data-aim="a" class="a b" style="left:1px; color:#111111" href="q&quot;">x &lt; y<br></p>' in once.split("\n")
    assert '<svg viewBox="0 0 1 1"><path d="m"/></svg>' in once.split("\n")
    assert markup.canonical_text(once) == once
    assert markup.canonical_json('{"b": 1.50, "a": "</x>", "é": [true]}') == '{"a":"<\\/x>","b":1.5,"é":[true]}'
    for bad in ("<p>", "</p>", "<script>"):
        with pytest.raises(markup.MarkupError):
            markup.parse(bad)


def test_numbering_and_paint(spark):
    items = [(1, k, "s", level) for k, level in enumerate([1, 0, 1, 1, 2, 0, 2])]
    got = layout.number_labels(spark.createDataFrame(items, "doc_id long, ord long, scheme string, level int")).orderBy("ord").collect()
    assert [r.label for r in got] == ["1.1", "2", "2.1", "2.2", "2.2.1", "3", "3.1.1"]
    nodes = spark.createDataFrame([(1, k, k - 1, "element") for k in range(4)], "doc_id long, node_id int, parent_id int, kind string")
    rows = [(1, 1, 0, 1, "color", "#ABC"), (1, 1, 0, 2, "color", "#def"), (1, 3, 1, 1, "border-color", "red")]
    won = paint.cascade(spark.createDataFrame(rows, "doc_id long, node_id int, layer int, ord int, prop string, value string"))
    assert {(r.node_id, r.prop): r.value for r in won.collect()}[1, "color"] == "#ddeeff"
    assert {r.node_id: r.value for r in paint.inherited(nodes, won).collect()} == {1: "#ddeeff", 2: "#ddeeff", 3: "#ddeeff"}


def test_assets(spark):
    rows = [(1, '<img src="data:image/png;base64,aGVsbG8="> <img src="data:image/png;base64,aGVsbG8=">'), (2, "none")]
    got = caches.pack_assets(spark.createDataFrame(rows, "doc_id long, html string")).collect()
    assert [(r.id, r.size) for r in got] == [("asset-2cf24dba5fb0", 5)]


def test_streams(spark, tmp_path):
    from foliant.streaming import log

    schema = "doc_id long, seq long, ts timestamp"
    rows = spark.sql("select * from values (1L, 1L, timestamp'2026-01-01 00:10:00'), (1L, 2L, timestamp'2026-01-01 00:20:00'), (1L, 5L, timestamp'2026-01-01 01:20:00'), (2L, 2L, timestamp'2026-01-01 00:00:00') as t(doc_id, seq, ts)")
    rows.write.parquet(f"{tmp_path}/in")
    for name, f, mode in (("gaps", log.last_sequence, "append"), ("edits", log.edits_by_window, "complete")):
        stream = f(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert sorted((r.doc_id, r.seq, r.gap) for r in spark.table("gaps").collect()) == [(1, 5, 2), (2, 2, 1)]
    assert sorted((r.doc_id, r.edits) for r in spark.table("edits").collect()) == [(1, 1), (1, 2), (2, 1)]
