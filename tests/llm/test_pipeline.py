import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import test_lines, test_shingles, test_substrings  # noqa: E402


def made():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(60)
    docs, labels = [], []
    for i in range(260):
        own = [line(rng.randint(20, 60)) for _ in range(3)]
        if i % 5 == 0:
            own.append("Shared footer of all")
        if i % 40 == 1:
            own.append(line(3) + " " + passage + " " + line(4))
        bad = i % 7 == 3
        if bad:
            own[1] += " Zorgle"
        docs.append((i, "\n".join(own), "en", "s", 0))
        labels.append((i, int(bad)))
    docs += [(500 + i, docs[2][1], "en", "s", 0) for i in range(15)]
    docs += [(300 + i, docs[i][1], "en", "s", 0) for i in range(0, 40, 4)]
    words = docs[20][1].split(" ")
    words[7] = "zz"
    docs += [(400, " ".join(words), "en", "s", 0), (401, None, "en", "s", 0), (402, "zorgle " + line(80), "en", "s", 0)]
    return docs, labels


def test_stages_match_plain_versions(spark, tmp_path):
    docs, labels = made()
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "substring dedup", "best-fit packing"]
    stage = [f for _, f in corpus_pipeline.STAGES]
    one = stage[0](spark, rows, str(tmp_path))
    kept = {r.doc_id: r.text for r in one.collect()}
    toxic = {i for i, t, *_ in docs if "zorgle" in (t or "").lower()}
    assert set(kept) == {d[0] for d in docs} - toxic
    two = stage[1](spark, one, str(tmp_path))
    assert one.columns == two.columns == names.replace("long", "").replace("string", "").replace(" ", "").split(",")
    by_lines = {d: t for d, _, _, t in test_lines.brute(list(kept.items()), 10, True)}
    got = {r.doc_id: (r.text, r.n_chars) for r in two.collect()}
    assert {d: t or "" for d, (t, _) in got.items()} == by_lines and all(n == len(t) for t, n in got.values() if t is not None)
    assert got[2][0] == kept[2] and got[505][0] == ""
    three = stage[2](spark, two, str(tmp_path))
    texts = [(d, t) for d, (t, _) in sorted(got.items())]
    firsts = {texts[x][0]: texts[x][1] for x in test_shingles.roots(texts)}
    assert 400 not in firsts  # a copy of document 20 with one word changed
    assert {r.doc_id: r.text for r in three.collect()} == firsts
    four = stage[3](spark, three, str(tmp_path))
    right = {d: t if gone else firsts[d] for d, _, gone, t in test_substrings.brute(list(firsts.items()), 20)}
    assert {r.doc_id: r.text for r in four.collect()} == right
    assert any(right[d] != firsts[d] for d in right)
    five = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in five} == set(right)
    assert max(Counter((r.sequence_id, r.offset) for r in five).values()) == 1
    assert {r.ids_crc32 for r in five} == {r.ids_crc32 for r in stage[4](spark, four, str(tmp_path)).collect()}


NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, labels, more=""):
    spark.createDataFrame(docs, NAMES + more).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, str(tmp_path), [], [])).collect() == []


def test_rows_of_every_kind(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(9000)}" for _ in range(n))
    one, other, long_text = text(120), text(130), text(60_000)
    docs = [(1, one), (1, one), (2, other), (2, text(90)), (None, one), (None, None), (3, None), (4, ""), (5, long_text), (6, long_text + " end")]
    rows = [(d, t, None, None, None, 7, "x", "y") for d, t in docs]
    folder = tables(spark, str(tmp_path), rows, [(1, 0), (1, 0), (77, 1), (2, None)], ", node int, kept string, d string")
    spark.createDataFrame([(i, int(i % 2)) for i in range(1, 7)], "doc_id long, toxic int").where("toxic = 0").write.mode("append").parquet(f"{folder}/labels.parquet")
    stages, rows = [f for _, f in corpus_pipeline.STAGES], spark.read.parquet(f"{folder}/documents.parquet")
    near = stages[2](spark, rows, folder)
    assert near.columns == corpus_pipeline.COLUMNS
    # equal rows and rows without an id stay; of blank texts the smallest id stays, and of the two long near copies
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter((d, t) for d, t in docs if (d, t) not in [(4, ""), (6, long_text + " end")])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {None, 1, 2, 3, 5}
    assert sum(r.length for r in packed if r.doc_id == 5) > 60_000
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in again) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_a_cluster_needs_a_shared_folder():
    from foliant.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        common.checkpoint_folder(Session())
