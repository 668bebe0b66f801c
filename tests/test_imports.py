import base64
import json

from pyspark.sql import functions as F

from foliant.sources import imports


def test_markdown():
    text = "# A *b*\n\npara <i> `x<y`\nmore [l](http://a) [m](javascript:b)\n\n- one\n- two **b**\n  1. deep\n\n> q\n> r\n\n```py\na < b\n```\n---\n| a | b |\n|---|:-:|\n| 1 | ![p](data:image/png;base64,x) |\n"
    assert imports.markdown_blocks(text) == [
        "<h1>A <em>b</em></h1>",
        '<p>para &lt;i&gt; <code>x&lt;y</code>\nmore <a href="http://a">l</a> m</p>',
        "<ul><li>one</li><li>two <strong>b</strong><ol><li>deep</li></ol></li></ul>",
        "<blockquote><p>q\nr</p></blockquote>",
        "<pre><code>a &lt; b</code></pre>",
        "<hr>",
        '<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td><img src="data:image/png;base64,x" alt="p"></td></tr></tbody></table>',
    ]


def test_structured(spark):
    doc = {
        "body": {"children": [{"$ref": f"#/texts/{k}"} for k in range(4)] + [{"$ref": "#/groups/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/99"}, {"$ref": "#/texts/0"}]},
        "texts": [
            {"label": "title", "text": "T & U"}, {"label": "section_header", "level": 1, "text": "S"}, {"label": "text", "text": "p", "children": [{"$ref": "#/texts/2"}]},
            {"label": "page_footer", "text": "no", "content_layer": "furniture"}, {"label": "list_item", "text": "i"},
        ],
        "groups": [{"label": "list", "children": [{"$ref": "#/texts/4"}]}],
        "tables": [{"label": "table", "data": {"grid": [[{"text": "a", "col_span": 2, "column_header": True}, {"text": "a", "start_col_offset_idx": 0}]]}}],
    }
    rows = spark.createDataFrame([(1, json.dumps(doc)), (2, "{bad"), (3, None)], "doc_id long, text string")
    got = imports.import_blocks(rows, "structured").orderBy("doc_id", "ord").collect()
    assert [r.html for r in got if r.doc_id == 1] == [
        "<h1>T &amp; U</h1>", "<h2>S</h2>", "<p>p</p>", "<ul><li>i</li></ul>", '<table><tbody><tr><th colspan="2">a</th></tr></tbody></table>',
    ]
    assert [r.error is not None for r in got if r.doc_id > 1] == [True, True]
    assert [(r.seq, r.action) for r in imports.as_events(imports.import_blocks(rows, "structured")).orderBy("seq").collect()] == [(k, "add") for k in range(1, 6)]


def test_files_and_pictures(spark, tmp_path):
    (tmp_path / "a.MD").write_bytes(b"x\r\ny")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    got = {r.path.rpartition("/")[2]: (r.kind, r.text) for r in imports.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.MD": ("markdown", "x\r\ny"), "b.bin": (None, None)}
    png = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAUAAAAHCAYAAADAp4fuAAAAAElFTkSuQmCC")
    rows = spark.createDataFrame([(png,), (b"GIF89a\x03\x01\x04\x00",), (b"no",)], "blob binary")
    assert [r.s and (r.s.width, r.s.height) for r in rows.select(imports.image_size(F.col("blob")).alias("s")).collect()] == [(5, 7), (259, 4), None]


def test_new_document(spark):
    from foliant.sources.markup import canonical_text

    made = spark.range(1).select(imports.new_document(F.lit("A & B"), F.lit("en")).alias("x")).first().x
    assert canonical_text(made) == made
