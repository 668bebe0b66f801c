"""Files and texts to block markup: dispatch by name, plain text, Markdown, structured JSON."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.scalars import escape_text

KINDS = {"md": "markdown", "markdown": "markdown", "txt": "text", "json": "structured", "html": "native", "htm": "native", "aim": "native", "docx": "unsupported", "pdf": "unsupported"}


def import_kind(path: Column) -> Column:
    """How a file is read, by its extension; null for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return table[F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, kind, text, length`` of files, byte for byte: line ends stay as they are; text is null where it is no UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.expr("try_validate_utf8(cast(content as string))")
    return files.select("path", import_kind(F.col("path")).alias("kind"), text.alias("text"), "length")


def new_document(title: Column, lang: Column) -> Column:
    """The markup of an empty document."""
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html data-aim-version="0.5" lang="'), lang, F.lit('">\n<head>\n<meta charset="utf-8">\n<title>'), escape_text(title),
        F.lit("</title>\n</head>\n<body>\n</body>\n</html>\n"),
    )


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


_INLINE = re.compile(r"(`+)(.+?)\1|!\[([^\]]*)\]\(([^)\s]*)\)|\[([^\]]*)\]\(([^)\s]*)\)|\*\*(.+?)\*\*|~~(.+?)~~|\*(.+?)\*|\\([^\w\s])", re.S)


def _allowed(url: str, picture: bool) -> bool:
    low = url.lower()
    if picture and low.startswith("data:image/") or not picture and low.startswith("#"):
        return True
    return low.partition(":")[0] in ("http", "https") + (() if picture else ("mailto",)) and ":" in low


def inline_markup(text: str) -> str:
    """Markdown spans as markup; raw markup is escaped, and stays visible."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(_escape(text[at : m.start()]))
        at = m.end()
        code, alt, src, label, href, strong, gone, em, plain = m[2], m[3], m[4], m[5], m[6], m[7], m[8], m[9], m[10]
        if code is not None:
            out.append(f"<code>{_escape(code.strip())}</code>")
        elif src is not None:
            out.append(f'<img src="{_escape(src)}" alt="{_escape(alt)}">' if _allowed(src, True) else _escape(alt))
        elif href is not None:
            own = inline_markup(label)
            out.append(f'<a href="{_escape(href)}">{own}</a>' if _allowed(href, False) else own)
        elif plain is not None:
            out.append(_escape(plain))
        else:
            tag, own = ("strong", strong) if strong is not None else ("s", gone) if gone is not None else ("em", em)
            out.append(f"<{tag}>{inline_markup(own)}</{tag}>")
    return "".join([*out, _escape(text[at:])])


_ITEM = re.compile(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$")


def markdown_blocks(text: str) -> list[str]:
    """Block markup of headings, paragraphs, lists, tables, quotes, fences and rules."""
    lines = text.replace("\r\n", "\n").replace("\t", "    ").split("\n")
    out: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        bare = line.strip()
        i += 1
        if not bare:
            continue
        if m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", bare):
            out.append(f"<h{len(m[1])}>{inline_markup(m[2])}</h{len(m[1])}>")
        elif m := re.match(r"^(```+|~~~+)", bare):
            code = []
            while i < len(lines) and not lines[i].strip().startswith(m[1]):
                code.append(lines[i])
                i += 1
            i += 1
            out.append("<pre><code>" + _escape("\n".join(code)) + "</code></pre>")
        elif re.match(r"^([-*_])(\s*\1){2,}$", bare):
            out.append("<hr>")
        elif bare.startswith(">"):
            quoted = [re.sub(r"^\s*>\s?", "", line)]
            while i < len(lines) and lines[i].strip().startswith(">"):
                quoted.append(re.sub(r"^\s*>\s?", "", lines[i]))
                i += 1
            out.append("<blockquote>" + "".join(markdown_blocks("\n".join(quoted))) + "</blockquote>")
        elif _ITEM.match(line):
            own = [line]
            while i < len(lines) and (lines[i].strip() and (_ITEM.match(lines[i]) or lines[i].startswith("  "))):
                own.append(lines[i])
                i += 1
            out.append(_list(own))
        elif "|" in bare and i < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i]):
            cells = lambda x: [inline_markup(c.strip()) for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))]
            rows = ["<thead><tr>" + "".join(f"<th>{c}</th>" for c in cells(bare)) + "</tr></thead>"]
            i += 1
            body = []
            while i < len(lines) and "|" in lines[i]:
                body.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells(lines[i])) + "</tr>")
                i += 1
            out.append("<table>" + rows[0] + ("<tbody>" + "".join(body) + "</tbody>" if body else "") + "</table>")
        else:
            para = [bare]
            while i < len(lines) and lines[i].strip() and not re.match(r"^\s*(#{1,6}\s|```|~~~|>|([-*_])(\s*\2){2,}$)", lines[i]) and not _ITEM.match(lines[i]):
                para.append(lines[i].strip())
                i += 1
            out.append(f"<p>{inline_markup(chr(10).join(para))}</p>")
    return out


def _list(lines: list[str]) -> str:
    first = _ITEM.match(lines[0])
    depth = len(first[1])
    tag = "ol" if first[2][0].isdigit() else "ul"
    items: list[list[str]] = []
    for line in lines:
        m = _ITEM.match(line)
        if m and len(m[1]) <= depth + 1:
            items.append([m[3]])
        else:
            items[-1].append(line)
    out = []
    for head, *rest in items:
        nested = next((k for k, x in enumerate(rest) if _ITEM.match(x)), len(rest))
        text = "\n".join([head, *(x.strip() for x in rest[:nested])])
        out.append(f"<li>{inline_markup(text)}{_list(rest[nested:]) if nested < len(rest) else ''}</li>")
    return f"<{tag}>" + "".join(out) + f"</{tag}>"


def structured_blocks(text: str) -> list[str]:
    """Block markup of a converted document: items by reference from its body, page furniture left out, cycles followed once."""
    data = json.loads(text)
    seen: set[str] = set()
    out: list[str] = []
    levels = any((x or {}).get("label") == "title" for x in data.get("texts") or [])

    def follow(ref: str):
        at = data
        for part in ref.lstrip("#/").split("/"):
            at = at[int(part)] if isinstance(at, list) else at.get(part)
        return at

    def walk(children, lists: list[str]):
        for child in children or []:
            ref = child.get("$ref") if isinstance(child, dict) else None
            if not ref or ref in seen:
                continue
            seen.add(ref)
            try:
                item = follow(ref)
            except (KeyError, IndexError, ValueError, AttributeError, TypeError):
                continue
            if not isinstance(item, dict) or item.get("content_layer", "body") != "body":
                continue
            label, own = item.get("label"), _escape(item.get("text") or "")
            if label in ("list", "ordered_list"):
                items: list[str] = []
                walk(item.get("children"), items)
                tag = "ol" if label == "ordered_list" else "ul"
                if items:
                    out.append(f"<{tag}>" + "".join(items) + f"</{tag}>")
                continue
            if label == "list_item":
                lists.append(f"<li>{own}</li>")
            elif label == "title":
                out.append(f"<h1>{own}</h1>")
            elif label == "section_header":
                n = min(6, int(item.get("level") or 1) + levels)
                out.append(f"<h{n}>{own}</h{n}>")
            elif label == "code":
                out.append(f"<pre><code>{own}</code></pre>")
            elif label == "table":
                out.append(_grid((item.get("data") or {}).get("grid") or []))
            elif own:
                out.append(f"<p>{own}</p>")
            walk(item.get("children"), lists)

    walk((data.get("body") or {}).get("children"), [])
    return [x for x in out if x]


def _grid(grid: list[list[dict]]) -> str:
    rows = []
    for y, row in enumerate(grid):
        cells = []
        for x, c in enumerate(row):
            if c.get("start_row_offset_idx", y) != y or c.get("start_col_offset_idx", x) != x:
                continue  # covered by a span
            tag = "th" if c.get("column_header") else "td"
            spans = "".join(f' {k}span="{c[f"{k}_span"]}"' for k in ("col", "row") if c.get(f"{k}_span", 1) > 1)
            cells.append(f"<{tag}{spans}>{_escape(c.get('text') or '')}</{tag}>")
        rows.append("<tr>" + "".join(cells) + "</tr>")
    return "<table><tbody>" + "".join(rows) + "</tbody></table>" if rows else ""


def import_blocks(rows: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ord, html, error``: the blocks of Markdown (``markdown``) or converted documents (``structured``)."""
    parse = {"markdown": markdown_blocks, "structured": structured_blocks}[kind]

    def run(batches):
        for batch in batches:
            ids, ords, blocks, errors = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found, error = parse(text or ""), None
                except (ValueError, AttributeError, TypeError, RecursionError) as problem:
                    found, error = [None], f"{type(problem).__name__}: {problem}"
                for k, block in enumerate(found):
                    ids.append(i)
                    ords.append(k)
                    blocks.append(block)
                    errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ords, pa.int32()), pa.array(blocks, pa.string()), pa.array(errors, pa.string())], ["doc_id", "ord", "html", "error"])

    chosen = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ord int, html string, error string")


def as_events(blocks: DataFrame) -> DataFrame:
    """``doc_id, seq, kind, action, target, payload, batch``: an import is itself history, one add for each block."""
    seq = F.expr("row_number() over (partition by doc_id order by ord)").cast("long")
    target = F.lower(F.substr(F.sha2(F.concat_ws(":", "doc_id", "ord"), 256), F.lit(1), F.lit(8)))
    return blocks.where("html is not null").select(
        "doc_id", seq.alias("seq"), F.lit("direct_edit").alias("kind"), F.lit("add").alias("action"), target.alias("target"), F.col("html").alias("payload"), F.lit("b1").alias("batch")
    )


def image_size(blob: Column) -> Column:
    """``width, height`` of PNG and GIF pictures from their first bytes, null for others."""
    code = F.hex(F.substring(blob, 1, 24))
    number = lambda at, n: F.conv(F.substring(code, 2 * at + 1, 2 * n), 16, 10).cast("long")
    little = lambda at: F.conv(F.concat(F.substring(code, 2 * at + 3, 2), F.substring(code, 2 * at + 1, 2)), 16, 10).cast("long")
    png = F.struct(number(16, 4).alias("width"), number(20, 4).alias("height"))
    gif = F.struct(little(6).alias("width"), little(8).alias("height"))
    return F.when(code.startswith("89504E470D0A1A0A") & (F.length(code) == 48), png).when(code.startswith("474946383961") | code.startswith("474946383761"), gif)
