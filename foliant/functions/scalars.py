"""Scalar functions of the format, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import vocabulary as v


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_text(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def escape_attribute(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ('"', "&quot;")])


def class_tokens(value: Column) -> Column:
    """The set of class tokens, sorted by code point."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(value, r"(?U)\s+"), lambda t: t != ""))), " ")


def normal_style(value: Column) -> Column:
    """Known properties in the registered order, the last of a name; then others as they stood."""
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    pieces = F.filter(F.split(value, ";"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(pieces, lambda p: F.struct(bare(F.substring_index(p, ":", 1)).alias("k"), bare(F.substr(p, F.instr(p, ":") + 1)).alias("v")))

    def ordered(own: Column) -> Column:
        known = F.transform(
            F.array(*map(F.lit, v.STYLE_ORDER)),
            lambda k: F.try_element_at(F.filter(own, lambda p: p["k"] == k), F.lit(-1)),
        )
        rest = F.filter(own, lambda p: ~p["k"].isin(v.STYLE_ORDER))
        return F.array_join(F.transform(F.concat(F.filter(known, lambda p: p.isNotNull()), rest), lambda p: F.concat(p["k"], F.lit(":"), p["v"])), "; ")

    return _let(pairs, ordered)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def asset_id(blob: Column) -> Column:
    return F.concat(F.lit("asset-"), F.substr(F.sha2(blob, 256), F.lit(1), F.lit(12)))


def valid_chunk_id(value: Column) -> Column:
    return F.rlike(value, F.lit(v.CHUNK_ID)) & ~value.isin(v.RESERVED) & ~value.startswith("p-")


def valid_proposal_id(value: Column) -> Column:
    return F.rlike(value, F.lit(v.PROPOSAL_ID))


def minted_id(*parts: Column) -> Column:
    """An id made from what it names: the same plan run again mints the same."""
    return F.substr(F.lower(F.conv(F.substr(F.sha2(F.concat_ws("\0", *parts), 256), F.lit(1), F.lit(13)), 16, 32)), F.lit(1), F.lit(8))


def version_key(value: Column) -> Column:
    """Numbers of a dotted version, null where it is none."""
    return F.when(F.rlike(value, F.lit(r"^\d+(\.\d+)*\z")), F.transform(F.split(value, r"\."), lambda x: x.cast("int")))


def implements(value: Column, own: str = v.VERSION) -> Column:
    """Whether a tool of version ``own`` implements a declared version."""
    mine = F.array(*[F.lit(int(x)) for x in own.split(".")])
    return F.coalesce(version_key(value) <= mine, F.lit(False))


def url_allowed(kind: str, value: Column) -> Column:
    schemes = v.URL_SCHEMES.get(kind)
    if not schemes:
        return F.lit(True)
    low = F.lower(value)
    allowed = F.contains(low, F.lit(":")) & F.substring_index(low, ":", 1).isin([s for s in schemes if ":" not in s and s != "#"])
    for s in schemes:
        if s == "#" or ":" in s:
            allowed = allowed | low.startswith(s)
    return allowed


def parse_actor(spec: Column) -> Column:
    """``type, id, model`` of human:ID, agent:MODEL or external[:ID]; null where it is none."""
    kind = F.trim(F.substring_index(spec, ":", 1))
    value = F.nullif(F.trim(F.when(F.contains(spec, F.lit(":")), F.substr(spec, F.instr(spec, ":") + 1))), F.lit(""))
    ok = (kind == "external") | (kind.isin("human", "agent") & value.isNotNull())
    return F.when(ok, F.struct(kind.alias("type"), F.when(kind != "agent", value).alias("id"), F.when(kind == "agent", value).alias("model")))


def state_changing(kind: Column, decision: Column) -> Column:
    return F.coalesce((kind == "direct_edit") | ((kind == "resolution") & (decision == "accepted")), F.lit(False))


def applied_payload(kind: Column, after: Column, proposed: Column, applied: Column, has_applied: Column | None = None) -> Column:
    """What an event put into the document. An ``applied`` that is there wins over the proposal, even as a null.

    ``has_applied`` tells whether the event has the field; without it, a null counts as absent.
    """
    has = applied.isNotNull() if has_applied is None else has_applied
    return F.when(kind == "resolution", F.when(has, applied).otherwise(proposed)).otherwise(after)


def rgb(value: Column) -> Column:
    """#rrggbb of #rrggbb, #rgb or rgb(r, g, b) with clamped parts; null for others."""
    part = lambda k: F.lpad(F.hex(F.least(F.lit(255), F.regexp_extract(value, r"^rgb\((\d{1,3}), ?(\d{1,3}), ?(\d{1,3})\)$", k).try_cast("int"))), 2, "0")
    low = F.lower(value)
    return (
        F.when(F.rlike(low, F.lit(r"^#[0-9a-f]{6}$")), low)
        .when(F.rlike(low, F.lit(r"^#[0-9a-f]{3}$")), F.regexp_replace(low, r"([0-9a-f])", "$1$1"))
        .when(F.rlike(value, F.lit(r"^rgb\(\d{1,3}, ?\d{1,3}, ?\d{1,3}\)$")), F.lower(F.concat(F.lit("#"), part(1), part(2), part(3))))
    )


def protect_markdown(text: Column, in_table: bool = False) -> Column:
    """Markdown's special characters behind backslashes, also what would open a block at the start of a line."""
    out = F.regexp_replace(text, r"([\\`*_\[\]~&<])", r"\\$1")
    if in_table:
        return F.replace(out, F.lit("|"), F.lit("\\|"))
    # ordered marks are escaped at their punctuation
    out = F.regexp_replace(out, r"(?md)^([^\S\n]{0,3}\d{1,9})([.)])(?=\s|$)", r"$1\\$2")
    return F.regexp_replace(out, r"(?md)^([^\S\n]{0,3})(?=#{1,6}(?:\s|$)|[>+-](?:\s|$)|(?:-[^\S\n]*){3,}$|=+[^\S\n]*$|-+[^\S\n]*$)", r"$1\\")


def code_fence(code: Column) -> Column:
    """A run of backticks longer than any inside, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(code, F.lit(r"(`+)"), F.lit(1)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def elide_data(markup: Column) -> Column:
    """Markup without the bodies of long data URIs."""
    return F.regexp_replace(markup, "data:[^\"'\\s]{64,}", "[data-uri elided]")


def format_number(n: Column, style: str) -> Column:
    """A list number in decimal, letters (a .. z, aa, ab) or roman figures; nothing for bullets, decimal for other styles.

    Letters and figures of numbers below one are empty.
    """
    if style in ("bullet", "none"):
        return F.when(n.isNotNull(), "")
    if style in ("lowerLetter", "upperLetter"):
        first = F.lit(97 if style == "lowerLetter" else 65)
        start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
        # digits from 1 to 26, the last one first; 14 of them hold any long
        digit = lambda a: F.concat(F.char(first + F.pmod(a["left"] - 1, F.lit(26))), a["out"])
        more = lambda a, _: F.struct(F.when(a["left"] > 0, F.floor((a["left"] - 1) / 26)).otherwise(F.lit(0)).alias("left"), F.when(a["left"] > 0, digit(a)).otherwise(a["out"]).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, more, lambda a: a["out"])
    if style not in ("lowerRoman", "upperRoman"):
        return n.cast("string")
    figures = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(s).alias("s")) for k, s in figures])
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    step = lambda a, f: F.struct((a["left"] % f["k"]).alias("left"), F.concat(a["out"], F.repeat(f["s"], F.floor(a["left"] / f["k"]).cast("int"))).alias("out"))
    roman = F.when(n > 0, F.aggregate(table, start, step, lambda a: a["out"])).otherwise("")
    return F.upper(roman) if style == "upperRoman" else roman
