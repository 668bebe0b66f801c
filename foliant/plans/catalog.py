"""Named queries over plain tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import scalars as s
from foliant.functions.lineage import kept
from foliant.operators import caches, history, lane, layout, paint, reconcile, rules, views
from foliant.plans.cases import CASES
from foliant.sources import adapters, markup
from foliant.sources.adapters import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOG = """
    log0 as (
        select user_id as doc_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_id,
            case when event_type = 'purchase' then 'checkpoint' else 'direct_edit' end as kind,
            case event_type when 'signup' then 'add' when 'error' then 'delete' when 'purchase' then null else 'modify' end as action,
            json_extract_string(props, '$.k') as target,
            case when event_type in ('signup', 'click', 'view') then value end as payload
        from events
    ),
    log as (select *, case when kind = 'direct_edit' then lag(payload) over (partition by doc_id, target, kind order by seq) end as before from log0)
"""
CARDS = """
    cards as (
        select l.doc_id, l.doc_id as card_ord, l.doc_id as target, 'modify' as action,
            case when quality = 1 then 'accepted' else 'rejected' end as decision, b.text as proposed, case when toxic = 1 then b.text || ' (edited)' end as applied
        from labels l join benchmark b on b.item_id = l.doc_id % (select count(*) from benchmark)
    )
"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _log(spark: SparkSession, d: str) -> DataFrame:
    return adapters.event_log(table(spark, d, "events"))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return adapters.cards(table(spark, d, "labels"), table(spark, d, "benchmark"))


# imports, hashing, scalar functions


@query("""
    with p as (select doc_id, unnest(string_split_regex(text, '\\n[ \\t]*\\n')) as part, generate_subscripts(string_split_regex(text, '\\n[ \\t]*\\n'), 1) - 1 as ord from documents),
    l as (select doc_id, ord, list_filter(list_transform(string_split(part, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') as lines from p)
    select doc_id, ord, '<p>' || array_to_string(list_transform(lines, lambda x: replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')), '<br>') || '</p>' as html,
        array_to_string(lines, chr(10)) as text
    from l where len(lines) > 0
""")
def import_text_chunks(spark, d):
    return adapters.text_chunks(table(spark, d, "documents"))


@query("select doc_id, 'sha256:' || sha256(text) as hash from documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", s.content_hash(F.col("text")).alias("hash"))


@query("select sha256(text) as hash, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from documents group by all")
def duplicate_texts(spark, d):
    return caches.duplicate_texts(table(spark, d, "documents"))


@query("select distinct 'asset-' || substr(sha256(text), 1, 12) as id, strlen(text) as size from documents")
def asset_ids(spark, d):
    blob = F.col("text").cast("binary")
    return table(spark, d, "documents").select(s.asset_id(blob).alias("id"), F.octet_length("text").cast("long").alias("size")).distinct()


@query("""
    select doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as as_text, replace(replace(text, '&', '&amp;'), '"', '&quot;') as as_attribute
    from documents
""")
def escape_markup(spark, d):
    return table(spark, d, "documents").select("doc_id", s.escape_text(F.col("text")).alias("as_text"), s.escape_attribute(F.col("text")).alias("as_attribute"))


@query("""
    select doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))), ' ') as tokens from documents
""")
def class_token_normal_form(spark, d):
    return table(spark, d, "documents").select("doc_id", s.class_tokens(F.col("text")).alias("tokens"))


@query("""
    with e as (select event_id, 'zoom:1;top: ' || event_id || 'px ;color:#a1b2c3; left:' || user_id || 'px; oops;top:' || user_id || 'px' as style from events),
    p as (select event_id, list_transform(list_filter(string_split(style, ';'), lambda x: contains(x, ':')),
        lambda x: {'k': trim(split_part(x, ':', 1)), 'v': trim(split_part(x, ':', 2))}) as pairs from e),
    k as (select ['left', 'top', 'width', 'height', 'transform', 'z-index', 'color', 'background-color', 'border-color', 'font-size', 'font-family'] as names),
    r as (select event_id, list_filter(list_transform(names, lambda n: list_filter(pairs, lambda q: q.k = n)[-1]), lambda q: q is not null) as known,
        list_filter(pairs, lambda q: not list_contains(names, q.k)) as other from p, k)
    select event_id, array_to_string(list_transform(list_concat(known, other), lambda q: q.k || ':' || q.v), '; ') as style from r
""")
def style_normal_form(spark, d):
    style = F.concat(F.lit("zoom:1;top: "), F.col("event_id"), F.lit("px ;color:#a1b2c3; left:"), F.col("user_id"), F.lit("px; oops;top:"), F.col("user_id"), F.lit("px"))
    return table(spark, d, "events").select("event_id", s.normal_style(style).alias("style"))


@query("""
    with c as (select conv_id, turn, case role when 'user' then 'human: ' when 'assistant' then 'agent:' when 'system' then 'external' end
        || case when turn % 3 = 0 then '' when role = 'system' then ':' || conv_id else cast(conv_id as varchar) end as spec from conversations),
    p as (select *, trim(split_part(spec, ':', 1)) as k, nullif(trim(split_part(spec, ':', 2)), '') as x from c)
    select conv_id, turn, k as type, case when k <> 'agent' then x end as id, case when k = 'agent' then x end as model
    from p where k = 'external' or x is not null
""")
def actor_parse(spark, d):
    own = F.expr("case role when 'user' then 'human: ' when 'assistant' then 'agent:' when 'system' then 'external' end")
    rest = F.when(F.col("turn") % 3 == 0, "").when(F.col("role") == "system", F.concat(F.lit(":"), F.col("conv_id"))).otherwise(F.col("conv_id").cast("string"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", s.parse_actor(F.concat(own, rest)).alias("a"))
    return rows.where("a is not null").select("conv_id", "turn", "a.type", "a.id", "a.model")


_URLS = "case page_id % 5 when 0 then url when 1 then 'javascript:x' when 2 then '#top' when 3 then 'DATA:image/png;base64,AA' else replace(url, 'http', 'HTTP') end"


@query(f"""
    with u as (select page_id, lower({_URLS}) as u from pages)
    select page_id, (contains(u, ':') and split_part(u, ':', 1) in ('https', 'http', 'mailto')) or starts_with(u, '#') as link_ok,
        (contains(u, ':') and split_part(u, ':', 1) in ('https', 'http')) or starts_with(u, 'data:image/') as image_ok from u
""")
def url_policy(spark, d):
    url = F.expr(_URLS)
    return table(spark, d, "pages").select("page_id", s.url_allowed("a.href", url).alias("link_ok"), s.url_allowed("img.src", url).alias("image_ok"))


_VERSIONS = "case when event_id % 13 = 0 then 'x' else concat(event_id % 2, '.', event_id % 9, case when event_id % 3 = 0 then '.1' else '' end) end"


@query(f"""
    with e as (select event_id, {_VERSIONS} as version from events),
    k as (select *, case when regexp_full_match(version, '\\d+(\\.\\d+)*') then list_transform(string_split(version, '.'), lambda x: cast(x as integer)) end as parts from e)
    select event_id, version, coalesce(parts <= [0, 5], false) as ok from k
""")
def version_gate(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(_VERSIONS).alias("version")).withColumn("ok", s.implements(F.col("version")))


@query("""
    with e as (select event_id, case event_id % 4 when 0 then '#' || substr(md5(cast(event_id as varchar)), 1, 6) when 1 then '#A' || event_id % 10 || 'f'
        when 2 then 'rgb(' || event_id % 400 || ', ' || event_id % 256 || ',' || user_id % 256 || ')' else 'var(--x)' end as value from events)
    select event_id, case when regexp_full_match(lower(value), '#[0-9a-f]{6}') then lower(value)
        when regexp_full_match(lower(value), '#[0-9a-f]{3}') then regexp_replace(lower(value), '([0-9a-f])', '\\1\\1', 'g')
        when value like 'rgb%' then printf('#%02x%02x%02x', least(255, cast(regexp_extract(value, '(\\d+), ?(\\d+), ?(\\d+)', 1) as int)),
            least(255, cast(regexp_extract(value, '(\\d+), ?(\\d+), ?(\\d+)', 2) as int)), least(255, cast(regexp_extract(value, '(\\d+), ?(\\d+), ?(\\d+)', 3) as int))) end as rgb
    from e
""")
def color_rgb(spark, d):
    value = F.expr(
        "case event_id % 4 when 0 then concat('#', substr(md5(cast(event_id as string)), 1, 6)) when 1 then concat('#A', event_id % 10, 'f') "
        "when 2 then concat('rgb(', event_id % 400, ', ', event_id % 256, ',', user_id % 256, ')') else 'var(--x)' end"
    )
    return table(spark, d, "events").select("event_id", s.rgb(value).alias("rgb"))


@query("""
    with e as (select event_id, user_id + 1 as n, (event_id * 7) % 4100 as r from events)
    select event_id, cast(n as varchar) as decimal,
        case when n <= 26 then chr(cast(96 + n as int)) when n <= 702 then chr(cast(96 + (n - 1) // 26 as int)) || chr(cast(97 + (n - 1) % 26 as int))
            when n <= 18278 then chr(cast(97 + (n - 703) // 676 as int)) || chr(cast(97 + (n - 703) // 26 % 26 as int)) || chr(cast(97 + (n - 703) % 26 as int))
            else chr(cast(97 + (n - 18279) // 17576 as int)) || chr(cast(97 + (n - 18279) // 676 % 26 as int)) || chr(cast(97 + (n - 18279) // 26 % 26 as int)) || chr(cast(97 + (n - 18279) % 26 as int)) end as letter,
        repeat('M', cast(r // 1000 as int)) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][cast(r // 100 % 10 + 1 as int)]
            || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][cast(r // 10 % 10 + 1 as int)] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][cast(r % 10 + 1 as int)] as roman,
        '' as bullet
    from e
""")
def list_numbers(spark, d):
    n = F.col("user_id") + 1
    r = (F.col("event_id") * 7) % 4100
    return table(spark, d, "events").select(
        "event_id", s.format_number(n, "decimal").alias("decimal"), s.format_number(n, "lowerLetter").alias("letter"), s.format_number(r, "upperRoman").alias("roman"), s.format_number(n, "bullet").alias("bullet"),
    )


@query("""
    select doc_id, regexp_replace('<img src="data:image/png;base64,' || replace(text, ' ', '+') || '">', 'data:[^"''\\s]{64,}', '[data-uri elided]', 'g') as markup from documents
""")
def data_uri_elide(spark, d):
    own = F.concat(F.lit('<img src="data:image/png;base64,'), F.replace("text", F.lit(" "), F.lit("+")), F.lit('">'))
    return table(spark, d, "documents").select("doc_id", s.elide_data(own).alias("markup"))


# pages

_PAGE = "select event_id, case event_id % 7 when 0 then 'A3' when 1 then 'A4' when 2 then 'A5' when 3 then 'Letter' when 4 then 'Legal' when 5 then 'Tabloid' else 'B5' end as size, case event_id % 3 when 0 then 'portrait' when 1 then 'landscape' else 'sideways' end as orientation, case when event_id % 11 = 0 then 'wide' else concat(event_id % 120, 'mm') end as margin from"
_SIZES = "(values ('A3', 297.0, 420.0), ('A4', 210.0, 297.0), ('A5', 148.0, 210.0), ('Letter', 215.9, 279.4), ('Legal', 215.9, 355.6), ('Tabloid', 279.4, 431.8)) as z(size, w, h)"


@query(f"""
    with e as ({_PAGE} events), m as (select e.*, z.w, z.h, try_cast(regexp_extract(margin, '^(\\d+)mm$', 1) as double) as mm from e left join {_SIZES} using (size))
    select event_id, case when w is null or orientation not in ('portrait', 'landscape') then 'D003' when mm is null or mm > 100 then 'D004'
        when case when orientation = 'landscape' then h else w end - 2 * mm <= 0 or case when orientation = 'landscape' then w else h end - 2 * mm <= 0 then 'D004' end as problem
    from m
""")
def page_geometry(spark, d):
    table(spark, d, "events").createOrReplaceTempView("_foliant_events")
    rows = spark.sql(f"{_PAGE} _foliant_events")
    return rows.select("event_id", layout.page_problem(F.col("size"), F.col("orientation"), F.col("margin")).alias("problem"))


@query(f"""
    with e as (select event_id, 148.0 + (event_id % 300) / 2.0 as w, 209.0 + (user_id % 240) as h from events)
    select event_id, (select first(size order by size) from {_SIZES} where (abs(e.w - z.w) <= 1.5 and abs(e.h - z.h) <= 1.5) or (abs(e.w - z.h) <= 1.5 and abs(e.h - z.w) <= 1.5)) as size from e
""")
def named_page_match(spark, d):
    rows = table(spark, d, "events").select("event_id", (148.0 + (F.col("event_id") % 300) / 2.0).cast("double").alias("w"), (F.lit(209.0) + F.col("user_id") % 240).alias("h"))
    return layout.match_page_size(rows, "w", "h").select("event_id", "size")


# history


@query(f"with {LOG} select doc_id, kind, action, count(*) as n, count(*) filter (kind = 'direct_edit') as changing from log group by all")
def event_state_changing(spark, d):
    changing = s.state_changing(F.col("kind"), F.lit(None).cast("string"))
    return _log(spark, d).groupBy("doc_id", "kind", "action").agg(F.count("*").alias("n"), F.count_if(changing).alias("changing"))


@query("""
    with t as (select conv_id as doc_id, turn + 1 as seq from conversations where (conv_id + turn) % 7 <> 3),
    p as (select *, lag(seq) over (partition by doc_id order by seq) as last from t)
    select doc_id, seq, case when last is null then 'pruned start' when seq <= last then 'not ascending' else 'gap' end as problem
    from p where (last is null and seq > 1) or seq <= last or seq > last + 1
""")
def seq_gap_check(spark, d):
    return history.sequence_problems(adapters.turns(table(spark, d, "conversations"), damaged=True))


@query("""
    with t as (select conv_id as doc_id, turn + 1 as seq from conversations where (conv_id + turn) % 7 <> 3),
    g as (select doc_id, min(seq) as first, max(seq) as last, count(*) as n from t group by doc_id)
    select doc_id, case when last - first + 1 <> n then 'gaps' else 'pruned' end as reason from g where last - first + 1 <> n or first <> 1
""")
def reconcile_log_check(spark, d):
    return reconcile.log_refusals(adapters.turns(table(spark, d, "conversations"), damaged=True))


_AT = """
    last as (select doc_id, target, arg_max(action, seq) as action, max(seq) as seq from log where kind = 'direct_edit' and seq <= 20 group by all)
    select l.doc_id, l.target, p.payload from last l join log p on p.doc_id = l.doc_id and p.seq = l.seq where l.action <> 'delete'
"""


@query(f"with {LOG}, {_AT}")
def state_at_n(spark, d):
    return history.state_at(_log(spark, d), 20)


@query(f"with {LOG}, {_AT}")
def state_by_undoing(spark, d):
    log = _log(spark, d)
    return history.state_before(log, history.state_at(log, 1 << 60), 20)


@query(f"""
    with {LOG}, c as (select *, lag(payload) over w as was, row_number() over w as nth from (select *, case when event_id % 50 = 7 then -1 else before end as told from log where kind = 'direct_edit')
        window w as (partition by doc_id, target order by seq))
    select doc_id, seq, target from c where nth > 1 and told is distinct from was
""")
def verify_flat_chain(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.expr("row_number() over (partition by user_id order by ts, event_id)").cast("long").alias("seq"), "event_id")
    log = _log(spark, d).join(ids, ["doc_id", "seq"]).withColumn("before", F.when(F.col("event_id") % 50 == 7, F.lit(-1.0)).otherwise(F.col("before")))
    return history.chain_breaks(log)


_ORIGIN = "case when seq % 4 = 1 then 'undo' when seq % 11 = 2 then 'redo' else 'user' end"


@query(f"""
    with recursive {LOG}, c as (select doc_id, seq, {_ORIGIN} as origin, row_number() over (partition by doc_id order by seq desc) as k from log where kind = 'direct_edit'),
    w(doc_id, k, skip, found) as (
        select distinct doc_id, cast(0 as bigint), 0, cast(null as bigint) from c
        union all
        select w.doc_id, c.k, case c.origin when 'undo' then w.skip + 1 when 'redo' then w.skip - 1 else case when w.skip > 0 then w.skip - 1 else w.skip end end,
            case when c.origin = 'user' and w.skip <= 0 then c.seq end
        from w join c on c.doc_id = w.doc_id and c.k = w.k + 1 where w.found is null
    )
    select doc_id, found as seq from w where found is not null
""")
def undo_candidate(spark, d):
    return history.undo_candidates(_log(spark, d).withColumn("origin", F.expr(_ORIGIN)))


@query(f"""
    with {LOG} select doc_id, seq, target, case action when 'add' then 'delete' when 'delete' then 'add' else action end as action, payload as before, before as after
    from log where kind = 'direct_edit'
""")
def inverse_events(spark, d):
    return history.inverses(_log(spark, d))


@query(f"with {LOG} select doc_id, seq, 'v' || target as label from log where kind = 'checkpoint'")
def checkpoint_listing(spark, d):
    return _log(spark, d).where("kind = 'checkpoint'").select("doc_id", "seq", F.concat(F.lit("v"), F.col("target")).alias("label"))


@query(f"with {LOG}, m as (select doc_id, max(seq) as latest from log group by doc_id) select doc_id, count(*) as n, min(seq) as floor from log join m using (doc_id) where seq >= 30 or latest < 30 group by doc_id")
def prune_floor(spark, d):
    return history.prune(_log(spark, d), 30).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("seq").alias("floor"))


@query(f"""
    with {LOG}, m as (select doc_id, min(seq) as cut from log where kind = 'checkpoint' and target = '7' group by doc_id)
    select doc_id, count(*) as n, min(seq) as floor from log left join m using (doc_id) where cut is null or seq >= cut group by doc_id
""")
def prune_at_checkpoint(spark, d):
    log = _log(spark, d).withColumn("label", F.col("target"))
    labels = log.select("doc_id", F.lit("7").alias("label")).distinct()
    return history.prune_at_label(log, labels).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("seq").alias("floor"))


@query(f"""
    with {LOG}, b as (select distinct doc_id, cast(target as int) % 40 + 1 as n from log),
    c as (select doc_id, n, row_number() over (partition by doc_id order by n) as k from b)
    select doc_id, 'b' || coalesce(min(k) filter (n > k), max(k) + 1) as batch from c group by doc_id
""")
def next_batch(spark, d):
    return history.next_batch(_log(spark, d).withColumn("batch", F.concat(F.lit("b"), (F.col("target").cast("int") % 40 + 1).cast("string"))))


@query(f"""
    with {LOG}, live as (select doc_id, target, arg_max(action, seq) as action from log where kind = 'direct_edit' group by all)
    select doc_id, target from live where action = 'delete'
""")
def burned_ids(spark, d):
    log = history.changes(_log(spark, d))
    used = log.select("doc_id", "target").distinct()
    return used.join(history.state_at(log, 1 << 60), ["doc_id", "target"], "left_anti")


@query()
def replay_documents(spark, d):
    held = F.col("before").isNotNull()
    action = F.when(F.col("action") == "delete", F.when(held, "delete")).when(held, "modify").otherwise("add")
    log = history.changes(_log(spark, d)).withColumn("action", action).where("action is not null")
    return history.replay(log.withColumn("after", F.lit(None).cast("string")))


@query()
def history_field_findings(spark, d):
    actor = F.create_map(F.lit("type"), F.col("actor_type"))
    rows = adapters.turns(table(spark, d, "conversations"))
    fields = F.struct("seq", F.lit("direct_edit").alias("kind"), F.lit("2026-01-01T00:00:00Z").alias("t"), F.lit("c1").alias("target"), F.when(F.col("seq") % 2 == 0, "modify").otherwise("edit").alias("action"), actor.alias("author"))
    return history.field_problems(rows.select("doc_id", F.col("seq").alias("line_ord"), F.to_json(fields).alias("raw")))


# proposals


@query(f"""
    with {LOG}, c as (select doc_id, seq as card_ord, target, action from log where action is not null)
    select doc_id, card_ord, target, action,
        case when action <> 'add' then lead(card_ord) over (partition by doc_id, target, case when action <> 'add' then 'content' end order by card_ord) end as superseded_by from c
""")
def supersede_latest(spark, d):
    cards = _log(spark, d).where("action is not null").select("doc_id", F.col("seq").alias("card_ord"), "target", "action")
    return lane.live_cards(cards)


@query(f"""
    with {CARDS} select doc_id, card_ord, decision, case when decision = 'accepted' then coalesce(nullif(applied, proposed), proposed) end as written,
        nullif(applied, proposed) is not null and decision = 'accepted' as corrected from cards
""")
def accept_with_tweaks(spark, d):
    return lane.resolutions(_cards(spark, d))


@query(f"with {CARDS} select decision, count(*) as n, count(*) filter (nullif(applied, proposed) is not null and decision = 'accepted') as corrected from cards group by decision")
def resolution_counts(spark, d):
    return lane.resolutions(_cards(spark, d)).groupBy("decision").agg(F.count("*").alias("n"), F.count_if("corrected").alias("corrected"))


@query(f"with {CARDS} select c.doc_id, card_ord, target from cards c left join documents d on d.doc_id = c.target + 3 where d.doc_id is null")
def dangling_targets(spark, d):
    units = table(spark, d, "documents").select((F.col("doc_id") - 3).alias("doc_id"), (F.col("doc_id") - 3).alias("target"))
    return lane.dangling_targets(_cards(spark, d), units).select("doc_id", "card_ord", "target")


@query(f"""
    with {CARDS} select c.doc_id, card_ord, 1 as part, 'del' as op, d.text from cards c join documents d on d.doc_id = c.target
    union all select doc_id, card_ord, 2, 'ins', proposed from cards
""")
def tracked_revisions(spark, d):
    before = table(spark, d, "documents").select(F.col("doc_id").alias("target"), F.col("text").alias("before"))
    return layout.revisions(_cards(spark, d).join(before, "target", "left"))


_CHAIN = "select user_id as doc_id, event_id as id, row_number() over (partition by user_id order by event_id) as k, count(*) over (partition by user_id) as n, event_type from"


def _chained(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("_foliant_events")
    own = spark.sql(f"{_CHAIN} _foliant_events")
    place = F.when(F.col("event_type").isin("click", "view"), (F.col("k") * 7) % F.col("n") + 1)
    own = own.withColumn("to", place)
    named = own.select("doc_id", F.col("k").alias("to"), F.col("id").alias("after"))
    return own.join(named, ["doc_id", "to"], "left").select("doc_id", "id", F.col("k").alias("card_ord"), F.lit("add").alias("action"), "after")


_CHAIN_SQL = f"""
    own as ({_CHAIN} events), to_k as (select *, case when event_type in ('click', 'view') then (k * 7) % n + 1 end as t from own),
    links as (select a.doc_id, a.id, b.id as after from to_k a left join to_k b on b.doc_id = a.doc_id and b.k = a.t),
    walk(doc_id, id, here, depth) as (
        select doc_id, id, after, cast(1 as bigint) from links
        union all select w.doc_id, w.id, l.after, w.depth + 1 from walk w join links l on l.doc_id = w.doc_id and l.id = w.here where w.here <> w.id and w.depth < 500
    )
"""


@query(f"""
    with recursive {_CHAIN_SQL}
    select doc_id, id, coalesce(bool_or(here = id), false) as in_cycle, not bool_or(here is null) as leads_to_cycle from walk group by doc_id, id
""")
def chain_cycles(spark, d):
    return lane.chains(_chained(spark, d)).select("doc_id", "id", "in_cycle", "leads_to_cycle")


@query(f"with recursive {_CHAIN_SQL} select doc_id, id, depth from walk where here is null")
def chain_depth(spark, d):
    return lane.chains(_chained(spark, d)).where("not leads_to_cycle").select("doc_id", "id", "depth")


@query()
def creation_order(spark, d):
    return lane.creation_order(_chained(spark, d))


@query()
def resolve_lane(spark, d):
    units = adapters.turns(table(spark, d, "conversations")).select("doc_id", F.col("seq").alias("ord"), F.col("seq").alias("id"), F.col("text").alias("payload"))
    action = F.expr("case id % 4 when 0 then 'modify' when 1 then 'add' when 2 then 'move' else 'delete' end")
    own = units.select(
        "doc_id", F.col("ord").alias("card_ord"), (F.col("id") + 100).alias("id"), action.alias("action"), F.col("id").alias("target"),
        F.when(F.col("id") > 2, F.col("id") - 2).alias("after"), F.upper("payload").alias("payload"), F.lit("accepted").alias("decision"),
    )
    return lane.resolve_lane(units, own)


# reconcile

_ACTUAL = "case when doc_id % 5 = 0 then reverse(text) else text end"


@query(f"""
    with e as (select doc_id % 50 as g, doc_id as id, text as serial from documents),
    a as (select doc_id % 50 as g, case when doc_id % 11 = 0 then doc_id + 1000000 else doc_id end as id, {_ACTUAL} as serial from documents where doc_id % 7 <> 3)
    select coalesce(e.g, a.g) as doc_id, coalesce(e.id, a.id) as id, case when e.id is null then 'added' when a.id is null then 'deleted' when e.serial <> a.serial then 'modified' else 'same' end as change
    from e full join a on e.g = a.g and e.id = a.id
""")
def reconcile_changes(spark, d):
    docs = table(spark, d, "documents")
    e = docs.select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("id"), F.col("text").alias("serial"))
    moved = F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") + 1000000).otherwise(F.col("doc_id"))
    a = docs.where("doc_id % 7 <> 3").select((F.col("doc_id") % 50).alias("doc_id"), moved.alias("id"), F.expr(_ACTUAL).alias("serial"))
    return reconcile.unit_changes(e, a)


@query()
def reconcile_script(spark, d):
    units = adapters.turns(table(spark, d, "conversations")).select("doc_id", F.col("seq").alias("ord"), F.col("seq").alias("id"), F.col("text").alias("serial"))
    actual = units.where("(doc_id + id) % 7 <> 3").withColumn("ord", F.when(F.col("id") % 3 == 0, -F.col("ord")).otherwise(F.col("ord")))
    return reconcile.edit_script(units, actual)


# caches

_VEC = """
    vec as (
        select vec_id as chunk, label as model, case when vec_id % 5 = 0 then '0' else coalesce(sha256(text), '1') end as text_hash
        from embeddings left join documents on doc_id = vec_id
    )
"""


@query(f"with {_VEC} select chunk, model, case when doc_id is null then 'orphaned' else 'outdated' end as reason from vec left join documents on doc_id = chunk where doc_id is null or sha256(text) <> text_hash")
def stale_embeddings(spark, d):
    docs = table(spark, d, "documents")
    return caches.stale_vectors(adapters.vector_lines(table(spark, d, "embeddings"), docs), docs.select(F.col("doc_id").alias("chunk"), "text"))


@query("select vec_id % 97 as chunk, label as model, arg_max(sha256(cast(vec_id as varchar)), vec_id) as text_hash, max(vec_id) as line_ord from embeddings group by all")
def embedding_upsert(spark, d):
    lines = table(spark, d, "embeddings").select((F.col("vec_id") % 97).alias("chunk"), F.col("label").alias("model"), F.sha2(F.col("vec_id").cast("string"), 256).alias("text_hash"), F.col("vec_id").alias("line_ord"))
    return caches.upsert_vectors(lines)


@query("select doc_id, 'asset-' || substr(sha256(text), 1, 12) as id from documents where doc_id % 3 <> 0")
def gc_assets(spark, d):
    own = table(spark, d, "documents").select("doc_id", s.asset_id(F.col("text").cast("binary")).alias("id"))
    refer = F.concat(F.lit('<use href="#'), F.col("id"), F.lit('"/>')).alias("markup")
    return caches.dead_assets(own, own.where("doc_id % 6 = 0").select("doc_id", refer), own.where("doc_id % 6 = 3").select("doc_id", refer))


_TAG = "case when role = 'system' then 'aim-slide' when turn % 4 = 1 then 'h2' else 'p' end"


#: What stands within a slide: a child, a heading further down, and a heading that is a child.
_INSIDE = "array(named_struct('at', 1, 'depth', 1, 'id', turn + 1000, 'tag', 'p', 'text', 'x'), named_struct('at', 3, 'depth', 1, 'id', turn + 2000, 'tag', 'h2', 'text', substr(text, 1, 9)), named_struct('at', 2, 'depth', 2, 'id', cast(null as bigint), 'tag', case when conv_id % 2 = 0 then 'h3' else 'span' end, 'text', concat('deep ', turn)))"


@query(f"""
    with c as (select conv_id as doc_id, turn as ord, turn as id, {_TAG} as tag, text from conversations),
    t as (select *, sum(case when tag in ('h2', 'aim-slide') then 1 else 0 end) over (partition by doc_id order by ord) as starts,
        sum(case when tag = 'aim-slide' then 1 else 0 end) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding) as slides_before from c),
    g as (select doc_id, case when tag = 'aim-slide' then 'slide' when starts > 0 and exists (select 1 from c h where h.doc_id = t.doc_id and h.ord <= t.ord and h.tag = 'h2'
        and not exists (select 1 from c x where x.doc_id = t.doc_id and x.tag = 'aim-slide' and x.ord > h.ord and x.ord < t.ord)) then 'titled' else 'bare' end as kind,
        case when tag = 'aim-slide' then starts * 2 else starts * 2 + 1 end as part, ord, id, tag, text from t),
    e as (select doc_id, part, any_value(kind) as kind, min(ord) as first, string_agg(cast(id as varchar), ',' order by ord) as own from g group by doc_id, part),
    n as (select *, row_number() over (partition by doc_id order by first) as place from e)
    select n.doc_id, n.place as ord, case n.kind when 'slide' then case when n.doc_id % 2 = 0 then 'deep ' || n.first else substr(c.text, 1, 9) end when 'titled' then case when c.tag = 'h2' then c.text else '' end else '' end as title,
        case when c.tag = 'h2' then 2 else 1 end as level, case n.kind when 'slide' then own || ',' || (n.first + 1000) || ',' || (n.first + 2000) else own end as chunks
    from n join c on c.doc_id = n.doc_id and c.ord = n.first
""")
def toc_sections(spark, d):
    turns = table(spark, d, "conversations").withColumn("tag", F.expr(_TAG))
    rows = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("turn").alias("id"), "tag", "text")
    inside = turns.where("tag = 'aim-slide'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.inline(F.expr(_INSIDE)))
    return caches.contents(rows, inside).withColumn("chunks", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ","))


@query("select conv_id as doc_id, 'sha256:' || sha256(string_agg(replace(text, chr(10), ' '), chr(10) order by turn) || chr(10)) as hash from conversations group by conv_id")
def document_hash(spark, d):
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(lines.alias("l"))
    return rows.select("doc_id", s.content_hash(F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))).alias("hash"))


# layout and paint


@query("""
    with i as (select conv_id as doc_id, turn as ord, case when turn % 3 = 0 then 0 else 1 end as level from conversations),
    c as (select *, sum(case when level = 0 then 1 else 0 end) over (partition by doc_id order by ord) as top from i),
    n as (select *, count(*) over (partition by doc_id, top, level order by ord) as deep from c)
    select doc_id, ord, cast(case when level = 0 then top else deep end as bigint) as number,
        case when level = 0 then cast(top as bigint)::varchar else greatest(cast(top as bigint), 1) || '.' || deep end as label from n
""")
def numbering_labels(spark, d):
    level = F.when(F.col("turn") % 3 == 0, 0).otherwise(1)
    items = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.lit("s").alias("scheme"), level.alias("level"))
    return layout.number_labels(items).select("doc_id", "ord", "number", "label")


#: Texts with what Markdown would read as blocks at the start of a line.
_OPENER = "concat(array('', '# ', '- ', '3. ', '---', '+ ', '> ', '12) ', '== ', '1.5 ', '####### ', '   * ')[turn % 12], text)"


@query(f"""
    with c as (select conv_id as doc_id, turn as ord, {_TAG} as tag, ['', '# ', '- ', '3. ', '---', '+ ', '> ', '12) ', '== ', '1.5 ', '####### ', '   * '][turn % 12 + 1] || text as text from conversations),
    l as (select *, list_transform(string_split(regexp_replace(text, '([\\\\`*_\\[\\]~&<])', '\\\\\\1', 'g'), chr(10)),
        lambda x: case when regexp_matches(x, '^\\s{{0,3}}\\d{{1,9}}[.)](\\s|$)') then regexp_replace(x, '^(\\s{{0,3}}\\d{{1,9}})([.)])', '\\1\\\\\\2')
            when regexp_matches(x, '^\\s{{0,3}}((#{{1,6}}|[>+-])(\\s|$)|(-\\s*){{3,}}$|=+\\s*$|-+\\s*$)') then regexp_replace(x, '^(\\s{{0,3}})', '\\1\\\\') else x end) as lines from c)
    select doc_id, string_agg(case when tag = 'h2' then '## ' || array_to_string(lines, chr(10)) else array_to_string(lines, '  ' || chr(10)) end, chr(10) || chr(10) order by ord) as markdown from l group by doc_id
""")
def markdown_export(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.expr(_TAG).alias("tag"), F.expr(_OPENER).alias("text"))
    return layout.to_markdown(rows)


@query("""
    select event_id, case when event_type = 'error' then case when user_id % 3 = 0 then null when user_id % 3 = 1 then 'tweak' else 'proposal' end else 'after' end as payload from events
""")
def applied_payloads(spark, d):
    rows = table(spark, d, "events").withColumn("e", F.expr("parse_json(case user_id % 3 when 0 then '{\"applied\": null, \"proposed\": \"proposal\"}' when 1 then '{\"applied\": \"tweak\", \"proposed\": \"proposal\"}' else '{\"proposed\": \"proposal\"}' end)"))
    get = lambda k: F.try_variant_get("e", f"$.{k}", "string")
    has = F.try_variant_get("e", "$.applied", "variant").isNotNull()
    kind = F.when(F.col("event_type") == "error", "resolution").otherwise("direct_edit")
    return rows.select("event_id", s.applied_payload(kind, F.lit("after"), get("proposed"), get("applied"), has).alias("payload"))


@query("""
    with x as (select user_id as doc_id, cast(json_extract_string(props, '$.k') as int) as node_id, event_id % 3 as layer, event_id as ord,
        unnest(case when event_type = 'click' then ['border-top-color', 'border-right-color', 'border-bottom-color', 'border-left-color'] else ['background-color'] end) as prop,
        '#' || substr(md5(cast(event_id as varchar)), 1, 6) as value from events)
    select doc_id, node_id, prop, arg_max(value, layer * 100000000 + ord) as value from x group by all
""")
def paint_cascade(spark, d):
    value = F.concat(F.lit("#"), F.substr(F.md5(F.col("event_id").cast("string")), F.lit(1), F.lit(6)))
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.get_json_object("props", "$.k").cast("int").alias("node_id"), (F.col("event_id") % 3).alias("layer"), F.col("event_id").alias("ord"),
        F.when(F.col("event_type") == "click", "border-color").otherwise("background").alias("prop"), value.alias("value"),
    )
    return paint.cascade(rows)


# markup


@query("select page_id as doc_id, contains(html, '</html>') as parsed from pages")
def parse_pages(spark, d):
    return markup.nodes(table(spark, d, "pages")).groupBy("doc_id").agg(F.bool_and(F.col("error").isNull()).alias("parsed"))


@query()
def canonical_pages(spark, d):
    return markup.canonical(table(spark, d, "pages"))


@query()
def page_outline(spark, d):
    return views.outline(markup.nodes(table(spark, d, "pages")))


@query()
def page_findings(spark, d):
    pages = table(spark, d, "pages")
    return rules.findings(kept(markup.nodes(pages)), kept(markup.surfaces(pages)), markup.canonical(pages))


@query()
def page_surfaces(spark, d):
    return markup.surfaces(table(spark, d, "pages"))


@query()
def flattened_pages(spark, d):
    return markup.flattened(table(spark, d, "pages"))


_SETUP = "case turn % 5 when 0 then '{}' when 1 then '{\"page\":{\"size\":\"A5\",\"orientation\":\"landscape\"}}' when 2 then concat('{\"page\":{\"margins\":{\"top\":\"', conv_id % 300, 'mm\",\"left\":\"', conv_id % 7, '.50mm\"}}}') when 3 then '{\"page\":{\"size\":\"B9\"}}' else 'x' end"


@query("""
    with s as (select conv_id * 100 + turn as doc_id, turn % 5 as k, conv_id as c from conversations),
    g as (select doc_id, case k when 3 then 'D003' when 4 then 'D001' when 2 then case when c % 300 > 100 then 'D004' end end as problem, case when k = 1 then 210.0 else 210.0 end as w, case when k = 1 then 148.0 else 297.0 end as h,
        case when k = 2 then c % 300 else 15 end as t, case when k = 2 then (c % 7) || '.5' else '15' end as l from s)
    select doc_id, case when problem is null then '@page{size:' || cast(w as int) || 'mm ' || cast(h as int) || 'mm;margin:' || t || 'mm 15mm 15mm ' || l || 'mm}' end as css, problem from g
""")
def page_css(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("page_id"), F.expr(_SETUP).alias("s"))
    html = F.concat(F.lit('<html><head><script type="application/aim-doc+json">'), F.col("s"), F.lit("</script></head><body></body></html>"))
    setups = views.page_setup(markup.nodes(rows.select("page_id", html.alias("html"))))
    return setups.join(views.page_css(setups), "doc_id", "left").select("doc_id", "css", "problem")


@query("""
    select conv_id * 100 + turn as doc_id, 'sha256:' || sha256('<html lang="en">' || chr(10) || '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' || chr(10)
        || '<h2 data-aim="a">' || role || '</h2>' || chr(10)) as doc_hash from conversations
""")
def document_state_hash(spark, d):
    escaped = s.escape_text(F.col("text"))
    html = F.concat(F.lit('<html LANG="en"><head></head><body><p>'), escaped, F.lit('</p>\n<h2  data-aim="a">'), F.col("role"), F.lit("</h2></body></html>"))
    pages = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("page_id"), html.alias("html"))
    return views.document_hashes(markup.surfaces(pages))


@query("""
    select code, count(*) as docs from (
        select 'S000' as code, page_id from pages where not contains(html, '</html>')
        union all select unnest(['S001', 'S005', 'X004', 'H001']), page_id from pages where contains(html, '</html>')
    ) group by code
""")
def finding_counts(spark, d):
    found = rules.findings(kept(markup.nodes(table(spark, d, "pages"))))
    return found.where(F.col("code").isin("S000", "S001", "S005", "X004", "H001")).groupBy("code").agg(F.count_distinct("doc_id").alias("docs"))


_CASES = [(2 * k + bad, code, bool(bad)) for k, (code, *_) in enumerate(CASES) for bad in (0, 1)]


@query(f"""
    with c(k, code, found) as (values {", ".join(f"({k}, '{code}', {bad})" for k, code, bad in _CASES)})
    select doc_id, code, found from documents join c on c.k = doc_id % {len(_CASES)}
""")
def rule_cases(spark, d):
    """Every rule on a document that breaks it and one that does not, with the text of a document in it."""
    made = spark.createDataFrame([(2 * k + bad, code, texts[1 - bad]) for k, (code, *texts) in enumerate(CASES) for bad in (0, 1)], "k long, code string, html string")
    text = s.escape_text(F.regexp_replace("text", r"[\\x00-\\x1f]", " "))
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % len(_CASES)).alias("k"), text.alias("text"))
    pages = kept(docs.join(F.broadcast(made), "k").select(F.col("doc_id").alias("page_id"), "code", F.replace("html", F.lit("@"), F.col("text")).alias("html")))
    found = rules.findings(kept(markup.nodes(pages)), kept(markup.surfaces(pages)), markup.canonical(pages)).select(F.col("doc_id").alias("page_id"), "code", F.lit(True).alias("found")).distinct()
    return pages.select("page_id", "code").join(found, ["page_id", "code"], "left").select(F.col("page_id").alias("doc_id"), "code", F.coalesce("found", F.lit(False)).alias("found"))


@query("select page_id as doc_id, len(regexp_extract_all(html, '<script')) as n from pages where contains(html, '</html>') and contains(html, '<script')")
def script_blocks(spark, d):
    found = rules.node_rules(markup.nodes(table(spark, d, "pages")))
    return found.where("code = 'X004'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("select page_id as doc_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as url from pages where contains(html, '</html>')")
def page_links(spark, d):
    return views.links(markup.nodes(table(spark, d, "pages"))).where("kind = 'a.href'").select("doc_id", "url")


@query("select page_id as doc_id, len(regexp_extract_all(html, '<(iframe|object|embed|form|input|button|select|textarea|video|audio|canvas|base|frame|frameset|applet|math)[ >]')) as n from pages where contains(html, '</html>') and regexp_matches(html, '<(iframe|object|embed|form|input|button|select|textarea|video|audio|canvas|base|frame|frameset|applet|math)[ >]')")
def forbidden_elements(spark, d):
    return rules.node_rules(markup.nodes(table(spark, d, "pages"))).where("code = 'X001'").groupBy("doc_id").agg(F.count("*").alias("n"))
