"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import language, lines, packing, pages, quality, simhash, substrings, tokens, topk, toxicity
from foliant.llm.common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score_texts(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(read_table(spark, sf_dir, "documents"), path, capacity=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = tokens.encode_texts(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, outputs=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.drop_common_lines(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_topk": op2_topk,
    "op3_pages": op3_pages,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_substrings": op9_substrings,
    "op10_lines": op10_lines,
}

#: White space of the word rule, as DuckDB writes it.
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {
    "op2_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id,
                cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
        )
        select * from (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
            from s
        ) where rank <= 5
    """,
    "op4_quality": f"""
        with d as (
            select doc_id, coalesce(source, '') as host, coalesce(text, '') as text,
                list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words
            from documents
        ),
        w as (select doc_id, words[i:i + 2] as gram, i from (select *, unnest(range(1, len(words) - 1)) as i from d where len(words) > 2)),
        twice as (select doc_id, i, count(*) over (partition by doc_id, gram) as n from w),
        covered as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice where n > 1) group by doc_id),
        l as (select doc_id, host, unnest(string_split(text, chr(10))) as line from d),
        k as (
            select *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
            from l where trim(line, {_SPACES}) <> ''
        ),
        dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from k group by doc_id),
        hosts as (select host, count(*) as host_docs from d group by host),
        common as (
            select host, line_key from (select host, line_key, count(distinct doc_id) as n from k group by all) join hosts using (host)
            where n >= 10 and n >= least(host_docs * 0.005, 100)
        ),
        lost as (
            select doc_id, sum(length(line_key)) as chars, coalesce(sum(length(line_key)) filter (c.line_key is not null), 0) as gone
            from k left join common c using (host, line_key) group by doc_id
        ),
        b as (
            select d.doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
                length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
                coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
                coalesce(chars, 0) as chars, coalesce(gone, 0) as gone
            from d left join covered using (doc_id) left join dup using (doc_id) left join lost using (doc_id)
        ),
        f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            not base_failed and not (gone > 0 and (chars - gone < 0.3 * chars or chars - gone < 200)) as kept
        from f
    """,
    "op9_substrings": """
        with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents),
        w as (select doc_id, len(words) as n, words, unnest(range(1, len(words) - 18)) as start from d where len(words) >= 20),
        k as (select doc_id, start, array_to_string(words[start:start + 19], ' ') as words from w),
        f as (select *, row_number() over (partition by words order by doc_id, start) > 1 as later from k),
        gone as (select distinct doc_id, unnest(range(start, start + 20)) as pos from f where later),
        p as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
        m as (select p.*, gone.pos is not null as gone from p left join gone using (doc_id, pos)),
        r as (
            select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed,
                string_agg(word, ' ' order by pos) filter (not gone) as kept
            from m group by doc_id
        )
        select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from d left join r using (doc_id)
    """,
    "op10_lines": f"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
        l as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from d),
        k as (
            select *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key from l
        ),
        common as (select line_key from k where line_key <> '' group by line_key having count(distinct doc_id) >= 10),
        m as (select k.*, c.line_key is not null as gone from k left join common c using (line_key))
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from m group by doc_id
    """,
}
