"""The registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; the package that holds them is installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packing_encoder():
    import public_tokenizers

    from .packing import encoder

    return encoder(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(common.documents(spark, sf_dir)).drop("class_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_column, media_features

    return media_features(media_column(common.documents(spark, sf_dir))).withColumn("feature", F.lower(F.hex("hash"))).drop("hash")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_decode, bpe_encode

    path = tokenizer_file("word_bpe_49k.json")
    decoded = bpe_decode(bpe_encode(common.documents(spark, sf_dir), path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.concat_ws(" ", F.col("ids").cast("array<string>")), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(common.documents(spark, sf_dir), packing_encoder)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(common.documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(common.documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import learn, quality_scores

    docs = common.documents(spark, sf_dir)
    return quality_scores(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(common.documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, toxicity_scores

    docs = common.documents(spark, sf_dir)
    return toxicity_scores(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(common.documents(spark, sf_dir))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(common.documents(spark, sf_dir))


def alignment_tokenizers():
    import public_tokenizers

    from .alignment import byte_level, pieces

    return byte_level(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), pieces(tokenizer_file("piece_bpe_32k.model"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(common.documents(spark, sf_dir), alignment_tokenizers)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_media_columns": op2_media_columns,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_bpe": op4_bpe,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_collocations": op11_collocations,
    "op12_near_dedup": op12_near_dedup,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op7_line_dedup": r"""
        with lines as (
            select doc_id, i, parts[i] as line,
                   translate(regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i
                  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))),
        repeated as (
            select key, max(doc_id) as keep from lines where length(key) >= 40
            group by key having count(distinct doc_id) >= 5),
        marked as (
            select l.doc_id, l.i, l.line, r.key is not null and l.doc_id <> r.keep as gone
            from lines l left join repeated r on l.key = r.key and length(l.key) >= 40)
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
        from marked group by doc_id""",
    "op11_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang,
                   unnest(list_transform(
                       regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
                       lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) as w
            from documents),
        totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
        grams as (
            select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as phrase
            from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, range(1, 5) as sizes(k))),
        f as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 30),
        candidates as (select lang, k, phrase, string_split(phrase, ' ') as w, f as a from f where k > 1),
        cuts as (
            select c.lang, c.phrase, c.a, j, x.f as l, y.f as r, (2000000::hugeint * c.a) // (x.f + y.f) as score
            from (select *, unnest(range(1, k)) as j from candidates) c
            join f x on x.lang = c.lang and x.phrase = array_to_string(list_slice(c.w, 1, j), ' ')
            join f y on y.lang = c.lang and y.phrase = array_to_string(list_slice(c.w, j + 1, c.k), ' ')),
        best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
        inner_phrases as (
            select lang, array_to_string(list_slice(w, i, i + m - 1), ' ') as phrase, max(a) as within
            from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from candidates)) group by all),
        ranked as (
            select b.lang, b.phrase, b.a, b.l, b.r, b.score::bigint as score,
                   row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank
            from best b left join inner_phrases i on i.lang = b.lang and i.phrase = b.phrase
            where coalesce(100 * i.within < 80 * b.a, true))
        select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000""",
    "op12_near_dedup": r"""
        with recursive split as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents),
        shingles as (
            select distinct doc_id, s
            from (select doc_id, unnest(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from split)),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        shared as (
            select a.doc_id as x, b.doc_id as y, count(*) as c
            from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
        links as (
            select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y
            where 100 * c >= 80 * (p.n + q.n - c)),
        both_ways as (select x, y from links union all select y, x from links),
        reached as (
            select doc_id, doc_id as root from documents
            union
            select r.doc_id, b.y from reached r join both_ways b on b.x = r.root)
        select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
        from (select doc_id, min(root) as component_id from reached group by doc_id) left join sizes using (doc_id)""",
}
