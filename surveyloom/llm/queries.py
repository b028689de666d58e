"""One registered query per operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.sharding import shard_documents
from surveyloom.llm.packing import pack_documents
from surveyloom.llm.warc import archive_round_trip
from surveyloom.llm.chat import chat_windows, conversation_digests
from surveyloom.sources.scratch import materialise
from surveyloom.llm.neardup import near_duplicates
from surveyloom.llm.langid import language_mixtures
from surveyloom.llm.lmscore import score_documents
from surveyloom.llm.quality import judge
from surveyloom.llm.decontaminate import contaminated
from surveyloom.llm.hamming import nearest_vectors
from surveyloom.llm.bpe import encoding_digests
from surveyloom.llm.divergence import source_divergence
from surveyloom.llm.negatives import hard_negatives
from surveyloom.llm.support import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_label_propagation_shards(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


@query
def op2_least_squares_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


@query
def op10_dictionary_warc(spark, sf_dir):
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


@query
def op4_budgeted_chat_windows(spark, sf_dir):
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(materialise(chat_windows(turns), "windows"))


@query
def op9_hamming_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op1_language_mixtures(spark, sf_dir):
    return language_mixtures(table(spark, sf_dir, "documents"))


@query
def op7_context_tree_scores(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


@query
def op6_kneser_ney_quality(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("same")


@query
def op5_edit_distance_leaks(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_multi_index_neighbours(spark, sf_dir):
    return nearest_vectors(table(spark, sf_dir, "embeddings"), k=10)


@query
def op11_pair_index_bpe(spark, sf_dir):
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op12_residue_hard_negatives(spark, sf_dir):
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", label)


@query
def op13_level_product_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLES: dict[str, str] = {
    "op10_dictionary_warc": """
    with hashed as (
        select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages
    ), topped as (
        select *, max(page_id) over (partition by hex) as top from hashed
    )
    select page_id, strlen(payload) as payload_bytes,
        array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda k: substr(
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(hex, 1 + 5 * i, 5))::bigint >> (15 - 5 * k)) & 31), 1)), '')), '') as payload_digest,
        case when page_id is distinct from top then 'revisit' else 'response' end as record_type,
        case when page_id is distinct from top then top end as refers_to
    from topped
    """,
    "op4_budgeted_chat_windows": """
    with turns as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all values (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')
    ), t1 as (
        select *, coalesce(cast(floor(turn / 256) as bigint), -4611686018427387904) as block,
            ceil(strlen(text) / 4)::bigint + 4 as tokens
        from turns
    ), t2 as (
        select *, min(block) over (partition by conv_id) as opening,
            first_value(role) over c as lead_role, first_value(tokens) over c as lead_tokens,
            first_value(text) over c as lead_text, row_number() over c as place
        from t1 window c as (partition by conv_id order by turn nulls first, role, text)
    ), t3 as (
        select conv_id, block, turn, role, text, tokens, false as copy, place = 1 and role = 'system' as system,
            case when lead_role = 'system' then lead_tokens else 0 end as head
        from t2
        union all
        select distinct conv_id, block, null, 'system', lead_text, lead_tokens, true, true, lead_tokens
        from t2 where block > opening and lead_role = 'system'
    ), t4 as (
        select *, case when system then 0 else tokens end as body,
            greatest(1, cast(floor((1024 - head - 128) / 2) as bigint)) as step,
            row_number() over (partition by conv_id, block order by copy desc, turn nulls first, role, text) as ord
        from t3
    ), t5 as (
        select *, coalesce(sum(body) over b, 0)::bigint as start, (body > step)::int as long
        from t4 window b as (partition by conv_id, block order by ord rows between unbounded preceding and 1 preceding)
    ), t6 as (
        select *, sum(long) over (partition by conv_id, block order by ord)
            + coalesce(sum(long) over (partition by conv_id, block order by ord rows between unbounded preceding and 1 preceding), 0) as segment
        from t5
    ), t7 as (
        select *, (start - min(start) over (partition by conv_id, block, segment)) // step as stretch from t6
    ), t8 as (
        select *, max(start + body) over (partition by conv_id, block, segment, stretch) as next_start,
            dense_rank() over (partition by conv_id, block order by segment, stretch) - 1 as win
        from t7
    ), t9 as (
        select *, max(win) over (partition by conv_id, block) as last_win from t8
    ), t10 as (
        select *, 8 + 6 + 1
            + length(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), chr(10), '\\n'))
            + length(replace(replace(text, '\\', '\\b'), '<', '\\l')) as piece,
            case when system then last_win + 1 when win < last_win and next_start - start <= 128 then 2 else 1 end as times
        from t9
    )
    select conv_id,
        count(*) filter (not copy) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by block, ord) filter (not copy)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by block, ord) filter (role = 'assistant'), '')) as loss_sha256,
        sum(piece * times)::bigint as formatted_chars
    from t10 group by conv_id
    """,
    "op8_multi_index_neighbours": """
    with codes as (
        select vec_id, list_transform(embedding, lambda x: coalesce(x > 0 and not isnan(x), false)) as signs
        from embeddings where len(embedding) > 0
    ), pairs as (
        select q.vec_id as query_id, v.vec_id as neighbour_id,
            list_sum(list_transform(range(1, len(q.signs) + 1), lambda i: (q.signs[i] <> v.signs[i])::int))::int as distance
        from codes q join codes v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id
    ), ranked as (
        select *, row_number() over (partition by query_id order by distance, neighbour_id)::int as rank from pairs
    )
    select query_id, rank, neighbour_id, distance from ranked where rank <= 10
    """,
    "op12_residue_hard_negatives": """
    with vectors as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * x::double)) as v, row_number() over () as rid
        from embeddings
        where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scores as (
        select a.rid, a.vec_id as anchor_id, b.vec_id, b.rid as other, a.label = b.label as same,
            list_inner_product(a.v, b.v)::bigint as score
        from vectors a join vectors b on a.vec_id % 100 = 0 and a.rid <> b.rid
    ), positives as (
        select * from scores where same
        qualify row_number() over (partition by rid order by score desc, vec_id, other) <= 5
    ), negatives as (
        select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
            row_number() over (partition by p.rid, p.other order by n.score desc, n.vec_id, n.other)::int as rank
        from positives p join scores n on p.rid = n.rid and not n.same
        where 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
    )
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 5
    """,
    "op13_level_product_divergence": """
    with docs as (
        select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
            regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
        from documents
    ), counts as (
        select lang, source, term, count(*) as n, count(distinct rid) as docs
        from (select rid, lang, source, unnest(words) as term from docs) group by all
    ), kept as (
        select lang, term, sum(n) as n from counts group by lang, term having sum(docs) >= 30
    ), langs as (
        select lang, count(*) as v, sum(n) as total from kept group by lang
    ), groups as (
        select distinct lang, source from docs
    ), cells as (
        select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as lang_n, l.v, l.total as lang_total,
            sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total
        from groups g join kept k using (lang) join langs l using (lang)
            left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
    ), shares as (
        select lang, source, term, n,
            1 + (1000000000::hugeint * (n + 5)::hugeint) // (total + 5 * v)::hugeint as p,
            1 + (1000000000::hugeint * (lang_n + 5)::hugeint) // (lang_total + 5 * v)::hugeint as q
        from cells
    ), differences as (
        select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
        from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
    ), results as (
        select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0)::bigint as value
        from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join differences d on d.lang = a.lang and d.source = a.source and d.item = b.source
        union all
        select lang, source, 'term', term, (p - q)::bigint from shares where n > 0 and p > q
    ), ranked as (
        select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from results
    )
    select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
    """,
}
