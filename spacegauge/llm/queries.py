"""The operators as queries over the given tables, with production parameters, and the SQL that checks some of them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spacegauge.llm import align, cascade, debruijn, hnsw, jaccard, kneser_ney, mixing, pieces, pivots, qda, repair, ring, token_files
from spacegauge.llm.tables import new_folder, table


def _remainder(divisor: int) -> Column:
    """The remainder of doc_id's CRC-32; a null doc_id counts as the empty text."""
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(0)) % divisor


def op1_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.sharded(table(spark, sf_dir, "documents"), shards=40)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op3_debruijn_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.judged(table(spark, sf_dir, "documents"))


def op4_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.perplexities(docs.select("doc_id", "text", (_remainder(10) == 0).alias("held_out")))


#: Domains by label: fit text, poor text, toxic text; and the tokens each is to have, as shares of all. None is zero, which
#: soft memberships can't reach, and all can be reached without dropping fit documents.
DOMAIN = "case when toxic = 1 then 2 when quality = 0 then 1 when quality = 1 then 0 end"
TARGETS = (0.92, 0.03, 0.05)


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.expr(DOMAIN), TARGETS)


def op6_streaming_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.verdicts(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op9_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = qda.scored(docs, labels.withColumn("train", _remainder(4) != 2), "quality")
    return scores.withColumn("held_out", _remainder(4) == 2)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "tokens")
    token_files.write(token_files.encoded(docs, public_tokenizers.path("word_bpe_49k.json")), folder)
    return token_files.placed(spark, folder)


def op11_pivot_permutation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.linked(table(spark, sf_dir, "embeddings"))


def op12_pointer_jumping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.aligned(table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults that depend on each row's conversation and turn: rows dropped, emptied, without their ends of
    sentences, repeated, or given to the user."""
    blank = F.lit(" ")
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    chance = F.crc32(place.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), chance.alias("chance"))
        .where("chance != 0")
        .withColumn("text", F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("chance") == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.when(F.col("chance") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("chance", "copy")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.digested(damaged(rows), rows)


QUERIES = {
    f.__name__: f
    for f in (
        op1_hnsw_search,
        op2_bounded_ring,
        op3_debruijn_substring_dedup,
        op4_kneser_ney_scoring,
        op5_soft_mixing,
        op6_streaming_pieces,
        op7_quality_cascade,
        op8_ngram_jaccard_join,
        op9_quality_discriminant,
        op10_token_files,
        op11_pivot_permutation_links,
        op12_pointer_jumping_alignment,
        op13_conversation_repair,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op3_debruijn_substring_dedup": rf"""
        with words as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
        windows as (
            select r, p, md5(array_to_string(w[p : p + 34], ' ')) as h
            from words, unnest(range(1, len(w) - 33)) as t(p) where len(w) >= 35),
        repeated as (select r, p from windows where h in (select h from windows group by h having count(*) > 1)),
        gone as (select distinct r, p + i as p from repeated, unnest(range(35)) as t(i)),
        lists as (select r, list(p) as gone from gone group by r)
        select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
            sha256(coalesce(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)), ' '), ''))
                as kept_sha256
        from words left join lists using (r)""",
    "op8_ngram_jaccard_join": rf"""
        with recursive words as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
        grams as (
            select distinct r, array_to_string(w[p : p + 4], ' ') as g
            from words, unnest(range(1, greatest(len(w) - 3, 2))) as t(p) where len(w) > 0),
        sizes as (select r, count(*) as n from grams group by r),
        shared as (select a.r as a, b.r as b, count(*) as n from grams a join grams b using (g) where a.r != b.r group by all),
        links as (
            select a, b, shared.n = x.n and x.n = y.n as same from shared
            join sizes x on x.r = a join sizes y on y.r = b where 9 * shared.n >= 4 * (x.n + y.n)),
        reach as (select r as a, r as b from words union select reach.a, links.b from reach join links on reach.b = links.a),
        least as (select a as r, min(doc_id) as class_id from reach join words on b = r group by a),
        copies as (select a as r, min(doc_id) as d from links join words on b = r where same group by a),
        counts as (select a as r, count(*) as n from links group by a)
        select doc_id, class_id, least(doc_id, coalesce(copies.d, doc_id)) as copy_id, coalesce(counts.n, 0)::bigint as n_links
        from words join least using (r) left join copies using (r) left join counts using (r)""",
    "op7_quality_cascade": rf"""
        with words as (select doc_id, row_number() over () as r, coalesce(text, '') as text, {_WORDS} as w from documents),
        places as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as tri, i <= len(w) - 2 as whole
            from words, unnest(range(1, len(w) + 1)) as t(i)),
        marked as (select r, i, whole and count(*) over (partition by r, tri, whole) > 1 as twice from places),
        repeats as (select r, count(*) filter (where hit) as n from (
            select r, twice or coalesce(lag(twice, 1) over s, false) or coalesce(lag(twice, 2) over s, false) as hit
            from marked window s as (partition by r order by i)) group by r),
        lines as (select r, count(*) as n, count(distinct line) as d
            from words, unnest(string_split(text, chr(10))) as t(line)
            where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
        counts as (
            select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
                coalesce(lines.n - lines.d, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words,
                coalesce(lines.n, 0) as n_lines,
                len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as n_letter_words,
                len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]'))) as n_shouted_words
            from words left join lines using (r) left join repeats using (r)),
        judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            not (base_failed or word_chars < 3 * n_words or word_chars > 12 * n_words or 10 * n_symbols > n_words
                or 2 * n_dup_lines > n_lines or 10 * n_letter_words < 8 * n_words or 2 * n_shouted_words > n_words) as kept
        from judged""",
    "op11_pivot_permutation_links": """
        with recursive vectors as (select vec_id, row_number() over () as r, label, embedding::double[] as v from embeddings),
        fit as (
            select r, label, v from vectors
            where label is not null and len(list_filter(v, lambda x: x is not null and isfinite(x))) = len(v)
                and len(list_filter(v, lambda x: x != 0)) > 0),
        links as (
            select a.r as a, b.r as b from fit a join fit b on a.label = b.label and len(a.v) = len(b.v) and a.r != b.r
            where list_cosine_similarity(a.v, b.v) >= 0.98),
        reach as (select r as a, r as b from vectors union select reach.a, links.b from reach join links on reach.b = links.a),
        least as (select a as r, min(vec_id) as component_id from reach join vectors on b = r group by a),
        counts as (select a as r, count(*) as n from links group by a)
        select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept
        from vectors join least using (r) left join counts using (r)""",
    "op13_conversation_repair": r"""
        with recursive places as (
            select *, dense_rank() over (order by conv_id nulls first) as k,
                coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as place
            from conversations),
        chances as (
            select *, xor(4294967295, list_reduce(
                list_concat([4294967295::bigint], flatten(list_transform(range(1, length(place) + 1),
                    lambda i: [unicode(substr(place, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end)) % 20 as chance
            from places),
        damaged as (
            select k, turn, case when chance = 4 then 'user' else coalesce(role, ' ') end as role,
                case chance when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
                    else coalesce(text, ' ') end as text
            from chances, unnest(range(case when chance = 3 then 2 else 1 end)) where chance != 0),
        ordered as (
            select *, left(role, 1) as own, row_number() over (partition by k order by turn nulls first, role, md5(text)) as p
            from damaged),
        seen as (select *, row_number() over (partition by k, role, text order by p) as nth, lag(own) over (partition by k order by p) as prior
            from ordered),
        judged as (
            select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not blank and nth > 1 as duplicate,
                not blank and not duplicate and not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as truncated
            from seen),
        counts as (
            select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank,
                count(*) filter (where duplicate) as duplicate, count(*) filter (where truncated) as truncated,
                count(*) filter (where p > 1 and (prior || own) not in ('su', 'ua', 'au')) as illegal, count(*) as n
            from judged group by k),
        moves(source, target, initial, inserts) as (values
            (0, 1, 's', 0), (0, 2, 'u', 0), (1, 2, 'u', 0), (3, 2, 'u', 0), (2, 2, 'u', 1), (2, 3, 'a', 0), (0, 3, 'a', 1),
            (1, 3, 'a', 1), (3, 3, 'a', 1), (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0)),
        ways(k, p, state, way) as (
            select k, 0::bigint, 0, {'cost': 0, 'audit': ''} from counts
            union all
            select w.k, j.p, m.target, min({
                'cost': w.way.cost + 3 * m.inserts + case when m.initial = '' then 4 else
                    (case when m.initial = j.own then 0 else 3 end) + (case when j.truncated then 3 else 0 end) end,
                'audit': w.way.audit || repeat('I', m.inserts) || case m.initial when '' then 'D' when j.own then 'K' else 'R' end})
            from ways w join judged j on j.k = w.k and j.p = w.p + 1 join moves m on m.source = w.state
            where m.initial = '' or (not j.blank and not j.duplicate and m.initial in (j.own, 'u', 'a'))
            group by w.k, j.p, m.target),
        solved as (
            select k, min({'cost': way.cost + 3 * e.n, 'audit': way.audit || repeat('I', e.n)}) as way
            from ways join counts using (k) join (values (0, 0), (1, 2), (2, 1), (3, 0)) e(state, n) on e.state = ways.state
            where ways.p = counts.n group by k),
        edits as (
            select k, i, way.audit[i] as letter, i - length(replace(way.audit[1 : i], 'I', '')) as skipped,
                length(replace(way.audit[1 : i - 1], 'D', '')) as o, length(replace(way.audit, 'D', '')) % 2 as leads
            from solved, unnest(range(1, length(way.audit) + 1)) as t(i)),
        lines as (
            select e.k, e.i, case when letter = 'K' then j.role when (o - leads) % 2 = 0 then 'user' else 'assistant' end || ':'
                || case when letter = 'I' then '' else j.text end as line
            from edits e left join judged j on j.k = e.k and j.p = e.i - e.skipped where letter != 'D'),
        sums as (select k, sha256(string_agg(line, chr(10) order by i)) as digest from lines group by k)
        select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
            coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(way.cost, 0)::bigint as cost,
            coalesce(way.audit, '') as audit, coalesce(digest, sha256('')) as repaired_sha256
        from (select distinct conv_id, k from places) left join counts using (k) left join solved using (k) left join sums using (k)""",
}
