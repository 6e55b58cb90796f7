"""The queries of this subpackage: op<N>_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, chat, decontaminate, divergence, jaccard, langid, lattice, licence, linededup, quality, suffix, toxicity
from tarn.llm.common import documents


#: Both turns of the conversation -7.
HARD_TURN = "\\### Assistant: </turn> ok"


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.report(documents(spark, sf_dir)).select(*cols, "fail_bits", "n_lines", "n_letters", "n_upper")


def op2_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.score(documents(spark, sf_dir), pieces)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(documents(spark, sf_dir)).withColumn("gone", F.array_join("gone", ","))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(documents(spark, sf_dir))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.scan(documents(spark, sf_dir)).drop("spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(documents(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TURN).alias("text"))
    return chat.report(chats.unionByName(hard))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORD = "[^\\x20\\x09-\\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_quality_ledger": f"""
        with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
        t as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c
              from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
        r as (select doc_id, count(distinct i + j) as n_repeat_words from t, (select unnest([0, 1, 2]) as j) where c > 1 group by doc_id),
        l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
              from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{_WORD}') group by doc_id),
        m as (select doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
                     coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
                     length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) as n_letters, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) as n_upper
              from d left join r using (doc_id) left join l using (doc_id)),
        b as (select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (100 * n_symbols > 25 * n_words)::bigint
                     + 8 * (100 * n_dup_lines > 50 * n_lines)::bigint + 16 * (n_letters > 0 and 100 * n_upper > 50 * n_letters)::bigint
                     + 32 * (word_chars > 40 * n_words)::bigint as fail_bits from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits % 4 > 0 as base_failed, fail_bits = 0 as kept,
               fail_bits, n_lines, n_letters, n_upper from b""",
    "op3_line_dedup": """
        with l as (select doc_id, generate_subscripts(x, 1) - 1 as p, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)),
        k as (select doc_id, p, lower(trim(regexp_replace(line, '[ \\t\\x0B\\f\\r]+', ' ', 'g'))) as line from l),
        f as (select line, min((doc_id, p)) as first, count(*) as times, string_split(line, ' ') as w from k where line <> '' group by line),
        v as (select line, first, i, true as cut, array_to_string(w[1:i - 1], ' ') as a, array_to_string(w[i + 1:], ' ') as b
              from (select *, unnest(range(1, len(w) + 1)) as i from f where len(w) >= 5)
              union all
              select line, first, i, false, array_to_string(w[1:i - 1], ' '), array_to_string(w[i:], ' ')
              from (select *, unnest(range(1, len(w) + 2)) as i from f where len(w) >= 5)),
        near as (select distinct x.line from v x join v y using (i, a, b) where (x.cut or y.cut) and y.first < x.first),
        g as (select k.doc_id, k.p, (k.doc_id, k.p) = f.first as near from k join f using (line) where (k.doc_id, k.p) > f.first or line in (select line from near)),
        s as (select doc_id, count_if(not near) as n_exact, count_if(near) as n_near, string_agg(p::varchar, ',' order by p) as gone from g group by doc_id)
        select d.doc_id, coalesce(len(string_split(text, chr(10))), 0) as n_lines, coalesce(n_exact, 0) as n_exact, coalesce(n_near, 0) as n_near,
               coalesce(gone, '') as gone from documents d left join s using (doc_id)""",
    "op10_jaccard_join": f"""
        with recursive w as (select doc_id, regexp_extract_all({_LOW}, '{_WORD}') as w from documents),
        s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (s) where x.doc_id <> y.doc_id group by all),
        e as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
        r as (select doc_id as d, doc_id as r from documents union select r.d, e.b from r join e on e.a = r.r)
        select d as doc_id, coalesce(any_value(n), 0) as n_shingles, min(r) as component_id from r left join n on n.doc_id = d group by d""",
    "op11_chat_format": f"""
        with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all select -7, t, r, '{HARD_TURN}' from (values (0, 'user'), (1, 'assistant')) as v(t, r)),
        t as (select *, regexp_replace(text, '(\\\\*(### |</turn>))', '\\\\\\1', 'g') as body,
                     case when role in ('system', 'user', 'assistant') then upper(role[1]) || role[2:]
                          else '=' || regexp_replace(role, '([\\\\:#<])', '\\\\\\1', 'g') end as label from r),
        p as (select *, '### ' || label || ': ' || body as piece from t)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, piece)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn nulls first, piece) filter (where role = 'assistant'), '')) as loss_sha256,
               cast(sum(length(piece) + 9) as bigint) as formatted_chars, count_if(body <> text) as n_escaped from p group by conv_id""",
    "op12_source_divergence": """
        with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as i,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
        t as (select lang, source, i, unnest(w) as term from d),
        k as (select lang, term, count(*) as n from t group by all having count(distinct i) >= 30),
        v as (select d.lang, coalesce(any_value(v), 0) as v, coalesce(any_value(n), 0) as n from (select distinct lang from d) d
              left join (select lang, count(*) as v, sum(n) as n from k group by lang) using (lang) group by d.lang),
        g as (select distinct lang, source from d),
        c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
        s as (select g.lang, g.source, coalesce(sum(n), 0) as n from g left join c using (lang, source) group by all),
        p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as c,
                     1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v.v) as p, 1 + (1000000000::hugeint * (k.n + 5)) // (v.n + 5 * v.v) as q
              from s join k using (lang) join v using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
        f as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
        r as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(value, 0)::bigint as value
              from g x join g y on x.lang = y.lang and x.source <> y.source left join f on f.lang = x.lang and f.source = x.source and f.item = y.source
              union all select lang, source, 'term', term, (p - q)::bigint from p where c > 0 and p > q),
        n as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from r)
        select * from n where part = 'pair' or rank <= 50""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against plain versions."""
    return dict(ORACLE_SQL)
