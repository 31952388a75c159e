"""The queries of this package over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkguard.llm import brown, chat, exact_dedup, langid, lexical_search, line_dedup, mixing, order_minhash, packing, pii, simhash_dedup, toxicity, whitening
from sparkguard.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@register(
    "op2_line_dedup",
    r"""
    with l as (
        select doc_id, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as no
        from documents
    ),
    w as (select *, greatest(1, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as words from l),
    s as (select *, coalesce(sum(words) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0)::bigint as s from w),
    v as (
        select doc_id, no, list(line) over a as win, sum(words) over a as held, list(line) over b as upto, sum(words) over b as reached
        from s
        window a as (partition by doc_id order by s range between current row and 49 following),
            b as (partition by doc_id order by s + words range between 49 preceding and current row)
    ),
    x as (
        select doc_id, no, win from v where held >= 50
        union select doc_id, no - len(upto) + 1, upto from v where reached >= 50
    ),
    f as (select win, min({'d': doc_id, 'n': no}) as f from x group by win having count(*) > 1),
    r as (select doc_id, no as a, no + len(win) - 1 as b from x join f using (win) where doc_id <> f.f.d or no <> f.f.n),
    g as (select distinct doc_id, unnest(range(a, b + 1)) as no from r),
    k as (select l.doc_id, l.no, l.line, g.no is null as stays from l left join g on l.doc_id = g.doc_id and l.no = g.no)
    select doc_id, count(*) as n_lines, count(*) filter (not stays) as dropped_lines,
        sha256(coalesce(string_agg(line, chr(10) order by no) filter (stays), '')) as kept_sha256
    from k group by doc_id
    """,
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "dropped_lines", F.sha2("text", 256).alias("kept_sha256"))


@register(
    "op3_exact_dedup",
    """
    with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents),
    g as (select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from n join g using (norm)
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@register("op5_simhash_gray")
def op5_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


# Documents whose id falls into fold TOXIC_FOLD of TOXIC_FOLDS are held out.
TOXIC_FOLDS, TOXIC_FOLD = 3, 1


@register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), TOXIC_FOLDS) == TOXIC_FOLD
    weights = toxicity.fit(docs, toxicity.learnable(labels, held_out))
    return toxicity.scores(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@register(
    "op8_mixing",
    """
    with d as (
        select *, md5(coalesce(doc_id::varchar, 'size ' || size::varchar)) as place
        from (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents)
    ),
    s as (
        select source, sum(size)::bigint as source_size, ([3, 1, 2])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w,
            ([-0.5, 0.5, 0.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as slope
        from d group by source
    ),
    o as (
        select *, coalesce(sum(2 * source_size) over (order by source_size / w, source rows between unbounded preceding and 1 preceding), 0) as given,
            sum(w) over (order by source_size / w, source rows between current row and unbounded following) as open,
            (select sum(source_size) from s) as total
        from s
    ),
    l as (
        select (1.5 * total - given)::double / open::double as level from o
        where (1.5 * total - given)::double / open::double * w <= 2 * source_size order by source_size / w, source limit 1
    ),
    t as (select source, source_size, slope, least((2 * source_size)::double, level * w) as target from s, l),
    r as (
        select d.*, source_size, slope, target, floor(target + 0.5)::bigint as goal,
            coalesce(sum(size) over (partition by d.source order by place, size rows between unbounded preceding and 1 preceding), 0)::bigint as b
        from d join t on d.source is not distinct from t.source
    ),
    k as (
        select *, greatest(0, least(size, goal - b)) as x, greatest(0, least(size, goal - b - source_size)) as y,
            b / target as u, (b + source_size) / target as v
        from r
    )
    select doc_id, size, source_size, target, (x + y)::bigint as taken,
        case when x > 0 then case when slope = 0 then u else (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) end end as position,
        case when y > 0 then case when slope = 0 then v else (sqrt((1 - slope) * (1 - slope) + 4 * slope * v) - (1 - slope)) / (2 * slope) end end as again_position
    from k
    """,
)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


# The same vocabulary for two libraries.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@register("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS))


@register("op1_order_minhash")
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


# Documents whose id falls into fold LM_FOLD of LM_FOLDS are not learned from.
LM_FOLDS, LM_FOLD = 10, 0


@register("op9_brown_lm")
def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), LM_FOLDS) == LM_FOLD
    out = brown.scores(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for c in ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


@register(
    "op10_chat_format",
    f"""
    with c as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    )
    select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        sum(12 + length(replace({_escaped_sql("role")}, chr(10), chr(92) || chr(10))) + 1 + length({_escaped_sql("text")}) + 11)::bigint as formatted_chars
    from c group by conv_id
    """,
)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], rows.schema))
    records = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record"))
    return chat.read_back(chat.formatted(chat.canonical(records, "conv_id", "turn", "record"))).drop("unmapped")


# Documents whose id falls into fold LANG_FOLD of LANG_FOLDS are not learned from.
LANG_FOLDS, LANG_FOLD = 4, 2


@register("op4_language_mixture")
def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), LANG_FOLDS) == LANG_FOLD
    langs, likelihoods = langid.train(docs, ~held_out)
    return langid.predict(docs, langs, likelihoods).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")


@register("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whole_rows(table(spark, sf_dir, "embeddings"))
    return whitening.whitened(rows, whitening.fit(rows))


@register(
    "op12_lexical_search",
    r"""
    with i as (
        select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark
    ),
    t as (
        select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from documents
    ),
    f as (select doc_id, term, count(*) as tf from t group by doc_id, term),
    d as (select doc_id, sum(tf)::bigint as n from f group by doc_id),
    c as (select count(*) as docs, sum(n)::bigint as terms from d),
    w as (
        select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
        from f, c where term in (select term from i) group by term, docs
    ),
    s as (
        select item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::bigint as score
        from i join w using (term) join f using (term) join d on d.doc_id = f.doc_id, c group by item_id, f.doc_id
    ),
    r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0)
    select item_id, rank, doc_id, score from r where rank <= 50
    """,
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_pii")
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))
