"""Rule scoring, masks and profiles over the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparkguard.functions import masks
from sparkguard.functions.freetext import CARD, EMAIL, IP, PHONE
from sparkguard.operators import masking as M
from sparkguard.plans import twin_masks as S
from sparkguard.plans.registry import Inputs, query

KEY = S.KEY

# ---- rules -----------------------------------------------------------------------------------


def _score_sql(r: M.MaskingRule) -> str:
    hits = " + ".join(f"case when regexp_matches(lower(column_name), '{p}') then 1 else 0 end" for p in r.patterns)
    types = ", ".join(f"'{t}'" for t in r.data_types)
    return f"least(({hits}) / {len(r.patterns)}.0::double * 0.7::double + case when lower(data_type) in ({types}) then 0.3::double else 0.0::double end, 1.0::double)"


_SCORED = " union all ".join(
    f"select fx_columns.*, {i} as rule_pos, '{r.name}' as rule_name, '{r.strategy}' as strategy, {_score_sql(r)} as score from fx_columns"
    for i, r in enumerate(M.DEFAULT_RULES)
)


@query(
    "rule_scores",
    f"select column_id, rule_name, round(score, 4) as score from ({_SCORED}) s where score > 0",
    fx="columns",
)
def rule_scores(t: Inputs):
    return M.score_rules(t.fx("columns")).select("column_id", "rule_name", F.round("score", 4).alias("score"))


@query(
    "rule_column_join",
    f"""select column_id, table_name, column_name, rule_name, strategy, round(score, 4) as score
    from ({_SCORED}) s where score > 0.35""",
    fx="columns",
)
def rule_column_join(t: Inputs):
    return M.score_rules(t.fx("columns"), min_score=0.35).select(
        "column_id", "table_name", "column_name", "rule_name", "strategy", F.round("score", 4).alias("score")
    )


@query(
    "best_rule",
    f"""select column_id, rule_name, strategy, round(score, 4) as score, score >= 0.8 as applied from
    (select *, row_number() over (partition by column_id order by score desc, rule_pos) as rn from ({_SCORED}) s where score > 0) where rn = 1""",
    fx="columns",
)
def best_rule(t: Inputs):
    return M.best_rules(t.fx("columns")).select("column_id", "rule_name", "strategy", F.round("score", 4).alias("score"), "applied")


@query(
    "dataset_sensitivity",
    f"""with best as (select * from (select *, row_number() over (partition by column_id order by score desc, rule_pos) as rn
      from ({_SCORED}) s) where rn = 1)
    select database_name, table_name, count(*) as total_columns, count(*) filter (score > 0) as sensitive_columns,
      round(count(*) filter (score > 0) / count(*), 4) as sensitive_share,
      coalesce(string_agg(case when score > 0 then column_name || ':' || strategy end, ',' order by column_name || ':' || strategy), '') as recommendations
    from best group by 1, 2""",
    fx="columns",
)
def dataset_sensitivity(t: Inputs):
    out = M.dataset_sensitivity(t.fx("columns"), ["database_name", "table_name"])
    return out.withColumn("sensitive_share", F.round("sensitive_share", 4))


# ---- whole tables ----------------------------------------------------------------------------

_TYPES = {"salary": "decimal"}
_PEOPLE = "person_id contact_email first_name phone ssn credit_card salary ip_address non_sensitive".split()
_MASKED = {
    "contact_email": "fake_email",
    "first_name": "fake_first_name",
    "phone": "fake_phone",
    "ssn": "fake_ssn",
    "credit_card": "fake_credit_card",
    "ip_address": "fake_address",
}


def _masked_people_sql() -> str:
    cols = []
    for c in _PEOPLE:
        if c in _MASKED:
            cols.append(f"{S.text_mask(_MASKED[c], c, c)} as {c}")
        elif c == "salary":
            cols.append(f"round({S.amount('salary', 'salary')}, 2) as salary")
        else:
            cols.append(c)
    return "select " + ", ".join(cols) + " from fx_people"


@query("mask_dataset", _masked_people_sql(), fx="people")
def mask_dataset(t: Inputs):
    masked = M.mask_dataset(t.fx("people"), KEY, threshold=0.4, column_types=_TYPES)
    return masked.withColumn("salary", F.round("salary", 2))


@query(
    "mask_dataset_defaults",
    "select person_id, " + S.text_mask("fake_email", "contact_email", "contact_email") + " as contact_email, first_name, phone, ssn, salary from fx_people",
    fx="people",
)
def mask_dataset_defaults(t: Inputs):
    """With the default threshold only the e-mail column scores high enough."""
    return M.mask_dataset(t.fx("people"), KEY).select("person_id", "contact_email", "first_name", "phone", "ssn", "salary")


def _statistics_sql() -> str:
    parts = []
    for c in _PEOPLE:
        masked = S.text_mask(_MASKED[c], c, c) if c in _MASKED else c
        parts.append(f"select '{c}' as column_name, count({c}) as processed, count(*) filter ({c} is not null and {c} <> {masked}) as masked from fx_people")
    return (
        "select column_name, processed, masked, processed - masked as preserved, round(masked / processed, 4) as masking_rate, "
        "round((processed - masked) / processed, 4) as preservation_rate from (" + " union all ".join(parts) + ")"
    )


@query("masking_statistics", _statistics_sql(), fx="people")
def masking_statistics(t: Inputs):
    people = t.fx("people")
    out = M.masking_statistics(people, KEY, [r for r in M.DEFAULT_RULES if r.name != "salaries"], threshold=0.4)
    return out.withColumn("masking_rate", F.round("masking_rate", 4)).withColumn("preservation_rate", F.round("preservation_rate", 4))


_PROFILED = "contact_email first_name phone ssn credit_card ip_address non_sensitive".split()


def _profile_sql(c: str) -> str:
    d = f"regexp_replace({c}, '[\\s\\-\\(\\)]', '', 'g')"
    return f"""select '{c}' as column_name, count(*) as total_values, count(*) - count({c}) as null_count, count(distinct {c}) as unique_count,
      count(*) filter (regexp_matches({c}, '{M.EMAIL_SHAPE}')) as email_matches,
      round(count(*) filter (regexp_matches({c}, '{M.EMAIL_SHAPE}')) / count({c}), 4) as email_share,
      count(*) filter (regexp_matches({d}, '{M.PHONE_SHAPE}')) as phone_matches,
      round(count(*) filter (regexp_matches({d}, '{M.PHONE_SHAPE}')) / count({c}), 4) as phone_share,
      round(greatest(0, least(1, 1 - stddev_pop(length({c})) / avg(length({c})))), 4) as format_consistency from fx_people"""


@query("column_profile", " union all ".join(_profile_sql(c) for c in _PROFILED), fx="people")
def column_profile(t: Inputs):
    out = M.column_profile(t.fx("people"), _PROFILED, exact=True)
    for c in ("email_share", "phone_share", "format_consistency"):
        out = out.withColumn(c, F.round(c, 4))
    return out


# ---- one query per strategy ------------------------------------------------------------------

# query, strategy, projection, id column, source column
_ONE = [
    ("mask_email", "fake_email", "people", "person_id", "contact_email"),
    ("mask_name", "fake_name", "people", "person_id", "first_name"),
    ("mask_first_name", "fake_first_name", "people", "person_id", "first_name"),
    ("mask_last_name", "fake_last_name", "people", "person_id", "first_name"),
    ("mask_phone", "fake_phone", "people", "person_id", "phone"),
    ("mask_ssn", "fake_ssn", "people", "person_id", "ssn"),
    ("mask_address", "fake_address", "people", "person_id", "non_sensitive"),
    ("mask_city", "fake_city", "people", "person_id", "non_sensitive"),
    ("mask_state", "fake_state", "people", "person_id", "non_sensitive"),
    ("mask_credit_card", "fake_credit_card", "people", "person_id", "credit_card"),
    ("mask_account_number", "fake_account_number", "people", "person_id", "contact_email"),
    ("mask_business_id", "fake_business_id", "people", "person_id", "contact_email"),
    ("mask_transaction_id", "fake_transaction_id", "people", "person_id", "contact_email"),
    ("mask_hash", "fake_hash", "people", "person_id", "ssn"),
    ("mask_api_key", "fake_api_key", "people", "person_id", "ssn"),
    ("mask_medical_id", "fake_medical_id", "people", "person_id", "ssn"),
    ("mask_ipv4", "fake_ipv4", "people", "person_id", "ip_address"),
    ("mask_company", "fake_company", "people", "person_id", "first_name"),
    ("mask_partial", "partial_mask", "resources", "identifier", "name"),
    ("mask_shuffle", "shuffle_chars", "people", "person_id", "contact_email"),
    ("mask_replace_digits", "replace_digits", "people", "person_id", "contact_email"),
    ("keyword_mask_string", "keyword_text", "people", "person_id", "non_sensitive"),
]
_FUNCTIONS = {**masks.STRATEGIES, "keyword_text": masks.keyword_text}


def _register(key: str, strategy: str, fx: str, id_column: str, source: str) -> None:
    @query(key, f"select {id_column}, {S.text_mask(strategy, source, source)} as masked from fx_{fx}", fx=fx)
    def build(t: Inputs):
        return t.fx(fx).select(id_column, _FUNCTIONS[strategy](F.col(source), KEY, source).alias("masked"))


for _args in _ONE:
    _register(*_args)


@query(
    "mask_zipcode",
    f"""select c_custkey, {S.text_mask('fake_zipcode', 'c_name', 'c_name')} as masked_text,
    case when c_nationkey is null then null else 10000 + {S.slot(S.h("cast(c_nationkey as varchar)", "c_nationkey"), 0)} % 90000 end as masked_number from customer""",
)
def mask_zipcode(t: Inputs):
    return t.table("customer").select(
        "c_custkey",
        masks.zipcode(F.col("c_name"), KEY, "c_name").alias("masked_text"),
        masks.zipcode_number(F.col("c_nationkey"), KEY, "c_nationkey").alias("masked_number"),
    )


@query(
    "mask_amount",
    f"""select person_id, round({S.amount('salary', 'salary')}, 2) as masked,
    {S.whole_amount('person_id', 'person_id')} as masked_whole from fx_people""",
    fx="people",
)
def mask_amount(t: Inputs):
    return t.fx("people").select(
        "person_id",
        F.round(masks.amount(F.col("salary"), KEY, "salary"), 2).alias("masked"),
        masks.whole_amount(F.col("person_id"), KEY, "person_id").alias("masked_whole"),
    )


@query(
    "keyword_mask_number",
    f"""select o_orderkey, round({S.jitter('o_totalprice', 'o_totalprice')}, 4) as price,
    {S.whole_jitter('o_custkey', 'o_custkey')} as cust from orders""",
)
def keyword_mask_number(t: Inputs):
    return t.table("orders").select(
        "o_orderkey",
        F.round(masks.jitter(F.col("o_totalprice"), KEY, "o_totalprice"), 4).alias("price"),
        masks.whole_jitter(F.col("o_custkey"), KEY, "o_custkey").alias("cust"),
    )


_WORDS = "|".join([w for f in M.NAME_FAMILIES.values() for w in f] + list(M.SENSITIVE_KEYWORDS))
_FAMILY_CASE = " ".join(f"when regexp_matches(lower(column_name), '{'|'.join(M.NAME_FAMILIES[f])}') then '{f}'" for f in M.FAMILY_ORDER)


@query(
    "keyword_sensitive",
    f"""select column_id, column_name, regexp_matches(lower(column_name), '{_WORDS}') as sensitive,
    case {_FAMILY_CASE} end as family from fx_columns""",
    fx="columns",
)
def keyword_sensitive(t: Inputs):
    name = F.col("column_name")
    return t.fx("columns").select(
        "column_id", name, M.keyword_sensitive_column(name).alias("sensitive"), M.keyword_family_column(name).alias("family")
    )


_KEYWORD_COLUMNS = {
    "contact_email": "fake_email",
    "first_name": "fake_first_name",
    "phone": "fake_phone",
    "ssn": "fake_ssn",
    "credit_card": "fake_credit_card",
    "ip_address": "fake_address",
}


@query(
    "keyword_mask",
    "select "
    + ", ".join(f"{S.text_mask(_KEYWORD_COLUMNS[c], c, c)} as {c}" if c in _KEYWORD_COLUMNS else c for c in _PEOPLE)
    + " from fx_people",
    fx="people",
)
def keyword_mask(t: Inputs):
    """`ip_address` contains "address", so the address family comes first."""
    return M.keyword_mask(t.fx("people"), KEY, keep=["person_id"])


# ---- free text -------------------------------------------------------------------------------


# One character of Unicode's private use stands for each masked kind until the text is put together again.
_MARKS = "\ue001\ue002\ue003\ue004"


def _text_sql(table: str, ids: str, text: str = "text") -> str:
    """Matches become marks, kind by kind; at the end the marked text is cut at the marks and the masks are set between."""
    inner = f"select {ids}, {text} as text from {table}"
    kinds = (("card", CARD, "fake_credit_card"), ("phone", PHONE, "fake_phone"), ("email", EMAIL, "fake_email"), ("ip", IP, "fake_ipv4"))
    for mark, (name, pattern, _) in zip(_MARKS, kinds, strict=True):
        inner = f"select * exclude (text), regexp_extract_all(text, '{pattern}') as {name}_found, regexp_replace(text, '{pattern}', '{mark}', 'g') as text from ({inner})"
    for mark, (name, _, strategy) in zip(_MARKS, kinds, strict=True):
        masked = re.sub(r"\s+", " ", S.text_mask(strategy, "m", "text"))
        inner = (
            f"select * exclude (text, {name}_found), len({name}_found)::bigint as {name}_count, "
            f"case when len({name}_found) = 0 then text else array_to_string(list_transform(list_zip(string_split(text, '{mark}'), list_transform({name}_found, lambda m: {masked})), "
            f"lambda z: z[1] || coalesce(z[2], '')), '') end as text from ({inner})"
        )
    return inner


@query("text_pii_mask", _text_sql("documents", "doc_id"))
def text_pii_mask(t: Inputs):
    return M.mask_free_text(t.table("documents").select("doc_id", "text"), "text", KEY)


@query("text_pii_mask_conversations", _text_sql("conversations", "conv_id, turn"))
def text_pii_mask_conversations(t: Inputs):
    return M.mask_free_text(t.table("conversations").select("conv_id", "turn", "text"), "text", KEY)


@query("text_pii_mask_pages", _text_sql("pages", "page_id", "html"))
def text_pii_mask_pages(t: Inputs):
    return M.mask_free_text(t.table("pages").select("page_id", F.col("html").alias("text")), "text", KEY)
