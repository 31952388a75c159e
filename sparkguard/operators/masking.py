"""Sensitive-column rules, masking of whole tables, and column profiles."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkguard.functions import masks
from sparkguard.functions.freetext import KINDS, masked_pieces


@dataclass(frozen=True)
class MaskingRule:
    """How a column is recognised and which strategy replaces its values."""

    name: str
    category: str
    patterns: tuple[str, ...]
    data_types: tuple[str, ...]
    strategy: str
    confidence_threshold: float = 0.8
    enabled: bool = True
    preserve_length: bool = field(default=True)


# The default rules (name, category, column-name patterns, type names, strategy).
DEFAULT_RULES: tuple[MaskingRule, ...] = (
    MaskingRule("email_addresses", "pii", ("email", "e_?mail", "mail_?address", "contact_?email"), ("string", "varchar", "text"), "fake_email"),
    MaskingRule("full_names", "pii", ("^name$", "full_?name", "display_?name", "user_?name"), ("string", "varchar", "text"), "fake_name"),
    MaskingRule("first_names", "pii", ("first_?name", "given_?name", "fname"), ("string", "varchar", "text"), "fake_first_name"),
    MaskingRule("last_names", "pii", ("last_?name", "family_?name", "surname", "lname"), ("string", "varchar", "text"), "fake_last_name"),
    MaskingRule("phone_numbers", "pii", ("phone", "telephone", "mobile", "cell", "contact_?number"), ("string", "varchar"), "fake_phone"),
    MaskingRule("ssn", "pii", ("ssn", "social_?security", "tax_?id"), ("string", "varchar"), "fake_ssn"),
    MaskingRule("addresses", "pii", ("address", "street", "location"), ("string", "varchar", "text"), "fake_address"),
    MaskingRule("cities", "location", ("city", "town", "municipality"), ("string", "varchar"), "fake_city"),
    MaskingRule("states", "location", ("state", "province", "region"), ("string", "varchar"), "fake_state"),
    MaskingRule("zip_codes", "location", ("zip", "postal", "postcode"), ("string", "varchar", "int"), "fake_zipcode"),
    MaskingRule("credit_cards", "financial", ("credit_?card", "cc_?number", "card_?number", "payment_?card"), ("string", "varchar"), "fake_credit_card"),
    MaskingRule("bank_accounts", "financial", ("account_?number", "bank_?account", "routing", "iban"), ("string", "varchar"), "fake_account_number"),
    MaskingRule("salaries", "financial", ("salary", "wage", "income", "compensation", "pay"), ("decimal", "float", "money", "numeric"), "randomize_amount"),
    MaskingRule("passwords", "authentication", ("password", "pwd", "pass", "secret"), ("string", "varchar", "text"), "fake_hash"),
    MaskingRule("tokens", "authentication", ("token", "key", "secret", "hash"), ("string", "varchar", "text"), "fake_api_key"),
    MaskingRule("medical_ids", "health", ("patient_?id", "medical_?record", "mrn", "health_?id"), ("string", "varchar"), "fake_medical_id"),
    MaskingRule("ip_addresses", "technical", ("ip_?address", "remote_?addr", "client_?ip"), ("string", "varchar"), "fake_ipv4"),
    MaskingRule("company_names", "business", ("company", "business", "organization", "employer"), ("string", "varchar", "text"), "fake_company"),
)

# Weight of the matched share of patterns and of a listed type.
PATTERN_WEIGHT = 0.7
TYPE_WEIGHT = 0.3


def type_name(data_type: T.DataType) -> str:
    """Spark type to the type name the rules list."""
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return data_type.simpleString()


def score(rule: MaskingRule, column: str, data_type: str) -> float:
    """Confidence of a rule for one column name, at plan time."""
    if not rule.enabled:
        return 0.0
    hits = sum(bool(re.search(p.lower(), column.lower())) for p in rule.patterns)
    share = hits / len(rule.patterns) * PATTERN_WEIGHT if hits else 0.0
    listed = data_type.lower() in {t.lower() for t in rule.data_types}
    return min(share + (TYPE_WEIGHT if listed else 0.0), 1.0)


def score_column(rule: MaskingRule, column: Column, data_type: Column) -> Column:
    """The same confidence over a catalog of columns."""
    if not rule.enabled:
        return F.lit(0.0)
    name = F.lower(column)
    hits = reduce(lambda a, b: a + b, [F.when(name.rlike(p.lower()), 1).otherwise(0) for p in rule.patterns])
    share = hits / F.lit(len(rule.patterns)) * PATTERN_WEIGHT
    listed = F.lower(data_type).isin([t.lower() for t in rule.data_types])
    return F.least(share + F.when(listed, TYPE_WEIGHT).otherwise(0.0), F.lit(1.0))


def score_rules(catalog: DataFrame, rules: Iterable[MaskingRule] = DEFAULT_RULES, min_score: float = 0.0) -> DataFrame:
    """One row per catalog column and rule with a score above ``min_score``.

    The rules are literals of the plan, so this is a projection and an explode: nothing is joined or
    shuffled whatever the size of the catalog.
    """
    scored = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_pos"),
                F.lit(r.name).alias("rule_name"),
                F.lit(r.category).alias("category"),
                F.lit(r.strategy).alias("strategy"),
                F.lit(r.confidence_threshold).alias("threshold"),
                score_column(r, F.col("column_name"), F.col("data_type")).alias("score"),
            )
            for i, r in enumerate(rules)
        ]
    )
    kept = F.filter(scored, lambda s: s["score"] > min_score)
    return catalog.select("*", F.explode(kept).alias("r")).select(*catalog.columns, "r.*")


def best_rules(catalog: DataFrame, rules: Iterable[MaskingRule] = DEFAULT_RULES, threshold: float | None = None) -> DataFrame:
    """Highest score per column, the earlier rule on a tie; ``applied`` only at the rule's threshold."""
    ranked = F.array(
        *[
            F.struct(
                score_column(r, F.col("column_name"), F.col("data_type")).alias("score"),
                F.lit(-i).alias("neg_pos"),
                F.lit(r.name).alias("rule_name"),
                F.lit(r.strategy).alias("strategy"),
                F.lit(r.confidence_threshold if threshold is None else threshold).alias("threshold"),
            )
            for i, r in enumerate(rules)
        ]
    )
    # explode keeps the scores from being computed once per use
    best = catalog.select("*", F.explode(F.array(F.array_max(ranked))).alias("best")).where(F.col("best.score") > 0)
    return best.select(
        *catalog.columns,
        F.col("best.rule_name").alias("rule_name"),
        F.col("best.strategy").alias("strategy"),
        F.col("best.score").alias("score"),
        (F.col("best.score") >= F.col("best.threshold")).alias("applied"),
    )


def resolve(
    schema: T.StructType,
    rules: Iterable[MaskingRule] = DEFAULT_RULES,
    threshold: float | None = None,
    column_types: dict[str, str] | None = None,
) -> dict[str, MaskingRule]:
    """Rule applied to each column of a schema; columns below their rule's threshold are absent."""
    rules = list(rules)
    chosen = {}
    for f in schema.fields:
        given = (column_types or {}).get(f.name) or type_name(f.dataType)
        scored = [(score(r, f.name, given), -i, r) for i, r in enumerate(rules)]
        top = max(scored, key=lambda x: x[:2], default=None)
        if top and top[0] > 0 and top[0] >= (top[2].confidence_threshold if threshold is None else threshold):
            chosen[f.name] = top[2]
    return chosen


def mask_column(field_: T.StructField, rule: MaskingRule, key: str) -> Column:
    """Masked column of the same type; a text mask leaves a column of another type alone."""
    value, dt = F.col(f"`{field_.name}`"), field_.dataType
    whole = isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
    fractional = isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType))
    if rule.strategy == "randomize_amount":
        if whole:
            return masks.whole_amount(value, key, field_.name).cast(dt).alias(field_.name)
        if fractional:
            return masks.amount(value, key, field_.name).cast(dt).alias(field_.name)
        return value.alias(field_.name)
    if rule.strategy == "fake_zipcode" and whole:
        return masks.zipcode_number(value, key, field_.name).cast(dt).alias(field_.name)
    if not isinstance(dt, T.StringType):
        return value.alias(field_.name)
    if rule.strategy not in masks.STRATEGIES or rule.strategy == "partial_mask":
        return masks.partial(value, preserve_length=rule.preserve_length).alias(field_.name)
    return masks.STRATEGIES[rule.strategy](value, key, field_.name).alias(field_.name)


def mask_dataset(
    df: DataFrame,
    key: str,
    rules: Iterable[MaskingRule] = DEFAULT_RULES,
    threshold: float | None = None,
    column_types: dict[str, str] | None = None,
) -> DataFrame:
    """Each column through the strategy of its best rule: one projection, batch or stream."""
    chosen = resolve(df.schema, rules, threshold, column_types)
    return df.select(
        *[mask_column(f, chosen[f.name], key) if f.name in chosen else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def masking_statistics(
    df: DataFrame, key: str, rules: Iterable[MaskingRule] = DEFAULT_RULES, threshold: float | None = None
) -> DataFrame:
    """Per column: values processed, masked, preserved and their rates. Nulls count as neither."""
    chosen = resolve(df.schema, rules, threshold)
    counts = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        masked = mask_column(f, chosen[f.name], key) if f.name in chosen else value
        counts.append(F.count(value).alias(f"{f.name}__n"))
        counts.append(F.count_if(value.isNotNull() & ~value.eqNullSafe(masked)).alias(f"{f.name}__m"))
    one = df.agg(*counts)
    per_column = F.array(
        *[
            F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}__n`").alias("processed"), F.col(f"`{f.name}__m`").alias("masked"))
            for f in df.schema.fields
        ]
    )
    return (
        one.select(F.explode(per_column).alias("s"))
        .select("s.*")
        .withColumn("preserved", F.col("processed") - F.col("masked"))
        .withColumn("masking_rate", F.when(F.col("processed") > 0, F.col("masked") / F.col("processed")))
        .withColumn("preservation_rate", F.when(F.col("processed") > 0, F.col("preserved") / F.col("processed")))
    )


EMAIL_SHAPE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_SHAPE = r"^[0-9]{10,}$"


def column_profile(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Totals, nulls, distinct values, e-mail and phone shares and length consistency per column.

    One aggregate over the rows as they are gives all figures, a row per task. Only where ``exact`` asks for true distinct counts
    is anything else shuffled, a number and a 64-bit hash per (column, value) and task, no text; otherwise distinct values are estimated. Two of a
    billion values share a hash with a chance of three in a hundred.
    """
    columns = columns or df.columns
    texts = {c: F.col(f"`{c}`").cast("string") for c in columns}

    def figures(c: str) -> Column:
        v = texts[c]
        length = F.length(v).cast("double")
        return F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("total_values"),
            F.count_if(v.isNull()).alias("null_count"),
            (F.lit(None).cast("long") if exact else F.approx_count_distinct(v)).alias("about"),
            F.count_if(F.coalesce(v.rlike(EMAIL_SHAPE), F.lit(False))).alias("email_matches"),
            F.count_if(F.coalesce(F.regexp_replace(v, r"[\s\-\(\)]", "").rlike(PHONE_SHAPE), F.lit(False))).alias("phone_matches"),
            F.nullif(F.count(v), F.lit(0)).alias("filled"),
            F.sum(length).alias("s1"),
            F.sum(length * length).alias("s2"),
        )

    one = df.agg(F.array(*[figures(c) for c in columns]).alias("all")).select(F.explode("all").alias("c")).select("c.*").where("total_values > 0")
    if exact:
        cells = [F.when(t.isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(t).alias("h"))) for i, t in enumerate(texts.values())]
        hashes = df.select(F.explode(F.array_compact(F.array(*cells))).alias("v")).select("v.i", "v.h").distinct()
        named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
        distinct = hashes.groupBy("i").agg(F.count(F.lit(1)).alias("distinct")).select(named.alias("column_name"), "distinct")
        out = one.join(distinct, "column_name", "left").withColumn("unique_count", F.coalesce("distinct", F.lit(0)).cast("long"))
    else:
        out = one.withColumnRenamed("about", "unique_count")
    mean = F.col("s1") / F.col("filled")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("filled") * F.col("s2") - F.col("s1") * F.col("s1"))) / F.col("filled")
    steady = F.when(F.col("filled") > 1, F.when(mean > 0, 1 - deviation / mean).otherwise(0.0)).otherwise(0.0)
    return out.select(
        "column_name",
        "total_values",
        "null_count",
        "unique_count",
        "email_matches",
        F.coalesce(F.col("email_matches") / F.col("filled"), F.lit(0.0)).alias("email_share"),
        "phone_matches",
        F.coalesce(F.col("phone_matches") / F.col("filled"), F.lit(0.0)).alias("phone_share"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), steady)).alias("format_consistency"),
    )


def dataset_sensitivity(catalog: DataFrame, by: list[str], rules: Iterable[MaskingRule] = DEFAULT_RULES, min_score: float = 0.0) -> DataFrame:
    """Per table: columns, sensitive columns, their share, and what to do with each.

    The list holds at most one entry per column of one table.
    """
    best = F.array_max(
        F.array(
            *[
                F.struct(
                    score_column(r, F.col("column_name"), F.col("data_type")).alias("score"),
                    F.lit(-i).alias("p"),
                    F.lit(r.strategy).alias("strategy"),
                )
                for i, r in enumerate(rules)
            ]
        )
    )
    scored = catalog.select("*", F.explode(F.array(best)).alias("best")).withColumn("sensitive", F.col("best.score") > min_score)
    advice = F.when(F.col("sensitive"), F.concat_ws(":", "column_name", "best.strategy"))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if("sensitive").alias("sensitive_columns"),
        (F.count_if("sensitive") / F.count(F.lit(1))).alias("sensitive_share"),
        F.array_join(F.array_sort(F.collect_list(advice)), ",").alias("recommendations"),
    )


def mask_free_text(df: DataFrame, text: str, key: str) -> DataFrame:
    """Cards, phones, e-mails and addresses inside ``text`` replaced, with a count per kind; all other text stays as it is."""
    out = df.withColumn("_pieces", masked_pieces(F.col(text), key, text))

    def count(kind: int):
        return F.size(F.filter("_pieces", lambda x: x["kind"] == kind)).cast("long")

    counts = {f"{name}_count": count(kind) for kind, (name, *_) in enumerate(KINDS, 1)}
    return out.withColumns({**counts, text: F.array_join(F.transform("_pieces", lambda x: x["s"]), "")}).drop("_pieces")


# Name families and keywords that mark a column of a replicated table.
NAME_FAMILIES: dict[str, tuple[str, ...]] = {
    "email": ("email", "e_mail", "mail", "email_address"),
    "phone": ("phone", "telephone", "mobile", "cell"),
    "ssn": ("ssn", "social_security", "social_security_number"),
    "name": ("name", "first_name", "last_name", "full_name"),
    "address": ("address", "street", "city", "state", "zip"),
    "credit_card": ("credit_card", "cc_number", "card_number"),
    "password": ("password", "pwd", "pass"),
    "ip": ("ip_address", "ip", "remote_addr"),
}
SENSITIVE_KEYWORDS = ("confidential", "private", "secret", "secure", "token", "key", "hash", "encrypted")
# The order in which families decide on the mask.
FAMILY_ORDER = ("email", "name", "phone", "address", "ssn", "credit_card", "password", "ip")
FAMILY_MASKS: dict[str, masks.Mask] = {
    "email": masks.email,
    "phone": masks.phone,
    "ssn": masks.ssn,
    "credit_card": masks.credit_card,
    "password": masks.hashed,
    "ip": masks.ipv4,
}
NAME_PARTS = (("first", masks.first_name), ("last", masks.last_name), ("", masks.full_name))
ADDRESS_PARTS = (
    ("street", masks.address),
    ("city", masks.city),
    ("state", masks.state),
    ("zip", masks.zipcode),
    ("", masks.address),
)


def is_keyword_sensitive(column: str) -> bool:
    name = column.lower()
    words = [w for family in NAME_FAMILIES.values() for w in family] + list(SENSITIVE_KEYWORDS)
    return any(w in name for w in words)


def keyword_sensitive_column(column: Column) -> Column:
    words = [w for family in NAME_FAMILIES.values() for w in family] + list(SENSITIVE_KEYWORDS)
    return F.lower(column).rlike("|".join(words))


def keyword_family(column: str) -> str | None:
    name = column.lower()
    return next((f for f in FAMILY_ORDER if any(w in name for w in NAME_FAMILIES[f])), None)


def keyword_family_column(column: Column) -> Column:
    cases = None
    for family in FAMILY_ORDER:
        hit = F.lower(column).rlike("|".join(NAME_FAMILIES[family]))
        cases = F.when(hit, family) if cases is None else cases.when(hit, family)
    return cases


def keyword_text_mask(column: str) -> masks.Mask:
    """Mask for a text column, chosen from its name."""
    family, name = keyword_family(column), column.lower()
    if family in ("name", "address"):
        parts = NAME_PARTS if family == "name" else ADDRESS_PARTS
        return next(mask for word, mask in parts if word in name)
    return FAMILY_MASKS.get(family, masks.keyword_text)


def keyword_mask(df: DataFrame, key: str, keep: Iterable[str] = ()) -> DataFrame:
    """Sensitive columns by name masked in place; types and the columns of ``keep`` stay."""
    keep = set(keep)
    out = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if f.name in keep or not is_keyword_sensitive(f.name):
            out.append(value)
        elif isinstance(f.dataType, T.StringType):
            out.append(keyword_text_mask(f.name)(value, key, f.name).alias(f.name))
        elif keyword_family(f.name) is not None:
            out.append(value)
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
            out.append(masks.whole_jitter(value, key, f.name).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(masks.jitter(value, key, f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(value)
    return df.select(*out)
