"""Edge cases of the masks and the rules."""

from __future__ import annotations

import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkguard.functions import masks
from sparkguard.operators import masking as M

KEY = "k"


def masked(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def luhn_ok(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0


def test_partial(spark):
    values = ["ab", "abc", "abcd", "abcde", "abcdefgh", "", None]
    assert masked(spark, values, masks.partial) == ["XX", "aXc", "aXXd", "abXde", "abXXXXgh", "", None]
    short = masked(spark, ["abcdefgh", "", "a"], lambda c: masks.partial(c, preserve_length=False))
    assert short == ["abXXXgh", "XX", "XX"]


def test_keyword_text(spark):
    assert masked(spark, ["abc", "abcd", "", None], masks.keyword_text) == ["XXX", "aXXd", "", None]


def test_phone_boundary_of_ten_digits(spark):
    nine, ten = masked(spark, ["555-123-456", "555-123-4567"], lambda c: masks.phone(c, KEY, "phone"))
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", nine)
    assert re.fullmatch(r"\d{3}-\d{3}-\d{4}", ten) and ten != "555-123-4567"


def test_credit_card_boundary_of_thirteen_digits(spark):
    values = ["123456789012", "1234-5678-9012-3", "4532-1234-5678-9012", "4532 1234 5678 9012 end", None]
    twelve, thirteen, sixteen, suffixed, none = masked(spark, values, lambda c: masks.credit_card(c, KEY, "cc"))
    assert re.fullmatch(r"4\d{15}", twelve) and luhn_ok(twelve)
    assert re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d", thirteen) and luhn_ok(thirteen)
    assert re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", sixteen) and luhn_ok(sixteen)
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4} end", suffixed) and luhn_ok(suffixed)
    assert none is None


def test_amount_keeps_sign_magnitude_and_decimals(spark):
    values = [0.0, 75000.0, -12.0, 0.4, 123.45, None]
    zero, big, negative, small, cents, none = masked(spark, values, lambda c: masks.amount(c, KEY, "a"), "double")
    assert zero == 0 and none is None
    assert 10_000 <= big <= 99_999 and -99 <= negative <= -10
    assert 1 <= small <= 9 and 100 <= cents <= 999
    assert round(cents, 2) == cents and round(small, 1) == small


def test_whole_amount(spark):
    values = [0, 7, -150, 99999, None]
    zero, one, negative, five, none = masked(spark, values, lambda c: masks.whole_amount(c, KEY, "a"), "bigint")
    assert zero == 0 and none is None and 1 <= one <= 9 and -999 <= negative <= -100 and 10_000 <= five <= 99_999


def test_jitter(spark):
    moved = masked(spark, [100.0, -100.0, None], lambda c: masks.jitter(c, KEY, "a"), "double")
    assert 90 <= moved[0] <= 110 and moved[1] == 0 and moved[2] is None
    whole = masked(spark, [100, 5, -3, None], lambda c: masks.whole_jitter(c, KEY, "a"), "bigint")
    assert 90 <= whole[0] <= 110 and whole[1] == 5 and whole[2] == 0 and whole[3] is None


@pytest.mark.parametrize("strategy", sorted(masks.STRATEGIES))
def test_every_text_strategy_keeps_null_and_repeats(spark, strategy):
    if strategy == "randomize_amount":
        return
    fn = masks.STRATEGIES[strategy]
    once = masked(spark, ["user1@mail.test", None, "", "x"], lambda c: fn(c, KEY, "col"))
    again = masked(spark, ["user1@mail.test", None, "", "x"], lambda c: fn(c, KEY, "col"))
    assert once == again and once[1] is None and all(isinstance(x, str) for x in (once[0], once[2], once[3]))


def test_key_and_column_change_the_mask(spark):
    a, b, c = (masked(spark, ["user1@mail.test"], lambda v, k=k, n=n: masks.hashed(v, k, n)) for k, n in (("k", "x"), ("l", "x"), ("k", "y")))
    assert len({a[0], b[0], c[0]}) == 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab19-é😀 ", max_size=80), min_size=1, max_size=20))
def test_format_keeping_masks(spark, values):
    digits = masked(spark, values, lambda c: masks.replace_digits(c, KEY, "c"))
    mixed = masked(spark, values, lambda c: masks.shuffle(c, KEY, "c"))
    for v, d, m in zip(values, digits, mixed, strict=True):
        assert re.sub("[0-9]", "#", v) == re.sub("[0-9]", "#", d)
        assert sorted(v) == sorted(m)


EXPECTED = [
    ("email", "varchar", 17, 0.65, "email_addresses"),
    ("contact_email", "varchar", 17, 0.825, "email_addresses"),
    ("contact_email_address", "varchar", 17, 1.0, "email_addresses"),
    ("first_name", "varchar", 17, 0.5333, "first_names"),
    ("last_name", "varchar", 17, 0.475, "last_names"),
    ("phone", "varchar", 17, 0.44, "phone_numbers"),
    ("telephone_mobile_cell", "varchar", 17, 0.86, "phone_numbers"),
    ("ssn", "varchar", 17, 0.5333, "ssn"),
    ("salary", "decimal", 1, 0.44, "salaries"),
    ("credit_card", "varchar", 17, 0.475, "credit_cards"),
    ("password", "varchar", 17, 0.65, "passwords"),
    ("password_pwd_secret", "text", 8, 1.0, "passwords"),
    ("ip_address", "varchar", 17, 0.5333, "addresses"),
    ("non_sensitive", "varchar", 17, 0.3, "email_addresses"),
    ("email", "VARCHAR(255)", 1, 0.35, "email_addresses"),
    ("l_orderkey", "bigint", 1, 0.175, "tokens"),
]


def test_rule_scores(spark):
    catalog = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(EXPECTED)], "id int, column_name string, data_type string")
    counts = {r["id"]: r["count"] for r in M.score_rules(catalog).groupBy("id").count().collect()}
    best = {r["id"]: r for r in M.best_rules(catalog).collect()}
    for i, (_, _, n, top, rule) in enumerate(EXPECTED):
        assert counts[i] == n and round(best[i]["score"], 4) == top and best[i]["rule_name"] == rule
        assert best[i]["applied"] == (top >= 0.8)


def test_threshold_is_inclusive_and_disabled_rules_do_not_count(spark):
    rule = M.MaskingRule("r", "pii", ("code",), ("other",), "partial_mask", confidence_threshold=0.7)
    schema = spark.createDataFrame([("abcdef",)], "code string").schema
    assert set(M.resolve(schema, [rule])) == {"code"}
    assert M.resolve(schema, [M.MaskingRule("r", "pii", ("code",), ("string",), "partial_mask", enabled=False)]) == {}


def test_custom_rule_and_unknown_strategy(spark):
    rule = M.MaskingRule("r", "pii", ("code",), ("string",), "no_such_strategy")
    out = M.mask_dataset(spark.createDataFrame([("abcdefgh", 1)], "code string, n int"), KEY, [*M.DEFAULT_RULES, rule])
    assert out.collect() == [("abXXXXgh", 1)]


def test_masks_keep_types(spark):
    df = spark.createDataFrame([("2020-01-01", 5, 1.5, True)], "ship_date string, zip int, salary double, phone boolean")
    df = df.withColumn("ship_date", F.to_date("ship_date"))
    out = M.mask_dataset(df, KEY, threshold=0.1)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert 10_000 <= out.head()["zip"] <= 99_999
    assert M.keyword_mask(df, KEY).schema.simpleString() == df.schema.simpleString()


def test_keyword_columns():
    sensitive = "c_name n_name p_name r_name s_name l_shipdate o_custkey l_orderkey".split()
    plain = "c_acctbal c_mktsegment o_orderdate l_quantity doc_id text lang embedding page_id item_id quality turn props".split()
    assert all(M.is_keyword_sensitive(c) for c in sensitive) and not any(M.is_keyword_sensitive(c) for c in plain)


def test_free_text_around_matches_stays(spark):
    text = "call 555-123-4567 ref 9555-123-45678 v10.1.1.1 and 555-123-4567, 10.1.1.1 x@y.org"
    row = M.mask_free_text(spark.createDataFrame([(text,)], "t string"), "t", KEY).first()
    assert (row["card_count"], row["phone_count"], row["email_count"], row["ip_count"]) == (0, 2, 1, 1)
    shape = re.fullmatch(r"call (\S+) ref 9555-123-45678 v10\.1\.1\.1 and (\S+), (\S+) (\S+@\S+)", row["t"])
    assert shape and shape[1] == shape[2] != "555-123-4567" and shape[3] != "10.1.1.1" and shape[4] != "x@y.org"


def test_free_text_takes_time_in_proportion(spark):
    def seconds(n):
        text = " ".join(f"user{i}@mail{i}.org 10.{i % 250}.{i % 199}.{i % 77}" for i in range(n))
        df = spark.createDataFrame([(text,)], "t string")
        start = time.perf_counter()
        assert M.mask_free_text(df, "t", KEY).first()["email_count"] == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(32_000) < 16 * max(0.5, seconds(4_000))  # the longer text has more than a megabyte


def test_free_text_is_whole_and_consistent(spark):
    text = "mail a@b.com, xa@b.com, a@b.com; card 4532-1234-5678-9012; call (555) 123-4567 or (555) 1234567; host 10.0.0.1. " * 400
    row = M.mask_free_text(spark.createDataFrame([(text,), (None,), ("nothing",)], "t string"), "t", KEY).collect()
    assert (row[0]["email_count"], row[0]["card_count"], row[0]["phone_count"], row[0]["ip_count"]) == (1200, 400, 800, 400)
    for secret in ("a@b.com", "4532-1234-5678-9012", "123-4567", "1234567", "10.0.0.1"):
        assert secret not in row[0]["t"]
    found = re.findall(r"mail (\S+), (\S+), (\S+);", row[0]["t"])
    assert len(set(found)) == 1 and found[0][0] == found[0][2] != found[0][1]
    assert row[1]["t"] is None and row[2]["t"] == "nothing"


def test_estimated_profile_agrees(spark):
    df = spark.range(500).selectExpr("concat('u', id % 50, '@b.co') as e", "cast(id % 7 as string) as n")
    exact = {r["column_name"]: r.asDict() for r in M.column_profile(df, exact=True).collect()}
    rough = {r["column_name"]: r.asDict() for r in M.column_profile(df).collect()}
    for c in exact:
        assert abs(exact[c].pop("unique_count") - rough[c].pop("unique_count")) <= 5
        assert exact[c] == pytest.approx(rough[c])


def test_profile_of_edge_columns(spark):
    df = spark.createDataFrame([("a@b.co", "555 123 4567", None), ("x", "12", None), ("x", "12", None)], "e string, p string, n string")
    rows = {r["column_name"]: r for r in M.column_profile(df, exact=True).collect()}
    assert rows["e"]["email_matches"] == 1 and rows["e"]["unique_count"] == 2 and rows["p"]["phone_matches"] == 1
    assert rows["n"]["null_count"] == 3 and rows["n"]["unique_count"] == 0 and rows["n"]["format_consistency"] == 0
