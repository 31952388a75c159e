r"""Personal data in texts by weak supervision, with DataFrame functions alone.

Texts are scanned once, where they are read. Every rule is a regular expression; what it matches and the text between the matches give candidates with
their places and a few letters around them, and only these go on. Four labelers vote on each candidate, yes, no or nothing:

* shape: the form of the rule and its check (digits, Luhn, parts of an address);
* gazetteer: lists of top domains, calling codes, card issuers, and blocks of addresses;
* context: words that stand before or after;
* border: what touches the candidate.

How many candidates have which votes is a table of at most 4 x 2 x 81 rows. Expectation-maximisation over it estimates, per kind, how often a labeler votes what
for personal data and for anything else; candidates whose check fails are known to be nothing. The posteriors are the targets of a logistic
regression over votes, kind and rule, the final span classifier. Its weights become literals of the expression that scores the candidates.

Base spans, those of a rule of the contract that pass its check, always stay. Others are added if the classifier gives them LEAST at least and they overlap
no base span and no candidate that was added before them.

The expressions match what the plain ones match, leftmost and longest, but start where a run of their letters starts or where the last match ended, and
never give back letters: each is linear in the text, however long a run is.

Defined results: a null text is an empty one; repeated rows and null ids have each their own spans; places count code points; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.llm.common import saved, text_of

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "gazetteer", "context", "border")
# Probability that an added span has at least.
LEAST = 0.9
# Letters around a candidate that labelers see.
BEFORE, AFTER = 40, 24
# Rounds of both fits, weight of the starting reliabilities in candidates, and the classifier's pull to zero.
EM_ROUNDS, PRIOR, FIT_ROUNDS, DECAY = 60, 10.0, 400, 1e-3
# Shares of yes, nothing and no that a labeler starts with for personal data; for anything else yes and no are exchanged.
START = {1: 0.7, 0: 0.2, -1: 0.1}


@dataclass(frozen=True)
class Rule:
    """``hint`` is a plain piece of text without which nothing can match."""

    kind: str
    base: bool
    pattern: str
    hint: str | None = None


RULES = (
    Rule("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Rule("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    # Whole runs of 13 to 19 digits: a shorter or longer run fails its check, and a match always takes its whole run.
    Rule("card", True, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"),
    Rule("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    # Not in the contract: the at sign and the dots spelled out, addresses of eight groups, cards with other separators, numbers without a calling code.
    Rule(
        "email", False,
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{]\x20?(?i:dot)\x20?[)\]}]\x20?)[A-Za-z0-9-]++)++",
    ),
    Rule("ip", False, r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", ":"),
    Rule("card", False, r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9./_])"),
    Rule("phone", False, r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-]*[0-9A-Za-z])"),
)

# Gazetteers. Top domains, calling codes, and issuer prefixes of cards in common use.
TOP_DOMAINS = "com org net edu gov info io eu de fr es uk it nl ch at be pl se dk no fi pt ru us ca au br mx jp cn in".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = "(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5))"
# Words around that speak for a kind, and words that speak against any.
FOR = {
    "email": "e-?mail|mail|contact|write|reach|courriel|correo|kontakt",
    "ip": "ip|ipv6|address|host|server|login|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|tarjeta|carte|karte",
    "phone": "phone|call|tel|telephone|mobile|cell|fax|telefon|llame",
}
AGAINST = "version|release|isbn|issn|serial|order|invoice|section|chapter|page|figure|table"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the weighted digits, doubled at every second place from the end, add up to a multiple of ten."""
    at = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(at, value), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def _passes(value: Column, kind: Column) -> Column:
    """The check of the contract for a match of a base rule; the others are checked in the same way where they have digits."""
    digits = _digits(value)
    small = F.forall(F.split(value, "[.]"), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3)
    at_most = F.forall(F.split(value, "[.]"), lambda p: F.substring(p, -3, 3).cast("int") <= 255)
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.when(F.contains(value, F.lit(":")), True).otherwise(small & at_most))
        .when(kind == "card", n.between(13, 19) & _luhn(digits))
        .otherwise(n.between(9, 15))
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, found: per document the rules that matched, each with its matches and what lies between them. Written once; texts stay."""
    read = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    some = F.array().cast("array<string>")
    for k, rule in enumerate(RULES):
        match = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        read = read.withColumn(f"match{k}", F.when(F.contains("text", F.lit(rule.hint)), match).otherwise(some) if rule.hint else match)

    def of(k: int, rule: Rule) -> Column:
        match, gaps = F.col(f"match{k}"), F.split("text", rule.pattern, -1)
        before = F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), F.substring(g, -BEFORE, BEFORE).alias("tail"), F.substring(g, 1, AFTER).alias("head")))
        return F.when(F.size(match) > 0, F.struct(F.lit(k).alias("rule"), match.alias("value"), before.alias("gap")))

    found = F.array_compact(F.array(*[of(k, rule) for k, rule in enumerate(RULES)]))
    # A match stands beside the text before it and the text after it.
    beside = F.transform(
        found, lambda r: F.struct(r["rule"].alias("rule"), F.arrays_zip(r["value"].alias("value"), r["gap"].alias("gap"), F.slice(r["gap"], 2, F.size(r["value"])).alias("after")).alias("matches"))
    )
    return saved(read.select("row_id", "doc_id", beside.alias("found")), "pii-candidates")


def _word(text: Column, words: str) -> Column:
    return F.lower(text).rlike(f"(?<![a-z])(?:{words})(?![a-z])")


def voted(found: DataFrame) -> DataFrame:
    """A row per candidate: row_id, doc_id, kind (its number), base, passes, start, end, value, and the labelers' votes (1, 0, -1)."""
    rules = found.select("row_id", "doc_id", F.explode("found").alias("r")).select("row_id", "doc_id", "r.rule", F.posexplode("r.matches").alias("no", "m"))
    each = rules.where(F.col("m.value").isNotNull()).select(
        "row_id", "doc_id", "rule", "no", "m.value", F.col("m.gap.n").alias("gap"), F.col("m.gap.tail").alias("tail"), F.col("m.after.head").alias("head")
    )
    reach = F.sum(F.col("gap") + F.length("value")).over(W.partitionBy("row_id", "rule").orderBy("no"))
    names = F.array(*[F.lit(r.kind) for r in RULES])
    numbers, base = F.array(*[F.lit(KINDS.index(r.kind)) for r in RULES]), F.array(*[F.lit(r.base) for r in RULES])
    rows = each.withColumns({"end": reach.cast("int"), "name": names[F.col("rule")], "kind": numbers[F.col("rule")], "base": base[F.col("rule")]})
    rows = rows.withColumn("passes", _passes(F.col("value"), F.col("name")))
    value, name, digits = F.col("value"), F.col("name"), _digits(F.col("value"))

    def yes(c: Column) -> Column:
        return F.when(c, 1).otherwise(-1)

    top = F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS)
    code = digits.rlike(f"^(?:{'|'.join(CALLING_CODES)})")
    first = F.regexp_extract(value, "^0*([0-9]{1,3})[.]", 1)
    public = ~first.isin("", "0", "127", "255")
    area = digits.rlike("^[2-9][0-9]{2}[2-9]")
    gazetteer = (
        F.when(name == "email", yes(top))
        .when(name == "ip", F.when(F.contains(value, F.lit(":")), yes(F.lower(value).rlike("^(?:2[0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}):"))).otherwise(yes(public)))
        .when(name == "card", yes(digits.rlike("^" + ISSUERS)))
        .otherwise(yes(F.when(F.col("base"), code).otherwise(area)))
    )
    around = F.concat_ws(" ", "tail", "head")
    cue = F.lit(False)
    for kind, words in FOR.items():
        cue = cue | ((name == kind) & _word(around, words))
    context = F.when(cue, 1).when(_word(around, AGAINST), -1).otherwise(0)
    touched = F.col("tail").rlike("[A-Za-z0-9_]$") | F.col("head").rlike("^[A-Za-z0-9_]")
    votes = {"shape": yes(F.col("passes")), "gazetteer": gazetteer, "context": context, "border": yes(~touched)}
    out = rows.withColumns({k: v.cast("int") for k, v in votes.items()})
    return out.select("row_id", "doc_id", "kind", "base", "passes", (F.col("end") - F.length("value")).alias("start"), "end", "value", *LABELERS)


def reliabilities(counts: list[dict]) -> dict[int, tuple[float, list[dict]]]:
    """Per kind the share of personal data, and per labeler {(is personal, vote): probability}, by expectation-maximisation.

    ``counts`` has kind, passes, the votes and n, the number of candidates with them.
    """
    out = {}
    for kind in range(len(KINDS)):
        rows = [r for r in counts if r["kind"] == kind]
        share = 0.5
        tables = [{(y, v): p if y else START[-v] for v, p in START.items() for y in (0, 1)} for _ in LABELERS]
        for _ in range(EM_ROUNDS):
            sums = [{k: PRIOR * (START[k[1]] if k[0] else START[-k[1]]) for k in t} for t in tables]
            ones, total = PRIOR / 2, PRIOR
            for r in rows:
                p = posterior(r, share, tables)
                ones, total = ones + p * r["n"], total + r["n"]
                for labeler, t in zip(LABELERS, sums, strict=True):
                    t[1, r[labeler]] += p * r["n"]
                    t[0, r[labeler]] += (1 - p) * r["n"]
            share = ones / total
            tables = [{(y, v): t[y, v] / sum(t[y, u] for u in START) for y, v in t} for t in sums]
        out[kind] = (share, tables)
    return out


def posterior(row: dict, share: float, tables: list[dict]) -> float:
    """Probability of personal data given a candidate's votes; one whose check fails is none."""
    if not row["passes"]:
        return 0.0
    yes, no = share, 1 - share
    for labeler, t in zip(LABELERS, tables, strict=True):
        yes, no = yes * t[1, row[labeler]], no * t[0, row[labeler]]
    return yes / (yes + no)


def features(row: dict) -> list[str]:
    """The features that a candidate has."""
    return ["bias", f"kind {row['kind']}", f"base {row['base']}", *[f"{k} {row[k]}" for k in LABELERS if row[k]]]


def classifier(counts: list[dict], learned: dict[int, tuple[float, list[dict]]]) -> dict[str, float]:
    """Weights of a logistic regression on the posteriors, by gradient steps over the table of votes; kinds weigh alike."""
    rows = [(features(r), posterior(r, *learned[r["kind"]]), r["n"] / sum(x["n"] for x in counts if x["kind"] == r["kind"])) for r in counts]
    weights = {f: 0.0 for names, _, _ in rows for f in names}
    for _ in range(FIT_ROUNDS):
        slope = {f: -DECAY * w for f, w in weights.items()}
        for names, p, n in rows:
            off = n * (p - 1 / (1 + math.exp(-sum(weights[f] for f in names))))
            for f in names:
                slope[f] += off
        weights = {f: w + 0.5 * slope[f] for f, w in weights.items()}
    return weights


def train(rows: DataFrame) -> dict[str, float]:
    """Weights of the final classifier from the votes on all candidates."""
    keys = ["kind", "base", "passes", *LABELERS]
    counts = [r.asDict() for r in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys).collect()]
    return classifier(counts, reliabilities(counts))


def _probability(weights: dict[str, float]) -> Column:
    def w(name: str) -> Column:
        return F.lit(weights.get(name, 0.0))

    total = w("bias")
    for k in range(len(KINDS)):
        total = total + F.when(F.col("kind") == k, w(f"kind {k}")).otherwise(0.0)
    total = total + F.when(F.col("base"), w("base True")).otherwise(w("base False"))
    for name in LABELERS:
        total = total + F.when(F.col(name) == 1, w(f"{name} 1")).when(F.col(name) == -1, w(f"{name} -1")).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def spans(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """row_id, doc_id, kind, base, start, end, value, probability: base spans, and the candidates that the classifier adds."""
    scored = rows.where("passes").withColumn("probability", _probability(weights)).where(F.col("base") | (F.col("probability") >= LEAST))
    order = ["start", "end", "kind", "base"]
    earlier, later = (W.partitionBy("row_id").orderBy(*by).rowsBetween(W.unboundedPreceding, -1) for by in (order, [F.desc(c) for c in order]))
    base = F.col("base")
    reach = F.max("end").over(earlier)  # of base spans and of what may be added
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(base, F.col("start"))).over(later), F.col("end")) >= F.col("end"))
    kept = scored.withColumn("free", free).where(base | F.col("free"))
    return kept.select("row_id", "doc_id", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1).alias("kind"), "base", "start", "end", "value", "probability")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, spans (all), per document. Only documents with candidates are shuffled."""
    found = candidates(docs, id_col, text_col)
    some = found.where(F.size("found") > 0)
    rows = saved(voted(some), "pii-votes")
    kept = spans(rows, train(rows))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    place = F.struct(number.alias("kind"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("text"))

    def joined(c: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(c), lambda x: x["text"]), ",")

    per_row = kept.groupBy("row_id").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        joined(F.collect_list(F.when(F.col("base"), place))).alias("base_spans"), joined(F.collect_list(place)).alias("spans"),
    )
    names = [f"n_{k}" for k in KINDS]
    with_some = some.select("row_id", "doc_id").join(per_row, "row_id", "left")
    zero = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names]
    with_some = with_some.select("doc_id", *zero, F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))
    none = found.where(F.size("found") == 0).select("doc_id", *[F.lit(0).cast("long").alias(n) for n in names], F.lit("").alias("base_spans"), F.lit("").alias("spans"))
    return with_some.unionByName(none).select("doc_id", *names, F.sha2("base_spans", 256).alias("base_sha256"), "spans")
