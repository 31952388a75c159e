"""SQL text of the masks, for the twins."""

from __future__ import annotations

import hashlib

from sparkguard.functions import words

KEY = "demo-key"


def lst(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def own_key(col: str, key: str = KEY) -> str:
    inner, outer = (bytes(b ^ x for b in key.encode().ljust(64, b"\0")) for x in (0x36, 0x5C))
    return hashlib.sha256(outer + hashlib.sha256(inner + col.encode()).digest()).hexdigest()[:32]


def h(v: str, col: str) -> str:
    return f"md5('{own_key(col)}:' || {v})"


def strong(v: str, col: str) -> str:
    return f"sha256('{own_key(col)}:' || {v})"


def slot(x: str, i: int) -> str:
    return f"cast('0x' || substr({x}, {1 + 8 * i}, 8) as bigint)"


def pick(items, n: str) -> str:
    return f"{lst(items)}[1 + {n} % {len(items)}]"


def digits(n: str, width: int) -> str:
    return f"lpad(cast({n} % {10**width} as varchar), {width}, '0')"


def supply(x: str, n: str) -> str:
    return f"array_to_string(list_transform(range(0, ({n}) // 32 + 1), lambda b: md5({x} || ':' || cast(b as varchar))), '')"


def dsupply(x: str, n: str) -> str:
    return f"translate({supply(x, n)}, 'abcdef', '012345')"


def replaced(v: str, col: str) -> str:
    return (
        f"array_to_string(list_transform(list_zip(str_split({v}, ''), str_split(substr({dsupply(h(v, col), f'length({v})')}, 1, length({v})), '')), "
        "lambda p: case when regexp_full_match(p[1], '[0-9]') then p[2] else p[1] end), '')"
    )


def luhn(payload: str) -> str:
    return (
        "cast((10 - list_sum(list_transform(list_zip(str_split(reverse({p}), ''), range(0, length({p}))), "
        "lambda q: case when q[2] % 2 = 0 then cast(q[1] as int) * 2 - case when cast(q[1] as int) > 4 then 9 else 0 end "
        "else cast(q[1] as int) end)) % 10) % 10 as varchar)"
    ).format(p=payload)


def num(v: str) -> str:
    return f"cast(cast({v} as decimal(38,6)) as varchar)"


def text_mask(strategy: str, v: str, col: str) -> str:
    x = h(v, col)
    s = [slot(x, i) for i in range(4)]
    strip = f"regexp_replace({v}, '[^0-9]', '', 'g')"

    def prefixed(p, w):
        lo = 10 ** (w - 1)
        return f"'{p}' || cast({lo} + ({s[0]} * 65536 + {s[1]} % 65536) % {9 * lo} as varchar)"

    first, last = pick(words.FIRST_NAMES, s[0]), pick(words.LAST_NAMES, s[1])
    if strategy == "fake_first_name":
        e = first
    elif strategy == "fake_last_name":
        e = last
    elif strategy == "fake_name":
        e = f"{first} || ' ' || {last}"
    elif strategy == "fake_email":
        e = f"lower({first}) || '.' || lower({last}) || cast({s[2]} % 1000 as varchar) || '@example.' || {pick(words.TLDS, s[3])}"
    elif strategy == "replace_digits":
        e = replaced(v, col)
    elif strategy == "fake_phone":
        e = (
            f"case when length({strip}) >= 10 then {replaced(v, col)} else "
            f"'(' || cast(200 + {s[0]} % 800 as varchar) || ') ' || {digits(s[1], 3)} || '-' || {digits(s[2], 4)} end"
        )
    elif strategy == "fake_ssn":
        e = f"{digits(s[0], 3)} || '-' || {digits(s[1], 2)} || '-' || {digits(s[2], 4)}"
    elif strategy == "fake_address":
        e = f"cast(1 + {s[0]} % 9999 as varchar) || ' ' || {pick(words.STREETS, s[1])} || ' ' || {pick(words.STREET_KINDS, s[2])}"
    elif strategy == "fake_city":
        e = pick(words.CITIES, s[0])
    elif strategy == "fake_state":
        e = pick(words.STATES, s[0])
    elif strategy == "fake_zipcode":
        e = f"cast(10000 + {s[0]} % 90000 as varchar)"
    elif strategy == "fake_credit_card":
        r = replaced(v, col)
        d = f"regexp_replace({r}, '[^0-9]', '', 'g')"
        kept = f"regexp_replace({r}, '[0-9]([^0-9]*)$', {luhn(f'substr({d}, 1, length({d}) - 1)')} || '\\1')"
        pay = f"('4' || substr({dsupply(x, '1')}, 1, 14))"
        e = f"case when length({strip}) >= 13 then {kept} else {pay} || {luhn(pay)} end"
    elif strategy == "fake_account_number":
        e = prefixed("ACC", 10)
    elif strategy == "fake_business_id":
        e = prefixed("BIZ", 6)
    elif strategy == "fake_transaction_id":
        e = prefixed("TXN", 9)
    elif strategy == "fake_medical_id":
        e = prefixed("MRN", 7)
    elif strategy == "fake_hash":
        e = strong(v, col)
    elif strategy == "fake_api_key":
        e = (
            f"array_to_string(list_transform(range(0, 32), lambda i: substr('{words.ALPHABET}', "
            f"1 + cast(cast('0x' || substr({strong(v, col)}, i * 2 + 1, 2) as bigint) % {len(words.ALPHABET)} as int), 1)), '')"
        )
    elif strategy == "fake_ipv4":
        e = " || '.' || ".join(f"cast({z} % 256 as varchar)" for z in s)
    elif strategy == "fake_company":
        e = f"{pick(words.LAST_NAMES, s[0])} || ' ' || {pick(words.COMPANY_KINDS, s[1])}"
    elif strategy == "partial_mask":
        e = (
            f"case when length({v}) <= 2 then repeat('X', length({v})) when length({v}) <= 4 then left({v}, 1) || repeat('X', length({v}) - 2) || right({v}, 1) "
            f"else left({v}, 2) || repeat('X', length({v}) - 4) || right({v}, 2) end"
        )
    elif strategy == "shuffle_chars":
        e = (
            f"array_to_string(list_transform(list_sort(list_transform(list_zip(str_split({v}, ''), range(0, length({v}))), "
            f"lambda p: struct_pack(k := substr({supply(x, f'length({v}) * 8')}, p[2] * 8 + 1, 8), c := p[1]))), lambda z: z.c), '')"
        )
    elif strategy == "keyword_text":
        e = (
            f"case when length({v}) <= 3 then repeat('X', length({v})) "
            f"else left({v}, 1) || repeat('X', length({v}) - 2) || right({v}, 1) end"
        )
    else:
        raise KeyError(strategy)
    return f"(case when {v} is null then null else {e} end)"


def amount(v: str, col: str) -> str:
    x = h(num(v), col)
    low = f"pow(10.0::double, length(cast(cast(floor(abs({v})) as decimal(38,0)) as varchar)) - 1)"
    places = f"greatest(1, length(regexp_replace(split_part({num(v)}, '.', -1), '0+$', '')))"
    scale = f"pow(10.0::double, {places})"
    return (
        f"(case when {v} is null or {v} = 0 then {v} else round(({low} + {slot(x, 0)}::double / 4294967296.0::double * ({low} * 10 - 1 - {low})) * {scale}) "
        f"/ {scale} * case when {v} < 0 then -1.0::double else 1.0::double end end)"
    )


def whole_amount(v: str, col: str) -> str:
    x = h(f"cast({v} as varchar)", col)
    low = f"cast(pow(10, length(cast(abs({v}) as varchar)) - 1) as bigint)"
    return f"(case when {v} is null or {v} = 0 then {v} else ({low} + {slot(x, 0)} % ({low} * 9)) * case when {v} < 0 then -1 else 1 end end)"


def jitter(v: str, col: str) -> str:
    f = f"({slot(h(num(v), col), 0)}::double / 4294967296.0::double)"
    return f"(case when {v} is null then null else greatest(0.0::double, {v} + abs({v}) * 0.1::double * ({f} * 2 - 1)) end)"


def whole_jitter(v: str, col: str) -> str:
    span = f"(abs({v}) // 10)"
    return f"(case when {v} is null then null else greatest(0, {v} + {slot(h(f'cast({v} as varchar)', col), 0)} % ({span} * 2 + 1) - {span}) end)"
