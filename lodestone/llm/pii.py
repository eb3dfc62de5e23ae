"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Numbers and dates that pass validation are permuted within their own format by a keyed Feistel network over
their digits, so a value maps to the same pseudonym wherever it stands and no two values share one. Addresses
of people get a keyed digest. Everything else in a text stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each kind's form. A match is replaced only if it is valid (see `_valid`).
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*+\.)++[A-Za-z]{2,}+",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}+(?![0-9A-Za-z])",
    "date": "|".join([
        r"(?<!\d)(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d)",
        r"(?<!\d)(?<!\d[./])(?:19|20)\d\d(?<y>[./])\d{1,2}\k<y>\d{1,2}(?!\d|[./]\d)",
        r"(?<!\d)(?<!\d[./])\d{1,2}(?<d>[./])\d{1,2}\k<d>(?:19|20)\d\d(?!\d|[./]\d)",
        r"(?<!\d)(?<!\d-)\d{1,2}-\d{1,2}-(?:19|20)\d\d(?!\d|-\d)",
    ]),
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "phone": "|".join([
        r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)",
        r"(?<![\w+])(?:\+|(?<!\d[.,\-/])00(?!\d{14}))[1-9]\d{0,2}[ .\-/]?(?:\(0\) ?)?\(?\d{1,5}\)?[ .\-/]?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\d)",
    ]),
    "ssn": r"(?<![\d\-])\d{3}-\d\d-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?<!\d\.)(?:\d{13,19}+|\d{4}(?<c>[ \-])\d{4}\k<c>\d{4}\k<c>\d{1,7}+|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
}
#: Phone numbers without a country, tried where nothing else matches: an area in brackets; a trunk 0, then pairs, an
#: area and groups, or digits alone; ten digits as 3-3-4.
NATIONAL = "|".join([
    r"(?<!\d)\((?!00|(?:19|20)\d\d\))\d{2,5}\)[ .\-/]?(?:\d{3,4}[ .\-]?\d{3,4}|\d{2,3}(?:[ .\-]\d\d){2,3}|\d{5,8})(?!\w|[.,\-/]\d)",
    r"(?<![\w+])(?<!\d[.,\-/])(?:0[1-9](?:(?<t>[ .\-])\d\d(?:\k<t>\d\d){3}|\d{1,3}(?: ?[/\-] ?|[ .])\d{3}(?:[ .\-]\d\d){2}|\d{1,3}(?: ?[/\-] ?|[ .])\d{3,4}[ .\-]\d{3,4}|\d{1,4}(?: ?[/\-] ?| )\d{5,8}|\d{8,9})|(?:1[ .\-])?[1-9]\d\d(?<n>[ .\-])\d{3}\k<n>\d{4})(?!\w|[.,\-/]\d)",
])
PATTERN = "|".join([*FORMS.values(), NATIONAL])
ROUNDS = 8
HEX = "'0123456789abcdef'"
#: Days that a date may move within: 1900-01-01 to 2099-12-31.
DAYS = 73049
DAY0 = "date'1900-01-01'"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shift(digits: str, stream: str, radix: int) -> str:
    """Each digit plus a byte of the stream (64 hexadecimal digits, used again if short), modulo the radix."""
    return f"array_join(transform(sequence(1, length({digits})), i -> substr({HEX}, (instr({HEX}, substr({digits}, i, 1)) - 1 + cast(conv(substr({stream}, (i - 1) % 32 * 2 + 1, 2), 16, 10) as int)) % {radix} + 1, 1)), '')"


def feistel(digits: str, radix: int, key: str, tag: str) -> str:
    """SQL for a keyed permutation of digit strings of one length (2 digits or more) and radix.

    The two halves take turns: one is shifted by a digest of the key, the round and the other.
    """
    half = f"cast(length({digits}) div 2 as int)"
    salt = lambda other: f"sha2(concat({_q(key + '|' + tag + '|')}, r, '|', length(s.a), '|', length(s.b), '|', {other}), 256)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substr({digits}, 1, {half}), 'b', substr({digits}, {half} + 1)), "
        f"(s, r) -> if(r % 2 = 1, named_struct('a', {_shift('s.a', salt('s.b'), radix)}, 'b', s.b), named_struct('a', s.a, 'b', {_shift('s.b', salt('s.a'), radix)})), s -> concat(s.a, s.b))"
    )


def walk(start: str, step: str, valid: str, most: int) -> str:
    """SQL for cycle walking: apply `step` (of x) until `valid` (of x) holds. With a share v of valid values, more
    than `most` steps are needed with probability (1 - v) ** most."""
    return f"aggregate(sequence(1, {most}), named_struct('x', {start}, 'done', false), (w, k) -> if(w.done, w, transform(array({step.replace('{x}', 'w.x')}), y -> named_struct('x', y, 'done', {valid.replace('{x}', 'y')}))[0]), w -> w.x)"


def luhn_sum(digits: str, doubled_first: bool) -> str:
    """Luhn's sum from the right; `doubled_first` if the rightmost digit given is a doubled one."""
    odd = 1 if doubled_first else 0
    return f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + if(i % 2 = {odd}, transform(array(2 * cast(substr({digits}, -i, 1) as int)), d -> d - if(d > 9, 9, 0))[0], cast(substr({digits}, -i, 1) as int)))"


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in turn by `digits`."""
    return f"array_join(transform(sequence(1, length({shape})), i -> if(substr({shape}, i, 1) between '0' and '9', substr({digits}, length(regexp_replace(substr({shape}, 1, i), '[^0-9]', '')), 1), substr({shape}, i, 1))), '')"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


SSN_OK = "(substr({x}, 1, 3) not in ('000', '666') and substr({x}, 1, 1) != '9' and substr({x}, 4, 2) != '00' and substr({x}, 6) != '0000')"
#: A date's parts p as text that casts to a date, by their order. Where a four-digit year comes last, the month comes
#: first between slashes, else the day; if no such date exists, the other order is taken ("swapped").
_AS = {o: f"concat_ws('-', p[{y}], lpad(p[{m}], 2, '0'), lpad(p[{d}], 2, '0'))" for o, (y, m, d) in {"ymd": (0, 1, 2), "dmy": (2, 1, 0), "mdy": (2, 0, 1)}.items()}
_PARTS = "split(m, '[./-]')"
_IS = {o: f"try_cast({x} as date) is not null" for o, x in _AS.items()}
_OCTETS = "transform(split(m, '[.]'), o -> cast(o as int))"


#: A phone number's digits, without the trunk 0 that is written in brackets after a country.
_BARE = "regexp_replace(replace(m, '(0)', ''), '[^0-9]', '')"
# Country codes of one and two digits; all others have three.
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Numbers of the North American plan without a country: 3-3-4, perhaps after a 1, or with the area in brackets.
_AMERICAN = r"^(?:(?:1[ .\-])?[1-9][0-9]{2}([ .\-])[0-9]{3}\1[0-9]{4}|\([1-9][0-9]{2}\)[ .\-/]?[0-9]{3}[ .\-]?[0-9]{4})$"


def _phone(key: str) -> str:
    """SQL for a phone number's pseudonym in the shape of m.

    A number with a country (after + or 00, or of the North American plan) is permuted by its digits alone, its
    country kept, so that all its spellings stay linked. Others keep a trunk 0 and are permuted behind it.
    """
    led = "(substr({x}, 1, 1) <> '0')"
    step = feistel("{x}", 10, key, "phone")
    # behind the 1 of North America a leading digit other than 0 stays one, which the 3-3-4 spelling needs
    rest = f"case when c <> '1' or length(q) <> 10 then {feistel('q', 10, key, 'phone')} when q like '0%' then concat('0', {_let('substr(q, 2)', 'v', feistel('v', 10, key, 'phone'))}) else {walk('q', step, led, 60)} end"
    permuted = _let(f"regexp_extract(n, {_q(COUNTRY)}, 0)", "c", _let("substr(n, length(c) + 1)", "q", f"concat(c, {rest})"))
    shape = "replace(m, '(0)', '(o)')"
    fill = lambda lead, number: _let(f"concat({lead}, {number})", "z", f"replace({_refill(shape, 'z')}, '(o)', '(0)')")
    abroad = fill("''", _let("d", "n", permuted))
    double = fill("'00'", _let("substr(d, 3)", "n", permuted))
    american = fill("if(length(d) = 11, '1', '')", _let("concat('1', right(d, 10))", "n", f"substr({permuted}, 2)"))
    home = fill("if(d like '0%', '0', '')", walk("if(d like '0%', substr(d, 2), d)", step, led, 60))
    return _let(_BARE, "d", f"case when startswith(m, '+') then {abroad} when startswith(m, '00') then {double} when m rlike {_q(_AMERICAN)} then {american} else {home} end")


def _valid(kind: str) -> str:
    digits = "regexp_replace(m, '[^0-9]', '')"
    return {
        "email": "true",
        "secret": "m rlike '[0-9]' and m rlike '[a-fA-F]'",
        "date": _let(_PARTS, "p", f"if(length(p[0]) = 4, {_IS['ymd']}, {_IS['dmy']} or {_IS['mdy']})"),
        "ip": f"forall({_OCTETS}, o -> o <= 255)",
        "phone": f"length({_BARE}) - if(m like '00%', 2, 0) between 9 and 15",
        "ssn": SSN_OK.replace("{x}", digits),
        "card": _let(digits, "q", f"{luhn_sum('q', False)} % 10 = 0 and q rlike '[1-9]'"),
    }[kind]


def _pseudonym(kind: str, key: str) -> str:
    digits = "regexp_replace(m, '[^0-9]', '')"
    if kind == "email":
        return f"concat('u', substr(sha2(concat({_q(key + '|email|')}, lower(m)), 256), 1, 20), '@pseudonym.invalid')"
    if kind == "secret":
        return _let("lower(m)", "q", feistel("q", 16, key, kind))
    if kind == "date":
        step = feistel("lpad({x}, 5, '0')", 10, key, kind)
        order = f"case when length(p[0]) = 4 then 'ymd' when contains(m, '/') then if({_IS['mdy']}, 'mdy', 'dmy') else if({_IS['dmy']}, 'dmy', 'mdy') end"
        swapped = "(o = if(contains(m, '/'), 'dmy', 'mdy'))"  # moves among days past the 12th, which only this order reads
        old = f"case o when 'ymd' then {_AS['ymd']} when 'dmy' then {_AS['dmy']} else {_AS['mdy']} end"
        start = f"lpad(cast(datediff(cast({old} as date), {DAY0}) as string), 5, '0')"
        moved = f"date_add({DAY0}, cast({walk(start, step, f'(cast({{x}} as int) < {DAYS} and (not {swapped} or day(date_add({DAY0}, cast({{x}} as int))) > 12))', 60)} as int))"
        wide = "if(forall(p, x -> length(x) > 1), 2, 1)"  # days and months get a leading 0 if the old ones have two digits
        part = {"y": "cast(year(t) as string)", "m": f"lpad(cast(month(t) as string), greatest({wide}, length(cast(month(t) as string))), '0')", "d": f"lpad(cast(day(t) as string), greatest({wide}, length(cast(day(t) as string))), '0')"}
        shown = "case o " + " ".join(f"when '{o}' then concat_ws(regexp_extract(m, '[./-]', 0), {', '.join(part[c] for c in o)})" for o in _AS) + " end"
        return _let(_PARTS, "p", _let(order, "o", _let(moved, "t", shown)))
    if kind == "ip":
        number = f"array_join(transform({_OCTETS}, o -> lpad(lower(hex(o)), 2, '0')), '')"
        return _let(feistel(number, 16, key, kind), "z", "array_join(transform(array(1, 3, 5, 7), i -> conv(substr(z, i, 2), 16, 10)), '.')")
    if kind == "phone":
        return _phone(key)
    if kind == "ssn":
        return _let(walk(digits, feistel("{x}", 10, key, kind), SSN_OK, 60), "z", _refill("m", "z"))
    body = _let(f"substr({digits}, 1, length({digits}) - 1)", "q", feistel("q", 10, key, kind))
    return _let(body, "b", _let(f"concat(b, cast((10 - {luhn_sum('b', True)} % 10) % 10 as string))", "z", _refill("m", "z")))


def _kind() -> str:
    """The kind of a match m, or null where it isn't valid."""
    shape = {"email": "contains(m, '@')", "phone": f"startswith(m, '+') or m rlike {_q('^(?:' + FORMS['phone'] + '|' + NATIONAL + ')$')}", "ip": "m rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$'", "date": "m rlike '^([0-9]{4}([./-][0-9]{1,2}){2}|([0-9]{1,2}[./-]){2}[0-9]{4})$'", "ssn": "m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'", "card": "m rlike '^[0-9]([ -]?[0-9]){12,18}$'", "secret": "m rlike '^[0-9a-fA-F]{32,64}$'"}
    return "case " + " ".join(f"when {shape[k]} then if({_valid(k)}, '{k}', null)" for k in ("email", "phone", "ip", "date", "ssn", "card", "secret")) + " end"


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """`docs` with the private values in `column` replaced, and `found`: an array of their kinds, in order.

    Kinds: email addresses, hexadecimal secrets, dates, IP addresses, phone numbers, social security numbers and
    payment cards; a form that fails its validation (Luhn's sum, a date that doesn't exist, an octet over 255)
    stays. `key` is the secret of the permutations. A null text stays null with nothing found; an empty or very
    long one is treated as any other; repeated rows are treated alike; other columns are carried as they are,
    whatever their names (where one is named found, the new one is found_1, or the first free number); an empty
    table gives no rows.
    """
    names = docs.columns
    new_name = next(n for n in ["found", *[f"found_{i}" for i in range(1, len(names) + 2)]] if n not in names)
    pattern = _q(PATTERN)
    plain = docs.toDF(*["text" if n == column else f"c{i}" for i, n in enumerate(names)])
    hits = f"transform(regexp_extract_all(text, {pattern}, 0), m -> named_struct('m', m, 'k', {_kind()}))"
    out = plain.withColumn("hits", F.expr(f"if(text rlike '[0-9@]', {hits}, null)"))  # every form has one of these
    new = "case h.k " + " ".join(f"when '{k}' then {_let('h.m', 'm', _pseudonym(k, key))}" for k in FORMS) + " else h.m end"
    real = "exists(hits, h -> h.k is not null)"
    text = F.expr(f"if({real}, {_rebuilt('text', pattern, new)}, text)")
    found = F.expr("transform(filter(coalesce(hits, array()), h -> h.k is not null), h -> h.k)")
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in plain.columns], found.alias("found")).toDF(*names, new_name)


def _rebuilt(text: str, pattern: str, new: str) -> str:
    """SQL for the text with each hit's successor in its place: pieces and successors in turn."""
    after = f"concat(transform(hits, h -> {new}), array(''))"
    return f"array_join(transform(arrays_zip(split({text}, {pattern}, -1), {after}), z -> concat(z['0'], z['1'])), '')"


def count_kinds(found: Column) -> list[Column]:
    """A count for each kind, named n_<kind>."""
    return [F.size(F.array_remove(F.transform(found, _same(kind)), "")).cast("long").alias(f"n_{kind}") for kind in FORMS]


def _same(kind: str):
    return lambda k: F.when(k == kind, k).otherwise("")
