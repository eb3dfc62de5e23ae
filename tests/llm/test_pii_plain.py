"""op10 against a plain-Python version of the whole of it: forms, validation, permutations, refilled shapes."""

import datetime
import hashlib
import random
import re

import regex

from lodestone.llm import pii
from lodestone.llm.queries_pii import KEY, op10_pii_pseudonyms



def in_python(pattern):
    """The pattern with its digits and word characters spelled out, which Python would read as Unicode's."""
    out, inside = "", False
    for part in re.findall(r"\\k<\w>|\\.|.", pattern):
        inside = part == "[" or inside and part != "]"
        plain = {r"\d": "0-9", r"\w": "0-9A-Za-z_"}.get(part)
        out += f"(?P={part[3]})" if part.startswith(r"\k") else part if plain is None else plain if inside else f"[{plain}]"
    return out


ANY = regex.compile(in_python(pii.PATTERN))
PHONE = regex.compile(in_python(f"^(?:{pii.FORMS['phone']}|{pii.NATIONAL})$"))
DAY0 = datetime.date(1900, 1, 1)


def feistel(digits, radix, key, tag):
    half = len(digits) // 2
    a, b = digits[:half], digits[half:]

    def shift(x, other, r):
        stream = hashlib.sha256(f"{key}|{tag}|{r}|{len(a)}|{len(b)}|{other}".encode()).digest()
        return "".join("0123456789abcdef"[(int(c, 16) + stream[i % 32]) % radix] for i, c in enumerate(x))

    for r in range(1, pii.ROUNDS + 1):
        a, b = (shift(a, b, r), b) if r % 2 else (a, shift(b, a, r))
    return a + b


def walk(x, step, valid):
    while True:
        x = step(x)
        if valid(x):
            return x


def luhn(s):
    return sum((2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(s)))


def refill(shape, digits):
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in shape)


ORDERS = {"ymd": (0, 1, 2), "dmy": (2, 1, 0), "mdy": (2, 0, 1)}


def as_date(p, order):
    try:
        return datetime.date(*(int(p[i]) for i in ORDERS[order]))
    except ValueError:
        return None


def kind_of(m):
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        return "email"
    if m.startswith("+") or PHONE.match(m):
        bare = re.sub("[^0-9]", "", m.replace("(0)", ""))
        return "phone" if 9 <= len(bare) - 2 * m.startswith("00") <= 15 else None
    if re.fullmatch(r"[0-9]{1,3}([.][0-9]{1,3}){3}", m):
        return "ip" if all(int(x) <= 255 for x in m.split(".")) else None
    if re.fullmatch(r"[0-9]{4}([./-][0-9]{1,2}){2}|([0-9]{1,2}[./-]){2}[0-9]{4}", m):
        p = re.split("[./-]", m)
        orders = ["ymd"] if len(p[0]) == 4 else ["dmy", "mdy"]
        return "date" if any(as_date(p, o) for o in orders) else None
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        return "ssn" if ssn_ok(digits) else None
    if re.fullmatch("[0-9]([ -]?[0-9]){12,18}", m):
        return "card" if luhn(digits) % 10 == 0 and digits.strip("0") else None
    if re.fullmatch("[0-9a-fA-F]{32,64}", m):
        return "secret" if re.search("[0-9]", m) and re.search("[a-fA-F]", m) else None
    return None


def ssn_ok(x):
    return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"


def new_date(m, key):
    p = re.split("[./-]", m)
    first, second = ("mdy", "dmy") if "/" in m else ("dmy", "mdy")
    order = "ymd" if len(p[0]) == 4 else first if as_date(p, first) else second
    late = order == second  # read so only because the day is past the 12th
    ok = lambda x: int(x) < pii.DAYS and (not late or (DAY0 + datetime.timedelta(int(x))).day > 12)
    t = DAY0 + datetime.timedelta(int(walk(f"{(as_date(p, order) - DAY0).days:05d}", lambda x: feistel(x, 10, key, "date"), ok)))
    wide = 2 if all(len(x) > 1 for x in p) else 1
    part = {"y": str(t.year), "m": f"{t.month:0{wide}d}", "d": f"{t.day:0{wide}d}"}
    return re.search("[./-]", m)[0].join(part[c] for c in order)


def new_phone(m, key):
    d = re.sub("[^0-9]", "", m.replace("(0)", ""))
    step, led = (lambda x: feistel(x, 10, key, "phone")), (lambda x: x[0] != "0")

    def abroad(n):
        c = re.match(pii.COUNTRY, n)[0]
        q = n[len(c) :]
        if c != "1" or len(q) != 10:
            return c + step(q)
        return c + ("0" + step(q[1:]) if q[0] == "0" else walk(q, step, led))

    if m.startswith("+"):
        z = abroad(d)
    elif m.startswith("00"):
        z = "00" + abroad(d[2:])
    elif re.fullmatch(r"(?:(?:1[ .\-])?[1-9][0-9]{2}([ .\-])[0-9]{3}\1[0-9]{4}|\([1-9][0-9]{2}\)[ .\-/]?[0-9]{3}[ .\-]?[0-9]{4})", m):
        z = ("1" if len(d) == 11 else "") + abroad("1" + d[-10:])[1:]
    else:
        z = ("0" if d[0] == "0" else "") + walk(d[1:] if d[0] == "0" else d, step, led)
    return refill(m.replace("(0)", "(o)"), z).replace("(o)", "(0)")


def pseudonym(kind, m, key):
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        return "u" + hashlib.sha256(f"{key}|email|{m.lower()}".encode()).hexdigest()[:20] + "@pseudonym.invalid"
    if kind == "secret":
        return feistel(m.lower(), 16, key, kind)
    if kind == "date":
        return new_date(m, key)
    if kind == "phone":
        return new_phone(m, key)
    if kind == "ip":
        z = feistel("".join(f"{int(x):02x}" for x in m.split(".")), 16, key, kind)
        return ".".join(str(int(z[i : i + 2], 16)) for i in (0, 2, 4, 6))
    if kind == "ssn":
        return refill(m, walk(digits, lambda x: feistel(x, 10, key, kind), ssn_ok))
    body = feistel(digits[:-1], 10, key, kind)
    return refill(m, body + next(c for c in "0123456789" if luhn(body + c) % 10 == 0))


def plain(text, key):
    """The text with its private values replaced, and their kinds."""
    found = []

    def new(match):
        kind = kind_of(match[0])
        if kind is None:
            return match[0]
        found.append(kind)
        return pseudonym(kind, match[0], key)

    return (None if text is None else ANY.sub(new, text)), found


def scraps(seed, n):
    """Texts of values, near values and what stands around them."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def value():
        body = rng.choice(["4", "5", "3"]) + d(rng.choice([11, 12, 13, 14, 15]))
        card = body + next(c for c in "0123456789" if luhn(body + c) % 10 == 0)
        day = f"{rng.randrange(1890, 2110)}-{rng.randrange(0, 14):02d}-{rng.randrange(0, 33):02d}"
        y, m, a = rng.randrange(1950, 2030), rng.randrange(1, 14), rng.randrange(1, 33)
        return rng.choice([
            card, f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}", d(16), day, f"{a}.{m}.{y}", f"{m:02d}/{a:02d}/{y}", f"{a}-{m}-{y}", f"{y}/{m}/{a}",
            f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"00{d(11)}", f"0{d(3)} {d(6)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+49 (0){d(2)} {d(7)}", f"0{d(9)}", f"06 {d(2)} {d(2)} {d(2)} {d(2)}",
            f"{d(3)}-{d(2)}-{d(4)}", f"{rng.randrange(300)}.{rng.randrange(300)}.{rng.randrange(300)}.{rng.randrange(300)}", hashlib.sha256(d(5).encode()).hexdigest()[: rng.choice([31, 32, 40, 64])],
            f"a.b{d(1)}@Mail{d(2)}.example.com", f"é{d(1)}@x.org", d(5), "x@y", "1.2.3", f"{d(2)},{d(3)},{d(3)}",
        ])

    return [rng.choice(["", "tel ", "(", "v", "№"]) + rng.choice([" ", ", ", "; ", "\n", ". ", ")"]).join(value() for _ in range(rng.randrange(1, 7))) for _ in range(n)]


def test_scraps_equal_plain_python(spark):
    rows = list(enumerate([*scraps(1, 1500), None, "", "no digits", "é" * 5000 + "+1 (551) 555-0826"]))
    got = {r["doc_id"]: (r["text"], r["found"]) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    for i, t in rows:
        assert got[i] == plain(t, "key"), t
    assert {k for _, f in got.values() for k in f} == set(pii.FORMS)


def test_the_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: plain(r["text"], KEY) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in op10_pii_pseudonyms(spark, sf).collect():
        text, found = want[r["doc_id"]]
        assert r["text"] == text and r["n_private"] == len(found)
        assert {k: r[f"n_{k}"] for k in pii.FORMS} == {k: found.count(k) for k in pii.FORMS}
