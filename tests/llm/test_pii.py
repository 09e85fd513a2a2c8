import hashlib
import re

import pytest

from siltstone.llm import pii

KEY = "k"


def swap(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace(df, key).orderBy("doc_id").collect()]


def brute_permuted(values, sizes, *secret):
    """The Feistel network in plain Python."""
    now, half = list(values), -(-len(values) // 2)

    def turn(k, sign):
        left = k % 2 == 1
        other = now[half:] if left else now[:half]
        stream = hashlib.sha512("\x1f".join([*secret, str(k), ",".join(map(str, other))]).encode()).hexdigest()
        for i in range(len(now)):
            if (i < half) == left:
                now[i] = (now[i] + sign * int(stream[(i * 4) % 124 :][:4], 16)) % sizes[i]

    for k in (1, 2, 3, 4):
        turn(k, 1)
    first = next((i for i, n in enumerate(sizes) if n > 1), None)
    if first is not None:
        now[first] = (now[first] + 1) % sizes[first]
    for k in (4, 3, 2, 1):
        turn(k, -1)
    return now


def brute_digits(digits, *secret, leading=False):
    values = [int(c) for c in digits]
    low = [2 if leading and not i and v > 1 else 0 for i, v in enumerate(values)]
    sizes = [(8 if v > 1 else 2) if leading and not i else 10 for i, v in enumerate(values)]
    return "".join(str(v + n) for v, n in zip(brute_permuted([v - n for v, n in zip(values, low, strict=True)], sizes, *secret), low, strict=True))


def brute_text(text, *secret):
    kinds = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in text]
    values = [ord(c) - 97 if n == 26 else ord(c) - 48 if n == 10 else 0 for c, n in zip(text, kinds, strict=True)]
    return "".join(chr(v + 97) if n == 26 else str(v) if n == 10 else c for v, n, c in zip(brute_permuted(values, kinds, *secret), kinds, text, strict=True))


def luhn(digits):
    return sum(int(x) if i % 2 == 0 else sum(divmod(int(x) * 2, 10)) for i, x in enumerate(reversed(digits))) % 10


def brute(kind, value):
    if kind == "email":
        local, domain = value.split("@")
        middle, top = domain.rsplit(".", 1)
        return f"{brute_text(local, KEY, 'email', domain)}@{brute_text(middle, KEY, 'domain', top)}.{top}"
    if kind == "ip":
        octets = value.split(".")
        low, sizes = [[0, 10, 100][len(o) - 1] for o in octets], [[10, 90, 156][len(o) - 1] for o in octets]
        return ".".join(str(v + n) for v, n in zip(brute_permuted([int(o) - n for o, n in zip(octets, low, strict=True)], sizes, KEY, "ip"), low, strict=True))
    digits = re.sub("[^0-9]", "", value)
    if kind == "identity":
        new = brute_digits(digits, KEY, "identity")
    elif kind == "card":
        check = lambda d: (10 - luhn(d[:-1] + "0")) % 10
        new = digits[0] + brute_digits(digits[1:-1], KEY, "card")
        new += str((check(new + "0") + int(digits[-1]) - check(digits)) % 10)
    else:
        plus = value.startswith("+")
        code = re.match(pii.COUNTRY, digits)[0] if plus else ""
        new = code + brute_digits(digits[len(code) :], KEY, "phone", str(plus).lower(), code, leading=True)
    out = iter(new)
    return "".join(next(out) if c.isdigit() else c for c in value)


VALUES = [
    ("email", "jo.doe42@mail3.example.com"), ("email", "x@a.org"), ("ip", "8.196.19.208"), ("ip", "1.2.3.4"), ("identity", "123-45-6789"),
    ("card", "4111 1111 1111 1111"), ("card", "4041894974608795"), ("phone", "+1 (743) 555-3824"), ("phone", "+17435553824"), ("phone", "(743) 555-3824"), ("phone", "+49 30 1234 5678"), ("phone", "+354 12 34 56 78"), ("phone", "743-555-3824"),
]


def test_every_kind_against_brute_force(spark):
    got = swap(spark, [f"see {v} now" for _, v in VALUES])
    assert got == [f"see {brute(k, v)} now" for k, v in VALUES]
    assert all(brute(k, v) != v for k, v in VALUES)


def test_phones_agree_across_formats(spark):
    a, b, c = swap(spark, ["+1 (743) 555-3824", "+17435553824", "+1 743 555 38 24"])
    assert len({re.sub("[^0-9+]", "", x) for x in (a, b, c)}) == 1 and a.startswith("+1 (")


def test_crowded_formats_are_permuted(spark):
    ips = [f"{a}.{b}.{c}.{d}" for a in range(10) for b in range(10) for c in range(10) for d in range(6)]
    out = swap(spark, [" ".join(ips)])[0].split(" ")
    assert len(set(out)) == len(ips) == 6000 and all(a != b and [*map(len, a.split("."))] == [1] * 4 for a, b in zip(out, ips, strict=True))
    mails = [f"{c}@{d}.com" for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz"]
    out = swap(spark, mails)
    assert sorted(out) == sorted(mails) and len({x.split("@")[1] for x in out}) == 26
    assert all(len({x.split("@")[1] for x, m in zip(out, mails, strict=True) if m.endswith(f"@{d}.com")}) == 1 for d in "abc")


def test_clashing_columns_and_a_missing_key(spark):
    df = spark.createDataFrame([("a@b.de and Mr John Smith", 1, 2, 3, 4), ("Mr Jane Smith", 1, 2, 3, 4)], "text string, n_entities int, _found int, _digest int, _attempts int")
    rows = pii.replace(df, KEY)
    assert rows.columns == ["text", "_found", "_digest", "_attempts", "n_entities"]
    assert sorted((r._found, r._digest, r._attempts, r.n_entities) for r in rows.collect()) == [(2, 3, 4, 1), (2, 3, 4, 2)]
    with pytest.raises(ValueError):
        pii.replace(df, "")


def test_formats_and_coreference(spark):
    a, b, c, d, e = swap(spark, ["Jo.Doe42@mail3.example.com wrote", "x jo.doe42@MAIL3.example.com", "ann@mail3.example.com", "8.196.19.208 and 4111 1111 1111 1111 or 4111111111111111", "see 1.2.3.4.5, v1.2.3 and 12345678901234567890"])
    assert re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d\d@[a-z]{4}\d\.[a-z]{7}\.com wrote", a) and a.split()[0].lower() == b.split()[1].lower()
    assert c.split("@")[1] == a.split()[0].split("@")[1]
    ip, _, *card, _, plain = d.split(" ")
    assert [len(x) for x in ip.split(".")] == [1, 3, 2, 3] and all(int(x) < 256 for x in ip.split("."))
    assert "".join(card) == plain and plain[0] == "4" and plain != "4" + "1" * 15
    assert sum(int(x) if i % 2 == 0 else sum(divmod(int(x) * 2, 10)) for i, x in enumerate(reversed(plain))) % 10 == 0
    assert e == "see 1.2.3.4.5, v1.2.3 and 12345678901234567890"


def test_names_keep_gender_and_script(spark):
    a, b, c, d = swap(spark, ["Mr. John Smith met Mrs Anna Smith", "Frau Smith kam", "г-жа Анна Иванова", "Mr SMITH left"])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+)", a)
    assert m[1] in pii.GIVEN["latin"]["m"] and m[3] in pii.GIVEN["latin"]["f"] and m[2] == m[4] != "Smith"
    assert b == f"Frau {m[2]} kam" and d == f"Mr {m[2].upper()} left"
    assert re.fullmatch(r"г-жа [А-яё]+ [А-яё]+", c) and c.split()[1] in pii.GIVEN["cyrillic"]["f"]


def test_distinct_even_in_a_crowded_space(spark):
    texts = [f"{i}.{j}.1.2" for i in range(10) for j in range(10)] + [f"Mr {chr(65 + i)}{'abcdefghij'[j]} Smith" for i in range(26) for j in range(10)]
    out = swap(spark, texts * 2)
    assert out[: len(texts)] == out[len(texts) :] and len(set(out)) == len(texts)
    assert all(a != b for a, b in zip(out, texts, strict=False)) and not set(out[100 : len(texts)]) & set(texts)  # no name is a real one; numbers are permuted


def test_planted_entities(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    was, now = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in pii.op7_pii(spark, sf).collect()}
    planted = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<!\d)\d{16}(?!\d)")
    for d, text in was.items():
        old, new = planted.findall(text), now[d].text
        assert not set(old) & set(planted.findall(new)) and now[d].n_entities == len(old)
        assert planted.sub("#", new) == planted.sub("#", re.sub(r"@mail\d\.example\.com", "@mail1.example.com", text)) if not old else len(new) == len(text)
    assert sum(r.n_entities for r in now.values()) > 10


def test_plan_is_native(spark, sf):
    plan = pii.op7_pii(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


@pytest.mark.parametrize("text", [None, "", "@", "a@b", "x" * 200_000, "word " * 100_000 + "a.b@c.de"])
def test_odd_texts(spark, text):
    df = spark.createDataFrame([(1, text, 1, "x"), (1, text, 1, "x"), (None, text, 1, "x")], "doc_id long, text string, kind int, canon string")
    rows = pii.replace(df, KEY).collect()
    assert len(rows) == 3 and len({r.text for r in rows}) == 1
    assert rows[0].text == text or text.endswith("c.de") and rows[0].text[:500_000] == text[:500_000] != rows[0].text
    assert pii.replace(df.limit(0), KEY).count() == 0
