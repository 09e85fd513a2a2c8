"""PII surrogates on DataFrame functions alone.

E-mail addresses, phone, card and identity numbers, IPv4 addresses and names after a title are replaced by keyed
surrogates of the same type and format: letters become letters of the same case, digits digits; country codes, top-level
domains, an issuer's digit, the validity of check digits and octet lengths stay; names keep gender, script and capitals.
A surrogate depends only on the key, the type and the entity itself (its digits, its lower-case form), so mentions of one
entity agree across documents and formats, a surname alone agrees with the full name, and addresses of one domain share
the new domain.

Numbers, addresses and domains are permuted: a keyed Feistel network over the digits, letters or octets that may change,
run forward, shifted by one step and run backward again. That is one-to-one within a format, so two entities never share
a surrogate, however crowded the format is, and no entity is its own surrogate; nothing has to be looked up. (A surrogate
may equal another real entity of the same format; in a crowded format it must.) Names are drawn from lists, and here
distinctness is checked over all names at once: they are merged first (partial aggregation), and where two surrogates
coincide, or one equals a real name, the later one is drawn again, longer each time, until none do. Only texts that hold
such a name are joined to them; all others are rewritten in one pass without a shuffle.

Defined results: null text stays null with no entities, empty text stays empty. Repeated rows get the same text; extra
columns stay (but the number of entities takes the place of a column of its name), an empty table gives an empty result.
An address without a letter or digit before the @ keeps that part. The key is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import met, private, table, with_results, written

#: Titles by gender.
MALE = "Mr|Herrn|Herr|Monsieur|Señor|Don|Sir|г-н|κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Doña|Lady|г-жа|κυρία"
NEUTRAL = "Dr|Prof|Mx"

_TITLES = f"{MALE}|{FEMALE}|{NEUTRAL}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9\-])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"
CARD = r"(?<![0-9+])(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"
IDENTITY = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[\-.][0-9]{4}|[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4})(?![0-9])"
NAME = rf"\p{{Lu}}(?<=(?:^|[^\p{{L}}\-])(?:{_TITLES})\.?\s\p{{Lu}})[\p{{L}}'’\-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'’\-]{{1,40}}){{0,2}}"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD.replace(r"\1", r"\k<sep>").replace(r"([ \-])", r"(?<sep>[ \-])"), "identity": IDENTITY, "phone": PHONE, "name": NAME}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())

#: Given names by script and gender, and syllables of surnames by script.
GIVEN = {
    "latin": {"m": "Adam Boris Carl David Emil Frank Georg Henry Ivan Jonas Karl Louis Martin Nils Oscar Paul Robert Samuel Thomas Victor".split(), "f": "Alice Berta Clara Diana Emma Flora Greta Helen Irene Julia Karen Laura Maria Nadia Olivia Paula Rosa Sarah Teresa Vera".split(), "n": "Alex Charlie Dana Eli Frankie Jamie Jordan Kim Lee Morgan Noel Quinn Robin Sasha Taylor".split()},
    "cyrillic": {"m": "Андрей Борис Виктор Григорий Денис Егор Иван Кирилл Максим Николай Олег Павел".split(), "f": "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Мария Нина Ольга Полина".split(), "n": "Саша Женя Валя Шура Слава".split()},
    "greek": {"m": "Αλέξανδρος Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος Σπύρος".split(), "f": "Άννα Ειρήνη Ελένη Ζωή Κατερίνα Μαρία Σοφία Χαρά".split(), "n": "Άγγελος Χρύσα Φώτης".split()},
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha he ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve vi wa we".split(),
    "cyrillic": "ба бе би бо ва ве ви да де ди до за зе ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се та те ти то".split(),
    "greek": "βα βε βι γα γε δα δε δι ζα ζε θα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε σα σε τα τε".split(),
}

_DIGITS = "[^0-9]"
#: Country calling codes; all that are not of one or two digits have three.
COUNTRY = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Key of the query on the synthetic tables; a session sets its own as spark.siltstone.pii.key.
SAMPLE_KEY = "key of the synthetic tables"
ROUNDS = 4


def _number(stream: Column, i: Column) -> Column:
    """A number below 65536 from place ``i`` of a stream of 128 hex digits."""
    return F.conv(F.substring(stream, F.pmod(i * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 512)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _bound(x: Column, f) -> Column:
    """f of a column that is made once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def permuted(values: Column, sizes: Column, secret: Column) -> Column:
    """A keyed one-to-one map, without fixed points, of lists of numbers below ``sizes``; those of size 1 stay.

    Each round adds to one half, place by place, what a digest of the other half says. After ROUNDS rounds the first
    place that can change is shifted, and the rounds are undone.
    """
    half = F.ceil(F.size(values) / 2).cast("int")

    def step(now, r):
        k = F.when(r <= ROUNDS, r).otherwise(2 * ROUNDS + 2 - r)
        sign = F.when(r <= ROUNDS, 1).otherwise(-1)
        left = k % 2 == 1
        other = F.when(left, F.slice(now, half + 1, F.size(now))).otherwise(F.slice(now, F.lit(1), half))
        stream = F.sha2(F.concat_ws("\x1f", secret, k.cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)
        added = _bound(stream, lambda s: F.transform(now, lambda v, i: F.when((i < half) == left, F.pmod(v + sign * _number(s, i), F.element_at(sizes, i + 1))).otherwise(v)))
        first = F.array_position(F.transform(sizes, lambda n: n > 1), True)
        shifted = F.transform(now, lambda v, i: F.when(i + 1 == first, F.pmod(v + 1, F.element_at(sizes, i + 1))).otherwise(v))
        return F.when(r == ROUNDS + 1, shifted).otherwise(added)

    return F.when(F.size(values) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(2 * ROUNDS + 1)), values.cast("array<int>"), step)).otherwise(values.cast("array<int>"))


def _permuted_text(text: Column, secret: Column) -> Column:
    """A lower-case text with its ASCII letters and digits permuted."""
    chars = _chars(text)
    sizes = F.transform(chars, lambda c: F.when(c.rlike("[a-z]"), 26).when(c.rlike("[0-9]"), 10).otherwise(1))
    values = F.transform(chars, lambda c: F.when(c.rlike("[a-z]"), F.ascii(c) - 97).when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(0))
    new = permuted(values, sizes, secret)
    shown = lambda v, c: F.when(c.rlike("[a-z]"), F.char(v + 97)).when(c.rlike("[0-9]"), v.cast("string")).otherwise(c)
    return F.array_join(F.zip_with(new, chars, shown), "")


def _permuted_digits(digits: Column, secret: Column, leading: bool = False) -> Column:
    """Digits permuted; with ``leading`` a first digit of 2 to 9 stays one, as does one below."""
    chars = F.transform(_chars(digits), lambda c: c.cast("int"))
    low = lambda v, i: F.when((i == 0) & (v > 1) & F.lit(leading), 2).otherwise(0)
    sizes = F.transform(chars, lambda v, i: F.when((i == 0) & F.lit(leading), F.when(v > 1, 8).otherwise(2)).otherwise(10))
    new = permuted(F.transform(chars, lambda v, i: v - low(v, i)), sizes, secret)
    return F.array_join(F.zip_with(new, F.transform(chars, low), lambda v, n: (v + n).cast("string")), "")


def _filled(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced by ``digits``, in order."""

    def one(c, i):
        place = F.length(F.regexp_replace(F.substring(text, F.lit(1), i), _DIGITS, F.lit("")))
        return F.when(c.rlike("[0-9]"), F.substring(digits, place + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _cased(text: Column, model: Column) -> Column:
    """``text`` with the capitals of ``model``, which is as long."""
    return F.array_join(F.zip_with(_chars(text), _chars(model), lambda c, m: F.when(m.rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")


def _secret(key: str, *parts) -> Column:
    return F.concat_ws("\x1f", F.lit(key), *parts)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    backwards = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(backwards, F.lit(0), lambda a, x: a + x) % 10


def _check_digit(digits: Column) -> Column:
    """The digit that makes all but the last of ``digits`` valid with it."""
    return F.pmod(10 - _luhn(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))), F.lit(10))


def _card(digits: Column, key: str) -> Column:
    """The issuer's digit and the distance from the valid check digit stay."""
    off = F.pmod(F.right(digits, F.lit(1)).cast("int") - _check_digit(digits), F.lit(10))
    middle = _permuted_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), _secret(key, F.lit("card")))
    new = F.concat(F.left(digits, F.lit(1)), middle)
    return _bound(new, lambda n: F.concat(n, F.pmod(_check_digit(F.concat(n, F.lit("0"))) + off, F.lit(10)).cast("string")))


def _phone(digits: Column, plus: Column, key: str) -> Column:
    """A country code, told by the fixed table and so alike in all formats, stays."""
    code = F.when(plus, F.regexp_extract(digits, f"^(?:{COUNTRY})", 0)).otherwise(F.lit(""))
    return F.concat(code, _permuted_digits(F.substring(digits, F.length(code) + 1, F.length(digits)), _secret(key, F.lit("phone"), plus.cast("string"), code), leading=True))


def _ip(text: Column, key: str) -> Column:
    octets = F.split(text, "\\.")
    low = F.transform(octets, lambda o: F.when(F.length(o) == 1, 0).when(F.length(o) == 2, 10).otherwise(100))
    sizes = F.transform(octets, lambda o: F.when(F.length(o) == 1, 10).when(F.length(o) == 2, 90).otherwise(156))
    new = permuted(F.zip_with(octets, low, lambda o, n: o.cast("int") - n), sizes, _secret(key, F.lit("ip")))
    return F.array_join(F.zip_with(new, low, lambda v, n: (v + n).cast("string")), ".")


def _email(text: Column, key: str) -> Column:
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    top = F.substring_index(domain, ".", -1)
    middle = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    new_local = _permuted_text(F.lower(local), _secret(key, F.lit("email"), F.lower(domain)))
    new_middle = _permuted_text(F.lower(middle), _secret(key, F.lit("domain"), F.lower(top)))
    return F.concat(_cased(new_local, local), F.lit("@"), _cased(new_middle, middle), F.lit("."), top)


def _of_script(word: Column, pick) -> Column:
    return F.when(word.rlike("\\p{IsCyrillic}"), pick("cyrillic")).when(word.rlike("\\p{IsGreek}"), pick("greek")).otherwise(pick("latin"))


def _named(word: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    def listed(words, i):
        return F.element_at(F.array(*map(F.lit, words)), F.pmod(_number(stream, F.lit(i)), F.lit(len(words))) + 1)

    def surname(script):
        parts = F.transform(F.sequence(F.lit(0), F.lit(3) + attempt), lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), F.pmod(_number(stream, i + 1), F.lit(len(SYLLABLES[script]))) + 1))
        return F.initcap(F.array_join(parts, ""))

    def given(script):
        base = F.when(kind == "given_m", listed(GIVEN[script]["m"], 0)).when(kind == "given_f", listed(GIVEN[script]["f"], 0)).otherwise(listed(GIVEN[script]["n"], 0))
        return F.when(attempt > 0, F.concat(base, F.lit("-"), surname(script))).otherwise(base)

    drawn = F.when(kind == "surname", _of_script(word, surname)).otherwise(_of_script(word, given))
    return F.when((F.length(word) > 1) & (F.upper(word) == word), F.upper(drawn)).otherwise(drawn)


def canonical(kind: Column, word: Column) -> Column:
    """What an entity is, whatever its format."""
    number = F.concat(F.when(word.startswith("+"), F.lit("+")).otherwise(F.lit("")), F.regexp_replace(word, _DIGITS, F.lit("")))
    return F.when(kind.isin("phone", "card", "identity"), number).otherwise(F.lower(word))


def surrogate(kind: Column, word: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity in the format of ``word``; only names look at ``attempt``."""
    digits = F.regexp_replace(canon, _DIGITS, F.lit(""))
    by_kind = {
        "email": _email(word, key),
        "ip": _ip(word, key),
        "card": _filled(word, _card(digits, key)),
        "phone": _filled(word, _phone(digits, canon.startswith("+"), key)),
        "identity": _filled(word, _permuted_digits(digits, _secret(key, F.lit("identity")))),
    }
    out = _named(word, kind, _stream(key, kind, canon, attempt), attempt)
    for name, column in by_kind.items():
        out = F.when(kind == name, column).otherwise(out)
    return out


_FOUND = "array<struct<value: string, parts: array<struct<kind: string, word: string, canon: string>>>>"


def detect(text: Column) -> Column:
    """Array of the entities found, in order: value, and its parts (one, or a name's words) with kind and canonical form."""
    values = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    between = F.transform(F.split(text, ENTITY, -1), lambda p: F.right(p, F.lit(16)))
    found = F.zip_with(values, F.slice(between, 1, F.size(between) - 1), lambda v, b: F.struct(v.alias("v"), b.alias("b")))

    def parts(x):
        v, b = x["v"], x["b"]
        kind = F.lit("phone")
        for name in ("identity", "card", "ip", "email"):
            kind = F.when(v.rlike(f"^(?:{KINDS[name]})$"), F.lit(name)).otherwise(kind)
        gender = F.when(b.rlike(f"({MALE})\\.?\\s$"), F.lit("given_m")).when(b.rlike(f"({FEMALE})\\.?\\s$"), F.lit("given_f")).otherwise(F.lit("given_n"))
        words = F.split(v, " ")
        of_name = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(gender).alias("kind"), w.alias("word"), F.lower(w).alias("canon")))
        whole = F.array(F.struct(kind.alias("kind"), v.alias("word"), canonical(kind, v).alias("canon")))
        return F.struct(v.alias("value"), F.when(v.rlike("^\\p{L}") & ~v.contains("@"), of_name).otherwise(whole).alias("parts"))

    return F.when(text.rlike(ENTITY), F.transform(found, parts)).otherwise(F.expr(f"cast(array() as {_FOUND})"))


_NAMES = ("given_m", "given_f", "given_n", "surname")


def exceptions(docs: DataFrame, key: str, text: str = "text", most_rounds: int = 20) -> DataFrame:
    """(kind, canon, attempt) of the names whose first surrogate coincides with another's or with a real name.

    Each attempt adds a syllable, so there is room for any number of names after a few of them.
    """
    e = docs.filter(F.col(text).rlike(NAME)).select(F.explode(detect(F.col(text))).alias("f")).select(F.explode("f.parts").alias("p"))
    real = written(e.filter(F.col("p.kind").isin(*_NAMES)).select("p.kind", "p.canon").distinct(), "names")
    now = real.withColumn("attempt", F.lit(0))
    for _ in range(most_rounds):
        drawn = F.lower(_named(F.col("canon"), F.col("kind"), _stream(key, F.col("kind"), F.col("canon"), F.col("attempt")), F.col("attempt")))
        now = written(now.select("kind", "canon", "attempt").withColumn("drawn", drawn), "surrogates")
        groups = now.groupBy("kind", "drawn").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canon")).alias("first"))
        twice = groups.filter(F.col("n") > 1).select("kind", "drawn", "first")
        lost = now.join(twice, ["kind", "drawn"]).filter(F.struct("attempt", "canon") != F.col("first")).select("kind", "canon")
        taken = now.join(real.select("kind", F.col("canon").alias("drawn")), ["kind", "drawn"]).select("kind", "canon")
        again = written(lost.union(taken).distinct(), "again")
        if again.isEmpty():
            return now.filter(F.col("attempt") > 0).select("kind", "canon", "attempt")
        now = now.join(again.withColumn("more", F.lit(1)), ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0)))
    raise RuntimeError("names still coincide after all rounds")


def replace(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``, and the number of entities replaced."""
    if not key:
        raise ValueError("a key is required")
    names, special = docs.columns, exceptions(docs, key, text)
    own, digest_, attempts = private(docs, "found", "digest", "attempts")

    def rewritten(df: DataFrame, attempt) -> DataFrame:
        def of(x):
            return F.array_join(F.transform(x["parts"], lambda p: surrogate(p["kind"], p["word"], p["canon"], attempt(p), key)), " ")

        found = df.withColumn(own, detect(F.col(text)))
        pieces = F.split(F.col(text), ENTITY, -1)
        whole = F.array_join(F.zip_with(pieces, F.transform(own, of), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        out = found.withColumn(text, F.when(F.size(own) > 0, whole).otherwise(F.col(text)))
        return out.select(with_results(out, names, {count: F.size(own)} if count else {}))

    if special.isEmpty():
        return rewritten(docs, lambda p: F.lit(0))
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    held = docs.filter(F.col(text).rlike(NAME)).select(digest.alias("d"), F.explode(detect(F.col(text))).alias("f")).select("d", F.explode("f.parts").alias("p"))
    held = held.select("d", "p.kind", "p.canon").distinct().join(special, ["kind", "canon"])
    held = held.groupBy(F.col("d").alias(digest_)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "canon"), "attempt"))).alias(attempts))  # at most a text's names
    joined = met(docs, digest, written(held, "held"), digest_)
    return rewritten(joined, lambda p: F.coalesce(F.try_element_at(F.col(attempts), F.concat_ws("\x1f", p["kind"], p["canon"])), F.lit(0)))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, by the key of the session (spark.siltstone.pii.key)."""
    key = spark.conf.get("spark.siltstone.pii.key", None) or SAMPLE_KEY
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
