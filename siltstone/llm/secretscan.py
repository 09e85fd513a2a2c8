"""Secret scans on DataFrame functions alone: one regular expression proposes, a random forest disposes.

The expression finds key-like strings. Each finding gets features: length, transitions between kinds of characters,
entropy, share covered by dictionary words, kind of path and the words around it. A random forest, trained by
pyspark.ml from labelled findings, is then written out as one SQL expression over those features, so that documents
are scanned, judged and redacted in a single pass: nothing is shuffled, joined or sent to Python, and a lost executor
costs only its tasks.

Labelled findings may come from any table (value, before, after, path, label). The default set is made from a rule:
keys of known issuers, assigned random strings, passwords, signed tokens and key blocks against digests, card numbers,
identifiers, addresses, plain words and placeholders in their usual surroundings.

Defined results: null text gives no findings and stays null; empty text stays empty. A null path counts as unknown.
Repeated rows are each scanned, extra columns stay (but the findings take the place of a column of their name), an empty
table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import private, table, with_results, written

_NAMES = r"pass(?:word|wd|phrase|code)|pwd|secret|token|credential|(?:api|access|auth|private|secret|client)[_\-]?(?:key|secret|token)"
#: Proposes candidates: key blocks; signed tokens of three parts; passwords in addresses; runs of 14 and more key characters
#: with a digit among them; anything else that is assigned to a name of secrets. All lookarounds are bounded.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
    r"|eyJ(?<![A-Za-z0-9_\-]eyJ)[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+"
    r"|(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/:@]{3,128}(?=@)"
    r"|(?<![\p{L}\p{N}+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{14,}={0,2}(?![\p{L}\p{N}])"
    rf"|(?<=[=:\s\"'])(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{_NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)[^\s\"'<>,;=:]{{5,127}}[^\s\"'<>,;.!?)\]]"
)

#: Words that tell a finding's neighbourhood, and words that keys seldom contain.
ASSIGNING = "password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential"
HARMLESS = "checksum|sha1|sha256|md5|hash|digest|integrity|commit|revision|version|uuid|guid|isbn|order|card|account|phone|invoice|ticket|serial|build|etag|url|http|path"
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|your|insert|redacted|xxxx|test|fake|todo|none|null|default"
DICTIONARY = (
    "access|account|action|address|agent|alpha|android|apple|april|archive|article|august|author|backup|banner|batch|beta|blog|book|browser|build|button|cache|calendar|camera|card|center|change|client|cloud|code|color|commit|common|config|content|control|copy|count|create|cross|custom|data|date|debug|default|deploy|design|detail|device|digest|domain|download|draft|edit|email|error|event|example|export|field|file|filter|final|first|folder|footer|form|format|frame|full|gallery|global|group|guide|hash|header|height|home|host|html|http|icon|image|import|index|info|input|issue|item|json|key|label|large|last|layout|left|level|library|license|light|line|link|list|local|lock|login|logo|main|manager|map|march|master|media|menu|message|method|mobile|model|module|month|name|network|news|note|number|object|offset|online|option|order|output|owner|package|page|panel|parent|park|part|password|patch|path|photo|plugin|point|policy|port|post|preview|price|print|product|profile|project|public|query|release|report|request|result|review|right|root|route|sample|script|search|secret|section|select|server|service|session|sheet|site|size|small|source|stable|start|state|static|status|step|storage|store|style|summary|support|system|table|target|task|team|template|test|text|theme|thumb|time|title|token|tool|total|track|type|update|upload|user|value|version|video|view|volume|week|widget|width|window|word|world|year"
)

#: A value that only refers to a secret kept elsewhere: a variable, a lookup, a call, a template.
REFERENCE = (
    r"^\$\{?[A-Za-z_][A-Za-z_.]*\}?$|^\$[({]|^%[A-Za-z_]+%?$|^\{\{|^<|^\$\w+->|^[A-Za-z_][A-Za-z_.]*[\[(]"
    r"|^(?:os|sys|env|process|config|conf|settings|secrets|vault|params|args|self|this|props|app|var|data|local|module)\.[A-Za-z_]"
)
#: The same for words, of any language, types and names: nothing but letters with signs between them.
WORDLIKE = r"^\p{L}+(?:['’\-]\p{L}+)*$"
#: Marks around findings; a text that holds one of them already is searched twice instead.
OPEN, CLOSE = "\ue000", "\ue001"

FEATURES = ("length", "transitions", "entropy", "distinct", "digits", "uppers", "symbols", "hexlike", "known", "covered", "placeholder", "assigned", "naming", "harmless", "quoted", "test_path", "code_path", "block", "address", "reference", "wordlike")


def _has(text: Column, words: str) -> Column:
    return F.when(F.lower(text).rlike(words), 1.0).otherwise(0.0)


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, F.lit(""))).cast("double")


def feature_struct(value: Column, before: Column, after: Column, path: Column) -> Column:
    """FEATURES of a finding, as a struct of doubles."""
    n = F.length(value).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", F.lit("l")), "[A-Z]+", F.lit("U")), "[0-9]+", F.lit("0")), "[^lU0]+", F.lit("-"))
    chars = F.array_distinct(F.split(value, ""))
    shares = F.transform(chars, lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    issuer = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20}|npm_[A-Za-z0-9]{36}|-----BEGIN)"
    values = {
        "length": n,
        "transitions": (F.length(kinds) - 1) / n,
        "entropy": entropy,
        "distinct": F.size(chars) / n,
        "digits": (n - _length_without(value, "[0-9]")) / n,
        "uppers": (n - _length_without(value, "[A-Z]")) / n,
        "symbols": _length_without(value, "[A-Za-z0-9]") / n,
        "hexlike": F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 1.0).otherwise(0.0),
        "known": F.when(value.rlike(issuer), 1.0).otherwise(0.0),
        "covered": (n - _length_without(F.lower(value), DICTIONARY)) / n,
        "placeholder": _has(value, PLACEHOLDER),
        "assigned": F.when(before.rlike("[=:]\\s*[\"'`]?$"), 1.0).otherwise(0.0),
        "naming": _has(before, f"({ASSIGNING})[\\w\\-.\\]\"']*\\s*(=|:|=>|is|\\s)?\\s*[\"'`]?$"),
        "harmless": _has(before, f"({HARMLESS})[\\w#\\-.]*\\s*[=:#/]?\\s*[\"'`]?$"),
        "quoted": F.when(before.rlike("[\"'`]$") & after.rlike("^[\"'`]"), 1.0).otherwise(0.0),
        "test_path": _has(path, "(^|[/_.-])(tests?|examples?|samples?|fixtures?|docs?|mocks?)([/_.-]|$)"),
        "block": F.when(value.rlike("^(-----BEGIN|eyJ[A-Za-z0-9_-]+\\.)"), 1.0).otherwise(0.0),
        "address": F.when(before.rlike("://[^\\s/:@]*:$") & after.startswith("@"), 1.0).otherwise(0.0),
        "reference": F.when(value.rlike(REFERENCE), 1.0).otherwise(0.0),
        "wordlike": F.when(value.rlike(WORDLIKE), 1.0).otherwise(0.0),
        "code_path": _has(path, "\\.(py|js|ts|java|go|rb|php|sh|env|ya?ml|json|toml|ini|cfg|conf|properties|tf)$"),
    }
    return F.struct(*[F.coalesce(values[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES])


def default_findings(spark: SparkSession, rows: int = 4600) -> DataFrame:
    """Labelled findings made from a rule: row i is of kind i modulo their number, its value drawn from digests of i."""
    hexed = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512)
    many = lambda salt: F.concat(F.base64(F.unhex(hexed(salt))), F.base64(F.unhex(hexed(salt + "+"))))
    letters = lambda salt, drop, n: F.substring(F.regexp_replace(F.concat(many(salt), many(salt + "2")), drop, F.lit("")), 1, n)
    digits = lambda salt, n: F.substring(F.concat(F.lit("4"), F.translate(F.substring(hexed(salt), 1, 60), "abcdef", "012345")), 1, n)
    pick = lambda salt, *words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(len(words))) + 1).cast("int"))
    size = lambda salt, lo, hi: (F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(hi - lo)) + lo).cast("int")
    filler = pick("f", "see the log, ", "and then ", "la clave de ", "der Wert ", "set ", "le reste, ", "", "\n")
    name = F.concat(filler, pick("n", "password", "token", "secret", "api_key", "auth_token", "DB_PASSWORD", "client-secret", "passwd", "access_key"))
    sign = pick("s", "=", " = ", ": ", "=\"", " = \"", ": \"", "='")
    label = F.concat(filler, pick("h", "checksum", "sha1", "md5", "commit", "revision", "digest", "build", "uuid", "etag"), pick("i", " ", ": ", "=", " = ", "/"))
    word = lambda k: pick(f"w{k}", *DICTIONARY.split("|"))
    slug = F.concat(word(1), pick("j", "-", "_", "/"), word(2), pick("k", "-", "_", "/"), word(3), F.lit("-"), size("y", 1, 2030).cast("string"))
    dashed = F.regexp_replace(F.substring(hexed("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", F.lit("$1-$2-$3-$4-$5"))
    quote = pick("q", "\"", " ", "\n", "'")
    phrase = F.concat(word(5), pick("y2", "12", "007", "99", "2024", "!9", "_x1"), pick("y3", "!", "$", "#4", "@home", "", "&co", "123"))
    mixed = F.concat(letters("p1", "[^A-Za-z]", 3), pick("y4", "!", "$", "@", "#", "%"), size("y5", 1, 9999).cast("string"), letters("p2", "[^A-Za-z]", 2))
    dashes = F.lit("-" * 5)
    title = F.concat(pick("bk", "RSA ", "EC ", "", "OPENSSH ", "ENCRYPTED "), F.lit("PRIVATE KEY"))
    head = pick("bh", "\n", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D\n\n")
    block = F.concat(dashes, F.lit("BEGIN "), title, dashes, head, many("bb"), F.lit("\n"), dashes, F.lit("END "), title, dashes)
    signed = F.concat(F.lit("eyJ"), letters("j1", "[^A-Za-z0-9]", 24), F.lit("."), letters("j2", "[^A-Za-z0-9]", 40), F.lit("."), letters("j3", "[^A-Za-z0-9]", 43))
    variable = pick("v1", "SECRET", "DB_PASSWORD", "API_KEY", "token", "user.password", "AUTH_TOKEN")
    refers = F.concat(pick("v2", "${", "$", "os.environ[", "getenv(", "process.env.", "{{", "%", "config.get(", "settings.", "<", "self.", "$(cat", "secrets.", "vault.read("), variable, pick("v3", "", "", "}", "]", "%"))
    called = pick("v4", "os.environ[", "getenv(", "os.getenv(", "config.get(", "System.getenv(", "read_secret(", "input(", "decrypt(")
    part = lambda k: pick(f"o{k}", "ba", "ness", "zah", "lung", "mit", "tel", "né", "ces", "saire", "ción", "pala", "bra", "wort", "über", "schlüs", "sel", "ge", "heim", "ver", "trau", "en", "con", "fi", "dent", "ial", "str", "ing", "opt", "ional", "ho", "nes", "ty", "mot", "passe", "segre", "to", "ключ", "слово", "γή")
    foreign = F.concat(*[part(k) for k in range(2)], F.when(size("o9", 0, 3) > 0, part(3)).otherwise(F.lit("")), F.when(size("o8", 0, 2) > 0, F.concat(part(4), part(5))).otherwise(F.lit("")))
    foreign = F.when(size("o7", 0, 3) == 0, F.initcap(foreign)).otherwise(foreign)
    kind_of = pick("ty", "string", "String", "SecretStr", "CancellationToken", "Optional", "boolean", "undefined", "required", "readonly", "StringProperty")
    address = F.concat(filler, pick("a1", "postgres://", "mysql://", "redis://", "https://", "amqp://"), word(6), F.lit(":"))
    kinds = [
        (F.substring(hexed("b"), F.lit(1), F.when(size("l", 0, 2) == 0, size("l1", 19, 40)).otherwise(size("l2", 41, 65))), F.concat(name, sign), quote, 1),
        (F.substring(many("c"), F.lit(1), size("c", 20, 44)), F.concat(name, sign), quote, 1),
        (F.concat(pick("g", "ghp_", "gho_", "sk_live_", "npm_"), letters("d", "[^A-Za-z0-9]", 36)), F.concat(filler, sign), F.lit(" "), 1),
        (F.concat(pick("g2", "AIza", "glpat-", "xoxb-"), letters("d2", "[^A-Za-z0-9]", 35)), filler, pick("r", " ", ".", ","), 1),
        (letters("e", "[^A-Za-z0-9]", 24), F.concat(name, sign), quote, 1),
        (letters("e2", "[^A-Z0-9]", 22), F.concat(name, sign), quote, 1),
        (phrase, F.concat(name, sign), quote, 1),
        (mixed, F.concat(name, sign), quote, 1),
        (block, F.concat(filler, F.lit("\n")), F.lit("\n"), 1),
        (signed, F.concat(pick("jb", "Authorization: Bearer ", "token=", "see "),), pick("r2", " ", "\n", "\""), 1),
        (F.when(size("a2", 0, 2) == 0, mixed).otherwise(phrase), address, F.concat(F.lit("@"), word(7), F.lit(".")), 1),
        (F.substring(hexed("m"), F.lit(1), pick("o", 32, 40, 64)), label, F.lit(" "), 0),
        (digits("n", 16), filler, pick("r", " ", ".", ","), 0),
        (dashed, F.concat(filler, pick("t", "uuid=", "id ", "/", "")), F.lit(" "), 0),
        (slug, F.concat(filler, pick("v", "http://www.example.com/", "/", "", " ")), pick("r", " ", ".", ","), 0),
        (F.concat(pick("x", "your-api-key-", "example_token_", "changeme_password_", "xxxxxxxxxxxx_"), size("x", 1, 999).cast("string")), F.concat(name, sign), quote, 0),
        (digits("z", 15), F.concat(filler, pick("z", "order ", "invoice: ", "account=", "")), F.lit(" "), 0),
        (F.concat(F.lit("20"), digits("t", 12), F.lit("-"), word(4)), F.concat(filler, pick("z2", "version ", "build-", "")), F.lit(" "), 0),
        (F.concat(word(8), pick("pl", "", "", "s", "-", "_"), F.when(size("pw", 0, 2) == 0, word(9)).otherwise(F.lit(""))), F.concat(name, sign), pick("r3", " ", "\n", "\""), 0),
        (F.when(size("v5", 0, 3) == 0, called).otherwise(refers), F.concat(name, sign), pick("r4", " ", "\n", "\"", ")", ";", "'"), 0),
        (foreign, F.concat(name, sign), pick("r5", " ", "\n", ".", ","), 0),
        (F.when(size("ty2", 0, 2) == 0, kind_of).otherwise(foreign), F.concat(name, pick("s2", ": ", ": ", " = ", "=")), pick("r6", ",", ";", ")", " ", "\n"), 0),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    chosen = [F.element_at(F.array(*[k[c] if isinstance(k[c], Column) else F.lit(k[c]) for k in kinds]), (kind + 1).cast("int")) for c in range(4)]
    path = pick("p", "src/app.py", "config/prod.yaml", "tests/fixtures/a.json", "docs/readme.md", "lib/client.go", "", "")
    return spark.range(0, rows, 1, 4).select(*[c.alias(n) for c, n in zip(chosen, ("value", "before", "after", "label"), strict=True)], path.alias("path"))


def _tree_sql(lines: list[str], at: list[int]) -> str:
    """One tree of the model's description, as nested CASE over the fields of ``x.f``."""
    line = lines[at[0]].strip()
    at[0] += 1
    if line.startswith("Predict"):
        return f"{float(line.split(':')[1])}D"
    feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    yes = _tree_sql(lines, at)
    at[0] += 1  # the Else
    no = _tree_sql(lines, at)
    return f"(CASE WHEN x.f.{FEATURES[int(feature)]} <= {float(limit)!r}D THEN {yes} ELSE {no} END)"


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7, most_rows: int = 20_000) -> list[str]:
    """A random forest from labelled findings (value, before, after, path, label), as one SQL expression a tree.

    It is fitted on at most ``most_rows`` findings, those with the smallest hashes. Rows with a null value or label
    are ignored. With one label only, the forest always answers that; with none, it answers 1.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.filter(F.col("value").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.col("label").cast("double").alias("label"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("value", "before", "after", "path")])
    rows = rows.orderBy(F.xxhash64("value", "before", "after", "path"), "label").limit(most_rows)
    features = feature_struct(F.col("value"), F.col("before"), F.col("after"), F.col("path"))
    ready = written(rows.select("label", features.alias("f")).select("label", "f.*"), "findings")  # the forest reads them many times
    seen = [r[0] for r in ready.select("label").distinct().limit(2).collect()]
    if len(seen) < 2:
        return [f"{seen[0] if seen else 1.0}D"]
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(ready)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=2).fit(ready)
    blocks = re.split(r"\n  Tree \d+[^\n]*:\n", model.toDebugString)[1:]
    return [_tree_sql([x for x in b.split("\n") if x.strip()], [0]) for b in blocks]


def _parts(text: Column) -> Column:
    """Struct of a text's candidates and of the pieces between them, one more, from one search."""
    marked = F.split(F.regexp_replace(text, CANDIDATE, F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    odd = F.element_at(F.transform(F.array(marked), lambda p: F.struct(F.filter(p, lambda x, i: i % 2 == 1).alias("found"), F.filter(p, lambda x, i: i % 2 == 0).alias("between"))), 1)
    apart = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("between"))
    return F.when(text.contains(OPEN) | text.contains(CLOSE), apart).otherwise(odd)


def _searched(docs: DataFrame, forest: list[str], text: str, path: str | None) -> tuple[DataFrame, str, str]:
    """``docs`` with the parts of each text and its judged findings, and the names of both columns."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    parts, own = private(docs, "parts", "judged")
    out = docs.withColumn(parts, _parts(F.col(text)))
    between = F.col(parts)["between"]
    n = F.size(between) - 1
    around = F.zip_with(F.slice(between, 1, n), F.slice(between, 2, n), lambda a, b: F.struct(F.right(a, F.lit(64)).alias("before"), F.left(b, F.lit(8)).alias("after")))
    found = F.zip_with(F.col(parts)["found"], around, lambda v, c: F.struct(v.alias("value"), c["before"].alias("before"), c["after"].alias("after"), feature_struct(v, c["before"], c["after"], where).alias("f")))
    out = out.withColumn(own, F.when(n > 0, found))
    scored = f"transform(`{own}`, x -> struct(x.value AS value, x.before AS before, x.after AS after, ({' + '.join(forest)}) / {len(forest)}D AS score))"
    none = F.expr("cast(array() as array<struct<value: string, before: string, after: string, score: double>>)")
    return out.withColumn(own, F.coalesce(F.expr(scored), none)), parts, own


def scan(docs: DataFrame, forest: list[str], text: str = "text", path: str | None = None, into: str = "findings") -> DataFrame:
    """``docs`` with the array of a text's findings, in order: value, before, after, score (share of trees that say secret)."""
    out, _, own = _searched(docs, forest, text, path)
    return out.select(with_results(out, docs.columns, {into: F.col(own)}))


def redact(docs: DataFrame, forest: list[str], text: str = "text", path: str | None = None, threshold: float = 0.5, by: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced."""
    out, parts, own = _searched(docs, forest, text, path)
    kept = F.transform(own, lambda x: F.when(x["score"] >= threshold, F.lit(by)).otherwise(x["value"]))
    whole = F.array_join(F.zip_with(F.col(parts)["between"], kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    any_ = F.exists(own, lambda x: x["score"] >= threshold)
    return out.withColumn(text, F.when(any_, whole).otherwise(F.col(text))).drop(parts, own)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """One row a finding: doc_id, its number in the document, the value, the words before it, score and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(default_findings(spark))).select("doc_id", F.posexplode("findings").alias("finding", "x"))
    return found.select("doc_id", "finding", F.col("x.value").alias("value"), F.col("x.before").alias("before"), F.col("x.score").alias("score"), (F.col("x.score") >= 0.5).alias("is_secret"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows it, that of a null text stays. No document goes."""
    clean = redact(docs, train(default_findings(spark)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
