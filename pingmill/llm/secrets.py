"""Secret scans with a random forest that removes false positives. DataFrame and SQL functions only.

Candidates are long runs of key characters, values assigned to telling names, tokens with known prefixes and private-key headers.
A random forest (Spark ML, grown from a table of labelled findings) scores each one on its length, its character transitions
(changes of kind, and pairs of letters that ordinary words have), its coverage by a dictionary of ordinary word parts, whether it
looks like a path, and its neighbouring words on both sides. The trees are turned into one SQL expression, so scanning is a
projection: no join, no shuffle, no row leaves its task.

The labelled findings are made from a rule (`labelled`), `LABELLED` rows; pass any other DataFrame of (value, before, after, label)
to `train` to use findings of your own. The bound is the parameter; the scan itself covers every character of every text.

Defined results: null and empty texts have no findings; a value found several times in a text is one finding with its count, the
place of the first and the score of the highest occurrence, each scored with its own neighbouring words; equal
rows are scanned alike; a value of any length is one candidate, scored and redacted as a whole; an empty table gives an empty
result; a column named like the new one stays, and the new one gets a leading underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.llm.common import fresh, spread, table

LABELLED, TREES, DEPTH, LONG, CONTEXT = 6000, 15, 6, 400, 48
THRESHOLD = 0.5
RUN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}+"
ASSIGNED = r"(?i)(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)[a-z_]{0,16}[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>]{8,}+)"
HEADER = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
PREFIXED = r"^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|AIza|eyJ|glpat-|npm_|-----BEGIN)"
#: Such tokens wherever they begin: after any character that is no letter or digit; access key ids have a fixed form and length.
TOKEN = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_|xox[abprs]-|sk[-_]|AIza|eyJ|glpat-|npm_)[A-Za-z0-9+/_.=-]{4,}+"
#: What a text must hold for the patterns to match at all (the first list in lower case).
ASSIGNED_PARTS = ("token", "secret", "passw", "pwd", "key", "auth", "credential")
TOKEN_PARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "sk_", "AIza", "eyJ", "glpat-", "npm_")
#: Word parts that ordinary identifiers and prose are made of.
DICTIONARY = "able access account action admin after all and any app array at auth back base begin block body build by call change check class clean client code com common config content control copy count create data date db default delete dev dir doc domain end env error event example exit file filter first for form format from func get global group handler has hash head help home host html http id image import in index info init input int is item java job json key lang last length level lib line link list load local lock log main make manager map max message method min mode model module name new next node not null num object of on open option or order org out output package page param parse path plugin port post print process project property public query queue read ref release report request reset resource response result return role root run save schema script search select self server service session set size sort source start state static status stop store stream string sub sync system table tag target task temp test text the time to token tool top tree type undefined update url use user util val value version view web with word work write your".split()
#: Words that follow a known prefix in ordinary names.
WORDS = "learn buff estimator config lifecycle package registry skb widget engine lookup socket family common".split()
#: What long words of letters are made of, and how they begin.
SYLLABLES = "schaft dampf fahrt gesell donau ung lich keit ver inter nation al isation europ ment ique tion bund straf recht haus ober ante contra dis establish arian ism electro photo graph micro scop hydro geo logie psych auf sicht rat".split()
CAPITALS = "Ar Be Do Ge Ka Lu Mi Ober Re Sta ar be do ge ka lu mi ober re sta".split()
FIXED_WORDS = r"(?i)(example|sample|placeholder|change_?me|your[_-]|dummy|fake|xxxx|todo|redacted|1234567|abcdef0|test[_-]?(key|token|secret)|\.\.\.)"
TELLING = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|credential|bearer|private|auth)"
HARMLESS = r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|revision|etag|integrity|version|id)\W{0,4}$"

AFTER_TELLING = r"(?i)^\W{0,4}(?:(?:is|as|for|of|=|:|\(|the|my|your|our|a)\s*){1,3}(?:token|secret|passw|pwd|api.?key|access.?key|credential|bearer|private|auth)"
AFTER_HARMLESS = r"(?i)^\W{0,4}(?:(?:is|as|for|of|=|:|\(|the|my|your|our|a)\s*){1,3}(?:commit|sha-?\d|md5|checksum|digest|hash|uuid|guid|revision|etag|integrity|version)"

OWN = ("length", "digits", "uppers", "lowers", "transitions", "repeats", "distinct", "usual_pairs", "coverage", "path", "hexadecimal", "numeric", "uuid", "prefix", "fixed")
PLACE = ("telling", "harmless", "assigned", "closed", "telling_after", "harmless_after")
NAMES = OWN + PLACE


def usual_pairs() -> str:
    """A pattern that matches before every pair of letters that occurs three times or more in the word parts above."""
    pairs: dict[str, int] = {}
    for word in DICTIONARY + SYLLABLES + WORDS:
        for k in range(len(word) - 1):
            pairs[word[k : k + 2]] = pairs.get(word[k : k + 2], 0) + 1
    after: dict[str, str] = {}
    for pair in sorted(x for x, n in pairs.items() if n >= 3):
        after[pair[0]] = after.get(pair[0], "") + pair[1]
    return "(?=" + "|".join(f"{a}[{b}]" for a, b in after.items()) + ")"


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def own_features(value: Column) -> list[Column]:
    """What OWN names, of the value itself."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    lower = F.lower(value)
    kinds = F.translate(value, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0" * 10 + "A" * 26 + "a" * 26)
    same_kind = F.length(F.regexp_replace(kinds, r"(0+|A+|a+|[^0Aa]+)", "-"))
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True))
    # The last of each character stays: a long value is never split into an array of its characters.
    kinds_of = F.when(n <= LONG, F.size(F.array_distinct(F.split(value, "")))).otherwise(F.length(F.regexp_replace(value, r"(?s)(.)(?=.*?\1)", "")))
    return [
        F.least(n, F.lit(200.0)),
        _share(value, "[^0-9]"),
        _share(value, "[^A-Z]"),
        _share(value, "[^a-z]"),
        same_kind / n,
        1 - F.length(F.regexp_replace(value, r"(.)\1+", "$1")) / n,
        kinds_of / F.least(n, F.lit(64.0)),
        F.regexp_count(lower, F.lit(usual_pairs())) / n,
        1 - F.length(F.regexp_replace(lower, f"({words})", "")) / n,
        _flag(value.rlike(r"^[./~]|/[A-Za-z_.-]+/|\.[a-z]{2,4}$|^https?")),
        _flag(value.rlike(r"^[0-9a-fA-F]+$")),
        _flag(value.rlike(r"^[0-9.+/_=-]+$")),
        _flag(value.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        _flag(value.rlike(PREFIXED)),
        _flag(value.rlike(FIXED_WORDS)),
    ]


def place_features(before: Column, after: Column) -> list[Column]:
    """What PLACE names, of the CONTEXT characters on both sides of one occurrence."""
    return [
        _flag(before.rlike(TELLING)),
        _flag(before.rlike(HARMLESS)),
        _flag(before.rlike(r"[:=]\s*[\"']?$")),
        _flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        _flag(after.rlike(AFTER_TELLING)),
        _flag(after.rlike(AFTER_HARMLESS)),
    ]


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _named(columns: list[Column], names: tuple[str, ...]) -> list[Column]:
    return [c.alias(n) for c, n in zip(columns, names, strict=True)]


def described(value: Column, before: Column, after: Column) -> list[Column]:
    """All features, by name."""
    return _named(own_features(value) + place_features(before, after), NAMES)


def labelled(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """(value, before, after, label): eighteen kinds of findings, nine of them secrets, with material from a hash of the row number."""
    m = F.sha2(F.col("id").cast("string"), 256)
    m2 = F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256)
    mixed = F.translate(F.concat(F.base64(F.unhex(m)), F.base64(F.unhex(m2))), "+/=", "aZ0")
    pick = lambda options, salt: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(salt)), len(options)) + 1).cast("int"))
    between = lambda low, high, salt: (F.pmod(F.xxhash64("id", F.lit(salt)), high - low + 1) + low).cast("int")
    telling = pick(['token = "', "secret: ", "password=", 'api_key = "', "access_key: ", "Authorization: Bearer ", 'private_key="', "le token = \"", "and auth_token="], 1)
    plain = pick(["the ", "see ", "", "and then ", "from ", "le ", "der ", "los "], 2)
    harmless = pick(["commit ", "sha256: ", "checksum=", "md5 ", "hash: ", "etag=\"", "revision "], 3)
    told = pick([" is the commit", " (sha256)", " as checksum", ", the revision", " = md5", " for the hash"], 50)
    meant = pick([" is the token", " as password", " (api key)", ", our secret", " for the access key", " is my private key"], 51)
    rest = pick(["", " and", ".", "\n", " |"], 52)
    parts = F.array(*(pick(DICTIONARY, 10 + i) for i in range(5)))
    joined = F.call_function("concat_ws", pick(["_", "-", "", "."], 4), F.slice(parts, F.lit(1), between(3, 5, 5)))
    kinds = [
        (F.substring(m, 1, 40), telling, 1),
        (F.substr(m, F.lit(1), between(32, 64, 6)), telling, 1),
        (F.substr(mixed, F.lit(1), between(20, 64, 7)), telling, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(mixed, "0189", "QRST"), 1, 16))), F.concat(plain, pick(["", 'key="'], 8)), 1),
        (F.concat(pick(["ghp_", "xoxb-", "sk-", "AIza", "glpat-"], 9), F.substring(mixed, 1, 36)), F.concat(plain, pick(["", 'token="'], 8)), 1),
        (F.substr(F.translate(mixed, "aeiou", "!@#$%"), F.lit(1), between(10, 20, 20)), pick(["password = \"", "passwd:", "pwd="], 21), 1),
        (joined, pick(['token = "', "the ", "key: ", "secret = \"", ""], 22), 0),
        (F.substr(F.repeat(pick(["x", "0", "*", "abc", "-", "1234567890", "12345678"], 23), 40), F.lit(1), between(10, 40, 56)), pick(['token = "', "password=", "api_key: ", ""], 24), 0),
        (F.substr(m, F.lit(1), F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), between(1, 3, 25))), harmless, 0),
        (F.regexp_replace(F.substring(m, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), pick(["uuid=", "id: ", "request id ", "the "], 26), 0),
        (F.concat(pick(["src/", "/usr/local/", "https://www.", "com.example."], 27), F.call_function("concat_ws", pick(["/", "."], 28), parts), pick(["", ".py", ".java", ".html", "/"], 29)), plain, 0),
        (pick(["your-token-goes-here", "CHANGE_ME_PLEASE", "example_api_key_value", "insert.your.secret.here", "test_token_1234567890", "REDACTED_REDACTED_REDACTED", "placeholder_placeholder"], 30), telling, 0),
        (F.concat(pick(["ghp_", "xoxb-", "sk-", "sk_", "npm_", "glpat-"], 31), F.substr(mixed, F.lit(1), between(8, 24, 32))), F.concat(plain, pick(["", 'token="'], 33)), 1),
        (F.call_function("concat_ws", F.lit("_"), F.concat(pick(["sk-", "sk_", "npm_"], 34), pick(WORDS, 35)), pick([None, *DICTIONARY[:20], *WORDS], 36)), F.concat(plain, pick(["", "key: ", "import "], 37)), 0),
        (F.concat(pick(CAPITALS, 38), F.call_function("array_join", F.slice(F.array(*(pick(SYLLABLES, 40 + i) for i in range(9))), F.lit(1), between(4, 9, 39)), F.lit(""))), plain, 0),
        (F.substr(mixed, F.lit(1), between(20, 40, 53)), plain, 1, meant),
        (F.substr(m, F.lit(1), between(32, 48, 54)), plain, 1, meant),
        (F.substr(m, F.lit(1), F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), between(1, 3, 55))), plain, 0, told),
    ]
    at = F.pmod("id", len(kinds))
    case = lambda k: reduce(lambda acc, i: acc.when(at == i, k(kinds[i])), range(1, len(kinds)), F.when(at == 0, k(kinds[0])))
    rows = spark.range(0, rows, 1, 2).select(case(lambda x: x[0]).alias("value"), case(lambda x: x[1]).alias("before"), case(lambda x: x[3] if len(x) > 3 else rest).alias("after"), case(lambda x: F.lit(x[2])).cast("double").alias("label"))
    # What was opened with a quote is closed by it.
    quote = F.regexp_extract("before", "[\"']$", 0)
    return rows.withColumn("after", F.concat(quote, "after"))


def _tree_sql(node, columns: list[str]) -> str:
    if node.subtreeDepth() == 0:
        counts = list(node.impurityStats().stats())
        return f"{counts[1] / sum(counts)!r}D"
    split = node.split()
    return f"CASE WHEN {columns[split.featureIndex()]} <= {split.threshold()!r}D THEN {_tree_sql(node.leftChild(), columns)} ELSE {_tree_sql(node.rightChild(), columns)} END"


_forests: dict[str, list] = {}


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
    """The random forest of labelled findings (value, before, after, label)."""
    rows = findings.select("label", *described(F.col("value"), F.col("before"), F.col("after")))
    ready = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(rows)
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", bootstrap=True).fit(ready)


def forest_sql(model, struct: str) -> str:
    """The model's probability of a secret as SQL over the fields of a struct: the mean of the trees' leaf shares."""
    columns = [f"{struct}.{n}" for n in NAMES]
    trees = [_tree_sql(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"), columns) for t in model.trees]
    return "(" + " + ".join(trees) + f") / {len(trees)}D"


def default_forest(spark: SparkSession) -> str:
    """The forest of the built-in labelled findings, grown once an application."""
    app = spark.sparkContext.applicationId
    if app not in _forests:
        _forests[app] = forest_sql(train(labelled(spark)), "x.f")
    return _forests[app]


def _all(text: Column, pattern: str, group: int = 0, parts: tuple[str, ...] = (), where: Column | None = None) -> Column:
    """All matches; the pattern is tried only on texts that hold one of the parts without which it cannot match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if not parts:
        return found
    holds = reduce(lambda a, b: a | b, ((text if where is None else where).contains(p) for p in parts))
    return F.when(holds, found).otherwise(F.array().cast("array<string>"))


def candidates(text: Column) -> Column:
    found = F.concat(_all(text, RUN), _all(text, ASSIGNED, 1, ASSIGNED_PARTS, F.lower(text)), _all(text, TOKEN, 0, TOKEN_PARTS))
    trimmed = F.transform(found, lambda v: F.regexp_replace(v, r"[.,;:)\]}]+$|^[.=-]{1,3}(?=\w)", ""))
    return F.array_distinct(F.filter(F.concat(trimmed, _all(text, HEADER, 0, ("-----BEGIN ",))), lambda v: F.length(v) >= 8))


def scan(docs: DataFrame, text: str = "text", out: str = "findings", forest: str | None = None) -> DataFrame:
    """docs with an array of findings: value, start (1-based), count, score, is_secret."""
    forest = forest or default_forest(docs.sparkSession)
    (out,) = fresh(docs, out)
    body = F.coalesce(F.col(text), F.lit(""))

    def let(value: Column, use) -> Column:
        """use(value), with the value computed once: a lambda's body computes its expressions again wherever they stand."""
        return F.transform(F.array(value), use)[0]

    def place(pieces: Column, v: Column, n: Column, i: Column) -> Column:
        back = F.ceil(F.lit(CONTEXT) / F.length(v)).cast("int")
        joined = F.call_function("array_join", F.slice(pieces, F.greatest(i - back, F.lit(1)), F.least(i, back + 1)), v)
        sides = F.struct(F.right(joined, F.lit(CONTEXT)).alias("before"), F.left(F.element_at(pieces, i + 1), F.lit(CONTEXT)).alias("after"))

        def described_place(c: Column) -> Column:
            before, after = c["before"], c["after"]
            inside = before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]") | ((after == "") & (i < n) & v.rlike("^[A-Za-z0-9]"))
            return F.struct(inside.alias("inside"), F.struct(*_named(place_features(before, after), PLACE)).alias("f"))

        return let(sides, described_place)

    def found_at(v: Column, mark: Column) -> Column:
        # The text is split at the value: a piece's end, and what precedes it, are the words before one occurrence. A mark that no
        # text holds stands for the value, since a long one makes a slow pattern.
        def described_value(pieces: Column) -> Column:
            n = F.size(pieces) - 1
            own = F.struct(*_named(own_features(v), OWN))
            start = (F.length(F.element_at(pieces, 1)) + 1).cast("int")

            def kept(places: Column) -> Column:
                # Parts of longer tokens are no occurrences of their own, unless there is no other.
                alone = F.filter(places, lambda p: ~p["inside"])
                chosen = let(alone, lambda x: F.when(F.size(x) > 0, x).otherwise(places))
                return F.struct(v.alias("value"), start.alias("start"), n.alias("count"), own.alias("own"), chosen.alias("places"))

            return let(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: place(pieces, v, n, i))), kept)

        return let(F.split(F.replace(body, v, mark), mark, -1), described_value)

    mark = F.concat(F.lit("\uffff"), F.md5(F.encode(body, "UTF-8")))
    found = let(mark, lambda m: F.transform(candidates(body), lambda v: found_at(v, m)))
    # The rows with candidates are few: the flag lets whole-stage code skip the rest of the work for all others.
    (held,) = fresh(docs.withColumn(out, F.lit(0)), "held_findings")
    fields = ", ".join(f"'{k}', {'v.own' if k in OWN else 'p.f'}.{k}" for k in NAMES)
    scores = f"transform(transform(v.places, p -> named_struct('f', named_struct({fields}))), x -> {forest})"
    scored = f"transform({held}, v -> named_struct('value', v.value, 'start', v.start, 'count', v.count, 'score', array_max({scores})))"
    done = docs.withColumn(held, found).withColumn(out, F.expr(scored)).drop(held)
    return done.withColumn(out, F.transform(out, lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), x["count"].alias("count"), F.round(x["score"], 9).alias("score"), (x["score"] >= THRESHOLD).alias("is_secret"))))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every accepted finding replaced in its text; other columns as they were, n_chars (if any) brought up to date."""
    (found,) = fresh(docs, "findings")
    scanned = scan(docs, text, found)
    secrets = F.array_sort(F.filter(found, lambda x: x["is_secret"]), lambda a, b: F.length(b["value"]) - F.length(a["value"]))
    clean = F.aggregate(secrets, F.col(text), lambda acc, x: F.replace(acc, x["value"], F.lit(mark)))
    changed = F.exists(found, lambda x: x["is_secret"])
    out = scanned.withColumn(text, F.when(changed, clean).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    """The accepted findings of all documents, without the secrets themselves: their SHA-256, place, length, count and score."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # Not explode: Spark would infer a filter on the findings' number from it, and scan every text once more for that.
    rows = scan(docs).select("doc_id", F.explode_outer("findings").alias("f")).filter("f.is_secret")
    return rows.select("doc_id", F.sha2("f.value", 256).alias("value_sha256"), F.col("f.start").alias("start"), F.length("f.value").alias("length"), F.col("f.count").alias("count"), F.col("f.score").alias("score"))
