"""Secret scan: regular-expression candidates, false positives removed by a random forest.

DataFrame and SQL functions only. Candidates are runs of at least eight token characters with a digit or a change of case
inside, and whatever four or more characters an announcing word and = or : give as its value. Each gets features of the token (length, character transitions and classes, distinct characters, dictionary coverage),
of its path or address, and of the neighbouring words. The forest is trained from labelled findings: given as a table of
(before, token, after, label), or the built-in ones, written by rule from the shapes that secrets and their look-alikes take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch

RUN = r"[A-Za-z0-9+/_\-]{8,}={0,2}"
LIKELY = r"[0-9]|[a-z][A-Z]"
FINDINGS = 6000  # rows of the built-in labelled findings
TREES, DEPTH, SEED = 24, 8, 3
REPLACEMENT = "[SECRET]"

#: Words that make a token readable, that announce a secret, and that announce something else.
DICTIONARY = "account admin api app array background bench build cache card check class client cloud code color commit common config count create data date default demo description digest document download email error event example factory field file filter form format function global group handler hash header height hello home html http identifier image index info input instance integer interface item java json key label lang length level library line link list load local lock main manager map master member message meta method model module month name node number object option order output package page param part password path phone placeholder point post price print process product profile project property public query random record release report request resource result role root sample schema script search secret section select sequence server service session setting size source spec src stage start state static status string style sub support system table tag target task template test text thread time title token total type unit update upload user utils value version view web width window word work world xml".split()
ANNOUNCE = "key|token|secret|passw(?:or)?d|pwd|auth|credential|bearer|signature|private"
BENIGN = "commit|sha1?|sha256|md5|checksum|digest|uuid|guid|version|revision|phone|tel|card|isbn|order|invoice|ip|hash|example|sample|test|dummy|placeholder"
HASHES = "commit|sha1?|sha256|md5|checksum|digest|uuid|guid|revision|hash"

FEATURES = ["length", "transitions", "digits", "upper", "lower", "other", "hexadecimal", "distinct", "covered", "slashes", "pathlike", "dashes", "announced", "assigned", "quoted", "benign", "hashlike", "prefixed", "placeholder", "longest_letters"]
#: An announcing word with = or : after it, and what encloses its value.
GIVES = rf"(?i:{ANNOUNCE})[\w\-]*[\"']?[=:]"
OPENS, CLOSES = r"[\"'`(\[{]*", r"[\"'`,;.)\]}!#$%&]*"
INSIDE = rf"^(.*{GIVES}{OPENS})(\S{{4,}}?)({CLOSES})$"  # all in one word
ALONE = rf"^({OPENS})(\S{{4,}}?)({CLOSES})$"  # the value's own word


def _length_without(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, ""))


def features(before: Column, token: Column, after: Column) -> dict[str, Column]:
    """Numbers between 0 and 1 but for lengths. `before` holds what precedes the token in its word and the words before."""
    n = F.greatest(F.length(token), F.lit(1)).cast("double")
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]", "\u0001"), "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "+/_-=", "\u0004" * 5)
    same = F.regexp_replace(classes, "(.)\\1*", "$1")
    letters = F.array_max(F.transform(F.split(token, "[^A-Za-z]+"), F.length))
    low, near, all_near = F.lower(token), F.lower(before), F.lower(F.concat_ws(" ", before, after))
    return {
        "length": n, "transitions": (F.length(same) - 1) / n,
        "digits": 1 - _length_without(token, "[0-9]") / n, "upper": 1 - _length_without(token, "[A-Z]") / n, "lower": 1 - _length_without(token, "[a-z]") / n, "other": _length_without(token, r"[A-Za-z0-9+/_\-=]") / n,
        "hexadecimal": token.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / n,
        "covered": 1 - _length_without(low, "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")") / n,
        "slashes": (n - _length_without(token, "/")) / n,
        "pathlike": (token.rlike("^/|/[a-z]{3,}/|[a-z]{3,}/[a-z]{3,}") | before.rlike(r"(://|\./|\.\w+/|@)\S*$") | after.rlike(r"^(\.[a-z]{1,5}\b|@)")).cast("double"),
        "dashes": (n - _length_without(token, "[-_]")) / n,
        "announced": near.rlike(rf"({ANNOUNCE})\W{{0,6}}\S{{0,3}}$").cast("double"), "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("double"), "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "benign": all_near.rlike(rf"\b({BENIGN})\b").cast("double"), "hashlike": near.rlike(rf"\b({HASHES})\b\W{{0,4}}$").cast("double"),
        "prefixed": token.rlike("^(AKIA|ASIA|ghp_|gho_|sk-|sk_live|xox[bp]-|AIza|glpat-)").cast("double"),
        "placeholder": low.rlike(r"x{4,}|example|placeholder|changeme|(.)\1{4,}|1234567|abcdef").cast("double"),
        "longest_letters": F.coalesce(letters, F.lit(0)).cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS, first: int = 0) -> DataFrame:
    """(before, token, after, label): n findings written by rule from hashes of their numbers, `first` and on; a third are secrets."""

    def pick(salt: int, choices: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(choices))) + 1).cast("int"))

    def number(salt: int, low: int, high: int) -> Column:
        return (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")

    def drawn(salt: int, alphabet: str, length: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), length), lambda k: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64("id", k, F.lit(salt)), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1)))
        return F.array_join(each, "")

    digits, hexes = "0123456789", "0123456789abcdef"
    upper, alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = pick(1, DICTIONARY)
    other = pick(2, DICTIONARY)
    third = pick(3, DICTIONARY)
    lead = F.concat(pick(4, ["", "the ", "it and ", "see ", "for of "]), pick(5, ["", "our ", "und ", "que "]))
    announce = pick(6, ["key", "api_key", "token", "secret", "password", "passwd", "client_secret", "auth_token", "pwd", "access_key"])
    assign = pick(7, ["=", " = ", ": ", '="', " = \"", ':"', "='"])
    quote = F.when(assign.contains('"'), '"').when(assign.contains("'"), "'").otherwise("")
    tail = F.concat(quote, pick(8, [" the", " on", "", " and of", " en"]))
    plain = pick(8, [" the", " on", "", " and of", " en", ". So"])
    camel = F.concat(word, F.initcap(other), F.initcap(third), number(9, 1, 99).cast("string"))
    snake = F.concat_ws("_", word, other, third, number(9, 1, 2000).cast("string"))
    path = F.concat(word, F.lit("/"), other, F.lit("/"), third, number(9, 1, 30).cast("string"))
    uuid = F.concat_ws("-", *(drawn(20 + k, hexes, F.lit(m)) for k, m in enumerate((8, 4, 4, 4, 12))))
    hash_word = pick(10, ["commit", "sha256", "md5", "checksum", "digest", "revision", "sha1", "hash"])
    kinds = [
        (1, F.concat(lead, announce, assign), drawn(30, hexes, number(31, 14, 64)), tail),
        (1, F.concat(lead, announce, assign), drawn(32, alnum, number(33, 16, 48)), tail),
        (1, lead, F.concat(F.lit("AKIA"), drawn(34, upper, F.lit(16))), plain),
        (1, lead, F.concat(pick(35, ["ghp_", "sk_live_", "glpat-", "xoxb-"]), drawn(36, alnum, number(37, 20, 40))), plain),
        (1, F.concat(lead, announce, assign), F.concat(drawn(38, alnum + "+/", number(39, 30, 60)), F.lit("==")), tail),
        (1, F.concat(lead, announce, assign), drawn(52, alnum + "!@#$%&*.", number(53, 7, 20)), tail),
        (1, F.concat(lead, announce, assign), F.concat(F.initcap(word), pick(54, ["!", "@", "#", "$", "&", "."]), other, number(55, 10, 9999).cast("string")), tail),
        (0, F.concat(lead, announce, assign), pick(56, ["required", "None", "null", "true", "string", "********", "<token>", "${TOKEN}", "getenv(NAME)", "todo", "your_password", "xxxxxxxx"]), tail),
        (0, F.concat(lead, announce, pick(57, [": ", " = "])), F.concat(word, pick(58, ["", "s", "-", "_"]), F.when(number(59, 0, 1) == 0, other).otherwise("")), plain),
        (0, F.concat(lead, pick(60, ["", "on ", "at "])), F.concat_ws("-", drawn(61, digits, F.lit(4)), drawn(62, digits, F.lit(2)), drawn(63, digits, F.lit(2))), plain),
        (0, lead, F.concat(word, number(64, 1, 9999).cast("string")), plain),
        (0, F.concat(lead, pick(11, ["", "card ", "order ", "number "])), drawn(40, digits, number(41, 12, 19)), plain),
        (0, F.concat(lead, hash_word, pick(12, [" ", ": ", "="])), drawn(42, hexes, number(43, 32, 64)), plain),
        (0, F.concat(lead, pick(13, ["", "uuid ", "id=", "request "])), uuid, plain),
        (0, F.concat(lead, pick(14, ["", "call ", "key: ", "token = "])), camel, plain),
        (0, F.concat(lead, pick(14, ["", "see ", "secret = ", "in "])), snake, plain),
        (0, F.concat(lead, pick(15, ["", "in ./", "https://site.org/", "src/"])), path, F.concat(pick(16, ["", ".py", ".java", ".html"]), plain)),
        (0, F.concat(lead, announce, assign), pick(17, ["xxxxxxxxxxxxxxxx1", "your-token-here-123", "EXAMPLEKEY1234567", "changeme-changeme1", "PLACEHOLDER_TOKEN_1", "aaaaaaaaaaaaaaa1"]), tail),
        (0, F.concat(lead, pick(18, ["tel ", "phone ", "+1 ", ""])), F.concat_ws("-", drawn(44, digits, F.lit(3)), drawn(45, digits, F.lit(3)), drawn(46, digits, F.lit(4))), plain),
        (0, lead, F.concat(word, other, third, number(9, 1, 99).cast("string")), F.concat(F.lit("@mail.org"), plain)),
        (0, lead, F.concat(drawn(47, digits, F.lit(4)), F.lit("-"), drawn(48, digits, F.lit(2)), F.lit("-"), drawn(49, digits, F.lit(2)), F.lit("T"), drawn(50, digits, F.lit(6))), plain),
    ]
    ids = spark.range(first, first + n, 1, 1)
    rows = None
    for k, (label, before, token, after) in enumerate(kinds):
        one = ids.where(F.col("id") % len(kinds) == k).select(before.alias("before"), token.alias("token"), after.alias("after"), F.lit(float(label)).alias("label"))
        rows = one if rows is None else rows.unionAll(one)
    # written, so that the features are taken of stored strings; one file: the forest does not depend on the cluster
    return Scratch(spark, "findings").write(rows.coalesce(1), "labelled")


def forest(findings: DataFrame):
    """A random forest over FEATURES of labelled findings, and the assembler of its input."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    table = findings.where("token is not null and label is not null")
    table = table.select(F.col("label").cast("double"), *(c.alias(k) for k, c in features(*(F.coalesce(c, F.lit("")) for c in ("before", "token", "after"))).items()))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(assembler.transform(table))
    return assembler, model


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, word, run, w, start, before, token, after: every candidate, its place in its word, and the neighbouring words."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(RUN) | F.col("text").rlike(rf"(?i:{ANNOUNCE})[\w\-]*[\"']?\s*[=:]"))
    # the words come out of a generator, so that the optimizer does not put the split into each lambda below
    rows = rows.select("doc_id", F.xxhash64("text").alias("row_hash"), F.explode(F.array(F.split("text", r"\s+"))).alias("words"))

    def near(i):
        return F.concat_ws(" ", F.coalesce(F.get("words", i - 2), F.lit("")), F.coalesce(F.get("words", i - 1), F.lit("")), F.lit(""))

    def may_hold(i):
        w = F.get("words", i)
        given = F.get("words", i - 1).rlike(r"[=:][\"']?$") & near(i).rlike(rf"(?i:{ANNOUNCE})[\w\-]*[\"']?\s*[=:][\"']?\s*$")
        return w.rlike(RUN) & w.rlike(LIKELY) | w.rlike(GIVES) | F.coalesce(given, F.lit(False))

    # only words that may hold a candidate are looked at further
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("words") - 1), may_hold)).where(F.size("at") > 0)
    each = F.transform("at", lambda i: F.struct(i.cast("int").alias("word"), F.get("words", i).alias("w"), near(i).alias("p"), F.coalesce(F.get("words", i + 1), F.lit("")).alias("q")))
    rows = rows.select("doc_id", "row_hash", F.explode(each).alias("n")).select("doc_id", "row_hash", "n.*")
    inside, given = F.col("w").rlike(INSIDE), F.col("p").rlike(rf"(?i:{ANNOUNCE})[\w\-]*[\"']?\s*[=:][\"']?\s*$") & F.col("w").rlike(ALONE)
    value = F.when(inside, F.lit(1)).when(given, F.lit(2)).otherwise(0)
    parts = F.when(value == 1, F.array(*(F.regexp_extract("w", INSIDE, k) for k in (1, 2)))).otherwise(F.array(*(F.regexp_extract("w", ALONE, k) for k in (1, 2))))
    rows = rows.withColumn("value", value).withColumn("parts", parts).withColumn("runs", F.regexp_extract_all("w", F.lit(RUN), 0)).withColumn("gaps", F.split("w", RUN))
    # a run starts after all gaps and runs before it
    starts = F.transform("runs", lambda _, k: F.aggregate(F.slice("gaps", F.lit(1), k + 1), F.lit(0), lambda n, g: n + F.length(g)) + F.aggregate(F.slice("runs", F.lit(1), k), F.lit(0), lambda n, r: n + F.length(r)))
    whole = F.array(F.struct(F.length(F.get("parts", F.lit(0))).alias("start"), F.get("parts", F.lit(1)).alias("token")))
    found = F.when(F.col("value") > 0, whole).otherwise(F.filter(F.arrays_zip(starts.alias("start"), F.col("runs").alias("token")), lambda r: r["token"].rlike(LIKELY)))
    rows = rows.select("doc_id", "row_hash", "word", "w", "p", "q", F.posexplode(found).alias("run", "r")).select("doc_id", "row_hash", "word", "run", "w", "p", "q", "r.start", "r.token")
    return rows.select(
        "doc_id", "row_hash", "word", "run", "w", "start", F.concat("p", F.substring(F.col("w"), F.lit(1), F.col("start"))).alias("before"), "token",
        F.concat(F.substring(F.col("w"), F.col("start") + F.length("token") + 1, F.length("w")), F.lit(" "), F.col("q")).alias("after"),
    )


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every candidate of every row of `docs`: doc_id, row_hash, word, run, w, start, token, probability, is_secret.

    `word` counts the text's words, `run` the candidates in one, which is `w`; the token starts `start` characters into it.
    Null, empty and plain texts give no rows, nor does an empty table. Repeated rows and ids give their findings each. Other
    columns are not read.
    """
    from pyspark.ml.functions import vector_to_array

    assembler, model = forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    found = candidates(docs)
    kept = ("doc_id", "row_hash", "word", "run", "w", "start", "token")
    ready = found.select(*kept, *(c.alias(k) for k, c in features(F.col("before"), F.col("token"), F.col("after")).items()))
    judged = model.transform(assembler.transform(ready)).withColumn("probability_of_secret", vector_to_array("probability")[1])
    p = F.round("probability_of_secret", 9)
    return judged.select(*kept, p.alias("probability"), (p >= threshold).alias("is_secret"))


def report(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """scan() without the tokens themselves: their lengths and sha256."""
    found = scan(docs, findings, threshold)
    return found.select("doc_id", "word", "run", F.length("token").alias("length"), F.sha2("token", 256).alias("token_sha256"), "probability", "is_secret")


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """`docs` with every secret in its text replaced where it stands; all rows, columns and other characters stay as they are."""
    found = scan(docs, findings, threshold).where("is_secret")
    key, changes = (next(f"{c}{'_' * k}" for k in range(99) if f"{c}{'_' * k}" not in docs.columns) for c in ("_key", "_changes"))
    # the words that hold secrets, from the last secret of a word to the first; a word's secrets lie in that word
    place = F.struct((-F.col("start")).alias("back"), F.length("token").alias("n"))
    by_word = found.groupBy("row_hash", "word", "w").agg(F.sort_array(F.collect_set(place)).alias("places"))
    clean = F.aggregate("places", F.col("w"), lambda t, x: F.concat(F.substring(t, F.lit(1), -x["back"]), F.lit(REPLACEMENT), F.substring(t, x["n"] - x["back"] + 1, F.length(t))))
    lists = by_word.groupBy(F.col("row_hash").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("word", clean.alias("clean")))).alias(changes))
    text = F.col("text").cast("string")
    joined = docs.withColumn(key, F.xxhash64(text)).join(lists, key, "left")
    words, spaces = F.split(text, r"\s+"), F.regexp_extract_all(text, F.lit(r"\s+"), 0)
    each = F.transform(F.arrays_zip(words.alias("w"), spaces.alias("s")), lambda x, i: F.concat(F.coalesce(F.try_element_at(F.col(changes), i), x["w"]), F.coalesce(x["s"], F.lit(""))))
    return joined.withColumn("text", F.when(F.col(changes).isNotNull(), F.array_join(each, "")).otherwise(F.col("text"))).select(*docs.columns)
