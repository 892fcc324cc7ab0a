"""Secret scans: patterns propose, a random forest removes false findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.text import let

# What a candidate looks like, by rule, tried in this order.
RULES = {
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    "cloud_key_id": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "code_host_token": r"\bgh[pousr]_[A-Za-z0-9]{30,}",
    "chat_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "payment_key": r"\bsk[-_](?:live[-_]|test[-_]|proj[-_])?[A-Za-z0-9]{16,}",
    "assignment": r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?[^ \t\r\n\"',;]{6,}",
    "random_string": r"\b(?=[A-Za-z+/_-]{0,60}[0-9])[A-Za-z0-9+/_-]{20,}={0,2}",
}
# Words whose presence makes a candidate look written rather than drawn.
WORDS = (
    "password secret token example sample default change change_me changeme placeholder dummy test demo fake your here value string "
    "config admin root user name login public private key access api service server client local host database production staging "
    "insert replace enter none null true false todo foobar qwerty letmein welcome hello world super master system account email "
    "image file path version release build index table column select where from with this that have will must should could would "
    "data time date year month number long short first last next open close read write send hash code text html json http https www com"
)
NEAR_SECRET = r"(?i)\b(key|keys|password|passwd|pwd|secret|token|credential|credentials|auth|bearer|login|export|aws)\b"
NEAR_FALSE = r"(?i)\b(example|sample|placeholder|dummy|test|tests|fake|your|demo|documentation|redacted|mock)\b"
NEAR_DIGEST = r"(?i)\b(sha1|sha256|sha512|md5|commit|checksum|digest|uuid|guid|hash|revision|etag|integrity|fingerprint|build)\b"
PATH_FALSE = r"(?i)(test|example|sample|doc|fixture|mock|demo|tutorial)"
PATH_CONF = r"(?i)(config|\.env|secret|prod|deploy|settings|credentials)"
_ANY = "|".join(RULES.values())
FEATURES = ["length", "runs", "digits", "uppers", "signs", "distinct", "bigrams", "steps", "repeats", "dictionary", "hexadecimal", "path_false", "path_conf", "near_secret", "near_false", "near_digest", "rule"]


def _before_each(sizes: Column, block: int = 64) -> Column:
    """For each of an array of longs the sum of those before it.

    Sums start anew in blocks, on which the blocks' own sums are put; so the work is that of the array's
    length times half a block, not its square.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(block))
    running = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["all"], a["sum"]).alias("all"))
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))

    def put(parts: Column, base: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda _, i: F.get(base, k) + total(F.slice(p, F.lit(1), i)))))

    def cut_up(parts: Column) -> Column:
        return let(F.aggregate(F.transform(parts, total), none, running, lambda a: a["all"]), lambda base: put(parts, base))

    return let(F.transform(starts, lambda s: F.slice(sizes, s, F.lit(block))), cut_up)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, nth, start, candidate, before, after, path): every match of a rule, with its neighbourhood.

    A text's findings are made as one array, each with no more of the text than its neighbourhood, before they
    become rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), path.alias("path")).where(F.col("text").rlike(_ANY))

    def findings(gaps: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda x, i: (F.char_length(F.get(gaps, i)) + F.char_length(x)).cast("long"))
        one = lambda x, i, ahead: F.struct((F.get(ahead, i) + F.char_length(F.get(gaps, i))).alias("start"), x.alias("candidate"), F.right(F.get(gaps, i), F.lit(60)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(60)).alias("after"))
        return let(let(sizes, lambda s: _before_each(s)), lambda ahead: F.transform(found, lambda x, i: one(x, i, ahead)))

    each = let(F.split("text", _ANY, -1), lambda gaps: let(F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)), lambda found: findings(gaps, found)))
    return rows.select("doc_id", "path", F.posexplode(each).alias("nth", "f")).select("doc_id", "nth", "f.*", "path")


def _rule(candidate: Column) -> Column:
    out = F.lit(len(RULES))
    for k, pattern in reversed(list(enumerate(RULES.values()))):
        out = F.when(candidate.rlike(f"^(?:{pattern})"), k).otherwise(out)
    return out


def featured(rows: DataFrame) -> DataFrame:
    """rows with value (the candidate without the name it is given to) and FEATURES as doubles."""
    rows = rows.withColumn("rule", _rule(F.col("candidate")).cast("double"))
    assignment = float(list(RULES).index("assignment"))
    value = F.when(F.col("rule") == assignment, F.regexp_replace("candidate", r"^[^:=]*[:=][ \t]*[\"']?", "")).otherwise(F.col("candidate"))
    rows = rows.withColumn("value", value).withColumn("length", F.char_length("value").cast("double"))
    n = F.greatest(F.col("length"), F.lit(1.0))
    without = lambda pattern: F.char_length(F.regexp_replace("value", pattern, ""))
    pairs = F.when(F.col("length") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("length").cast("int") - 1, F.lit(1))), lambda i: F.col("value").substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("pairs", pairs)
    of_pairs = lambda test: F.size(F.filter("pairs", test)) / F.greatest(F.size("pairs"), F.lit(1))
    step = lambda p: F.ascii(F.substring(p, 2, 1)) - F.ascii(F.substring(p, 1, 1))
    flag = lambda c: c.cast("double")
    listed = "|".join(sorted(WORDS.split(), key=lambda w: (-len(w), w)))
    around = F.concat_ws(" ", "before", "after")
    return rows.withColumns({
        "runs": F.char_length(F.regexp_replace("value", "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x")) / n,
        "digits": 1 - without("[0-9]") / n,
        "uppers": 1 - without("[A-Z]") / n,
        "signs": without("[A-Za-z0-9]") / n,
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "bigrams": F.size(F.array_distinct("pairs")) / n,
        "steps": of_pairs(lambda p: step(p) == 1),
        "repeats": of_pairs(lambda p: step(p) == 0),
        "dictionary": 1 - F.char_length(F.regexp_replace(F.lower("value"), listed, "")) / n,
        "hexadecimal": flag(F.col("value").rlike("^[0-9a-f-]+$")),
        "path_false": flag(F.col("path").rlike(PATH_FALSE)),
        "path_conf": flag(F.col("path").rlike(PATH_CONF)),
        "near_secret": flag(F.concat_ws(" ", "before", "candidate").rlike(NEAR_SECRET)),
        "near_false": flag(around.rlike(NEAR_FALSE)),
        "near_digest": flag(around.rlike(NEAR_DIGEST)),
    }).drop("pairs")


def labelled_findings(spark: SparkSession, rows: int = 6000, seed: int = 1) -> DataFrame:
    """(candidate, before, after, path, label): findings made by rule, half of them real secrets.

    Real ones are drawn from the alphabets of their kinds and stand in any text. False ones are written by
    hand or have another use: examples, placeholders, counters, repeated signs, references to variables,
    digests, identifiers.
    """
    draw = lambda *k: F.xxhash64(F.lit(seed), F.col("id"), *[F.lit(x) if not isinstance(x, Column) else x for x in k])

    def pick(items: list[str], k: str) -> Column:
        return F.element_at(F.array(*map(F.lit, items)), (F.pmod(draw(k), F.lit(len(items))) + 1).cast("int"))

    def drawn(alphabet: str, length: Column | int, k: str) -> Column:
        each = F.transform(F.sequence(F.lit(1), length if isinstance(length, Column) else F.lit(length)), lambda i: F.substring(F.lit(alphabet), (F.pmod(draw(k, i), F.lit(len(alphabet))) + 1).cast("int"), 1))
        return F.array_join(each, "")

    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum, hexa = upper + lower + digit, "0123456789abcdef"
    some = lambda low, high, k: (F.pmod(draw(k), F.lit(high - low + 1)) + low).cast("int")
    word = lambda k: pick(WORDS.split(), k)
    name = pick(["password=", "password: ", "secret=", "token=", "api_key=", "apikey: ", "PASSWORD=", "access_key = ", "pwd="], "name")
    real = [
        F.concat(F.lit("AKIA"), drawn(upper + digit, 16, "a")),
        F.concat(F.lit("AKIA"), drawn(upper + "234567", 16, "a2")),
        F.concat(F.lit("ghp_"), drawn(alnum, 36, "b")),
        F.concat(F.lit("xoxb-"), drawn(digit, 12, "c"), F.lit("-"), drawn(alnum, 24, "d")),
        F.concat(F.lit("sk_live_"), drawn(alnum, some(24, 32, "e1"), "e")),
        F.concat(name, drawn(hexa, some(12, 40, "f1"), "f")),
        F.concat(name, drawn(alnum + "!#%+/_-", some(10, 40, "g1"), "g")),
        F.concat(F.lit("eyJ"), drawn(alnum, 30, "h"), F.lit(".eyJ"), drawn(alnum, 60, "i"), F.lit("."), drawn(alnum + "_-", 43, "j")),
        drawn(alnum + "+/", some(32, 64, "k1"), "k"),
        F.lit("-----BEGIN RSA PRIVATE KEY-----"),
    ]
    false = [
        F.concat(F.lit("AKIA"), F.substring(F.upper(F.concat(word("l"), word("m"), word("n"), word("o"), F.lit("EXAMPLEEXAMPLEEXAMPLE"))), 1, 16)),
        F.concat(name, word("p"), F.lit("_"), word("q")),
        F.concat(name, word("p2"), word("q2"), drawn(digit, some(1, 4, "r1"), "r")),
        F.concat(name, F.lit("${"), F.upper(word("s")), F.lit("_"), F.upper(word("t")), F.lit("}")),
        F.concat(name, F.lit("<your_"), word("u"), F.lit(">")),
        F.concat(name, F.repeat(pick(["x", "*", "0", "X", "."], "v"), some(8, 24, "v1"))),
        F.concat(pick(["AKIA", "ghp_", "sk_test_", "token="], "w"), F.repeat(F.lit("abcdefghij0123456789"), 2)),
        F.concat(F.lit("ghp_"), F.repeat(pick(["x", "X", "0", "a"], "w1"), 36)),
        drawn(hexa, F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), some(1, 3, "y1")), "y"),
        F.concat(drawn(hexa, 8, "z1"), F.lit("-"), drawn(hexa, 4, "z2"), F.lit("-4"), drawn(hexa, 3, "z3"), F.lit("-a"), drawn(hexa, 3, "z4"), F.lit("-"), drawn(hexa, 12, "z5")),
        F.concat_ws("-", word("aa"), word("ab"), word("ac"), word("ad"), drawn(digit, 2, "ae")),
        F.concat_ws("/", word("ba"), word("bb"), word("bc"), drawn(digit, 4, "bd"), word("be")),
        F.concat_ws("_", F.upper(word("ca")), F.upper(word("cb")), F.upper(word("cc")), drawn(digit, 1, "cd"), F.upper(word("ce"))),
    ]
    digest = F.lit(False)
    k_false = F.pmod(draw("kind"), F.lit(len(false)))
    digest = k_false.isin(8, 9)
    is_real = F.col("id") % 2 == 0
    plain = pick(["of the on", "and in", "der die", "que la", "est le", "it was", "thndea", "", "the"], "plain")
    helped = pick(["export the key", "login with password", "the api key is", "aws credentials", "auth bearer"], "helped")
    hint = pick(["for example", "your key here", "a placeholder", "test value", "sample config", "dummy", "of the", "and in", ""], "hint")
    about = pick(["commit", "sha256", "md5 checksum", "uuid", "etag", "build revision", "integrity hash"], "about")
    before = F.when(is_real, F.when(F.pmod(draw("h"), F.lit(3)) == 0, helped).otherwise(plain)).otherwise(F.when(digest, about).otherwise(hint))
    path = F.when(is_real, pick(["src1", "config/prod.env", "deploy/settings.py", "", "web", "notes.txt"], "path")).otherwise(pick(["src1", "tests/test_login.py", "docs/example.md", "", "web", "notes.txt"], "path"))
    choose = lambda options, k: F.element_at(F.array(*options), (k + 1).cast("int"))
    return spark.range(0, rows, 1, 1).select(
        F.when(is_real, choose(real, F.pmod(draw("real"), F.lit(len(real))))).otherwise(choose(false, k_false)).alias("candidate"),
        F.concat(before, F.lit(" ")).alias("before"), F.concat(F.lit(" "), plain).alias("after"), path.alias("path"),
        is_real.cast("double").alias("label"),
    )


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def fit_forest(findings: DataFrame, trees: int = 40, depth: int = 9, seed: int = 3):
    """A random forest over FEATURES from labelled findings, a table of bounded size."""
    from pyspark.ml.classification import RandomForestClassifier

    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=4, seed=seed)
    return forest.fit(_vectors(featured(findings)).select("features", "label").coalesce(1))


def scored(rows: DataFrame, model) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(_vectors(featured(rows))).withColumn("score", vector_to_array("probability")[1])


def secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, start, length, rule, value, score, predicted): all findings and whether they are secrets.

    start and length are in code points of the text; value is what would be redacted. Findings that the
    forest takes for false have predicted 0. Without `findings` the forest learns from labelled_findings().
    Null and empty texts have no findings; null ids stay null; equal rows have equal findings, each its own rows;
    an empty table has none. A score at the threshold counts as a secret. A path column that is not there counts
    as empty. A long text or one of many findings takes time in proportion to both.

    All in Spark's own functions, one pass without a shuffle: texts without a match stop at the first look.
    The forest is a few thousand nodes, whatever the input.
    """
    model = fit_forest(findings if findings is not None else labelled_findings(docs.sparkSession))
    out = scored(candidates(docs, id_col, text_col, path_col), model)
    rule = F.element_at(F.array(*map(F.lit, [*RULES, "other"])), (F.col("rule") + 1).cast("int"))
    ahead = F.char_length("candidate") - F.char_length("value")
    return out.select("doc_id", (F.col("start") + ahead).alias("start"), F.char_length("value").alias("length"), rule.alias("rule"), "value", F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted"))
