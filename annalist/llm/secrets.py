"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame and SQL functions only.

Candidates are values behind a name of secrets (quoted, with blanks or not, or up to white space), passwords in URLs,
long tokens with a digit or of mixed case, and quoted values of assignments. A forest judges each by length, character
transitions and classes, entropy, coverage by dictionary words, its path, and the words beside it. It is trained
from labelled findings: any table of (before, candidate, after, path, label). ``labelled_findings`` makes one of
fixed size from templates with known labels; a team's own triage results can take its place.

Defined results: null and empty texts have no findings; a null path says nothing; repeated rows are found
repeatedly; equal candidates of one text are separate findings, numbered in order; texts and candidates of any
length are taken whole; an empty table gives an empty table; other columns are ignored by ``scan`` and kept by
``redact``, where names that begin with ``_secret_`` are reserved.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import table

NAMED = r"(?i:token|secret|passwd|password|passphrase|pwd|api.?key|access.?key|private.?key|client.?key|auth|credentials?)[A-Za-z0-9_\-]{0,16}[\"']?\s{0,2}[:=]\s{0,2}"
#: In this order: the quoted and the unquoted value of a name, the password of a URL, a long token with a digit, one of mixed case, the quoted value of an assignment.
#: None begins inside a word; each has a short test that most places fail ahead of the look back for a name or over a token.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?:" + "|".join((
    rf"""(?<=["'])(?<=[:=]\s{{0,2}}["'])(?<={NAMED}["'])[^"'\n]{{4,}}+(?=["'])""",
    rf"""(?<=[:=\s])(?<=[:=]\s{{0,2}})(?<={NAMED})[^\s"':=][^\s"']*(?<![.,;)}}\]])""",
    r"""(?<=:)(?<=://[^\s:/@]{0,64}:)[^\s/@]++(?=@)""",
    r"""(?=[A-Za-z0-9+/_\-]{16})(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}""",
    r"""(?=[A-Za-z+/_\-]{20})(?=[a-z+/_\-]*+[A-Z])(?=[A-Z+/_\-]*+[a-z])[A-Za-z+/_\-]{20,}+={0,2}""",
    r"""(?<=[:=]\s{0,2}["'])[^"'\s]{8,}+(?=["'])""",
)) + ")"
BESIDE = 48
TREES, DEPTH, SEED, THRESHOLD = 40, 8, 7, 0.5
#: Labelled rows made for training.
FINDINGS = 4_000
MASK = "[SECRET]"
#: Words that name a secret, words that name something else, words of placeholders, paths of each kind.
NAMES = "token|secret|passw|pwd|api.?key|access.?key|auth|credential|private|bearer|client.?key"
OTHERS = "commit|sha1|sha256|sha512|md5|checksum|hash|digest|integrity|uuid|guid|revision|etag|version|card|phone|serial|build|order|invoice|trace"
PLACEHOLDERS = "example|sample|your|test|dummy|placeholder|change|fake|here|insert|foo|bar|todo|none|null|xxx+|abc|123|key|token|secret|password|name|value|path|file|lib|user|home|python|function|package|module|class|index|data|http|www"
TEST_PATHS = "test|example|fixture|sample|mock|docs?/|lock|vendor"
CONFIG_PATHS = r"\.env|\.ya?ml|\.ini|\.cfg|\.toml|\.properties|config|deploy|credential"
PREFIXES = "^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|AIza|sk_live_|rk_live_|glpat-|eyJ)"
BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
TRANSITION = "(?<=[A-Za-z])(?=[^A-Za-z])|(?<=[^A-Za-z])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """What the forest sees, by name."""
    size = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    low, near = F.lower(candidate), F.lower(F.concat_ws(" ", before, after))
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    flag = lambda c, p: F.coalesce(c.rlike(p), F.lit(False)).cast("double")
    # Equal characters put together are runs; their lengths give the entropy of a candidate of any length.
    kinds = F.regexp_extract_all(F.array_join(F.array_sort(F.split(candidate, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    entropy = F.aggregate(F.transform(kinds, lambda k: F.length(k) / size), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return {
        "size": size,
        "digits": count(candidate, "[0-9]") / size,
        "upper": count(candidate, "[A-Z]") / size,
        "lower": count(candidate, "[a-z]") / size,
        "transitions": count(candidate, TRANSITION) / size,
        "bigrams": count(low, BIGRAMS) / size,
        "kinds": F.size(kinds) / F.least(size, F.lit(64.0)),
        "entropy": entropy,
        "dictionary": 1.0 - F.length(F.regexp_replace(low, PLACEHOLDERS, "")) / size,
        "hex": flag(candidate, "^[0-9a-fA-F]+$"),
        "number": flag(candidate, r"^[0-9+\-]+$"),
        "uuid": flag(low, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "prefix": flag(candidate, PREFIXES),
        "slashes": count(candidate, "/") / size,
        "assigned": flag(before, r"[:=]\s{0,2}[\"']?$"),
        "quoted": flag(before, "[\"']$"),
        "value_of": flag(before, NAMED + "[\"']?$"),
        "url": flag(before, r"://[^\s:/@]*:$"),
        "symbols": count(candidate, r"[^A-Za-z0-9\s]") / size,
        "blanks": count(candidate, r"\s") / size,
        "named": flag(near, NAMES),
        "other": flag(near, OTHERS),
        "test_path": flag(F.lower(path), TEST_PATHS),
        "config_path": flag(F.lower(path), CONFIG_PATHS),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``n`` labelled findings from templates; digests of the row number stand for random material."""
    rows = spark.range(n).select("id", F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")), 512).alias("x"), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 512).alias("y"))
    b64 = F.regexp_replace(F.base64(F.unhex("y")), "[+/=\\s]", "")
    digits = F.translate("x", "abcdef", "482619")
    uuid = F.concat_ws("-", *(F.substring("x", a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    name = pick(["token", "api_key", "secret", "password", "client_secret", "auth_token", "access_key", "credentials"], "n")
    lead = pick(["", "the value of ", "set ", "export ", "re and it ", "la de que ", "config. "], "l")
    assign = lambda q: F.concat(lead, name, F.lit(q))
    words = F.concat_ws("_", pick(["your", "my", "example", "sample", "test", "dummy"], "w"), name, pick(["here", "value", "placeholder", "123456", "changeme"], "v"))
    words_of = lambda salt: pick(["correct", "horse", "battery", "staple", "river", "window", "purple", "monkey", "garden", "silver", "winter", "candle"], salt)
    common = lambda salt: pick(["the", "is", "that", "required", "and", "field", "must", "string", "None", "str", "True", "for", "reset", "user"], salt)
    loud = lambda salt: F.concat(F.initcap(words_of(salt)), F.substring(digits, 3, 2), pick(["&", "!", "$", "#", "%", "^", "*"], salt + "s"), F.substring(b64, 9, 5), pick(["", "!", "?", "z"], salt + "e"))
    letters = F.translate(b64, "0123456789", "kQwZrTnLxB")
    env = F.concat(pick(["DB_PASSWORD", "password", "AWS_SECRET", "SECRET_KEY", "passwd", "PWD", "db_pwd", "api_key"], "v1"), pick(["=", ": ", " = "], "v2"))
    url = F.concat(lead, pick(["postgres", "https", "mysql", "redis", "amqp", "ftp"], "u1"), F.lit("://"), pick(["app", "admin", "root", "", "svc"], "u2"), F.lit(":"))
    yes = [
        (F.concat(lead, env), loud("k1"), "\n"), (F.concat(lead, env), F.concat(words_of("k2"), F.substring(digits, 5, 1), F.substring(b64, 20, 5)), " "), (F.concat(lead, env), F.substring(letters, 1, 40), "\n"), (F.concat(lead, env), loud("k7"), ""),
        (url, F.concat(F.substring(b64, 4, 11)), "@host/db"), (url, loud("k3"), "@localhost"), (F.concat(lead, env, F.lit('"')), F.concat_ws(" ", words_of("k4"), words_of("k5"), words_of("k6")), '"'), (F.concat(lead, env), F.substring(letters, 7, 24), " "),
        (assign(' = "'), F.substring("x", 1, 40), '"'), (assign(' = "'), F.substring("x", 2, 40), '" and'),
        (assign(' = "'), F.substring("x", 1, 40), '"'), (assign(': "'), F.substring(b64, 1, 40), '"'), (assign("="), F.substring(b64, 5, 24), "\n"), (assign(' = "'), F.substring("y", 1, 64), '" '),
        (F.concat(lead, F.lit("aws_access_key_id = ")), F.concat(F.lit("AKIA"), F.upper(F.substring(b64, 3, 16))), "\n"), (F.concat(lead, F.lit("authorization: bearer ")), F.concat(F.lit("eyJ"), F.substring(b64, 1, 60)), " "),
        (assign(" = '"), F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), "'"), (assign(' = "'), F.substring("x", 9, 32), '" er '),
    ]
    camel = F.concat_ws("", *(F.initcap(words_of(f"c{i}")) for i in range(4)))
    no = [
        (F.concat(lead, env), common("d1"), " "), (F.concat(lead, env), F.concat(common("d2"), F.lit("_"), common("d3")), "\n"), (F.concat(lead, env), F.concat(pick(["os.environ[", "getenv(", "${", "<your_", "request.form["], "d4"), name), "]"), (lead, camel, "("),
        (F.concat(lead, F.lit("class ")), F.concat(camel, F.lit("Factory")), ":"), (lead, F.concat_ws("/", words_of("c5"), F.initcap(words_of("c6")), words_of("c7"), words_of("c8")), "."), (F.concat(lead, env, F.lit('"')), F.concat_ws(" ", F.lit("Enter your"), name, common("d5")), '"'), (url, pick(["password", "pass", "<password>", "${PASSWORD}", "yourpassword", "changeme"], "d6"), "@host"),
        (F.concat(lead, F.lit("commit ")), F.substring("x", 1, 40), "\n"), (F.concat(lead, F.lit("sha256: ")), F.substring("y", 1, 64), " "), (F.lit('"integrity": "'), F.concat(F.lit("sha512-"), b64), '"'), (F.concat(lead, F.lit('uuid = "')), uuid, '"'),
        (lead, F.substring(digits, 1, 16), " the"), (lead, F.substring(digits, 5, 16), F.concat(F.lit(" on "), name, F.lit(' = "'))), (assign(' = "'), words, '"'), (assign(' = "'), F.concat(F.repeat(F.lit("x"), 20), F.substring(digits, 1, 2)), '"'), (F.concat(lead, F.lit("def ")), F.concat(words, F.lit("_function_2")), "("),
        (lead, F.concat(F.lit("/usr/lib/python3/"), words), " "), (F.concat(lead, F.lit('etag: "')), F.substring("x", 3, 32), '"'), (F.concat(lead, F.lit("card ")), F.substring(digits, 7, 16), "."), (F.concat(lead, F.lit('checksum = "')), F.substring("y", 1, 40), '"'),
    ]
    case = lambda options: [F.struct(b.alias("before"), c.alias("candidate"), (a if isinstance(a, Column) else F.lit(a)).alias("after")) for b, c, a in options]
    choose = lambda options, salt: F.element_at(F.array(*case(options)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    label = F.col("id") % 2
    good = pick(["src/config/prod.env", "deploy/app.yml", "settings.ini", "src0", "main.py", "notes.txt"], "p")
    bad = pick(["tests/test_auth.py", "docs/example.md", "package-lock.json", "src0", "main.py", "notes.txt"], "q")
    return rows.select(F.when(label == 1, choose(yes, "y")).otherwise(choose(no, "o")).alias("f"), F.when(label == 1, good).otherwise(bad).alias("path"), label.cast("double").alias("label")).select("f.*", "path", "label")


def with_features(df: DataFrame, path: Column) -> tuple[DataFrame, list[str]]:
    own = features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), path)
    return df.select("*", *(c.cast("double").alias(f"f_{k}") for k, c in own.items())), [f"f_{k}" for k in own]


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from labelled findings (before, candidate, after, path, label 0.0 or 1.0)."""
    rows, names = with_features(findings.filter("candidate IS NOT NULL AND label IS NOT NULL"), F.col("path"))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label").coalesce(2)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows)


_standard: dict[str, RandomForestClassificationModel] = {}


def standard(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest of ``labelled_findings``, which are the same each time; so an application trains it once."""
    name = spark.sparkContext.applicationId
    if name not in _standard:
        _standard.clear()
        _standard[name] = train(labelled_findings(spark))
    return _standard[name]


def candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that have candidates, with a key, the text between candidates and the candidates."""
    rows = df.filter(F.col(text_col).rlike(CANDIDATE))
    return rows.withColumns({"_secret_key": F.monotonically_increasing_id(), "_secret_pieces": F.split(text_col, CANDIDATE, -1), "_secret_found": F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0))})


def scored(rows: DataFrame, model: RandomForestClassificationModel, path: Column, keep: list[str]) -> DataFrame:
    """A row for each candidate of ``rows``: the columns ``keep``, nth, ahead (characters since the candidate before), candidate, score.

    A row holds what stands beside its candidate, never the text, so the work is linear in a text's candidates.
    """
    beside = F.transform("_secret_pieces", lambda p: F.struct(F.right(p, F.lit(BESIDE)).alias("tail"), F.left(p, F.lit(BESIDE)).alias("head"), F.length(p).alias("size")))
    rows = rows.select(*keep, path.alias("path"), beside.alias("pieces"), F.col("_secret_found").alias("found"))
    nth = F.posexplode(F.arrays_zip(F.col("found").alias("candidate"), F.slice("pieces", 1, F.size("found")).alias("before"), F.slice("pieces", 2, F.size("found")).alias("after")))
    out = rows.select(*keep, "path", nth.alias("nth", "x"))
    out = out.select(*keep, "path", "nth", F.col("x.before.size").cast("long").alias("ahead"), "x.candidate", F.col("x.before.tail").alias("before"), F.col("x.after.head").alias("after"))
    out, names = with_features(out, F.col("path"))
    out = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(out)
    return model.transform(out).select(*keep, "nth", "ahead", "candidate", vector_to_array("probability")[1].alias("score"))


def scan(df: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row for each secret: doc_id, nth, start (characters before it), candidate, score."""
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))
    found = scored(candidates(own), model, F.col("path"), ["doc_id", "_secret_key"])
    upto = Window.partitionBy("_secret_key").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("ahead") + F.length("candidate")).over(upto) - F.length("candidate")
    return found.withColumn("start", start.cast("long")).filter(F.col("score") >= THRESHOLD).select("doc_id", "nth", "start", "candidate", "score")


def redact(df: DataFrame, model: RandomForestClassificationModel, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``df`` with every secret replaced by a mask. Only rows with candidates are dealt out anew."""
    names = df.columns
    some = table(candidates(df, text_col), "secret-candidates")
    marks = scored(some, model, F.col(path_col).cast("string"), ["_secret_key"])
    marks = marks.groupBy(F.col("_secret_key").alias("_secret_of")).agg(F.sort_array(F.collect_list(F.struct("nth", (F.col("score") >= THRESHOLD).alias("hit")))).alias("_secret_marks"))
    shown = F.zip_with("_secret_found", "_secret_marks", lambda c, m: F.when(m["hit"], F.lit(MASK)).otherwise(c))
    text = F.array_join(F.zip_with("_secret_pieces", shown, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    changed = some.join(marks, F.col("_secret_key") == F.col("_secret_of")).withColumn(text_col, text).select(*names)
    return df.filter(~F.coalesce(F.col(text_col).rlike(CANDIDATE), F.lit(False))).select(*names).unionByName(changed)


def digest(df: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Secrets by document, without the secret itself."""
    return scan(df, model).select("doc_id", "nth", "start", F.length("candidate").alias("n_chars"), F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"), "score")
