"""Operator 10 - secret scans with a random forest against false positives (DataFrame functions only).

One regular expression finds candidates in whole texts: assigned values (``name = "value"``), published token formats and
private keys, header to end.  Each candidate is described by its length, character classes, how usual its character transitions are,
dictionary coverage, the path it came from and its neighbouring words; the dictionary is the corpus's own, its commonest words by the
number of texts that hold them (counted over all texts, DICTIONARY_WORDS kept), and transitions are those of its letters; a random forest trained from labelled findings removes false positives.
The forest is a literal (arrays of feature, threshold and leaf) that a SQL higher-order expression walks, so scanning,
describing, scoring and redacting stay in the JVM; only the small, bounded set of labelled findings comes to the driver
for training (``MAX_FINDINGS``).

Edge cases: null and empty texts have no findings and stay as they are; a null path counts as no path; equal candidates in
one text are findings each; rows may repeat; an empty table gives an empty result; other columns are kept (``findings`` and ``redacted`` are replaced).
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without
from .fingerprints import bind

MAX_FINDINGS, TREES, DEPTH, NEAR, DICTIONARY_WORDS = 4000, 32, 7, 48, 4000
#: Published shapes of credentials, and values assigned to a name.
#: Names of credentials, and what stands between a name and its value.  Bounded, for looking behind.
NAMED = r"(?i:token|secret|passphrase|passwd|password|pwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key)"
ASSIGNED = NAMED + r"[\"']?(?:[ \t]{0,8}(?:=>|:=|[=:])[ \t]{0,8}|[ \t]{1,8}(?i:is)[ \t]{1,8})"
LINE_END = r"(?:[\r\n]|\\[rn])"
#: A private key reaches to its END line or, without one, to the end of its base64 lines.  Line ends may be escaped.
PRIVATE_KEY = (
    r"-----BEGIN [0-9A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]++|-(?!----))*+-----END [0-9A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:(?:[ \t]*+{LINE_END}[ \t]*+[A-Z][0-9A-Za-z-]*+: [^\r\n]*+)*+(?:(?:\s|\\[rn])++[0-9A-Za-z+/]{{40,}}+={{0,2}}+)++(?:[ \t]*+{LINE_END}++[ \t]*+[0-9A-Za-z+/]++={{0,2}}+(?=[ \t]*(?:{LINE_END}|[\"']|$)))?+)?+)"
)
SHAPES = (
    PRIVATE_KEY,
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
    r"\bglpat-[0-9A-Za-z_-]{20,}\b",
    r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    r"\bnpm_[0-9A-Za-z]{36}\b",
    r"\bsk-[0-9A-Za-z_-]{20,}",
    r"\bSG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}",
    r"https://hooks\.slack\.com/services/[0-9A-Za-z/]{20,}",
    r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    # Any value assigned to the name of a credential; the short first look behind spares the long one.
    rf"(?<=\")(?<={ASSIGNED}\")[^\r\n\"]{{6,}}(?=\")",
    rf"(?<=')(?<={ASSIGNED}')[^\r\n']{{6,}}(?=')",
    rf"(?<=[=:> \t])(?<={ASSIGNED}|(?i:bearer|authorization: basic)[ \t]{{1,8}})[^\s\"',;<>()\[\]{{}}=:][^\s\"',;<>()\[\]{{}}]{{5,}}",
    r"(?<=[:=] ?[\"'])[0-9A-Za-z+/_=.~-]{12,}(?=[\"'])",
    r"(?<=[0-9A-Za-z_](?: = |=|: ))[0-9A-Za-z+/_~-]{16,}={0,2}(?![0-9A-Za-z+/_~-])",
    r"\b(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}\b",
    # The password of an address, between the user's name and the host.
    r"(?<=://[^\s:/@]{0,64}:)[^\s:/@\"']{3,}(?=@)",
)
#: So many of them are published formats.
PUBLISHED = 12
CANDIDATE = "|".join(SHAPES)
#: What any text with a candidate holds: one of these strings, or a match of MAYBE.  Cheap to test, and never stricter.
LITERALS = ("://", "-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "npm_", "sk-", "SG.", "k_live_", "k_test_", "AIza", "eyJ")
MAYBE = rf"{ASSIGNED}|(?i:bearer|authorization: basic)[ \t]|" + r"[\"'][0-9A-Za-z+/_=.~-]{12}|[=:] ?[0-9A-Za-z+/_~-]{16}|[0-9A-Fa-f]{32}"
#: Names beside which a value is likely a credential, and those beside which it is likely not.
NAMES = r"(?i)(?:token|secret|passphrase|authorization: basic|bearer|passwd|password|pwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key)[\"']?\s*(?:=|:|=>|is)?\s*[\"']?$"
BENIGN = r"(?i)(?:commit|sha\d*|md5|digest|checksum|hash|revision|uuid|guid|etag|integrity|example|sample|placeholder|order|serial|invoice|build|version|id)[\"']?\s*(?:=|:|=>|is)?\s*[\"']?$"
TEST_PATH = r"(?i)(?:test|spec|example|sample|fixture|mock|doc)"
#: Words that make a value readable.
DICTIONARY = ("the", "and", "ing", "ion", "test", "exam", "your", "here", "pass", "word", "change", "place", "holder", "value", "name", "data", "user", "file", "path", "dummy", "sample", "null", "none", "default", "config", "string", "insert")
FEATURES = ("words", "usual", "length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "coverage", "hex", "named", "benign", "test_path", "shaped", "slashes", "address")


class Dictionary:
    """Words, and how usual it is that one letter follows another in them (log2 of the share, in bits, letter a = 0)."""

    def __init__(self, words: list[str]):
        self.words = sorted({*DICTIONARY, *words})
        counts = np.full((26, 26), 0.5)
        for w in self.words:
            for a, b in zip(w, w[1:], strict=False):
                counts[ord(a) - 97, ord(b) - 97] += 1
        self.follows = np.log2(counts / counts.sum(axis=1, keepdims=True)).ravel().round(3).tolist()


def corpus_dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> Dictionary:
    """The commonest words of four to twelve letters, by the number of texts that hold them; ties by the word."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z]+"), lambda w: F.length(w).between(4, 12)))
    counted = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return Dictionary([r.w for r in counted.where("n > 1").orderBy(F.desc("n"), "w").limit(most).collect()])


def features(value: Column, before: Column, after: Column, path: Column, known: Dictionary) -> Column:
    """An array of doubles, in the order of FEATURES."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    rate = lambda p: F.regexp_count(value, F.lit(p)) / n
    kind = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a"), "\n", "")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    parts = F.filter(F.split(F.lower(value), "[^a-z]+"), lambda w: w.isin(*known.words))
    letters = F.split(F.regexp_replace(F.lower(value), "[^a-z]", ""), "")
    follows = F.array(*[F.lit(x) for x in known.follows])
    place = lambda c: F.ascii(c) - 97
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.coalesce(F.get(follows, place(a) * 26 + place(b)), F.lit(0.0)))
    mean = lambda p: F.coalesce(F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(p), F.lit(0)), F.lit(0.0))
    return F.array(
        F.aggregate(parts, F.lit(0), lambda s, w: s + F.length(w)) / n,
        bind(bind(letters, pairs), mean),
        n,
        rate("[0-9]"),
        rate("[A-Z]"),
        rate("[a-z]"),
        rate("[^0-9A-Za-z]"),
        F.length(kind) / n,
        F.size(F.array_distinct(F.split(value, ""))) / n,
        F.length(F.regexp_replace(F.lower(value), "(?:" + "|".join(DICTIONARY) + ")", "")) / n * -1 + 1,
        flag(F.rlike(value, F.lit("^[0-9A-Fa-f]+$"))),
        flag(F.rlike(before, F.lit(NAMES))),
        flag(F.rlike(before, F.lit(BENIGN)) | F.rlike(F.left(after, F.lit(12)), F.lit(r"(?i)^[\"']?\s*(?:is (?:an? )?(?:example|sample|hash)|#\s*(?:example|sample))"))),
        flag(F.rlike(path, F.lit(TEST_PATH))),
        flag(F.rlike(value, F.lit("^(?:" + "|".join(SHAPES[:PUBLISHED]) + ")"))),
        rate("/"),
        flag(F.rlike(before, F.lit("://[^\\s:/@]*:$")) & F.startswith(after, F.lit("@"))),
    )


def labelled_findings(spark: SparkSession, n: int = 2400, seed: int = 5, known: Dictionary | None = None) -> DataFrame:
    """Findings (value, before, after, path, label) written by rule from the seed: the default training set, ``n`` rows."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, full = digit + "abcdef", low + up + digit
    real = (known or Dictionary([])).words
    chosen_words = [w for w in real if w not in DICTIONARY]  # nobody's passphrase is made of placeholders
    word = lambda: rnd.choice(real) if rnd.random() < 0.5 else pick(low, rnd.randint(2, 8))

    def private_key() -> str:
        kind = rnd.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])
        body = "".join(pick(full + "+/", 64) + "\n" for _ in range(rnd.randint(1, 50)))
        return f"-----BEGIN {kind}-----" + rnd.choice(["", f"\n{body}-----END {kind}-----", f"\n{body}-----END {kind}-----"])

    def several() -> str:
        """A passphrase: words, and sometimes a sign of their own."""
        return rnd.choice([" ", " ", "-", "."]).join(rnd.choice([*rnd.sample(chosen_words, min(1, len(chosen_words))), pick(low, rnd.randint(4, 8))]) for _ in range(rnd.randint(3, 5))) + rnd.choice(["", "", "!", "7"])

    def chosen() -> str:
        """A password as people choose it: parts of words, digits and signs."""
        return pick(up, 1) + pick(low, rnd.randint(2, 6)) + pick(digit, rnd.randint(1, 4)) + pick("!#$%&*?@^.+-_", rnd.randint(0, 2)) + pick(full, rnd.randint(2, 8))

    rows = []
    for i in range(n):
        prose = " ".join(word() for _ in range(4)) + " "
        path, after = rnd.choice(["src1", "app/main.py", "conf/prod.env", None, "web"]), rnd.choice(['"', "'", '" ' + word(), "\n", " " + word(), '"###'])
        if i % 2:
            name = rnd.choice(["token", "secret", "api_key", "password", "passphrase", "pwd", "access_key", "auth", "TOKEN", "client_secret"]) + rnd.choice([" = ", "=", ": ", " => ", "  =  ", "\t=\t", " is "]) + rnd.choice(['"', "'", ""])
            value, before = rnd.choice([(chosen(), name), (several(), name), (several(), name), (pick(low, rnd.randint(4, 8)) + pick(digit, rnd.randint(2, 6)), name), (pick(low + digit, rnd.randint(10, 16)), name), (pick(full, rnd.randint(10, 20)), name), (pick(hexa, rnd.choice([32, 40, 64])), name), (pick(hexa, 40).upper(), name), (pick(full + "+/", rnd.choice([24, 32, 40, 44])), name), ("AKIA" + pick(up + digit, 16), rnd.choice([name, ""])), ("npm_" + pick(full, 36), rnd.choice([name, ""])), ("sk-" + rnd.choice(["", "ant-", "proj-"]) + pick(full + "-_", rnd.randint(24, 60)), rnd.choice([name, ""])), ("https://hooks.slack.com/services/T" + pick(up + digit, 8) + "/B" + pick(up + digit, 8) + "/" + pick(full, 24), ""), (pick(full + "+/", rnd.choice([12, 20, 28])) + "==", rnd.choice(["Authorization: Basic ", "authorization: bearer "])), ("ghp_" + pick(full, 36), rnd.choice([name, ""])), ("sk_live_" + pick(full, 24), rnd.choice([name, ""])), (private_key(), "")])
            if rnd.random() < 0.1:  # the password of an address
                value, before, after = rnd.choice([chosen(), pick(low + digit, rnd.randint(6, 16)), pick(full, rnd.randint(6, 12))]), rnd.choice(["postgres", "mysql", "https", "amqp"]) + "://" + word() + ":", "@" + word() + "." + word()
            rows.append((value, prose + before, after, path, 1))
        else:
            name = rnd.choice(["commit", "sha256", "md5", "checksum", "revision", "uuid", "etag", "order id", "version", word(), word()]) + rnd.choice([" = ", "=", ": ", " "]) + rnd.choice(['"', "'", ""])
            secret = rnd.choice(["token", "password", "api_key", "secret"]) + rnd.choice([" = ", " = ", ": ", "=", " is "]) + rnd.choice(['"', ""])
            value, before = rnd.choice([(pick(hexa, rnd.choice([32, 40, 64])), name), ("your-token-value-here", secret), ("changeme-" + word() + "-password", secret), ("example_" + word() + "_placeholder", secret), (rnd.choice(["enter your ", "your own ", "type the ", "please change this "]) + rnd.choice(["password here", "value here", "secret word", "name of the file"]), secret), (pick(digit, rnd.choice([16, 20])), name), ("/".join(word() for _ in range(5)), name), (word() + "_" + word() + "_" + word() + "_" + word(), name), ("x" * rnd.randint(6, 32), secret), (pick(low, rnd.randint(6, 12)), secret), (word() + rnd.choice([".", "_", "-"]) + word() + word(), secret), ("${" + pick(up, rnd.randint(4, 9)) + "}", secret), (rnd.choice(["changeme", "password", "example", "undefined", "required", "https://" + word() + "." + word() + "/" + word()]), secret), ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), name)])
            rows.append((value, prose + before, after, rnd.choice([path, "tests/fixture.json", "docs/example.md"]), 0))
    return spark.createDataFrame(rows, "value string, before string, after string, path string, label int")


def _grow(x: np.ndarray, y: np.ndarray, rnd: np.random.Generator, depth: int):
    """One tree in heap layout: feature and threshold of each inner node, value of each leaf."""
    inner = 2**depth - 1
    feature, threshold, leaf = [0] * inner, [float("inf")] * inner, [0.0] * (inner + 1)
    todo = [(0, np.arange(len(y)))]
    for node, rows in todo:
        mean = float(y[rows].mean()) if len(rows) else 0.5
        if node >= inner:
            leaf[node - inner] = mean
            continue
        best = (0.0, None, None)
        if len(rows) >= 4 and 0 < mean < 1:
            for f in rnd.choice(x.shape[1], size=5, replace=False):
                values = np.unique(x[rows, f])
                for cut in (values[:-1] + values[1:])[:: max(1, len(values) // 16)] / 2:
                    left = x[rows, f] <= cut
                    a, b = y[rows[left]], y[rows[~left]]
                    gain = mean * (1 - mean) - (len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())) / len(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, int(f), float(cut))
        if best[1] is not None:
            feature[node], threshold[node] = best[1], best[2]
            left = x[rows, best[1]] <= best[2]
            todo += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]
        else:  # all rows go left, down to one leaf
            todo.append((2 * node + 1, rows))
    return feature, threshold, leaf


def train_forest(findings: DataFrame, known: Dictionary, trees: int = TREES, depth: int = DEPTH, seed: int = 5):
    """Labelled findings (at most MAX_FINDINGS of them, in order of a hash) -> list of trees."""
    described = findings.select(features(F.col("value"), F.col("before"), F.col("after"), F.coalesce("path", F.lit("")), known).alias("x"), F.col("label").cast("double").alias("y"), F.xxhash64("value", "before").alias("h"))
    got = described.orderBy("h").limit(MAX_FINDINGS).collect()
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got])
    rnd = np.random.default_rng(seed)
    return [_grow(x[rows], y[rows], rnd, depth) for rows in (rnd.integers(0, len(y), len(y)) for _ in range(trees))]


def forest_score(x: Column, forest, depth: int = DEPTH) -> Column:
    """Mean leaf value over the trees, walked in heap layout by SQL functions."""
    numbers = lambda v, kind: F.array(*[F.lit(i) for i in v]).cast(f"array<{kind}>")
    steps = F.sequence(F.lit(1), F.lit(depth))

    def walk(feature, threshold, leaf):
        f, t, v = numbers(feature, "int"), numbers(threshold, "double"), numbers(leaf, "double")
        node = F.aggregate(steps, F.lit(0), lambda i, _: F.when(F.get(x, F.get(f, i)) > F.get(t, i), i * 2 + 2).otherwise(i * 2 + 1))
        return F.get(v, node - (2**depth - 1))

    return reduce(lambda a, b: a + b, [walk(*t) for t in forest]) / len(forest)


BLOCK = 256


def running(lengths: Column) -> Column:
    """Sums of what stands before each number of an array: blocks of BLOCK are summed first, so that no list is copied at each step."""
    plus = lambda s, x: s + x
    grow = lambda s, x: F.concat(s, F.array(F.coalesce(F.element_at(s, -1), F.lit(0)) + x))
    block = lambda i: F.slice(lengths, i * BLOCK + 1, F.lit(BLOCK))
    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / BLOCK).cast("int"))
    before = F.aggregate(F.transform(numbers, lambda i: F.aggregate(block(i), F.lit(0), plus)), F.array(F.lit(0)), grow)

    def within(starts: Column) -> Column:
        return F.flatten(F.transform(numbers, lambda i: bind(block(i), lambda b: F.slice(F.aggregate(b, F.array(F.get(starts, i)), grow), F.lit(1), F.size(b)))))

    return bind(before, within)


FOUND = "array<struct<start:int,value:string,score:double,is_secret:boolean>>"


def scan(docs: DataFrame, forest=None, path: str = "source", threshold: float = 0.5, redaction: str = "[REDACTED]", known: Dictionary | None = None) -> DataFrame:
    """``docs`` with findings (array of start, value, score, is_secret) and redacted (the text without its secrets).

    ``start`` counts code points from 0.  The scan is map-only, whatever a source or a document holds, and linear in a text's
    findings: what a text's findings share is worked out once, and bound where they use it.  Only the dictionary is counted over
    the corpus before (``known``, as a forest given has to have been trained with it).
    """
    known = known or corpus_dictionary(docs)
    forest = forest or train_forest(labelled_findings(docs.sparkSession, known=known), known)
    text = F.coalesce(F.col("text"), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    docs = without(docs, "findings", "redacted")
    # A cheap look decides whether a text is searched at all.
    maybe = reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in LITERALS]) | F.rlike(text, F.lit(MAYBE))
    out = docs.withColumn("__found", F.when(maybe, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def described(t: Column) -> Column:
        found, pieces = t["found"], t["pieces"]
        # Where each finding starts: after the pieces and findings before it.
        lengths = F.transform(found, lambda v, i: F.length(F.get(pieces, i)) + F.length(v))
        here = lambda v, i, starts: F.struct(
            (F.get(starts, i) + F.length(F.get(pieces, i))).alias("start"), v.alias("value"), features(v, F.right(F.get(pieces, i), F.lit(NEAR)), F.left(F.get(pieces, i + 1), F.lit(NEAR)), t["path"], known).alias("x")
        )
        return bind(bind(lengths, running), lambda starts: F.transform(found, lambda v, i: here(v, i, starts)))

    def redacted(t: Column) -> Column:
        kept = F.transform(t["findings"], lambda c, i: F.concat(F.get(t["pieces"], i), F.when(c["is_secret"], F.lit(redaction)).otherwise(c["value"])))
        return F.concat(F.array_join(kept, ""), F.element_at(t["pieces"], -1))

    pieces = F.split(text, CANDIDATE, -1)
    out = out.withColumn("__described", F.when(F.size("__found") > 0, bind(F.struct(F.col("__found").alias("found"), pieces.alias("pieces"), where.alias("path")), described)))
    scored = F.transform("__described", lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value"), forest_score(c["x"], forest).alias("score")))
    told = F.transform(scored, lambda c: F.struct(c["start"], c["value"], c["score"], (c["score"] >= threshold).alias("is_secret")))
    out = out.withColumn("findings", F.coalesce(told, F.array().cast(FOUND)))
    whole = bind(F.struct(F.col("findings").alias("findings"), pieces.alias("pieces")), redacted)
    return out.withColumn("redacted", F.when(F.exists("findings", lambda c: c["is_secret"]), whole).otherwise(F.col("text"))).drop("__found", "__described")
