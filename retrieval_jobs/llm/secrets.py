"""Secret scan, with DataFrame functions only.

Candidates are runs of 16 or more key characters holding a digit, also right after "=". Each gets features of length,
character transitions, dictionary coverage, path and neighbouring words; a random forest trained
from labelled findings (Spark's own) decides which are real. The trees are written as nested CASE
expressions, so candidates are found, scored and redacted inside the row: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

# What a candidate looks like, and the words the features look for.
# An "=" before a run assigns it; after one it is padding only where no value follows.
# An identifier with a credential word that a value is assigned to is a name, not a candidate.
NAME = r"(?i:(?=[a-z0-9_\-]*(?:token|secret|passw|pwd|key|auth|credential))(?:[a-z0-9]{1,16}[_\-]){1,8}[a-z]{0,16}[0-9]{0,2})(?:[\"'`]?[ \t]*=|[\"'`]?:[ \t]|[\"'`][ \t]*:)[ \t]*[\"'`]?[A-Za-z0-9+/]"
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?!" + NAME + r")(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=\-]))?"
ASSIGNS = r"^[\"'`]?\s*(:|=|:=|=>)\s*[\"'`]?$"
CONTEXT = 48  # characters of context on either side
CREDENTIAL = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key|client[_-]?secret|signature)"
CHECKSUM = r"(?i)(sha-?[0-9]*|md5|checksum|digest|commit|revision|etag|hash|uuid|guid|build|integrity|order|invoice|phone|card|isbn|serial)"
SAMPLE = r"(?i)(example|sample|dummy|fake|placeholder|changeme|your|xxxx|test|mock|demo|fixture)"
PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abpr]-|sk_live_|sk-|AIza|eyJ|glpat-|npm_|SG)"
DICTIONARY = "the and for are with that this from have not you was key test data name file user code text time list index value page order item line main core base list type info example sample der die und das ist ein nicht les des est une pour dans que los las una del con por para".split()

FEATURES = ["length", "transitions", "digits", "upper", "distinct", "hex_only", "digit_only", "dictionary", "known_prefix", "assigned", "credential_before", "credential_near", "checksum_near", "sample_near", "quoted", "in_path", "path_test", "words_near"]


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """Struct of doubles, one per name of FEATURES."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    known = F.regexp_replace(F.lower(value), "(" + "|".join(DICTIONARY) + ")", "")
    by_name = {
        "length": n,
        "transitions": count(r"(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])") / n,
        "digits": count("[0-9]") / n,
        "upper": count("[A-Z]") / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / F.least(n, F.lit(64.0)),
        "hex_only": flag(value.rlike("^[0-9a-fA-F]+$")),
        "digit_only": flag(value.rlike("^[0-9+_=/-]+$")),
        "dictionary": F.lit(1.0) - F.length(known) / n,
        "known_prefix": flag(value.rlike(PREFIX)),
        "assigned": flag(before.rlike(r"[:=]\s*[\"'`]?$")),
        "credential_before": flag(before.rlike(CREDENTIAL + r"[A-Za-z_]{0,12}[\"']?\s*(:|=|:=|=>|is|\s)\s*[\"'`]?$")),
        "credential_near": flag(before.rlike(CREDENTIAL)),
        "checksum_near": flag(before.rlike(CHECKSUM + r"[^A-Za-z]{0,6}$")),
        "sample_near": flag(before.rlike(SAMPLE) | value.rlike(SAMPLE)),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "in_path": flag(before.rlike(r"[/\\]$") | value.rlike("^[^=]*/[^=]*/") | after.rlike(r"^\.[a-z]{2,4}\b")),
        "path_test": flag(path.rlike(SAMPLE)),
        "words_near": F.regexp_count(before, F.lit(r"[A-Za-z]{2,}")).cast("double"),
    }
    return F.struct(*[by_name[name].alias(name) for name in FEATURES])


def candidates(text: Column) -> Column:
    """Array of structs (value, start (1-based), before, after) of the candidates in a text."""
    text = F.coalesce(text, F.lit(""))
    # the pieces between the candidates give each one's neighbours and place
    pieces, found = F.split(text, CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def at(value, i):
        gone = F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, p: a + F.length(p))
        gone = gone + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0).cast("long"), lambda a, p: a + F.length(p))
        left, right = F.element_at(pieces, i + 1), F.element_at(pieces, i + 2)
        # a candidate can be the name that the next one is assigned to
        left = F.when(left.rlike(ASSIGNS), F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), left)).otherwise(left)
        return F.struct(
            value.alias("value"), (gone + 1).alias("start"),
            F.substring(left, F.greatest(F.lit(1), F.length(left) - (CONTEXT - 1)), F.lit(CONTEXT)).alias("before"),
            F.substring(right, F.lit(1), F.lit(CONTEXT)).alias("after"),
        )

    return F.transform(found, at)


def labelled_findings(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """Labelled findings (value, before, after, path, label) made from templates of reviewed findings.

    Each row draws a template and fills it with hash characters; ``rows`` bounds the training set."""
    # Fixed values: (before, value kind, after, path, label)
    templates = [
        ('token = "', "hex40", '"', "src/app.py", 1), ("api_key: ", "mixed32", "\n", "conf/prod.yml", 1), ("password='", "mixed20", "'", "deploy.sh", 1),
        ("Authorization: Bearer ", "mixed48", "\n", "client.ts", 1), ("client_secret=", "mixed32", "&", "oauth.md", 1), ("aws id ", "akia", " ", "notes", 1),
        ("secret_key = ", "base64", "\n", "settings.py", 1), ("clone with ", "ghp", " ", "docs", 1), ("access-key ", "mixed40", " ", "web", 1), ("word token = \"", "hex40", '"*** word', "web", 1),
        ("passwd ", "mixed20", " word", "web", 1), ("export TOKEN=", "hex32", "\n", "web", 1), ("stripe ", "sk_live", " ", "web", 1),
        ("commit ", "hex40", " word", "git.log", 0), ("sha256: ", "hex64", "\n", "sums.txt", 0), ("md5=", "hex32", "\n", "sums.txt", 0), ("word word ", "digits16", " word", "web", 0),
        ("card ", "digits16", " word", "web", 0), ("order ", "digits20", ". ", "web", 0), ("uuid ", "uuid", " ", "web", 0), ("/static/img/", "path", ".png", "web", 0),
        ("word word, ", "words", " word", "web", 0), ('token = "', "example", '"', "tests/test_auth.py", 0), ('api_key: "', "xxxx", '"', "docs/example.md", 0), ("integrity=sha512-", "base64", "\n", "lock", 0),
        ("word ", "hex40", " word", "web", 0), ("| ", "digits16", " | word", "web", 0), ("build ", "hex12d", "\n", "ci", 0), ("word. ", "mixed20w", " word", "web", 0), ("tel ", "phone", " ", "web", 0),
    ]
    names = ("t", "before", "kind", "after", "path", "label")
    # literals of the plan: rows of a Python list would start Python workers of another kind on every executor, which stay
    shape = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, (i, *t), strict=True)]) for i, t in enumerate(templates)])))
    r = spark.range(rows).withColumn("t", (F.col("id") % len(templates)).cast("int")).withColumn("h", F.sha2(F.concat(F.lit("finding"), F.col("id")).cast("binary"), 256))
    r = r.withColumn("h2", F.translate(F.base64(F.unhex("h")), "+/=", "xY0"))
    r = r.withColumn("d", F.translate("h", "abcdef", "123456")).join(F.broadcast(shape), "t")
    cut = lambda c, n: F.substring(c, 1, n)
    kinds = {
        "hex40": cut("h", 40), "hex32": cut("h", 32), "hex64": F.col("h"), "mixed20": cut("h2", 20), "mixed32": cut("h2", 32), "mixed40": cut("h2", 40), "mixed48": F.concat("h2", cut("h", 6)),
        "base64": F.base64(F.unhex("h")), "akia": F.concat(F.lit("AKIA"), F.upper(cut("h2", 16))), "ghp": F.concat(F.lit("ghp_"), cut("h2", 36)), "sk_live": F.concat(F.lit("sk_live_"), cut("h2", 24)),
        "digits16": cut("d", 16), "digits20": cut("d", 20), "uuid": F.concat_ws("-", cut("h", 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)),
        "path": F.concat(F.lit("assets/theme/icon-"), cut("d", 3)), "words": F.concat(F.lit("chapter-the-main-list-"), cut("d", 2)), "example": F.concat(F.lit("example_token_"), cut("d", 6)),
        "xxxx": F.concat(F.lit("xxxxxxxxxxxxxxxx"), cut("d", 2)), "hex12d": F.concat(cut("h", 12), F.lit("-"), cut("d", 6)), "mixed20w": F.concat(F.lit("thingdata_list_"), cut("d", 5)), "phone": F.concat(F.lit("00"), cut("d", 15)),
    }
    value = None
    for k, v in kinds.items():
        value = F.when(F.col("kind") == k, v) if value is None else value.when(F.col("kind") == k, v)
    return r.select(value.alias("value"), "before", "after", "path", F.col("label").cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 25, depth: int = 6, seed: int = 7):
    """Random forest over labelled findings (value, before, after, path, label)."""
    rows = findings.where("value is not null and label is not null").withColumn("f", features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit(""))))
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.select("label", "f.*")).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data)


def forest_expression(model, struct: Column) -> Column:
    """Share of the trees that vote for a real secret, as one SQL expression over the feature struct."""

    def tree(lines: list[str], at: int) -> tuple[Column, int]:
        if leaf := re.match(r"\s*Predict: ([-0-9.E]+)", lines[at]):
            return F.lit(float(leaf[1])), at + 1
        test = re.match(r"\s*If \(feature (\d+) <= ([-0-9.E]+)\)", lines[at])
        low, at = tree(lines, at + 1)
        high, at = tree(lines, at + 1)  # the line between is the Else
        return F.when(struct[FEATURES[int(test[1])]] <= float(test[2]), low).otherwise(high), at

    votes = F.lit(0.0)
    for t in model.trees:
        votes = votes + tree([x for x in t.toDebugString.split("\n")[1:] if x.strip()], 0)[0]
    return votes / len(model.trees)


def scan(docs: DataFrame, model, threshold: float = 0.5, into: str = "findings") -> DataFrame:
    """``docs`` with a new column ``into``: array of (value, start, score, is_secret), one per candidate, in text order.

    Needs ``text`` and ``source`` (its path); other columns stay; a column that is named like the new one is an error. Null and
    empty texts have no candidates; long texts are read whole; a score on the threshold is a secret; every row gives a row, so that
    null and repeated doc_ids stay and equal rows get equal results; an empty table gives no rows."""
    if unused(docs, into) != into:
        raise ValueError(f"column {into} is there already: name the findings otherwise")
    path = F.coalesce(F.col("source").cast("string"), F.lit(""))
    with_f = F.transform(candidates(F.col("text")), lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), features(c["value"], c["before"], c["after"], path).alias("f")))
    score = lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), forest_expression(model, c["f"]).alias("score"))
    scored = F.transform(with_f, score)
    return docs.withColumn(into, F.transform(scored, lambda c: F.struct(c["value"], c["start"], c["score"], (c["score"] >= threshold).alias("is_secret"))))


def find_secrets(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start (1-based character), length, masked, value_sha256, score, is_secret. Extra columns are ignored; else as ``scan``."""
    found = scan(docs.select("doc_id", "text", "source"), model, threshold).select("doc_id", F.explode("findings").alias("x"))
    masked = F.concat(F.substring("x.value", 1, 4), F.lit("..."))
    return found.select("doc_id", "x.start", F.length("x.value").cast("long").alias("length"), masked.alias("masked"), F.sha2(F.col("x.value").cast("binary"), 256).alias("value_sha256"), "x.score", "x.is_secret")


def redact(docs: DataFrame, model, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every real secret in ``text`` replaced by ``mark``; ``n_chars`` follows if present.

    All rows and columns stay, also columns of any other name; cases as in ``scan``."""
    cols, into = docs.columns, unused(docs, "findings")
    rows = scan(docs, model, threshold, into)
    pieces = F.split("text", CANDIDATE)
    shown = F.concat(F.transform(into, lambda c: F.when(c["is_secret"], F.lit(mark)).otherwise(c["value"])), F.array(F.lit("")))
    text = F.array_join(F.zip_with(pieces, shown, lambda p, s: F.concat(p, s)), "")
    rows = rows.withColumn("text", F.when(F.exists(into, lambda c: c["is_secret"]), text).otherwise(F.col("text")))
    if "n_chars" in cols:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.drop(into)
