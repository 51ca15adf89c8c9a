"""URL verdicts: allow and block rules first, then gradient-boosted trees on lexical features.

The trees learn from labelled URLs: by default those that a rule decides. At most `most` labelled rows (the smallest
by hash, one bounded sample) train them; every URL is judged. Features: length, depth, digit ratio, character entropy,
parameter counts, and for the host's last label and the path's first part the smoothed share of blocked URLs among
the labelled sample. All of it is DataFrame functions and Spark's own tree learner.

Cases: a null URL, or one without ://, has an empty host and path, fits no rule and is judged by its features; empty
tables and samples with one class get that class's verdict (allow without labels); repeated rows are judged alike;
rules of equal length: the smaller rule string wins; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import saved

#: Labelled rows that train the trees, at most.
MOST = 20_000
LEXICAL = ["url_length", "host_length", "path_depth", "host_labels", "digit_ratio", "entropy", "n_params", "n_marks", "has_fragment", "longest_run"]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule is a host, then a path from its first slash."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = (host != "") & ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def lexical(df: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """df with the columns of LEXICAL."""
    text = F.coalesce(F.col(url), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    low = F.lower(text)
    shares = [(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / size for c in string.ascii_lowercase + string.digits + "/.-_"]
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares), F.lit(0.0))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return df.withColumns({
        "url_length": F.length(text).cast("double"), "host_length": F.length(host).cast("double"),
        "path_depth": F.regexp_count(F.col(path), F.lit("/[^/]")).cast("double"), "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / size, "entropy": entropy,
        "n_params": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0), "n_marks": F.length(F.regexp_replace(text, r"[\p{L}\p{N}]", "")).cast("double"),
        "has_fragment": F.instr(text, "#").cast("boolean").cast("double"), "longest_run": F.array_max(F.transform(F.split(text, "[^0-9]+"), lambda x: F.length(x))).cast("double"),
    })


INPUTS = [*LEXICAL, "last_label_share", "first_part_share"]


def fit_trees(sample: DataFrame, iterations: int = 10, depth: int = 3):
    """Spark's boosted trees on INPUTS and label."""
    vectors = VectorAssembler(inputCols=INPUTS, outputCol="_features", handleInvalid="keep")
    return GBTClassifier(featuresCol="_features", labelCol="label", maxIter=iterations, maxDepth=depth, stepSize=0.3, seed=7).fit(vectors.transform(sample))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", id_col: str = "page_id", labels: DataFrame | None = None, most: int = MOST, iterations: int = 10, depth: int = 3) -> DataFrame:
    """id_col, host, path, rule, verdict, score (the trees' probability of block). labels: id_col, blocked (0 or 1)."""
    base = pages.select(F.col(id_col), F.col(url).alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))
    base = base.withColumns({"last_label": F.regexp_extract("host", r"([^.]*)\z", 1), "first_part": F.regexp_extract("path", r"\A/?([^/]*)", 1)})
    full = lexical(base, "url")
    known = full.filter("_fit is not null").withColumn("label", (F.col("_fit.verdict") == "block").cast("double")) if labels is None else full.join(labels.select(id_col, F.col("blocked").cast("double").alias("label")), id_col)
    sample = saved(known.select("url", "last_label", "first_part", "label", *LEXICAL).orderBy(F.xxhash64("url"), "url").limit(most), "url-sample")
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    all_ = sum(classes.values())
    prior = classes.get(1.0, 0) / all_ if all_ else 0.0
    # at most one row for each row of the bounded sample
    shares = {n: saved(sample.groupBy(n).agg(((F.sum("label") + 4 * prior) / (F.count("*") + 4)).alias(f"{n}_share")), "url-shares") for n in ("last_label", "first_part")}

    def with_shares(df: DataFrame) -> DataFrame:
        for name, share in shares.items():
            df = df.join(F.broadcast(share), name, "left").fillna({f"{name}_share": prior})
        return df

    if min(classes.get(0.0, 0), classes.get(1.0, 0)) == 0:
        judged = full.withColumn("score", F.lit(float(prior)))
    else:
        margin = 2 * model_margin(fit_trees(with_shares(sample), iterations, depth), INPUTS)
        judged = with_shares(full).withColumn("score", 1 / (1 + F.exp(-margin)))
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"), "score")


def model_margin(model, inputs: list[str]) -> Column:
    """The trees' weighted sum as one SQL expression of the input columns, so that judging stays in generated code."""

    def walk(node) -> str:
        if node.numDescendants() == 0:
            return repr(float(node.prediction()))
        split = node.split()
        return f"if({inputs[split.featureIndex()]} <= {split.threshold()!r}D, {walk(node.leftChild())}, {walk(node.rightChild())})"

    total = " + ".join(f"{w!r}D * ({walk(t._call_java('rootNode'))})" for t, w in zip(model.trees, model.treeWeights))
    return F.expr(total)
