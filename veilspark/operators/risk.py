"""Dataset privacy: k-anonymity, l-diversity, scores, exposure and readiness.

Two aggregations: by the quasi-identifiers, with partial sums, and over the
groups. Everything after is arithmetic on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score ladders, weights, anchors.
LABELS = [(1.0, "MINIMAL"), (2.5, "LOW"), (5.0, "MODERATE"), (7.5, "HIGH")]
WEIGHTS = {"identifiability": 0.35, "financial": 0.25, "reidentification": 0.25, "readiness": 0.15}
SMALL, PER_RECORD, FLAT, COST = 200, (50.0, 500.0), (10_000.0, 100_000.0), (100.0, 300.0)
SCENARIO = {"score_min": 0.05, "score_max": 0.15, "var_min": 0.02, "var_max": 0.08}
FINDINGS = [
    (("NAME", "FIRSTNAME", "LASTNAME"), "GDPR", "Art. 4(1)", "MEDIUM"),
    (("EMAIL",), "GDPR", "Art. 4(1)", "HIGH"),
    (("IBAN", "SWIFT", "CREDIT_CARD", "ACCOUNT"), "GDPR / PCI-DSS", "Art. 32 / Sec. 3", "HIGH"),
    (("SALARY", "INCOME", "PRICE"), "GDPR (Financial)", "Art. 6", "MEDIUM"),
    (("PHONE", "TEL"), "GDPR", "Art. 4(1)", "LOW"),
]
# Columns of the two usual reports, quasi-identifiers and sensitive ones.
PILOT = (("region", "dept"), ("name", "iban", "email"))
STAFF = (("region", "dept", "age_group"), ("name", "email", "iban", "salary"))
OTHER_FINDING = ("General Privacy", "Best Practice", "LOW")


def groups(df: DataFrame, quasi: list[str], sensitive: list[str]) -> DataFrame:
    """Size and number of different sensitive tuples of every quasi-identifier group; missing values are ``*``
    in the first and left out in the second."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("*")).alias(c) for c in quasi]
    tuple_ = F.concat_ws("|", *[F.col(c).cast("string") for c in sensitive])
    kinds = F.count_distinct("_s").cast("long") if sensitive else F.lit(0).cast("long")
    return df.select(*keys, tuple_.alias("_s")).groupBy(*quasi).agg(F.count("*").alias("size"), kinds.alias("kinds"))


def anonymity(df: DataFrame, quasi: list[str], sensitive: list[str]) -> DataFrame:
    """records, k, l, violating (records in groups below three) and compliant."""
    g = groups(df, quasi, sensitive)
    one = g.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("records"), F.coalesce(F.min("size"), F.lit(0)).alias("k"), F.coalesce(F.min("kinds"), F.lit(0)).alias("l"),
        F.coalesce(F.sum(F.when(F.col("size") < 3, F.col("size"))), F.lit(0)).alias("violating"),
    )
    ok = F.col("k") >= 3
    return one.withColumn("compliant", ok & (F.col("l") >= 2) if sensitive else ok)


def label(score: Column) -> Column:
    out = F.when(score <= LABELS[0][0], LABELS[0][1])
    for most, name in LABELS[1:]:
        out = out.when(score <= most, name)
    return out.otherwise("CRITICAL")


def scores(one: DataFrame) -> DataFrame:
    """Adds the four category scores, the overall score and its label to a row of ``anonymity``."""
    k, l, n, bad = (F.col(c) for c in ("k", "l", "records", "violating"))  # noqa: E741
    share = F.when(n > 0, bad / n).otherwise(0.0)
    out = one.withColumns({
        "identifiability": F.when(k <= 0, 10.0).when(k == 1, 9.5).when(k == 2, 7.0).when(k == 3, 4.0).when(k <= 5, 2.5).otherwise(1.0),
        "financial": F.least(share * 12, F.lit(10.0)),
        "reidentification": F.least(F.when(k <= 1, 5.0).when(k < 3, 3.0).otherwise(0.0) + F.when(l <= 1, 5.0).otherwise(0.0), F.lit(10.0)),
        "readiness": F.when(F.col("compliant"), 1.5).otherwise(F.least(share * 10, F.lit(10.0))),
    })
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("overall", total).withColumn("risk_label", label(F.col("overall")))
    return out.withColumn("dataset_score", F.least(F.col("overall") / 10, F.lit(1.0)))


def exposure(one: DataFrame) -> DataFrame:
    """Adds the value-at-risk range to a row of ``scores``: (regulatory + operational) x multiplier."""
    k, l, n = F.col("k"), F.col("l"), F.col("records").cast("double")  # noqa: E741
    small = n < SMALL
    reg = [F.when(small, n * p).otherwise(f) * F.col("dataset_score") for p, f in zip(PER_RECORD, FLAT, strict=True)]
    op = [n * c for c in COST]
    times = [F.when(k <= 1, a).when(k < 3, b).when(l <= 1, c).otherwise(d) for a, b, c, d in ((1.5, 1.3, 1.2, 1.0), (2.0, 1.5, 1.5, 1.2))]
    return one.withColumns({
        "regulatory_min": reg[0], "regulatory_max": reg[1], "operational_min": op[0], "operational_max": op[1], "multiplier_min": times[0], "multiplier_max": times[1],
        "var_min": (reg[0] + op[0]) * times[0], "var_max": (reg[1] + op[1]) * times[1],
    })


def readiness(one: DataFrame) -> DataFrame:
    """Adds whether models and indexes may see the data."""
    k, ok = F.col("k"), F.col("compliant")
    share = F.when(F.col("records") > 0, F.col("violating") / F.col("records")).otherwise(0.0)
    safe = ok & (k >= 5)
    middle = ok | (k >= 3)
    return one.withColumns({
        "ai_status": F.when(safe, "ALLOW").when(middle, "SANITIZE_FIRST").otherwise("BLOCK"),
        "llm_exposure": F.when(safe, F.when(share > 0.05, "MODERATE").otherwise("LOW")).when(middle, "MEDIUM").otherwise("CRITICAL"),
        "rag_safe": safe,
    })


def scenario(one: DataFrame) -> DataFrame:
    """The dataset as it is, and as projected after protection: ranges of score and exposure, and the label of the upper score."""
    before = F.struct(F.lit("before").alias("phase"), F.col("overall").alias("score_min"), F.col("overall").alias("score_max"), "var_min", "var_max", F.col("ai_status"))
    times = lambda c, k: (F.col(c) * SCENARIO[k]).alias(k)
    after = F.struct(F.lit("after").alias("phase"), times("overall", "score_min"), times("overall", "score_max"), times("var_min", "var_min"), times("var_min", "var_max"), F.lit("ALLOW").alias("ai_status"))
    return one.select(F.inline(F.array(before, after))).withColumn("label", label(F.col("score_max")))


def findings(sensitive: list[str]) -> list[tuple[str, str, str, str]]:
    """(attribute, regulation, article, severity) of the sensitive columns."""
    return [(c, *next((f[1:] for f in FINDINGS if c.upper() in f[0]), OTHER_FINDING)) for c in sensitive]


def report(df: DataFrame, quasi: list[str], sensitive: list[str]) -> DataFrame:
    """One row with everything; of an empty dataset, one row of zeros and nulls."""
    one = readiness(exposure(scores(anonymity(df, quasi, sensitive))))
    found = [F.struct(*[F.lit(x).alias(n) for x, n in zip(f, ("attribute", "regulation", "article", "severity"), strict=True)]) for f in findings(sensitive)]
    kind = "array<struct<attribute:string,regulation:string,article:string,severity:string>>"
    one = one.withColumn("findings", F.array(*found).cast(kind) if found else F.array().cast(kind))
    kept = ("records", "k", "l", "violating")
    return one.select(*[F.col(c) if c in kept else F.when(F.col("records") > 0, F.col(c)).alias(c) for c in one.columns])
