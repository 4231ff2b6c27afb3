"""Business-domain detection for many datasets at once, as joins and grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright import rules as R
from tablewright.operators.constraints import match_rules, table_columns

# Decision limits.
MIN_SCORE = 0.30
MIN_HITS = 5
MIN_GAP = 0.15
MAX_CONFIDENCE = 0.95
LOW_CONFIDENCE = 0.60


def keyword_frame(spark) -> DataFrame:
    """``(domain, priority, token, keyword_count)``."""
    rows = [(d, i, k, len(words)) for i, (d, words) in enumerate(R.DOMAIN_KEYWORDS.items()) for k in words]
    return spark.createDataFrame(rows, "domain string, priority int, token string, keyword_count int")


def name_tokens(columns: DataFrame, dataset: str = "dataset_id", column: str = "column") -> DataFrame:
    """Lower-cased column names and their ``_``-separated parts."""
    name = F.lower(F.col(column))
    parts = F.concat(F.split(name, "_"), F.array(name))
    return columns.select(dataset, F.explode(parts).alias("token"))


def value_tokens(values: DataFrame, dataset: str = "dataset_id", value: str = "value") -> DataFrame:
    """Sample values as single tokens."""
    return values.select(dataset, F.btrim(F.lower(F.col(value).cast("string")), F.lit(" \t\n\r\f")).alias("token"))


def goal_tokens(goals: DataFrame, dataset: str = "dataset_id", goal: str = "goal") -> DataFrame:
    """The words of a goal or any other text, split at white space."""
    return goals.select(dataset, F.explode(F.split(F.lower(F.col(goal)), r"\s+")).alias("token"))


def domain_scores(tokens: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """``(dataset, domain, hits, score)`` for each dataset and domain with a keyword among its tokens.

    Tokens are cut down to keywords by a join with the fixed list before the
    distinct, so the shuffle carries at most a list's length per dataset and task.
    """
    words = F.broadcast(keyword_frame(tokens.sparkSession))
    hits = tokens.join(words, "token").select(dataset, "domain", "priority", "token", "keyword_count").distinct()
    return (
        hits.groupBy(dataset, "domain", "priority", "keyword_count").agg(F.count(F.lit(1)).alias("hits"))
        .select(dataset, "domain", "priority", "hits", (F.col("hits") / F.col("keyword_count")).alias("score")))


def detect_domains(tokens: DataFrame, datasets: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """One row per dataset: domain (or ``unknown``), confidence, method, low-confidence flag.

    Keywords among the tokens are gathered by one grouped set, bounded by the fixed list, and
    datasets without any come as rows of the same group; everything after works on a dataset's own array.
    """
    words = F.broadcast(keyword_frame(tokens.sparkSession))
    found = tokens.join(words, "token").select(dataset, F.struct("priority", "token").alias("_hit"))
    none = datasets.select(dataset, F.lit(None).cast(found.schema["_hit"].dataType).alias("_hit"))
    hits = found.unionByName(none).groupBy(dataset).agg(F.collect_set("_hit").alias("_hits"))

    def scored(i: int, domain: str, keywords: int) -> Column:
        n = F.size(F.filter("_hits", lambda h: h["priority"] == i))
        return F.struct((-n / keywords).alias("loss"), F.lit(i).alias("priority"), n.alias("hits"), F.lit(domain).alias("domain"))

    ranked = F.array_sort(F.array(*[scored(i, d, len(words_)) for i, (d, words_) in enumerate(R.DOMAIN_KEYWORDS.items())]))
    best = hits.withColumn("_ranked", ranked).select(
        dataset, F.expr("_ranked[0].domain").alias("_domain"), F.expr("_ranked[0].hits").alias("hits"),
        F.expr("-_ranked[0].loss").alias("score"), F.expr("_ranked[1].loss - _ranked[0].loss").alias("gap"))
    sure = ((F.col("score") >= MIN_SCORE) | (F.col("hits") >= MIN_HITS)) & (F.col("gap") >= MIN_GAP)
    confidence = F.round(F.least(F.lit(MAX_CONFIDENCE), F.col("score") * 2 + F.col("gap")), 3)
    return best.select(
        dataset,
        F.when(sure, F.col("_domain")).otherwise("unknown").alias("domain"),
        F.when(sure, confidence).otherwise(0.0).alias("confidence"),
        F.when(sure, "keyword_heuristic").otherwise("ambiguous").alias("method"),
        (~F.coalesce(sure & (confidence >= LOW_CONFIDENCE), F.lit(False))).alias("low_confidence"))


def detect_domain(df: DataFrame, goal: str = "", samples: DataFrame | None = None) -> dict:
    """The domain of one table by its column names, optional sample values and goal."""
    spark = df.sparkSession
    one = spark.createDataFrame([("table", goal)], "dataset_id string, goal string")
    tokens = name_tokens(spark.createDataFrame([("table", c) for c in df.columns], "dataset_id string, column string"))
    tokens = tokens.unionByName(goal_tokens(one))
    if samples is not None:
        tokens = tokens.unionByName(value_tokens(samples.withColumn("dataset_id", F.lit("table"))))
    return detect_domains(tokens, one).first().asDict()


def rule_assignments(columns: DataFrame, domains: DataFrame) -> DataFrame:
    """``(dataset, domain, rule, column)``: the rules of each dataset's domain with the columns they are about.

    ``columns`` are :func:`~tablewright.operators.constraints.table_columns` of any number of datasets,
    ``domains`` is (dataset, domain).
    """
    rules = F.broadcast(rules_frame(columns.sparkSession).where("kind = 'validation_rules'").select("domain", F.col("name").alias("rule")))
    wanted = domains.select("dataset", "domain").join(rules, "domain")
    return match_rules(columns, wanted.select("dataset", "rule")).join(domains.select("dataset", "domain"), "dataset").select(
        "dataset", "domain", "rule", "column", "position")


def table_rules(df: DataFrame, domain: str) -> list[tuple[str, str]]:
    """``(rule, column)`` of one table, in the order of the domain's rules and the table's columns."""
    one = df.sparkSession.createDataFrame([("table", domain)], "dataset string, domain string")
    order = {n: i for i, n in enumerate(R.rules_for(domain)["validation_rules"])}
    rows = rule_assignments(table_columns(df), one).collect()
    return [(r["rule"], r["column"]) for r in sorted(rows, key=lambda r: (order[r["rule"]], r["position"]))]


def rules_frame(spark) -> DataFrame:
    """``(domain, kind, name)``: every rule list as rows."""
    kinds = ("sensitive_columns", "required_transforms", "forbidden_transforms", "validation_rules")
    rows = [(d, k, n) for d, r in R.DOMAIN_RULES.items() for k in kinds for n in r[k]]
    return spark.createDataFrame(rows, "domain string, kind string, name string")


def load_domain_rules(detected: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """``(dataset, domain, kind, name)`` of the rules that hold for each detected dataset."""
    return detected.select(dataset, "domain").join(F.broadcast(rules_frame(detected.sparkSession)), "domain").select(
        dataset, "domain", "kind", "name")
