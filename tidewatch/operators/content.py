"""Scorer 2: what gateway lines say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Content
from tidewatch.functions import logs
from tidewatch.functions.common import bucket, rnd, severity
from tidewatch.operators.buckets import arrivals, first_arrival

FAMILIES = ("sqli_probe", "path_traversal", "auth_failure", "scanner_probe", "schema_reject", "other")
#: The model's inputs, in their order (M7).
FEATURES = (
    "window_events", "distinct_templates", "n_sqli", "n_traversal", "n_auth_fail", "n_scanner", "n_schema_reject", "n_other", "n_suspicious_other",
    "benign_ratio", "auth_fail_ratio", "err_4xx_ratio", "max_auth_attempt",
)


def analyzed(tele: DataFrame, scanner: str = logs.SCANNER) -> DataFrame:
    """Parsed lines with family, level and template; events without address or line go.

    No filter asks for a line: it would build each line twice, and ``parse`` leaves none where there is none.
    """
    rows = logs.parse(tele.filter(F.nullif("client_ip", F.lit("")).isNotNull()))
    fam = logs.family(scanner)
    return rows.withColumn("family", fam).withColumns({"level": logs.level(F.col("family")), "template": logs.masked(logs.content())})


def windows(lines: DataFrame, seconds: int) -> DataFrame:
    """The features of each address and bucket, and the counts by family in a sorted map: two levels of partial sums."""
    b = bucket(F.col("t"), seconds)
    n = F.col("window_events")
    fam = lambda f: F.count_if(F.col("family") == f)
    base = lines.withColumn("bucket", b).withColumns(arrivals()).groupBy("bucket", "client_ip").agg(
        F.count("*").alias("window_events"),
        F.count_distinct("template").alias("distinct_templates"),
        fam("sqli_probe").alias("n_sqli"), fam("path_traversal").alias("n_traversal"), fam("auth_failure").alias("n_auth_fail"), fam("scanner_probe").alias("n_scanner"),
        fam("schema_reject").alias("n_schema_reject"), fam("other").alias("n_other"), F.count_if((F.col("family") == "other") & (F.col("level") == 1)).alias("n_suspicious_other"),
        F.count_if(F.col("family").isin(*logs.BENIGN)).alias("benign_n"), F.count_if(F.col("code") >= 400).alias("err_n"),
        F.max(F.when(F.col("family") == "auth_failure", logs.attempt()).otherwise(0)).alias("max_auth_attempt"),
        F.min("near").alias("near"), F.min("arrival").alias("arrival"),
    )
    return base.withColumn("first", first_arrival()).drop("near", "arrival").withColumns({"benign_ratio": F.col("benign_n") / n, "auth_fail_ratio": F.col("n_auth_fail") / n, "err_4xx_ratio": F.col("err_n") / n})


def template_counts(lines: DataFrame, seconds: int) -> DataFrame:
    """(bucket, client_ip, template_counts map)."""
    per = lines.groupBy(bucket(F.col("t"), seconds).alias("bucket"), "client_ip", "family").count()
    return per.groupBy("bucket", "client_ip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "count")))).alias("template_counts"))


def rule_level(storm: int):
    """F8."""
    return (
        F.when((F.col("n_sqli") + F.col("n_traversal") + F.col("n_scanner") > 0) | (F.col("n_auth_fail") >= storm), 2)
        .when((F.col("n_auth_fail") > 0) | (F.col("n_suspicious_other") > 0), 1)
        .otherwise(0)
    )


def stand_in(win: DataFrame, cfg: Content = Content()) -> DataFrame:
    """The model's labels as its probabilities: what a perfect model of them would say; any model may take its place."""
    level = rule_level(cfg.storm)
    return win.withColumns({"p_malicious": F.when(level == 2, 1.0).otherwise(0.0), "p_suspicious": F.when(level == 1, 1.0).otherwise(0.0)})


def score(win: DataFrame, cfg: Content = Content()) -> DataFrame:
    """Cascade of rules and model; rows that are neither anomalous nor of a level nor large enough go.

    ``win`` has ``p_malicious`` and ``p_suspicious``.
    """
    level = rule_level(cfg.storm)
    hits = F.col("n_sqli") + F.col("n_traversal") + F.col("n_scanner") + F.when(F.col("n_auth_fail") >= cfg.storm, F.col("n_auth_fail")).otherwise(0)
    model = F.col("p_malicious") + 0.5 * F.col("p_suspicious")
    rows = win.withColumns({"rule_level": level, "model_score": model})
    rows = rows.withColumn("score", rnd(F.when(level == 2, F.greatest(model, F.least(F.lit(1.0), 0.85 + 0.03 * hits))).otherwise(model), 4))
    rows = rows.withColumn("is_anomalous", (level == 2) | ((model >= cfg.anomaly) & (F.col("window_events") >= cfg.min_window)))
    counted = (("sqli_probe", "n_sqli"), ("path_traversal", "n_traversal"), ("scanner_probe", "n_scanner"), ("auth_failure", "n_auth_fail"), ("other", "n_suspicious_other"))
    reasons = [F.when(F.col(c) > 0, F.format_string(f"template={f} count=%d", F.col(c))) for f, c in counted]
    reasons.append(F.when(F.col("auth_fail_ratio") > 0, F.format_string("auth_fail_ratio=%.2f", "auth_fail_ratio")))
    reasons.append(F.when(F.col("is_anomalous") & (level != 2), F.format_string("model_p_malicious=%.2f", "p_malicious")).when(~F.col("is_anomalous") & (model >= cfg.suspicious), F.format_string("model=suspicious score=%.2f", model)))
    rows = rows.withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull()))
    return rows.filter(F.col("is_anomalous") | (level >= 1) | (F.col("window_events") >= cfg.min_score))


def documents(scored: DataFrame, seconds: int) -> DataFrame:
    return scored.select(
        "bucket", F.lit("client_ip").alias("entity_type"), F.col("client_ip").alias("entity_id"), F.lit(None).cast("long").alias("event_count"), "score",
        F.lit("log_classification").alias("alert_type"), "reasons", "is_anomalous", F.lit(False).alias("warming_up"), "first", F.lit("content").alias("model"), (F.col("bucket") + seconds).alias("t"),
    )


def alerts(docs: DataFrame, cfg: Content = Content()) -> DataFrame:
    """The worst few anomalous addresses of each bucket."""
    rank = Window.partitionBy("bucket").orderBy(F.desc("score"), "first.t", "first.event_id", "first.rep", "entity_id")
    kept = docs.filter("is_anomalous").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= cfg.max_alerts)
    summary = F.format_string("log content of %s scored %.2f", "entity_id", "score")
    return kept.select("t", "alert_type", severity(F.col("score")).alias("severity"), "entity_type", "entity_id", "score", F.col("model").alias("source"), summary.alias("summary"), "rank")


def train_model(win: DataFrame, trees: int = 40, depth: int = 3, seed: int = 1337):
    """Three-class model of the windows' rule levels: one boosted-tree model against the rest for each class (M6, M8)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler

    labelled = win.withColumn("label", rule_level(Content().storm).cast("double"))
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), OneVsRest(classifier=gbt)]).fit(labelled)


def holdout(win: DataFrame, part: int = 5, **training) -> DataFrame:
    """``label, prediction`` of the addresses whose checksum falls in one of ``part`` parts, by a model of the others."""
    held = F.crc32(F.col("client_ip").cast("binary")) % part == 0
    model = train_model(win.filter(~held), **training)
    return model.transform(win.filter(held).withColumn("label", rule_level(Content().storm).cast("double"))).select("label", "prediction")


def check_contract(names: list[str], accuracy: float, least: float = 0.97) -> None:
    """A model whose inputs differ or whose accuracy is too low is refused (M7)."""
    if tuple(names) != FEATURES:
        raise ValueError("the model's features are not those of the windows")
    if accuracy < least:
        raise ValueError(f"accuracy {accuracy:.3f} is below {least}")
