"""End-to-end runs: train, evaluate a saved model, detect."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.functions.scalars import numeric_columns, q
from flowsift.operators import attribution, clean, encode, fuse, metrics, model, order, reports, views
from flowsift.operators.alerts import match_alerts
from flowsift.operators.common_schema import descriptions_of
from flowsift.operators.rules import Rule, apply_rules
from flowsift.plans.profiles import Profile
from flowsift.session import materialise
from flowsift.sources import sinks

ORD = "_ord"
META = [ORD, "label", "split"]


@dataclass(frozen=True)
class TrainConfig:
    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15)
    stratify: bool = True
    seed: int = 42
    common: bool = False
    digits: int = 4
    threshold: float | None = None
    boost: model.BoostConfig = field(default_factory=model.BoostConfig)


def clean_labelled(df: DataFrame, profile: Profile, ordinal: str = ORD) -> DataFrame:
    """Label, remove exact copies, drop identifying columns, NULL for infinities, remove near copies.

    Exact copies are judged without the label and with the identifying columns; near copies on
    what is left. The first row of a group stays with its own label.
    """
    labelled = profile.label(df)
    cleaned = clean.inf_to_null(clean.drop_known(labelled, [c for c in profile.drops if c != "label"]))
    # Exact copies are near copies too and the earliest of them all is the earliest of the exact ones it belongs to, so
    # one pass over rounded rows does both steps.
    return clean.dedup_near(cleaned, [c for c in cleaned.columns if c not in ("label", ordinal)], ordinal)


def fit_state(train: DataFrame, profile: Profile) -> sinks.PrepState:
    """Dictionary and medians from the training rows only.

    Medians are taken after encoding, so a categorical column has one too. Text columns that
    no profile lists are encoded as well.
    """
    names = [c for c in train.columns if c not in META]
    kinds = dict(train.dtypes)
    categoricals = [c for c in names if c in profile.categoricals or kinds[c] == "string"]
    encoders = encode.fit_encoder(train, categoricals) if categoricals else (
        train.sparkSession.createDataFrame([], encode.SCHEMA))
    numbers = numeric_columns(train, [*META, *categoricals])
    medians = clean.medians_as_dict(clean.fit_medians(train, numbers))
    return sinks.PrepState(encoders, medians, names, descriptions_of(names))


def apply_state(df: DataFrame, state: sinks.PrepState, keep: Sequence[str], fill: str = "median") -> DataFrame:
    """Encode, impute and shape a table with fitted state; ``keep`` columns come first.

    ``fill='zero'`` puts 0 for missing numbers, as detection does; training uses medians.
    """
    coded = {r["column_name"] for r in state.encoders.select("column_name").distinct().collect()}
    present = [c for c in state.features if c in coded and c in df.columns]
    encoded = encode.encode(df, state.encoders, present) if present else df
    return clean.impute(clean.conform_features(encoded, state.features, keep), state.medians, fill, keep)


@dataclass
class Trained:
    model: PipelineModel
    state: sinks.PrepState
    features: list[str]
    threshold: float
    matrix: DataFrame
    metrics: DataFrame


def evaluate(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> dict[str, DataFrame]:
    """All evaluation tables of a scored table."""
    sweep = metrics.threshold_sweep(df, score, label)
    return {"metrics": metrics.binary_metrics(df, score, label, threshold),
            "class_report": metrics.class_report(df, score, label, threshold),
            "roc_curve": metrics.roc_curve(df, score, label), "pr_curve": metrics.pr_curve(df, score, label),
            "pr_auc": metrics.pr_auc(df, score, label),
            "threshold_sweep": sweep, "threshold_best": metrics.threshold_best(sweep)}


def _matrix(split: DataFrame, state: sinks.PrepState, profile: Profile, common: bool) -> tuple[DataFrame, list[str]]:
    matrix = apply_state(split, state, META)
    if common:
        matrix = profile.to_common(matrix, tuple(META))
    return matrix, [c for c in matrix.columns if c not in META]


def run_training(df: DataFrame, profile: Profile, ordinal: str, config: TrainConfig | None = None,
                 out: str | None = None) -> Trained:
    """Clean, split, fit on the training rows, train, evaluate on the test rows, save.

    ``ordinal`` names a unique column giving the order of the rows. The cleaned and split table and the finished matrix are each written once to the shared
    folder, because fitting and boosting read them many times.
    """
    cfg = config or TrainConfig()
    cleaned = materialise(clean_labelled(df.withColumnRenamed(ordinal, ORD), profile), "clean")
    split = materialise(order.split_stratified(cleaned, ORD, "label" if cfg.stratify else None, cfg.ratios, cfg.seed), "split")
    state = fit_state(split.filter("split = 'train'"), profile)
    matrix, features = _matrix(split, state, profile, cfg.common)
    matrix = materialise(matrix, "matrix")
    fitting = matrix.filter("split <> 'test'").withColumn("is_val", F.col("split") == "validation")
    fitted = model.train_model(fitting, features, "label", cfg.boost, "is_val")
    limit = cfg.threshold if cfg.threshold is not None else profile.threshold
    # All tables of the evaluation read labels and scores only, computed once.
    scored = model.score(matrix.filter("split = 'test'"), fitted, features, limit)
    results = evaluate(materialise(scored.select("label", "score"), "scored"), limit)
    if out:
        model.save_model(fitted, f"{out}/model")
        state.save(f"{out}/state")
        meta = [(profile.name, "common" if cfg.common else "native", float(limit), features)]
        sinks.write_metrics(df.sparkSession.createDataFrame(
            meta, "profile string, mode string, threshold double, features array<string>"), f"{out}/meta")
        sinks.write_metrics(metrics.split_summary(matrix), f"{out}/splits")
        for name, table in results.items():
            sinks.write_metrics(table, f"{out}/{name}")
    return Trained(fitted, state, features, limit, matrix, results["metrics"])


def run_evaluation(spark: SparkSession, df: DataFrame, profile: Profile, ordinal: str, saved: str,
                   config: TrainConfig | None = None, refit: bool = False) -> dict[str, DataFrame]:
    """Evaluate a saved model on the test part of a labelled table.

    The saved dictionary and medians are applied. ``refit`` fits them anew on all rows of this
    table, which lets test rows influence the preparation; it exists for comparison only.
    """
    cfg = config or TrainConfig()
    cleaned = materialise(clean_labelled(df.withColumnRenamed(ordinal, ORD), profile), "clean")
    split = order.split_stratified(cleaned, ORD, "label" if cfg.stratify else None, cfg.ratios, cfg.seed)
    meta = spark.read.json(f"{saved}/meta").first()
    state = fit_state(split, profile) if refit else sinks.PrepState.load(spark, f"{saved}/state")
    matrix, _ = _matrix(split, state, profile, meta["mode"] == "common")
    test = matrix.filter("split = 'test'")
    limit = cfg.threshold if cfg.threshold is not None else meta["threshold"]
    scored = model.score(test, model.load_model(f"{saved}/model"), list(meta["features"]), limit)
    return evaluate(materialise(scored.select("label", "score"), "scored"), limit)


def hybrid_detection(scored: DataFrame, alerts: DataFrame | None = None, rules: Sequence[Rule] | None = None,
                     threshold: float = 0.5, score: str = "score", gravest: bool = False) -> DataFrame:
    """Flows with ml, sig, fusion and severity, from a score column and one signature source:
    an alert table, or flow rules."""
    judged = fuse.verdicts(scored, score, threshold)
    signed = match_alerts(judged, alerts, gravest) if alerts is not None else apply_rules(judged, rules)
    return fuse.severity_detection(fuse.fuse(signed))


def run_detection(flows: DataFrame, fitted: PipelineModel, features: Sequence[str], threshold: float,
                  state: sinks.PrepState | None = None, common: Profile | None = None,
                  alerts: DataFrame | None = None, rules: Sequence[Rule] | None = None,
                  flow_id: str = "flow_id", analysis_id: str = "analysis_id", fill: str = "zero",
                  out: str | None = None, explain: bool = False) -> dict[str, DataFrame]:
    """Score flows, match signatures, fuse, grade, summarise; optionally explain and store.

    ``state`` prepares the flows as in training; ``common`` then maps them to the common schema
    for a model trained on it. Returns detections and summaries, and with ``explain`` the
    incident records with report text of all intrusions.
    """
    def prepared(rows: DataFrame, keep: list[str]) -> DataFrame:
        ready = rows if state is None else apply_state(rows, state, keep, fill)
        return ready if common is None else common.to_common(ready, tuple(keep))

    # The untouched flow travels beside its prepared features, so nothing has to be joined back.
    whole = flows.withColumn("_flow", F.struct("*"))
    scored = model.score(prepared(whole, ["_flow"]), fitted, features, None).select("_flow.*", "score")
    judged = materialise(hybrid_detection(scored, alerts, rules, threshold), "judged")
    detections = fuse.detection_rows(judged, flow_id, analysis_id)
    results = {"detections": detections, "summaries": views.run_summary(judged, analysis_id)}
    if explain:
        # The judged row travels through the attribution: flow ids are unique within a run only.
        hits = judged.filter("is_intrusion")
        packed = hits.withColumn("_judged", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
        why = attribution.attribute(prepared(packed, ["_judged"]), fitted, features, ["_judged"])
        back = F.from_json("_judged", hits.schema).alias("j")
        listed = why.select(back, "attributions").select("j.*", "attributions").withColumn("detection_id", fuse.detection_id(flow_id, analysis_id))
        results["incidents"] = reports.incident_report(reports.incidents(listed))
    if out:
        sinks.write_detections(detections, results["summaries"], out)
    return results


def flow_results(judged: DataFrame, truth: Column, flow_id: str = "flow_id") -> DataFrame:
    """Per-flow result table of a detector comparison: truth, the three verdicts, rules, flow ends.

    ``truth`` is true for attacks: a label condition, or ``lit(True)`` for a capture of attacks only.
    """
    def verdict(flag: Column) -> Column:
        return F.when(flag, "ATTACK").otherwise("BENIGN")

    time = F.col("last_us") / 1e6 if "last_us" in judged.columns else F.lit(None).cast("double")
    return fuse.with_aliases(judged).select(
        q(flow_id).alias("flow_id"), verdict(truth).alias("ground_truth"), F.col("ml.probability").alias("ml_probability"),
        verdict(F.col("ml.is_intrusion")).alias("ml_verdict"), verdict(F.col("sig.is_intrusion")).alias("signature_verdict"),
        F.array_join("sig.matched_rules", "; ").alias("signature_rules"), verdict(F.col("is_intrusion")).alias("hybrid_verdict"),
        F.col("triggered_by").alias("hybrid_trigger"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        time.alias("timestamp"))


def run_comparison(judged: DataFrame, truth: Column, flow_id: str = "flow_id", out: str | None = None) -> dict[str, DataFrame]:
    """Compare classifier, signatures and their union on fused flows; optionally store CSV and JSON."""
    flags = judged.select(truth.cast("int").alias("label"), F.col("ml.is_intrusion").alias("ml_flag"),
                          F.col("sig.is_intrusion").alias("sig_flag"))
    results = {"flows": flow_results(judged, truth, flow_id), "metrics": metrics.compare_detectors(flags),
               "component_counts": metrics.complementarity(flags)}
    if out:
        sinks.write_flow_results(results["flows"], f"{out}/flows", "csv")
        sinks.write_metrics(results["metrics"], f"{out}/metrics")
        sinks.write_metrics(results["component_counts"], f"{out}/component_counts")
    return results
