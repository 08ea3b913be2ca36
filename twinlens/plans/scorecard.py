"""Scorecards: from a pair to the numbers, and from the numbers to a decision.

Rules work on a table of flat scorecard rows (one row per evaluated run), so
one run and a long run history are judged by the same projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.functions.scalars import fixed
from twinlens.operators import fidelity, privacy
from twinlens.operators.columns import quasi_identifiers
from twinlens.operators.pair import Pair
from twinlens.operators.profile import pair_stats

FIDELITY = ("wasserstein", "js_divergence", "correlation_similarity", "mmd", "kl_divergence")
UTILITY = ("baseline_accuracy", "tstr_accuracy", "trts_accuracy", "performance_drop")
PRIVACY = ("exact_matches", "mia_risk_score", "k_anonymity", "is_compliant")


def metric_row(pair: Pair, exclude_ids: tuple[str, ...] = (), mmd: bool = False) -> DataFrame:
    """Fidelity and exact privacy metrics of a pair as one row.

    Each metric is a one-row plan used as a scalar subquery: Spark runs them
    side by side and reuses the shuffles that the plans have in common.
    """
    stats = pair_stats(pair, pair.numeric, sketch=True)
    cells = [
        fidelity.wasserstein_judge(pair, stats).scalar().alias("wasserstein"),
        fidelity.js_divergence(pair).scalar().alias("js_divergence"),
        fidelity.corr_similarity(pair, stats=stats).scalar().alias("correlation_similarity"),
        fidelity.kl_divergence(pair).scalar().alias("kl_divergence"),
        privacy.linkability(pair, exclude_ids).select("exact_matches").scalar().alias("exact_matches"),
        privacy.k_anonymity(pair.synth, quasi_identifiers(pair.tagged)).scalar().alias("k_anonymity"),
    ]
    if mmd:
        cells.insert(3, fidelity.mmd_features(pair).scalar().alias("mmd"))
    return pair.tagged.sparkSession.range(1).select(*cells)


def measured(pair: Pair, target: str | None, classifier: str = "forest", parity: bool = False, row_id: str | None = None, **attack) -> tuple[dict, float | None]:
    """(utility values, attack accuracy) by MLlib forests or, with ``classifier`` "counts", by the count tables of
    ``bayes``. What could not be measured is null; with ``parity`` it gets the published constants instead: no drop, an
    attack accuracy of ``ATTACK_FALLBACK``."""
    from twinlens.operators import bayes, modelling

    if classifier == "counts":
        use = bayes.utility(pair, target, row_id).first().asDict() if target else dict(modelling.NO_UTILITY)
        risk = bayes.attack(pair, row_id).first()["accuracy"]
    else:
        use = modelling.utility_or_failed(pair, target) if target else dict(modelling.NO_UTILITY)
        risk = modelling.attack_or_failed(pair, **attack)
    if parity:
        use["performance_drop"] = 0.0 if use["performance_drop"] is None else use["performance_drop"]
        risk = C.ATTACK_FALLBACK if risk is None else risk
    return use, risk


def evaluate(
    real: DataFrame,
    synth: DataFrame,
    target: str | None = None,
    exclude_ids: tuple[str, ...] = (),
    attack_rows: int | None = None,
    classifier: str = "forest",
    parity: bool = False,
) -> DataFrame:
    """Full flat scorecard of a pair, with utility and the membership attack (see ``measured``)."""
    from twinlens.operators.profile import pick_target

    pair = Pair.of(real, synth)
    target = target or pick_target(pair.real)
    use, attack = measured(pair, target, classifier, parity, **({} if classifier == "counts" else {"rows": attack_rows}))
    row = metric_row(pair, exclude_ids, mmd=True)
    return with_compliance(
        row.select("*", *[F.lit(use[k]).cast("double").alias(k) for k in UTILITY], F.lit(attack).cast("double").alias("mia_risk_score"))
    )


def with_compliance(rows: DataFrame) -> DataFrame:
    """No exact copy, and an attack that stays below its threshold."""
    return rows.withColumn(
        "is_compliant", (F.col("exact_matches") == 0) & (F.col("mia_risk_score") < F.lit(C.MAX_ATTACK_ACCURACY))
    )


def nested(rows: DataFrame, *keep: str) -> DataFrame:
    """The report shape: fidelity, utility and privacy structs."""
    return rows.select(
        *keep,
        F.struct(*FIDELITY).alias("fidelity"),
        F.struct(*UTILITY).alias("utility"),
        F.struct(
            F.struct("exact_matches", (F.col("exact_matches") == 0).alias("is_compliant")).alias("linkability"),
            "mia_risk_score",
            "k_anonymity",
            "is_compliant",
        ).alias("privacy"),
    )


def judge(rows: DataFrame) -> DataFrame:
    """Add decision and note: privacy first, then group size, fidelity, utility. A pair of which
    any of these was not measured is never approved: it is an Error, unless what was measured fails."""
    drop = F.col("performance_drop")
    unknown = F.col("wasserstein").isNull() | F.col("is_compliant").isNull() | drop.isNull() | F.col("k_anonymity").isNull()
    cascade = (
        (F.col("wasserstein").isNull() | F.col("is_compliant").isNull(), "Error", "Missing Data"),
        (~F.col("is_compliant"), "Reject", "Privacy Failed (MIA/Linkability)"),
        (F.col("k_anonymity") < F.lit(C.MIN_K_ANONYMITY), "Reject", "Low k-anonymity"),
        (F.col("wasserstein") > F.lit(C.MAX_WASSERSTEIN), "Reject", "Fidelity poor"),
        (drop > F.lit(C.MAX_UTILITY_DROP), "Reject", "Utility poor"),
        (unknown, "Error", "Missing Data"),
    )
    decision, note = F.lit("Approve"), F.lit("Passed all benchmarks.")
    for test, verdict, text in reversed(cascade):
        decision = F.when(test, F.lit(verdict)).otherwise(decision)
        note = F.when(test, F.lit(text)).otherwise(note)
    return rows.withColumn("decision", decision).withColumn("note", note)


def next_step(rows: DataFrame) -> DataFrame:
    """Where a judged run goes: finish, synthesise again, or a new seed table."""
    return rows.withColumn(
        "next",
        F.when((F.col("decision") == "Approve") | (F.col("iteration") >= C.MAX_ROUNDS), F.lit("logging"))
        .when(F.col("note").contains("Fidelity"), F.lit("critic"))
        .otherwise(F.lit("reasoning")),
    )


def _or(name: str, default: float) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def radar_report(rows: DataFrame, *keep: str) -> DataFrame:
    half = F.lit(0.5)
    return rows.select(
        *keep,
        (F.lit(1.0) / (F.lit(1.0) + _or("wasserstein", 0.5))).alias("fidelity_w"),
        _or("correlation_similarity", 0.5).alias("fidelity_corr"),
        _or("tstr_accuracy", 0.5).alias("utility_tstr"),
        _or("trts_accuracy", 0.5).alias("utility_trts"),
        (F.lit(1.0) - (_or("mia_risk_score", 0.5) - half) * F.lit(2.0)).alias("privacy_mia"),
    )


def radar_dashboard(rows: DataFrame, *keep: str) -> DataFrame:
    zero = F.lit(0.0)
    matches = F.col("exact_matches").cast("double")
    return rows.select(
        *keep,
        F.greatest(zero, F.lit(1.0) - F.col("wasserstein") / F.lit(C.MAX_WASSERSTEIN)).alias("fidelity"),
        F.col("tstr_accuracy").alias("utility"),
        F.greatest(zero, F.lit(1.0) - (F.col("mia_risk_score") - F.lit(0.5)) / F.lit(0.5)).alias("privacy"),
        F.least(_or("k_anonymity", 0.0) / F.lit(10.0), F.lit(1.0)).alias("k_anonymity"),
        F.when(matches.isNull() | (matches == 0), F.lit(1.0)).otherwise(F.greatest(zero, F.lit(1.0) - matches)).alias("linkability"),
    )


def pass_flags(rows: DataFrame) -> DataFrame:
    """Dashboard flags; note the strict comparisons, unlike the judge's."""
    return rows.select(
        "*",
        (_or("wasserstein", 1.0) < F.lit(C.MAX_WASSERSTEIN)).alias("f_pass"),
        (_or("performance_drop", 100.0) < F.lit(C.MAX_UTILITY_DROP)).alias("u_pass"),
        F.coalesce(F.col("is_compliant"), F.lit(False)).alias("p_pass"),
    )


def overall_grade(rows: DataFrame, *keep: str) -> DataFrame:
    passed = F.col("f_pass").cast("int") + F.col("u_pass").cast("int") + F.col("p_pass").cast("int")
    overall = F.floor(passed.cast("double") / F.lit(3.0) * F.lit(100.0)).cast("int")
    grade = (
        F.when(F.col("overall") > 85, F.lit("Excellent (85+)"))
        .when(F.col("overall") >= 70, F.lit("Good (70+)"))
        .otherwise(F.lit("Needs Improvement (<70)"))
    )
    flagged = pass_flags(rows)
    return flagged.select(*keep, "f_pass", "u_pass", "p_pass", overall.alias("overall")).withColumn("grade", grade)


def compliance_checklist(rows: DataFrame, *keep: str) -> DataFrame:
    """Eight (label, ok) rows per judged run; needs ``decision`` and ``epsilon``."""
    w, drop = F.col("wasserstein"), F.col("performance_drop")
    k = F.coalesce(F.col("k_anonymity"), F.lit(0))
    items = (
        (F.lit(True), F.lit("Record of processing generated")),
        (F.col("epsilon").isNotNull(), F.lit("Noise applied")),
        (F.col("f_pass"), F.concat(F.lit("Fidelity verified (W="), fixed(w, 4), F.lit(f" < {C.MAX_WASSERSTEIN})"))),
        (F.col("u_pass"), F.concat(F.lit("Utility retained (drop="), fixed(drop, 1), F.lit(f"% < {C.MAX_UTILITY_DROP:.0f}%)"))),
        (F.col("p_pass"), F.concat(F.lit("Membership attack resisted ("), fixed(F.col("mia_risk_score"), 3), F.lit(f" < {C.MAX_ATTACK_ACCURACY})"))),
        (k >= C.MIN_K_ANONYMITY, F.concat(F.lit("k-anonymity satisfied (k="), k.cast("string"), F.lit(")"))),
        (F.coalesce(F.col("exact_matches"), F.lit(0)) == 0, F.lit("No exact copy")),
        (F.col("decision") == "Approve", F.concat(F.lit("Decision: "), F.col("decision"))),
    )
    cells = F.array(
        *[F.struct(F.lit(i + 1).alias("item"), label.alias("label"), ok.alias("ok")) for i, (ok, label) in enumerate(items)]
    )
    return pass_flags(rows).select(*keep, F.inline(cells))


REPORT_SCHEMA = """
    fidelity struct<wasserstein:double, js_divergence:double, correlation_similarity:double, mmd:double, kl_divergence:double>,
    utility struct<baseline_accuracy:double, tstr_accuracy:double, trts_accuracy:double, performance_drop:double>,
    privacy struct<linkability:struct<exact_matches:bigint, is_compliant:boolean>, mia_risk_score:double, k_anonymity:bigint, is_compliant:boolean>
"""


def flatten_report(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Flat columns of report texts; parts that are missing get their defaults."""
    parsed = df.select(*keep, F.from_json(text, REPORT_SCHEMA).alias("r"))

    def at(path: str, default=None) -> Column:
        col = F.col(f"r.{path}")
        return col if default is None else F.coalesce(col, F.lit(default))

    return parsed.select(
        *keep,
        at("fidelity.wasserstein", 1.0).alias("wass"),
        at("fidelity.js_divergence").alias("jsd"),
        at("fidelity.correlation_similarity").alias("corr_sim"),
        at("fidelity.mmd").alias("mmd"),
        at("utility.tstr_accuracy", 0.0).alias("tstr"),
        at("utility.trts_accuracy").alias("trts"),
        at("utility.performance_drop", 100.0).alias("perf_drop"),
        at("utility.baseline_accuracy").alias("baseline"),
        at("privacy.mia_risk_score", 1.0).alias("mia"),
        at("privacy.k_anonymity", 0).cast("bigint").alias("k_anon"),
        at("privacy.linkability.exact_matches").alias("linkability"),
        at("privacy.is_compliant", False).alias("is_compliant"),
        (at("fidelity.wasserstein", 1.0) < F.lit(C.MAX_WASSERSTEIN)).alias("f_pass"),
        (at("utility.performance_drop", 100.0) < F.lit(C.MAX_UTILITY_DROP)).alias("u_pass"),
        at("privacy.is_compliant", False).alias("p_pass"),
    )
