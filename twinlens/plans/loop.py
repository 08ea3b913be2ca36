"""The whole job: seed, pilot, ensemble, noise, judgement; at most three rounds.

The loop itself runs on the driver and only moves plans and a few numbers; each
round's table is settled in the shared folder, so rounds do not pile up lineage.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.operators import generators, privacy, sampling, synthesizers
from twinlens.operators.pair import Pair
from twinlens.operators.profile import pick_target
from twinlens.plans import scorecard as S
from twinlens.session import settle
from twinlens.sources import records

ROW_ID = "_row_id"


@dataclass(frozen=True)
class Request:
    """What to make. ``seed`` must stay secret where the noise protects somebody."""

    domain: str = "Healthcare"
    goal: str = "Data synthesis"
    rows: int = C.DEFAULT_ROWS
    epsilon: float = C.DEFAULT_EPSILON
    model: str = "auto"
    output_format: str = "CSV"
    seed: int = C.DEFAULT_SEED
    attack_trees: int = C.ATTACK_TREES
    classifier: str = "forest"
    parity: bool = False
    max_rounds: int = C.MAX_ROUNDS


@dataclass
class Outcome:
    real: DataFrame
    synth: DataFrame | None = None
    scorecard: DataFrame | None = None
    decision: str = "Error"
    note: str = "Missing Data"
    iteration: int = 0
    cold_start: bool = False
    model_selection: str = ""
    pilot_scores: list[tuple[str, float]] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    proof: dict = field(default_factory=dict)
    trace: list[str] = field(default_factory=list)


def propose(real: DataFrame, request: Request, rows: int, seed: int) -> tuple[DataFrame, str, list, dict[str, float]]:
    """The ensemble of the two best samplers, with ``ROW_ID``; the real table
    itself where every sampler failed."""
    spark = real.sparkSession
    ids = spark.range(rows).withColumnRenamed("id", ROW_ID)
    found = synthesizers.pilot(real, ids, ROW_ID, synthesizers.candidates(request.model), seed)
    scores = [(name, score) for name, score, _ in found]
    found = [x for x in found if x[2] is not None]
    if not found:
        from twinlens.operators.ordered import ordered_row_number

        return ordered_row_number(real, real.columns, ROW_ID), "Fallback", scores, {}
    if len(found) == 1:
        return found[0][2], found[0][0], scores, {found[0][0]: 1.0}
    (m1, s1, d1), (m2, s2, d2) = found[:2]
    inverse = [1.0 / (s + C.WEIGHT_FLOOR) for s in (s1, s2)]
    w1 = inverse[0] / sum(inverse) if sum(inverse) else 0.5  # no number to score by: both alike
    mixed = sampling.ensemble_mix(d1, d2, w1, rows, ROW_ID, (m1, m2), seed)
    # A row id can come from both models; the source makes it unique again.
    keyed = mixed.withColumn(ROW_ID, F.col(ROW_ID) * 2 + (F.col("source") == m2).cast("bigint")).drop("source")
    return keyed, f"Ensemble({m1}+{m2})", scores, {m1: w1, m2: 1.0 - w1}


def judge_pair(real: DataFrame, synth: DataFrame, request: Request, iteration: int, epsilon: float) -> DataFrame:
    """Judged flat scorecard row of one round, with the epsilon that its proof states."""
    pair = Pair.of(real, synth)
    target = pick_target(pair.real)
    use, attack = S.measured(pair, target, request.classifier, request.parity, **({} if request.classifier == "counts" else {"trees": request.attack_trees}))
    row = S.metric_row(pair, mmd=True).select(
        "*",
        *[F.lit(use[k]).cast("double").alias(k) for k in S.UTILITY],
        F.lit(attack).cast("double").alias("mia_risk_score"),
        F.lit(iteration).alias("iteration"),
        F.lit(request.domain).alias("domain"),
        F.lit(epsilon).alias("epsilon"),
    )
    return S.next_step(S.judge(S.with_compliance(row)))


RECORDS = ("audit", "log", "report", "certificate", "history")


def write_records(out: Outcome, request: Request, path: str, run_id: str) -> dict[str, bool]:
    """Audit, run log, report, certificate and history entry of a finished run, each appended exactly once below
    ``path`` (see ``records.append_once``); says which were new."""
    row = out.scorecard.withColumns(
        {
            "timestamp": records.utc_text(F.current_timestamp()),
            "goal": F.lit(request.goal),
            "output_format": F.lit(request.output_format),
            "synthesis_logic": F.lit(", ".join(f"{c} {t}" for c, t in out.real.dtypes)),
        }
    )
    history = row.select("domain", F.lit("tabular").alias("modality"), F.lit(out.model_selection).alias("model"), F.col("wasserstein").alias("score"), F.col("goal").alias("description"))
    made = {
        "audit": records.audit_records(row, privacy.proof_columns(F.col("epsilon")), "judge"),
        "log": records.run_log(row),
        "report": records.report_text(row, "timestamp", "output_format", "decision", "note"),
        "certificate": records.certificate_text(row, F.col("timestamp"), "domain"),
        "history": records.history_rows(history),
    }
    return {kind: records.append_once(made[kind], f"{path}/{kind}", run_id) for kind in RECORDS}


def run(spark: SparkSession, request: Request, real: DataFrame | None = None, records_path: str | None = None, run_id: str | None = None) -> Outcome:
    """Rounds until the judge approves or the rounds are used up. With ``records_path`` the finished run
    writes its records there; a run that is repeated under the same ``run_id`` (by default the digest of
    the request) appends nothing twice."""
    out = _rounds(spark, request, real)
    if records_path:
        write_records(out, request, records_path, run_id or hashlib.md5(repr(request).encode()).hexdigest())
    return out


def _rounds(spark: SparkSession, request: Request, real: DataFrame | None) -> Outcome:
    real, cold = generators.seed_or_input(spark, real, request.domain, request.rows, request.seed)
    out = Outcome(real=real, cold_start=cold)
    rows = max(request.rows, C.MIN_COLD_START_ROWS) if cold else real.count()
    while True:
        seed = request.seed + out.iteration
        draft, out.model_selection, out.pilot_scores, out.weights = propose(out.real, request, rows, seed)
        out.trace.append(f"pilot: {out.model_selection}")
        draft = settle(draft)
        safe, out.proof, status = privacy.sanitise(
            draft, out.real, request.epsilon, out.iteration, seed, F.col(ROW_ID), exclude=(ROW_ID,)
        )
        out.synth = settle(safe.drop(ROW_ID))
        out.trace.append(f"privacy: {status}")
        out.iteration += 1
        out.scorecard = settle(judge_pair(out.real, out.synth, request, out.iteration, out.proof["epsilon"]))
        verdict = out.scorecard.first()
        out.decision, out.note = verdict["decision"], verdict["note"]
        out.trace.append(f"judge: {out.decision} ({out.note})")
        if verdict["next"] == "logging" or out.iteration >= request.max_rounds:
            return out
        if cold and "Fidelity" in out.note:
            out.real = settle(generators.augment_seed(out.real, request.domain, request.rows, request.seed, out.iteration))
