"""Fixed tables of the job protocol, and the single-response step shared by stream and test."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions.cases import lookup

# Transcript package states in order, and the terminal non-success states.
PACKAGE_STATES = (
    "initialized",
    "probed",
    "source-selected",
    "source-acquired",
    "corrected",
    "translated",
    "chaptered",
    "complete",
)
PACKAGE_FAILURES = ("blocked", "incomplete")

# Job phases with the review gate or input each one waits for.
GATES = {
    "awaiting-canonical-review": "canonical",
    "awaiting-production-blueprint-review": "motion-blueprint",
    "awaiting-motion-plan-review": "motion-plan",
    "awaiting-keyframe-review": "keyframe-set",
    "awaiting-spacing-plan-review": "spacing-plan",
    "awaiting-sequence-review": "sequence",
    "awaiting-package-review": "package",
}
INPUTS = {
    "awaiting-keyframe-input": "keyframes",
    "awaiting-spacing-plan-input": "spacing-plan",
    "awaiting-sequence-input": "sequence",
}
RESTING = ("initializing", "package-ready", "review-complete", "diagnosis-complete")
PHASES = (*GATES, *INPUTS, *RESTING)
FIRST_PHASE = "awaiting-canonical-review"
APPROVED, CHANGES = "approved", "changes-requested"


@dataclass(frozen=True)
class Step:
    """A response that is valid in ``phase`` and the phase it leads to."""

    phase: str
    kind: str
    gate: str
    decision: str
    return_to: str
    then: str


def _review(phase: str, then: str, back: str | None = None) -> list[Step]:
    gate = GATES[phase]
    return [Step(phase, "review", gate, APPROVED, "", then), Step(phase, "review", gate, CHANGES, "", back or phase)]


def _input(phase: str, then: str) -> list[Step]:
    return [Step(phase, "input", INPUTS[phase], "", "", then)]


def _package(routes: dict[str, str]) -> list[Step]:
    phase = "awaiting-package-review"
    return [Step(phase, "review", "package", APPROVED, "", "package-ready")] + [
        Step(phase, "review", "package", CHANGES, route, then) for route, then in routes.items()
    ]


# The protocol versions as transition tables.
STEPS = {
    "v1": [
        *_review("awaiting-canonical-review", "awaiting-production-blueprint-review"),
        *_review("awaiting-production-blueprint-review", "awaiting-keyframe-input"),
        *_input("awaiting-keyframe-input", "awaiting-keyframe-review"),
        *_review("awaiting-keyframe-review", "awaiting-spacing-plan-input", "awaiting-keyframe-input"),
        *_input("awaiting-spacing-plan-input", "awaiting-spacing-plan-review"),
        *_review("awaiting-spacing-plan-review", "awaiting-sequence-input", "awaiting-spacing-plan-input"),
        *_input("awaiting-sequence-input", "awaiting-sequence-review"),
        *_review("awaiting-sequence-review", "awaiting-package-review", "awaiting-sequence-input"),
        *_package({
            "keyframes": "awaiting-keyframe-input",
            "spacing-plan": "awaiting-spacing-plan-input",
            "sequence": "awaiting-sequence-input",
        }),
    ],
    "v2": [
        *_review("awaiting-canonical-review", "awaiting-motion-plan-review"),
        *_review("awaiting-motion-plan-review", "awaiting-keyframe-input"),
        *_input("awaiting-keyframe-input", "awaiting-keyframe-review"),
        *_review("awaiting-keyframe-review", "awaiting-sequence-input", "awaiting-keyframe-input"),
        *_input("awaiting-sequence-input", "awaiting-sequence-review"),
        *_review("awaiting-sequence-review", "awaiting-package-review", "awaiting-sequence-input"),
        *_package({"keyframes": "awaiting-keyframe-input", "sequence": "awaiting-sequence-input"}),
    ],
}

# a job of the second version whose intent holds no in-between position has no sequence to ask for after its keyframes
KEYFRAMES_ONLY = "v2-keyframes-only"
STEPS[KEYFRAMES_ONLY] = [
    replace(s, then="awaiting-sequence-review") if s.phase == "awaiting-keyframe-review" and s.decision == APPROVED else s for s in STEPS["v2"]
]
#: An input column with this name gives each job its own version.
PROTOCOL = "protocol"


def waiting_kind(phase: Column) -> Column:
    return F.when(phase.isin(*INPUTS), "input").when(phase.isin(*GATES), "review").otherwise("none")


def gate_of(phase: Column) -> Column:
    return lookup(phase, {**GATES, **INPUTS}, F.lit("none"))


def context_text(job: Column, revision: Column) -> Column:
    """Canonical text a response must bind: the job and the revision it answers."""
    return F.concat(F.lit('{"job":'), job.cast("string"), F.lit(',"revision":'), revision.cast("string"), F.lit("}"))


def context_hash(job: int, revision: int) -> str:
    return hashlib.sha256(f'{{"job":{job},"revision":{revision}}}'.encode()).hexdigest()


def checkpoint_name(job: Column, revision: Column) -> Column:
    """Id of the checkpoint that waits at a revision; it is renewed with every revision."""
    return F.concat(F.lit("cp-"), revision.cast("string"), F.lit("-"), F.substring(F.sha2(context_text(job, revision), 256), 1, 16))


def checkpoint_id(job: int, revision: int) -> str:
    return f"cp-{revision}-{context_hash(job, revision)[:16]}"


def answer(version: str, job: int, phase: str, revision: int, response: dict) -> tuple[str, int, str]:
    """Phase, revision and status after one response."""
    bound = response["context_sha256"] == context_hash(job, revision) and response["checkpoint_id"] == checkpoint_id(job, revision)
    if response["job_revision"] != revision or not bound:
        return phase, revision, "stale"
    waiting = "input" if phase in INPUTS else "review" if phase in GATES else "none"
    if response["kind"] != waiting:
        return phase, revision, "kind-mismatch"
    for step in STEPS[response.get(PROTOCOL) or version]:
        if (step.phase, step.kind, step.gate, step.decision, step.return_to) == (
            phase, response["kind"], response["gate"], response["decision"], response["return_to"]
        ):
            return step.then, revision + 1, "applied"
    return phase, revision, "invalid"
