"""Parameters and phrase lists of the reasoning-trace jobs."""

from __future__ import annotations

from dataclasses import dataclass

# Phrase patterns by category, in the order that decides ties.
MARKERS = {
    "hedge": [
        r"\bI think\b", r"\bprobably\b", r"\bmight be\b", r"\bperhaps\b", r"\blikely\b", r"\bI'm not sure\b",
        r"\bit seems\b", r"\bpossibly\b", r"\bcould be\b",
    ],
    "revise": [
        r"\bWait\b", r"\bActually\b", r"\bNo,\b", r"\bLet me redo\b", r"\bthat's wrong\b", r"\bcorrection\b",
        r"\bLet me reconsider\b", r"\bOn second thought\b",
    ],
    "verify": [r"\bLet me verify\b", r"\bdouble-check\b", r"\bchecking\b", r"\bto confirm\b", r"\bLet me check\b"],
    "explicit": [
        r"\bI'm uncertain\b", r"\bnot confident\b", r"\bunsure\b", r"\bhard to determine\b", r"\bdifficult to say\b",
        r"\bnot entirely sure\b",
    ],
}

# Phrase patterns by epistemic state, in the order that decides ties.
STATES = {
    "exploring": [
        r"\bLet me think\b", r"\bLet's consider\b", r"\bLooking at\b", r"\bFirst\b", r"\bLet me analyze\b", r"\bWhat if\b",
        r"\bpossible\b", r"\bmaybe\b", r"\bcould be\b", r"\bI need to consider\b", r"\bLet me start\b",
    ],
    "committing": [
        r"\btherefore\b", r"\bthus\b", r"\bso the answer\b", r"\bmost likely\b", r"\bI think it's\b", r"\bthis points to\b",
        r"\bthe diagnosis is\b", r"\bthis suggests\b", r"\bconsistent with\b", r"\bstrongly suggests\b",
    ],
    "verifying": [
        r"\bLet me verify\b", r"\bLet me check\b", r"\bdouble-check\b", r"\bto confirm\b", r"\bchecking\b",
        r"\bDoes this make sense\b", r"\bLet me make sure\b", r"\bIs this consistent\b",
    ],
    "backtracking": [
        r"\bWait\b", r"\bActually\b", r"\bNo,\b", r"\bHmm\b", r"\bthat's wrong\b", r"\bLet me reconsider\b",
        r"\bOn second thought\b", r"\bI was wrong\b", r"\bcorrection\b", r"\bhold on\b",
    ],
}
NEUTRAL = "neutral"
ALL_STATES = [*STATES, NEUTRAL]

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = [
    "Dr.", "Mr.", "Mrs.", "Ms.", "e.g.", "i.e.", "vs.", "etc.", "approx.", "Fig.", "Eq.", "No.", "Vol.", "Inc.", "Ltd.",
    "St.", "Jr.", "Sr.", "Prof.", "Dept.",
]

# Phrase lists for texts that hold none of the phrases above.
COMMON_MARKERS = {"hedge": ["that", "this"], "revise": ["was", "with"], "verify": ["by", "from"], "explicit": ["are", "as"]}
COMMON_STATES = {"exploring": ["that", "or"], "committing": ["is", "be"], "verifying": ["with", "for"], "backtracking": ["was", "not"]}


def whole_words(lexicon: dict[str, list[str]]) -> dict[str, list[str]]:
    """Patterns for single words."""
    return {k: [rf"\b{w}\b" for w in words] for k, words in lexicon.items()}


@dataclass(frozen=True)
class Params:
    """Thresholds of the analysis."""

    pilot_questions: int = 20
    seed: int = 42
    drop: float = 0.15
    z: float = -1.5
    flat_std: float = 0.01
    min_words: int = 5
    min_chars: int = 50
    min_sentences: int = 3
    coupling_sentences: int = 5
    min_traces: int = 5
    p: float = 0.05
    pct_with_transitions: float = 50.0
    rho: float = 0.15
    models_passing: int = 2
    tau: float = 0.8
    sustain: int = 2
    depth_tau: float = 0.7
    near: int = 3


PARAMS = Params()
