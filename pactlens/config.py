"""Settings of the risk engine: lexicon, severity tables and cascade thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

# Risk categories in order of precedence, each with its trigger substrings.
RISK_CATEGORIES = (
    ("Liability", ("liability", "responsible", "damages", "indemnify",
                   "indemnification", "hold harmless", "indemnified")),
    ("Penalty", ("penalty", "fine", "liquidated damages", "interest",
                 "charge", "forfeit", "late payment", "surcharge")),
    ("Termination", ("terminate", "termination", "cancel", "cancellation",
                     "rescind", "breach", "expiration", "expires")),
    ("Obligation", ("must", "shall", "obligated", "requirement",
                    "mandatory", "duty", "required to", "bound to")),
    ("Arbitration", ("arbitration", "dispute resolution", "governing law",
                     "jurisdiction", "venue", "mediation", "arbitrator")),
)

# Modal words with their obligation weight, strongest first.
MODAL_WEIGHTS = (
    ("must", 1.00), ("shall", 0.90), ("required", 0.85), ("obligated", 0.80),
    ("will", 0.65), ("should", 0.50), ("may", 0.25), ("might", 0.15), ("could", 0.10),
)

# Phrases that raise and lower severity.
AMPLIFIERS = (
    "not liable", "no liability", "not responsible",
    "unlimited", "sole", "absolute", "irrevocably",
    "waive", "waives", "forfeit", "forfeits",
    "immediately", "forthwith", "without notice",
)
SUPPRESSORS = (
    "not required", "no obligation", "shall not",
    "not obligated", "excluded from", "exempt",
)

# Base severity per category.
CATEGORY_BASE_WEIGHTS = (
    ("Liability", 0.75), ("Penalty", 0.70), ("Termination", 0.60),
    ("Obligation", 0.50), ("Arbitration", 0.45),
)

NONE_LABEL = "None"
SEVERITIES = ("High", "Medium", "Low")
DETECTORS = ("transformer", "ml", "keyword")


@dataclass(frozen=True)
class Lexicon:
    """Word lists and weights behind the keyword tier and the severity score."""

    categories: tuple = RISK_CATEGORIES
    modals: tuple = MODAL_WEIGHTS
    amplifiers: tuple = AMPLIFIERS
    suppressors: tuple = SUPPRESSORS
    base_weights: tuple = CATEGORY_BASE_WEIGHTS
    default_base_weight: float = 0.50
    amplifier_step: float = 0.15
    suppressor_step: float = 0.10
    delta_floor: float = -0.2
    delta_ceiling: float = 0.3
    high_threshold: float = 0.65
    medium_threshold: float = 0.35

    @property
    def category_names(self) -> tuple:
        return tuple(name for name, _ in self.categories)


def _as_float(value, default: float) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


@dataclass(frozen=True)
class CascadeConfig:
    """Cascade mode, thresholds and temperature.

    An unknown mode runs the keyword tier only.
    """

    mode: str = "auto"
    transformer_threshold: float = 0.6
    ml_threshold: float = 0.5
    temperature: float = 1.5
    lexicon: Lexicon = field(default_factory=Lexicon)

    def __post_init__(self):
        object.__setattr__(self, "mode", (self.mode or "auto").strip().lower())
        if self.temperature <= 0:
            raise ValueError(f"temperature must be positive, got {self.temperature}")

    @classmethod
    def from_settings(cls, settings: dict) -> "CascadeConfig":
        """Build from string settings; a malformed threshold falls back to its default."""
        return cls(
            mode=settings.get("mode") or "auto",
            transformer_threshold=_as_float(settings.get("transformer_threshold"), 0.6),
            ml_threshold=_as_float(settings.get("ml_threshold"), 0.5),
            temperature=float(settings.get("temperature", 1.5)),
            lexicon=settings.get("lexicon") or Lexicon(),
        )

    @property
    def uses_transformer(self) -> bool:
        return self.mode in ("transformer", "auto")

    @property
    def uses_ml(self) -> bool:
        return self.mode in ("ml", "auto")

    @property
    def enforce_thresholds(self) -> bool:
        return self.mode == "auto"
