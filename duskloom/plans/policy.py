"""Masking policy: profiles, categories, operators, layered merge, validation and fingerprint. Driver-side only."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from datetime import date

# The entity labels of each category.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "secrets": ("API_KEY", "AWS_ACCESS_KEY", "AWS_SECRET_KEY", "AZURE_KEY", "GCP_API_KEY", "PRIVATE_KEY", "JWT", "URL_CREDENTIAL"),
    "financial": ("CREDIT_CARD", "IBAN_CODE", "CRYPTO", "US_BANK_NUMBER", "ABA_ROUTING_NUMBER", "CREDIT_CARD_EXPIRATION", "EXPIRATION_DATE", "CVV"),
    "identity": ("US_SSN", "US_ITIN", "NATIONAL_ID", "PASSPORT", "US_PASSPORT", "UK_PASSPORT", "DRIVER_LICENSE", "US_DRIVER_LICENSE", "UK_DRIVING_LICENCE", "MEDICAL_LICENSE", "US_NPI", "US_MBI", "UK_NHS", "UK_NINO", "DATE_OF_BIRTH", "PRIVATE_DATE", "EXPIRATION_DATE"),
    "contact": ("EMAIL_ADDRESS", "PHONE_NUMBER"),
    "network": ("IP_ADDRESS", "URL", "MAC_ADDRESS", "DOMAIN"),
    "personal": ("PERSON", "LOCATION", "ORGANIZATION"),
}

# Threshold and categories of each profile.
PROFILES: dict[str, tuple[float, tuple[str, ...]]] = {
    "strict": (0.4, ("secrets", "financial", "identity", "contact", "network", "personal")),
    "balanced": (0.5, ("secrets", "financial", "identity", "contact")),
    "minimal": (0.6, ("secrets", "financial")),
    "secrets_only": (0.6, ("secrets",)),
}
ALIASES = {"development_safe": "secrets_only"}

#: What a text is, and whether it is masked on its way out or restored on its way back.
SURFACES = {"user_message": "mask", "system_prompt": "mask", "tool_result": "mask", "assistant_text": "unmask", "tool_use_input": "unmask"}
OPERATORS = ("token", "redact", "mask", "hash", "broker", "local", "keep")

#: How far below the threshold a recognizer may score before context is known.
CONTEXT_BOOST = 0.35
DETECTOR_VERSION = 17


@dataclass(frozen=True)
class Operator:
    kind: str = "token"
    char: str = "*"
    from_end: int = 4


@dataclass(frozen=True)
class CustomRule:
    pattern: str
    entity: str
    is_regex: bool = False
    case_sensitive: bool = True
    priority: int = 100
    token: str | None = None
    surfaces: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    profile: str = "balanced"
    threshold: float | None = None
    categories: tuple[str, ...] | None = None
    default_operator: Operator = Operator()
    overrides: dict[str, Operator] = field(default_factory=dict)
    allow: tuple[str, ...] = ()  # values as they are
    allow_any_case: tuple[str, ...] = ()
    allow_patterns: tuple[str, ...] = ()
    custom: tuple[CustomRule, ...] = ()
    surfaces_off: tuple[str, ...] = ()
    salt: str = "salt"
    enabled: bool = True

    @property
    def floor(self) -> float:
        return PROFILES[ALIASES.get(self.profile, self.profile)][0] if self.threshold is None else self.threshold

    @property
    def on(self) -> tuple[str, ...]:
        return PROFILES[ALIASES.get(self.profile, self.profile)][1] if self.categories is None else self.categories

    def entities(self) -> tuple[str, ...]:
        """Labels that are masked: of an enabled category, or with an override of their own."""
        return tuple(sorted({e for c in self.on for e in CATEGORIES[c]} | set(self.overrides)))

    def operator_for(self, entity: str) -> Operator:
        """Override, then CVV is redacted and a card keeps four digits, then the default."""
        if entity in self.overrides:
            return self.overrides[entity]
        return {"CVV": Operator("redact"), "CREDIT_CARD": Operator("mask", "*", 4)}.get(entity, self.default_operator)

    def fingerprint(self, today: date | None = None) -> str:
        """A hash of what decides detections. What an override does is left out, that it is there isn't."""
        parts = [DETECTOR_VERSION, self.floor, sorted(self.on), sorted(self.overrides), sorted(self.allow), sorted(self.allow_any_case), sorted(self.allow_patterns), sorted(map(str, self.custom)), str(today)]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]


def merged(*layers: dict) -> dict:
    """Layers of settings, later ones over earlier: tables merge key by key, anything else replaces."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def problems(settings: dict, before: dict | None = None) -> list[str]:
    """What is wrong with settings. An unknown override that was already there before isn't reported again."""
    found = []
    known = {e for labels in CATEGORIES.values() for e in labels} | {"DATE_TIME"}
    threshold = settings.get("threshold")
    if threshold is not None and not 0 <= threshold <= 1:
        found.append("threshold must lie between 0 and 1")
    if (profile := settings.get("profile", "balanced")) not in PROFILES | ALIASES:
        found.append(f"unknown profile {profile}")
    old = set((before or {}).get("overrides", {}))
    found += [f"unknown entity {e}" for e in settings.get("overrides", {}) if e not in known and e not in old]
    found += [f"unknown operator {o.get('kind')}" for o in settings.get("overrides", {}).values() if o.get("kind") not in OPERATORS]
    found += [f"secret {s.get('name')} has its value inline" for s in settings.get("secrets", []) if "value" in s]
    return found


def from_settings(settings: dict) -> Policy:
    if wrong := problems(settings):
        raise ValueError("; ".join(wrong))
    fields = {k: settings[k] for k in ("profile", "threshold", "salt", "enabled") if k in settings}
    if "categories" in settings:
        fields["categories"] = tuple(settings["categories"])
    fields |= {k: tuple(settings[k]) for k in ("allow", "allow_any_case", "allow_patterns") if k in settings}
    if "overrides" in settings:
        fields["overrides"] = {e: Operator(**o) for e, o in settings["overrides"].items()}
    return Policy(**fields)


# Live edits: policy -> policy.
def with_custom(policy: Policy, rule: CustomRule) -> Policy:
    return replace(policy, custom=(*[r for r in policy.custom if r.pattern != rule.pattern], rule), allow=tuple(a for a in policy.allow if a != rule.pattern))


def revealed(policy: Policy, value: str) -> Policy:
    """The value is allowed from now on; a rule for it goes."""
    return replace(policy, allow=(*[a for a in policy.allow if a != value], value), custom=tuple(r for r in policy.custom if r.pattern != value))


def remasked(policy: Policy, value: str) -> Policy:
    return replace(policy, allow=tuple(a for a in policy.allow if a != value))
