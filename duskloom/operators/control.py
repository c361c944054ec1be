"""Control-plane scalars: names, keys, gates and small persisted selections. Driver-side, but for the Column functions."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.policy import CustomRule, Policy
from ..sources.files import read_state, write_state

LONGEST_NAME, MOST_SELECTIONS = 200, 1000

#: How a target's trust is stated, the strongest first; 'attested' isn't graded.
TRUST = ("user_verified", "contract", "documented", "attested")


def file_component(name: str) -> str:
    """A name that is safe as one part of a path: other characters become '_', 200 bytes at most with a hash at the end when cut."""
    safe = re.sub(r"[^0-9A-Za-z._-]", "_", name).lstrip(".") or "_"
    if len(safe.encode()) <= LONGEST_NAME:
        return safe
    return f"{safe[: LONGEST_NAME - 17]}-{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def project_key(root: str) -> str:
    return hashlib.sha256(root.encode()).hexdigest()[:16]


def control_token(key: str) -> str:
    """A token for the control plane that can't be any other hash of the key."""
    return hashlib.sha256(b"control:" + key.encode()).hexdigest()


def base_url(url: str) -> str:
    """The URL without a last slash; an error unless it is http(s) with a host, without user, query and fragment."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.password or parts.query or parts.fragment:
        raise ValueError("a base URL needs http or https and a host, and no user, query or fragment")
    return url.rstrip("/")


def trust_grade(basis: Column) -> Column:
    """Rank of a stated basis of trust; null for one that isn't graded or known."""
    return F.coalesce(*[F.when(basis == name, rank) for rank, name in enumerate(TRUST) if name != "attested"])


def authorised(model: Column, models: tuple[str, ...]) -> Column:
    """Exact membership; an empty list authorises none."""
    return model.isin(*models) if models else F.lit(False)


def intake_open(required: Column, resolved: Column) -> Column:
    """Whether all required secrets are resolved; until then requests are refused."""
    return F.size(F.array_except(required, resolved)) == 0


def cache_key(text: Column, surface: Column, policy: Policy, day: str) -> Column:
    """The key under which a text's detections may be kept: text, surface, what the policy decides, and the day for dates about now."""
    return F.sha2(F.concat_ws("|", T.short_hash("leaf:", text, digits=64), surface, F.lit(policy.fingerprint()), F.lit(day)), 256)


def select(selections: dict[str, str], conversation: str, target: str | None) -> dict[str, str]:
    """Selections with one engaged, or cleared by None; an error beyond MOST_SELECTIONS."""
    kept = {k: v for k, v in selections.items() if k != conversation}
    if target is None:
        return kept
    if len(kept) >= MOST_SELECTIONS:
        raise ValueError(f"no more than {MOST_SELECTIONS} selections")
    return kept | {conversation: target}


def save_policy_edits(path: str, policy: Policy) -> None:
    """The live edits of a policy: custom rules and the allow list."""
    write_state(path, {"allow": list(policy.allow), "custom": [r.__dict__ | {"surfaces": list(r.surfaces)} for r in policy.custom]})


def load_policy_edits(path: str, policy: Policy) -> Policy:
    """The policy with persisted edits; an absent file has none, a corrupt one is an error."""
    outcome, state = read_state(path)
    if outcome == "corrupt":
        raise ValueError(f"{path} can't be read")
    rules = tuple(CustomRule(**r | {"surfaces": tuple(r["surfaces"])}) for r in state.get("custom", []))
    return Policy(**policy.__dict__ | {"allow": (*policy.allow, *state.get("allow", [])), "custom": (*policy.custom, *rules)})
