"""Checking SQL of merged claims: the steps of a claim over the claims that lead a merge."""

from __future__ import annotations

import re

from oracle import claim_changes, claim_header, claim_items

STEPS: dict[str, str] = {}
QUERIES: dict[str, str] = {}

_ALL = claim_header.STEPS | claim_items.STEPS | claim_changes.STEPS
_CLAIMS = "insurance_claim"


def _words(text: str) -> set[str]:
    return set(re.findall(r"[a-z_][a-z0-9_]*", text))


def _resting_on_claims() -> set[str]:
    """The steps that read the claims, directly or not."""
    found = {_CLAIMS}
    while more := {n for n, text in _ALL.items() if n not in found and _words(text) & found}:
        found |= more
    return found


_OVER_LEADS = _resting_on_claims()


def _over_leads(text: str) -> str:
    """The same SQL over the leading claims."""
    return re.sub(r"\b(FROM|JOIN)(\s+)(\w+)", lambda m: f"{m[1]}{m[2]}{'lead_' if m[3] in _OVER_LEADS else ''}{m[3]}", text)


STEPS.update({f"lead_{n}": _over_leads(_ALL[n]) for n in _OVER_LEADS if n in _ALL})
STEPS["lead_insurance_claim"] = """
SELECT c.* REPLACE (m.claim_appointment_list AS claim_appointment_list) FROM insurance_claim c
JOIN merge_group m ON m.claim = c.name AND m.claims > 1"""
QUERIES["m2_rebuilt_claims"] = _over_leads(claim_changes.QUERIES["c10_saved_headers"])
QUERIES["m2_rebuilt_lines"] = _over_leads(claim_items.QUERIES["c9_claim_lines"])
QUERIES["m2_relinked_appointments"] = _over_leads(claim_header.QUERIES["h11_link_appointments"])
