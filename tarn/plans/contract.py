"""The contract of a product's behaviour: a JSON object and the rules that it must meet."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any

# States of a mode, and the values that a contract must name.
STATES = ("active", "planned", "deprecated")
REQUIRED = {
    "chunking_contract.strategy": "section_paragraph_list",
    "retrieval_contract.unit": "job",
    "retrieval_contract.deduplicate_by": "job_id",
    "answer_contract.citation.required": True,
    "delivery_workflow.phase_confirmation_required": True,
}


def at(contract: Any, path: str) -> Any:
    """The value at a dotted path, None if there is none."""
    for key in path.split("."):
        contract = contract.get(key) if isinstance(contract, dict) else None
    return contract


def _whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _name(x: Any) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _filled(x: Any) -> bool:
    return isinstance(x, list) and bool(x)


def _names(x: Any) -> bool:
    return _filled(x) and all(map(_name, x))


def _limits(x: Any) -> bool:
    found = [at(x, k) for k in ("minimum", "target", "maximum")]
    return all(map(_whole, found)) and 1 <= found[0] and found == sorted(found)


def _modes(x: Any) -> bool:
    return isinstance(x, dict) and all(isinstance(k, str) and at(m, "status") in STATES for k, m in x.items())


#: What must hold of the value at a path, and how it is said.
RULES: list[tuple[str, Callable[[Any], bool], str]] = [
    ("contract_version", _name, "must be a text"),
    ("modes", _modes, f"must map names to objects with a status of {', '.join(STATES)}"),
    *[(f"chunking_contract.{k}", _names, "must be a list of texts") for k in ("relevant_sections", "ignored_sections", "context_fields")],
    *[(f"chunking_contract.{k}", lambda x: _whole(x) and x >= 1, "must be a positive whole number") for k in ("max_chars", "overlap_chars")],
    *[(f"retrieval_contract.{k}", _limits, "must have 1 <= minimum <= target <= maximum") for k in ("candidate_jobs", "top_relevant_jobs")],
    ("answer_contract.required_sections", _names, "must be a list of texts"),
    ("answer_contract.refusal.triggers", _filled, "must not be empty"),
    *[(f"quality_contract.{k}", _filled, "must not be empty") for k in ("retrieval_metrics", "answer_metrics", "release_requirements")],
    ("delivery_workflow.sequence", _filled, "must not be empty"),
]


def faults(contract: Any) -> list[str]:
    """Every rule that the contract breaks; an empty list means that it is valid."""
    if not isinstance(contract, dict):
        return ["the contract must be an object"]
    out = [f"{path} {said}" for path, holds, said in RULES if not holds(at(contract, path))]
    out += [f"{path} must be {wanted!r}" for path, wanted in REQUIRED.items() if type(at(contract, path)) is not type(wanted) or at(contract, path) != wanted]
    mode, modes = at(contract, "default_mode"), at(contract, "modes")
    if not (isinstance(mode, str) and isinstance(modes, dict) and mode in modes):
        out.append("default_mode must be one of modes")
    size, overlap = (at(contract, f"chunking_contract.{k}") for k in ("max_chars", "overlap_chars"))
    if _whole(size) and _whole(overlap) and overlap >= size:
        out.append("chunking_contract.overlap_chars must be below max_chars")
    return out


def read(path: str) -> dict:
    """The contract in a file. Raises ValueError with all faults if it is missing, no JSON, or invalid."""
    if not os.path.exists(path):
        raise ValueError(f"no contract at {path}")
    with open(path, encoding="utf-8") as f:
        try:
            contract = json.load(f)
        except json.JSONDecodeError as e:
            raise ValueError(f"{path} is no JSON: {e}") from e
    if found := faults(contract):
        raise ValueError("; ".join(found))
    return contract
