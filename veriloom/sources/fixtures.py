"""An example corpus whose every outcome is known by construction: six documents, eight line items each.

What happens to each field is written down, and the page text is made so that the keyword baseline does just that: a line with
the value, a line with another one, no line, a line for what the label says is not stated, or a figure whose printed scale the
verifier reads otherwise (`3 tn`).
"""

from __future__ import annotations

import json

from veriloom.functions.kernels import LABELS
from veriloom.schemas import ITEMS
from veriloom.sources import writers

#: A letter a field, in the order of the line items: Correct, Mismatch, Omission, Hallucination, Abstention that is right, Ungrounded.
OUTCOMES = {
    "example-1": "CCACCCAC", "example-2": "CMACCAAM", "example-3": "CCMAOUCA", "example-4": "MCACCOAA", "example-5": "CMAMCAUO", "example-6": "MCHACMAA",
}
#: Fields that took a judgement to label.
AMBIGUOUS = {("example-1", "ebitda_addbacks"), ("example-2", "cfads"), ("example-3", "cash"), ("example-4", "revenue_ltm"), ("example-5", "cfads"), ("example-6", "ebitda_addbacks")}


def value_of(document: int, item: int) -> float:
    return float(1000 * (document + 2) + 37 * (item + 1))


def example(name: str, kinds: str) -> tuple[dict, list[str]]:
    """A golden record and its two pages."""
    document = sorted(OUTCOMES).index(name)
    fields, lines = [], []
    for at, (item, kind) in enumerate(zip(ITEMS, kinds)):
        value, phrase = value_of(document, at), LABELS[item][0][0]
        fields.append({"name": item, "value": None if kind in "AH" else value, "page": None if kind in "AH" else 1 + at // 4, "ambiguous": (name, item) in AMBIGUOUS, "note": f"made as {kind}"})
        printed = {"C": f"{value:,.0f}", "M": f"{3 * value:,.0f}", "H": f"{value:,.0f}", "U": f"{value:,.0f} tn"}.get(kind)
        lines.append(f"{phrase.capitalize()}  {printed}" if printed else "This line says nothing of it")
    pages = ["\n".join(["Annual statements", *lines[:4]]), "\n".join(["Notes to them", *lines[4:]])]
    return {"doc_id": name, "source": "made by fixtures", "pages": 2, "scanned": False, "fields": fields}, pages


def write_example(root: str) -> None:
    """Labels, texts and thresholds of the example corpus."""
    for name, kinds in OUTCOMES.items():
        golden, pages = example(name, kinds)
        writers.save_golden(root, golden)
        writers.save_page_text(root, name, pages)
    floors = {"accuracy": 0.59, "coverage": 0.9, "grounding_rate": 0.93, "hallucination_rate": {"max": 0.0626, "note": "one field"}, "ratio.safety": {"min": 0.0}, "field.cash.accuracy": 0.5}
    writers.save_text(root, "thresholds.json", json.dumps({"corpus": root, "extractor": "heuristic", "metrics": floors}, indent=2))
