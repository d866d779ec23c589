"""Prompt texts. The placeholders are filled once, by concatenation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM_PROMPT = """A search over regulations has produced the numbered passages below. Work as a careful reader of them.

Whatever you assert must be traceable: put the passage number next to it in square brackets. Names of provisions and
figures are to be taken over as printed there. Where the passages are silent or contradict each other, write that down
instead of filling the gap, and point the reader to the body in charge. Mention for which area a provision was made.
The reader is not your client.

Output format: a single JSON object, opening with {{ and closing with }}, without anything around it.
"""

_HEAD = ("CONTEXT:\n", "\n\nQUESTION:\n", "\n\nCOUNCIL: ")

# The JSON keys of each task. The instructions are this engine's own.
_TASKS = {
    "ELIGIBILITY": """

Decide from the passages whether the project needs consent.
Fill this object:
  "answer_summary": one plain sentence
  "permission_required": true, false or "uncertain"
  "reasoning": list of {"point", "citation"}
  "conditions": list of conditions and exceptions
  "what_to_do_next": a practical step
  "confidence": "high", "medium" or "low"
  "chunks_used": list of chunk numbers
""",
    "EXEMPTION": """

Decide from the passages whether the project falls under an exemption.
Fill this object:
  "answer_summary": one plain sentence
  "is_exempt": true, false or "uncertain"
  "exemption_class": the class, or null
  "conditions": list of {"condition", "citation"}
  "thresholds": list of {"threshold", "citation"}; leave none out
  "disqualifiers": whatever would remove the exemption
  "section_5_recommended": true when anything is uncertain
  "what_to_do_next": a practical step
  "confidence": "high", "medium" or "low"
  "chunks_used": list of chunk numbers
""",
    "PROCESS": """

Lay out the procedure that the passages describe, with its time limits.
Fill this object:
  "answer_summary": one plain sentence
  "process_steps": list of {"step", "action", "timeline", "citation"}
  "key_deadlines": list of {"deadline", "timeframe", "consequence"}
  "fees": what the context says about fees, or null
  "what_to_do_next": a practical step
  "confidence": "high", "medium" or "low"
  "chunks_used": list of chunk numbers
""",
}

RESPONSE_DISCLAIMER = (
    "Generated from indexed passages by software. It binds nobody, may be out of date, and does not replace the "
    "decision of the body in charge."
)


def build_prompt(query_type: Column, context: Column, query: Column, jurisdiction: Column) -> Column:
    """The prompt of the query's type; other types use the eligibility task."""
    task = (
        F.when(query_type == "EXEMPTION", _TASKS["EXEMPTION"])
        .when(query_type == "PROCESS", _TASKS["PROCESS"])
        .otherwise(_TASKS["ELIGIBILITY"])
    )
    return F.concat(F.lit(_HEAD[0]), context, F.lit(_HEAD[1]), query, F.lit(_HEAD[2]), jurisdiction, task)
