"""Requests to models, made of versioned templates by column functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import prompt_hash


@dataclass(frozen=True)
class Part:
    """A piece of a template: text with ``{column}`` in places. ``given``: the piece is left out where this column is
    null or empty. A column that a piece names must be there; a null one is an error."""

    text: str
    given: str | None = None


#: (kind, version) -> (parts of the system's text, parts of the user's); a kind may have no system text.
TEMPLATES: dict[tuple[str, str], tuple[list[Part], list[Part]]] = {
    ("estimate", "v1"): ([Part("Estimate the work of a {project_type} project."), Part("Level of detail: {detail_level}."), Part("Form of the answer: {output_format}.")], [Part("{description}")]),
    ("session", "v2"): ([Part("Estimate the work of a {project_type} project, turn by turn."), Part("Level of detail: {detail_level}. Form of the answer: {output_format}."), Part("Known so far:\n{metadata}", "metadata")], [Part("{transcript}"), Part("Attachments:\n{attachments}", "attachments")]),
    ("session", "v3"): ([Part("Estimate the work of a {project_type} project, turn by turn."), Part("Level of detail: {detail_level}. Form of the answer: {output_format}."), Part("Readers: {tier}.", "tier"), Part("Known so far:\n{metadata}", "metadata")], [Part("{transcript}"), Part("Attachments:\n{attachments}", "attachments")]),
    ("facts", "v1"): ([], [Part("Which facts of the project does this turn tell? Answer with new ones only."), Part("Known: {metadata}", "metadata"), Part("User: {question}\nAssistant: {answer}")]),
    ("summary", "v1"): ([Part("Sum up what was said, in a few lines. Keep names, numbers and decisions.")], [Part("Summary so far:\n{summary}", "summary"), Part("Said since:\n{said}")]),
}


def rendered(parts: list[Part]) -> Column:
    """The pieces that are there, a line end between them; null if the template has none."""

    def piece(part: Part) -> Column:
        cells = []
        for k, bit in enumerate(re.split(r"\{(\w+)\}", part.text)):
            if k % 2 == 0:
                cells.append(F.lit(bit))
            else:
                cells.append(F.coalesce(F.col(bit).cast("string"), F.raise_error(F.lit(f"a template needs {bit}")).cast("string")))
        text = F.concat(*cells)
        return F.when(F.coalesce(F.col(part.given).cast("string"), F.lit("")) != "", text) if part.given else text

    return F.concat_ws("\n", *[piece(p) for p in parts]) if parts else F.lit(None).cast("string")


def render(rows: DataFrame, kind: str, version: str) -> DataFrame:
    """``rows`` with ``system``, ``user`` and their hashes, by which logs tell prompts without their text."""
    if (kind, version) not in TEMPLATES:
        raise KeyError(f"no template {kind} {version}; there are {sorted(TEMPLATES)}")
    system, user = TEMPLATES[kind, version]
    out = rows.withColumns({"system": rendered(system), "user": rendered(user), "prompt_version": F.lit(version)})
    return out.withColumns({"system_hash": prompt_hash(F.col("system")), "user_hash": prompt_hash(F.col("user"))})
