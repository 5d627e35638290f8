"""Versioned prompts: files with a head, a [system] and a [user] section. A prompt's id and hash go into the run log."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FOLDER = Path(__file__).resolve().parent.parent / "prompts"


@dataclass(frozen=True)
class Prompt:
    id: str
    system: str
    user: str
    hash: str


def names(folder: Path = FOLDER) -> list[str]:
    return sorted(p.stem for p in folder.glob("*.md"))


def parse(name: str, raw: str) -> Prompt:
    """A prompt from its file's text; the hash is of all of it, so any edit is another prompt."""
    body = re.sub(r"\A---\n.*?\n---\n", "", raw, flags=re.S)
    sections = dict(zip(*[iter(re.split(r"(?m)^\[(system|user)\]\n", body)[1:])] * 2, strict=True))
    if set(sections) != {"system", "user"}:
        raise ValueError(f"prompt {name!r} needs one [system] and one [user] section")
    return Prompt(name, sections["system"].strip(), sections["user"].strip(), hashlib.sha1(raw.encode()).hexdigest()[:10])


def load(name: str, folder: Path = FOLDER) -> Prompt:
    if name not in names(folder):
        raise KeyError(f"no prompt {name!r}; there are {', '.join(names(folder))}")
    return parse(name, (folder / f"{name}.md").read_text(encoding="utf-8"))


def requests(rows: DataFrame, name: str, **values: Column) -> DataFrame:
    """(qid, system, user, prompt_id, prompt_hash) for each row."""
    p = load(name)
    return rows.select("qid", T.render(p.system, **values).alias("system"), T.render(p.user, **values).alias("user"), F.lit(p.id).alias("prompt_id"), F.lit(p.hash).alias("prompt_hash"))
