"""Project configuration: strict YAML."""

from __future__ import annotations

from pathlib import Path

import yaml
from pydantic import BaseModel, ConfigDict

from trailmark.operators.specs import Spec


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Dataset(Strict):
    name: str
    adapter: str = "messages"
    paths: list[str]
    exclude: list[str] = []
    options: dict = {}


class Alerts(Strict):
    min_batch: int = 30
    tail_precision: float = 0.6
    lift: float = 1.5


class Project(Strict):
    datasets: list[Dataset] = []
    features: list[Spec] = []
    hidden_metadata: list[str] = []
    batch: list[str] = []
    stratum: list[str] = []
    baseline: str = "all"
    alerts: Alerts = Alerts()
    window_steps: int = 40
    window_stride: int = 20


def load(path: str) -> Project:
    return Project.model_validate(yaml.safe_load(Path(path).read_text()) or {})


TEMPLATE = """\
datasets:
  - {name: example, adapter: messages, paths: ["data/*.jsonl"]}
features: []
batch: []
stratum: []
"""
