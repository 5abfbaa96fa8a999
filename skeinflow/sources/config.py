"""What stays on the driver: scan targets, policies with their defaults and limits, ensembles of models, and the workspace."""

from __future__ import annotations

import logging
import shutil
from dataclasses import dataclass, field
from pathlib import Path

from . import block_yaml

log = logging.getLogger(__name__)


class ConfigError(ValueError):
    """A policy that says something it may not."""


# Kinds of targets, and what settings may be.
TARGET_KINDS = ("folder", "repo", "mount", "image")
MODES = {"llm_classifier": ("off", "auto", "required"), "llm_fallback": ("off", "auto", "required"), "runtime": ("off", "python")}
ACTIONS = ("ask", "skip", "llm", "error")
ENSEMBLE_MODES = ("fast", "solo", "full", "custom")
ROLES = ("fast", "solo", "voter", "judge")


@dataclass(frozen=True)
class Target:
    root: str
    kind: str = "folder"


def target(root: str, kind: str = "folder") -> Target:
    """A target with its root made absolute; an unknown kind raises ConfigError, a missing root (but of an image) FileNotFoundError."""
    if kind not in TARGET_KINDS:
        raise ConfigError(f"kind must be one of {TARGET_KINDS}, not {kind!r}")
    if kind == "image" or "://" in root:
        return Target(root, kind)
    path = Path(root).expanduser().resolve()
    if not path.exists():
        raise FileNotFoundError(path)
    return Target(str(path), kind)


@dataclass
class Policy:
    enabled: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    llm_classifier: str = "off"
    llm_fallback: str = "off"
    runtime: str = "off"
    test_command: str | None = None
    unclassified: str = "ask"
    keep_archives: int = 5
    confidence_threshold: float = 0.7

    def detectors(self, known: list[str]) -> list[str]:
        """The known detectors that are on: the enabled ones (none named: all) without the disabled."""
        for name in sorted({*self.enabled, *self.disabled} - set(known)):
            log.warning("unknown detector %r", name)
        return [n for n in self.enabled or known if n in known and n not in self.disabled]


class _Section:
    """One section of a policy; every read checks what it gets."""

    def __init__(self, data: dict, name: str) -> None:
        own = data.get(name)
        if own is not None and not isinstance(own, dict):
            raise ConfigError(f"{name} must be a mapping")
        self.name, self.own = name, own or {}

    def _get(self, key: str, default, ok, what: str):
        value = self.own.get(key, default)
        if not ok(value):
            raise ConfigError(f"{self.name}.{key} must be {what}, not {value!r}")
        return value

    def names(self, key: str) -> list[str]:
        return [n.strip() for n in self._get(key, None, lambda v: v is None or isinstance(v, list) and all(isinstance(n, str) and n.strip() for n in v), "a list of names") or []]

    def one_of(self, key: str, allowed: tuple[str, ...], default: str) -> str:
        value = self.own.get(key, default)
        return self._one(key, "off" if value is False and "off" in allowed else value, allowed)

    def _one(self, key: str, value, allowed: tuple[str, ...]) -> str:
        if value not in allowed:
            raise ConfigError(f"{self.name}.{key} must be one of {allowed}, not {value!r}")
        return value

    def text(self, key: str) -> str | None:
        value = self._get(key, None, lambda v: v is None or isinstance(v, str), "text or null")
        return value.strip() or None if value else None

    def count(self, key: str, default: int) -> int:
        return self._get(key, default, lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0, "a count")

    def ratio(self, key: str, default: float) -> float:
        return float(self._get(key, default, lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1, "between 0 and 1"))


def _document(text: str) -> dict:
    try:
        data = block_yaml.load(text)
    except ValueError as e:
        raise ConfigError(f"not readable: {e}") from None
    if data is not None and not isinstance(data, dict):
        raise ConfigError("a policy is a mapping")
    return data or {}


def policy(text: str) -> Policy:
    """A policy from its text; what it does not say has its default."""
    data = _document(text)
    detectors, classifier, fallback, runtime = (_Section(data, n) for n in ("detectors", "llm_classifier", "llm_fallback", "runtime"))
    return Policy(
        detectors.names("enabled"),
        detectors.names("disabled"),
        classifier.one_of("mode", MODES["llm_classifier"], "off"),
        fallback.one_of("mode", MODES["llm_fallback"], "off"),
        runtime.one_of("mode", MODES["runtime"], "off"),
        runtime.text("test_command"),
        _Section(data, "unclassified").one_of("action", ACTIONS, "ask"),
        _Section(data, "logs").count("keep_archives", 5),
        _Section(data, "store").ratio("confidence_threshold", 0.7),
    )


@dataclass
class Model:
    name: str
    role: str
    weight: float = 1.0
    timeout: int = 600
    max_tokens: int = 2000
    temperature: float = 0.0
    base_url: str = "http://localhost:1234/v1"


@dataclass
class Ensemble:
    mode: str
    voters: list[Model]
    judge: Model | None = None

    @property
    def parallel(self) -> bool:
        """Whether items may be asked about at once: with one voter and no judge only."""
        return len(self.voters) == 1 and self.judge is None


def ensemble(text: str, mode: str | None = None) -> Ensemble:
    """The models that a mode asks: fast and solo those of that role, full and custom the voters with at most one judge."""
    section = _Section(_document(text), "evaluation")
    defaults, models = section.own.get("defaults") or {}, section.own.get("models")
    if not isinstance(defaults, dict) or not isinstance(models, list) or not models:
        raise ConfigError("evaluation needs a list of models")
    known = []
    for entry in models:
        if not isinstance(entry, dict) or not entry.get("name") or entry.get("role") not in ROLES:
            raise ConfigError(f"a model needs a name and a role of {ROLES}: {entry!r}")
        fields = {k: v for k, v in {**defaults, **entry}.items() if k in Model.__dataclass_fields__}
        known.append(Model(**fields))
    mode = section._one("mode", mode or section.own.get("mode", "fast"), ENSEMBLE_MODES)
    role = mode if mode in ("fast", "solo") else "voter"
    voters = [m for m in known if m.role == role]
    judges = [m for m in known if m.role == "judge"] if role == "voter" else []
    if not voters or len(judges) > 1:
        raise ConfigError(f"mode {mode} needs a model of role {role} and at most one judge")
    return Ensemble(mode, voters, judges[0] if judges else None)


DEFAULT_POLICY = "detectors:\n  enabled: []\n  disabled: []\nllm_classifier:\n  mode: off\nstore:\n  confidence_threshold: 0.7\nlogs:\n  keep_archives: 5\n"


@dataclass(frozen=True)
class Workspace:
    """The folders of one project's results; its policy is the user's and survives ``clean``."""

    root: Path

    @property
    def graph(self) -> Path:
        return self.root / "graph"

    @property
    def reports(self) -> Path:
        return self.root / "reports"

    @property
    def cache(self) -> Path:
        return self.root / "cache"

    @property
    def policy_file(self) -> Path:
        return self.root / "config" / "config.yaml"

    def prepare(self) -> Workspace:
        for folder in (self.graph, self.reports, self.cache, self.policy_file.parent):
            folder.mkdir(parents=True, exist_ok=True)
        if not self.policy_file.exists():
            self.policy_file.write_text(DEFAULT_POLICY, encoding="utf-8")
        return self

    def policy(self) -> Policy:
        return policy(self.policy_file.read_text(encoding="utf-8"))

    def clean(self) -> None:
        for folder in (self.graph, self.reports, self.cache):
            shutil.rmtree(folder, ignore_errors=True)
        self.prepare()
