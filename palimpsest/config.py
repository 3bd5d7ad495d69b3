"""Stages, presets, levels and how a configuration is resolved (plain Python)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# The stages, which of them lose content, the presets and the cumulative ladder.
DEFAULT_STAGES = ("cmd-strip", "minify", "toon", "strip-lines", "whitespace", "llmlingua", "dedup", "diff", "read-diff", "prune")
EXTRA_STAGES = ("strip-comments", "textpress", "foundation-models", "graph", "br-cache", "disclosure", "bm25-trim")
ALL_STAGES = DEFAULT_STAGES + EXTRA_STAGES
LOSSY_STAGES = frozenset({"llmlingua", "foundation-models", "textpress", "strip-comments", "disclosure", "bm25-trim"})
_CONSERVATIVE = ("cmd-strip", "minify", "toon", "strip-lines", "whitespace", "dedup", "diff")
_AGGRESSIVE = (*DEFAULT_STAGES, "strip-comments", "textpress", "br-cache", "disclosure", "bm25-trim")
PRESETS = {
    "conservative": (_CONSERVATIVE, 4), "balanced": (DEFAULT_STAGES, 5), "aggressive": (_AGGRESSIVE, 8),
    "recommended": (tuple(s for s in _AGGRESSIVE if s != "llmlingua"), None),
}
_STEPS = (
    ("minify",), ("whitespace", "strip-lines"), ("cmd-strip",), ("toon", "dedup", "diff"), ("llmlingua", "read-diff", "prune"), ("strip-comments",),
    ("textpress", "br-cache"), ("disclosure", "bm25-trim"), ("graph", "foundation-models"),
)
LEVELS = {n: tuple(s for step in _STEPS[:n] for s in step) for n in range(1, 10)}
# The configurations of a sweep besides the presets, a baseline, stages left out of the
# aggressive preset one at a time, and a ladder of its own.
SWEEP_BASELINE = ("minify", "toon", "strip-lines", "whitespace", "llmlingua", "dedup", "diff", "prune")
SWEEP_LEFT_OUT = ("cmd-strip", "read-diff", "br-cache", "disclosure", "bm25-trim")
_RUNGS = (
    ("minify",), ("whitespace", "strip-lines"), ("cmd-strip",), ("dedup", "diff"), ("read-diff", "prune", "toon"), ("llmlingua",), ("graph", "br-cache"),
    ("strip-comments", "textpress"), ("foundation-models", "disclosure", "bm25-trim"),
)
SWEEP = (
    {f"preset:{name}": (None, stages) for name, (stages, level) in PRESETS.items() if level} | {"baseline": (None, SWEEP_BASELINE)}
    | {f"without:{drop}": (None, tuple(s for s in _AGGRESSIVE if s != drop)) for drop in SWEEP_LEFT_OUT}
    | {f"L{n}": (n, tuple(s for rung in _RUNGS[:n] for s in rung)) for n in range(1, 10)}
)
ALIASES = {"conservative": 4, "balanced": 5, "aggressive": 8, "max": 9}
DEFAULT_LEVEL = 5
OUTPUT_MODES = ("conservative", "balanced", "aggressive")


@dataclass(frozen=True)
class Config:
    stages: tuple[str, ...] = DEFAULT_STAGES
    level: int | None = DEFAULT_LEVEL
    level_source: str = "default"
    preset: str = "balanced"
    min_size: int = 200
    max_body: int = 10_485_760
    cache_safe: bool = True
    redact: bool = True
    redact_mode: str = "mask"
    output_mode: str = "off"
    agent: str | None = None
    token_cost: float = 3.0
    disclosure_bytes: int = 32768
    trim_bytes: int = 65536
    trim_tokens: int = 4096
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def has(self, stage: str) -> bool:
        return stage in self.stages


def level_of(raw: object) -> int | None:
    """1 to 9 from a number, its digits or an alias; null for anything else."""
    if isinstance(raw, bool) or raw is None:
        return None
    text = str(raw).strip()
    if text.lstrip("-").isdigit():
        return int(text) if int(text) in LEVELS else None
    return ALIASES.get(text)


def stages_of(level: int) -> tuple[str, ...]:
    """A level's stages; at 4, 5 and 8 in the order of the preset of that level."""
    return next((stages for stages, n in PRESETS.values() if n == level), LEVELS[level])


def _number(raw: object, default: int) -> int:
    """Leading digits of raw; none of them, or zero, mean the default."""
    text = str(raw or "").strip()
    sign, text = (-1, text[1:]) if text[:1] == "-" else (1, text)
    digits = text[: len(text) - len(text.lstrip("0123456789"))]
    return sign * int(digits or 0) or default


def _flag(raw: object, default: bool) -> bool:
    return default if raw in (None, "") else str(raw).strip().lower() not in ("false", "0", "no", "off")


def resolve(env: Mapping[str, str] | None = None, file: Mapping[str, str] | None = None, level: object = None) -> Config:
    """Configuration by precedence: listed stages, the level argument, the environment's level, its
    preset, the file's level, the default. What is not valid is warned of and passed over.

    Keys are STAGES, LEVEL, COMPRESSION_PRESET, MIN_SIZE, MAX_BODY, CACHE_SAFE, REDACT, REDACT_MODE,
    OUTPUT_MODE, OUTPUT_DEFAULT, AGENT and TOKEN_COST; a file has `level` besides.
    """
    env, file, warnings = env or {}, file or {}, []
    get = lambda key: env[key] if key in env else file.get(key)
    listed = [s.strip() for s in (get("STAGES") or "").split(",") if s.strip()]
    warnings += [f"unknown stage: {s}" for s in listed if s not in ALL_STAGES]
    listed = [s for s in listed if s in ALL_STAGES]
    preset = get("COMPRESSION_PRESET") or None
    chosen: tuple[tuple[str, ...], int | None, str] | None = (tuple(listed), None, "stages") if listed else None
    for raw, source in ((level, "level-argument"), (get("LEVEL"), "level-env")):
        if chosen is None and raw not in (None, ""):
            if (n := level_of(raw)) is not None:
                chosen = stages_of(n), n, source
            else:
                warnings.append(f"invalid level: {raw!r}")
    if chosen is None and preset is not None:
        if preset in PRESETS:
            chosen = (*PRESETS[preset], "preset")
        else:
            warnings.append(f"unknown preset: {preset!r}")
            chosen, preset = (*PRESETS["balanced"], "default"), "balanced"
    if chosen is None and file.get("level") not in (None, ""):
        if (n := level_of(file["level"])) is not None:
            chosen = stages_of(n), n, "file"
        else:
            warnings.append(f"invalid level in file: {file['level']!r}")
    stages, n, source = chosen or (stages_of(DEFAULT_LEVEL), DEFAULT_LEVEL, "default")
    mode = get("OUTPUT_MODE") or get("OUTPUT_DEFAULT") or "off"
    try:
        cost = float(get("TOKEN_COST") or 0) or 3.0
    except ValueError:
        cost = 3.0
    return Config(
        stages, n, source, preset or "balanced", _number(get("MIN_SIZE"), 200), _number(get("MAX_BODY"), 10_485_760), _flag(get("CACHE_SAFE"), True),
        _flag(get("REDACT"), True), "remove" if get("REDACT_MODE") == "remove" else "mask", mode if mode in OUTPUT_MODES else "off",
        (get("AGENT") or "").lower() or None, cost, warnings=tuple(warnings),
    )


def read_settings(text: str) -> dict[str, str]:
    """key=value lines; # begins a comment line, and a pair of quotes round a value goes."""
    out = {}
    for line in text.splitlines():
        key, eq, value = line.partition("=")
        if eq and key.strip() and not line.lstrip().startswith("#"):
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out
