"""Settings from YAML, with defaults and checks."""

from __future__ import annotations

import logging
import logging.handlers
from pathlib import Path

DEFAULTS: dict = {
    "project": {"name": "corvane", "version": "0.1.0"},
    "paths": {"raw": "data/raw", "chunks": "data/chunks", "embeddings": "data/embeddings", "indexes": "data/indexes", "conversations": "data/conversations", "logs": "logs"},
    "ingestion": {"formats": ["txt", "pdf", "docx", "markdown"], "chunk_size": 512, "chunk_overlap": 50, "recursive": False},
    "embeddings": {"dimension": 64, "normalize": True},
    "index": {"metric": "cosine", "m": 16, "ef_construction": 200, "ef_search": 50},
    "query": {"top_k": 5, "min_score": 0.0, "max_context_length": 4000},
    "generation": {"enabled": False, "model": "mistral:7b", "base_url": "http://localhost:11434", "temperature": 0.7, "max_tokens": 512, "max_turns": 10, "max_history_tokens": 2000, "cache_size": 100, "cache_ttl_seconds": 3600},
    "logging": {"level": "INFO", "max_bytes": 10_000_000, "backups": 5},
}


def _merged(base: dict, over: dict) -> dict:
    return {k: _merged(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}


def load_config(path: str | Path | None = None) -> dict:
    """The defaults with the file's values over them, checked."""
    given = {}
    if path is not None:
        import yaml

        path = Path(path)
        if not path.is_file():
            raise FileNotFoundError(str(path))
        given = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        if not isinstance(given, dict):
            raise ValueError("settings must be a mapping")
    config = _merged(DEFAULTS, given)
    validate_config(config)
    return config


def validate_config(config: dict) -> None:
    from ..functions.vectors import check_metric
    from ..operators.chunking import check_chunking

    missing = [k for k in DEFAULTS if not isinstance(config.get(k), dict)]
    if missing:
        raise ValueError(f"missing sections: {missing}")
    check_chunking(config["ingestion"]["chunk_size"], config["ingestion"]["chunk_overlap"])
    check_metric(config["index"]["metric"])
    if config["embeddings"]["dimension"] <= 0 or config["query"]["top_k"] <= 0:
        raise ValueError("dimension and top_k must be positive")


def create_directories(config: dict, base: str | Path = ".") -> list[Path]:
    made = [Path(base) / p for p in config["paths"].values()]
    for p in made:
        p.mkdir(parents=True, exist_ok=True)
    return made


def project_info(config: dict) -> dict:
    return dict(config["project"])


def setup_logging(config: dict, base: str | Path = ".") -> logging.Logger:
    """A rotating file and the console, on the driver."""
    c, log = config["logging"], logging.getLogger("corvane")
    at = Path(base) / config["paths"]["logs"]
    at.mkdir(parents=True, exist_ok=True)
    log.handlers.clear()
    log.setLevel(c["level"])
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    for h in (logging.handlers.RotatingFileHandler(at / "corvane.log", maxBytes=c["max_bytes"], backupCount=c["backups"], encoding="utf-8"), logging.StreamHandler()):
        h.setFormatter(form)
        log.addHandler(h)
    return log


def log_config(config: dict, log: logging.Logger) -> None:
    for section, values in config.items():
        log.info("%s: %s", section, values)
