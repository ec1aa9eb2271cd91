"""Settings that define results. Every operator takes them as parameters; these are the defaults."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass

# Fixed values of the data format and of the retrieval semantics.
CACHE_MAGIC = b"RAGC"
CACHE_VERSION = 4
QUERY_PREFIX = "为这个句子生成表示以用来检索相关文章："
CONTEXT_HEADER = "【参考资料】\n"
SESSION_SEPARATOR = "\u001f"

#: The first turn of a grounded chat, where the caller gives none.
SYSTEM_PROMPT = "You answer questions about a product from its manuals. Use only the passages that come with a question, name the file of each passage you rely on, and say so when they do not hold the answer."


@dataclass(frozen=True)
class RetrievalConfig:
    chunk_size: int = 240
    chunk_overlap: int = 40
    k1: float = 1.5
    b: float = 0.75
    top_k: int = 3
    threshold: float = 0.22
    alpha: float = 0.6
    pool_factor: int = 4
    pool_least: int = 20
    batch_items: int = 8
    batch_tokens: int = 2048
    batch_context: int = 4096
    n_ctx: int = 4096
    max_tokens: int = 512
    debounce_ms: int = 800
    min_recall: float = 0.5
    agreement: float = 0.95

    @property
    def pool(self) -> int:
        """Candidates per query that are scored again; a smaller corpus gives all it has."""
        return max(self.pool_factor * self.top_k, self.pool_least)


DEFAULT = RetrievalConfig()


#: Settings that a file may hold, by section and name, with their values where it does not.
FILE_DEFAULTS = {
    "embedding.backend": "hashing", "embedding.dimension": "512", "embedding.model_path": "", "embedding.vocabulary_path": "",
    "embedding.threads": "1", "knowledge_base.directory": "",
}


def setting(spark, key: str, default: str) -> str:
    """A session setting under sedgewren.*, or the default where it is missing or blank."""
    value = spark.conf.get(f"sedgewren.{key}", default)
    return value if value and value.strip() else default


def read_settings(path: str) -> dict[str, str]:
    """Settings of an ini file of the driver; missing and blank ones have their defaults. Without a file the defaults
    are written to it first."""
    if not os.path.exists(path):
        write_settings(path, {})
    parser = configparser.ConfigParser(interpolation=None)
    parser.read(path, encoding="utf-8")
    found = {f"{section}.{name}": value.strip() for section in parser.sections() for name, value in parser.items(section)}
    return FILE_DEFAULTS | {k: v for k, v in found.items() if v}


def write_settings(path: str, settings: dict[str, str]) -> None:
    """Write settings over the defaults, in one step, so that the next run finds them (the directory, for one)."""
    parser = configparser.ConfigParser(interpolation=None)
    for key, value in (FILE_DEFAULTS | settings).items():
        section, _, name = key.partition(".")
        if not parser.has_section(section):
            parser.add_section(section)
        parser.set(section, name, value)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        parser.write(f)
    os.replace(f"{path}.new", path)
