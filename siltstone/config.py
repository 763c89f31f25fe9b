"""Settings of a scan: which files of a tree are taken."""

from __future__ import annotations

from collections.abc import Iterable
from copy import copy
from dataclasses import dataclass

# Extension to language, default file patterns and directories.
# Only patterns that can hit a file of a known language are listed.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "javascript",
    ".tsx": "javascript",
    ".java": "java",
}
DEFAULT_PATTERNS = ("*.min.js", "*.bundle.js", "*.chunk.js", "*.vendor.js")
DEFAULT_DIRS = (
    "__pycache__",
    "node_modules",
    ".git",
    ".svn",
    ".hg",
    "build",
    "dist",
    "target",
    "out",
    "bin",
    "obj",
    "lib",
    ".vscode",
    ".idea",
    "venv",
    "env",
    ".env",
    "env.bak",
    "venv.bak",
    "analysis_output",
    "chroma_db",
    "*.egg-info",
    "*.dist-info",
)


@dataclass(frozen=True)
class ScanConfig:
    """Exclusions of a scan; every change gives a new config.

    ``dirs`` are compared with whole directory names, ``patterns`` are shell
    globs.  An empty or missing list means the defaults.
    """

    patterns: tuple[str, ...] = DEFAULT_PATTERNS
    dirs: tuple[str, ...] = DEFAULT_DIRS

    def __post_init__(self) -> None:
        object.__setattr__(self, "patterns", tuple(self.patterns or DEFAULT_PATTERNS))
        object.__setattr__(self, "dirs", tuple(self.dirs or DEFAULT_DIRS))

    def add_pattern(self, pattern: str) -> ScanConfig:
        return self._with("patterns", (*self.patterns, pattern))

    def remove_pattern(self, pattern: str) -> ScanConfig:
        return self._with("patterns", (p for p in self.patterns if p != pattern))

    def add_dir(self, name: str) -> ScanConfig:
        return self._with("dirs", (*self.dirs, name))

    def remove_dir(self, name: str) -> ScanConfig:
        return self._with("dirs", (d for d in self.dirs if d != name))

    def _with(self, field: str, values: Iterable[str]) -> ScanConfig:
        # A copy, not a new config: removing the last entry leaves nothing
        # excluded, it does not bring the defaults back.
        changed = copy(self)
        object.__setattr__(changed, field, tuple(dict.fromkeys(values)))
        return changed
