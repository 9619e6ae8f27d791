"""The configuration file, and what the working tree's version control says."""

from __future__ import annotations

import json
import re
import subprocess
from dataclasses import asdict, dataclass, field
from pathlib import Path

from arcwright.functions.text import same_commit
from arcwright.model import GraphError, camel

#: Folders of builds, packages and editors.
SKIPPED = frozenset("artifacts packages node_modules bin obj .git .idea .vs".split())
FILE = "arcwright.json"


@dataclass
class ProjectFilter:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


@dataclass
class Config:
    solution: str | None = None
    solutions: list[str] = field(default_factory=list)
    output: str = ".arcwright"
    split_by: str = "assembly"
    projects: ProjectFilter = field(default_factory=ProjectFilter)

    def effective_solutions(self) -> list[str]:
        """The list if there is one, else the single solution, else none."""
        return list(self.solutions) or ([self.solution] if self.solution else [])


def validate(config: Config) -> Config:
    """Either one solution or a list of such whose names differ."""
    if config.solution and config.solutions:
        raise GraphError("Give either solution or solutions, not both")
    stems = [Path(s.replace("\\", "/")).stem.lower() for s in config.solutions]
    if twice := sorted({s for s in stems if stems.count(s) > 1}):
        raise GraphError(f"Solutions of the same name: {', '.join(twice)}")
    return config


def load_config(path: str | Path | None = None, start: str | Path = ".") -> Config:
    """The configuration at a path, or in the nearest folder from start up that has one, or the defaults."""
    if path is None:
        here = Path(start).absolute()
        path = next((p / FILE for p in (here, *here.parents) if (p / FILE).is_file()), None)
        if path is None:
            return Config()
    if not Path(path).is_file():
        raise FileNotFoundError(f"No configuration at {path}")
    try:
        raw = json.loads(Path(path).read_text("utf-8-sig"))
    except ValueError as e:
        raise GraphError(f"{path} is no JSON: {e}") from e
    named = {f: raw[camel(f)] for f in Config.__dataclass_fields__ if raw.get(camel(f)) is not None}
    if "projects" in named:
        named["projects"] = ProjectFilter(named["projects"].get("include") or [], named["projects"].get("exclude") or [])
    return validate(Config(**named))


def save_config(config: Config, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({camel(k): v for k, v in asdict(config).items() if v is not None}, indent=2), "utf-8")


def git(*arguments: str, folder: str | Path = ".") -> str:
    """Output of git, '' if anything goes wrong."""
    try:
        done = subprocess.run(["git", *arguments], cwd=folder, capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return ""
    return done.stdout.strip() if done.returncode == 0 else ""


def stale(folder: str | Path, root: str | Path = ".") -> str | None:
    """A warning if the graph was made from another commit than the tree's; None if not, or if that can't be told."""
    try:
        found = re.search(r'"commitHash"\s*:\s*"([^"]+)"', (Path(folder) / "meta.json").read_text("utf-8-sig"))
    except OSError:
        return None
    head = git("rev-parse", "HEAD", folder=root)
    if not found or not head or same_commit(found[1], head):
        return None
    return f"The graph is of commit {found[1][:7]}, the tree at {head[:7]}: index it again."


def changed_files(since: str, root: str | Path = ".") -> list[str]:
    """Sources and project files that differ between a commit and the last one, below the repository's top."""
    return [f for f in git("diff", "--name-only", since, "HEAD", "--", "*.cs", "*.csproj", folder=root).splitlines() if f.strip()]


def find_solutions(root: str | Path, skip: frozenset[str] = SKIPPED) -> list[str]:
    """Solution files below a folder, but for some folders' names."""
    root = Path(root)
    found = [p.relative_to(root) for e in ("*.sln", "*.slnx") for p in root.rglob(e)]
    return sorted(p.as_posix() for p in found if not skip & {x.lower() for x in p.parts[:-1]})
