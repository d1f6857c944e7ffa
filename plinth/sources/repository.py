"""A local copy of a repository, kept up to date with the ``git`` program on the driver."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass
from pathlib import Path


class RepositoryError(RuntimeError):
    pass


@dataclass(frozen=True)
class LocalRepository:
    owner: str
    name: str
    clone_url: str
    local_path: str
    default_branch: str
    commit: str


def _git(*args: str, cwd: str | None = None) -> str:
    done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True)
    if done.returncode:
        raise RepositoryError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout.strip()


def acquire(clone_url: str, owner: str, name: str, base: str) -> LocalRepository:
    """Clone if there is no copy, else fetch, and move forward only if the tracked commit differs."""
    path = Path(base) / f"{owner}_{name}"
    if not (path / ".git").exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        _git("clone", "--quiet", clone_url, str(path))
    else:
        _git("fetch", "--quiet", cwd=str(path))
        if _git("rev-parse", "HEAD", cwd=str(path)) != _git("rev-parse", "@{upstream}", cwd=str(path)):
            _git("merge", "--quiet", "--ff-only", "@{upstream}", cwd=str(path))
    branch = _git("rev-parse", "--abbrev-ref", "HEAD", cwd=str(path))
    return LocalRepository(owner, name, clone_url, str(path), branch, _git("rev-parse", "HEAD", cwd=str(path)))
