"""Scan of document folders, and the checks of paths."""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

from .readers import FORMATS

DEPTH = 10
_SENSITIVE = ("/etc", "/usr", "/sys", "/proc", "/var", "~/.ssh", "~/.gnupg")


@dataclass
class Coverage:
    """What a scan didn't look into."""

    unreadable: list[str] = field(default_factory=list)
    too_deep: list[str] = field(default_factory=list)
    symlinks: list[str] = field(default_factory=list)
    oversized: list[str] = field(default_factory=list)

    def unobserved(self) -> list[str]:
        return self.unreadable + self.too_deep + self.symlinks + self.oversized


def below(path: str, parent: str) -> bool:
    """The path itself or something inside it."""
    return path == parent or path.startswith(parent.rstrip("/") + "/")


def classify(entry: os.DirEntry, excluded: Iterable[str] = ()) -> str:
    return _kind(entry.path, entry.is_symlink(), entry.is_dir(follow_symlinks=False), entry.is_file(follow_symlinks=False), excluded)


def _kind(path: str, link: bool, folder: bool, regular: bool, excluded: Iterable[str]) -> str:
    if link:
        return "symlink"
    if any(below(path, x) for x in excluded):
        return "excluded"
    if folder:
        return "directory"
    if not regular:
        return "irregular"
    return "file" if os.path.splitext(path)[1].lower() in FORMATS else "unsupported"


def classify_path(path: str, excluded: Iterable[str] = ()) -> str:
    """As ``classify``, of a path that was asked for; one that can't be looked at is missing."""
    try:
        mode = os.lstat(path).st_mode
    except OSError:
        return "missing"
    return _kind(path, stat.S_ISLNK(mode), stat.S_ISDIR(mode), stat.S_ISREG(mode), excluded)


REFUSED = {
    "missing": "there is nothing at {}",
    "irregular": "{} is neither a file nor a folder",
    "symlink": "{} is a symbolic link; links aren't followed",
    "excluded": "{} belongs to the database",
    "unsupported": "{} isn't of a type that can be read",
}


def canonical(path: str) -> str | None:
    """The path with its folder's links resolved; None if the folder can't be."""
    try:
        return os.path.join(os.path.realpath(os.path.dirname(path), strict=True), os.path.basename(path))
    except OSError:
        return None


def requested(path: str, roots: Iterable[str], excluded: Iterable[str] = ()) -> str:
    """What is at a path that was asked for: file or directory; an error for anything else.

    Whatever isn't under a root, by its spelling and by where it really is, gets one and the same error.
    """
    roots = [os.path.normpath(r) for r in roots]
    path = os.path.normpath(path)
    real = path if path in roots else canonical(path)
    if not os.path.isabs(path) or not any(below(path, r) for r in roots) or real is None or not any(below(os.path.realpath(real) if path in roots else real, os.path.realpath(r)) for r in roots):
        raise ValueError(f"{path} is not under a document folder")
    kind = classify_path(path, excluded)
    if kind in REFUSED:
        raise ValueError(REFUSED[kind].format(path))
    return kind


def shown(path: str) -> str:
    """The path with the home folder as ~."""
    home = os.path.expanduser("~")
    return "~" + path[len(home) :] if home != "/" and below(path, home) else path


def collect(root: str, excluded: Iterable[str] = (), depth: int = DEPTH, scope: Iterable[str] = ()) -> tuple[list[str], Coverage]:
    """Supported files under ``root``, breadth first and sorted; folders outside ``scope`` aren't entered."""
    files, seen, scope = [], Coverage(), list(scope)
    queue = deque([(root, 0)])
    while queue:
        folder, level = queue.popleft()
        if level >= depth:
            seen.too_deep.append(folder)
            continue
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            seen.unreadable.append(folder)
            continue
        for e in entries:
            kind = classify(e, excluded)
            inside = not scope or any(below(e.path, s) for s in scope)
            if kind == "symlink":
                seen.symlinks.append(e.path)
            elif kind == "directory" and (inside or any(below(s, e.path) for s in scope)):
                queue.append((e.path, level + 1))
            elif kind == "file" and inside:
                files.append(e.path)
    return sorted(files), seen


def validate(path: str, roots: Iterable[str]) -> str:
    """The path if it is absolute and really lies under a root; one error for all that doesn't."""
    roots = [os.path.realpath(r) for r in roots]
    if not os.path.isabs(path) or os.path.islink(path) and not os.path.exists(path) or not any(below(os.path.realpath(path), r) for r in roots):
        raise ValueError(f"{path} is not an absolute path under a document folder")
    return path


def sensitive(path: str) -> bool:
    """Folders that are never taken for document folders."""
    return any(below(os.path.realpath(path), os.path.realpath(os.path.expanduser(s))) for s in _SENSITIVE)


def surviving_roots(roots: Iterable[str]) -> list[str]:
    """Roots without repetitions and without those inside another one."""
    return [r for r, ancestor in nested_roots(roots).items() if ancestor is None]


def nested_roots(roots: Iterable[str]) -> dict[str, str | None]:
    """Each root with the surviving root that it lies in, or None if it survives itself."""
    kept = list(dict.fromkeys(os.path.normpath(r) for r in roots))
    real = {r: os.path.realpath(r) for r in kept}
    inside = lambda r, o: real[o] != real[r] and below(real[r], real[o]) or real[o] == real[r] and kept.index(o) < kept.index(r)
    survive = [r for r in kept if not any(inside(r, o) for o in kept if o != r)]
    return {r: None if r in survive else max((o for o in survive if inside(r, o)), key=lambda o: len(real[o])) for r in kept}


def files_of(target: str, roots: Iterable[str], excluded: Iterable[str] = ()) -> list[str]:
    """The file, or the supported files of the folder, that a caller names for ingestion; sorted, each once."""
    if os.path.isdir(target) and not os.path.islink(target):
        requested(target, roots, excluded)
        return sorted(dict.fromkeys(collect(target, excluded)[0]))
    if os.path.splitext(target)[1].lower() not in FORMATS:
        raise ValueError(REFUSED["unsupported"].format(target))
    return [validate(target, roots)]
