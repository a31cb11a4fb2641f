"""Fetching an advisory snapshot to a local file: download with resume, or a sparse clone packed as an archive.

This moves one file to the machine it runs on, before Spark has anything to read.
A file takes its final name only once it has been read to its end.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
import tarfile
import tempfile
import time
import urllib.error
import urllib.request
import zlib
from collections import deque
from pathlib import Path

from fieldweave import constants as K

#: Where the public advisory database lies, and the part of it that is read.
ARCHIVE_URL = "https://codeload.github.com/github/advisory-database/tar.gz/refs/heads/main"
CLONE_URL, CLONE_REF = "https://github.com/github/advisory-database.git", "main"
PROXIES = ("http_proxy", "https_proxy", "all_proxy")
CHUNK = 2**18


def whole(path: str | Path) -> bool:
    """Whether a local tar.gz reads to its end and holds a JSON file."""
    try:
        with tarfile.open(path, "r:gz") as tar:
            return sum(member.isfile() and member.name.endswith(".json") for member in tar) > 0
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        return False


def direct_environment() -> dict[str, str]:
    """The environment without proxies and without prompts."""
    return {k: v for k, v in os.environ.items() if k.lower() not in PROXIES} | {"GIT_TERMINAL_PROMPT": "0"}


def tool(name: str) -> str:
    """The path of a program that has to be there."""
    found = shutil.which(name)
    if found is None:
        raise RuntimeError(f"{name} is not installed")
    return found


def _pour(response, out, floor: int, window: float) -> None:
    """Copy a response; give up if fewer than ``floor`` bytes a second came in the last ``window`` seconds."""
    seen: deque[tuple[float, int]] = deque([(time.monotonic(), 0)])
    total = 0
    while block := response.read(CHUNK):
        out.write(block)
        total += len(block)
        now = time.monotonic()
        seen.append((now, total))
        while now - seen[0][0] > window:
            then, had = seen.popleft()
            if total - had < floor * (now - then):
                raise TimeoutError(f"fewer than {floor} bytes a second")
    told = response.headers.get("Content-Length")
    if told is not None and total < int(told):
        raise ConnectionError(f"broken off after {total} of {told} bytes")


# The least speed, in bytes a second over so many seconds.
def download(url: str, part: Path, *, timeout: float = 60, floor: int = 256, window: float = 180) -> None:
    """Download to ``part``, going on where an earlier attempt stopped if the server can."""
    have = part.stat().st_size if part.exists() else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
    opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
    try:
        with opener.open(request, timeout=timeout) as response:
            goes_on = have and getattr(response, "status", None) == 206
            with part.open("ab" if goes_on else "wb") as out:
                _pour(response, out, floor, window)
    except urllib.error.HTTPError as refused:
        if refused.code == 416:  # nothing lies beyond what is there, and that was not whole
            part.unlink()
        raise


def clone(target: str | Path, *, repository: str = CLONE_URL, ref: str = CLONE_REF, attempts: int = 3) -> None:
    """Clone the advisory folders only, one commit deep, and pack them as an archive."""
    target, git, error = Path(target), tool("git"), ""
    root = f"{Path(repository).stem}-{ref}"
    for _ in range(attempts):
        with tempfile.TemporaryDirectory(dir=target.parent) as scratch:
            work = Path(scratch) / root
            steps = [
                [git, "clone", "--depth=1", "--filter=blob:none", "--sparse", "--single-branch", f"--branch={ref}", repository, str(work)],
                [git, "-C", str(work), "sparse-checkout", "set", K.REVIEWED_PREFIX.rstrip("/"), K.UNREVIEWED_PREFIX.rstrip("/")],
            ]
            for step in steps:
                done = subprocess.run(step, capture_output=True, text=True, env=direct_environment())
                if done.returncode:
                    error = done.stderr.strip()
                    print(f"warning: {step[1]} failed: {error}", file=sys.stderr)
                    break
            else:
                packed = Path(scratch) / "packed.tar.gz"
                with tarfile.open(packed, "w:gz") as tar:
                    for prefix in (K.REVIEWED_PREFIX, K.UNREVIEWED_PREFIX):
                        if (work / prefix).exists():
                            tar.add(work / prefix, arcname=f"{root}/{prefix.rstrip('/')}")
                if not whole(packed):
                    raise RuntimeError(f"{repository} holds no advisories")
                packed.replace(target)
                return
    raise RuntimeError(f"cannot clone {repository}: {error}")


def fetch(target: str | Path, *, url: str = ARCHIVE_URL, retries: int = 5, timeout: float = 60, repository: str | None = CLONE_URL) -> str:
    """Bring a whole archive to ``target``; says how: present, recovered, downloaded or cloned.

    The clone stands in only for the public address; it is not what another address names.
    """
    target = Path(target)
    part = target.with_name(target.name + ".part")
    target.parent.mkdir(parents=True, exist_ok=True)
    if whole(target):
        return "present"
    if whole(part):
        part.replace(target)
        return "recovered"
    error = ""
    for attempt in range(1, retries + 1):
        try:
            download(url, part, timeout=timeout)
            if whole(part):
                part.replace(target)
                return "downloaded"
            part.unlink()
            error = "what came is not a whole archive of advisories"
        except OSError as failed:  # network errors and timeouts are of this kind
            error = str(failed)
        print(f"warning: attempt {attempt} of {retries}: {error}", file=sys.stderr)
    if url == ARCHIVE_URL and repository:
        clone(target, repository=repository)
        return "cloned"
    part.unlink(missing_ok=True)
    raise RuntimeError(f"cannot fetch {url}: {error}")
