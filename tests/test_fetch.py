"""Fetching: downloads that break off and go on, files that are not whole, and a clone of a local repository."""

import http.server
import subprocess
import tarfile
import threading

import pytest

from fieldweave.plans import cli
from fieldweave.sources import fetch


@pytest.fixture
def archive(tmp_path):
    body = tmp_path / "src" / "advisories" / "github-reviewed" / "2024" / "01" / "a.json"
    body.parent.mkdir(parents=True)
    body.write_text("{}" + " " * 5000)
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "src", arcname="root-1")
    return tmp_path / "a.tar.gz"


@pytest.fixture
def server(archive):
    """Serves the archive; breaks off at ``cut`` bytes while ``cuts`` are left."""
    content, state = archive.read_bytes(), {"asked": [], "cuts": 0, "cut": 60}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            start = int(self.headers.get("Range", "bytes=0-")[6:-1])
            state["asked"].append(start)
            rest = content[start:]
            self.send_response(206 if start else 200)
            self.send_header("Content-Length", str(len(rest)))
            self.end_headers()
            if state["cuts"]:
                state["cuts"] -= 1
                rest = rest[: state["cut"]]
            self.wfile.write(rest)

        def log_message(self, *args):
            pass

    served = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=served.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{served.server_port}/a.tar.gz", state
    served.shutdown()


def test_download_goes_on_where_it_stopped(tmp_path, archive, server):
    url, state = server
    target = tmp_path / "out" / "x.tar.gz"
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "x.tar.gz.part").write_bytes(archive.read_bytes()[:40])
    assert fetch.fetch(target, url=url) == "downloaded" and state["asked"] == [40]
    assert target.read_bytes() == archive.read_bytes() and not target.with_name("x.tar.gz.part").exists()
    assert fetch.fetch(target, url="http://127.0.0.1:9/none") == "present"
    target.rename(target.with_name("x.tar.gz.part"))
    assert fetch.fetch(target, url="http://127.0.0.1:9/none") == "recovered"


def test_what_is_not_whole_is_fetched_anew(tmp_path, server):
    url, state = server
    state["cuts"] = 1
    assert fetch.fetch(tmp_path / "x.tar.gz", url=url, retries=3) == "downloaded" and state["asked"] == [0, 60]
    empty = tmp_path / "empty.tar.gz"
    with tarfile.open(empty, "w:gz"):
        pass
    assert not fetch.whole(empty) and not fetch.whole(tmp_path / "none")
    with pytest.raises(RuntimeError):
        fetch.fetch(tmp_path / "y.tar.gz", url=empty.as_uri(), retries=2)
    assert not (tmp_path / "y.tar.gz").exists() and not (tmp_path / "y.tar.gz.part").exists()


def test_clone_stands_in(tmp_path, archive, monkeypatch):
    repository = tmp_path / "src"
    (repository / "other.json").write_text("{}")
    git = ["git", "-C", str(repository), "-c", "user.name=a", "-c", "user.email=a@b"]
    for step in (["init", "-q", "-b", "main"], ["config", "uploadpack.allowFilter", "true"], ["add", "."], ["commit", "-qm", "x"]):
        subprocess.run([*git, *step], check=True)
    monkeypatch.setattr(fetch, "ARCHIVE_URL", (tmp_path / "none.tar.gz").as_uri())
    target = tmp_path / "cloned.tar.gz"
    assert fetch.fetch(target, url=fetch.ARCHIVE_URL, retries=1, repository=repository.as_uri()) == "cloned"
    with tarfile.open(target) as tar:
        assert [m.name for m in tar if m.isfile()] == ["src-main/advisories/github-reviewed/2024/01/a.json"]
    with pytest.raises(RuntimeError):
        fetch.clone(tmp_path / "z.tar.gz", repository=(tmp_path / "nothing").as_uri(), attempts=1)


def test_command(tmp_path, archive):
    target, tree = tmp_path / "got.tar.gz", tmp_path / "tree"
    cli.main(["fetch", "--url", archive.as_uri(), "--archive", str(target), "--extract-dir", str(tree)])
    assert fetch.whole(target) and (tree / "advisories" / "github-reviewed" / "2024" / "01" / "a.json").exists()


def test_tools_and_environment(monkeypatch):
    monkeypatch.setenv("HTTPS_PROXY", "http://p")
    assert not {"HTTPS_PROXY", "https_proxy"} & set(fetch.direct_environment())
    with pytest.raises(RuntimeError):
        fetch.tool("no-such-program-here")
