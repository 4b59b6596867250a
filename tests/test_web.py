import json
import threading
import urllib.error
import urllib.request

import pytest

from veriloom import web


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("web")
    for folder in ("golden", "text"):
        (root / folder).mkdir()
    (root / "golden" / "d.json").write_text('{"doc_id": "d", "fields": [{"name": "cash", "value": 5.0}]}')
    (root / "text" / "d.json").write_text('{"pages": ["Cash 5"]}')
    server = web.server(web.App(spark, str(root), f"{root}/runs"), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def ask(url, method="GET", data=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, method=method)) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def test_endpoints(base):
    assert ask(base + "/")[0] == 200 and json.loads(ask(base + "/api/config")[1])["extractor"] == "heuristic"
    assert json.loads(ask(base + "/api/runs")[1]) == []
    done = json.loads(ask(base + "/api/run", "POST", b"{}")[1])
    listed = json.loads(ask(base + "/api/runs")[1])
    assert [r["run_id"] for r in listed] == [done["run_id"]] and json.loads(ask(f"{base}/api/runs/{done['run_id']}")[1]) == done
    assert done["report"]["overall"]["accuracy"] == 1.0 and [d["doc_id"] for d in done["documents"]] == ["d"]
    assert json.loads(ask(f"{base}/api/runs/{done['run_id']}/d")[1])["fields"][0]["quote"] == "Cash 5"
    assert ask(f"{base}/api/runs/{done['run_id']}/x")[0] == 404 and ask(f"{base}/api/runs/{done['run_id']}/..%2Fx")[0] == 400
    assert len(json.loads(ask(base + "/api/inspect/d")[1])["fields"]) == 8
    saved = json.loads(ask(base + "/api/golden/d", "PUT", b'{"fields": [{"name": "cash", "value": null}]}')[1])
    assert saved["fields"][0]["value"] is None
    assert json.loads(ask(base + "/api/upload?filename=A%20b.pdf", "POST", b"%PDF-1")[1]) == {"doc_id": "a-b"}
    assert json.loads(ask(base + "/api/corpus")[1])["unlabelled"] == 1


@pytest.mark.parametrize(("path", "method", "data", "status"), [
    ("/api/runs/none", "GET", None, 404), ("/api/runs/..%2F..%2Fetc", "GET", None, 400), ("/api/golden/x", "GET", None, 404), ("/api/inspect/x", "GET", None, 404), ("/x", "GET", None, 404),
    ("/api/run", "POST", b'{"extractor": "nobody"}', 400), ("/api/upload?filename=x.pdf", "POST", b"PK", 400), ("/api/golden/d", "PUT", b'{"fields": [{"name": "sales"}]}', 400), ("/api/golden/d", "PUT", b"{", 400),
])
def test_refusals(base, path, method, data, status):
    assert ask(base + path, method, data)[0] == status
