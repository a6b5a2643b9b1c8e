import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from veritrove.__main__ import main
from veritrove.plans.durable import release, stored
from veritrove.sources.generator import ChatGenerator


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            request = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], request))
            prompt = request["messages"][0]["content"]
            content = "[1]" if prompt == "list" else json.dumps({"answer": "Kept for seven years.", "citations": [], "confidence": 0.5, "insufficient_evidence": False})
            body = json.dumps({"choices": [{"message": {"content": content}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/v1/", seen
    made.shutdown()


def test_generator(server):
    url, seen = server
    generator = ChatGenerator(url, "key", "m")
    assert json.loads(generator("hello"))["confidence"] == 0.5
    path, key, request = seen[0]
    assert path == "/v1/chat/completions" and key == "Bearer key" and request["model"] == "m" and request["temperature"] == 0.0 and request["response_format"] == {"type": "json_object"}
    with pytest.raises(ValueError):
        generator("list")


def test_command_line(spark, tmp_path, server, monkeypatch, capsys):
    monkeypatch.setenv("LLM_BASE_URL", server[0])
    (tmp_path / "a.txt").write_text("Audit logs must be kept for seven years by the records team.")
    (tmp_path / "cases.json").write_text('[{"question": "How long are logs kept?", "expected_insufficient_evidence": false}]')
    store = ["--store", str(tmp_path / "store")]

    def run(*arguments):
        main([*store, *arguments], spark)
        return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]

    first = run("ingest", str(tmp_path / "a.txt"))
    assert first[0]["inserted"] and run("health") == [{"documents": 1, "chunks": 1}] and run("list")[0]["doc_id"] == first[0]["doc_id"]
    assert "seven years" in run("query", "How long are logs kept?")[0]["answer"]
    assert run("query", "How long are logs kept?", "--llm", "--prompt-mode", "one_shot")[0]["generator"] == "openai-compatible"
    benchmark = run("prompt-benchmark", "--cases", str(tmp_path / "cases.json"))
    assert benchmark[0]["quarantined_chunks"] == 0 and len(benchmark) == 4 and benchmark[1]["schema_validity_rate"] == 1.0
    (tmp_path / "labelled.json").write_text(json.dumps([{"question": "How long are logs kept?", "relevant_doc_id": first[0]["doc_id"]}]))
    assert run("evaluate", "--cases", str(tmp_path / "labelled.json"))[0]["hit_rate_at_k"] == 1.0


def test_stored_tables_can_be_released(spark):
    release(spark)
    kept = stored(spark.range(5))
    assert kept.count() == 5 and release(spark) == 1 and release(spark) == 0
