"""A model over a table: failures, repeats, and work that goes on after a loss."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from placeloom.operators import model_calls as C
from placeloom.service import http_client


@pytest.fixture
def server():
    """Fails every third call; remembers what it was asked and what it answered."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][0]["content"][1]["text"]
            with state.lock:
                state.calls += 1
                state.now += 1
                state.most = max(state.most, state.now)
                state.asked[said] += 1
                code = 400 if said == "refused" else 503 if state.calls % 3 == 0 or said == "never" else 200
                state.answered[said] += code == 200
            out = json.dumps({"choices": [{"message": {"content": json.dumps({"image_summary": said, "confidence": 0.9})}}]}).encode()
            with state.lock:
                state.now -= 1
            self.send_response(code)
            self.end_headers()
            self.wfile.write(out if code == 200 else b"")

        def log_message(self, *_):
            pass

    state = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    state.lock, state.calls, state.now, state.most, state.asked, state.answered = threading.Lock(), 0, 0, 0, Counter(), Counter()
    threading.Thread(target=state.serve_forever, daemon=True).start()
    yield state
    state.shutdown()


def requests(spark, texts):
    return spark.createDataFrame([(i, ["http://x/a.jpg"], t, None) for i, t in enumerate(texts)], "id int, image_urls array<string>, user_text string, version string")


def test_answers_come_once(spark, server, tmp_path):
    ask = http_client(f"http://127.0.0.1:{server.server_port}", "m")
    texts = [f"text {i}" for i in range(60)] * 2 + ["never", "refused"]
    df = requests(spark, texts)
    how = {"attempts": 6, "pause": 0.0, "flush": 5, "buckets": 4, "in_flight": 3}
    rows = C.understood(df, ask, str(tmp_path), "m", **how).collect()
    assert len(rows) == 122 and all(r.answer.image_summary == r.user_text and r.answer.confidence == 0.9 for r in rows if r.user_text.startswith("text"))
    bad = {r.user_text: r.answer for r in rows if not r.user_text.startswith("text")}
    assert all(a.confidence == 0.78 and a.raw_model_output.startswith("vLLM request failed; fallback used: HTTP Error") for a in bad.values())
    assert set(server.answered) - {"never", "refused"} == {f"text {i}" for i in range(60)} and max(server.answered.values()) == 1
    assert server.asked["refused"] == 1 and server.asked["never"] == 6 and server.most <= 2 * 3
    # a later run asks only for what failed
    before = server.calls
    again = C.understood(df, ask, str(tmp_path), "m", **how).collect()
    assert sorted(str(r) for r in again) == sorted(str(r) for r in rows) and server.calls - before == 7 and max(server.answered.values()) == 1


def test_goes_on_after_a_lost_task(spark, server, tmp_path):
    url, flag = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "lost")

    def ask(payload):
        import os

        if "text 30" in json.dumps(payload) and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        return http_client(url, "m")(payload)

    df = requests(spark, [f"text {i}" for i in range(40)])
    how = {"attempts": 6, "pause": 0.0, "flush": 1, "buckets": 1, "in_flight": 1}
    with pytest.raises(Exception, match="(?i)crashed|exited|eof"):
        C.understood(df, ask, str(tmp_path / "s"), **how).collect()
    kept = sum(server.answered.values())
    assert 0 <= kept < 40
    rows = C.understood(df, ask, str(tmp_path / "s"), **how).collect()
    assert {r.answer.image_summary for r in rows} == {f"text {i}" for i in range(40)} and max(server.answered.values()) == 1


def test_odd_requests(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None, None), (2, [], "", "unknown"), (3, ["http://x/museum"], None, None)], "id int, image_urls array<string>, user_text string, version string")
    rows = {r.id: r.answer for r in C.understood(df, lambda p: "no json", str(tmp_path / "a"), pause=0.0).collect()}
    assert {a.image_summary for a in rows.values()} == {"no json"} and {a.confidence for a in rows.values()} == {0.3}

    def down(payload):
        raise OSError("down")

    rows = {r.id: r.answer for r in C.understood(df, down, str(tmp_path / "b"), attempts=1).collect()}
    assert (rows[1].confidence, rows[3].confidence) == (0.78, 0.62) and rows[3].raw_model_output.endswith("down")
    assert C.understood(df.filter("false"), down, str(tmp_path / "c")).count() == 0
    assert C.answers(spark.createDataFrame([(None,)], "payload string"), down, str(tmp_path / "d")).select(F.count("*")).first()[0] == 0
