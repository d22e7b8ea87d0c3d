import threading
import time

from ledgerloom.operators.service import Service


def make(**options):
    def answer(q):
        if "fail" in q:
            raise RuntimeError("boom")
        if "slow" in q:
            time.sleep(0.5)
        return {"answer": "The sources do not contain this information." if "none" in q else "It was $5 [1].", "unverified": ["$5"] if "bad" in q else []}

    return Service(answer, lambda f: "<html>" if f == "ACME_10Q_2025-06-28" else None, **options)


def test_statuses():
    s = make()
    status, body = s.handle("POST", "/query", {"question": " What was it? "})
    assert status == 200 and body["question"] == "What was it?" and not body["refused"]
    assert s.handle("POST", "/query", {"question": "ab"})[0] == s.handle("POST", "/query", {"question": "x" * 1001})[0] == s.handle("POST", "/query", {})[0] == 422
    assert s.handle("POST", "/query", {"question": "fail now"})[0] == 500
    assert s.handle("GET", "/filing/ACME_10Q_2025-06-28") == (200, "<html>") and s.handle("GET", "/filing/../x")[0] == 404
    assert s.handle("GET", "/health")[0] == 200 and make(ready=False).handle("GET", "/health")[0] == 503
    assert make(ready=False).handle("POST", "/query", {"question": "What?"})[0] == 503
    assert make(timeout=0.05).handle("POST", "/query", {"question": "slow one"})[0] == 504
    assert s.handle("GET", "/nowhere")[0] == 404


def test_admission():
    s = make(most_waiting=1)
    first = threading.Thread(target=s.query, args=({"question": "slow one"},))
    first.start()
    time.sleep(0.1)
    assert s.query({"question": "another"})[0] == 503
    first.join()
    assert s.query({"question": "another"})[0] == 200


def test_metrics():
    s = make(window=3)
    assert s.metrics() == {"requests": 0, "p50_ms": None, "p95_ms": None, "refusal_rate": 0.0, "unverified_rate": 0.0}
    for q in ("dropped", "none here", "bad number", "fine answer"):
        s.query({"question": q})
    m = s.metrics()
    assert m["requests"] == 3 and m["refusal_rate"] == m["unverified_rate"] == 1 / 3
