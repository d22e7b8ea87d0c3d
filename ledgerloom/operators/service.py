"""The edge of a service over the engine: admission, limits, status codes, metrics. Any HTTP server can call handle()."""

from __future__ import annotations

import concurrent.futures
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from ledgerloom.functions import text as T

SHORTEST, LONGEST = 3, 1000


@dataclass
class Service:
    """answer(question) gives a dict with answer and unverified; document(filing_id) a page or None."""

    answer: Callable[[str], dict]
    document: Callable[[str], str | None]
    ready: bool = True
    most_waiting: int = 4
    timeout: float = 300.0
    window: int = 200

    recent: deque = field(init=False)
    waiting: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        self.recent = deque(maxlen=self.window)
        self._count, self._one = threading.Lock(), threading.Lock()
        self._pool = concurrent.futures.ThreadPoolExecutor(self.most_waiting)

    def _run(self, question: str) -> dict:
        with self._one:  # one pipeline at a time
            return self.answer(question)

    def query(self, body: dict) -> tuple[int, dict]:
        """(status, body): 422 a bad question, 503 not ready or full, 504 too slow, 500 an error."""
        question = body.get("question")
        if not isinstance(question, str) or not SHORTEST <= len(question.strip()) <= LONGEST:
            return 422, {"error": f"a question has {SHORTEST} to {LONGEST} characters"}
        with self._count:
            if not self.ready or self.waiting >= self.most_waiting:
                return 503, {"error": "not ready" if not self.ready else "busy"}
            self.waiting += 1
        start = time.perf_counter()
        try:
            got = self._pool.submit(self._run, question.strip()).result(self.timeout)
        except concurrent.futures.TimeoutError:
            return 504, {"error": "timed out"}
        except Exception as e:  # whatever a model or a job may raise
            return 500, {"error": type(e).__name__}
        finally:
            with self._count:
                self.waiting -= 1
        ms = round(1000 * (time.perf_counter() - start))
        refused = T.REFUSAL in str(got.get("answer", "")).lower()
        self.recent.append((ms, refused, len(got.get("unverified") or [])))
        return 200, {**got, "question": question.strip(), "refused": refused, "latency_ms": ms}

    def filing(self, filing_id: str) -> tuple[int, str]:
        page = self.document(filing_id)
        return (200, page) if page is not None else (404, "no such filing")

    def health(self) -> tuple[int, dict]:
        return (200 if self.ready else 503), {"ready": self.ready, "waiting": self.waiting}

    def metrics(self) -> dict:
        """Over the last requests: count, nearest-rank latencies, shares refused and with unverified numbers."""
        rows, n = list(self.recent), len(self.recent)
        times = sorted(ms for ms, _, _ in rows)
        at = lambda p: times[min(n - 1, int(p * (n - 1) + 0.5))] if n else None
        share = lambda xs: sum(xs) / n if n else 0.0
        return {"requests": n, "p50_ms": at(0.5), "p95_ms": at(0.95), "refusal_rate": share([r for _, r, _ in rows]), "unverified_rate": share([u > 0 for _, _, u in rows])}

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, object]:
        if (method, path) == ("POST", "/query"):
            return self.query(body or {})
        if (method, path) == ("GET", "/health"):
            return self.health()
        if (method, path) == ("GET", "/metrics"):
            return 200, self.metrics()
        if method == "GET" and path.startswith("/filing/"):
            return self.filing(path.removeprefix("/filing/"))
        return 404, {"error": "not found"}
