"""HTTP for connectors: waits between requests, retries, a cache of answers, and secrets kept out of messages.

Services limit requests for each client, so connectors fetch from the driver or from one task for each host.
"""

from __future__ import annotations

import contextlib
import hashlib
import http.client
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from pathlib import Path

_SECRET = re.compile(r"((?:api[_-]?key|apikey|key|token|secret|password|mailto|email)=)[^&#\s]+", re.I)
_last: dict[str, float] = {}
#: Seconds beyond which a service that asks to wait (a quota that is renewed once a day) is not waited for.
LONGEST_WAIT = 120.0
_WAIT_IN = re.compile(r"retry in (\d+)\s*s", re.I)


class HttpError(Exception):
    def __init__(self, status: int | None, message: str, persistent: bool = False):
        super().__init__(redacted(message))
        self.status, self.persistent = status, persistent


class NotFound(HttpError):
    """The service does not know the thing that was asked for."""


def redacted(s: str) -> str:
    return _SECRET.sub(r"\1***", s)


def address(base: str, params: dict | None) -> str:
    given = {k: v for k, v in (params or {}).items() if v is not None}
    return base + ("?" + urllib.parse.urlencode(given) if given else "")


class Client:
    """Fetches texts. transport(request, timeout) -> (status, headers, text) can be replaced, as in tests."""

    def __init__(self, cache: str | None = None, *, retries: int = 6, timeout: float = 60, transport: Callable | None = None, sleep=time.sleep, clock=time.monotonic):
        self.cache, self.retries, self.timeout, self.transport = Path(cache) if cache else None, retries, timeout, transport or _send
        self.sleep, self.clock = sleep, clock

    def text(self, base: str, params: dict | None = None, *, body: dict | None = None, headers: dict | None = None, interval: float = 0, refresh: bool = False, keep: Callable[[str], bool] | None = None) -> str:
        """The answer to a GET, or to a POST of a JSON body; keep says whether an answer may be cached."""
        url = address(base, params)
        place = self.cache / hashlib.sha1((url + json.dumps(body, sort_keys=True)).encode()).hexdigest() if self.cache else None
        if place and place.exists() and not refresh:
            return place.read_text(encoding="utf-8")
        answer = self._fetch(url, body, headers or {}, interval)
        if place and (keep is None or keep(answer)):
            with contextlib.suppress(OSError):  # an answer is worth more than its copy
                place.parent.mkdir(parents=True, exist_ok=True)
                hidden = place.with_suffix(".part")
                hidden.write_text(answer, encoding="utf-8")
                os.replace(hidden, place)
        return answer

    def json(self, base: str, params: dict | None = None, **options):
        answer = self.text(base, params, **options)
        try:
            return json.loads(answer)
        except ValueError:
            raise HttpError(None, f"{redacted(base)} did not answer in JSON: {answer[:120]!r}") from None

    def _fetch(self, url: str, body: dict | None, headers: dict, interval: float) -> str:
        host = urllib.parse.urlsplit(url).netloc
        for attempt in range(self.retries):
            wait = _last.get(host, -1e9) + interval - self.clock()
            if wait > 0:
                self.sleep(wait)
            _last[host] = self.clock()
            data = None if body is None else json.dumps(body).encode()
            request = urllib.request.Request(url, data=data, headers={"Accept": "*/*", **({"Content-Type": "application/json"} if data else {}), **headers})
            try:
                status, got, answer = self.transport(request, self.timeout)
            except (OSError, http.client.HTTPException) as e:  # a body that breaks off is no OSError
                status, got, answer = None, {}, f"{type(e).__name__}: {e}"
            if status == 200:
                return answer
            if status == 404:
                raise NotFound(404, f"not found: {url}")
            again = status is None or status == 429 or status >= 500
            if not again or attempt == self.retries - 1:
                raise HttpError(status, f"{host} answered {status}: {answer[:200]}", persistent=status in (401, 403))
            wait = self._wait(got, answer, attempt)
            if wait > LONGEST_WAIT or attempt and "api key" in answer.lower():
                raise HttpError(status, f"{host} refused with {status}: {answer[:200]}", persistent=True)
            self.sleep(wait)
        raise HttpError(None, f"{host}: no attempts allowed")


    @staticmethod
    def _wait(headers: dict, answer: str, attempt: int) -> float:
        """Seconds until the next attempt: what the service asks for in a header or in words, else twice as long each time."""
        asked, said = headers.get("Retry-After") or headers.get("retry-after") or "", _WAIT_IN.search(answer)
        if asked.replace(".", "", 1).isdigit():
            return float(asked)
        return float(said[1]) + 1 if said else min(60.0, 2.0**attempt)


def _send(request: urllib.request.Request, timeout: float) -> tuple[int, dict, str]:
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode("utf-8", "replace")
