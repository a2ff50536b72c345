"""Clients of sources that are asked over one connection: requests and answers matched by number.

A transport is anything with send(text), receive(timeout) -> text (TimeoutError, ConnectionError)
and close(); opening one is a callable, so that a test or any WebSocket library can stand in. A
lost connection is opened again, once for each try; waits are those of `Retry`.
"""

from __future__ import annotations

import json
import logging
import secrets
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from kinmatch.sources.connectors import RateLimiter, Retry

log = logging.getLogger(__name__)


class Transport(Protocol):
    def send(self, text: str) -> None: ...

    def receive(self, timeout: float) -> str: ...

    def close(self) -> None: ...


class Refused(Exception):
    """The source answered that it does not serve the request; asking again does not help."""


@dataclass
class Session:
    """One connection; subclasses say how it is greeted, asked and answered."""

    open: Callable[[], Transport]
    timeout: float = 30.0
    retry: Retry = Retry()
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    stats: dict[str, int] = field(default_factory=lambda: {"calls": 0, "retries": 0, "reconnects": 0, "bytes": 0})
    #: What was asked for and what became of it.
    diagnostics: list[dict] = field(default_factory=list)
    _link: Transport | None = None
    _opened: bool = False

    def greet(self) -> None:
        """What has to be said on a new connection."""

    def ask(self, topic: str, params: dict) -> tuple[str, object]:
        """The text to send and the number that its answer will have."""
        raise NotImplementedError

    def answer(self, message, number) -> object:
        """The answer to that number; KeyError if the message is another one; Refused."""
        raise NotImplementedError

    def connect(self) -> None:
        if self._opened:
            self.stats["reconnects"] += 1
        self._link, self._opened = self.open(), True
        self.greet()

    def receive(self, until: float):
        left = until - self.clock()
        if left <= 0:
            raise TimeoutError("no answer in time")
        text = self._link.receive(left)
        self.stats["bytes"] += len(text)
        try:
            return json.loads(text)
        except ValueError:
            return None  # one broken message does not end the stream

    def once(self, topic: str, params: dict):
        if self._link is None:
            self.connect()
        text, number = self.ask(topic, params)
        self._link.send(text)
        until = self.clock() + self.timeout
        while True:
            try:
                return self.answer(self.receive(until), number)
            except KeyError:
                continue

    def call(self, topic: str, params: dict | None = None, attempts: int | None = None):
        """The answer, asked for again after a lost connection or no answer in time."""
        self.stats["calls"] += 1
        attempts = attempts or self.retry.attempts
        for attempt in range(attempts):
            try:
                got = self.once(topic, params or {})
                self.diagnostics.append({"topic": topic, "ok": True, "error": None})
                return got
            except (TimeoutError, ConnectionError) as e:
                error: Exception = e
                if isinstance(e, ConnectionError):
                    self._link = None
                if attempt + 1 < attempts:
                    self.stats["retries"] += 1
                    self.sleep(self.retry.wait(attempt, None))
            except Refused as e:
                error = e
                break
        self.diagnostics.append({"topic": topic, "ok": False, "error": f"{type(error).__name__}: {error}"})
        raise error

    def dump(self, topic: str, params: dict | None = None, attempts: int | None = None):
        """As call, but None where nothing came; the diagnostics tell why."""
        try:
            return self.call(topic, params, attempts)
        except (TimeoutError, ConnectionError, Refused) as e:
            log.warning("%s: %s", topic, e)
            return None

    def close(self) -> None:
        if self._link is not None:
            self._link.close()
            self._link = None

    def failed(self) -> list[dict]:
        return [d for d in self.diagnostics if not d["ok"]]


class TreeSession(Session):
    """Commands with a request id; answers bring it back with a code, 0 if all is well."""

    greeting = {"language": "eng", "source": 42}

    def ask(self, topic, params):
        number = secrets.token_hex(4)
        return json.dumps({"command": topic, "params": params, "rid": number}), number

    def answer(self, message, number):
        if not isinstance(message, dict) or message.get("rid") != number:
            raise KeyError(number)  # pushes have no id and are not used
        if message.get("code") != 0:
            raise Refused(f"code {message.get('code')}: {message.get('msg') or message.get('data')}")
        return message.get("data")

    def greet(self):
        text, number = self.ask("request_session", self.greeting)
        self._link.send(text)
        until = self.clock() + self.timeout
        while True:
            try:
                return self.answer(self.receive(until), number)
            except KeyError:
                continue

    def get(self, what: dict, where: dict | None = None) -> dict:
        data = self.call("get", {"source": "betting", "what": what, "subscribe": False} | ({"where": where} if where else {})) or {}
        return data.get("data") or data


#: Message codes of the WAMP protocol.
HELLO, WELCOME, ABORT, GOODBYE, ERROR = 1, 2, 3, 6, 8
SUBSCRIBE, SUBSCRIBED, EVENT, CALL, RESULT, REGISTER, REGISTERED = 32, 33, 36, 48, 50, 64, 65


class RecordSession(Session):
    """Remote calls in WAMP's JSON messages: a topic is called and gives a list of records."""

    realm: str = "http://sports"
    procedure: str = "/sports#initialDump"
    _number: int = 0

    def greet(self):
        self._link.send(json.dumps([HELLO, self.realm, {"roles": {"caller": {}, "callee": {}, "subscriber": {}, "publisher": {}}}]))
        until = self.clock() + self.timeout
        while True:
            message = self.receive(until)
            if isinstance(message, list) and message[:1] == [WELCOME]:
                return message[1]
            if isinstance(message, list) and message[:1] == [ABORT]:
                raise Refused(f"not welcome: {message[2:]}")

    def ask(self, topic, params):
        self._number += 1
        return json.dumps([CALL, self._number, params, self.procedure, [], {"topic": topic}]), self._number

    def answer(self, message, number):
        if not isinstance(message, list) or not message:
            raise KeyError(number)
        if message[0] == GOODBYE:
            raise ConnectionError("the source said goodbye")
        if message[0] == ERROR and message[1:3] == [CALL, number]:
            raise Refused(str(message[4:]))
        if message[0] != RESULT or message[1] != number:
            raise KeyError(number)  # events and other pushes are not used
        last = message[-1] if len(message) > 3 else {}
        return (last.get("records") if isinstance(last, dict) else None) or []


# -- the way round a bulk answer that does not come -----------------------------------------------


def to_come(record: dict) -> bool:
    """Whether there are matches to come; a record that does not say so may have some."""
    n = record.get("numberOfUpcomingMatches")
    return n in (None, "") or float(n) > 0


@dataclass
class Walk:
    """Collects a sport league by league: its branches, their leagues, each league's matches.

    Leagues can be asked for in several forms. The form that first brought matches is asked for
    first from then on; an answer without matches does not count, as all leagues would seem empty.
    topics: names of the topics, with {sport}, {id}.
    """

    dump: Callable[..., list[dict] | None]
    branches: str
    leagues: str
    forms: tuple[str, ...]
    branch_type: str = "LOCATION"
    most_branches: int = 0  # 0: all
    limiter: RateLimiter | None = None
    working: str | None = None

    def _get(self, topic: str, **more) -> list[dict]:
        if self.limiter:
            self.limiter.acquire()
        return self.dump(topic, **more) or []

    def matches(self, sport: str) -> Iterator[dict]:
        found = [r for r in self._get(self.branches.format(sport=sport)) if r.get("_type") == self.branch_type and r.get("id") is not None and to_come(r)]
        for branch in found[: self.most_branches or None]:
            for league in self._get(self.leagues.format(sport=sport, id=branch["id"])):
                if league.get("_type") == "TOURNAMENT" and league.get("id") is not None and to_come(league):
                    yield from self._of(sport, league["id"])

    def _of(self, sport: str, league) -> list[dict]:
        for form in sorted(self.forms, key=lambda f: f != self.working):
            own = [r for r in self._get(form.format(sport=sport, id=league), attempts=2) if r.get("_type") == "MATCH" and r.get("id") is not None and str(r.get("sportId")) == sport]
            if own:
                self.working = form
                return own
        return []


def bulk_or_walk(bulk: list[dict] | None, walk: Walk, sport: str) -> list[dict]:
    """The bulk answer's matches; league by league where it was refused (None), not where it is empty."""
    if bulk is not None:
        return [r for r in bulk if r.get("_type") == "MATCH" and str(r.get("sportId")) == sport]
    return list(walk.matches(sport))
