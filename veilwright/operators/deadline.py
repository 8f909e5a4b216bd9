"""A model with a time limit for each text.

The model runs in a process of its own beside the Python worker. A text that is not answered in time
costs that process its life: it is ended and another takes its place, so a model that hangs holds up one
text and no other. Loading does not count to any text's time.

A model that can be forked is loaded once. The process that loaded it answers nothing itself; it forks
those that do, which takes milliseconds and shares what was loaded. Then texts that take much longer than
usual are waited for while a further copy goes on with those behind them.
"""

from __future__ import annotations

import io
import logging
import os
import pickle
import select
import socket
import struct
import subprocess
import sys
from collections import deque
from collections.abc import Callable, Iterator
from time import monotonic

from pyspark import cloudpickle

#: What the process that loads runs. Over its control socket it gets the loader, says that it is ready, then
#: is told to open a copy on the socket that comes along, or to end one. With the control socket all ends.
_CHILD = """
import gc, os, pickle, signal, socket, struct, sys
os.dup2(2, 1)  # what a model prints goes where errors go
sys.stdout = sys.stderr
control = socket.socket(fileno=int(sys.argv[1]))
def take(source):
    head = source.read(8)
    return pickle.loads(source.read(struct.unpack("<Q", head)[0])) if len(head) == 8 else None
def give(to, value):
    data = pickle.dumps(value)
    to.sendall(struct.pack("<Q", len(data)) + data)
def serve(line):
    source = line.makefile("rb")
    while (text := take(source)) is not None:
        try:
            give(line, ("done", list(predict([text]))[0]))
        except Exception as failure:
            give(line, ("failed", repr(failure)))
def told(size=9):
    said, fds, _, _ = socket.recv_fds(control, size, 1)
    while said and len(said) < size:
        said += control.recv(size - len(said)) or sys.exit(0)
    return said[:1], struct.unpack("<Q", said[1:])[0] if said else 0, fds
def begin():
    head = control.recv(8, socket.MSG_WAITALL)
    data = control.recv(struct.unpack("<Q", head)[0], socket.MSG_WAITALL)
    return pickle.loads(data)()
try:
    predict = begin()
except BaseException as failure:
    give(control, ("unloaded", repr(failure)))
    sys.exit(1)
give(control, ("ready", None))
forks, copies = sys.argv[2] == "1", set()
gc.freeze()
try:
    while True:
        what, pid, fds = told()
        if what == b"+":
            line = socket.socket(fileno=fds[0])
            if not forks:
                serve(line)
                break
            pid = os.fork()
            if not pid:
                copies.clear()
                control.close()
                serve(line)
                os._exit(0)
            copies.add(pid)
            line.close()
            control.sendall(struct.pack("<Q", pid))
        elif what == b"-":
            copies.discard(pid)
            os.kill(pid, signal.SIGKILL)
            os.waitpid(pid, 0)
        else:
            break
finally:
    for pid in copies:
        os.kill(pid, signal.SIGKILL)
        os.waitpid(pid, 0)
"""


#: Spans or the reason why there are none, and milliseconds.
Answer = tuple[list[dict] | None, str | None, float]

#: A text is late for its neighbours after this share of the limit, or so many times the mean of those before.
PATIENCE, TIMES_THE_MEAN = 1 / 20, 8
#: Lists of texts that may be begun before the first of them is answered.
AHEAD = 16


class Late(Exception):
    """No answer in time."""


class Died(Exception):
    """The process ended before it answered."""


def _send(line: socket.socket, value: object) -> None:
    data = pickle.dumps(value)
    try:
        line.sendall(struct.pack("<Q", len(data)) + data)
    except (BrokenPipeError, ConnectionResetError) as failure:
        raise Died from failure


def _receive(line: socket.socket, until: float | None) -> tuple[str, object]:
    have, need = io.BytesIO(), None
    while True:
        left = None if until is None else max(0.0, until - monotonic())
        if not select.select([line], [], [], left)[0]:
            raise Late
        try:
            part = line.recv(1 << 16)
        except ConnectionResetError as failure:
            raise Died from failure
        if not part:
            raise Died
        have.write(part)
        if need is None and have.tell() >= 8:
            need = 8 + struct.unpack("<Q", have.getvalue()[:8])[0]
        if need is not None and have.tell() >= need:
            return pickle.loads(have.getvalue()[8:])


class Model:
    """The process that loaded the model; ``copy`` opens a line to one that answers, ``end_copy`` ends that."""

    def __init__(self, loader: bytes, load_seconds: float | None, forks: bool):
        paths = os.pathsep.join(p for p in sys.path if p)
        self.forks = forks
        self.control, theirs = socket.socketpair()
        self.process = subprocess.Popen(
            [sys.executable, "-c", _CHILD, str(theirs.fileno()), str(int(forks))], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL,
            pass_fds=[theirs.fileno()], env=os.environ | {"PYTHONPATH": paths},
        )
        theirs.close()
        try:
            self.control.sendall(struct.pack("<Q", len(loader)) + loader)
            kind, said = _receive(self.control, None if load_seconds is None else monotonic() + load_seconds)
        except (Late, Died, BrokenPipeError, ConnectionResetError) as failure:
            self.end()
            raise RuntimeError(f"the model was not loaded: {failure!r}") from failure
        if kind == "unloaded":
            self.end()
            raise RuntimeError(f"the model was not loaded: {said}")

    def copy(self) -> tuple[socket.socket, int]:
        ours, theirs = socket.socketpair()
        socket.send_fds(self.control, [b"+" + bytes(8)], [theirs.fileno()])
        theirs.close()
        return ours, struct.unpack("<Q", self.control.recv(8, socket.MSG_WAITALL))[0] if self.forks else 0

    def end_copy(self, pid: int) -> None:
        if self.forks:
            self.control.sendall(b"-" + struct.pack("<Q", pid))

    def end(self) -> None:
        self.control.close()  # tells it to end its copies; it answers nothing itself and so can not hang
        if not self.forks:
            self.process.kill()
        self.process.wait()


class Answers:
    """Answers to a list of texts, in any order."""

    def __init__(self, size: int):
        self.all: list[Answer | None] = [None] * size
        self.left = size

    def put(self, place: int, answer: Answer) -> None:
        self.all[place], self.left = answer, self.left - 1


class Crew:
    """Up to ``size`` copies of a model at work; ``answered`` gives them texts and keeps the order of the lists."""

    def __init__(self, loader: bytes, milliseconds: int, load_seconds: float | None, forks: int):
        self.loader, self.milliseconds, self.load_seconds = loader, milliseconds, load_seconds
        self.size, self.forks = max(1, forks), forks > 0
        self.limit, self.model = milliseconds / 1000, None
        self.idle: list[tuple[socket.socket, int]] = []
        self.busy: dict[socket.socket, tuple[int, float, Answers, int, str]] = {}  # pid, begin, answers, place, text
        self.asked, self.spent = 0, 0.0

    def _patience(self) -> float:
        return min(self.limit, max(self.limit * PATIENCE, TIMES_THE_MEAN * self.spent / max(1, self.asked)))

    def _give(self, out: Answers, place: int, text: str) -> None:
        if not self.model:
            self.model = Model(self.loader, self.load_seconds, self.forks)
        line, pid = self.idle.pop() if self.idle else self.model.copy()
        self.busy[line] = pid, monotonic(), out, place, text
        try:
            _send(line, text)
        except Died as failure:
            self._end(line, failure)

    def _end(self, line: socket.socket, failure: Exception) -> None:
        """The text is given up, and with it the copy that has it."""
        pid, begin, out, place, text = self.busy.pop(line)
        line.close()
        if self.forks:
            self.model.end_copy(pid)
        else:
            self.model.end()
            self.model = None
        logging.getLogger(__name__).warning("a model was ended over a text of %d characters: %r", len(text), failure)
        reason = f"timeout after {self.milliseconds}ms" if isinstance(failure, Late) else "scan failed"
        out.put(place, (None, reason, (monotonic() - begin) * 1000))

    def _take(self, line: socket.socket) -> None:
        pid, begin, out, place, text = self.busy[line]
        try:
            kind, said = _receive(line, begin + self.limit)
        except (Late, Died) as failure:
            self._end(line, failure)
            return
        del self.busy[line]
        self.idle.append((line, pid))
        seconds = monotonic() - begin
        self.asked, self.spent = self.asked + 1, self.spent + seconds
        if kind != "done":
            logging.getLogger(__name__).warning("a model failed on a text of %d characters: %s", len(text), said)
        out.put(place, (said, None, seconds * 1000) if kind == "done" else (None, "scan failed", seconds * 1000))

    def _wait(self, room: bool) -> None:
        """Until there is an answer or a text is late; with ``room`` for another text, until all at work are slow."""
        now = monotonic()
        ends = [begin + self.limit for _, begin, *_ in self.busy.values()]
        if room:
            ends.append(max(begin for _, begin, *_ in self.busy.values()) + self._patience())
        for line in select.select(list(self.busy), [], [], max(0.0, min(ends) - now))[0]:
            self._take(line)
        now = monotonic()
        for line in [line for line, (_, begin, *_) in self.busy.items() if now >= begin + self.limit]:
            self._end(line, Late())

    def _free(self) -> bool:
        """Whether another text may be given out: no copy is at work, or all that are have a slow one."""
        now = monotonic()
        return len(self.busy) < self.size and all(now >= begin + self._patience() for _, begin, *_ in self.busy.values())

    def answered(self, lists: Iterator[list[str]]) -> Iterator[list[Answer]]:
        lists = iter(lists)
        begun: deque[Answers] = deque()
        todo: deque[tuple[Answers, int, str]] = deque()
        more = True
        while more or begun:
            if more and not todo and len(begun) < AHEAD:
                texts = next(lists, None)
                more = texts is not None
                if more:
                    begun.append(Answers(len(texts)))
                    todo.extend((begun[-1], place, text) for place, text in enumerate(texts))
            while todo and self._free():
                self._give(*todo.popleft())
            while begun and not begun[0].left:
                yield begun.popleft().all
            if self.busy and (todo or not more or len(begun) >= AHEAD):
                self._wait(bool(todo) and len(self.busy) < self.size)

    def end(self) -> None:
        for line in [*self.busy, *(line for line, _ in self.idle)]:
            line.close()
        if self.model:
            self.model.end()


def timed(load: Callable, milliseconds: int, load_seconds: float | None = None, forks: int = 0) -> Callable[[Iterator[list[str]]], Iterator[list[Answer]]]:
    """A function from lists of texts to ``(spans, reason, ms)`` of each: spans or the reason why there are none, and the time.

    The limit holds for each text alone, from when the model gets it. A model that can not be loaded
    fails the job. ``forks``: how many forked copies of the loaded model may work at a time; 0 for a model
    that does not bear a fork, which is loaded anew after each text that was late.
    """
    loader = cloudpickle.dumps(load)

    def run(lists: Iterator[list[str]]) -> Iterator[list[Answer]]:
        crew = Crew(loader, milliseconds, load_seconds, forks)
        try:
            yield from crew.answered(lists)
        finally:
            crew.end()

    return run
