"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  Nothing
is assumed about its markup: the prefixes of a conversation are rendered one turn
longer each time, and consecutive outputs are compared: where the longer one first differs from the shorter one begins what the
turn adds, its *piece*.  A piece is compared with that of the same turn with one character as its text, which
does not occur in the output, and where they part and meet again the text stands.

A longer output that does not begin with the shorter one rewrites history.  The turn is reported, and as spans of
the shorter output say nothing of the longer one, all turns' texts are then found anew in the last output, each by
comparing it with the whole conversation with that turn's text replaced.  What a template leaves of a text is its span.

`turn_template` escapes what could be taken for markup, so its output can be read
back (`read_back`) whatever the texts hold.

Defined cases: null text and null role are empty; turns are taken by turn, ties by
role and then text; repeated rows are turns of their own; rows with a null conv_id
form one conversation with a null id; an empty table gives an empty result; other columns are
ignored.  A task holds one conversation at a time, however long; a conversation of n turns is rendered 2 n times, as a black box needs it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import mapped, record

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_UNSAFE = re.compile(r"[\\#<]")
_UNSAFE_ROLE = re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]+|\\.)*) </turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def turn_template(turns: list[Turn]) -> str:
    r"""``### role: text </turn>`` a turn; ``\``, ``#`` and ``<`` in texts get a backslash, so no text holds a marker."""
    return "".join(f"### {_UNSAFE_ROLE.sub(lambda m: chr(92) + m.group(), role)}: {escape(text)} </turn>\n" for role, text in turns)


def last_thought_template(turns: list[Turn]) -> str:
    """A template that rewrites history: it shows <think> blocks in the last turn only."""
    last = len(turns) - 1
    return "".join(f"[{role}]{text if i == last else re.sub(r'<think>.*?</think>', '', text, flags=re.DOTALL)}[end]" for i, (role, text) in enumerate(turns))


def read_back(formatted: str) -> list[Turn]:
    """The turns of turn_template's output; ValueError if it is not such an output."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


def _unused(text: str) -> str:
    """A character of a private area that the text does not have."""
    return next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text)


class Rendered:
    """formatted; pieces [start, end) that the turns added, None for those whose piece a later turn rewrote; spans [start, end) of
    the turns' texts in formatted; rewrites: the turns that changed what stood before them."""

    def __init__(self, turns: list[Turn], template: Template = turn_template):
        self.pieces: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        self.rewrites: list[int] = []
        before = template([])
        for i, (role, _) in enumerate(turns):
            now = template(turns[: i + 1])
            start = _first_difference(before, now)
            if start < len(before):
                self.rewrites.append(i)
                self.pieces = [p if p and p[1] <= start else None for p in self.pieces]
            self.pieces.append((start, len(now)))
            self.spans.append(self._text(now, template([*turns[:i], (role, mark := _unused(now))]), mark, start))
            before = now
        self.formatted = before
        for i in range(self.rewrites[-1] if self.rewrites else 0):
            mark, (role, _) = _unused(before), turns[i]
            self.spans[i] = self._text(before, template([*turns[:i], (role, mark), *turns[i + 1 :]]), mark, 0)

    @staticmethod
    def _text(now: str, probe: str, mark: str, start: int) -> tuple[int, int]:
        """Where the text stands in now that probe has as mark; at or after start. An empty span if the probe does not show it."""
        at = probe.find(mark, start)
        return (at, max(at, len(now) - (len(probe) - at - 1))) if at >= 0 else (len(now), len(now))

    def masked(self, turns: list[Turn], role: str = "assistant") -> list[str]:
        """The formatted text under the loss mask, a string for each turn of the role."""
        return [self.formatted[s:e] for (s, e), t in zip(self.spans, turns, strict=True) if t[0] == role]


def _first_difference(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("rewrites", pa.int64())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.int64())])


def _conversations(batches):
    held, at, any_row = [], None, False
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(3)]
        for conv, role, text in zip(*cols, strict=True):
            if any_row and conv != at:
                yield at, held
                held = []
            at, any_row = conv, True
            held.append((role or "", text or ""))
    if any_row:
        yield at, held


def _by_conversation(rows: DataFrame) -> DataFrame:
    order = ["conv_id", "turn", "role", "text"]
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")


def formatted(rows: DataFrame, template: Template = turn_template) -> DataFrame:
    """conv_id, formatted, spans (start and end of each turn's text), rewrites (number of turns that rewrote history)."""

    def run(batches):
        for conv, turns in _conversations(batches):
            r = Rendered(turns, template)
            yield record(_FORMATTED, [conv], [r.formatted], [r.spans], [len(r.rewrites)])

    return mapped(_by_conversation(rows), run, "conv_id long, formatted string, spans array<array<bigint>>, rewrites long")


def digests(rows: DataFrame, role: str = "assistant") -> DataFrame:
    """A row a conversation, read back from what turn_template made: the turns by parsing it, the loss by its spans."""

    def one(conv, turns):
        r = Rendered(turns)
        back = read_back(r.formatted)
        loss = "".join(unescape(x) for x in r.masked(back, role))
        all_turns = "".join(f"{a}\n{b}\n" for a, b in back)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return conv, len(back), sha(all_turns), len(loss), sha(loss), len(r.formatted), len(r.rewrites)

    def run(batches):
        held = []
        for conv, turns in _conversations(batches):
            held.append(one(conv, turns))
            if len(held) == 512:
                yield record(_DIGEST, *map(list, zip(*held, strict=True)))
                held = []
        if held:
            yield record(_DIGEST, *map(list, zip(*held, strict=True)))

    return mapped(_by_conversation(rows), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")
