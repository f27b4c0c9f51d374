"""Chat formatting by incremental black-box rendering.

A template is any function from messages to one string. Successive turn prefixes are rendered and consecutive outputs
compared: what an output adds to the one before is its turn's span. Where an output does not begin with the one before,
the template has rewritten history; the turn is flagged, with the length up to which both agree. Where in its span a
turn's text lies is found by rendering the turn with two other texts and comparing the outputs from both ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

Messages = list[tuple[str, str]]
Template = Callable[[Messages], str]

_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>(?P<role>.*?)\[INST\] (?P<text>.*) \[/INST\]</s>\n", re.DOTALL)


def escape(text: str) -> str:
    """Puts one more backslash into whatever looks like a control string, so that `unescape` undoes it exactly."""
    if "<" not in text and "[" not in text:
        return text
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def turn_template(messages: Messages) -> str:
    """`<s>role[INST] text [/INST]</s>` and a line end for each turn; control strings inside are escaped."""
    return "".join(f"<s>{escape(role)}[INST] {escape(text)} [/INST]</s>\n" for role, text in messages)


def moving_system_template(messages: Messages) -> str:
    """A template that rewrites history: the system text stands in the last user turn only."""
    system = "\n".join(escape(t) for r, t in messages if r == "system")
    last = max((i for i, (r, _) in enumerate(messages) if r == "user"), default=-1)
    return "".join(f"<s>{escape(r)}[INST] {system if i == last else ''}{escape(t)} [/INST]</s>\n" for i, (r, t) in enumerate(messages) if r != "system")


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of one turn that `turn_template` has rendered."""
    m = _TURN.fullmatch(segment)
    if not m:
        raise ValueError("not a rendered turn")
    return unescape(m["role"]), unescape(m["text"])


def common(a: str, b: str) -> int:
    """Length of the longest prefix of both, by halving, since outputs are long."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Incremental:
    """Locates the turns of one conversation at a time. Whole prefixes are rendered, since a template may number its
    turns, depend on their count, or rewrite any of them.
    """

    def __init__(self, template: Template):
        self.template = template
        self.restart()

    def restart(self) -> None:
        self.messages: Messages = []
        self.before = self.template([])

    def add(self, role: str, text: str) -> tuple[str, int, int, bool, int]:
        """(span, text start in it, text end in it, history rewritten, characters that stay from before)."""
        before = self.before
        one, two, now = (self.template([*self.messages, (role, t)]) for t in ("qqqqq", "zzzz", text))
        head = common(one, two)
        tail = common(one[head:][::-1], two[head:][::-1])
        same = common(before, now)
        span = now[same:]
        self.messages.append((role, text))
        self.before = now
        lo = min(max(head - same, 0), len(span))
        return span, lo, max(lo, len(span) - tail), same < len(before), same


#: Turns that are rendered before a new one to see what it adds, and turns after which all are rendered for the first time.
WINDOW, FIRST_CHECK = 4, 8

#: Span, where the text starts and ends in it, whether history was rewritten, characters that stay from before.
Found = tuple[str, int, int, bool, int]


class Growing:
    """The same for templates whose outputs grow, in time that grows with the conversation: a turn is rendered after the
    last `WINDOW` ones only, and what they add up to is held against a full rendering after `FIRST_CHECK` turns, after
    twice as many, and so on, and at the end. Where they differ, or a turn changes the ones before it, all turns since the
    last agreement are done anew by whole prefixes, and so is the rest. Results come out once they have been checked.
    """

    def __init__(self, template: Template):
        self.template, self.whole = template, Incremental(template)
        self.restart()

    def restart(self) -> None:
        self.messages: Messages = []
        self.parts = [self.template([])]
        self.length, self.checked, self.next = len(self.parts[0]), 0, FIRST_CHECK
        self.waiting: list[tuple[object, Found]] = []
        self.grows = True

    def add(self, role: str, text: str, name: object) -> list[tuple[object, Found]]:
        """Takes a turn; gives (name, found) of turns that are certain now."""
        if not self.grows:
            return [(name, self.whole.add(role, text))]
        window = self.messages[-WINDOW:]
        before = self.template(window)
        one, two, now = (self.template([*window, (role, t)]) for t in ("qqqqq", "zzzz", text))
        same = common(before, now)
        head = common(one, two)
        tail = common(one[head:][::-1], two[head:][::-1])
        span = now[same:]
        lo = min(max(head - same, 0), len(span))
        self.messages.append((role, text))
        self.waiting.append((name, (span, lo, max(lo, len(span) - tail), False, self.length)))
        if same < len(before):
            return self._anew()
        self.parts.append(span)
        self.length += len(span)
        return self.check() if len(self.messages) == self.next else []

    def check(self) -> list[tuple[object, Found]]:
        """Renders all turns, at the end of a conversation, too."""
        if not self.waiting:
            return []
        whole = self.template(self.messages)
        if whole != "".join(self.parts):
            return self._anew()
        done, self.waiting, self.parts, self.checked, self.next = self.waiting, [], [whole], len(self.messages), 2 * len(self.messages)
        return done

    def _anew(self) -> list[tuple[object, Found]]:
        self.grows = False
        self.whole.messages = self.messages[: self.checked]
        self.whole.before = self.template(self.whole.messages)
        turns, names, self.waiting = self.messages[self.checked :], [n for n, _ in self.waiting], []
        return [(n, self.whole.add(role, text)) for n, (role, text) in zip(names, turns, strict=True)]


class _Every(Incremental):
    """`Incremental` in the same form."""

    def add(self, role: str, text: str, name: object) -> list[tuple[object, Found]]:
        return [(name, super().add(role, text))]

    def check(self) -> list[tuple[object, Found]]:
        return []


def format_turns(conversations: DataFrame, template: Template = turn_template, learn: tuple[str, ...] = ("assistant",), every_prefix: bool = False) -> DataFrame:
    """One row a turn, in order within its conversation: conv_id, turn, role, span, span_start, text_start, text_end
    (code points in the formatted conversation), in_loss, rewrites.

    Rows are dealt by conversation and sorted by turn, then role and text (repeated turns stay), and pass as a stream; a
    worker holds one conversation. Where a template's output only grows, time grows with the conversation (`Growing`); a
    template that rewrites history is found when a turn changes one of the last few, or where whole renderings at doubling
    numbers of turns and at the end differ. One that rewrites and restores all in between is found with `every_prefix`
    only, which renders each whole prefix. Null text and null role count as empty; rows with a null conv_id are one
    conversation. An empty table gives no rows. Other columns are not read.
    """
    kinds = dict(conversations.dtypes)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "turn", "role", "span", "span_start", "text_start", "text_end", "in_loss", "rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, ready, types = (_Every if every_prefix else Growing)(template), object(), [], None

        def packed(found: list[tuple[object, Found]]) -> pa.RecordBatch:
            out = [(*name, span, start, start + a, start + b, name[2] in learn, rewritten) for name, (span, a, b, rewritten, start) in found]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            types = (batch.schema.field("conv_id").type, batch.schema.field("turn").type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if conv != current:
                    ready += state.check()
                    state.restart()
                    current = conv
                ready += state.add(role, text, (conv, turn, role))
                while len(ready) >= 1024:
                    yield packed(ready[:1024])
                    ready = ready[1024:]
        ready += state.check()
        for lo in range(0, len(ready), 1024):
            yield packed(ready[lo : lo + 1024])

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, span string, span_start bigint, text_start bigint, text_end bigint, in_loss boolean, rewrites boolean")


def read_back(turns: DataFrame) -> DataFrame:
    """One row a conversation, from what `format_turns` gives with `turn_template`: counts, and digests of the texts
    read out of the spans. The rows must come as that function leaves them; they are not dealt again. Without rows there
    is none.
    """
    kind = dict(turns.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, any_rows = None, False
        n = loss = chars = 0
        rewrites = False
        digest, learnt = hashlib.sha256(), hashlib.sha256()
        id_type = None

        def rows_of(done: list[tuple]) -> pa.RecordBatch:
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            done = []
            for conv, span, start, a, b, in_loss, rewritten in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "span", "span_start", "text_start", "text_end", "in_loss", "rewrites")), strict=True):
                if not any_rows or conv != current:
                    if any_rows:
                        done.append((current, n, digest.hexdigest(), loss, learnt.hexdigest(), chars, rewrites))
                    current, any_rows, n, loss, chars, rewrites = conv, True, 0, 0, 0, False
                    digest, learnt = hashlib.sha256(), hashlib.sha256()
                role, text = read_turn(span)
                digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if in_loss:
                    masked = unescape(span[a - start : b - start])
                    loss += len(masked)
                    learnt.update(masked.encode("utf-8", "surrogatepass"))
                n += 1
                chars = start + len(span)
                rewrites |= rewritten
            if done:
                yield rows_of(done)
        if any_rows:
            yield rows_of([(current, n, digest.hexdigest(), loss, learnt.hexdigest(), chars, rewrites)])

    return turns.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites boolean")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations, and one that holds control strings, and reads them back."""
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    kinds = dict(table.dtypes)
    odd = odd.select(*[F.col(c).cast(kinds[c]).alias(c) for c in table.columns])
    return read_back(format_turns(table.unionByName(odd)))
