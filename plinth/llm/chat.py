r"""Chat formatting by incremental black-box rendering.

A template is a function from messages to text and nothing else is known of it.
Successive prefixes of a conversation are rendered and consecutive outputs compared:
where the earlier output is a prefix of the later one, the rest is the span of the new
turn; where it is not, the template has rewritten history, which is counted and
reported, and the span starts where the outputs part.

A template may state how many earlier messages a turn's rendering looks back at
(``lookback``).  Then a turn's span comes from that many messages and is proven by
prefixes: in each of the first CHECKED turns, whenever the number of turns is a power
of two, and at the end, all messages so far are rendered and must be the spans put
together; so each span is compared with a prefix that holds it, at twice the cost of
one rendering.  What is rendered at once is bounded: after STRETCH characters the
check is made and the next prefix begins with the ``lookback`` messages before the
turn.  A difference is an error.  Without ``lookback`` the prefix of every turn is
rendered, at a cost that grows with the square of the turns.

Rows are dealt by conversation and sorted by turn; digests are updated turn by turn,
so no conversation is ever held as a whole (a digest of ordered text is sequential:
one task goes through one conversation).

Defined cases: null texts and roles count as empty; rows with the same turn come in the
order of role and text; null turns come first; rows without a conv_id form one
conversation without id; an empty table gives an empty result; other columns play no
part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

Message = tuple[str, str]
#: Strings with a meaning in templates; inside texts and roles they are escaped.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]")
#: First turns after each of which the spans are compared with the whole prefix.
CHECKED = 8
#: Characters of a prefix that is rendered at once, about.
STRETCH = 1 << 24
#: The contract's extra conversation.
EXTRA_ID = -7
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    """A backslash is doubled, and put behind the first character of each control string."""
    text = text.replace("\\", "\\\\")
    for mark in CONTROL:
        text = text.replace(mark, mark[0] + "\\" + mark[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass(frozen=True)
class Template:
    """``render`` makes the text of messages (role, text); ``read`` finds role, text begin and text end (escaped) in a turn's span."""

    render: Callable[[list[Message]], str]
    read: Callable[[str], tuple[str, int, int]]
    lookback: int | None = None


def _render_turns(messages: list[Message]) -> str:
    return "".join(f"<|{escape(role)}|>\n{escape(text)}</s>\n" for role, text in messages)


def _read_turn(span: str) -> tuple[str, int, int]:
    head = span.index("|>")
    begin = head + 3
    return unescape(span[2:head]), begin, span.index("</s>", begin)


TURNS = Template(_render_turns, _read_turn, lookback=1)


@dataclass
class Spans:
    """Spans of a conversation's turns, found as its messages come in; :meth:`finish` after the last."""

    template: Template
    before: list[Message]
    turn: int = 0
    rewrites: int = 0

    def __post_init__(self) -> None:
        self._start(len(self.before))

    def add(self, message: Message) -> str:
        """The span of the next turn."""
        back = self.template.lookback
        span, kept = self._between(self.before if back is None else self.before[max(0, len(self.before) - back) :], message)
        self.rewrites += not kept
        self.before.append(message)
        self.turn += 1
        if back is None:
            return span
        self.spans.append(span)
        self.chars += len(span)
        n = len(self.spans)
        full = self.chars >= STRETCH
        if full or n <= CHECKED or n & (n - 1) == 0:
            self.finish()
        if full:
            del self.before[: max(0, len(self.before) - back)]
            self._start(len(self.before))
        return span

    def _start(self, context: int) -> None:
        """Begin a prefix; its first ``context`` messages are of former turns."""
        self.context, self.spans, self.chars = context, [], 0

    def finish(self) -> None:
        """Compare the spans since the prefix began with the prefix as the template renders it."""
        if self.template.lookback is None or not self.spans:
            return
        head = self.template.render(self.before[: self.context]) if self.context else ""
        if self.template.render(self.before) != head + "".join(self.spans):
            raise ValueError("the template looks back further than it states")

    def _between(self, earlier: list[Message], message: Message) -> tuple[str, bool]:
        a = self.template.render(earlier) if earlier else ""
        b = self.template.render([*earlier, message])
        if b.startswith(a):
            return b[len(a) :], True
        return b[len(os.path.commonprefix([a, b])) :], False


@dataclass
class Digest:
    """What is read back of a conversation, turn by turn."""

    conv_id: int | None
    spans: Spans

    def __post_init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        """Add a message; returns its span and the begin and end of its loss mask in it (0, 0: none)."""
        span = self.spans.add((role, text))
        read_role, begin, end = self.spans.template.read(span)
        read_text = unescape(span[begin:end])
        self.turns.update(f"{read_role}\n{read_text}\n".encode("utf-8", "surrogatepass"))
        self.n_turns += 1
        self.formatted_chars += len(span)
        if read_role != "assistant":
            return span, 0, 0
        self.loss.update(read_text.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(read_text)
        return span, begin, end

    def row(self) -> tuple:
        self.spans.finish()
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.spans.rewrites


def _sorted(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


DIGEST_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, history_rewrites bigint"
TURN_SCHEMA = "conv_id bigint, turn bigint, position bigint, role string, span string, loss_begin bigint, loss_end bigint"


def conversation_digests(conversations: DataFrame, template: Template = TURNS) -> DataFrame:
    """One row for each conversation: what is read back from its formatted text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
        kinds = [pa.string() if "string" in x else pa.int64() for x in DIGEST_SCHEMA.split(", ")]
        now: Digest | None = None
        for batch in batches:
            done = []
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(conv_id, Spans(template, []))
                now.add(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(now.row(), kinds, strict=True)], names=names)

    return _sorted(conversations).mapInArrow(make, DIGEST_SCHEMA)


def format_turns(conversations: DataFrame, template: Template = TURNS) -> DataFrame:
    """One row for each turn: its span of the formatted text, and where the loss mask lies in the span (both null: nowhere)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Digest | None = None
        for batch in batches:
            out: list[tuple] = []
            for conv_id, turn, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        now.spans.finish()
                    now = Digest(conv_id, Spans(template, []))
                span, begin, end = now.add(role, text)
                out.append((conv_id, turn, now.n_turns - 1, role, span, begin if role == "assistant" else None, end if role == "assistant" else None))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (3, 4) else pa.int64()) for i, c in enumerate(cols)], names=["conv_id", "turn", "position", "role", "span", "loss_begin", "loss_end"])
        if now is not None:
            now.spans.finish()

    return _sorted(conversations).mapInArrow(make, TURN_SCHEMA)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    Scratch(spark, "chat")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return conversation_digests(rows.unionByName(extra))


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + 10) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS history_rewrites
FROM c GROUP BY conv_id
"""
