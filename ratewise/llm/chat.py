"""Chat formatting with any template, and the span of every turn in its output.

The template is a black box: a function from a list of (role, text) to a
string. Each conversation is rendered for its successive prefixes of turns.
Where an output only appends to the one before, the appended part is the turn's
span; the text's place in it is found by rendering the turn once more with a
probe as its text: what stands before and after the probe must stand before and after
the text, else the turn has no text span (null: a template that shows a text twice, or
changed). Where an output does not begin with the one before, the template rewrites
history: ``rewritten_at`` holds the first turn that does so, and the conversation has
no spans (no text of it is under the loss mask).

``instruction_template`` marks turns with control strings and puts a backslash
into any that occur in texts and roles, reversibly: ``[INST]`` becomes
``[\\INST]``, ``[\\INST]`` becomes ``[\\\\INST]``; in a role's name, backslashes, ``]`` and line
ends are escaped first. ``parse_instructions`` reads every turn, its role and its text
back out of the string alone.

Turns are in order of ``turn`` (null first), ties by role, then text. Null roles
and texts count as empty. Rows with a null conversation id form one
conversation. Extra columns are ignored; an empty table gives an empty result.
A conversation is one task's work and one output row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import ship_package

Template = Callable[[list[tuple[str, str]]], str]

_ADD = re.compile(r"([<\[])(\\*)(?=/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE)")
_REMOVE = re.compile(r"([<\[])\\(\\*)(?=/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE)")
PROBE = "probe"


def escape(text: str) -> str:
    return _ADD.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _REMOVE.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("]", "\\]").replace("\n", "\\n"))


def unescape_role(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))


def instruction_template(turns: list[tuple[str, str]]) -> str:
    """[INST] user [/INST] assistant </s>; a system block; other roles by name."""
    out = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body} </s>")
        elif role == "system":
            out.append(f"<<SYS>>\n{body}\n<</SYS>>\n\n")
        else:
            out.append(f"[ROLE {escape_role(role)}]\n{body}\n[/ROLE]\n")
    return "".join(out)


_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n"
                   r"|\[ROLE (?P<name>(?:[^\\\]]|\\.)*)\]\n(?P<other>.*?)\n\[/ROLE\]\n", re.S)


def parse_instructions(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that ``instruction_template`` wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = "other" if m["name"] is not None else m.lastgroup
        out.append((unescape_role(m["name"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return out


def spans(turns: list[tuple[str, str]], template: Template) -> tuple[str, list[tuple[int, int, int | None, int | None]], int | None]:
    """The rendered conversation; per turn the start and end of its span and of
    its text; and the first turn whose rendering changed what stood before it."""
    before, found = template([]), []
    for k in range(len(turns)):
        now = template(turns[:k + 1])
        if not now.startswith(before):
            return template(turns), [], k
        role, text = turns[k]
        probe = PROBE
        while probe in now:                         # the probe must be new to the output
            probe += PROBE
        probed = template([*turns[:k], (role, probe)])
        at = probed.find(probe)
        end = len(now) - (len(probed) - at - len(probe))
        if at < len(before) or end < at or probed[:at] != now[:at] or probed[at + len(probe):] != now[end:]:
            at = end = None
        found.append((len(before), len(now), at, end))
        before = now
    return before, found, None


SCHEMA = ("conv_id long, n_turns long, formatted string, rewritten_at long, "
          "spans array<struct<role: string, start: int, end: int, text_start: int, text_end: int>>")


def format_conversations(df: DataFrame, template: Template = instruction_template, conv: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: the formatted string and its turns' spans, in
    code points; ``rewritten_at`` is null for a template that only appends."""
    ship_package(df.sparkSession)
    rows = (df.select(F.col(conv).cast("long").alias("conv_id"),
                      F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))

    def run(batches):
        for batch in batches:
            out = []
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                said = [(t["role"] or "", t["text"] or "") for t in turns]
                formatted, found, rewritten = template_spans(said)
                out.append({"conv_id": conv_id, "n_turns": len(said), "formatted": formatted, "rewritten_at": rewritten,
                            "spans": [dict(zip(("role", "start", "end", "text_start", "text_end"), (r, *s)))
                                      for (r, _), s in zip(said, found)]})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow)
    _arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("rewritten_at", pa.int64()),
                        ("spans", pa.list_(pa.struct([("role", pa.string()), *[(c, pa.int32()) for c in ("start", "end", "text_start", "text_end")]])))])
    template_spans = lambda said: spans(said, template)
    return rows.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame, parse: Callable[[str], list[tuple[str, str]]] = parse_instructions,
              trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """What the string itself says: the number of its turns, the digest of all turns,
    and the text under the loss mask (that of the roles that are trained on)."""
    ship_package(formatted.sparkSession)

    @F.arrow_udf("struct<n_turns: bigint, turns_sha256: string, loss_chars: bigint, loss_sha256: string>")
    def run(text: pa.Array) -> pa.Array:
        rows = []
        for whole in text:
            turns = parse(whole.as_py())
            loss = "".join(said for role, said in turns if role in trained)
            rows.append((len(turns), hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest(),
                         len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        kinds = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
    return (formatted.drop("n_turns").withColumn("_r", run("formatted"))
            .withColumn("formatted_chars", F.length("formatted").cast("long"))
            .select("*", "_r.*").drop("_r"))
