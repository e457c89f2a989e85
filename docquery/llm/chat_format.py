r"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows are dealt by conversation and sorted by turn inside each partition; a task then streams them, so a
conversation of any length needs the memory of a turn. Each turn becomes segments with a loss flag: the opening
mark, the escaped text, the closing mark. Inside texts, the escape character goes before itself and before every
control string, so marks and texts can be told apart and read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: marks: opening mark and loss flag of each role. other: mark, end of the role's name and loss flag of any other role.
#: close: closing mark. order: roles allowed after each role; "" is the start.
TEMPLATE = {
    "escape": "\\",
    "control": ["### ", "</turn>"],
    "marks": {"system": ("### System: ", False), "user": ("### User: ", False), "assistant": ("### Assistant: ", True)},
    "other": ("### Role ", ": ", False),
    "close": "</turn>\n",
    "order": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
}
SEGMENTS = "conv_id string, position bigint, segments array<struct<text:string,loss:boolean>>, allowed boolean"


class Codec:
    """Writes and reads turns by a template."""

    def __init__(self, template: dict):
        self.t = template
        self.e = template["escape"]
        some = "|".join(map(re.escape, [self.e, *template["control"]]))
        self.find = re.compile(some)
        self.find_in_name = re.compile(some + "|" + re.escape(template["other"][1]))
        self.undo = re.compile(re.escape(self.e) + "(.)", re.S)
        text = rf"((?:{re.escape(self.e)}.|(?!{re.escape(self.e)}).)*?)"
        self.other = re.compile(re.escape(template["other"][0]) + text + re.escape(template["other"][1]), re.S)
        self.body = re.compile(text + re.escape(template["close"]), re.S)
        self.opened = {mark: role for role, (mark, _) in template["marks"].items()}
        self.opening = re.compile("|".join(map(re.escape, self.opened)))

    def write(self, role: str, text: str) -> list[tuple[str, bool]]:
        put = lambda m: self.e + m[0]
        if role in self.t["marks"]:
            mark, loss = self.t["marks"][role]
        else:
            start, end, loss = self.t["other"]
            mark = start + self.find_in_name.sub(put, role) + end
        return [(mark, False), (self.find.sub(put, text), loss), (self.t["close"], False)]

    def unescape(self, text: str) -> str:
        return self.undo.sub(r"\1", text)

    def read(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        if m := self.opening.match(formatted):
            role = self.opened[m[0]]
        elif m := self.other.match(formatted):
            role = self.unescape(m[1])
        else:
            raise ValueError("no opening mark")
        body = self.body.fullmatch(formatted, m.end())
        if not body:
            raise ValueError("no closing mark")
        return role, self.unescape(body[1])


def format_conversations(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id (as text), position, segments, allowed: a row for each row of rows (conv_id, turn, role, text; others are ignored).

    Partitions hold whole conversations, sorted by conv_id and position (from 0). ``allowed`` is the state
    machine's verdict on the turn; turns out of order are formatted all the same. Null texts and roles count as empty, a null
    conv_id is a conversation of its own, null turns come first; equal turns are ordered by role, then text.
    No rows give no rows.
    """
    own = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, at, position, state = Codec(template), object(), 0, ""
        for batch in batches:
            out = []
            for conv, role, text in zip(batch.conv_id, batch.role, batch.text, strict=True):
                if conv != at:
                    at, position, state = conv, 0, ""
                allowed = role in template["order"].get(state, [])
                out.append((conv, position, [{"text": t, "loss": loss} for t, loss in codec.write(role, text)], allowed))
                position, state = position + 1, role
            yield pd.DataFrame(out, columns=["conv_id", "position", "segments", "allowed"])

    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, SEGMENTS)


def read_back(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Digests of each conversation, parsed from what format_conversations returned, in its order and partitions.

    n_turns; turns_sha256 of role, newline, text, newline for each turn; loss_chars and loss_sha256 of the
    unescaped text under the loss mask; formatted_chars; ordered: every turn was allowed.
    """
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "ordered"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, at, now, done = Codec(template), object(), None, []

        def frame() -> pd.DataFrame:
            rows = [(c, n, a.hexdigest(), k, b.hexdigest(), f, ok) for c, n, a, k, b, f, ok in done]
            done.clear()
            return pd.DataFrame(rows, columns=columns)

        for batch in batches:
            for conv, position, parts, allowed in zip(batch.conv_id, batch.position, batch.segments, batch.allowed, strict=True):
                if position == 0 or conv != at:
                    if now:
                        done.append(now)
                    at, now = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                formatted = "".join(p["text"] for p in parts)
                role, text = codec.read(formatted)
                lost = "".join(codec.unescape(p["text"]) for p in parts if p["loss"])
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now[3] += len(lost)
                now[4].update(lost.encode("utf-8", "surrogatepass"))
                now[5] += len(formatted)
                now[6] &= bool(allowed)
            yield frame()
        if now:
            done.append(now)
            yield frame()

    return segments.mapInPandas(run, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, ordered boolean")


def op8_query(spark, sf_dir: str) -> DataFrame:
    """All conversations and a made one, -7, whose texts look like marks."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    made = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_conversations(rows.unionByName(made))).withColumn("conv_id", F.col("conv_id").cast("bigint"))


ORACLE = r"""
with c as (select conv_id, turn, role, coalesce(text, '') t from conversations union all
    select -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
o as (select *, lag(role) over (partition by conv_id order by turn) before from c)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn)) turns_sha256,
    coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(t, '' order by turn) filter (role = 'assistant'), '')) loss_sha256,
    sum(length('### : </turn>') + 1 + length(role) + length(replace(replace(replace(t, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>')))::bigint formatted_chars,
    bool_and(case when before is null then role in ('system', 'user') when before in ('system', 'assistant') then role = 'user' else role = 'assistant' end) ordered
from o group by conv_id"""
