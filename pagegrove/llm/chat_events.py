r"""Chat formatting by event-sourced reconstruction (operator 8).

A log of events ``(conv_id, msg, turn, seq, kind, role, text)`` is partitioned
by conversation, sorted by sequence and folded into final messages:

    start       opens a message with its role and first text
    delta       appends its text
    edit        replaces the message's whole text by its own
    regenerate  discards the text; what follows builds it anew
    delete      removes the message, unless a later event opens it again

Messages are folded first, each in its own group, then put in order of turn,
role and text within the conversation.  Rendering writes each turn as
``<s>[INST]role[/INST]text</s>``; control strings inside roles and texts are
escaped by a backslash after their first character, backslashes are doubled,
and a backslash before any character restores it.  The loss mask is a list of
code-point spans that cover each assistant text.

Null text and role count as empty.  A message has the role of its last
``start`` since it was last deleted; without one that of the first event since then
that has a role, else the last role it had.  A null conversation id is a conversation
like others.  Of turns with equal number all are kept.  An empty log gives no
rows; other columns are never read.  A conversation is one output row, so its
own size is the bound of a group.
"""

from __future__ import annotations

import hashlib
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The control strings of the template.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)
TRAINED = "assistant"
DELTA_CHARS = 48


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def events_of(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The log of a table of turns, with all kinds of events; folded, it gives the turns.

    Of four kinds of messages (by a hash of the row) one is streamed in deltas
    only, one is begun and then generated again, one is a draft that an edit
    replaces, and one is deleted under another role and opened anew."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("msg"))
    n = F.ceil(F.length("text") / delta_chars).cast("int")

    def event(kind, role=None, text=None):
        own = F.lit(None).cast("string") if role is None else role
        return F.struct(F.lit(kind).alias("kind"), own.alias("role"), (F.lit("") if text is None else text).alias("text"))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(places, lambda k: event("delta", text=F.substring("text", (k - 1) * delta_chars + 1, F.lit(delta_chars))))
    start, draft = F.array(event("start", F.col("role"))), F.slice(deltas, 1, 1)
    kind = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(4))
    log = (F.when(kind == 0, F.concat(start, deltas))
           .when(kind == 1, F.concat(start, draft, F.array(event("regenerate", text=F.lit("again"))), deltas))
           .when(kind == 2, F.concat(start, draft, F.array(event("edit", text=F.col("text")))))
           .otherwise(F.concat(F.array(event("start", F.lit("draft"))), draft, F.array(event("delete")), start, deltas)))
    return rows.select("conv_id", "msg", "turn", F.posexplode(log).alias("seq", "e")).select(
        "conv_id", "msg", "turn", F.col("seq").cast("long").alias("seq"), "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, role, text)``."""
    text = F.coalesce("text", F.lit(""))
    e = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", text.alias("text")))).alias("e"), F.min("turn").alias("turn"))
    at = lambda *kinds: F.coalesce(F.array_max(F.transform("e", lambda x, i: F.when(x["kind"].isin(*kinds), i))), F.lit(-1))
    e = e.select("conv_id", "turn", "e", at("start", "edit", "regenerate").alias("reset"), at("delete").alias("gone"), at("start", "edit", "regenerate", "delta").alias("made"))
    e = e.where(F.col("gone") <= F.col("made"))
    body = F.filter("e", lambda x, i: (i >= F.col("reset")) & (i > F.col("gone")) & (x["kind"] != "delete"))

    def roles(test, last: bool):
        """The first or last role of events that pass ``test``."""
        found = F.filter("e", lambda x, i: x["role"].isNotNull() & test(x, i))
        return F.try_element_at(F.transform(found, lambda x: x["role"]), F.lit(-1 if last else 1))
    here = lambda _x, i: i > F.col("gone")
    role = F.coalesce(roles(lambda x, i: here(x, i) & (x["kind"] == "start"), True), roles(here, False), roles(lambda _x, _i: F.lit(True), True), F.lit(""))
    return e.select("conv_id", "turn", role.alias("role"),
                    F.array_join(F.transform(body, lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"])), "").alias("text"))


def conversations(messages: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the messages of each conversation in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _render(batches):
    for b in batches:
        out = [render([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([f for f, _ in out], pa.string()),
                                          pa.array([[{"start": a, "stop": z} for a, z in s] for _, s in out], SPAN)], ["conv_id", "formatted", "loss"])


def format_events(events: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)`` for each conversation of the log; loss: spans ``[start, stop)`` in code points."""
    return conversations(fold(events)).mapInArrow(_render, "conv_id long, formatted string, loss array<struct<start:long,stop:long>>")


def _digests(batches):
    for b in batches:
        rows = []
        for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"]:s["stop"]]) for s in spans)
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                         ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations hold, read from their text and mask alone."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
