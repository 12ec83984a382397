"""Chat formatting (operator 6): layouts told apart by schema fingerprints, turned into canonical turns and a template.

A *fingerprint* is a hash of those of a record's nested field paths (lists as ``[]``) that some layout uses; further fields
don't change it. It selects a declarative mapping, so that prompt, instruction and message layouts need no code of their
own. Canonical turns are rows (conv_id, turn, role, text).

The template writes a turn as ``<|turn|>role<|text|>text<|end|>`` and a newline. In roles and texts every backslash is doubled and
every control string (this template's and common ones of others) gets a backslash after its first character; parse()
undoes both. The loss mask covers the text of assistant turns.

Formatting is a narrow map over turns. The digests of a conversation are folded while its turns stream by in order of
(turn, role, text), so its length is bounded by nothing. A null text or role is empty. Turns of a null conv_id are
one conversation. Repeated rows are repeated turns. A JSON record that is null, damaged, of an unknown layout or without turns
gives one row with a null turn and its fingerprint, so nothing is lost silently. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import lean, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PIECE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)

#: (name, field paths, mapping). "turns": (role, path) pairs, empty texts left out if optional; "each": a list of messages
#: with its fields for role and text; "rows": the input has a row for each turn.
_PAIRS = (("prompt", "completion"), ("prompt", "response"), ("question", "answer"), ("instruction", "output"), ("instruction", "response"))
_LISTS = (("messages", "role", "content"), ("data.messages", "role", "content"), ("conversation", "role", "content"), ("conversations", "from", "value"))
_SYSTEM = ("system", "system")


def _layouts() -> Iterator[tuple[str, tuple[str, ...], dict]]:
    yield "rows", ("role", "text", "turn"), {"rows": ("turn", "role", "text")}
    for system in ((), ("system",)):
        lead = (_SYSTEM,) if system else ()
        for ask, reply in _PAIRS:
            for more in ((), ("input",)):
                yield f"{ask} and {reply}", (ask, reply, *more, *system), {"turns": (*lead, ("user", ask, *more), ("assistant", reply))}
        for where, role, text in _LISTS:
            # a list without messages is a leaf
            for paths in ((f"{where}[].{role}", f"{where}[].{text}"), (where,)):
                yield where, (*paths, *system), {"turns": lead, "each": (where, role, text)}


LAYOUTS = tuple(_layouts())
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(set(paths))).encode(), digest_size=8).hexdigest()


MAPPINGS = {fingerprint(paths): (name, mapping) for name, paths, mapping in LAYOUTS}
#: The paths that records, and tables with a row for each turn, are told apart by.
RECORD_PATHS = {p for _, paths, mapping in LAYOUTS if "rows" not in mapping for p in paths}
ROW_PATHS = {p for _, paths, mapping in LAYOUTS if "rows" in mapping for p in paths}


def paths_of(value, at: str = "") -> Iterator[str]:
    """The nested field paths of a JSON value; an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from paths_of(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list) and value:
        for v in value:
            yield from paths_of(v, at + "[]")
    else:
        yield at


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """The nested field paths of a DataFrame's schema."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, at + "[]")
    else:
        yield at


def _at(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(x) -> str:
    return x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)


def turns_of(value) -> tuple[str, list[tuple[str, str]] | None]:
    """(fingerprint, canonical turns) of a JSON record; None if its layout is unknown."""
    mark = fingerprint(RECORD_PATHS.intersection(paths_of(value)))
    _, mapping = MAPPINGS.get(mark, ("", None))
    if mapping is None:
        return mark, None
    out = []
    for role, *sources in mapping.get("turns", ()):
        text = "\n".join(x for x in (_text(_at(value, s)) for s in sources) if x)
        if text or role != "system":
            out.append((role, text))
    if "each" in mapping:
        where, role, text = mapping["each"]
        # a message may lack a field, or be no object at all: then it is one text without a role
        messages = [m if isinstance(m, dict) else {text: m} for m in _at(value, where) or ()]
        out += [(ROLES.get(_text(m.get(role)), _text(m.get(role))), _text(m.get(text))) for m in messages]
    return mark, out or None


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, layout) from records(conv_id, record), each a JSON text in any of LAYOUTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, raw in zip(b["conv_id"].to_pylist(), b["record"].to_pylist(), strict=True):
                try:
                    mark, turns = turns_of(json.loads(raw)) if raw is not None else ("null", None)
                except ValueError:
                    mark, turns = "damaged", None
                rows += [(conv, None, None, None, mark)] if turns is None else [(conv, i, r, t, mark) for i, (r, t) in enumerate(turns)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("record").cast("string").alias("record")).mapInArrow(lean(run), "conv_id long, turn long, role string, text string, layout string")


def canonical_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table that has a row for each turn; its layout is found by fingerprint."""
    have = set(schema_paths(df.schema))
    _, mapping = MAPPINGS.get(fingerprint(have & ROW_PATHS), ("", {}))
    if "rows" not in mapping or "conv_id" not in have:
        raise ValueError(f"unknown layout: {sorted(have)}")
    turn, role, text = mapping["rows"]
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def piece(role: str, text: str) -> str:
    """A formatted turn."""
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    out, at = [], 0
    for m in _PIECE.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


PIECE = "conv_id long, turn long, role string, text string, formatted string, loss_from int, loss_to int"


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn with its formatted piece, and the part of it under the loss mask (code points; null: none). A conversation is the concatenation of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = b["role"].to_pylist(), b["text"].to_pylist()
            made = [piece(r, t) for r, t in zip(roles, texts, strict=True)]
            start = [len(TURN) + len(escape(r)) + len(TEXT) if r == "assistant" else None for r in roles]
            stop = [None if s is None else len(m) - len(END) - 1 for s, m in zip(start, made, strict=True)]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], b["role"], b["text"], pa.array(made, pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=[x.split()[0] for x in PIECE.split(", ")])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(lean(run), PIECE)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted pieces."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def done():
            out.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def pack():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

        for b in batches:
            for conv, text, lo, hi in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), b["loss_from"].to_pylist(), b["loss_to"].to_pylist(), strict=True):
                if now != (conv,):
                    if now is not None:
                        done()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if lo is not None:
                    masked = unescape(text[lo:hi])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if len(out) > 5000:
                yield pack()
                out.clear()
        if now is not None:
            done()
            yield pack()

    return pieces.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(lean(run), DIGEST)


#: A conversation that quotes control strings, formatted with every run of the query.
QUOTING = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = canonical_rows(table(spark, sf_dir, "conversations")).unionByName(spark.sql(QUOTING))
    return digests(format_turns(turns))


ORACLE_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, chr(92), chr(92) || chr(92)),
        '(<)(\\|turn\\|>|\\|text\\|>|\\|end\\|>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|<SYS>>|</SYS>>)', '\\1' || chr(92) || chr(92) || '\\2', 'g'),
        '(\\[)(INST\\]|/INST\\])', '\\1' || chr(92) || chr(92) || '\\2', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(esc) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
