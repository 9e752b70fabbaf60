"""Chat formatting by schema fingerprints.

A record is a JSON object. The nested paths of its leaves (``messages[].role``; paths that
no layout names don't count) are sorted and hashed; the hash selects the declarative
``Layout`` that says where its turns, their roles and their texts stand. So records of many
layouts (one row a turn, message lists, prompt and completion, instruction, input and
output ...) become the same canonical turns, a pair of role and text each.

Template: ``### ROLE: TEXT</turn>`` and a line feed per turn. A backslash goes before each
backslash, before a number sign that two more follow and before the ``<`` of ``</turn>`` in
roles and texts (in roles before a colon, too), so marks stand only where the template
puts them, and dropping these backslashes gives the exact text. The loss mask is a list of
character ranges of the output: the texts of assistant turns, marks left out.

Records are dealt by ranges of (conversation, order, record), so a conversation of any size
spreads over tasks; each task formats its stretch into output rows of about
``PIECE_CHARS`` characters. A conversation is one row (``whole``), unless it is longer than
that or crosses the border of two ranges; then its rows are in order of (part, piece).

Reading back parses the rows of the output. Rows of whole conversations are read where they
stand, the others are streamed in order, row by row, through one running digest (a digest of
a text is sequential, whoever computes it; nothing is gathered).

Odd cases: null texts and roles are empty, numbers and booleans their JSON; a record that
is null, not a JSON object or of a fingerprint no layout has gives no turn (its
conversation stays, with fewer turns or none); records of equal order go by their JSON;
a null order comes last; a null conversation id is a conversation of its own; repeated rows
are turns each; half surrogates become U+FFFD; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import read_columns, staged

PIECE_CHARS = 1 << 20
OUTPUT = "part int, piece int, whole boolean, text string, loss array<struct<start: long, end: long>>"


# --- layouts ---------------------------------------------------------------------

class Turn(NamedTuple):
    """One turn: a role (fixed, or read at ``role_at``) and the texts of paths, joined."""
    texts: tuple[str, ...]
    role: str | None = None
    role_at: str | None = None
    join: str = "\n\n"


class Layout(NamedTuple):
    """Turns of a record, or of each element of the list at ``each``. A turn whose paths are
    all optional and absent is left out."""
    name: str
    turns: tuple[Turn, ...]
    each: str | None = None
    optional: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()

    def paths(self) -> set[str]:
        at = f"{self.each}[]." if self.each else ""
        return {at + p for t in self.turns for p in (*t.texts, t.role_at) if p} | set(self.optional)


def _asked(question: str, answer: str) -> tuple[Turn, ...]:
    return (Turn(("system",), "system"), Turn((question,), "user"), Turn((answer,), "assistant"))


LAYOUTS = (
    Layout("turn", (Turn(("text",), role_at="role"),)),
    Layout("messages", (Turn(("content",), role_at="role"),), each="messages"),
    Layout("message parts", (Turn(("content[].text",), role_at="role", join=""),), each="messages",
           optional=("messages[].content[].type",)),
    Layout("from and value", (Turn(("value",), role_at="from"),), each="conversations",
           aliases=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt and completion", _asked("prompt", "completion"), optional=("system",)),
    Layout("prompt and response", _asked("prompt", "response"), optional=("system",)),
    Layout("question and answer", _asked("question", "answer"), optional=("system",)),
    Layout("instruction", (Turn(("system",), "system"), Turn(("instruction", "input"), "user"),
                           Turn(("output",), "assistant")), optional=("system", "input")),
)


def leaf_paths(node, at: str = "") -> Iterator[str]:
    """Paths of all leaves: ``a.b`` for objects in objects, ``a[]`` for elements of a list."""
    if isinstance(node, dict):
        for k, v in node.items():
            yield from leaf_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(node, list):
        for v in node:
            yield from leaf_paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "replace")).hexdigest()[:16]


def layout_table(layouts=LAYOUTS) -> tuple[dict[str, Layout], set[str]]:
    """Fingerprint -> layout, with and without each optional path; and all their paths."""
    table: dict[str, Layout] = {}
    for layout in layouts:
        needed = layout.paths() - set(layout.optional)
        for n in range(len(layout.optional) + 1):
            for extra in combinations(layout.optional, n):
                key = fingerprint(needed | set(extra))
                if table.setdefault(key, layout) is not layout:
                    raise ValueError(f"{layout.name} and {table[key].name} have equal paths")
    return table, {p for layout in layouts for p in layout.paths()}


def leaves(node, path: str) -> list:
    """The leaves at a path below a node."""
    if not path:
        return [node]
    head, _, rest = path.partition(".")
    listed, head = head.endswith("[]"), head.removesuffix("[]")
    if not isinstance(node, dict) or head not in node:
        return []
    below = node[head]
    if not listed:
        return leaves(below, rest)
    return [x for v in below for x in leaves(v, rest)] if isinstance(below, list) else []


HALF = re.compile("[\ud800-\udfff]")


def as_text(value) -> str:
    if value is None:
        return ""
    return HALF.sub("\ufffd", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def canonical(record: str | None, table: dict[str, Layout], known: set[str]) -> list[tuple[str, str]]:
    """The turns (role, text) of a record."""
    try:
        node = json.loads(record) if record is not None else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(node, dict):
        return []
    layout = table.get(fingerprint(p for p in leaf_paths(node) if p in known))
    if layout is None:
        return []
    elements = node[layout.each] if layout.each else [node]
    alias, turns = dict(layout.aliases), []
    for e in elements:
        for t in layout.turns if isinstance(e, dict) else ():
            texts = [x for p in t.texts for x in leaves(e, p)]
            if not texts and not layout.each:
                continue
            role = t.role if t.role_at is None else as_text((leaves(e, t.role_at) or [None])[0])
            body = [as_text(x) for x in texts]
            turns.append((alias.get(role, role), t.join.join(b for b in body if b or len(body) == 1)))
    return turns


# --- template ----------------------------------------------------------------------

IN_TEXT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
IN_ROLE = re.compile(r"[\\:]|#(?=##)|<(?=/turn>)")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escaped(text: str, special: re.Pattern = IN_TEXT) -> str:
    return special.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text starts and ends in it."""
    head, body = f"### {escaped(role, IN_ROLE)}: ", escaped(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; an error if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


# --- as Spark jobs -------------------------------------------------------------------

def format_chats(records: DataFrame, key: str, order: str, record: str, layouts=LAYOUTS,
                 loss_roles: tuple[str, ...] = ("assistant",), piece_chars: int = PIECE_CHARS) -> DataFrame:
    """The formatted conversations: (key, part, piece, whole, text, loss); loss holds
    character ranges of the row's own text. One shuffle."""
    table, known = layout_table(layouts)
    kind = records.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        key_type = None

        def rows():
            nonlocal key_type
            now, text, loss, size, piece, many, first = None, [], [], 0, 0, False, True
            started = False

            def flush(whole):
                return now, part, piece, whole, "".join(text), loss

            for batch in batches:
                key_type = batch.schema.field(0).type
                for k, rec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if started and k != now:
                        # the first conversation may have begun in the range before
                        yield flush(not first and not many)
                        text, loss, size, piece, many, first = [], [], 0, 0, False, False
                    started, now = True, k
                    for role, said in canonical(rec, table, known):
                        if size >= piece_chars:
                            yield flush(False)
                            text, loss, size, piece, many = [], [], 0, piece + 1, True
                        turn, a, b = format_turn(role, said)
                        if role in loss_roles:
                            loss.append({"start": size + a, "end": size + b})
                        text.append(turn)
                        size += len(turn)
            if started:
                yield flush(False)  # the last one may go on in the next range

        held, chars = [], 0

        def batch_of(held):
            cols = list(zip(*held))
            types = [key_type, pa.int32(), pa.int32(), pa.bool_(), pa.string(), ranges]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              [key, "part", "piece", "whole", "text", "loss"])
        for row in rows():
            held.append(row)
            chars += len(row[4])
            if chars > 8 * PIECE_CHARS or len(held) >= 4096:
                yield batch_of(held)
                held, chars = [], 0
        if held:
            yield batch_of(held)

    rec = F.col(record)
    ordered = records.select(key, F.col(order).alias("order__"), rec.alias("record__"))
    dealt = ordered.repartitionByRange(
        F.col(key), F.col("order__").asc_nulls_last(), F.substring("record__", 1, 64)).sortWithinPartitions(
        F.col(key), F.col("order__").asc_nulls_last(), "record__")
    return dealt.select(key, "record__").mapInArrow(run, f"`{key}` {kind}, {OUTPUT}")


def read_chats(formatted: DataFrame, key: str) -> DataFrame:
    """What the output says of each conversation: key, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    kind = formatted.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")

    def run(batches):
        import pyarrow as pa
        names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        started = False
        out = []

        def close():
            out.append((now, n, turns.hexdigest(), lost, loss_hash.hexdigest(), chars))

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or k != now:
                    if started:
                        close()
                    now, n, lost, chars = k, 0, 0, 0
                    turns, loss_hash, started = hashlib.sha256(), hashlib.sha256(), True
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in loss:
                    said = unescaped(text[span["start"]:span["end"]])
                    loss_hash.update(said.encode())
                    lost += len(said)
                chars += len(text)
            if out:
                yield _digests(out, names, key_type)
                out.clear()
        if started:
            close()
            yield _digests(out, names, key_type)

    def _digests(out, names, key_type):
        import pyarrow as pa
        types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    whole = formatted.where("whole").select(key, "text", "loss").mapInArrow(run, schema)
    rest = (formatted.where("not whole").repartition(key).sortWithinPartitions(key, "part", "piece")
            .select(key, "text", "loss").mapInArrow(run, schema))
    return whole.unionByName(rest)


# The conversation that the query adds.
ADDED_ID = -7
ADDED_TEXT = "\\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations (one record a row) and one more as a list of messages, formatted,
    written, read back from the output."""
    rows = read_columns(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    said = json.dumps({"messages": [{"role": r, "content": ADDED_TEXT} for r in ("user", "assistant")]})
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    added = spark.range(1).select(F.lit(ADDED_ID).cast(kinds["conv_id"]).alias("conv_id"),
                                  F.lit(0).cast(kinds["turn"]).alias("turn"), F.lit(said).alias("record"))
    made = staged(format_chats(rows.unionByName(added), "conv_id", "turn", "record"), "chats")
    return read_chats(made, "conv_id")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, length(text) + length(role)
             + length(text || role) - length(replace(text || role, '\', ''))
             + length(role) - length(replace(role, ':', ''))
             + (length(text) - length(replace(text, '</turn>', ''))) // 7
             + (length(role) - length(replace(role, '</turn>', ''))) // 7
             + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(text, '#{3,}')]), 0)
             + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(role, '#{3,}')]), 0)
             + length('### : </turn>') + 1 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
