"""Chat formatting: schema fingerprints select declarative mappings into canonical turns, which a reversible template renders.

A fingerprint is a hash of the sorted nested field paths of a record, of which only paths that some mapping knows count, so
extra fields do not matter.  Each mapping lists its required and optional paths; its fingerprints (one for each subset of
the optional paths) are computed once, so choosing a mapping is one look-up.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairfold.llm.common import blocks

TURNS = "array<struct<role:string,text:string>>"

#: Role names of common layouts and their canonical names.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``each``: (array path, role field, text field) of a list of messages.  ``one``: (role, fields joined by a blank line)
    for each turn, skipped if all its fields are missing.  ``rows``: (conversation, order, role, text) columns of a table
    with one row per turn.  ``part``: the field of a message's typed parts that has text, whose texts are put together; a
    message may still have its text as it is.
    """

    name: str
    each: tuple[str, str, str] | None = None
    one: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rows: tuple[str, str, str, str] | None = None
    part: str | None = None
    optional: frozenset[str] = frozenset()
    roles: dict = field(default_factory=dict, hash=False, compare=False)

    def paths(self) -> set[str]:
        found = {p for _, fields in self.one for p in fields}
        if self.each:
            array, role, text = self.each
            found |= {f"{array}[].{role}", f"{array}[].{text}[].{self.part}" if self.part else f"{array}[].{text}"}
        return found | self.optional | set((self.rows or ())[1:])

    def needed(self) -> list[set[str]]:
        """The required paths; for a list of messages also those of an empty one."""
        must = self.paths() - self.optional
        return [must, {f"{self.each[0]}[empty]"}] if self.each and not self.part else [must]


MAPPINGS = (
    Mapping("turn_rows", rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", each=("messages", "role", "content"), one=(("system", ("system",)),), optional=frozenset({"system"})),
    Mapping("message_parts", each=("messages", "role", "content"), one=(("system", ("system",)),), part="text", optional=frozenset({"system", "messages[].content", "messages[].content[].type"})),
    Mapping("from_value", each=("conversations", "from", "value"), one=(("system", ("system",)),), optional=frozenset({"system"}), roles=ROLE_NAMES),
    Mapping("instruction", one=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system", "input"})),
    Mapping("prompt_completion", one=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=frozenset({"system"})),
    Mapping("prompt_response", one=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system"})),
    Mapping("question_answer", one=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",))), optional=frozenset({"system", "context"})),
    Mapping("preference", one=(("user", ("prompt",)), ("assistant", ("chosen",)))),
)


def fingerprint(paths) -> str:
    """Hash of the nested field paths that any mapping knows."""
    return hashlib.sha256("\n".join(sorted(set(paths) & _KNOWN)).encode()).hexdigest()


_KNOWN = set().union(*(m.paths() for m in MAPPINGS), *(n for m in MAPPINGS for n in m.needed()))
_BY_FINGERPRINT: dict[str, Mapping] = {}
for _m in MAPPINGS:
    for _must in _m.needed():
        for _n in range(len(_m.optional) + 1):
            for _some in itertools.combinations(sorted(_m.optional), _n):
                _BY_FINGERPRINT.setdefault(fingerprint(_must | set(_some)), _m)


def schema_paths(schema: T.StructType, prefix: str = "") -> set[str]:
    """Nested leaf paths of a DataFrame schema; arrays are marked by []."""
    out: set[str] = set()
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        out |= schema_paths(kind, path + ".") if isinstance(kind, T.StructType) else {path}
    return out


def json_paths(value, prefix: str = "", nulls: bool = False) -> set[str]:
    """Nested leaf paths of a parsed JSON value; fields that are null count with ``nulls``.  A list of nothing is marked [empty]."""
    if isinstance(value, dict):
        return set().union(*(json_paths(v, f"{prefix}.{k}" if prefix else k, nulls) for k, v in value.items() if nulls or v is not None), set())
    if isinstance(value, list):
        some = [v for v in value if v is not None]
        return set().union(*(json_paths(v, prefix + "[]", nulls) for v in some), set() if some else {prefix + "[empty]"})
    return {prefix}


def mapping_for(paths) -> Mapping | None:
    """The mapping of a record's fingerprint; failing that, the first one whose own paths alone have one of its fingerprints.

    The second covers records with extra fields that happen to have the name of another layout's field.
    """
    paths = set(paths)
    if m := _BY_FINGERPRINT.get(fingerprint(paths)):
        return m
    return next((m for m in MAPPINGS if _BY_FINGERPRINT.get(fingerprint(paths & m.paths())) is m), None)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name and canonical turns of one parsed record; (None, []) if no mapping has its fingerprint.

    Fields that are null are no part of the fingerprint unless none is found without them.
    """
    m = mapping_for(json_paths(record)) or mapping_for(json_paths(record, nulls=True))
    if not m or m.rows:
        return None, []
    out = []
    for role, fields in m.one:
        parts = [_text(record[p]) for p in fields if record.get(p) is not None]
        if parts:
            out.append((role, "\n\n".join(x for x in parts if x)))
    if m.each:
        array, role, text = m.each
        said = lambda v: "".join(_text(p.get(m.part)) for p in v if isinstance(p, dict)) if m.part and isinstance(v, list) else _text(v)
        out += [(m.roles.get(r := _text(x.get(role)), r), said(x.get(text))) for x in record[array] if isinstance(x, dict)]
    return m.name, out


def turns_from_json(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """(id_col, layout, turns) of a column of JSON records of mixed layouts.

    A null, broken or unknown record has a null layout and no turns; it is never dropped.
    """

    def run(batches):
        for ids, records in blocks(batches, ["id", "record"]):
            names, turns = [], []
            for r in records:
                try:
                    parsed = json.loads(r) if r else None
                except ValueError:
                    parsed = None
                name, found = turns_of(parsed) if isinstance(parsed, dict) else (None, [])
                names.append(name)
                turns.append([{"role": a, "text": b} for a, b in found])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))], ["id", "layout", "turns"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("record"))
    return rows.mapInArrow(run, f"id long, layout string, turns {TURNS}").withColumnRenamed("id", id_col)


def turns_from_columns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, layout, turns) of a table whose schema has a known fingerprint.

    Rows by turn are grouped by conversation and ordered by turn (nulls first), role, then text; a null role or text is
    empty, and repeated rows stay repeated turns.  A null conversation id is a conversation of its own.  A table of
    records gives one conversation a row.  An unknown schema raises ValueError.
    """
    m = mapping_for(schema_paths(df.schema))
    if m is None:
        raise ValueError(f"no mapping has the fingerprint of {sorted(schema_paths(df.schema))}")
    empty = F.lit("")
    if m.rows:
        conv, order, role, text = m.rows
        row = F.struct(F.col(order), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))
        grouped = df.groupBy(F.col(conv).cast("long").alias(id_col)).agg(F.sort_array(F.collect_list(row)).alias("all"))
        return grouped.select(id_col, F.lit(m.name).alias("layout"), F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    parts = []
    for role, fields in m.one:
        have = [F.col(p).cast("string") for p in fields if p in df.columns]
        if have:
            joined = F.concat_ws("\n\n", *[F.when(c != "", c) for c in have])
            parts.append(F.when(F.coalesce(*have).isNotNull(), F.array(F.struct(F.lit(role).alias("role"), joined.alias("text")))))
    if m.each:
        array, role, text = m.each

        def turn(x):
            r = F.coalesce(x[role].cast("string"), empty)
            for a, b in m.roles.items():
                r = F.when(r == a, b).otherwise(r)
            if m.part:
                said = F.array_join(F.transform(x[text], lambda p: F.coalesce(p[m.part].cast("string"), empty)), "")
            else:
                said = x[text].cast("string")
            return F.struct(r.alias("role"), F.coalesce(said, empty).alias("text"))

        parts.append(F.transform(F.filter(array, lambda x: x.isNotNull()), turn))
    none = F.array().cast(TURNS)
    return df.select(F.col(id_col).cast("long").alias(id_col), F.lit(m.name).alias("layout"), F.concat(*[F.coalesce(p.cast(TURNS), none) for p in parts]).alias("turns"))


#: The template's control strings, and the rule that hides them in texts: "<", any backslashes and "|" get a backslash more.
START, END = "<|im_start|>", "<|im_end|>\n"
_HIDE, _SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Text without "<|", so without control strings; ``unescape`` gives back any text exactly."""
    return _HIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation and the code point spans of its assistant texts (the loss mask)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        out += [head, body, END]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((_unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END)
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def format_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, formatted, loss_spans) of a table of canonical turns; no turns give an empty text and no spans.

    A null turn is left out, and a null role or text is empty.  Each row gives one, those with a null or repeated id too.
    Other columns are not read.
    """

    def run(batches):
        for ids, convs in blocks(batches, ["id", "turns"]):
            done = [render([(t["role"] or "", t["text"] or "") for t in c or [] if t]) for c in convs]
            spans = [[{"start": a, "stop": b} for a, b in s] for _, s in done]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([f for f, _ in done], pa.string()), pa.array(spans, _SPANS)], ["id", "formatted", "loss_spans"])

    rows = turns.select(F.col(id_col).cast("long").alias("id"), "turns")
    return rows.mapInArrow(run, "id long, formatted string, loss_spans array<struct<start:long,stop:long>>").withColumnRenamed("id", id_col)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests read from formatted conversations: (id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    A null text is a conversation without turns, and null spans are none.  Each row gives one, those with a null or repeated id
    too.  A text that the template didn't make raises ValueError.
    """

    def run(batches):
        for ids, texts, masks in blocks(batches, ["id", "formatted", "loss_spans"]):
            rows = []
            for text, mask in zip((t or "" for t in texts), (m or [] for m in masks), strict=True):
                turns, loss = parse(text), [unescape(text[s["start"] : s["stop"]]) for s in mask]
                all_turns = hashlib.sha256()
                for role, said in turns:
                    all_turns.update(f"{role}\n{said}\n".encode())
                rows.append((len(turns), all_turns.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(text)))
            n, t, c, h, f = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(t), pa.array(c, pa.int64()), pa.array(h), pa.array(f, pa.int64())], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select(F.col(id_col).cast("long").alias("id"), "formatted", "loss_spans")
    return rows.mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)


def format_chat(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns by the mapping that the table's fingerprint selects, rendered: (id_col, formatted, loss_spans)."""
    return format_turns(turns_from_columns(df, id_col), id_col)
