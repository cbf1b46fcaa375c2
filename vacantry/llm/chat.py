"""Chat formatting: layouts recognised by schema fingerprints, one reversible template, a loss mask."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declarative mappings. `paths` are the nested fields that make up a layout; `optional` ones may be missing.
#: turns: either fields that each make a turn (role, paths joined by a blank line), or one list of turns with the
#: names of its role and text; rows: a table with one turn a row.
LAYOUTS = [
    {"name": "prompt", "paths": ["prompt", "completion"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt_response", "paths": ["prompt", "response"], "optional": ["system"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "instruction", "paths": ["instruction", "output"], "optional": ["input", "system"], "turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "question", "paths": ["question", "answer"], "turns": [("user", ["question"]), ("assistant", ["answer"])]},
    {"name": "messages", "paths": ["messages[].content", "messages[].role"], "list": ("messages", "role", "content")},
    {"name": "conversations", "paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    {"name": "rows", "paths": ["conv_id", "role", "text", "turn"], "rows": ("conv_id", "turn", "role", "text")},
]
#: Names that layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
TRAINED = "assistant"
_KNOWN = {p for x in LAYOUTS for p in [*x["paths"], *x.get("optional", [])]}


def fingerprint(paths) -> str:
    """SHA-256 of the sorted nested field paths, of those that any layout knows."""
    return hashlib.sha256("\n".join(sorted(_KNOWN.intersection(paths))).encode()).hexdigest()


def _registry() -> dict[str, dict]:
    out = {}
    for x in LAYOUTS:
        rest = x.get("optional", [])
        for bits in range(1 << len(rest)):
            out[fingerprint([*x["paths"], *(p for k, p in enumerate(rest) if bits >> k & 1)])] = x
    return out


REGISTRY = _registry()


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; [] marks what a list holds."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


#: Levels of nesting that are looked at; no layout has more than two.
DEEPEST = 8


def value_paths(value, at: str = "", deep: int = 0) -> set[str]:
    """Nested field paths of a parsed JSON value; what lies deeper than DEEPEST is one field of its own."""
    if isinstance(value, dict) and deep < DEEPEST:
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k, deep + 1)}
    if isinstance(value, list) and deep < DEEPEST:
        return {p for v in value for p in value_paths(v, f"{at}[]", deep + 1)}
    return {at}


def turns_of(value) -> tuple[str | None, list[dict]]:
    """(layout, turns) of one parsed record.

    The layout is null, and there are no turns, if no layout has its fingerprint, or if its list of turns holds
    anything but objects.
    """
    layout = REGISTRY.get(fingerprint(value_paths(value))) if isinstance(value, dict) else None
    if layout is None or "rows" in layout:
        return None, []
    if "list" in layout and not (isinstance(value[layout["list"][0]], list) and all(isinstance(m, dict) for m in value[layout["list"][0]])):
        return None, []
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if "list" in layout:
        items, role, content = layout["list"]
        return layout["name"], [{"role": ROLES.get(text(m.get(role)), text(m.get(role))), "text": text(m.get(content))} for m in value[items]]
    out = []
    for role, fields in layout["turns"]:
        said = [text(value[f]) for f in fields if f in value and (value[f] not in (None, "") or f == fields[0])]
        if said:
            out.append({"role": role, "text": "\n\n".join(said)})
    return layout["name"], out


def _no_constant(name: str):
    raise ValueError(name)


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def canonical_json(df: DataFrame, *, id_col: str, json_col: str) -> DataFrame:
    """(id, layout, turns) of records that are JSON texts of mixed layouts, each recognised by its own fingerprint.

    Null, malformed, too deeply nested and unrecognised records stay, with a null layout and no turns; numbers that
    JSON does not have (NaN) and halves of surrogate pairs count as malformed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            layouts, turns = [], []
            for t in b.column(1):
                try:
                    name, said = turns_of(json.loads(t.as_py() or "null", parse_constant=_no_constant))
                    "".join(x for m in said for x in m.values()).encode()
                except (ValueError, RecursionError):
                    name, said = None, []
                layouts.append(name)
                turns.append(said)
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(layouts, pa.string()), pa.array(turns, kind)], [id_col, "layout", "turns"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("layout", T.StringType()), T.StructField("turns", TURNS)])
    return df.select(id_col, F.col(json_col).cast("string")).mapInArrow(run, schema)


def canonical(df: DataFrame, *, id_col: str | None = None) -> DataFrame:
    """(id, layout, turns) of a table, by the layout that its schema's fingerprint selects; fields that no layout knows are ignored.

    In a table with a turn a row, the turns of one conversation are ordered by turn, then role and text; a null
    role or text is empty, and rows with a null conversation make one conversation. In other tables each row is a
    conversation named by id_col, and null fields are empty (an optional one is left out).
    """
    layout = REGISTRY.get(fingerprint(schema_paths(df.schema)))
    if layout is None:
        raise ValueError(f"no layout has these fields: {schema_paths(df.schema)}")
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if "rows" in layout:
        conv, turn, role, text = layout["rows"]
        said = F.struct(F.col(turn).alias("turn"), empty(F.col(role)).alias("role"), empty(F.col(text)).alias("text"))
        turns = F.transform(F.array_sort(F.collect_list(said)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return df.groupBy(F.col(conv).alias(id_col or conv)).agg(F.lit(layout["name"]).alias("layout"), turns.alias("turns"))
    if "list" in layout:
        items, role, content = layout["list"]
        named = lambda r: F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[r], r)
        turns = F.transform(F.coalesce(F.col(items), F.array()), lambda m: F.struct(named(empty(m[role])).alias("role"), empty(m[content]).alias("text")))
    else:
        parts = []
        for role, fields in layout["turns"]:
            there = [f for f in fields if f in df.columns]
            if there:
                joined = F.concat_ws("\n\n", empty(F.col(there[0])) if fields[0] == there[0] and role != "system" else F.nullif(empty(F.col(there[0])), F.lit("")), *[F.nullif(empty(F.col(f)), F.lit("")) for f in there[1:]])
                said = F.struct(F.lit(role).alias("role"), joined.alias("text"))
                parts.append(F.when(F.lit(role != "system") | (joined != ""), said))
        turns = F.array_compact(F.array(*parts))
    return df.select(F.col(id_col), F.lit(layout["name"]).alias("layout"), turns.alias("turns"))


def escape(text: str) -> str:
    r"""No < is left, so no control string can stand in a text: \ becomes \b and < becomes \l."""
    return text.replace("\\", "\\b").replace("<", "\\l")


def escape_role(role: str) -> str:
    r"""As a text, and > becomes \g, so a role ends at the first >."""
    return escape(role).replace(">", "\\g")


def unescape(text: str) -> str:
    return text.replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted conversation, and the spans (start, end, in code points) of what is trained on: the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape_role(role)}>\n", escape(text)
        if role == TRAINED:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, "\n</turn>\n"]
        at += len(head) + len(body) + 9
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of render."""
    out = []
    for piece in formatted.split("\n</turn>\n")[:-1]:
        role, _, text = piece.removeprefix("<turn ").partition(">\n")
        out.append((unescape(role), unescape(text)))
    return out


def format_chat(conversations: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """(id, formatted, loss_spans) of (id, turns) rows as `canonical` makes them.

    Each turn is <turn ROLE>, its text and </turn>, on lines of their own; role and text are escaped reversibly.
    No turns give an empty text. Ids are passed through; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render([(t["role"] or "", t["text"] or "") for t in turns.as_py() or []]) for turns in b.column(1)]
            spans = pa.array([s for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f for f, _ in done], pa.string()), spans], [id_col, "formatted", "loss_spans"])

    kind = conversations.schema[id_col].dataType.simpleString()
    return conversations.select(id_col, "turns").mapInArrow(run, f"`{id_col}` {kind}, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """(id, turns, loss_text, formatted_chars), read from the formatted text and its loss spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, loss, chars = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns.append([{"role": r, "text": t} for r, t in parse(text or "")])
                loss.append("".join(unescape(text[s["start"] : s["end"]]) for s in spans or []))
                chars.append(len(text or ""))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(turns, kind), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], [id_col, "turns", "loss_text", "formatted_chars"])

    kind = formatted.schema[id_col].dataType.simpleString()
    return formatted.select(id_col, "formatted", "loss_spans").mapInArrow(run, f"`{id_col}` {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")
