"""Chat formatting: layouts found by fingerprint, one template, a reversible escape and a loss mask.

A record's fingerprint is the hash of its nested field paths, of any depth and
with any names. A table of fingerprints selects a declarative mapping that
names where turns, roles and texts lie. A fingerprint that isn't in the table
is resolved once: the mapping with the most paths among those whose paths the
record has, so that further fields do no harm. The mapping makes canonical
turns `array<struct<role, text>>`. A record that no mapping fits is an error,
unless the caller asks for nulls.

Template, for each turn: `<s>` role `[INST]` text `</s>`. In roles and texts a
backslash is put before every backslash and after the first character of every
control string, so no control string of the template (or of the chat formats
listed below) stands inside a text, and taking the backslashes out again gives
back the text.
"""

from __future__ import annotations

import hashlib
import json as jsonlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, MIDDLE, END = "<s>", "[INST]", "</s>"
#: Control strings, each as its first character and the rest.
CONTROLS = r"(<)(/?s>)|(\[)(/?INST\])|(<)(/?SYS>>)|(<)(\|[A-Za-z_]+\|>)"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROLS, r"$1$3$5$7\\$2$4$6$8")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


@dataclass(frozen=True)
class Layout:
    """Where canonical turns come from: an array of (role, text) objects, or single fields in order with fixed roles."""

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()


#: Known layouts: leaf paths, `[]` marks array elements.
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Layout("share", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("instruction", ("instruction", "input", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction_only", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt", ("system", "prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def path_print(paths: Iterable[str]) -> str:
    """sha256 of the sorted distinct field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()


def _step(name: str) -> str:
    """A field's name as a part of a path: quoted where it could be taken for several parts."""
    return jsonlib.dumps(name) if re.search(r'[.\[\]"\n]', name) or not name else name


def field_paths(value: object, at: str = "") -> set[str]:
    """Leaf paths of a JSON value, those of all elements of an array together; `[]` marks elements, an empty array is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{_step(k)}" if at else _step(k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def kind_paths(kind: str) -> frozenset[str] | None:
    """`field_paths` of a JSON object whose type is given as `schema_of_variant` writes it; None for what is no object."""
    marks = re.findall(r"`(?:[^`]|``)*`|[^\s`<>:,()]+|[<>:,]|\([^)]*\)", kind)
    at = 0

    def walk(path: str) -> set[str]:
        nonlocal at
        word, at = marks[at], at + 1
        if word == "ARRAY":
            at += 1
            found = walk(f"{path}[]")
        elif word == "OBJECT":
            at += 1
            found: set[str] = set()
            while marks[at] != ">":
                if marks[at] == ",":
                    at += 1
                name, at = marks[at], at + 2
                name = name[1:-1].replace("``", "`") if name.startswith("`") else name
                found |= walk(f"{path}.{_step(name)}" if path else _step(name))
            at += 1
            return found or {path}
        else:
            at += at < len(marks) and marks[at].startswith("(")  # of a decimal
            return {path}
        at += 1
        return found

    return frozenset(walk("")) if marks and marks[0] == "OBJECT" else None


#: The mapping of each fingerprint that is just a layout's own.
PRINTS = {path_print(x.paths): x for x in LAYOUTS}


@lru_cache(maxsize=10_000)
def layout_of(paths: frozenset[str]) -> Layout | None:
    """The mapping whose fingerprint the record has; else the one with the most paths among those that the record has; None if none fits.

    Of mappings with as many paths the first in `LAYOUTS` counts. Only where
    none of these fits, a layout of turns fits a record whose array of turns is empty.
    """
    exact = PRINTS.get(path_print(paths))
    if exact:
        return exact
    fits = [x for x in LAYOUTS if paths.issuperset(x.paths)] or [x for x in LAYOUTS if x.turns and f"{x.turns}[]" in paths][:1]
    return max(fits, key=lambda x: len(x.paths), default=None)


@lru_cache(maxsize=10_000)
def _recognised_kind(kind: str | None) -> tuple[str | None, str | None]:
    """Fingerprint and layout of records of one type."""
    paths = kind_paths(kind) if kind else None
    found = layout_of(paths) if paths is not None else None
    return None if paths is None else path_print(paths), found.name if found else None


@F.pandas_udf(T.StructType().add("print", T.StringType()).add("layout", T.StringType()))
def _recognised(kinds: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_recognised_kind(k) for k in kinds], columns=["print", "layout"])


def canonical_turns(records: DataFrame, json: str = "json", unknown: str = "raise") -> DataFrame:
    """Add `layout`, `turns` and `print` (the fingerprint) to records that each hold one JSON object.

    Rows that are null, no JSON object, or that no mapping fits stop the job
    with an error that names the fingerprint; with `unknown` as "null" they get
    a null layout and null turns. Further fields do no harm. An empty field of
    a layout of single fields (as `input`) gives no turn.
    """
    rows = records.withColumn("_value", F.try_parse_json(F.col(json)))
    rows = rows.withColumn("_seen", _recognised(F.schema_of_variant("_value")))
    name = F.col("_seen.layout")
    for layout in LAYOUTS:
        if layout.turns:  # elements without any field are no turns
            bare = F.exists(F.try_variant_get(F.col("_value"), f"$.{layout.turns}", "array<variant>"), lambda x: ~F.coalesce(F.schema_of_variant(x).startswith("OBJECT<"), F.lit(False)) | (F.schema_of_variant(x) == "OBJECT<>"))
            name = F.when((F.col("_seen.layout") == layout.name) & F.coalesce(bare, F.lit(False)), F.lit(None)).otherwise(name)
    if unknown == "raise":
        name = F.coalesce(name, F.raise_error(F.concat(F.lit("no chat layout fits the fields of print "), F.coalesce("_seen.print", F.lit("null")))))
    rows = rows.withColumn("layout", name).withColumn("print", F.col("_seen.print"))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in LAYOUTS:
        turns = F.when(F.col("layout") == layout.name, _mapped(layout, F.col("_value"))).otherwise(turns)
    return rows.withColumn("turns", turns).drop("_value", "_seen")


def _mapped(layout: Layout, value: Column) -> Column:
    if layout.turns:
        kind = f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"
        return F.transform(F.try_variant_get(value, f"$.{layout.turns}", kind), lambda x: _turn(x[layout.role], x[layout.text]))
    parts = [(_turn(F.lit(role), F.try_variant_get(value, f"$.{path}", "string"))) for role, path in layout.fields]
    return F.filter(F.array(*parts), lambda x: (x["text"] != "") | (x["role"] == "assistant"))


def _turn(role: Column, text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.struct(F.coalesce(known[F.lower(role)], role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def from_rows(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Canonical turns of a table with one row a turn: `key`, `turns`.

    Turns are in the order of `turn`; equal numbers by role, then text; null
    numbers first. Null roles and texts are empty. Repeated rows stay. One
    conversation is one record, so it is put together in one task.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gathered = rows.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return gathered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


#: Tables with one row a turn: the columns that hold key, turn number, role and text.
ROW_LAYOUTS = (("conv_id", "turn", "role", "text"), ("conversation_id", "index", "from", "value"), ("thread", "position", "role", "content"))


def schema_paths(schema: T.StructType, at: str = "") -> list[str]:
    """Leaf paths of a table's columns."""
    out = []
    for field in schema.fields:
        path, kind = f"{at}{_step(field.name)}", field.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = f"{path}[]", kind.elementType
        out += schema_paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [path]
    return out


def from_table(table: DataFrame) -> DataFrame:
    """Canonical turns of a typed table, by the mapping that the fingerprint of its columns selects.

    A table of turns gives a row for each key; a table of records keeps its
    rows and columns. Other columns may stand beside those of a layout;
    ValueError if no mapping fits.
    """
    found = frozenset(schema_paths(table.schema))
    for names in ROW_LAYOUTS:
        if path_print(found.intersection(names)) == path_print(names):
            return from_rows(table, *names)
    layout = layout_of(found)
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(found)}")
    used = sorted({re.split(r"[.\[]", p)[0] for p in layout.paths})
    return table.withColumn("turns", _mapped(layout, F.parse_json(F.to_json(F.struct(*used)))))


def formatted(conversations: DataFrame) -> DataFrame:
    """Add `formatted`, and `loss_spans`: [start, end) in code points of each assistant text in it. Needs `turns`.

    Null turns give a null text and null spans.
    """
    pieces = F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("learn"),
        F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
        escape(t["text"]).alias("body"),
    ))
    out = conversations.withColumn("_pieces", pieces)
    out = out.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    sizes = F.transform("_pieces", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body")))
    return out.withColumn("loss_spans", _spans(sizes["head"], sizes["body"], F.transform("_pieces", lambda p: p["learn"]))).drop("_pieces")


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))
def _spans(heads: pd.Series, bodies: pd.Series, learns: pd.Series) -> pd.Series:
    out = []
    for head, body, learn in zip(heads, bodies, learns, strict=True):
        if head is None:
            out.append(None)
            continue
        ends = np.cumsum(np.asarray(head, np.int64) + np.asarray(body, np.int64) + len(END)) - len(END)
        out.append([{"start": int(e - n), "end": int(e)} for e, n, ok in zip(ends, body, learn, strict=True) if ok])
    return pd.Series(out, dtype=object)


def parsed(text: Column) -> Column:
    """Canonical turns read back from formatted text.

    A head holds no control string, so its mark is the first one of its turn.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)<s>(.*?)</s>"), F.lit(1))
    mark = F.lit(MIDDLE)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.split_part(p, mark, F.lit(1))).alias("role"),
        unescape(F.split_part(p, mark, F.lit(2))).alias("text"),
    ))


@F.pandas_udf(T.StringType())
def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
    """All text under the loss mask, unescaped, nothing between; null without a text."""
    plain = lambda t: re.sub(r"\\(.)", r"\1", t, flags=re.DOTALL)
    return pd.Series([None if t is None else "".join([plain(t[x["start"] : x["end"]]) for x in at]) for t, at in zip(text, spans, strict=True)], dtype=object)


def digest(conversations: DataFrame, key: str) -> DataFrame:
    """What can be read back from formatted conversations: counts and checksums."""
    back = conversations.withColumn("_turns", parsed(F.col("formatted"))).withColumn("_learned", masked("formatted", "loss_spans"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        key,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -1: control strings of another template inside both texts."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
