"""Chat formatting with native functions only, by schema fingerprints.

Tables of chats come in different layouts.  A layout is known by its
fingerprint, the SHA-256 of its sorted nested field paths (of the columns that
some mapping names; others may clash or be missing).  A registered mapping, a
declaration of where the chat id, the turns and their roles and texts are, turns
it into canonical rows (conv_id, turn, role, text), which one template formats:

    <|system|>...<|end|>  /  <|user|>...<|end|>  /  <|assistant|>...<|end|>

Control strings inside texts and roles are escaped reversibly: a backslash
becomes ``\\0``, the ``<`` of ``<|``, ``<s>``, ``</s>``, ``<<SYS>>`` and ``<</SYS>>`` becomes ``\\1``,
the ``[`` of ``[INST]`` and ``[/INST]`` becomes ``\\2``, and ``|>`` in a role ``\\3``.  Nothing escaped holds a control
string, so markers can be found again by plain splitting.

The loss mask is a list of (start, length) in code points: the escaped texts of
assistant turns.  ``read_back`` gets turns and loss text from the formatted
string and the mask alone.

Defined results: a null text or role is empty; equal turn numbers are ordered by
role, then (escaped) text; repeated rows are repeated turns; a null or empty array of
turns has no turn, and gives no chat; a null element is an empty turn; rows without a conv_id form
one chat of id null; of an empty table nothing comes. A chat is one output row, so its turns meet in one task; a
third of all chats being alike does no harm, as they are dealt by id.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOSS_ROLE = "assistant"
#: The template's markers, and the control strings of common templates that are escaped: fixed values.
OPEN, MID, END = "<|", "|>", "<|end|>"
ANGLED = r"<(?=\||/?s>|</?SYS>>)|(?<=<)<(?=/?SYS>>)"
SQUARE = r"\[(?=/?INST\])"


def paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths with the kind at each leaf; [] stands for array elements."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, f"{prefix}[]")
    kind = "number" if isinstance(schema, T.NumericType) else schema.typeName()
    return [f"{prefix}:{kind}"]


def fingerprint(found: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. turns: one (role, text) pair of SQL expressions each, or an array to explode and pairs over its element x."""

    paths: tuple[str, ...]
    id: str
    turns: tuple[tuple[str, str], ...]
    array: str | None = None
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return fingerprint(list(self.paths))


#: Role names of common data sets and what they mean here: fixed values.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping(("conv_id:number", "turn:number", "role:string", "text:string"), "conv_id", (("role", "text"),), order="turn"),
    Mapping(("id:number", "messages[].role:string", "messages[].content:string"), "id", (("x.role", "x.content"),), array="messages"),
    Mapping(("id:number", "conversations[].from:string", "conversations[].value:string"), "id", (("x.from", "x.value"),), array="conversations", roles=ROLES),
    Mapping(("id:number", "instruction:string", "input:string", "output:string"), "id", (("'user'", "concat_ws('\\n', instruction, nullif(input, ''))"), ("'assistant'", "output"))),
    Mapping(("id:number", "prompt:string", "response:string"), "id", (("'user'", "prompt"), ("'assistant'", "response"))),
    Mapping(("id:number", "system:string", "prompt:string", "response:string"), "id", (("'system'", "system"), ("'user'", "prompt"), ("'assistant'", "response"))),
)


def select_mapping(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping whose fingerprint equals that of the schema cut to the mapping's paths; of several the one with most paths. No match: ValueError with the schema's own fingerprint."""
    found = paths(schema)
    for mapping in sorted(mappings, key=lambda m: -len(m.paths)):
        if fingerprint([p for p in found if p in mapping.paths]) == mapping.key:
            return mapping
    raise ValueError(f"no mapping for layout {fingerprint(found)}: {sorted(found)}")


def canonical(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text) of any known layout."""
    m = select_mapping(df.schema, mappings)
    if m.array:
        df = df.select(F.expr(m.id).alias("_id"), F.posexplode(F.expr(m.array)).alias("_turn", "x"))
    else:
        df = df.withColumns({"_id": F.expr(m.id), "_turn": F.expr(m.order) if m.order else F.lit(0)})
    if len(m.turns) == 1:
        df = df.select("_id", F.col("_turn").alias("turn"), F.expr(m.turns[0][0]).alias("role"), F.expr(m.turns[0][1]).alias("text"))
    else:
        each = [F.struct(F.lit(i).alias("turn"), F.expr(r).alias("role"), F.expr(t).alias("text")) for i, (r, t) in enumerate(m.turns)]
        df = df.select("_id", F.explode(F.array(*each)).alias("t")).select("_id", "t.*")
    role = F.col("role").cast("string")
    for name, meaning in m.roles.items():
        role = F.when(F.col("role") == name, meaning).otherwise(role)
    return df.select(F.col("_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.col("text").cast("string").alias("text"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    return F.regexp_replace(F.regexp_replace(text, ANGLED, r"\\1"), SQUARE, r"\\2")


def unescape(text: Column) -> Column:
    for code, char in (("\\3", MID), ("\\2", "["), ("\\1", "<"), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans) of canonical turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.replace(escape(role), F.lit(MID), F.lit("\\3")).alias("r"), escape(text).alias("t"))
    rows = rows.withColumn("piece", F.concat(F.lit(OPEN), F.col("r"), F.lit(MID), F.col("t"), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "t")
    place = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("t")
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        "piece",
        F.when(F.col("role") == loss_role, F.struct((F.sum(F.char_length("piece")).over(place) - size - len(END)).cast("int").alias("start"), size.alias("length"))).alias("span"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "span"))).alias("p"))
    return chats.select(
        "conv_id",
        F.array_join("p.piece", "").alias("formatted"),
        F.filter("p.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted_chars), from formatted and loss_spans."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MID, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, MID) + len(MID))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return chats.select("conv_id", parsed.alias("turns"), loss.alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def digest(df: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted chats."""
    back = read_back(format_chats(canonical(df)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
