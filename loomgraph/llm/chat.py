"""Chat formatting: layouts told by a fingerprint of their field paths, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, quoted

#: The template: START role newline text END newline, for each turn.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that models take as control; inside roles and texts they are broken up.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Breaks a control string after its first character; where texts hold it, it is doubled up with KEPT.
ESCAPE, BROKEN, KEPT, LINE = "␛", "c", "e", "n"
LOSS_ROLE = "assistant"

TURNS = "array<struct<role:string,text:string>>"


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _role(name: Column) -> Column:
    """Other layouts' names of the three roles."""
    names = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
    return F.coalesce(*(F.when(F.lower(name) == k, v) for k, v in names.items()), name)


def _list(array: str, role: str, text: str) -> Callable[[], Column]:
    return lambda: F.transform(F.col(array), lambda x: _turn(_role(x[role]), x[text]))


def _asked(*parts: str, system: str | None = None, answer: str) -> Callable[[], Column]:
    """A question of one or more columns, and its answer."""

    def turns() -> Column:
        question = F.concat_ws("\n\n", *(F.when(F.col(p) != "", F.col(p)) for p in parts))
        return F.array(*([_turn("system", F.col(system))] if system else []), _turn("user", question), _turn("assistant", F.col(answer)))

    return turns


#: Layout name -> its field paths, and the canonical turns that they are mapped to.
MAPPINGS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "turn_row": (("role", "text"), lambda: F.array(_turn(F.col("role"), F.col("text")))),
    "turn_row_content": (("content", "role"), lambda: F.array(_turn(F.col("role"), F.col("content")))),
    "prompt_response": (("prompt", "response"), _asked("prompt", answer="response")),
    "prompt_completion": (("completion", "prompt"), _asked("prompt", answer="completion")),
    "question_answer": (("answer", "question"), _asked("question", answer="answer")),
    "instruction_output": (("instruction", "output"), _asked("instruction", answer="output")),
    "instruction_input_output": (("input", "instruction", "output"), _asked("instruction", "input", answer="output")),
    "system_instruction_output": (("instruction", "output", "system"), _asked("instruction", system="system", answer="output")),
    "messages": (("messages[].content", "messages[].role"), _list("messages", "role", "content")),
    "messages_text": (("messages[].role", "messages[].text"), _list("messages", "role", "text")),
    "conversations": (("conversations[].from", "conversations[].value"), _list("conversations", "from", "value")),
}


def paths(name: str, kind: T.DataType) -> list[str]:
    """Nested field paths of a column: a[].b for a field of an array's structs, a.b for one of a struct."""
    return [path for path, _ in _leaves(name, kind, F.lit(None))]


def _leaves(name: str, kind: T.DataType, value: Column) -> list[tuple[str, Column]]:
    """The nested field paths of a value, and whether it has anything there: in arrays, whether any element has."""
    if isinstance(kind, T.ArrayType):
        found = _leaves(f"{name}[]", kind.elementType, F.lit(None))
        some = lambda i: F.coalesce(F.exists(value, lambda x: _leaves("", kind.elementType, x)[i][1]), F.lit(False))
        return [(path, some(i)) for i, (path, _) in enumerate(found)]
    if isinstance(kind, T.StructType):
        return [leaf for field in kind for leaf in _leaves(f"{name}.{field.name}", field.dataType, value.getField(field.name))]
    return [(name, value.isNotNull())]


def fingerprint_of(found: list[str] | tuple[str, ...]) -> int:
    """The hash of a set of field paths, as Spark's xxhash64 of the sorted, joined paths gives it."""
    value = xxhash.xxh64_intdigest("\n".join(sorted(found)).encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """Of each row: the hash of the nested paths below those columns at which that row has anything but null."""
    found = sorted((leaf for c in columns for leaf in _leaves(c, df.schema[c].dataType, quoted(c))), key=lambda x: x[0])
    return F.xxhash64(F.concat_ws("\n", *(F.when(there, F.lit(path)) for path, there in found)))


def layouts(here: set[str]) -> dict[int, str]:
    """Fingerprint -> layout, of all layouts whose paths are among those here.

    A row may lack some of its layout's fields; where two layouts then look alike,
    the first has it. A row without any field is known only where there is but one
    layout.
    """
    usable = {name: p for name, (p, _) in MAPPINGS.items() if set(p) <= here}
    known = {fingerprint_of(p): name for name, p in usable.items()}
    for name, p in usable.items():
        for n in range(len(p) - 1, -1 if len(usable) == 1 else 0, -1):
            for some in combinations(p, n):
                known.setdefault(fingerprint_of(some), name)
    return known


def canonical(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """keys, layout, turns: a row of any known layout as an array of (role, text).

    Each row's own paths are hashed, elements of arrays included, and select its
    mapping, so rows of different layouts may come in one table. A row of an
    unknown layout (an empty list has no paths) stays, with null turns and layout:
    who explodes turns must ask for it with explode_outer or by `layout is null`.
    """
    here = {p for c in columns for p in paths(c, df.schema[c].dataType)}
    known = layouts(here)
    (mark,) = free_names(df, "layout")
    marked = df.withColumn(mark, fingerprint(df, columns))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name in dict.fromkeys(known.values()):
        hit = quoted(mark).isin([value for value, of in known.items() if of == name])
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, MAPPINGS[name][1]().cast(TURNS)).otherwise(turns)
    return marked.select(*map(quoted, keys), layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + KEPT))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(control[0] + ESCAPE + BROKEN + control[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + BROKEN), F.lit("")), F.lit(ESCAPE + KEPT), F.lit(ESCAPE))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + LINE), F.lit("\n")))


def render(turns: DataFrame) -> DataFrame:
    """turns (conv_id, position, role, text) -> conv_id, formatted, loss_spans; one row per conversation.

    Turns are ordered by position, then role and text; null roles and texts are
    empty ones, and a null conv_id is a conversation. loss_spans are the places
    (start from 0, length, in code points) of the assistant's texts in formatted.
    A conversation is one string, so its turns meet in one task, once.
    """
    said = turns.select(
        "conv_id", "position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"head": F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), "body": escape(F.col("text"))})
    order = Window.partitionBy("conv_id").orderBy("position", "role", "text")
    before = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = said.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("nth"),
            F.concat("head", "body", F.lit(END)).alias("piece"),
            F.when(F.col("role") == LOSS_ROLE, F.struct((before + F.length("head")).alias("start"), F.length("body").cast("bigint").alias("length"))).alias("span"),
        ).alias("t"),
    )
    pieces = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return pieces.select("conv_id", F.array_join(F.col("t")["piece"], "").alias("formatted"), F.filter(F.col("t")["span"], lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The canonical turns that a formatted string was made of."""
    parts = F.filter(F.split(formatted, r"\Q" + START + r"\E"), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        head = F.locate("\n", part)
        text = F.substring(part, head + 1, F.length(part) - head - len(END))
        return F.struct(unescape_role(F.substring(part, F.lit(1), head - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def under_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(turns: DataFrame) -> DataFrame:
    """turns (conv_id, position, role, text) -> one row of digests per conversation, read from the formatted strings and their loss masks."""
    done = render(turns)
    read = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def conversation_digests(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, ...), a turn each -> one row of digests per conversation.

    Each row goes through the mapping of its layout, nulls and all, and the
    template. Null roles and texts are empty ones. Repeated rows are repeated
    turns; other columns are not read.
    """
    flat = rows.select("conv_id", "turn", "role", "text")
    turns = canonical(flat, ["role", "text"], "conv_id", "turn").select("conv_id", F.col("turn").alias("position"), F.explode("turns").alias("t"))
    return digests(turns.select("conv_id", "position", "t.role", "t.text"))


def in_many_layouts(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, ...) -> the same conversations in one table of four layouts, by conv_id modulo four.

    Rows of a turn each (with position), and rows of a whole conversation as
    messages of role and content, of role and text, or as conversations of from
    and value.
    """
    kind = F.pmod(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)), F.lit(4))
    single = rows.where(kind == 0).select("conv_id", F.col("turn").alias("position"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(which: int, column: str, role: str, text: str) -> DataFrame:
        turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        lists = rows.where(kind == which).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
        return lists.select("conv_id", F.transform("all", lambda x: F.struct(x["role"].alias(role), x["text"].alias(text))).alias(column))

    content, texts = whole(1, "messages", "role", "content"), whole(2, "messages", "role", "text")
    empty = F.lit(None).cast("string")
    content = content.select("conv_id", F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), empty.alias("text"))).alias("messages"))
    texts = texts.select("conv_id", F.transform("messages", lambda x: F.struct(x["role"].alias("role"), empty.alias("content"), x["text"].alias("text"))).alias("messages"))
    values = whole(3, "conversations", "from", "value")
    return single.unionByName(content, True).unionByName(texts, True).unionByName(values, True)


def layout_digests(rows: DataFrame) -> DataFrame:
    """Digests of conversations in any known layouts: rows (conv_id, position where a row is a turn, fields of layouts)."""
    fields = [c for c in rows.columns if c not in ("conv_id", "position")]
    turns = canonical(rows, fields, "conv_id", "position").select("conv_id", "position", F.posexplode("turns").alias("nth", "t"))
    return digests(turns.select("conv_id", F.coalesce(F.col("position").cast("bigint"), F.col("nth").cast("bigint")).alias("position"), "t.role", "t.text"))


def _escaped_sql(text: str, role: bool = False) -> str:
    text = f"replace({text}, '{ESCAPE}', '{ESCAPE + KEPT}')"
    for control in CONTROL:
        text = f"replace({text}, '{control}', '{control[0] + ESCAPE + BROKEN + control[1:]}')"
    return f"replace({text}, chr(10), '{ESCAPE + LINE}')" if role else text


#: What conversation_digests() returns for a view conversations and the probe, in SQL.
SQL = f"""with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -1, t, case when t = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(t))
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = '{LOSS_ROLE}'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{LOSS_ROLE}'), '')) as loss_sha256,
 cast(sum({len(START) + 1 + len(END)} + length({_escaped_sql('role', True)}) + length({_escaped_sql('text')})) as bigint) as formatted_chars
from said group by conv_id"""
