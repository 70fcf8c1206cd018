"""Chat formatting with schema fingerprints, in DataFrame functions alone.

A record is a JSON text of any layout. The nested paths of its fields are
hashed, and the hashes select the first of the declarative mappings whose own
paths are all among them; other fields do not matter. The mapping turns the
layout into canonical turns, an array of (role, text). Turns are then written in
a template of control strings; control strings that occur inside a text get a
backslash, which reading takes away again, so that any text survives. The loss
mask is a list of spans of the formatted text. Time is near linear in the
length of a conversation.

Defined cases: null roles and texts are empty; a system text beside the turns
(``SYSTEM``) comes first, as a turn of its own, unless it is empty; a content
that is a list of parts is the texts of the parts, and a part without a text
stands as its JSON, as does any other content that is no text; known fields that
a mapping does not take are named in ``left_over``; a record whose paths no
mapping has, and one that is not JSON, has null turns and null output
(``layout_counts`` tells how many of each); one of ``LARGE`` bytes or more that
cannot be parsed is an error, for a limit of the parser cannot be told from bad
JSON there; a record without turns is the empty text; repeated records are
formatted each for itself; an empty table gives an empty result; other columns
pass through, but for those with the names of new columns and of steps on the way
(``__variant``, ``__paths``, ``__hashes``, ``__layout``, ``__pieces`` and the lists'),
which are replaced or dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, cut, running_sums, text_blocks

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other common templates, without their first character: fixed values.
CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|/?s>|/?INST\]|/?SYS>|\|[a-z_]+\|>"
TURNS = "array<struct<role:string,text:string>>"
#: Bytes of a JSON text from which the limits of a variant (128 MB) or of its parser may be met.
LARGE = 16 << 20
#: Fields of a record: texts, system texts, lists of turns; and fields of a turn, the role's and the text's by preference.
TEXTS = ("prompt", "completion", "response", "question", "answer", "instruction", "input", "output")
SYSTEM = ("system", "system_prompt")
LISTS = ("turns", "messages", "conversations", "conversation")
ROLES, CONTENTS = ("role", "from"), ("content", "value", "text")
#: Roles that records with a field ``from`` call otherwise.
RENAMED = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def get(value: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({value}, '{path}', '{kind}')"


def text_of(value: str) -> str:
    """A content as text: as it is, the texts of its parts, or its JSON."""
    part = f"coalesce({get('p', '$.text', 'string')}, {get('p', '$', 'string')}, '')"
    return f"coalesce(array_join(transform({get(value, '$', 'array<variant>')}, p -> {part}), ''), {get(value, '$', 'string')})"


@dataclass(frozen=True)
class Layout:
    """A record layout: alternatives of field paths, of each of which it needs one, what it takes, and the SQL of its
    mapping from ``__variant``, and from its list of turns in a column of the list's name, to turns."""

    name: str
    needs: tuple[tuple[str, ...], ...]
    takes: tuple[str, ...]
    turns: str


def _list(field: str) -> list[Layout]:
    """A list of turns, and an empty one."""
    inside = lambda names: tuple(f"{field}[].{n}" for n in names)
    said = get("m", "$.from", "string")
    named = f"CASE {said} {' '.join(f'WHEN {old!r} THEN {new!r}' for old, new in RENAMED.items())} ELSE {said} END"
    text = ", ".join(text_of(get("m", f"$.{c}")) for c in CONTENTS)
    return [
        Layout(field, (inside(ROLES), inside(CONTENTS)), inside(ROLES), f"transform(__{field}, m -> struct(coalesce({get('m', '$.role', 'string')}, {named}) AS role, coalesce({text}) AS text))"),
        Layout(f"{field}_empty", ((f"{field}[]empty",),), (f"{field}[]empty",), f"CAST(array() AS {TURNS})"),
    ]


def _pair(question: str, answer: str, more: str | None = None) -> Layout:
    """Two texts, a question and an answer; ``more`` goes below the question."""
    of = lambda field: text_of(get("__variant", f"$.{field}"))
    asked = f"concat_ws('\\n\\n', {of(question)}, nullif({of(more)}, ''))" if more else of(question)
    fields = tuple(x for x in (question, more, answer) if x)
    return Layout("_".join(fields), tuple((x,) for x in fields), fields, f"array(struct('user' AS role, {asked} AS text), struct('assistant' AS role, {of(answer)} AS text))")


#: In order of preference.
LAYOUTS = (
    *(x for f in LISTS for x in _list(f)[:1]),
    _pair("instruction", "output", "input"),
    _pair("instruction", "output"),
    _pair("instruction", "response"),
    _pair("prompt", "completion"),
    _pair("prompt", "response"),
    _pair("prompt", "output"),
    _pair("question", "answer"),
    _pair("question", "response"),
    *(x for f in LISTS for x in _list(f)[1:]),
)


def list_paths(field: str) -> str:
    """The paths below a list of turns; none if the record has no such list."""
    having = ", ".join(f"CASE WHEN exists(__{field}, t -> {get('t', f'$.{n}')} IS NOT NULL) THEN '{field}[].{n}' END" for n in (*ROLES, *CONTENTS))
    return f"CASE WHEN __{field} IS NULL THEN CAST(array() AS array<string>) ELSE array(CASE WHEN size(__{field}) = 0 THEN '{field}[]empty' END, {having}) END"


def field_paths() -> str:
    """The nested paths of the fields of a record that some layout knows."""
    texts = ", ".join(f"CASE WHEN {get('__variant', f'$.{f}')} IS NOT NULL THEN '{f}' END" for f in (*TEXTS, *SYSTEM))
    return f"array_compact(concat(array({texts}), {', '.join(map(list_paths, LISTS))}))"


def _strings(values: tuple[str, ...] | list[str]) -> str:
    return f"array({', '.join(map(repr, values))})"


def canonical_turns(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout_fingerprint``, ``layout``, ``turns`` and ``left_over``."""
    lost = (F.octet_length(record_col) >= LARGE) & F.col("__variant").isNull()
    failed = F.raise_error(F.concat(F.lit("a record cannot be parsed; its bytes: "), F.octet_length(record_col).cast("string"))).cast("array<string>")
    # a step each, so that what is used more than once is computed once
    found = records.withColumn("__variant", F.try_parse_json(F.col(record_col)))
    found = found.withColumns({f"__{f}": F.expr(get("__variant", f"$.{f}", "array<variant>")) for f in LISTS})
    found = found.withColumn("__paths", F.when(lost, failed).when(F.col("__variant").isNotNull(), F.expr(field_paths())))
    found = found.withColumn("__hashes", F.expr("transform(__paths, p -> xxhash64(p))"))

    fits = lambda layout: " AND ".join(f"arrays_overlap(__hashes, array({', '.join(f'xxhash64({p!r})' for p in either)}))" for either in layout.needs)
    found = found.withColumn("__layout", F.expr(f"CASE {' '.join(f'WHEN {fits(x)} THEN {i}' for i, x in enumerate(layouts))} END"))

    def left(layout: Layout) -> str:
        contents = [p for either in layout.needs[1:] if "[]" in either[0] for p in either]
        first = f"slice(filter({_strings(contents)}, p -> array_contains(__paths, p)), 1, 1)" if contents else "CAST(array() AS array<string>)"
        return f"array_except(__paths, concat({_strings([*layout.takes, *SYSTEM])}, {first}))"

    def by_layout(of: Callable[[Layout], str], other: str) -> str:
        return f"CASE __layout {' '.join(f'WHEN {i} THEN {of(x)}' for i, x in enumerate(layouts))} ELSE {other} END"

    system = ", ".join(f"struct('system' AS role, {text_of(get('__variant', f'$.{f}'))} AS text)" for f in SYSTEM)
    has_system = " OR ".join(f"array_contains(__paths, '{f}')" for f in SYSTEM)
    before = f"CASE WHEN {has_system} THEN filter(array({system}), t -> length(t.text) > 0) ELSE CAST(array() AS {TURNS}) END"
    found = found.withColumn("turns", F.expr(by_layout(lambda x: x.turns, "NULL"))).withColumns(
        {
            "turns": F.expr(f"concat({before}, transform(turns, t -> struct(coalesce(t.role, '') AS role, coalesce(t.text, '') AS text)))"),
            "layout_fingerprint": F.expr("CASE WHEN size(__paths) > 0 THEN xxhash64(array_join(__paths, ' ')) END"),
            "layout": F.expr(by_layout(lambda x: f"'{x.name}'", "NULL")),
            "left_over": F.expr(by_layout(left, "__paths")),
        }
    )
    return found.drop("__variant", "__paths", "__hashes", "__layout", *[f"__{f}" for f in LISTS])


def layout_counts(found: DataFrame) -> DataFrame:
    """``(layout, n, left_over)``: how many records of ``canonical_turns`` each layout took, null for those that none
    did, and how many of them have known fields that the layout did not take."""
    return found.groupBy("layout").agg(F.count("*").alias("n"), F.count_if(F.size("left_over") > 0).alias("left_over"))


def escape(text: Column) -> Column:
    """One backslash more after the first character of every control string."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of escape: one backslash less."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def format_turns(chats: DataFrame, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """``chats`` with ``formatted`` and ``loss_spans`` (start, end: code points of ``formatted``, end exclusive)."""
    pieces = F.transform(
        turns_col,
        lambda t: F.struct(
            F.concat(F.lit(BEGIN), F.url_encode(t["role"]), F.lit("\n")).alias("head"),
            F.concat(escape(t["text"]), F.lit(END)).alias("body"),
            (t["role"] == loss_role).alias("loss"),
        ),
    )

    def spans(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: (F.length(p["head"]) + F.length(p["body"])).cast("long"))
        placed = F.zip_with(pieces, running_sums(lengths), lambda p, stop: F.struct((stop - F.length(p["body"])).cast("int").alias("start"), (stop - len(END)).cast("int").alias("end"), p["loss"].alias("loss")))
        return F.transform(F.filter(placed, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    done = bound(pieces, lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"])), "").alias("formatted"), spans(ps).alias("loss_spans")))
    out = chats.withColumn("__pieces", F.when(F.col(turns_col).isNotNull(), done))
    return out.withColumns({c: F.col("__pieces")[c] for c in ("formatted", "loss_spans")}).drop("__pieces")


def read_turns(formatted: str = "formatted") -> Column:
    """The turns of a formatted text: the inverse of the template."""
    pieces = F.slice(F.split(F.col(formatted), r"<\|im_end\|>\n"), 1, F.size(F.split(F.col(formatted), r"<\|im_end\|>\n")) - 1)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, len(BEGIN) + 1, 2147483647)
        role = F.substring_index(inner, "\n", 1)
        return F.struct(F.url_decode(role).alias("role"), unescape(F.substring(inner, F.length(role) + 2, F.lit(2147483647))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    read = bound(text_blocks(F.col(formatted)), lambda blocks: F.array_join(F.transform(spans, lambda s: unescape(cut(blocks, s["start"], s["end"]))), ""))
    return F.when(F.col(formatted).isNotNull(), read)


def records_of_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conversation, record)``: a conversation's rows as one JSON record of layout ``turns``, by turn, ties by role and text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(row)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy(F.col(conv_col).alias("conversation")).agg(F.to_json(F.struct(turns.alias("turns"))).alias("record"))


def record_of_row(key: Column, role: Column, text: Column) -> Column:
    """One row as a JSON record in one of the list layouts, by a hash of its conversation; layouts that rename roles take none of those."""
    layout = F.pmod(F.xxhash64(key), F.lit(3))
    lists = [F.struct(key.cast("string").alias("id"), F.array(F.struct(role.alias(r), text.alias(t))).alias(field)) for field, r, t in (("turns", "role", "text"), ("messages", "role", "content"), ("conversations", "from", "value"))]
    renamed = role.isin("human", "gpt", "bot")
    return F.when((layout == 2) & ~renamed, F.to_json(lists[2])).when(layout == 1, F.to_json(lists[1])).otherwise(F.to_json(lists[0]))


def turns_of_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conversation, turns)``: each row is a record with one turn, in one of several layouts, and is
    parsed by itself, so that the limits of a variant bind a turn and not a conversation;
    a conversation's turns are put together after that, by turn, ties by role and text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    records = rows.select(F.col(conv_col).alias("conversation"), F.col(turn_col).alias("turn"), record_of_row(F.col(conv_col), empty(role_col), empty(text_col)).alias("record"))
    found = canonical_turns(records, "record")
    first = F.when(F.size("turns") == 1, F.col("turns")[0]).otherwise(F.raise_error(F.lit("a row that no layout takes")))
    row = found.select("conversation", "turn", first.alias("said")).select("conversation", F.struct("turn", "said.role", "said.text").alias("row"))
    turns = F.transform(F.array_sort(F.collect_list("row")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return row.groupBy("conversation").agg(turns.alias("turns"))
