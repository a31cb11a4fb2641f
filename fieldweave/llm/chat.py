"""Chat formatting by schema fingerprints, with Spark expressions only.

A record is JSON. Its fingerprint under a layout is a hash of the nested field
paths that the layout reads and of their types, where a null counts as of the
type the layout declares; other fields do not matter. Each layout lists the
fingerprints of the shapes it covers, and the fingerprint selects the mapping
that turns the record into canonical turns (seq, role, text). Of several layouts
that match, the first is taken that leaves out nothing but nulls and empty lists
of the others; if there is none, the record is unmatched. A template marks the turns of a conversation in one string
and escapes control strings inside roles and texts by a backslash, which
``read_back`` takes out again. The loss mask lies on assistant texts.

Null roles and texts are empty, and a null list is an empty one. Turns of one conversation are ordered by seq
(null first), then role and text; repeated rows are repeated turns. A null
conversation id is a conversation of its own. A record of an unknown layout
gives one row of ``unmatched`` and no turn; formatting counts it. Texts may be as long as a row can
hold: a record above the size of a variant (some 16 MB) is read as texts by name instead, whose
types are taken to be the declared ones. Empty tables give no rows; columns
that are not named are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Openings of control strings of public chat templates.
CONTROL = r"(<)([|]|/?s>|</?SYS>)|(\[)(/?INST\])"
TURNS = "array<struct<seq: bigint, role: string, text: string>>"


@dataclass(frozen=True)
class Source:
    """How SQL reads a parsed record: a text or a whole number at a name, and the turns of a list of objects."""

    text: str
    number: str
    items: str
    item_text: str

    def field(self, name: str) -> str:
        return self.text.format(name)

    def turn(self, seq: str, role: str, text: str) -> str:
        return f"named_struct('seq', cast({seq} as bigint), 'role', {role}, 'text', {text})"

    def said(self, seq: int, role: str, text: str) -> str:
        return self.turn(str(seq), f"'{role}'", text)

    def listed(self, name: str, role: str, text: str) -> str:
        return f"transform({self.items.format(name)}, (m, i) -> {self.turn('i', self.item_text.format(role), self.item_text.format(text))})"


ITEMS = "array<map<string, string>>"
#: Strings of any length that a row can hold.
LONG = "map('maxStringLen', '2147483647')"
VARIANT = Source("try_variant_get(v, '$.{0}', 'string')", "try_variant_get(v, '$.{0}', 'bigint')", "try_variant_get(v, '$.{0}', 'array<variant>')", "try_variant_get(m, '$.{0}', 'string')")
#: A record that no variant can hold, as texts by name.
TEXTS = Source("try_element_at(x, '{0}')", "try_cast(try_element_at(x, '{0}') as bigint)", f"from_json(try_element_at(x, '{{0}}'), '{ITEMS}', {LONG})", "try_element_at(m, '{0}')")


@dataclass(frozen=True)
class Layout:
    """A record layout: sample records that show its shapes, and its mapping to turns, as SQL over a source."""

    name: str
    samples: tuple[str, ...]
    turns: Callable[[Source], str]

    @property
    def fields(self) -> dict:
        """The fields that the mapping reads: a type for each, for a list the fields of its members."""
        out: dict = {}
        for sample in map(json.loads, self.samples):
            for name, value in sample.items():
                if isinstance(value, list):
                    out.setdefault(name, set()).update(*value)
                else:
                    out[name] = "BIGINT" if isinstance(value, int) else "STRING"
        return out


def _two(ask: str, tell: str) -> Callable[[Source], str]:
    return lambda s: f"array({s.said(0, 'user', s.field(ask))}, {s.said(1, 'assistant', s.field(tell))})"


def _told(s: Source) -> str:
    """An instruction and its input as one text, and the output."""
    ask = f"concat_ws(char(10), {s.field('instruction')}, nullif({s.field('input')}, ''))"
    return f"array({s.said(0, 'user', ask)}, {s.said(1, 'assistant', s.field('output'))})"


def _public(s: Source) -> str:
    role = "case t.role when 'human' then 'user' when 'gpt' then 'assistant' else t.role end"
    return f"transform({s.listed('conversations', 'from', 'value')}, t -> {s.turn('t.seq', role, 't.text')})"


LAYOUTS = (
    Layout("turn", ('{"turn":1,"role":"a","text":"b"}',), lambda s: f"array({s.turn(s.number.format('turn'), s.field('role'), s.field('text'))})"),
    Layout("prompt", ('{"prompt":"a","completion":"b"}',), _two("prompt", "completion")),
    Layout("response", ('{"prompt":"a","response":"b"}',), _two("prompt", "response")),
    Layout("instruction", ('{"instruction":"a","input":"b","output":"c"}', '{"instruction":"a","output":"c"}'), _told),
    Layout("messages", ('{"messages":[{"role":"a","content":"b"}]}', '{"messages":[]}'), lambda s: s.listed("messages", "role", "content")),
    Layout("conversations", ('{"conversations":[{"from":"a","value":"b"}]}', '{"conversations":[]}'), _public),
)


def _type(value: str, path: str) -> str:
    """SQL of the type at a path of a variant; null if there is none, VOID if it holds a null."""
    return f"schema_of_variant(try_variant_get({value}, '$.{path}', 'variant'))"


def _type_of_text(name: str, kind: str | set) -> str:
    """SQL of the type at a name of the texts ``x``, in the variant's words: what the layouts declare, as texts have none."""
    value = f"try_element_at(x, '{name}')"
    items = TEXTS.items.format(name)
    told = f"'{kind}'" if isinstance(kind, str) else f"case when size({items}) = 0 then 'ARRAY<VOID>' when size({items}) > 0 then 'ARRAY<OBJECT<>>' else 'STRING' end"
    return f"case when map_contains_key(x, '{name}') then case when {value} is null then 'VOID' else {told} end end"


def _members(name: str, path: str) -> str:
    """SQL of the types, other than VOID, of a field of the members of a list; MISSING if no member has it."""
    kinds = f"array_distinct(filter(transform(try_variant_get(v, '$.{name}', 'array<variant>'), m -> {_type('m', path)}), t -> t is not null))"
    told = f"transform(array({kinds}), k -> case when size(k) = 0 then 'MISSING' when k = array('VOID') then 'STRING' else array_join(array_sort(array_remove(k, 'VOID')), '|') end)[0]"
    of_texts = f"case when exists({TEXTS.items.format(name)}, m -> map_contains_key(m, '{path}')) then 'STRING' else 'MISSING' end"
    return f"case when x is null then {told} else {of_texts} end"


def _shape(name: str, kind: str | set) -> Column:
    """The path and types of a field that a layout reads, nulls as of the declared type, from column ``_is_name``."""
    is_, void = F.col(f"_is_{name}"), F.col(f"_is_{name}").isin("VOID", "ARRAY<VOID>")
    if isinstance(kind, str):
        told = F.when(is_ == "VOID", kind).otherwise(is_)
    else:
        inside = F.concat_ws(",", *(F.concat(F.lit(f"{x}:"), F.expr(_members(name, x))) for x in sorted(kind)))
        told = F.when(void, "ARRAY<>").when(is_.startswith("ARRAY<OBJECT<"), F.concat(F.lit("ARRAY<"), inside, F.lit(">"))).otherwise(is_)
    return F.concat(F.lit(f"{name}:"), F.coalesce(told, F.lit("MISSING")))


def fingerprint(layout: Layout) -> Column:
    """Hash of the nested field paths and types that a layout reads, over the columns of ``typed``."""
    return F.xxhash64(*(_shape(name, kind) for name, kind in sorted(layout.fields.items())))


def typed(records: DataFrame, columns: list[Column], record: str, layouts: tuple[Layout, ...]) -> DataFrame:
    """The columns, the record as variant ``v`` or else as texts ``x``, and the type of each field that some layout reads."""
    kinds = {name: kind for layout in layouts for name, kind in layout.fields.items()}
    parsed = records.select(*columns, F.try_parse_json(F.col(record)).alias("v"), F.col(record).alias("_record"))
    texts = F.when(F.col("v").isNull(), F.expr(f"from_json(_record, 'map<string, string>', {LONG})"))
    both = parsed.select("*", texts.alias("x")).drop("_record")
    return both.select("*", *(F.expr(f"case when x is null then {_type('v', name)} else {_type_of_text(name, kinds[name])} end").alias(f"_is_{name}") for name in sorted(kinds)))


def canonical_turns(records: DataFrame, *, key: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, layout, seq, role, text): the turns of each record, by the mapping its fingerprint selects."""
    spark = records.sparkSession
    shapes = spark.createDataFrame([(x.name, s) for x in layouts for s in x.samples], "layout string, sample string")
    marks = [fingerprint(x).alias(f"_mark_{i}") for i, x in enumerate(layouts)]
    known = typed(shapes, [F.col("layout")], "sample", layouts).select("layout", *marks).collect()  # a row for each declared shape
    found = [F.col(f"_mark_{i}").isin([r[f"_mark_{i}"] for r in known if r["layout"] == x.name]) for i, x in enumerate(layouts)]
    marked = typed(records, [F.col(key).alias(key)], record, layouts).select("*", *marks)
    marked = marked.select("*", *(x.alias(f"_fits_{i}") for i, x in enumerate(found)))
    layout, turns = F.lit("unmatched"), F.expr(f"cast(array(named_struct('seq', null, 'role', null, 'text', null)) as {TURNS})")
    for i, x in reversed(list(enumerate(layouts))):
        mine = F.col(f"_fits_{i}")
        for j, other in enumerate(layouts):
            more = [F.coalesce(F.col(f"_is_{name}"), F.lit("VOID")).isin("VOID", "ARRAY<VOID>") for name in sorted(other.fields.keys() - x.fields.keys())]
            for empty in more:
                mine = mine & (~F.col(f"_fits_{j}") | empty)
        layout = F.when(mine, F.lit(x.name)).otherwise(layout)
        turns = F.when(mine, F.when(F.col("x").isNull(), F.expr(x.turns(VARIANT)).cast(TURNS)).otherwise(F.expr(x.turns(TEXTS)).cast(TURNS))).otherwise(turns)
    return marked.select(key, layout.alias("layout"), F.inline(turns).alias("seq", "role", "text"))


def escape(value: Column) -> Column:
    """Double backslashes, then part the control strings by one."""
    return F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescape(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss_mask, unmatched): one marked string for each conversation.

    ``loss_mask`` has an entry (turn, start, length) for each assistant text, in
    code points from the start of that turn's marked piece. ``unmatched`` counts the
    records of the conversation that no layout reads; if all are such, it has no
    marked string (null) and an empty mask.
    """
    piece = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS), escape(F.col("text")), F.lit(END))
    known = F.col("layout") != "unmatched"
    rows = turns.select(
        key,
        known.alias("known"),
        F.struct(
            F.col("seq"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            piece.alias("piece"),
            (F.lit(len(TURN + SAYS)) + F.length(escape(F.col("role")))).alias("start"),
            F.length(escape(F.col("text"))).alias("length"),
        ).alias("t"),
    )
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("known"), F.col("t")))).alias("t"), F.count_if(~F.col("known")).alias("unmatched"))
    marked = F.transform("t", lambda t, i: F.struct(i.alias("turn"), t.start.alias("start"), t.length.alias("length"), (t.role == "assistant").alias("on")))
    return grouped.select(
        key,
        F.when(F.size("t") > 0, F.array_join(F.transform("t", lambda t: t.piece), "")).alias("formatted"),
        F.transform(F.filter(marked, lambda m: m.on), lambda m: F.struct(m.turn, m.start, m.length)).alias("loss_mask"),
        "unmatched",
    )


def read_back(formatted: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """(key, turns array of (role, text), loss_text): what a formatted string says, unescaped; null turns if there is none."""
    pieces = F.split("formatted", F.lit(r"(?<=<\|end\|>)"))
    cut = formatted.select(key, "loss_mask", F.filter(pieces, lambda p: p != "").alias("pieces"))

    def turn(p: Column) -> Column:
        at = F.instr(p, F.lit(SAYS))
        role = F.substring(p, F.lit(len(TURN) + 1), at - len(TURN) - 1)
        text = F.substring(p, at + len(SAYS), F.length(p) - at - len(SAYS) - len(END) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    under = F.transform("loss_mask", lambda m: unescape(F.substring(F.get("pieces", m.turn), m.start + 1, m.length)))
    return cut.select(key, F.transform("pieces", turn).alias("turns"), F.array_join(under, "").alias("loss_text"))
