"""Chat formatting by schema fingerprint, in DataFrame functions only.

The nested field paths of a record, from the schema of its parsed JSON at any depth, are reduced to the slots that some
layout knows: a slot stands for its path and all below it, and other paths are extras. The sorted slots, hashed, are
the record's fingerprint. Each mapping declares required and optional slots, so it has a fingerprint for each choice of
its optional slots; the one that has the record's fingerprint, or else the first one whose required slots are all
there, turns the record into (role, text) turns. A table's schema is reduced in the same way.

The template writes each turn as <|im_start|>role, newline, text, <|im_end|>, newline. In texts a backslash is doubled
and "<|" becomes "<\\|", so no text can hold a mark, and both are undone on reading; a role is percent-encoded. The loss
mask lists the spans, in code points of the formatted string, of the assistant's texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import columns_but, fresh, let

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
#: Turns of a record that row_records() makes, and characters after which it begins another one.
RECORD_TURNS, RECORD_CHARS = 64, 400_000
#: Characters of JSON that are parsed as a variant, which has a size limit; a longer record, which holds a very long
#: text, is parsed by the type of all layouts and takes the same way by fingerprint and mapping.
VARIANT_CHARS = 4_000_000
#: Elements that offsets() sums one by one.
_RUN = 256


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all leaves; [] stands for an array's elements and {} for a map's values."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, f"{at}{{}}")
    return [at]


def fingerprint(slots) -> str:
    return hashlib.md5("\n".join(sorted(slots)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """A layout: the slots that it needs and may have, and how its turns are made.

    An item of turns is (role, slots), the texts of the slots that are there joined by newlines; or (list slot, role
    field, text field), a turn for each element of a list.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple, ...] = ()
    #: Whether the list's roles have names of their own, as ROLES says.
    renamed: bool = False

    def keys(self) -> list[str]:
        chosen = (c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n))
        return [fingerprint({*self.required, *c}) for c in chosen]


_SYSTEM = ("system", ("system",))
#: Layouts by record, the first that fits before others; the layout of rows by turn is ROWS.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), ("system",), (_SYSTEM, ("messages", "role", "content"))),
    Mapping("shared", ("conversations[].from", "conversations[].value"), ("system",), (_SYSTEM, ("conversations", "from", "value")), renamed=True),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction-response", ("instruction", "response"), ("input", "system"), (_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("response",)))),
    Mapping("prompt", ("completion", "prompt"), ("system",), (_SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt-response", ("prompt", "response"), ("system",), (_SYSTEM, ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", ("answer", "question"), ("system",), (_SYSTEM, ("user", ("question",)), ("assistant", ("answer",)))),
)
ROWS = Mapping("rows", ("conv_id", "role", "text", "turn"))
SLOTS = sorted({s for m in MAPPINGS for s in (*m.required, *m.optional)})
#: Roles by the names that some layouts give them: fixed values of those formats.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def variant_paths(kind: Column) -> Column:
    """The paths of all leaves of a type as schema_of_variant() writes it, at any depth; null where it is no object.

    The type is read token by token: a name says where the next value stands, "<" goes into it and ">" out of it.
    """
    name = r"`(?:[^`]|``)*`: |[A-Za-z_][A-Za-z0-9_]*: "
    tokens = F.regexp_extract_all(kind, F.lit(name + r"|OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]*\))?"), F.lit(0))
    state = "struct<inside:array<string>,at:string,paths:array<string>>"

    def step(a: Column, x: Column) -> Column:
        top = F.coalesce(F.get(a["inside"], F.size(a["inside"]) - 1), F.lit(""))
        bare = F.regexp_replace(F.substr(x, F.lit(1), F.length(x) - 2), r"^`|`$", "")
        named = F.when(top == "", bare).otherwise(F.concat(top, F.lit("."), bare))
        into = F.when(x == "ARRAY<", F.concat(a["at"], F.lit("[]"))).otherwise(a["at"])
        pushed = F.struct(F.concat(a["inside"], F.array(into)).alias("inside"), into.alias("at"), a["paths"].alias("paths"))
        popped = F.struct(F.slice(a["inside"], 1, F.greatest(F.size(a["inside"]) - 1, F.lit(0))).alias("inside"), a["at"].alias("at"), a["paths"].alias("paths"))
        here = F.struct(a["inside"].alias("inside"), named.alias("at"), a["paths"].alias("paths"))
        leaf = F.struct(a["inside"].alias("inside"), a["at"].alias("at"), F.concat(a["paths"], F.array(a["at"])).alias("paths"))
        next_ = F.when(x.endswith("<"), pushed).when(x == ">", popped).when(x.endswith(": "), here).otherwise(leaf)
        return next_.cast(state)

    none = F.struct(F.array().alias("inside"), F.lit("").alias("at"), F.array().alias("paths")).cast(state)
    return F.when(kind.startswith("OBJECT<"), F.aggregate(tokens, none, step, lambda a: a["paths"]))


def known_slots(paths: Column) -> Column:
    """The sorted slots that paths fill. An empty list fills all slots of its elements."""

    def fills(p: Column, s: str) -> Column:
        return (p == s) | p.startswith(f"{s}.") | p.startswith(f"{s}[") | (p.endswith("[]") & F.lit(s).startswith(F.concat(p, F.lit("."))))

    def slot(p: Column, s: str) -> Column:
        return F.when(F.exists(p, lambda x: fills(x, s)), F.lit(s))

    def found(p: Column) -> Column:
        return F.array_compact(F.array(*[slot(p, s) for s in SLOTS]))

    return F.when(paths.isNotNull(), let(paths, found))


def chosen_mapping(slots: Column) -> Column:
    """The name of the mapping that has the fingerprint of slots, or else of the first whose required slots are there."""
    by_key: dict[str, str] = {}
    for m in MAPPINGS:
        for k in m.keys():
            by_key.setdefault(k, m.name)
    table = F.create_map(*[F.lit(x) for pair in by_key.items() for x in pair])

    def chosen(s: Column) -> Column:
        held = [F.when(F.size(F.array_intersect(s, F.array(*map(F.lit, m.required)))) == len(m.required), m.name) for m in MAPPINGS]
        return F.coalesce(F.element_at(table, F.md5(F.array_join(s, "\n"))), *held)

    return F.when(slots.isNotNull(), let(slots, chosen))


def value_text(v: Column) -> Column:
    """The text of a variant: a string as it is, the texts of a list's parts in a row, an object's text, content or value."""
    get = lambda x, path: F.try_variant_get(x, path, "string")
    of = lambda x: F.coalesce(get(x, "$.text"), get(x, "$.content"), get(x, "$.value"))
    part = lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT<"), F.coalesce(of(x), F.lit(""))).otherwise(F.coalesce(get(x, "$"), F.lit("")))
    kind = F.schema_of_variant(v)
    parts = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), part), "")
    return F.when(kind.startswith("ARRAY<"), parts).when(kind.startswith("OBJECT<"), F.coalesce(of(v), get(v, "$"))).otherwise(get(v, "$"))


def _list_turns(record: Column, slot: str, role: str, text: str, renamed: bool) -> Column:
    """A turn for each element of a record's list."""
    usual = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def turn(x: Column) -> Column:
        raw = F.try_variant_get(x, f"$.{role}", "string")
        named = F.coalesce(F.element_at(usual, F.lower(raw)), raw) if renamed else raw
        return F.struct(named.alias("role"), value_text(F.try_variant_get(x, f"$.{text}", "variant")).alias("text"))

    return F.transform(F.coalesce(F.try_variant_get(record, f"$.{slot}", "array<variant>"), F.array().cast("array<variant>")), turn)


def _one_turn(record: Column, role: str, slots: tuple[str, ...]) -> Column:
    """A turn of the texts of slots joined by newlines, those after the first only where they are not empty; or none."""
    first, *others = [value_text(F.try_variant_get(record, f"$.{s}", "variant")) for s in slots]
    text = F.concat_ws("\n", first, *[F.when(t != "", t) for t in others]) if others else first
    return F.filter(F.array(F.struct(F.lit(role).alias("role"), text.alias("text"))), lambda x: x["text"].isNotNull())


def _mapped(m: Mapping, record: Column) -> Column:
    """The turns of a record, a variant, by a mapping."""
    got = [_list_turns(record, *item, m.renamed) if len(item) == 3 else _one_turn(record, *item) for item in m.turns]
    return F.concat(*[g.cast(TURNS) for g in got])


#: The fields of all layouts, texts as strings.
TYPED = "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, " + ", ".join(
    f"{f} string" for f in ("system", "instruction", "input", "output", "response", "prompt", "completion", "question", "answer", "torn")
)


def _typed_slots(typed: Column) -> Column:
    """The slots that are there in a record of type TYPED; an empty list fills all slots of its elements."""

    def there(s: str) -> Column:
        at, _, inner = s.partition("[].")
        if not inner:
            return typed[s].isNotNull()
        return typed[at].isNotNull() & ((F.size(typed[at]) == 0) | F.exists(typed[at], lambda x: x[inner].isNotNull()))

    return F.when(typed.isNotNull() & typed["torn"].isNull(), F.array_compact(F.array(*[F.when(there(s), F.lit(s)) for s in SLOTS])))


def _typed_turns(m: Mapping, typed: Column) -> Column:
    """The turns of a record of type TYPED by a mapping."""
    usual = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    named = lambda role: F.coalesce(F.element_at(usual, F.lower(role)), role) if m.renamed else role
    got = []
    for item in m.turns:
        if len(item) == 3:
            slot, role, text = item
            got.append(F.transform(typed[slot], lambda x: F.struct(named(x[role]).alias("role"), x[text].alias("text"))))
        else:
            role, (first, *others) = item
            text = F.concat_ws("\n", typed[first], *[F.when(typed[o] != "", typed[o]) for o in others]) if others else typed[first]
            got.append(F.filter(F.array(F.struct(F.lit(role).alias("role"), text.alias("text"))), lambda x: x["text"].isNotNull()))
    return F.concat(*[g.cast(TURNS) for g in got])


def json_turns(records: DataFrame, column: str) -> DataFrame:
    """records with `layout` and `turns`, from a column of JSON; columns of these names, in any case, are replaced.

    Fields beside a layout's are ignored, at any depth. Texts may be strings, lists of parts, or objects with a text. Both
    columns are null where the JSON is null or torn, or fits no layout; an empty list of turns is a layout without turns.
    In a record of more than VARIANT_CHARS characters, texts are strings, or the JSON of what stands there.
    """
    v, typed, layout = (fresh(records, x) for x in ("record_variant", "record_typed", "record_layout"))
    long = F.length(column) > VARIANT_CHARS
    parsed = records.withColumn(v, F.try_parse_json(F.when(~long, F.col(column))))
    parsed = parsed.withColumn(typed, F.from_json(F.when(long, F.col(column)), TYPED, {"columnNameOfCorruptRecord": "torn"}))
    paths = variant_paths(F.schema_of_variant(v))
    slots = let(paths, lambda p: F.coalesce(known_slots(p), _typed_slots(F.col(typed))))
    named = parsed.withColumn(layout, let(slots, chosen_mapping))
    turns = F.coalesce(*[F.when(F.col(layout) == m.name, F.when(F.col(v).isNotNull(), _mapped(m, F.col(v))).otherwise(_typed_turns(m, F.col(typed)))) for m in MAPPINGS])
    return named.select(*columns_but(records, "layout", "turns"), F.col(layout).alias("layout"), turns.alias("turns"))


def table_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table whose schema is a known layout: rows by turn, or one conversation a row with conv_id.

    Rows by turn are ordered by turn, nulls first, ties by role and text; null roles and texts are empty. Columns beside
    the layout's are ignored.
    """
    paths = field_paths(rows.schema)
    if fingerprint(p for p in paths if p in ROWS.required) == ROWS.keys()[0]:
        turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
        return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    if not any(p == "conv_id" for p in paths):
        raise ValueError(f"no mapping for the paths {sorted(paths)}")
    record = F.to_json(F.struct(*columns_but(rows, "conv_id")))
    return json_turns(rows.select("conv_id", record.alias("record")), "record").select("conv_id", "turns")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def offsets(sizes: Column) -> Column:
    """For each of an array of bigint, the sum of those before it: runs of _RUN are summed first, so the time is linear."""
    zero = F.lit(0).cast("long")

    def before(xs: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, none, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(_RUN))
    runs = F.transform(starts, lambda i: F.slice(sizes, i, F.lit(_RUN)))

    def joined(r: Column) -> Column:
        totals = before(F.transform(r, lambda x: F.aggregate(x, zero, lambda a, y: a + y)), zero)
        return F.flatten(F.transform(F.arrays_zip(r.alias("r"), totals.alias("t")), lambda z: before(z["r"], z["t"])))

    return let(runs, joined)


def formatted(chats: DataFrame) -> DataFrame:
    """chats (conv_id, turns, ...) with `formatted` and `loss_spans`, array<struct<start,end>> in code points.

    Null roles and texts count as empty; null turns give an empty string. Columns of these names, in any case, are
    replaced. A conversation is one value of its task, however long; the time is linear in its turns.
    """
    head = lambda x: F.concat(F.lit(START), F.url_encode(F.coalesce(x["role"], F.lit(""))), F.lit("\n"))
    part = lambda x: F.struct(head(x).alias("h"), escaped(F.coalesce(x["text"], F.lit(""))).alias("t"), (x["role"] == "assistant").alias("loss"))
    tail = f"{END}\n"
    parts = F.transform(F.coalesce("turns", F.array().cast(TURNS)), part)

    def written(p: Column) -> Column:
        sizes = F.transform(p, lambda x: (F.length(x["h"]) + F.length(x["t"]) + len(tail)).cast("long"))
        spans = F.transform(F.arrays_zip(p.alias("p"), offsets(sizes).alias("at")), lambda z: F.struct(z["p"]["loss"].alias("loss"), (z["at"] + F.length(z["p"]["h"])).alias("start"), F.length(z["p"]["t"]).alias("n")))
        kept = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("end")))
        text = F.array_join(F.transform(p, lambda x: F.concat(x["h"], x["t"], F.lit(tail))), "")
        return F.struct(text.alias("formatted"), kept.alias("loss_spans"))

    made = fresh(chats, "written")
    return chats.withColumn(made, let(parts, written)).select(*columns_but(chats, "formatted", "loss_spans"), f"{made}.*")


def read_back(chats: DataFrame) -> DataFrame:
    """chats with `read`, the turns (role, text, loss) parsed from `formatted` and `loss_spans` alone."""
    pieces = F.filter(F.split("formatted", r"\Q" + START + r"\E"), lambda x, i: i > 0)

    def marked(p: Column) -> Column:
        """(start of the text, whether the mask holds it) of each piece in order: both lists of starts are sorted together."""
        own = F.transform(F.arrays_zip(p.alias("p"), offsets(F.transform(p, lambda x: (F.length(x) + len(START)).cast("long"))).alias("at")), lambda z: F.struct((z["at"] + len(START) + F.instr(z["p"], "\n")).alias("s"), F.lit(1).alias("k")))
        mask = F.transform("loss_spans", lambda x: F.struct(x["start"].alias("s"), F.lit(0).alias("k")))

        def flags(z: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                last = F.get(z, i - 1)
                return F.struct(x["k"].alias("k"), F.coalesce((last["s"] == x["s"]) & (last["k"] == 0), F.lit(False)).alias("loss"))

            return F.transform(F.filter(F.transform(z, one), lambda x: x["k"] == 1), lambda x: x["loss"])

        return F.arrays_zip(p.alias("p"), let(F.array_sort(F.concat(own, mask)), flags).alias("loss"))

    def turn(x: Column) -> Column:
        head = F.instr(x["p"], "\n")
        text = F.substring(x["p"], head + 1, F.length(x["p"]) - head - len(END) - 1)
        return F.struct(F.url_decode(F.substring(x["p"], F.lit(1), head - 1)).alias("role"), unescaped(text).alias("text"), x["loss"].alias("loss"))

    return chats.withColumn("read", F.transform(let(pieces, marked), turn))


def row_records(rows: DataFrame) -> DataFrame:
    """(conv_id, part, turns) of rows by turn: a conversation's turns in order, cut into parts of a bounded number of turns
    and, but for a single long text, of characters."""
    turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = (F.length("role") + F.length("text")).cast("long")
    nth = clean.withColumn("nth", F.row_number().over(turn) - 1).withColumn("until", F.sum(size).over(turn.rowsBetween(Window.unboundedPreceding, -1)))
    part = F.struct(F.floor(F.col("nth") / RECORD_TURNS).alias("turns"), F.floor(F.coalesce("until", F.lit(0)) / RECORD_CHARS).alias("chars"))
    grouped = nth.withColumn("part", part).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("nth", "role", "text"))).alias("t"))
    return grouped.select("conv_id", "part", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def as_records(chats: DataFrame) -> DataFrame:
    """chats (conv_id, turns) with `record`, each conversation as JSON of a layout that its number chooses.

    Messages with a number beside them, messages with texts in parts, shared conversations with nested extras, and
    prompts where a user and an assistant speak once. A role that a shared layout would rename takes messages, and so does
    what holds a text that is too long for a variant.
    """
    turns, which = F.col("turns"), F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))
    many = lambda of: F.to_json(of, {"ignoreNullFields": "false"})
    message = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))
    parted = lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content"))
    shared = lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))
    plain = many(F.struct(F.transform(turns, message).alias("messages"), F.lit(1).alias("id")))
    parts = many(F.struct(F.transform(turns, parted).alias("messages")))
    others = many(F.struct(F.transform(turns, shared).alias("conversations"), F.struct(F.lit("x").alias("tag")).alias("meta")))
    prompt = many(F.struct(F.struct(F.get(turns, F.lit(0))["text"].alias("text")).alias("prompt"), F.get(turns, F.lit(1))["text"].alias("response")))
    renamed = F.exists(turns, lambda x: F.lower(x["role"]).isin(list(ROLES)))
    spoken = F.array_join(F.transform(turns, lambda x: F.when(x["role"].contains(","), "-").otherwise(x["role"])), ",") == "user,assistant"
    size = F.aggregate(turns, F.lit(0).cast("long"), lambda a, x: a + F.length(x["role"]) + F.length(x["text"]))
    chosen = F.when(8 * size > VARIANT_CHARS, plain)  # a character may take six in JSON
    chosen = chosen.when(spoken & (which == 0), prompt).when(which == 1, parts).when((which == 2) & ~renamed, others).otherwise(plain)
    return chats.withColumn("record", chosen)


def chat_digests(conversations: DataFrame) -> DataFrame:
    """One row a conversation, read back from its formatted string, plus conversation -1 with marks in its texts.

    Rows are ordered within their conversation, which is cut into records of a bounded number of turns; these are laid
    out in several layouts, each is mapped by its own fingerprint, and the turns are put together again. A null conv_id is a conversation; null roles and texts are empty; repeated rows are turns of
    their own; an empty table leaves conversation -1. A conversation's string and digest are one value, so its turns
    meet in one task, however long. Other columns are ignored.
    """
    spark, tricky = conversations.sparkSession, f"{END}{START}assistant ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    two = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(tricky).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(two)
    turns = json_turns(as_records(row_records(rows)).drop("turns"), "record").select("conv_id", "part", "turns")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "turns"))).alias("parts"))
    chats = whole.select("conv_id", F.flatten(F.transform("parts", lambda x: x["turns"])).alias("turns"))
    back = read_back(formatted(chats))
    lines = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("read", lambda x: x["loss"]), lambda x: x["text"]), "")
    return back.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL for chat_digests(); lengths follow the template: marks, role, text with what the escapes add.
SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(24 + length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) as bigint) as formatted_chars
from t group by conv_id
"""
