"""Chat formatting: a declarative template, a turn-order state machine and a loss mask.

Only DataFrame functions are used. Turns of a conversation are gathered in slices of
``SLICE_TURNS`` turn numbers first; a slice yields its text segments and, for the state machine,
the *map* from every entry state to the state after the slice. Maps compose, so the conversation
level joins slices without looking at turns again. What is left per conversation is its own text,
which one output row holds by definition.

Edge cases: a NULL text is empty; a NULL role is the empty role; rows are taken by
(turn, role, text) with NULLs first, so ties and repeated rows keep all their rows in a defined
order; a NULL ``conv_id`` is one conversation of its own; an empty table gives no rows; other
columns are ignored.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_TURNS = 256
ESC = "\\"


@dataclass(frozen=True)
class Mark:
    """How one role's turns are written; ``loss`` marks the text itself (never the marks)."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles with their marks, and the turn-order machine as (state, role) -> next state.

    Every control string starts with a character that none holds at a later place, so the leftmost
    unescaped control string is always the right one when the output is read back.
    Roles without marks of their own are written with ``other``, their name between ``name`` marks.
    """

    roles: dict[str, Mark] = field(default_factory=dict)
    other: Mark = Mark("[TURN]", "[/TURN]")
    name: Mark = Mark("[ROLE]", "[/ROLE]")
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    start: str = "start"
    final: tuple[str, ...] = ()

    @property
    def controls(self) -> list[str]:
        marks = [*self.roles.values(), self.other, self.name]
        return sorted({s for m in marks for s in (m.open, m.close)})

    @property
    def states(self) -> list[str]:
        seen = {self.start, *self.final}
        for (a, _), b in self.moves.items():
            seen |= {a, b}
        return sorted(seen)

    def check(self) -> None:
        """Raise ValueError if the control strings could not be read back."""
        firsts = {c[0] for c in self.controls}
        for c in self.controls:
            if not c or ESC in c or any(x in firsts for x in c[1:]) or any(o != c and o.startswith(c) for o in self.controls):
                raise ValueError(f"control string {c!r} cannot be told apart")
        marks = [*self.roles.values(), self.other, self.name]
        if len({m.open for m in marks}) < len(marks):
            raise ValueError("two roles share an opening mark")


# user -> assistant -> user ...; a system row may come first, tool rows follow an assistant row
INSTRUCT = Template(
    roles={
        "system": Mark("[SYS]", "[/SYS]"),
        "user": Mark("[INST]", "[/INST]"),
        "assistant": Mark("[OUT]", "</s>", loss=True),
        "tool": Mark("[TOOL]", "[/TOOL]"),
    },
    moves={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
        ("assistant", "tool"): "tool",
        ("tool", "tool"): "tool",
        ("tool", "assistant"): "assistant",
    },
    final=("assistant",),
)


def _any(strings) -> str:
    return "|".join(re.escape(s) for s in strings)


def _heads(t: Template) -> str:
    return "|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in t.controls)


def escape(text: Column, t: Template) -> Column:
    """Wherever a control string's first character is followed by any number of backslashes and its
    rest, put one backslash more between them: no control string is left, and taking one away
    again restores every text, whatever backslashes it held."""
    return F.regexp_replace(text, _heads(t), r"$0\\")


def unescape(text: Column, t: Template) -> Column:
    heads = "|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in t.controls)
    return F.regexp_replace(text, heads, "")


def _segments(turn: Column, t: Template) -> Column:
    """The segments (text, loss) of one turn."""
    seg = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    body = escape(turn["text"], t)
    out = F.array(
        seg(F.lit(t.other.open + t.name.open)),
        seg(escape(turn["role"], t)),
        seg(F.lit(t.name.close)),
        seg(body, t.other.loss),
        seg(F.lit(t.other.close)),
    )
    for role, m in t.roles.items():
        out = F.when(turn["role"] == role, F.array(seg(F.lit(m.open)), seg(body, m.loss), seg(F.lit(m.close)))).otherwise(out)
    return out


def _walk(entry: int, roles: Column, t: Template) -> Column:
    """State after ``roles`` when entering in state number ``entry``; -1 is the dead state."""
    number = {s: i for i, s in enumerate(t.states)}
    table = F.create_map(*[F.lit(x) for (a, r), b in t.moves.items() for x in (f"{number[a]} {r}", number[b])])
    step = lambda s, r: F.coalesce(F.element_at(table, F.concat(s.cast("string"), F.lit(" "), r)), F.lit(-1))
    return F.aggregate(roles, F.lit(entry), step)


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation: ``conv_id, n_rows long, segments array<struct<text, loss>>,
    formatted string, valid boolean``. ``formatted`` is the segments' texts one after another;
    ``valid`` says that the state machine accepts the order of the roles (nothing is dropped)."""
    template.check()
    t, n = template, len(template.states)
    rows = conversations.select(
        "conv_id",
        F.floor(F.col("turn") / SLICE_TURNS).alias("slice"),
        F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("row"),
    )
    slices = (
        rows.groupBy("conv_id", "slice")
        .agg(F.sort_array(F.collect_list("row")).alias("turns"))
        .select(
            "conv_id", "slice",
            F.size("turns").cast("long").alias("n"),
            F.flatten(F.transform("turns", lambda x: _segments(x, t))).alias("segments"),
            F.array(*[_walk(i, F.transform("turns", lambda x: x["role"]), t) for i in range(n)]).alias("moves"),
        )
    )
    whole = slices.groupBy("conv_id").agg(
        F.sum("n").alias("n_rows"),
        F.sort_array(F.collect_list(F.struct("slice", "segments", "moves"))).alias("parts"),
    )
    start, final = t.states.index(t.start), [t.states.index(s) for s in t.final]
    end = F.aggregate(
        "parts", F.lit(start), lambda s, p: F.when(s < 0, s).otherwise(F.element_at(p["moves"], F.greatest(s, F.lit(0)) + 1))
    )
    return whole.select(
        "conv_id", "n_rows", F.flatten(F.transform("parts", lambda p: p["segments"])).alias("segments"),
        end.isin(final).alias("valid"),
    ).select(
        "conv_id", "n_rows", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid",
    )


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns array<struct<role, text>> of a formatted text, unescaped."""
    t = template
    opens = {m.open: r for r, m in t.roles.items()}
    one = rf"(?s)(?:{_any([*opens, t.other.open])}).*?(?:{_any([m.close for m in (*t.roles.values(), t.other)])})"

    def parse(s: Column) -> Column:
        named = re.escape(t.other.open + t.name.open)
        out = F.struct(
            unescape(F.regexp_extract(s, rf"(?s)^{named}(.*?){re.escape(t.name.close)}", 1), t).alias("role"),
            unescape(F.regexp_extract(s, rf"(?s)^{named}.*?{re.escape(t.name.close)}(.*){re.escape(t.other.close)}$", 1), t).alias("text"),
        )
        for o, role in opens.items():
            m = t.roles[role]
            body = s.substr(F.lit(len(m.open) + 1), F.char_length(s) - len(m.open) - len(m.close))
            out = F.when(s.startswith(m.open), F.struct(F.lit(role).alias("role"), unescape(body, t).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(one), F.lit(0)), parse)


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
