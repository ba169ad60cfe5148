"""Chat formatting by a grammar round trip.

A conversation becomes one string of turns, each ``### role: body`` followed by a line ``</turn>``. A turn is first
rendered as it is and parsed again; where the parser does not give back the very text, its control strings are escaped
with a backslash, which the parser takes off. The whole string is parsed once more and must equal its source.
All of it is built-in expressions; one shuffle brings a conversation's rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import let

CLOSE = "\n</turn>\n"
_CONTROL = r"(###|</turn>)"


def escape(text: Column) -> Column:
    """A backslash before every control string."""
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(body: Column) -> Column:
    """One backslash less before every control string."""
    return F.regexp_replace(body, r"\\" + _CONTROL, "$1")


def parse_body(body: Column) -> Column:
    """The text of a turn's body; null if the body has a control string that is not escaped."""
    text = unescape(body)
    return F.when(escape(text) == body, text)


def render_body(text: Column) -> Column:
    """The text as it is if the parser recovers it, else escaped."""
    return F.when(parse_body(text).eqNullSafe(text), text).otherwise(escape(text))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text). A malformed turn has null text."""
    pieces = F.split(formatted, CLOSE)
    header = r"^### ([^:]*): "
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            F.try_url_decode(F.regexp_extract(p, header, 1)).alias("role"),
            F.when(p.rlike(header), parse_body(F.regexp_replace(p, header, ""))).alias("text"),
        ),
    )


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: `conv`, n_turns, formatted, loss_mask, turns.

    `loss_mask` is a run-length code of `formatted`: array of (chars, loss), three runs a turn (header, body, close);
    loss is true on the bodies of the roles in `trained`. `turns` holds what the parser recovers from `formatted`.

    Null roles and texts count as empty; a null `conv` is a conversation of its own. Turns are ordered by `turn`
    (null first), ties by role, then text; repeated rows stay. Roles are URL-encoded, so any role survives. Other
    columns are ignored. An empty table gives no rows. A conversation's text is one value, so it must fit in a task.
    """
    rows = df.select(
        F.col(conv).alias("_c"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"),
    )
    chats = rows.groupBy("_c").agg(F.sort_array(F.collect_list("_t")).alias("_s"))
    parts = F.transform("_s", lambda t: F.struct(F.concat(F.lit("### "), F.url_encode(t["role"]), F.lit(": ")).alias("head"), render_body(t["text"]).alias("body"), t["role"].isin(*trained).alias("loss")))
    chats = chats.withColumn("_p", parts)
    chats = chats.withColumn("formatted", F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    run = lambda chars, loss: F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))
    mask = F.flatten(F.transform("_p", lambda p: F.array(run(F.length(p["head"]), F.lit(False)), run(F.length(p["body"]), p["loss"]), run(F.lit(len(CLOSE)), F.lit(False)))))
    turns = parse(F.col("formatted"))
    source = F.transform("_s", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return (
        chats.withColumn("loss_mask", mask)
        .withColumn("_r", turns)
        .withColumn("turns", F.when(F.col("_r").eqNullSafe(source), F.col("_r")).otherwise(F.raise_error(F.lit("a conversation cannot be recovered from its rendering"))))
        .select(F.col("_c").alias(conv), F.size("turns").cast("long").alias("n_turns"), "formatted", "loss_mask", "turns")
    )


def trained_text(formatted: Column, mask: Column) -> Column:
    """What `formatted` says under the mask, escapes taken off: cut out by the mask's run lengths alone.

    Runs are taken in pieces of about the square root of their number: a piece is cut from the whole, its runs from the
    piece, so n runs cost about the square root of n walks over the text, not n."""
    step = F.greatest(F.ceil(F.sqrt(F.size(mask))).cast("int"), F.lit(1))
    zero = F.array(F.lit(0).cast("long"))
    total = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["chars"])
    ends = lambda lengths: F.aggregate(lengths, zero, lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    cut = lambda text, start, chars: F.substring(text, (start + 1).cast("int"), chars.cast("int"))

    def piece(runs: Column, start: Column) -> Column:
        said = lambda t: let(ends(F.transform(runs, lambda r: r["chars"])), lambda at: F.transform(runs, lambda r, j: F.when(r["loss"], unescape(cut(t, F.get(at, j), r["chars"]))).otherwise("")))
        return F.array_join(let(cut(formatted, start, total(runs)), said), "")

    pieces = F.transform(F.sequence(F.lit(0), F.size(mask) - 1, step), lambda i: F.slice(mask, i + 1, step))
    text = let(pieces, lambda p: let(ends(F.transform(p, total)), lambda at: F.array_join(F.transform(p, lambda runs, i: piece(runs, F.get(at, i))), "")))
    return F.when(F.size(mask) > 0, text).otherwise("")


def read_back(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what `format_chats` wrote, taken from its output alone."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = trained_text(F.col("formatted"), F.col("loss_mask"))
    return chats.select(
        conv,
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
