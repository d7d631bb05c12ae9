"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A template names the machine (which role may follow in which state), the states in
which a conversation may end, and what stands around the text of each role. One
conversation is one array, folded by the machine inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """What stands before and after a turn, and whether its text and its end are trained on."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A machine over roles, the look of each role's turns, and the markers that no text may hold."""

    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "briefed"),
        ("start", "user", "asked"),
        ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    accept: tuple[str, ...] = ("answered",)
    markers: tuple[str, ...] = ("<|im_start|>", "<|im_end|>")
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<|im_start|>system\n", "<|im_end|>\n"),
            "user": Role("<|im_start|>user\n", "<|im_end|>\n"),
            "assistant": Role("<|im_start|>assistant\n", "<|im_end|>\n", loss=True),
        }
    )


def _pick(of: Column, values: dict) -> Column:
    """The value for what of is, null for none."""
    out = F.lit(None)
    for key, value in values.items():
        out = F.when(of == key, F.lit(value)).otherwise(out)
    return out


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, segment, turn, role, text, loss, error) of each conversation.

    A conversation that the machine takes gives three segments for each turn, up to
    the last turn at which it may end. Before the text of a turn nothing is trained
    on; its text and what ends it are where the role says so. Each turn after that one
    gives one row with its text and the error "trailing", not to be trained on.
    Any other conversation gives one row without text, with the error: "turn" (a null
    turn number, or different rows of one number), "text" (a null text), "marker" (a
    text that holds a marker of the template, by which it could forge a turn), "order"
    (a null or unknown role, or one that may not come there), "end" (it never comes to
    an end). Repeated rows count once, rows without conv_id are left out, an empty text
    is a text, a very long one is taken whole, an empty table gives an empty result,
    other columns are not read. A conversation is one array of one task.
    """
    each = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    # one shuffle: repeated rows go where they lie, and again where they meet
    packed = each.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("t"))
    moves = {f"{a}\x00{role}": to for a, role, to in template.moves}

    def step(at: Column, turn: Column) -> Column:
        to = F.coalesce(_pick(F.concat(at["state"], F.lit("\x00"), turn["role"]), moves), F.lit("\x00"))
        taken = at["taken"] + 1
        return F.struct(
            to.alias("state"), taken.alias("taken"),
            F.when(to.isin(*template.accept), taken).otherwise(at["good"]).alias("good"),
            F.when((at["bad"] == 0) & (to == "\x00"), taken).otherwise(at["bad"]).alias("bad"),
        )

    zero = F.lit(0)
    first = F.struct(F.lit(template.start).alias("state"), zero.alias("taken"), zero.alias("good"), zero.alias("bad"))
    folded = packed.withColumn("end", F.aggregate("t", first, step))

    def forged(turn: Column) -> Column:
        return reduce(lambda a, b: a | b, (turn["text"].contains(m) for m in template.markers), F.lit(False))

    error = (
        F.when(F.exists("t", lambda x: x["turn"].isNull()) | (F.size("t") != F.size(F.array_distinct("t.turn"))), "turn")
        .when(F.exists("t", lambda x: x["text"].isNull()), "text")
        .when(F.exists("t", forged), "marker")
        .when(F.col("end.bad") > 0, "order")
        .when(F.col("end.good") == 0, "end")
    )

    def part(turn: Column, text: Column, loss: Column, error: Column) -> Column:
        return F.struct(turn["turn"].alias("turn"), turn["role"].alias("role"), text.alias("text"), loss.alias("loss"), error.alias("error"))

    none = F.lit(None).cast("string")

    def three(turn: Column) -> Column:
        role = turn["role"]
        trained = F.coalesce(_pick(role, {k: r.loss for k, r in template.roles.items()}), F.lit(False))
        before = F.coalesce(_pick(role, {k: r.before for k, r in template.roles.items()}), F.lit(""))
        after = F.coalesce(_pick(role, {k: r.after for k, r in template.roles.items()}), F.lit(""))
        return F.array(part(turn, before, F.lit(False), none), part(turn, turn["text"], trained, none), part(turn, after, trained, none))

    kind = turns.schema["turn"].dataType.simpleString()
    nothing = F.expr(f"array(named_struct('turn', cast(null as {kind}), 'role', cast(null as string), 'text', cast(null as string), 'loss', false, 'error', error))")
    good = F.col("end.good")
    taken = F.flatten(F.transform(F.slice("t", F.lit(1), good), three))
    later = F.transform(F.slice("t", good + 1, F.size("t")), lambda x: part(x, x["text"], F.lit(False), F.lit("trailing")))
    out = folded.withColumn("error", error).withColumn("s", F.when(F.col("error").isNull(), F.concat(taken, later)).otherwise(nothing))
    return out.select("conv_id", F.posexplode("s").alias("segment", "p")).select("conv_id", "segment", "p.turn", "p.role", "p.text", "p.loss", "p.error")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the whole conversations table."""
    return segments(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH each_turn AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS previous FROM each_turn
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
judged AS (
  SELECT conv_id,
    CASE WHEN count(*) > count(DISTINCT turn) THEN 'turn'
         WHEN count(*) > count(text) THEN 'text'
         WHEN bool_or(contains(text, '<|im_start|>') OR contains(text, '<|im_end|>')) THEN 'marker'
         WHEN NOT bool_and(coalesce(CASE WHEN place = 1 THEN role IN ('system', 'user')
           WHEN previous IN ('system', 'assistant') THEN role = 'user'
           WHEN previous = 'user' THEN role = 'assistant' END, false)) THEN 'order'
         WHEN NOT bool_or(role = 'assistant') THEN 'end' END AS error,
    max(CASE WHEN role = 'assistant' THEN place END) AS good
  FROM placed GROUP BY conv_id),
parts AS (SELECT unnest([0, 1, 2]) AS part)
SELECT conv_id, CAST((place - 1) * 3 + part AS INTEGER) AS segment, turn, role,
  CASE part WHEN 0 THEN '<|im_start|>' || role || chr(10) WHEN 1 THEN text ELSE '<|im_end|>' || chr(10) END AS text,
  part > 0 AND role = 'assistant' AS loss, error
FROM placed JOIN judged USING (conv_id), parts WHERE error IS NULL AND place <= good
UNION ALL
SELECT conv_id, CAST(good * 3 + place - good - 1 AS INTEGER), turn, role, text, false, 'trailing' FROM placed JOIN judged USING (conv_id) WHERE error IS NULL AND place > good
UNION ALL
SELECT conv_id, 0, NULL, NULL, NULL, false, error FROM judged WHERE error IS NOT NULL
"""
