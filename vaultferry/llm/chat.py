"""Chat formatting with tool-call linking, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.llm.support import stored
from vaultferry.operators.lookups import with_position

# Layers of calls that are kept apart before they are written together; no limit of rounds.
ROUNDS = 64


@dataclass(frozen=True)
class Param:
    """One argument of a tool: JSON type, whether it must be there, and its bounds.

    ``least`` and ``most`` bound a number's value or a string's characters; ``one_of`` lists
    the values a string may have.
    """

    kind: str  # string, integer, number, boolean, array or object
    required: bool = True
    least: float | None = None
    most: float | None = None
    one_of: Sequence[str] | None = None


Schema = Mapping[str, Param]

# JSON types by the names Spark gives to parsed values.
VARIANT_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
}


def _problem(value: Column, name: str, param: Param) -> Column:
    """First fault of one argument, null if it has none. ``value`` is the parsed object."""
    path = f"$['{name}']"
    found = F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(found)
    missing = found.isNull() | (kind == "VOID")
    fault = F.when(missing, F.lit(f"{name}: missing") if param.required else F.lit(None))
    fault = fault.when(
        ~missing & ~kind.rlike(VARIANT_TYPES[param.kind]), F.lit(f"{name}: not {param.kind}")
    )
    if param.kind == "string":
        size = F.char_length(F.try_variant_get(value, path, "string"))
    else:
        size = F.try_variant_get(value, path, "double")
    if param.least is not None:
        fault = fault.when(~missing & (size < param.least), F.lit(f"{name}: below {param.least:g}"))
    if param.most is not None:
        fault = fault.when(~missing & (size > param.most), F.lit(f"{name}: above {param.most:g}"))
    if param.one_of is not None:
        listed = F.try_variant_get(value, path, "string").isin(*param.one_of)
        fault = fault.when(~missing & ~listed, F.lit(f"{name}: not listed"))
    return fault


def argument_fault(tool: Column, arguments: Column, schemas: Mapping[str, Schema]) -> Column:
    """First fault of a call, null if it is valid: unknown tool, arguments that are no JSON
    object, an argument that breaks its schema (in the schema's order), or one not in it."""
    value = F.try_parse_json(arguments)
    broken = value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT<")
    fault = F.when(tool.isNull() | ~tool.isin(*schemas), F.lit("unknown tool"))
    fault = fault.when(broken, F.lit("arguments: not object"))
    names = F.map_keys(F.from_json(arguments, "map<string,string>"))
    for name, schema in schemas.items():
        faults = [_problem(value, p, param) for p, param in schema.items()]
        extra = F.array_sort(F.array_except(names, F.array(*[F.lit(p) for p in schema])))
        other = F.when(F.size(extra) > 0, F.concat(F.get(extra, 0), F.lit(": not in schema")))
        fault = fault.when(tool == name, F.coalesce(*faults, other))
    return fault


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no white space; null if the text is no JSON."""
    return F.to_json(F.try_parse_json(json))


def linked(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hash-join results to calls by conversation (``conv``) and identifier.

    Of several calls with one identifier the earliest counts, of several results the
    earliest answers. Returns the calls with ``state`` (answered, unanswered or repeated)
    and the results with ``call_turn`` and ``state`` (result, orphan or repeated).
    """
    keys = ["conv", "call_id"]
    seen = calls.groupBy(*keys).agg(F.min("turn").alias("first_call"))
    answer = results.groupBy(*keys).agg(F.min("turn").alias("first_result"))
    named = calls.join(seen, keys, "left").join(answer, keys, "left")
    repeated = F.col("first_call") < F.col("turn")
    marked_calls = named.select(
        *calls.columns,
        F.when(repeated, "repeated")
        .when(F.col("first_result").isNull(), "unanswered")
        .otherwise("answered")
        .alias("state"),
    )
    found = results.join(seen, keys, "left").join(answer, keys, "left")
    marked_results = found.select(
        *results.columns,
        F.col("first_call").alias("call_turn"),
        F.when(F.col("first_call").isNull(), "orphan")
        .when(F.col("first_result") < F.col("turn"), "repeated")
        .otherwise("result")
        .alias("state"),
    )
    return marked_calls, marked_results


def _latest(needs: DataFrame, places: DataFrame) -> DataFrame:
    """``places(conv, call_id, turn)`` with ``ready``: the latest turn of a call and all it needs.

    Turns only grow, up to the last one, so this ends with rings as well. A round looks at
    the calls that need one that has just moved; in logs that are in order the first is the last.
    """
    ready = moved = places.withColumn("ready", F.col("turn"))
    while True:
        there = moved.select("conv", F.col("call_id").alias("need"), F.col("ready").alias("later"))
        late = (
            needs.join(there, ["conv", "need"])
            .groupBy("conv", "call_id")
            .agg(F.max("later").alias("later"))
            .join(ready, ["conv", "call_id"])
            .where("later > ready or (ready is null and later is not null)")
            .select("conv", "call_id", F.col("later").alias("ready"))
        )
        moved = stored(late, "late")
        if moved.isEmpty():
            return ready
        later = moved.withColumnRenamed("ready", "later")
        ready = stored(
            ready.join(later, ["conv", "call_id"], "left").select(
                "conv", "call_id", "turn", F.coalesce("later", "ready").alias("ready")
            ),
            "ready",
        )


def _peeled(ties: DataFrame, end: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Peel off the ties whose ``end`` is no tie's ``other`` end, until there are none.

    Returns the calls of the peeled ties with ``step``, the latest round one of theirs went,
    and the ties that stay: those of rings and of what hangs on them at the other side.
    """
    peeled: DataFrame | None = None
    step = 0
    while True:
        step += 1
        held = ties.select("conv", F.col(other).alias(end), F.lit(True).alias("held")).distinct()
        marked = stored(
            ties.join(held, ["conv", end], "left").select(
                "conv", "call_id", "need", F.coalesce("held", F.lit(False)).alias("held")
            ),
            "ties",
        )
        free = marked.where("not held")
        ties = marked.where("held").drop("held")
        if free.isEmpty():
            break
        layer = free.select("conv", "call_id", F.lit(step).alias("step")).distinct()
        peeled = layer if peeled is None else peeled.union(layer)
        if step % ROUNDS == 0:
            peeled = stored(peeled, "layers")
    if peeled is None:
        peeled = ties.select("conv", "call_id", F.lit(0).alias("step")).limit(0)
    return peeled.groupBy("conv", "call_id").agg(F.max("step").alias("step")), ties


def ordered_calls(calls: DataFrame) -> DataFrame:
    """Calls with ``ready`` and ``step``, the place they can stand at, and ``unsettled``.

    A call follows the calls named in ``after``. ``ready`` is its own turn, or the latest turn
    of what it needs, directly or not, if that comes later. Only calls tied to one they need
    by the same ``ready`` have to be put in order within it: those that need none of the others
    come first, and so on (``step``), however long the chain is. What is never free is on a ring
    or behind one. Calls on a ring, or between two rings of one ``ready``, wait for each other:
    they are ``unsettled``, keep their own turn, and all others are placed by what they need.
    """
    places = stored(calls.groupBy("conv", "call_id").agg(F.min("turn").alias("turn")), "places")
    needs = stored(
        calls.select("conv", "call_id", F.explode("after").alias("need"))
        .where("need is not null and call_id is not null")
        .distinct(),
        "needs",
    )
    rings = None
    while True:
        ready = _latest(needs, places)
        there = ready.select("conv", F.col("call_id").alias("need"), F.col("ready").alias("needed"))
        ties = stored(
            needs.join(there, ["conv", "need"])
            .join(ready, ["conv", "call_id"])
            .where("ready <=> needed")
            .select("conv", "call_id", "need"),
            "tied",
        )
        steps = None
        if ties.isEmpty():
            break
        steps, stuck = _peeled(ties, "need", "call_id")
        if stuck.isEmpty():
            break
        _, ring = _peeled(stuck, "call_id", "need")
        ring = stored(ring.select("conv", "call_id").distinct(), "rings")
        needs = stored(needs.join(ring, ["conv", "call_id"], "left_anti"), "needs")
        rings = ring if rings is None else rings.union(ring)
    placed = ready.drop("turn")
    if steps is None:
        placed = placed.withColumn("step", F.lit(0))
    else:
        placed = placed.join(steps, ["conv", "call_id"], "left")
    if rings is None:
        placed = placed.withColumn("unsettled", F.lit(False))
    else:
        marks = rings.withColumn("unsettled", F.lit(True))
        placed = placed.join(marks, ["conv", "call_id"], "left")
    # A call without an identifier has no place of its own and stays at its turn.
    return calls.join(placed, ["conv", "call_id"], "left").select(
        *calls.columns,
        F.greatest("turn", "ready").alias("ready"),
        F.coalesce("step", F.lit(0)).alias("step"),
        F.coalesce("unsettled", F.lit(False)).alias("unsettled"),
    )


def formatted(
    messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: Mapping[str, Schema]
) -> DataFrame:
    """One row per message, call and result, in an order in which each can be replayed.

    ``messages(conv_id, turn, role, text)``, ``calls(conv_id, turn, call_id, tool, arguments,
    after)`` and ``results(conv_id, turn, call_id, content)``. Returns ``conv_id, position``
    (from 0 per conversation), ``turn, kind, call_id, state, fault, json``. A result follows
    its call and a call the calls it needs, else the turns decide; in one turn messages come
    first, then calls, then results, then by identifier and text.

    Null texts are empty strings and null roles ``unknown``; rows without a conversation are
    one conversation; a result or call without identifier is an orphan or unanswered;
    arguments that are no JSON are kept as a string; repeated rows stay. No conversation is
    gathered: positions come from a range sort, so one of any length is spread over tasks.
    """
    # A struct is not null and equals another with the same field, also if that is null: so
    # joins, ranges and windows all see one conversation in the rows without one.
    conv = F.struct("conv_id").alias("conv")
    messages, calls, results = (
        t.select(conv, *[c for c in t.columns if c != "conv_id"]) for t in (messages, calls, results)
    )
    marked_calls, marked_results = linked(calls, results)
    in_order = stored(ordered_calls(marked_calls), "calls")
    spots = in_order.groupBy("conv", "call_id").agg(
        F.min(F.struct("ready", "step")).alias("spot")
    )
    zero = F.lit(0)
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    said = messages.select(
        "conv",
        "turn",
        F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"),
        F.lit("message").alias("state"),
        F.lit(None).cast("string").alias("fault"),
        F.to_json(F.struct(text.alias("content"), role.alias("role"))).alias("json"),
        F.col("turn").alias("ready"),
        zero.alias("step"),
        zero.alias("rank"),
    )
    fault = F.coalesce(
        F.when(F.col("unsettled"), F.lit("needs do not settle")),
        argument_fault(F.col("tool"), F.col("arguments"), schemas),
    )
    arguments = F.coalesce(canonical(F.col("arguments")), F.to_json(F.array("arguments")))
    quoted = F.when(canonical(F.col("arguments")).isNotNull(), arguments).otherwise(
        F.substring(arguments, 2, F.char_length(arguments) - 2)
    )
    named = F.to_json(
        F.struct(
            F.coalesce("call_id", F.lit("")).alias("id"),
            F.coalesce("tool", F.lit("")).alias("name"),
            F.lit("call").alias("type"),
        )
    )
    asked = in_order.select(
        "conv",
        "turn",
        F.lit("call").alias("kind"),
        "call_id",
        "state",
        fault.alias("fault"),
        F.concat(F.lit('{"arguments":'), quoted, F.lit(","), F.substr(named, F.lit(2))).alias("json"),
        "ready",
        "step",
        F.lit(1).alias("rank"),
    )
    content = F.coalesce(F.col("content"), F.lit(""))
    given = marked_results.join(spots, ["conv", "call_id"], "left").select(
        "conv",
        "turn",
        F.lit("result").alias("kind"),
        "call_id",
        "state",
        F.when(F.col("state") == "orphan", F.lit("no such call")).alias("fault"),
        F.to_json(
            F.struct(
                content.alias("content"),
                F.coalesce("call_id", F.lit("")).alias("id"),
                F.lit("result").alias("type"),
            )
        ).alias("json"),
        F.greatest("turn", "spot.ready").alias("ready"),
        F.when(F.col("spot.ready") >= F.col("turn"), F.col("spot.step")).otherwise(0).alias("step"),
        F.lit(2).alias("rank"),
    )
    rows = said.union(asked).union(given)
    order = ["ready", "step", "rank", "turn", "call_id", "json"]
    return with_position(rows, ["conv"], order, "position").select(
        "conv.conv_id", "position", "turn", "kind", "call_id", "state", "fault", "json"
    )
