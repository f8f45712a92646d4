"""The old side of a patch, and what changed between two snapshots of a file's symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.operators.build import symbol_id
from ripplet.operators.diffs import HEADER, HUNK, changed_lines, enclosing

#: Kinds of events, and the kind of change that they make.
STRUCTURAL = ("METHOD_REMOVED", "METHOD_ADDED", "FUNCTION_REMOVED", "FUNCTION_ADDED", "CLASS_REMOVED", "CLASS_ADDED")
INTERFACE = ("SIGNATURE_CHANGED", "PARAMETER_ADDED", "PARAMETER_REMOVED", "RETURN_TYPE_CHANGED")

EVENT = "struct<kind:string,detail:string,from:string,to:string>"
KEYS = ["change", "path"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with a value that is worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hunks(patch: Column) -> Column:
    """The hunks of a patch, as they stand in it: at (where a hunk's new side begins, from 0; -1 for that of a deleted file), size (lines
    of its new side) and old (the lines of its old side). Lines before the first hunk, file headers, and lines of no known kind
    aren't in it."""
    empty = lambda x: x == ""

    def one(lines: Column, heads: Column, k: Column) -> Column:
        first = F.get(heads, k)
        last = F.coalesce(F.get(heads, k + 1), F.size(lines))
        held = F.filter(F.slice(lines, first + 2, last - first - 1), lambda x: (x.rlike("^[+ -]") | empty(x)) & ~x.rlike(HEADER))
        at = F.regexp_extract(F.get(lines, first), HUNK, 2).cast("long") - 1
        size = lambda body: F.size(F.filter(body, lambda x: x.rlike("^[+ ]") | empty(x))).cast("long")
        old = lambda body: F.transform(F.filter(body, lambda x: x.rlike("^[- ]") | empty(x)), lambda x: F.substring(x, 2, 2**31 - 1))
        return _let(held, lambda body: F.struct(at.alias("at"), size(body).alias("size"), old(body).alias("old")))

    def of(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(HUNK), i)), lambda i: i.isNotNull())
        return _let(heads, lambda found: F.transform(found, lambda _, k: one(lines, found, k)))

    return _let(F.split(patch, "\r?\n"), of)


def _before(text: Column, found: Column) -> Column:
    """The lines of a text before hunks that rise: each hunk's old lines stand for those of its new side."""
    # Lines up to the furthest end of the hunks so far are gone.
    reach = lambda ends, h: F.array_append(ends, F.greatest(F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)), h["at"] + h["size"]))
    ends = F.aggregate(found, F.array().cast("array<bigint>"), reach)

    def part(h: Column, i: Column, done: Column) -> Column:
        end = F.get(done, i)
        stop = F.coalesce(F.get(found, i + 1)["at"], F.size(text).cast("long"))
        return F.concat(h["old"], F.slice(text, (end + 1).cast("int"), F.greatest(F.lit(0), stop - end).cast("int")))

    parts = _let(ends, lambda done: F.flatten(F.transform(found, lambda h, i: part(h, i, done))))
    return F.concat(F.slice(text, F.lit(1), F.get(found, F.lit(0))["at"].cast("int")), parts)


def old_sides(changed: DataFrame) -> DataFrame:
    """(change, path, content, old_content) of changed files (change, path, patch, content): the text before the patch, null if
    there is no patch or no hunk in it.

    A hunk's place in the new text is where its header says, for as many lines as it has on the new side; whether the text
    there is that of the hunk isn't asked. Those lines go, and the hunk's old lines stand before the line that comes next. A
    hunk that begins at new line 0 is of a deleted file: its old lines are all there is. Hunks that don't rise are sorted. All
    is worked out within a row, so nothing is shuffled and a task holds one file at a time. Null text is empty.
    """
    found = changed.select(*KEYS, "content", hunks(F.col("patch")).alias("hunks"))
    gone = F.filter("hunks", lambda h: h["at"] < 0)
    numbered = F.transform("hunks", lambda h, k: F.struct(h["at"].alias("at"), k.alias("k"), h["size"].alias("size"), h["old"].alias("old")))
    text = F.split(F.coalesce("content", F.lit("")), "\n")
    whole = _let(text, lambda t: _let(F.array_sort(numbered), lambda h: _before(t, h)))
    lines = F.when(F.size(gone) > 0, F.get(gone, F.size(gone) - 1)["old"]).otherwise(whole)
    return found.select(*KEYS, "content", F.when(F.size("hunks") > 0, F.array_join(lines, "\n")).alias("old_content"))


def changed_symbols(changed: DataFrame, symbols: DataFrame, old_symbols: DataFrame) -> DataFrame:
    """(change, path, kind, owner, name) of the symbols around changed lines: the new side's lines among symbols, the old side's
    among old_symbols (change, path, kind, owner, name, start_line, end_line). A symbol that both sides name is one row."""
    lines = changed_lines(changed.select(*KEYS, "patch"))
    found = None
    for side, table in (("new", symbols), ("old", old_symbols)):
        here = enclosing(lines.where(F.col("side") == side), table).select(*KEYS, "kind", "owner", "name")
        found = here if found is None else found.unionByName(here)
    return found.distinct()


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def symbol_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """The events between two snapshots of symbols: change, path, symbol_id, owner, name, kind, detail, from, to.

    Snapshots have change, path, kind (FUNCTION, METHOD, CLASS), owner (a method's class), name, parameters ("name:type"),
    return_type, calls, body; a symbol's id is unique in its change and file. A symbol of one side only was added or removed. Of one
    of both sides: each parameter and call that only one side has; another return type; another signature, if parameters or
    return type changed and the parameters aren't the same in the same order; another body. Classes are added or removed only.
    detail is a parameter or callee; from and to are return types, or parameters joined by "|". Null lists are empty, null
    return types and bodies are empty texts; a null owner is a value like others.
    """
    ident = symbol_id(F.col("kind"), F.col("path"), F.col("owner"), F.col("name"))
    fields = ("owner", "name", "kind", "parameters", "return_type", "calls", "body")
    one = old.select(*KEYS, ident.alias("symbol_id"), F.struct(*fields).alias("o")).alias("a")
    two = new.select(*KEYS, ident.alias("symbol_id"), F.struct(*fields).alias("n")).alias("b")
    on = F.expr("a.change <=> b.change and a.path <=> b.path and a.symbol_id <=> b.symbol_id")
    keys = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in (*KEYS, "symbol_id")]
    both = one.join(two, on, "full_outer").select(*keys, "o", "n")
    none = F.lit(None).cast("string")
    event = lambda kind, detail=none, before=none, after=none: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), detail.alias("detail"), before.alias("from"), after.alias("to")).cast(EVENT)
    each = lambda kind, a, b: F.transform(F.array_except(_list(a), _list(b)), lambda x: event(kind, x))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = [F.array_join(_list(f"{s}.parameters"), "|") for s in "on"]
    returns = text("o.return_type") != text("n.return_type")
    sets = (F.size(F.array_except(_list("o.parameters"), _list("n.parameters"))) > 0) | (F.size(F.array_except(_list("n.parameters"), _list("o.parameters"))) > 0)
    when = lambda c, e: F.array_compact(F.array(F.when(c, e)))
    inside = F.concat(
        each("PARAMETER_ADDED", "n.parameters", "o.parameters"),
        each("PARAMETER_REMOVED", "o.parameters", "n.parameters"),
        when(returns, event("RETURN_TYPE_CHANGED", none, text("o.return_type"), text("n.return_type"))),
        when((sets | returns) & (joined[0] != joined[1]), event("SIGNATURE_CHANGED", none, *joined)),
        each("CALL_ADDED", "n.calls", "o.calls"),
        each("CALL_REMOVED", "o.calls", "n.calls"),
        when(text("o.body") != text("n.body"), event("BODY_CHANGED")),
    )
    classes = (F.col("o.kind") == "CLASS") | (F.col("n.kind") == "CLASS")
    events = (
        F.when(F.col("n").isNull(), F.array(event(F.concat("o.kind", F.lit("_REMOVED")))))
        .when(F.col("o").isNull(), F.array(event(F.concat("n.kind", F.lit("_ADDED")))))
        .when(classes, F.array().cast(f"array<{EVENT}>"))
        .otherwise(inside)
    )
    shown = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("owner", "name")]
    return both.select(*KEYS, "symbol_id", *shown, F.explode(events).alias("e")).select(*KEYS, "symbol_id", "owner", "name", "e.*")


def semantic_diff(changed: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol_events() of changed files (change, path, content, old_content, patch). Where there is no old content, or the old
    is the new, snapshots can't tell: each symbol of the new snapshot about a changed line gets BODY_CHANGED. Snapshots also
    have start_line and end_line."""
    blind = changed.where("old_content is null or old_content = '' or old_content <=> content")
    seen = changed.join(blind.select(*KEYS), KEYS, "left_anti").select(*KEYS)
    events = symbol_events(old.join(seen, KEYS, "left_semi"), new.join(seen, KEYS, "left_semi"))
    spans = [*KEYS, "kind", "owner", "name", "start_line", "end_line"]
    about = changed_symbols(blind.select(*KEYS, "patch"), new.select(*spans), new.select(*spans).limit(0))
    ident = symbol_id(F.col("kind"), F.col("path"), F.col("owner"), F.col("name")).alias("symbol_id")
    none = [F.lit(None).cast("string").alias(c) for c in ("detail", "from", "to")]
    return events.unionByName(about.select(*KEYS, ident, "owner", "name", F.lit("BODY_CHANGED").alias("kind"), *none))


def change_categories(events: DataFrame) -> DataFrame:
    """(change, path, category): structural events come before those of interfaces, and these before all others."""
    row = events.groupBy(*KEYS).agg(F.bool_or(F.col("kind").isin(*STRUCTURAL)).alias("s"), F.bool_or(F.col("kind").isin(*INTERFACE)).alias("i"))
    return row.select(*KEYS, F.when(F.col("s"), "STRUCTURAL").when(F.col("i"), "INTERFACE").otherwise("BEHAVIORAL").alias("category"))
