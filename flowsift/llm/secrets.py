"""Secret scans with multipart credential linking, in DataFrame operations throughout.

Strong findings (``BASE``) are reported as they are. Weak candidates - names that may be access identifiers,
values that may be secrets, endpoints - are reported only in company: an interval join within each document
links parts that lie at most ``scope`` characters apart, and a weak part needs its complement there. The join
looks at the nearest part of each role on either side, so a scope full of parts makes no pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Characters between the nearest ends of two parts that belong together.
SCOPE = 300


@dataclass(frozen=True)
class Kind:
    """A pattern whose matches count from ``least`` characters on, in the whole or in one ``group``."""

    name: str
    role: str
    pattern: str
    group: int
    least: int


# The patterns of the strong kinds.
BASE = (
    Kind("assign", "secret", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Kind("access", "identifier", r"(AKIA[A-Z0-9]+)", 1, 18),
    Kind("hex", "secret", r"([0-9a-f]{16,})", 1, 16),
)
WEAK = (
    Kind("weak_id", "identifier", r"""\b(?i:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""", 1, 3),
    Kind("weak_secret", "secret", r"""\b(?i:pass|pwd|pw|auth|credential|private_?key)["']?\x20*[:=]\x20*["']?([^\x20\x09-\x0D"',;]+)""", 1, 6),
    Kind("endpoint", "endpoint", r"""((?:https?|ftp|jdbc|postgres|mysql|redis|amqp|mongodb)://[^\x20\x09-\x0D"'<>]+)""", 1, 10),
)
#: A weak part stays if parts of all these roles are in scope.
COMPANY = {"weak_id": ("secret",), "weak_secret": ("identifier",), "endpoint": ("identifier", "secret")}


#: Matches that one running sum covers; the sums of stretches of so many are summed up apart.
_STRETCH_BITS = 8
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, kind: Kind, rank: int) -> Column:
    """Leftmost non-overlapping matches that are long enough, as structs (start, rank, end) in characters.

    What lies between the matches comes from splitting at the same pattern, so positions are running sums. A sum that
    gathers its results copies them at each step; it is therefore taken over stretches of matches, then within each.
    """
    regex = F.lit(kind.pattern)
    between = F.transform(F.split(text, kind.pattern, -1), lambda s: F.length(s))
    sized = F.zip_with(F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda s: F.length(s)),
                       F.transform(F.regexp_extract_all(text, regex, F.lit(kind.group)), lambda s: F.length(s)),
                       lambda a, b: F.struct(a.alias("all"), b.alias("part")))
    # The last gap has no match behind it.
    pieces = F.zip_with(between, sized, lambda g, m: F.struct(g.alias("gap"), m["all"].alias("all"), m["part"].alias("part")))
    none = F.array().cast(_SPANS)

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        hit = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + m["all"]).alias("end")))
        return F.struct((start + m["all"]).alias("at"), F.when(m["part"] >= kind.least, F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found"))

    def placed(stretches: Column) -> Column:
        sums = F.transform(stretches, lambda ms: F.aggregate(ms, F.lit(0), lambda n, m: n + m["gap"] + m["all"]))
        begins = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
                             lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]
        return F.flatten(F.zip_with(stretches, begins, lambda ms, at: F.aggregate(ms, F.struct(at.alias("at"), none.alias("found")), add)["found"]))

    def spans(found: Column) -> Column:
        n = F.size(found) - 1
        stretches = F.transform(F.sequence(F.lit(0), F.shiftright(n - 1, _STRETCH_BITS)),
                                lambda i: F.slice(found, F.shiftleft(i, _STRETCH_BITS) + 1, F.least(F.lit(1 << _STRETCH_BITS), n - F.shiftleft(i, _STRETCH_BITS))))
        return F.when(n > 0, _bound(stretches, placed)).otherwise(none)

    return _bound(pieces, spans)


def _named(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    names = F.array(*(F.lit(k.name) for k in kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base, spans) per row.

    ``base`` and ``spans`` are comma-joined ``kind:start:end`` by start, then kind, in characters with the end
    exclusive; ``spans`` adds the weak parts in company that overlap no strong one. A missing or empty text has
    none. Repeated rows and missing keys give rows like any other; other columns are ignored; an empty table gives
    an empty table.
    """
    kinds = BASE + WEAK
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(key).alias("key"), whole.alias("text")).select(
        "key", *(matches(F.col("text"), k, i).alias(k.name) for i, k in enumerate(kinds)))
    weak = F.concat(*(k.name for k in WEAK))
    strong = F.concat(*(k.name for k in BASE))
    # One scan of the texts; what follows works on the spans alone.
    rows = materialise(found.select("key", *(F.size(k.name).alias(f"n_{k.name}") for k in BASE), strong.alias("strong"), weak.alias("weak"))
                       .withColumn("row", F.monotonically_increasing_id()), "parts")

    role = F.element_at(F.array(*(F.lit(k.role) for k in kinds)), F.col("rank") + 1)
    parts = (rows.where(F.size("weak") > 0).select("row", F.explode(F.concat("strong", "weak")).alias("s"))
             .select("row", "s.*").withColumn("role", role))
    # The interval join: of every role, the last part that starts before and the first that starts after.
    order = Window.partitionBy("row").orderBy("start", "rank", "end")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    roles = ("identifier", "secret", "endpoint")
    near = {}
    for r in roles:
        mine = F.col("role") == r
        near[r] = F.coalesce((F.max(F.when(mine, F.col("end"))).over(before) >= F.col("start") - scope), F.lit(False)) | F.coalesce(
            (F.min(F.when(mine, F.col("start"))).over(after) <= F.col("end") + scope), F.lit(False))
    is_strong = F.col("rank") < len(BASE)
    covered = F.coalesce(F.max(F.when(is_strong, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(is_strong, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    judged = parts.select("row", "start", "rank", "end", covered.alias("covered"), *(near[r].alias(r) for r in roles))
    stays = F.lit(False)
    for i, k in enumerate(kinds):
        if k.name in COMPANY:
            needs = F.lit(True)
            for r in COMPANY[k.name]:
                needs = needs & F.col(r)
            stays = stays | ((F.col("rank") == i) & needs)
    linked = (judged.where(stays & ~F.col("covered")).groupBy("row")
              .agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return rows.join(linked, "row", "left").select(
        F.col("key").alias(key), *(F.col(f"n_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE),
        _named(F.col("strong"), kinds).alias("base"), _named(F.concat("strong", F.coalesce("linked", none)), kinds).alias("spans"))
