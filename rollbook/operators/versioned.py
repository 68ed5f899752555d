"""Dated full snapshots: validity intervals, the state as of a date, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.schema import snapshot_columns
from rollbook.functions.text import clean, name_key, record_key
from rollbook.operators.identity import keep_first

#: Stretches of days are aligned to this one; so many lengths of them, each twice the one before, are enough for all dates.
DAY_ZERO, LEVELS = "0001-01-01", 22
DIFF_FIELDS = ("category", "first_issue_date", "issue_date", "expiry_date")


def snapshot_rows(raw: DataFrame, date: str, normal: bool = False) -> DataFrame:
    """A snapshot's rows with record and name keys, to append under its date."""
    own = snapshot_columns(raw)
    own = own.withColumn("rec_key", record_key("name", "license_no", "qualification", normal)).withColumn("name_key", name_key("name", normal))
    return own.withColumn("snapshot_date", F.lit(date).cast("date"))


def snapshot_meta(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("snapshot_date").agg(F.count("*").alias("rows"), F.countDistinct("rec_key").alias("records"))


def intervals(snapshots: DataFrame, attributes: tuple[str, ...] = (), named_only: bool = True) -> DataFrame:
    """(rec_key, valid_from, valid_to, attributes): runs of snapshots in a row that hold a key.

    valid_to is the day before the next snapshot, and null for a run that reaches the last; attributes are those of the
    run's last snapshot. The only window over all rows is the numbering of the distinct snapshot dates.
    """
    some = snapshots.where("name is not null") if named_only and "name" in snapshots.columns else snapshots
    dates = snapshots.select("snapshot_date").distinct()
    along = Window.orderBy("snapshot_date")
    dates = dates.withColumn("_n", F.row_number().over(along)).withColumn("_next", F.lead("snapshot_date").over(along))
    # a key's last row of a date: the greatest of its attributes
    once = some.groupBy("rec_key", "snapshot_date").agg(F.max(F.struct(*(attributes or ("rec_key",)))).alias("_a"))
    placed = once.join(dates, "snapshot_date")
    island = F.col("_n") - F.row_number().over(Window.partitionBy("rec_key").orderBy("_n"))
    runs = placed.withColumn("_run", island).groupBy("rec_key", "_run").agg(
        F.min("snapshot_date").alias("valid_from"), F.date_sub(F.max_by("_next", "snapshot_date"), 1).alias("valid_to"), F.max_by("_a", "snapshot_date").alias("_a"))
    return runs.select("rec_key", "valid_from", "valid_to", *(F.col(f"_a.{c}").alias(c) for c in attributes))


def numbered_dates(dates: DataFrame) -> DataFrame:
    """(snapshot_date, n, next) of distinct snapshot dates, one row each."""
    along = Window.orderBy("snapshot_date")
    return dates.select("snapshot_date").distinct().select("snapshot_date", F.row_number().over(along).alias("n"), F.lead("snapshot_date").over(along).alias("next"))


def advanced(stretches: DataFrame, known: DataFrame, incoming: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Stretches (rec_key, first, last, attributes) after more snapshots; a stretch is a run of snapshots in a row that hold
    a key with the same attributes.

    known: the snapshot dates so far. Snapshots may come in any order: a date between others cuts the stretches of keys that
    it does not hold, and joins those on its two sides for keys that it does. A date that comes again adds its rows, and of
    a key's attributes on a date the greatest count. A key's stretches depend on nothing but the key's own and the dates.
    """
    names = list(attributes)
    new = incoming.select("snapshot_date").distinct().join(known.select("snapshot_date").distinct().withColumn("_old", F.lit(True)), "snapshot_date", "left")
    dates = numbered_dates(known.select("snapshot_date").unionByName(incoming.select("snapshot_date"))).drop("next")
    came = new.join(dates, "snapshot_date").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("_old", F.lit(False)).alias("old")))).alias("_came"))  # a row, of the batch's dates
    at = lambda c, n: dates.select(F.col("snapshot_date").alias(c), F.col("n").alias(n))
    placed = stretches.join(at("first", "a"), "first").join(at("last", "b"), "last").crossJoin(F.broadcast(came))
    own = F.filter("_came", lambda d: d["n"].between(F.col("a"), F.col("b")))
    cut = placed.withColumn("_own", own)
    between = F.transform(F.arrays_zip(F.concat(F.array(F.col("a")), F.transform("_own", lambda d: d["n"] + 1)).alias("a"), F.concat(F.transform("_own", lambda d: d["n"] - 1), F.array(F.col("b"))).alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    left = F.filter(between, lambda x: x["a"] <= x["b"])
    held = F.transform(F.filter("_own", lambda d: d["old"]), lambda d: F.struct(d["n"].alias("a"), d["n"].alias("b")))
    value = F.struct(*names) if names else F.struct(F.lit(0).alias("none"))
    pieces = cut.select("rec_key", value.alias("v"), F.explode(F.concat(left, held)).alias("p")).select("rec_key", "v", "p.*")
    points = incoming.join(dates, "snapshot_date").select("rec_key", value.alias("v"), F.col("n").alias("a"), F.col("n").alias("b"))
    # a date's pieces of one key become one, with the greatest attributes
    pieces = pieces.unionByName(points).groupBy("rec_key", "a", "b").agg(F.max("v").alias("v"))
    along = Window.partitionBy("rec_key").orderBy("a")
    starts = ~F.coalesce((F.lag("b").over(along) + 1 == F.col("a")) & F.lag("v").over(along).eqNullSafe(F.col("v")), F.lit(False))
    runs = pieces.withColumn("_new", starts.cast("int")).withColumn("_run", F.sum("_new").over(along)).groupBy("rec_key", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("v").alias("v"))
    out = runs.join(at("first", "a"), "a").join(at("last", "b"), "b")
    return out.select("rec_key", "first", "last", *(F.col(f"v.{c}").alias(c) for c in names))


def intervals_of(stretches: DataFrame, known: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """(rec_key, valid_from, valid_to, attributes), as intervals() has them, of stretches and the snapshot dates."""
    dates = numbered_dates(known)
    at = lambda c, n: dates.select(F.col("snapshot_date").alias(c), F.col("n").alias(n), *([F.col("next").alias("_next")] if c == "last" else []))
    placed = stretches.join(at("first", "a"), "first").join(at("last", "b"), "last")
    along = Window.partitionBy("rec_key").orderBy("a")
    starts = (~F.coalesce(F.lag("b").over(along) + 1 == F.col("a"), F.lit(False))).cast("int")
    runs = placed.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(along)).groupBy("rec_key", "_run").agg(
        F.min("first").alias("valid_from"), F.date_sub(F.max_by("_next", "b"), 1).alias("valid_to"), *(F.max_by(c, "b").alias(c) for c in attributes))
    return runs.drop("_run")


def as_of(runs: DataFrame, date: str) -> DataFrame:
    day = F.lit(date).cast("date")
    return runs.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))


def dyadic_nodes(start: Column, end: Column) -> Column:
    """The aligned stretches of 1, 2, 4, ... days that together are the days from start to end, as (level, node), at most two a
    level. Each day of the stretch lies in exactly one of them."""
    a, b = (F.date_diff(c, F.lit(DAY_ZERO).cast("date")).cast("long") for c in (start, F.date_add(end, 1)))

    def at(level: Column) -> Column:
        low, high = F.ceil(a / F.pow(F.lit(2), level)).cast("long"), F.floor(b / F.pow(F.lit(2), level)).cast("long")
        odd = lambda x: x % 2 == 1
        node = lambda keep, n: F.when(keep & (low < high), F.struct(level.alias("level"), n.alias("node")))
        return F.array(node(odd(low), low), node(odd(high), high - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at)), lambda x: x.isNotNull())


def dyadic_ancestors(day: Column) -> Column:
    """The stretch of each level that a day lies in, as (level, node)."""
    n = F.date_diff(day, F.lit(DAY_ZERO).cast("date")).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: F.struct(level.alias("level"), F.floor(n / F.pow(F.lit(2), level)).cast("long").alias("node")))


def as_of_dates(runs: DataFrame, dates: DataFrame) -> DataFrame:
    """The state at each of several dates (column as_of).

    An interval, cut to the time from the first date to the last, becomes the few aligned stretches that make it up, twice the
    logarithm of its days at most, and a date asks for the stretch of each length that holds it. They meet by equality, and
    every meeting is a row of the result: no pair is looked at in vain, and an interval's length costs nothing.
    """
    ends = dates.agg(F.min("as_of").alias("_first"), F.max("as_of").alias("_last"))  # one row
    start, end = F.greatest("valid_from", "_first"), F.least(F.coalesce("valid_to", "_last"), "_last")
    spread = runs.where("valid_from is not null").crossJoin(F.broadcast(ends)).where(start <= end).withColumn("_at", F.explode(dyadic_nodes(start, end))).drop("_first", "_last")
    return spread.join(dates.select("as_of", F.explode(dyadic_ancestors(F.col("as_of"))).alias("_at")), "_at").drop("_at")


def as_of_list(runs: DataFrame, people: DataFrame, date: str) -> DataFrame:
    """The state with names, by name, qualification and licence."""
    return as_of(runs, date).join(people, "name_key").orderBy("name", "qualification", "license_no")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rec_key, change): keys that one side has and the other has not."""
    a, b = before.select("rec_key").distinct(), after.select("rec_key").distinct()
    return b.join(a, "rec_key", "left_anti").withColumn("change", F.lit("added")).union(a.join(b, "rec_key", "left_anti").withColumn("change", F.lit("removed")))


def preview(current: DataFrame, incoming: DataFrame, fields: tuple[str, ...] = DIFF_FIELDS) -> DataFrame:
    """(rec_key, change, changes): what an incoming snapshot would add, remove and change against open intervals."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    side = lambda df, tag: keep_first(df, ["rec_key"], *fields).select("rec_key", F.lit(True).alias(f"_{tag}"), *(text(c).alias(f"{tag}_{c}") for c in fields))
    both = side(current, "old").join(side(incoming, "new"), "rec_key", "full")
    changed = F.filter(F.array(*(F.when(F.col(f"old_{c}") != F.col(f"new_{c}"), F.concat(F.lit(f"{c}: "), f"old_{c}", F.lit(" -> "), f"new_{c}")) for c in fields)), lambda x: x.isNotNull())
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return both.select("rec_key", kind.alias("change"), F.when(kind == "changed", F.array_join(changed, "; ")).otherwise("").alias("changes")).where("change is not null")


def persons(snapshots: DataFrame) -> DataFrame:
    """(person_id, name_key, name): the first name of each key."""
    out = snapshots.where(clean("name_key").isNotNull()).groupBy("name_key").agg(F.min_by("name", F.struct("snapshot_date", "name")).alias("name"))
    return out.withColumn("person_id", F.sha1("name_key"))


def latest_before(snapshots: DataFrame, date: str) -> DataFrame:
    return snapshots.where(F.col("snapshot_date") <= F.lit(date).cast("date")).agg(F.max("snapshot_date").alias("snapshot_date"))


def history(runs: DataFrame, people: DataFrame, name: str, date: str) -> DataFrame:
    """A person's rows as of a date, the latest expiry and issue first."""
    out = as_of(runs, date).join(people.where(F.col("name") == name), "name_key")
    return out.orderBy(F.col("expiry_date").desc_nulls_last(), F.col("issue_date").desc_nulls_last())
