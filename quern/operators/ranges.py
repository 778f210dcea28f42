"""Windows and pages over lists of any length: a list is dealt over tasks by ranges of its order.

A window over one huge list is one task. Here each range of the list (a piece) has windows of its own, and what a row needs from
the rows outside its piece is carried over: the last or next value, the last one that isn't null, a count, a sum. Carries come
from one row for each piece and list. Pages go by the same ranges: counts say which pieces hold a page, and only these are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import table

PIECE, PLACE = "__piece", "__place"


def _pieces(spark: SparkSession, pieces: int | None) -> int:
    return pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, within: list[str], order: list[Column], pieces: int | None = None) -> DataFrame:
    """``df`` as a table with each row's piece; ``order`` must tell any two rows of a list apart."""
    n = _pieces(df.sparkSession, pieces)
    ranged = df.repartitionByRange(n, *[F.col(c).asc() for c in within], *order)
    return table(ranged.withColumn(PIECE, F.spark_partition_id()), "ranges")


def next_known(name: str, w) -> Column:
    """The next value of a column that isn't null, in one pass: a frame up to the end of the list is folded anew for every row."""
    return F.expr(f"lead(`{name}`) IGNORE NULLS").over(w)


class Carried:
    """Columns that look along each list of ``df`` (rows of equal ``within``, by ``order``).

    Ask for columns with ``lag``, ``lead``, ``before``, ``after``, ``total`` and ``place``; ``rows`` gives the rows with them.
    """

    def __init__(self, df: DataFrame, within: list[str], order: list[Column], pieces: int | None = None):
        self.columns = df.columns
        self.within = within or ["__list"]
        # A list of all rows: a column of the table, so that the windows over pieces are dealt by it like any other.
        df = df if within else df.withColumn("__list", F.lit(0))
        self.placed = dealt(df, self.within, order, pieces)
        self.local = Window.partitionBy(*self.within, PIECE).orderBy(*order)
        self.over = Window.partitionBy(*self.within).orderBy(PIECE)
        self.before_rows = (Window.unboundedPreceding, -1)
        self.looked: dict[str, Column] = {}
        self.inner: dict[str, Column] = {}
        self.ends: dict[str, Column] = {}
        self.carry: dict[str, Column] = {}
        self.out: dict[str, Column] = {}

    def lag(self, name: str, value: Column) -> Carried:
        """The value of the row before."""
        self._own(name, value, F.lag(value).over(self.local), F.max_by(value, PLACE), lambda end: F.lag(end).over(self.over))
        self.out[name] = F.when(F.col(PLACE) == 1, F.col(f"__c_{name}")).otherwise(F.col(f"__i_{name}"))
        return self

    def lead(self, name: str, value: Column) -> Carried:
        """The value of the next row."""
        self._own(name, value, F.lead(value).over(self.local), F.min_by(value, PLACE), lambda end: F.lead(end).over(self.over))
        self.out[name] = F.when(F.col(PLACE) == F.col("__size"), F.col(f"__c_{name}")).otherwise(F.col(f"__i_{name}"))
        return self

    def before(self, name: str, value: Column) -> Carried:
        """The last value before that isn't null."""
        held = F.when(value.isNotNull(), F.col(PLACE))
        self._own(name, value, F.last(value, True).over(self.local.rowsBetween(*self.before_rows)), F.max_by(value, held), lambda end: F.last(end, True).over(self.over.rowsBetween(*self.before_rows)))
        self.out[name] = F.coalesce(f"__i_{name}", f"__c_{name}")
        return self

    def after(self, name: str, value: Column) -> Carried:
        """The next value that isn't null."""
        held = F.when(value.isNotNull(), F.col(PLACE))
        self.looked[f"__v_{name}"] = value
        self._own(name, value, next_known(f"__v_{name}", self.local), F.min_by(value, held), lambda end: next_known(f"__e_{name}", self.over))
        self.out[name] = F.coalesce(f"__i_{name}", f"__c_{name}")
        return self

    def total(self, name: str, value: Column) -> Carried:
        """The sum of the values up to the row, its own included; null while there is none."""
        running = F.sum(value).over(self.local.rowsBetween(Window.unboundedPreceding, 0))
        self._own(name, value, running, F.sum(value), lambda end: F.sum(end).over(self.over.rowsBetween(*self.before_rows)))
        self.out[name] = F.when(F.col(f"__i_{name}").isNotNull() | F.col(f"__c_{name}").isNotNull(), F.coalesce(f"__i_{name}", F.lit(0)) + F.coalesce(f"__c_{name}", F.lit(0)))
        return self

    def place(self, name: str) -> Carried:
        """The row's number in its list, from 1."""
        return self.total(name, F.lit(1).cast("long"))

    def _own(self, name: str, value: Column, inner: Column, end: Column, carry) -> None:
        self.inner[f"__i_{name}"] = inner
        self.ends[f"__e_{name}"] = end
        self.carry[f"__c_{name}"] = carry(F.col(f"__e_{name}"))

    def rows(self) -> DataFrame:
        marked = self.placed.withColumn(PLACE, F.row_number().over(self.local)).withColumns(self.looked).withColumns(self.inner)
        # One row for each piece of a list.
        numbered = self.placed.withColumn(PLACE, F.row_number().over(self.local))
        ends = numbered.groupBy(*self.within, PIECE).agg(F.count(F.lit(1)).alias("__size"), *[v.alias(k) for k, v in self.ends.items()])
        carried = ends.withColumns(self.carry).select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(self.within)], F.col(PIECE).alias("__p"), "__size", *self.carry)
        on = F.col(PIECE) == F.col("__p")
        for i, c in enumerate(self.within):
            on = on & F.col(c).eqNullSafe(F.col(f"__w{i}"))
        return marked.join(carried, on).withColumns(self.out).select(*self.columns, *self.out)


def breaks(df: DataFrame, bucket: str, order: list[Column], within: list[str], out: str = "is_break", pieces: int | None = None) -> DataFrame:
    """Marks rows whose bucket differs from that of the row before, and the first of each list."""
    # The bucket in a struct, so that a null one differs from none.
    rows = Carried(df, within, order, pieces).lag("__was", F.struct(F.col(bucket).alias("b"))).rows()
    same = F.col("__was").isNotNull() & F.col(bucket).eqNullSafe(F.col("__was.b"))
    first = F.col("__was").isNull() & F.col(bucket).isNull()  # as a lag of the plain column has it
    return rows.withColumn(out, ~(same | first)).drop("__was")


def neighbours(df: DataFrame, order: list[Column], within: list[str], gone: str, pieces: int | None = None) -> DataFrame:
    """Previous and next row, and the row to open when the rows marked ``gone`` leave: the next that stays, else the one before."""
    stays = F.when(~F.col(gone), F.col("id"))
    seen = Carried(df, within, order, pieces).lag("prev_id", F.col("id")).lead("next_id", F.col("id")).after("__after", stays).before("__before", stays)
    return seen.rows().withColumn("advance_to", F.coalesce("__after", "__before")).drop("__after", "__before")


def between(df: DataFrame, order: list[Column], within: list[str], *ends, pieces: int | None = None) -> DataFrame:
    """The rows from one of these ids to another, both included, whichever comes first."""
    placed = table(Carried(df, within, order, pieces).place("__n").rows(), "placed")
    marks = placed.filter(F.col("id").isin(*ends)).groupBy(*within).agg(F.min("__n").alias("__a"), F.max("__n").alias("__b"))
    # At most a row for each given id.
    return placed.join(F.broadcast(marks), within).filter("__n between __a and __b").drop("__n", "__a", "__b")


def advances(df: DataFrame, within: list[str], order: list[Column], width: str, pieces: int | None = None) -> DataFrame:
    """Running sums of ``width`` along each list."""
    return Carried(df, within, order, pieces).total("advance", F.col(width)).rows()


class Pages:
    """Messages stored by ranges of each folder's order, with counts by flags, for pages at any depth.

    ``counts`` has a row for each piece, folder and combination of flags. The pieces that hold a page are found by summing these;
    a page reads and sorts them alone, and there are no more of them than rows on the page.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[Column]):
        self.spark, self.path, self.order = spark, path, order
        self.rows, self.counts = (spark.read.parquet(f"{path}/{part}") for part in ("rows", "counts"))

    @classmethod
    def build(cls, messages: DataFrame, order: list[Column], path: str, flags: tuple[str, ...] = ("seen", "flagged"), pieces: int | None = None) -> Pages:
        n = _pieces(messages.sparkSession, pieces)
        ranged = messages.repartitionByRange(n, F.col("folder").asc(), *order)
        ranged.withColumn("piece", F.spark_partition_id()).write.partitionBy("piece").parquet(f"{path}/rows")
        rows = messages.sparkSession.read.parquet(f"{path}/rows")
        rows.groupBy("folder", "piece", *flags).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/counts")
        return cls(messages.sparkSession, path, order)

    def placed(self, folder: str, flagged: Column | None = None, where: Column | None = None) -> DataFrame:
        """(piece, n, before): how many rows of the folder each piece holds, and all pieces before it.

        ``flagged`` is a condition on flags alone, answered by the counts; for any other (``where``) the folder's rows are
        counted in one pass without a sort.
        """
        source = self.counts if where is None else self.rows.withColumn("n", F.lit(1))
        for condition in (F.col("folder") == folder, flagged, where):
            source = source.filter(condition) if condition is not None else source
        sums = source.groupBy("folder", "piece").agg(F.sum("n").cast("long").alias("n"))
        before = Window.partitionBy("folder").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("piece", "n", "before")

    def page(self, folder: str, offset: int, limit: int, flagged: Column | None = None, where: Column | None = None) -> DataFrame:
        held = self.placed(folder, flagged, where).filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).collect()
        skipped = min((r["before"] for r in held), default=offset)
        rows = self.rows.filter(F.col("piece").isin([r["piece"] for r in held]))
        for condition in (F.col("folder") == folder, flagged, where):
            rows = rows.filter(condition) if condition is not None else rows
        return rows.orderBy(*self.order).offset(offset - skipped).limit(limit).drop("piece")

    def page_with_total(self, folder: str, offset: int, limit: int, flagged: Column | None = None, where: Column | None = None) -> DataFrame:
        """A page with the number of all rows and the next offset, or null at the end."""
        total = self.placed(folder, flagged, where).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
        out = self.page(folder, offset, limit, flagged, where).withColumn("total", total)
        return out.withColumn("next", F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit)))
