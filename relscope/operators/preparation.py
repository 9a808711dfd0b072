"""Profiles of columns, proposals of types, cleaning, date parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shares of the rules.
PARSED, LEVELS, NULLS, DISTINCT, EMPTY = 0.99, 0.005, 0.10, 0.20, 0.95
MOST_LEVELS, MOST_DATES = 60, 5
#: Delimiters of concatenated categories.
DELIMITER, HEADER = "_|&|_", "_&_"
PARTS = ("year", "quarter", "month", "day", "hour", "half_hour")


@dataclass(frozen=True)
class Profile:
    column: str
    dtype: str
    rows: int
    n_unique: int
    n_null: int
    proposed: str
    drop: bool = False
    change: bool = False

    @property
    def share_unique(self) -> float:
        return self.n_unique / max(1, self.rows - self.n_null)

    @property
    def share_null(self) -> float:
        return self.n_null / max(1, self.rows)


def _is(df: DataFrame, c: str, *kinds: type) -> bool:
    return isinstance(df.schema[c].dataType, kinds)


def _values(df: DataFrame, c: str) -> Column:
    v = F.col(f"`{c}`")
    return F.when(~F.isnan(v), v) if _is(df, c, T.FloatType, T.DoubleType) else v


def column_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, n_unique, n_null, dates, numbers, wholes) of each column, in one pass over the rows."""
    names = columns or df.columns
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        v, text = _values(df, c), F.col(f"`{c}`").cast("string")
        number = F.expr(f"try_cast(`{c}` AS DOUBLE)") if _is(df, c, T.StringType) else F.lit(None).cast("double")
        date = F.try_to_timestamp(text) if _is(df, c, T.StringType) else F.lit(None).cast("timestamp")
        whole = number.isNotNull() & (F.abs(number) < 1e15) & (number == F.floor(number))
        aggs += [F.count_distinct(v).alias(f"u{i}"), F.count(v).alias(f"n{i}"), F.count(date).alias(f"d{i}"), F.count(number).alias(f"f{i}"), F.count_if(whole).alias(f"w{i}")]
    one = df.agg(*aggs)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"u{i}").alias("n_unique"), (F.col("rows") - F.col(f"n{i}")).alias("n_null"), F.col(f"d{i}").alias("dates"), F.col(f"f{i}").alias("numbers"), F.col(f"w{i}").alias("wholes")) for i, c in enumerate(names)))
    return one.select(F.explode(each).alias("p")).select("p.*")


def propose(dtype: str, rows: int, n_unique: int, n_null: int, dates: int, numbers: int, wholes: int) -> str:
    """The type a column should have: datetime, long, double or category.  Dates are tried before numbers."""
    present = max(1, rows - n_null)
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        return "datetime"
    if dtype == "string":
        if n_null < rows and dates / present >= PARSED:
            return "datetime"
        if n_null < rows and numbers / present > PARSED and n_unique > LEVELS * present:
            return "long" if wholes == numbers else "double"
        return "category"
    if dtype == "boolean":
        return "category"
    if n_unique <= LEVELS * present:
        return "category"
    return "long" if wholes == numbers else "double"


def decide(p: Profile) -> tuple[bool, bool]:
    """(drop, change); the first rule that fits counts."""
    category_now = p.dtype in ("string", "boolean")
    number_now = not category_now and p.dtype not in ("timestamp", "timestamp_ntz", "date")
    both = category_now and p.proposed == "category"
    if p.share_null > EMPTY:
        return True, False
    if p.n_unique < 2 and not category_now and p.proposed != "category":
        return True, False
    if p.n_unique < 2 and p.proposed == "category" and p.share_null > NULLS:
        return False, True
    if p.share_unique > DISTINCT and both:
        return True, False
    if p.share_null > NULLS and number_now and p.proposed == "category" and p.n_unique <= MOST_LEVELS:
        return False, True
    if p.proposed == "datetime" and p.dtype not in ("timestamp", "timestamp_ntz", "date"):
        return False, True
    if p.share_unique > DISTINCT and category_now and p.proposed != "category":
        return False, True
    return False, False


def profiles(df: DataFrame, columns: list[str] | None = None) -> list[Profile]:
    """One per column; the driver holds one small row of counts per column."""
    out, types = [], dict(df.dtypes)
    for r in column_counts(df, columns).collect():
        kind = types[r["column"]]
        counts = {k: r[k] for k in ("rows", "n_unique", "n_null", "dates", "numbers", "wholes")}
        p = Profile(r["column"], kind, r["rows"], r["n_unique"], r["n_null"], propose(kind, **counts))
        out.append(Profile(p.column, p.dtype, p.rows, p.n_unique, p.n_null, p.proposed, *decide(p)))
    return out


def constant_columns(found: list[Profile]) -> list[str]:
    """Columns of one value, unless nulls make up over a tenth."""
    return [p.column for p in found if not (p.n_unique > 1 or (p.n_unique == 1 and p.share_null > NULLS))]


CASTS = {"datetime": "timestamp", "long": "bigint", "double": "double", "category": "string"}


def cleaned(df: DataFrame, found: list[Profile] | None = None) -> DataFrame:
    """Constant and ruled-out columns go, others are cast as proposed where a rule says so; what can't be cast is null."""
    found = found if found is not None else profiles(df)
    gone = {*constant_columns(found), *(p.column for p in found if p.drop)}
    by = {p.column: p for p in found}
    out = []
    for c in df.columns:
        if c in gone:
            continue
        change = c in by and by[c].change
        out.append(F.expr(f"try_cast(`{c}` AS {CASTS[by[c].proposed]})").alias(c) if change else F.col(f"`{c}`"))
    return df.select(*out)


def named_nulls(df: DataFrame, columns: list[str], label: str = "NAN") -> DataFrame:
    """Null categories as a level of their own."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(label)) for c in columns})


def date_parts(df: DataFrame, columns: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Year, quarter, month, day, hour and half hour of up to five timestamps, as categories.

    A part with one value is left out; a name that is taken gets _i, _ii and so on; the
    original goes unless ``keep``.
    """
    names = (columns or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))])[:MOST_DATES]
    parts = {}
    for c in names:
        v = F.col(f"`{c}`")
        parts |= {(c, p): e for p, e in zip(PARTS, (F.year(v), F.quarter(v), F.month(v), F.dayofmonth(v), F.hour(v), F.floor(F.minute(v) / 30)), strict=True)}
    if not parts:
        return df
    n = df.agg(*(F.count_distinct(e).alias(str(i)) for i, e in enumerate(parts.values()))).first()
    taken, out = set(df.columns) - (set() if keep else set(names)), {}
    for i, ((c, p), e) in enumerate(parts.items()):
        if n[i] > 1:
            name, k = f"{c}_{p}", 0
            while name in taken:
                k += 1
                name = f"{c}_{p}_{'i' * k}"
            taken.add(name)
            out[name] = e.cast("string")
    made = df.withColumns(out)
    return made if keep else made.drop(*names)


def concatenated(df: DataFrame, columns: list[str], delimiter: str = DELIMITER, name: str | None = None) -> DataFrame:
    """Adds several categories as one; a null reads 'nan' and is never dropped."""
    parts = [x for c in columns for x in (F.lit(delimiter), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")))][1:]
    return df.withColumn(name or HEADER.join(columns), F.concat(*parts))


def oriented(results: DataFrame, column: str, a: str = "column_a", b: str = "column_b") -> DataFrame:
    """Result rows that touch a column, with it on the left, once each, sorted."""
    own = results.where((F.col(a) == column) | (F.col(b) == column))
    swapped = own.withColumn("_b", F.when(F.col(a) == column, F.col(b)).otherwise(F.col(a))).withColumn(a, F.lit(column)).withColumn(b, F.col("_b")).drop("_b")
    return swapped.dropDuplicates().orderBy(a, b)


def column_pairs(results: DataFrame, a: str = "column_a", b: str = "column_b") -> list[tuple[str, str]]:
    """The pairs of a result, which has one row per pair of columns."""
    return [tuple(r) for r in results.select(a, b).collect()]


def preview(df: DataFrame, n: int = 3, seed: int | None = None) -> DataFrame:
    """A few random rows."""
    return df.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n)
