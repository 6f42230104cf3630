"""Fluent queries over a collection: the expression language behind method chaining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsheet.functions.document import Val
from loomsheet.plans.docsql import _aggregates, _name
from loomsheet.plans.expressions import Builder, parse


def _condition(df: DataFrame, text: str, parameters: dict | None = None) -> Column:
    return Builder(df, parameters).build(parse(text)).col


class Predicate:
    """A condition by its expression text and parameters; ``&`` and ``|`` combine."""

    _serial = 0

    def __init__(self, text: str, parameters: dict):
        self.text, self.parameters = text, parameters

    def __and__(self, other: Predicate) -> Predicate:
        return all_of(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return any_of(self, other)


def _test(field: str, op: str, *values) -> Predicate:
    names = []
    parameters = {}
    for value in values:
        Predicate._serial += 1
        name = f"p{Predicate._serial}"
        names.append("@" + name)
        parameters[name] = value
    return Predicate(f"{field} {op} " + " AND ".join(names), parameters)


def eq(field: str, value) -> Predicate:
    return _test(field, "=", value)


def negate(field: str, value) -> Predicate:
    return _test(field, "!=", value)


def lt(field: str, value) -> Predicate:
    return _test(field, "<", value)


def lte(field: str, value) -> Predicate:
    return _test(field, "<=", value)


def gt(field: str, value) -> Predicate:
    return _test(field, ">", value)


def gte(field: str, value) -> Predicate:
    return _test(field, ">=", value)


def between(field: str, low, high) -> Predicate:
    return _test(field, "BETWEEN", low, high)


def starts_with(field: str, value: str) -> Predicate:
    return _test(field, "LIKE", value + "%")


def contains(field: str, value: str) -> Predicate:
    return _test(field, "LIKE", f"%{value}%")


def ends_with(field: str, value: str) -> Predicate:
    return _test(field, "LIKE", "%" + value)


def isin(field: str, values: list) -> Predicate:
    return _test(field, "IN", list(values))


def any_in(field: str, op: str, value) -> Predicate:
    return _test(f"{field}[*]", f"ANY {op}", value)


def all_in(field: str, op: str, value) -> Predicate:
    return _test(f"{field}[*]", f"ALL {op}", value)


def _joined(word: str, parts: tuple[Predicate, ...]) -> Predicate:
    return Predicate("(" + f" {word} ".join(p.text for p in parts) + ")", {k: v for p in parts for k, v in p.parameters.items()})


def all_of(*parts: Predicate) -> Predicate:
    return _joined("AND", parts)


def any_of(*parts: Predicate) -> Predicate:
    return _joined("OR", parts)


class Query:
    """One query; several ``where`` calls add up."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._order: list[tuple[str, bool]] = []
        self._group = self._having = None
        self._skip = self._limit = None
        self._select: list[str] = []

    def where(self, condition: Predicate | str, parameters: dict | None = None) -> Query:
        text, given = (condition.text, condition.parameters) if isinstance(condition, Predicate) else (condition, parameters)
        self.df = self.df.filter(_condition(self.df, text, given))
        return self

    def order_by(self, *expressions: str) -> Query:
        self._order += [(e, False) for e in expressions]
        return self

    def order_by_descending(self, expression: str, *then: str) -> Query:
        self._order += [(expression, True), *((e, False) for e in then)]
        return self

    def group_by(self, expression: str) -> Query:
        self._group = expression
        return self

    def having(self, expression: str) -> Query:
        self._having = expression
        return self

    def skip(self, n: int) -> Query:
        self._skip = n
        return self

    offset = skip

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def select(self, *expressions: str) -> Query:
        self._select = list(expressions)
        return self

    def _columns(self, df: DataFrame, key: Val | None = None) -> list[Column]:
        out = []
        for place, text in enumerate(self._select):
            body, _, alias = text.partition(" AS ")
            node = parse(body)
            out.append(Builder(df, key=key).build(node).col.alias(alias.strip() or _name(node, place)))
        return out

    def to_documents(self) -> DataFrame:
        df = self.df
        if self._group:
            base = Builder(df).build(parse(self._group))
            key = Val(F.col("_key"), base.kind)
            extra = [F.coalesce(Builder(df, key=key).build(parse(self._having)).col, F.lit(False)).alias("_having")] if self._having else []
            df = df.withColumn("_key", base.col).groupBy("_key").agg(*self._columns(df, key), *extra)
            df = df.filter("_having").drop("_having") if extra else df
            df = df.drop("_key")
        elif self._select and any(_aggregates(parse(t.partition(" AS ")[0])) for t in self._select):
            df = df.agg(*self._columns(df))
        if self._order and not self._group:
            keys = [(Builder(df).build(parse(e)).col, d) for e, d in self._order]
            df = df.orderBy(*[k.desc_nulls_last() if d else k.asc_nulls_first() for k, d in keys])
        if self._skip:
            df = df.offset(self._skip)
        if self._limit is not None:
            df = df.limit(self._limit)
        if self._select and not self._group and not any(_aggregates(parse(t.partition(" AS ")[0])) for t in self._select):
            df = df.select(*self._columns(df))
        return df

    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.to_documents().collect()]

    def first_or_default(self) -> dict | None:
        row = self.to_documents().first()
        return row.asDict(recursive=True) if row else None

    def first(self) -> dict:
        found = self.first_or_default()
        if found is None:
            raise LookupError("no document")
        return found

    def single_or_default(self) -> dict | None:
        rows = self.to_documents().limit(2).collect()
        if len(rows) > 1:
            raise LookupError("more than one document")
        return rows[0].asDict(recursive=True) if rows else None

    def single(self) -> dict:
        found = self.single_or_default()
        if found is None:
            raise LookupError("no document")
        return found

    def count(self) -> int:
        return self.to_documents().count()

    long_count = count

    def exists(self) -> bool:
        return not self.to_documents().isEmpty()

    def get_plan(self) -> str:
        df = self.to_documents()
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


class Collection:
    def __init__(self, df: DataFrame, key: str = "_id"):
        self.df, self.key = df, key

    def query(self) -> Query:
        return Query(self.df)

    def find(self, condition: Predicate | str, parameters: dict | None = None) -> DataFrame:
        return self.query().where(condition, parameters).to_documents()

    def find_by_id(self, value) -> dict | None:
        return self.query().where(eq(self.key, value)).first_or_default()

    def find_one(self, condition: Predicate | str) -> dict | None:
        return self.query().where(condition).first_or_default()

    def find_all(self) -> DataFrame:
        return self.df

    def min(self, field: str):
        return self.df.agg(F.min(field)).first()[0]

    def max(self, field: str):
        return self.df.agg(F.max(field)).first()[0]

    def summary(self, field: str) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"), F.min(field).alias("least"), F.max(field).alias("most"))
