"""SQL over documents: SELECT, INSERT, UPDATE, DELETE and catalog commands to DataFrames.

Tables are DataFrames in a ``Database``; commands that change a table bind its name to a new, immutable
DataFrame.  GROUP BY may be combined with ORDER BY and INCLUDE, and ``@key`` is always the current key.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsheet.functions.document import Val
from loomsheet.plans.expressions import Builder, Node, Parser, Tokens
from loomsheet.sources import files

PRAGMAS = {"USER_VERSION": 0, "COLLATION": "en-US/IgnoreCase", "TIMEOUT": 60, "LIMIT_SIZE": 0, "UTC_DATE": False, "CHECKPOINT": 1000}


def _name(node: Node, place: int) -> str:
    if node.op == "field":
        return node.value
    if node.op == "key":
        return "key"
    if node.op in ("call", "lambda"):
        return node.value.lower() if place == 0 else f"{node.value.lower()}{place}"
    return "expr" if place == 0 else f"expr{place}"


def _aggregates(node: Node) -> bool:
    """Whether a tree reads the source as a whole."""
    return node.op == "source" or any(_aggregates(a) for a in node.args if isinstance(a, Node))


class Database:
    """Named tables and the commands on them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, legacy: bool = False):
        self.spark, self.legacy = spark, legacy
        self.tables = dict(tables or {})
        self.indexes: dict[str, tuple[str, str, bool]] = {}
        self.pragmas = dict(PRAGMAS)
        self.sources: dict[str, Callable[..., DataFrame]] = {}

    def register_source(self, name: str, read: Callable[..., DataFrame]) -> None:
        """A system collection of one's own: ``FROM $name(arguments)`` calls ``read(spark, argument)``."""
        self.sources["$" + name.lstrip("$")] = read

    # --- parsing -----------------------------------------------------------------------------------

    def execute(self, sql: str, parameters: dict | None = None) -> DataFrame:
        self.parameters = {str(k): v for k, v in (parameters or {}).items()}
        tokens = Tokens(sql.strip().rstrip(";"))
        self.t, self.p = tokens, Parser(tokens, self.legacy)
        explain = tokens.accept("EXPLAIN")
        word = tokens.next().word
        handler: Callable | None = getattr(self, "_do_" + word.lower(), None)
        if handler is None:
            raise ValueError(f"unknown command {word}")
        result = handler()
        if tokens.peek().kind != "end":
            raise ValueError(f"unexpected {tokens.peek().text!r}")
        if explain:
            plan = result._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(plan,)], "plan string")
        return result

    def _source(self) -> DataFrame:
        t = self.t
        name = t.next().text
        if name.startswith("$"):
            return self._system(name)
        if name not in self.tables:
            raise ValueError(f"no collection {name}")
        return self.tables[name]

    def _system(self, name: str) -> DataFrame:
        arguments = None
        if self.t.accept("("):
            arguments = self.p.expression()
            self.t.expect(")")
        if name in self.sources:
            value = None if arguments is None else arguments.value if arguments.op == "lit" else dict(zip(arguments.value, [a.value for a in arguments.args], strict=True))
            return self.sources[name](self.spark, value)
        if name == "$cols":
            return self.spark.createDataFrame([(n, "user") for n in sorted(self.tables)], "name string, type string")
        if name == "$indexes":
            rows = [(c, n, e, u) for n, (c, e, u) in sorted(self.indexes.items())]
            return self.spark.createDataFrame(rows, "collection string, name string, expression string, unique boolean")
        if name == "$database":
            return self.spark.createDataFrame([(len(self.tables), json.dumps(self.pragmas))], "collections int, pragmas string")
        if name == "$sequences":
            return self.spark.createDataFrame([], "collection string, value bigint")
        if name == "$query":
            return Database(self.spark, self.tables, self.legacy).execute(arguments.value)
        if name == "$file":
            if arguments.op == "lit":
                return files.read_file(self.spark, arguments.value)
            options = {k: n.value if n.op == "lit" else [a.value for a in n.args] for k, n in zip(arguments.value, arguments.args, strict=True)}
            return files.read_file(self.spark, options.pop("filename"), **options)
        raise ValueError(f"{name} belongs to the storage engine and has no counterpart")

    def _clauses(self, *words: str) -> bool:
        return self.t.accept(*words)

    # --- queries -----------------------------------------------------------------------------------

    def _do_select(self) -> DataFrame:
        t, p = self.t, self.p
        selects: list[tuple[Node, str | None]] = []
        distinct_all = t.accept("ALL")
        while True:
            node = p.expression()
            alias = t.next().text if t.accept("AS") else None
            selects.append((node, alias))
            if not t.accept(","):
                break
        into = None
        if t.accept("INTO"):
            into = self._target()
        if not t.accept("FROM"):
            df = self.spark.range(1).select(F.lit(1).alias("_one"))
            return self._project(df, selects)
        df = self._source()
        includes: list[Node] = []
        if t.accept("INCLUDE"):
            includes.append(p.expression())
            while t.accept(","):
                includes.append(p.expression())
        for node in includes:
            df = self.include(df, node.value)
        if t.accept("WHERE"):
            node = p.expression()
            if _aggregates(node):
                raise ValueError("WHERE looks at one document at a time")
            df = df.filter(self._build(df, node).col)  # bare, so that it reaches the scan
        group = having = None
        if t.accept("GROUP"):
            t.expect("BY")
            group = p.expression()
            if t.accept("HAVING"):
                having = p.expression()
        order: list[tuple[Node, bool]] = []
        if t.accept("ORDER"):
            t.expect("BY")
            while True:
                node = p.expression()
                down = t.accept("DESC")
                if not down:
                    t.accept("ASC")
                order.append((node, down))
                if not t.accept(","):
                    break
        offset = limit = None
        for _ in range(2):
            if t.accept("LIMIT"):
                limit = self._number()
            elif t.accept("OFFSET"):
                offset = self._number()
        t.accept("FOR") and t.expect("UPDATE")
        if group is not None:
            out = self._grouped(df, group, having, selects, order)
        elif any(_aggregates(n) for n, _ in selects):
            out = df.agg(*self._columns(df, selects, None))
        else:
            if order:
                keys = [self._build(df, n).col for n, _ in order]
                df = df.orderBy(*[k.desc_nulls_last() if down else k.asc_nulls_first() for k, (_, down) in zip(keys, order, strict=True)])
            if offset:
                df = df.offset(offset)
            if limit is not None:
                df = df.limit(limit)
            out, offset, limit = self._project(df, selects), None, None
        if offset:
            out = out.offset(offset)
        if limit is not None:
            out = out.limit(limit)
        del distinct_all
        return self._into(out, into) if into else out

    def _number(self) -> int:
        node = self.p.primary()
        return int(self.parameters[node.value] if node.op == "param" else node.value)

    def _build(self, df: DataFrame, node: Node, key: Val | None = None) -> Val:
        return Builder(df, self.parameters, key).build(node)

    def _columns(self, df: DataFrame, selects: list[tuple[Node, str | None]], key: Val | None) -> list[Column]:
        out = []
        for place, (node, alias) in enumerate(selects):
            if node.op == "doc" and alias is None and len(selects) == 1:
                out += [self._build(df, n, key).col.alias(k) for k, n in zip(node.value, node.args, strict=True)]
            elif node.op in ("root", "source") and alias is None and key is None:
                out += [F.col(f"`{c}`") for c in df.columns]
            else:
                out.append(self._build(df, node, key).col.alias(alias or _name(node, place)))
        return out

    def _project(self, df: DataFrame, selects: list[tuple[Node, str | None]]) -> DataFrame:
        return df.select(*self._columns(df, selects, None))

    def _grouped(self, df: DataFrame, group: Node, having: Node | None, selects, order) -> DataFrame:
        base = self._build(df, group)
        keyed = df.withColumn("_key", base.col)
        key = Val(F.col("_key"), base.kind, dtype=base.dtype)
        columns = self._columns(df, selects, key)
        extra = [F.coalesce(self._build(df, having, key).col, F.lit(False)).alias("_having")] if having is not None else []
        sorts = [self._build(df, n, key).col.alias(f"_order{i}") for i, (n, _) in enumerate(order)]
        # aggregates may be mixed with the key in one expression, which a grouped aggregate allows
        out = keyed.groupBy("_key").agg(*columns, *extra, *sorts)
        if having is not None:
            out = out.filter("_having")
        if order:
            out = out.orderBy(*[F.col(f"_order{i}").desc_nulls_last() if d else F.col(f"_order{i}").asc_nulls_first() for i, (_, d) in enumerate(order)])
        return out.drop("_key", "_having", *[f"_order{i}" for i in range(len(order))])

    def include(self, df: DataFrame, path: str, ref: str | None = None) -> DataFrame:
        """Dereference ``{id, coll}`` structs (or arrays of them) against the tables they name.

        A reference becomes a struct of the referenced columns with its ``id`` and ``missing``; tables
        are joined on ``_id``, which must be unique; arrays keep their order.
        """
        dtype = df.schema[path].dataType
        many = isinstance(dtype, T.ArrayType)
        name = ref or next(iter(self.tables))
        target = self.tables[name]
        fields = [c for c in target.columns if c != "_id"]
        packed = target.select(F.col("_id").alias("_rid"), F.struct(*[F.col(f"`{c}`") for c in fields]).alias("_doc"))

        def merged() -> Column:
            return F.struct(F.col("_r.id").alias("id"), F.col("_doc").isNull().alias("missing"), *[F.col("_doc").getField(c).alias(c) for c in fields])

        if not many:
            joined = df.withColumn("_r", F.col(path)).join(packed, F.col("_r.id") == F.col("_rid"), "left")
            return joined.withColumn(path, F.when(F.col("_r").isNotNull(), merged())).select(*df.columns)
        rows = df.withColumn("_row", F.xxhash64(*[F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))]))
        flat = rows.select("_row", F.posexplode(path).alias("_pos", "_r")).distinct()
        found = flat.join(packed, F.col("_r.id") == F.col("_rid"), "left").select("_row", F.struct("_pos", merged().alias("v")).alias("e"))
        lists = found.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e.getField("v")).alias("_list"))
        return rows.join(lists, "_row", "left").withColumn(path, F.col("_list")).select(*df.columns)

    # --- changes -----------------------------------------------------------------------------------

    def _target(self) -> tuple[str, object]:
        name = self.t.next().text
        if name == "$file":
            self.t.expect("(")
            node = self.p.expression()
            self.t.expect(")")
            options = {"filename": node.value} if node.op == "lit" else {k: n.value for k, n in zip(node.value, node.args, strict=True)}
            return name, options
        kind = self.t.next().text if self.t.accept(":") else None
        return name, kind

    def _with_id(self, df: DataFrame, kind: str | None) -> DataFrame:
        if "_id" in df.columns:
            return df
        kind = (kind or "objectid").lower()
        if kind in ("int", "int32", "int64", "long"):
            new = (F.monotonically_increasing_id() + 1).cast("int" if kind.startswith("int") and kind != "int64" else "bigint")
        else:
            new = F.expr("uuid()") if kind == "guid" else F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 24)
        return df.select(new.alias("_id"), *df.columns)

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "value int")

    def _into(self, df: DataFrame, target: tuple[str, object]) -> DataFrame:
        name, kind = target
        if name == "$file":
            options = dict(kind)  # type: ignore[arg-type]
            files.write_file(df, options.pop("filename"), **options)
            return self._count(df.count())
        rows = self._with_id(df, kind)  # type: ignore[arg-type]
        self.tables[name] = self.tables[name].unionByName(rows, allowMissingColumns=True) if name in self.tables else rows
        return self._count(df.count())

    def _do_insert(self) -> DataFrame:
        t = self.t
        t.expect("INTO")
        name, kind = self._target()
        t.expect("VALUES")
        rows = []
        one = self.spark.range(1)
        while True:
            node = self.p.expression()
            rows.append(one.select(*[self._build(one, n).col.alias(k) for k, n in zip(node.value, node.args, strict=True)]))
            if not t.accept(","):
                break
        if t.accept("WITH"):
            t.expect("ID")
            t.expect("=")
            kind = t.next().text
        new = rows[0]
        for r in rows[1:]:
            new = new.unionByName(r, allowMissingColumns=True)
        return self._into(new, (name, kind))

    def upsert(self, name: str, rows: DataFrame) -> int:
        """Replace documents by ``_id``, append the others."""
        if name not in self.tables:
            self.tables[name] = self._with_id(rows, None)
            return rows.count()
        kept = self.tables[name].join(rows.select("_id"), "_id", "left_anti")
        self.tables[name] = kept.unionByName(rows, allowMissingColumns=True)
        return rows.count()

    def _do_update(self) -> DataFrame:
        t = self.t
        name = t.next().text
        t.expect("SET")
        df = self.tables[name]
        sets: dict[str, Node] = {}
        while True:
            node = self.p.primary() if t.peek().text == "{" else None
            if node is not None:
                sets.update(zip(node.value, node.args, strict=True))
            else:
                field = self.p.primary()
                t.expect("=")
                sets[field.value] = self.p.expression()
            if not t.accept(","):
                break
        if "_id" in sets:
            raise ValueError("_id can't be changed")
        condition = F.lit(True)
        if t.accept("WHERE"):
            condition = F.coalesce(self._build(df, self.p.expression()).col, F.lit(False))
        changed = df.filter(condition).count()
        old = {c.lower(): c for c in df.columns}
        new = {}
        for field, node in sets.items():
            column = old.get(field.lower(), field)
            value = self._build(df, node).col
            new[column] = F.when(condition, value).otherwise(F.col(f"`{column}`") if field.lower() in old else F.lit(None))
        self.tables[name] = df.withColumns(new)
        return self._count(changed)

    def _do_delete(self) -> DataFrame:
        name = self.t.next().text
        df = self.tables[name]
        condition = F.lit(True)
        if self.t.accept("WHERE"):
            condition = F.coalesce(self._build(df, self.p.expression()).col, F.lit(False))
        gone = df.filter(condition).count()
        self.tables[name] = df.filter(~condition)
        return self._count(gone)

    # --- catalog -----------------------------------------------------------------------------------

    def _do_create(self) -> DataFrame:
        """CREATE [UNIQUE] INDEX: there is no index to build; uniqueness is checked by an aggregate."""
        unique = self.t.accept("UNIQUE")
        self.t.expect("INDEX")
        index = self.t.next().text
        self.t.expect("ON")
        name = self.t.next().text
        self.t.expect("(")
        node = self.p.expression()
        self.t.expect(")")
        v = self._build(self.tables[name], node)
        if unique:
            if v.shape == "seq":
                raise ValueError("an index over the items of an array can't be unique")
            twice = self.tables[name].groupBy(v.col.alias("k")).count().filter("count > 1").limit(1)
            if not twice.isEmpty():
                raise ValueError(f"index {index}: a key occurs more than once")
        self.indexes[index] = (name, _name(node, 0), bool(unique))
        return self.spark.createDataFrame([(True,)], "value boolean")

    def _do_drop(self) -> DataFrame:
        what = self.t.next().word
        name = self.t.next().text
        if what == "INDEX":
            if self.t.accept("."):
                name = self.t.next().text
            done = self.indexes.pop(name, None) is not None
        else:
            done = self.tables.pop(name, None) is not None
        return self.spark.createDataFrame([(done,)], "value boolean")

    def _do_rename(self) -> DataFrame:
        self.t.expect("COLLECTION")
        old = self.t.next().text
        self.t.expect("TO")
        new = self.t.next().text
        if new in self.tables:
            raise ValueError(f"collection {new} exists")
        self.tables[new] = self.tables.pop(old)
        return self.spark.createDataFrame([(True,)], "value boolean")

    def _do_pragma(self) -> DataFrame:
        name = self.t.next().text.upper()
        if name not in self.pragmas:
            raise ValueError(f"unknown pragma {name}")
        if self.t.accept("="):
            self.pragmas[name] = self.p.primary().value
        return self.spark.createDataFrame([(str(self.pragmas[name]),)], "value string")

    def _nothing(self) -> DataFrame:
        """Transactions and compaction: every job replaces whole tables, so there is nothing to do."""
        self.t.accept("TRANSACTION", "TRANS")
        return self.spark.createDataFrame([(True,)], "value boolean")

    _do_begin = _do_commit = _do_rollback = _do_checkpoint = _do_rebuild = _nothing
