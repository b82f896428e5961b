"""Spark's JVM classes and expressions, for what its SQL functions leave out."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column


class Jvm:
    """Spark's own classes, expressions and Scala values by short names."""

    def __init__(self, sc: SparkContext | None = None):
        self.sc = sc or SparkContext._active_spark_context
        self.jvm = self.sc._jvm

    def cls(self, name: str):
        return self.jvm.java.lang.Class.forName(
            name, True, self.jvm.java.lang.Thread.currentThread().getContextClassLoader())

    def module(self, name: str):
        """A Scala object; its methods cannot be mistaken for a class's own."""
        return self.cls(name + "$").getField("MODULE$").get(None)

    def seq(self, items: list):
        held = self.jvm.java.util.ArrayList()
        for item in items:
            held.add(item)
        return self.jvm.org.apache.spark.api.python.PythonUtils.toSeq(held)

    def some(self, value):
        return self.module("scala.Option").apply(value)

    def none(self):
        return self.module("scala.Option").empty()

    def kind(self, text: str):
        """A SQL type by its DDL text, or the type of JVM objects of a class."""
        return self.jvm.org.apache.spark.sql.types.DataType.fromDDL(text)

    def object_kind(self, name: str):
        return self.jvm.org.apache.spark.sql.types.ObjectType(self.cls(name))

    def literal(self, value):
        return self.module("org.apache.spark.sql.catalyst.expressions.Literal").apply(value)

    def invoke(self, target, method: str, kind, *args, pure: bool = True):
        """A method of an object; where it is not ``pure``, called once a row, in order."""
        return self.jvm.org.apache.spark.sql.catalyst.expressions.objects.Invoke(
            target, method, kind, self.seq(list(args)), self.seq([]), True, False, pure)

    def static(self, name: str, method: str, kind, *args, pure: bool = True):
        """A static method of a class."""
        return self.jvm.org.apache.spark.sql.catalyst.expressions.objects.StaticInvoke(
            self.cls(name), kind, method, self.seq(list(args)), self.seq([]), True, False, pure, self.none())

    def instance(self, name: str, args: list):
        return self.jvm.org.apache.spark.sql.catalyst.expressions.objects.NewInstance(
            self.cls(name), self.seq(args), self.seq([]), False, self.object_kind(name), self.none())

    def expression(self, column: Column):
        return self.jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(column._jc)

    def column(self, expression) -> Column:
        return Column(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))
