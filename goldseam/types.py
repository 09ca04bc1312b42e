"""How Python, database and Spark types correspond."""

from __future__ import annotations

import datetime as dt
import decimal
import types as pytypes
import typing

from pyspark.sql import types as T

# The four names that inference yields, and their Spark types.
SPARK_TYPES = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "wide": T.DecimalType(38, 0),
}

# Contract types. A time of day is kept as ``HH:mm:ss`` text.
PYTHON_TYPES = {
    str: T.StringType(),
    int: T.LongType(),
    float: T.DoubleType(),
    bool: T.BooleanType(),
    dt.datetime: T.TimestampNTZType(),
    dt.date: T.DateType(),
    dt.time: T.StringType(),
    decimal.Decimal: T.DecimalType(38, 9),
    bytes: T.BinaryType(),
    bytearray: T.BinaryType(),
    dict: T.VariantType(),
    list: T.VariantType(),
    type(None): T.StringType(),
}

# Declared database type -> inferred name; anything else is text.
DECLARED_TYPES = {
    "TEXT": "str", "VARCHAR": "str", "CHAR": "str", "CLOB": "str", "STRING": "str",
    "INTEGER": "int", "INT": "int", "TINYINT": "int", "SMALLINT": "int", "BIGINT": "int",
    "NUMERIC": "float", "REAL": "float", "DOUBLE": "float", "FLOAT": "float", "DECIMAL": "float",
    "BOOLEAN": "bool", "BOOL": "bool",
    "BLOB": "str",
}


def declared_type(declaration: str) -> str:
    """``VARCHAR(40)`` -> ``str``: the length is dropped before the lookup."""
    return DECLARED_TYPES.get(declaration.upper().split("(")[0].strip(), "str")


def spark_type(python_type) -> T.DataType:
    """Spark type of a contract annotation; ``Optional[X]`` counts as ``X``."""
    if typing.get_origin(python_type) in (typing.Union, pytypes.UnionType):
        members = [a for a in typing.get_args(python_type) if a is not type(None)]
        python_type = members[0] if members else str
    base = typing.get_origin(python_type) or python_type
    return PYTHON_TYPES.get(base, T.StringType())


def contract_schema(contract: type) -> T.StructType:
    """Schema of an annotated class (dataclass, TypedDict or model class)."""
    return T.StructType(
        [T.StructField(name, spark_type(hint)) for name, hint in typing.get_type_hints(contract).items()]
    )


def inferred_schema(schema_map: dict[str, str], nullable: set[str] | None = None) -> T.StructType:
    """Schema of an inferred map; columns outside ``nullable`` are required."""
    return T.StructType(
        [
            T.StructField(name, SPARK_TYPES[kind], nullable is None or name in nullable)
            for name, kind in schema_map.items()
        ]
    )
