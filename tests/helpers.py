"""Building small nested records and comparing rows."""

from pyspark.sql import types as T


def complete(data_type, value):
    """A nested value with unset fields filled in as None."""
    if value is None:
        return None
    if isinstance(data_type, T.StructType):
        return tuple(complete(f.dataType, value.get(f.name)) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return [complete(data_type.elementType, v) for v in value]
    return value


def records(spark, schema, rows):
    return spark.createDataFrame([complete(schema, row) for row in rows], schema)


def values(rows, *columns):
    picked = rows.select(*columns) if columns else rows
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def rounded(rows, *columns, digits=6):
    return sorted(
        (tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in values(rows, *columns)),
        key=repr,
    )
