"""Rows of a Spark query against those of its SQL, as sorted multisets."""

import datetime
import decimal
import math
import os

import duckdb


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
    con.execute("SET TimeZone = 'UTC'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return sorted(names), rows_of(names, result.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def differences(df, sql, folder):
    """None, or how the two differ."""
    names, found = spark_rows(df)
    wanted_names, wanted = oracle_rows(sql, folder)
    if names != wanted_names:
        return f"columns {names} against {wanted_names}"
    if found == wanted:
        return None
    extra = [x for x in found if x not in set(wanted)][:2]
    lost = [x for x in wanted if x not in set(found)][:2]
    return f"{len(found)} rows against {len(wanted)}; only here: {extra}; only there: {lost}"
