"""Holds queries against their DuckDB SQL."""

import os

import duckdb


def rows_of(columns, rows):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in rows)


def check(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    expected = con.sql(sql)
    found = query(spark, sf_dir)
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(expected.columns, expected.fetchall())
