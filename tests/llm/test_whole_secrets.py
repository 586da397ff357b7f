"""Spans cover the whole secret."""

import base64
import random

import duckdb

from lodestar.llm import secrets, sql

from ..oracle import rows_of


def body(n, seed):
    text = base64.b64encode(random.Random(seed).randbytes(n)).decode()
    return "\n".join(text[i : i + 64] for i in range(0, len(text), 64))


def test_whole_keys_and_credentials(spark):
    begin, end, head = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F\n\n"
    keys = [
        f"{begin}\n{body(1190, 1)}\n{end}", f"{begin}\n{head}{body(1190, 2)}\n{end}", f"{begin} {body(1190, 3)}".replace("\n", " "),
        f"{begin}\n{head}{body(1190, 4)}", f"{begin}\n{body(9450, 5)}", f"{begin}\n{body(100_000, 6)}\n{end}", "://user:" + "p" * 90 + "@", "://" + "u" * 90 + ":p@",
    ]
    docs = spark.createDataFrame([(k, f"Some text. {x} the rest - of it.") for k, x in enumerate(keys)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean == {k: "Some text. [secret] the rest - of it." for k in range(len(keys))}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    expected = con.sql(sql.secrets(secrets.RULES))
    found = secrets.digest(secrets.scan(docs))
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(expected.columns, expected.fetchall())
