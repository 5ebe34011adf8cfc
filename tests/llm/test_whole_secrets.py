"""The whole secret is redacted, not only what it is told by."""

import re

from landgrain.llm import secret_scan


def test_key_bodies_and_long_logins_are_redacted(spark):
    body = "\n".join("MIIEpAIBAAKCAQEA7bq" + "Zx9/+" * 9 for _ in range(5)) + "\nAb9="
    end = "\n-----END RSA PRIVATE KEY-----"
    begin = "-----BEGIN RSA PRIVATE KEY-----"
    keys = [
        (f"x {begin}\nProc-Type: 4,ENCRYPTED\n\n{body}{end}\nafter it", "x [REDACTED]\nafter it"),
        (f"x {begin}\n{body}\nNext is prose here", "x [REDACTED]\nNext is prose here"),
        (f"{begin}\\n" + body.replace("\n", "\\n") + '"}', '[REDACTED]"}'),
        (f"{begin}\n{body}\n{begin}\n{body}{end} z", "[REDACTED]\n[REDACTED] z"),
        (f"the line {begin} alone. Then prose.", "the line [REDACTED] alone. Then prose."),
        ("redis://:password@host", "[REDACTED]host"),
        ("https://user:" + "a" * 93 + "@host " + "https://" + "b" * 120 + ":c@host", "[REDACTED]host [REDACTED]host"),
        ("http://host:80/path mail@host", "http://host:80/path mail@host"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(keys)], "doc_id long, text string")
    got = {r.doc_id: r.scan.redacted for r in secret_scan.scanned(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(keys)}
    assert all(secret_scan.trigram_query(r.pattern) and re.compile(r.pattern) for r in secret_scan.RULES)
